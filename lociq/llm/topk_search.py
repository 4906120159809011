"""Exact top-k by inner product with a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.scratch import stored

BITS = 8  # of a quantised component: 256 cells between the block's extremes of each dimension
BLOCK_ROWS = 16_384  # vectors in a block of the file
QUERY_ROWS = 1_024  # queries scanned together
HOT_PAIRS = 1_000  # queries that must read one vector before it is sent to them instead of shuffled
_EXACT = float(1 << 53)  # sums of products below it are exact in a double
_SLACK = 1e-12  # of a bound, for the rounding of components beyond 2**53
_LONG = float(1 << 63)


def whole_numbers(embedding: Column) -> Column:
    """floor(1024 * x) of each component x, taken as double, as whole doubles; null if one is null or not finite, before or
    after it is multiplied."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = embedding.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | ((F.abs(1024 * v) == float("inf"))))
    # Doubles from 2**53 on are whole already, and may not fit a long.
    return F.when(fine, F.transform(x, lambda v: F.when(F.abs(v) < _EXACT / 1024, F.floor(1024 * v).cast("double")).otherwise(1024 * v)))


def _pack(rows: DataFrame) -> DataFrame:
    """One row for each block of queries and dimension: the rows' numbers, and the vectors as bytes of whole doubles."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(pdf["v"].tolist(), dtype="<f8")
        return pd.DataFrame({"group": [pdf["block"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "query_rows": [pdf["row"].to_numpy("<i8").tobytes()], "queries": [vectors.tobytes()]})

    return rows.groupBy("block", "dim").applyInPandas(pack, "group long, dim int, query_rows binary, queries binary")


def _approximated(rows: DataFrame) -> DataFrame:
    """The file: for each block and dimension the rows' numbers, the cells of their vectors (a byte a component) and the
    cells' edges. It holds no exact vector."""

    def quantise(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), dtype="<f8")
        low, high = v.min(axis=0), v.max(axis=0)
        share = 1 / (1 << BITS)
        step = np.maximum(1, np.ceil(high * share - low * share + share))
        cells = (v / step - low / step).clip(0, (1 << BITS) - 1) if max(-low.min(), high.max()) >= _EXACT else (v - low) // step
        edges = np.stack([low, step]).astype("<f8")
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "rows": [pdf["row"].to_numpy("<i8").tobytes()], "cells": [cells.astype(np.uint8).tobytes()], "edges": [edges.tobytes()]})

    return rows.groupBy("block", "dim").applyInPandas(quantise, "dim int, rows binary, cells binary, edges binary")


def _exact(query: np.ndarray, vector: np.ndarray) -> int:
    """The inner product of two vectors of whole numbers; kept within a long."""
    if np.abs(query).max() * np.abs(vector).max() * len(query) < _EXACT:
        return int(query @ vector)
    return max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(query, vector, strict=True))))


def _scan(k: int):
    """From blocks of cells and of queries: the rows of the block that can be among a query's best k, with bounds of their
    scores. A row whose upper bound is below the kth lower bound of the block cannot."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                numbers, query_rows = np.frombuffer(row.rows, "<i8"), np.frombuffer(row.query_rows, "<i8")
                queries = np.frombuffer(row.queries, "<f8").reshape(-1, row.dim)
                low, step = np.frombuffer(row.edges, "<f8").reshape(2, -1)
                floor = low + np.frombuffer(row.cells, np.uint8).reshape(-1, row.dim) * step
                top = floor + (step - 1)
                widest = np.maximum(np.abs(low), np.abs(low + step * (1 << BITS)))
                for a in range(0, len(queries), 64):
                    some, own = queries[a : a + 64], query_rows[a : a + 64]
                    above, below = np.maximum(some, 0), np.minimum(some, 0)
                    with np.errstate(over="ignore", invalid="ignore"):
                        slack = _SLACK * (np.abs(some) @ widest)[:, None]
                        upper, lower = above @ top.T + below @ floor.T + slack, above @ floor.T + below @ top.T - slack
                    # A score beyond a long is the nearest long, so its bounds are, too.
                    upper, lower = np.nan_to_num(upper, nan=_LONG).clip(-_LONG, _LONG), np.nan_to_num(lower, nan=-_LONG).clip(-_LONG, _LONG)
                    others = numbers[None, :] != own[:, None]
                    lower[~others] = -np.inf
                    least = np.partition(lower, len(numbers) - k, axis=1)[:, len(numbers) - k] if len(numbers) > k else np.full(len(some), -np.inf)
                    q, c = np.nonzero(others & (upper >= least[:, None]))
                    yield pd.DataFrame({"query_row": own[q], "row": numbers[c], "lower": lower[q, c], "upper": upper[q, c]})

    return scan


def _read(pairs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """(query_row, vec_id, score) of each pair (query_row, row): the exact vectors are read and multiplied.

    A vector that very many queries read is broadcast; there are at most 1,000 of these.
    """
    wanted = stored(pairs.select("query_row", "row"), f"{name}-pairs")
    hot = max(HOT_PAIRS, wanted.count() // 1_000)
    vectors = rows.select("row", "vec_id", "v")
    often = stored(wanted.groupBy("row").count().filter(F.col("count") > hot).join(vectors, "row").drop("count"), f"{name}-hot")
    spread = wanted.join(F.broadcast(often.select("row")), "row", "left_anti").join(vectors, "row")
    asked = rows.filter("asks").select(F.col("row").alias("query_row"), F.col("v").alias("q"))
    score = F.pandas_udf(lambda q, v: pd.Series([_exact(a, b) for a, b in zip(q, v, strict=True)], dtype="int64"), "long")
    return spread.unionByName(wanted.join(F.broadcast(often), "row")).join(asked, "query_row").select("query_row", "vec_id", score("q", "v").alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the ``k`` highest integer inner products with all
    other rows, ties to the smaller vec_id; all, if there are fewer.

    Vectors that are null or empty, or hold a null or non-finite component (also one that is beyond a double when it is
    multiplied by 1024), take no part; nor do rows without vec_id. Every other vector does, however large: products are
    exact whole numbers, and a score beyond a long is the nearest long. Vectors meet only those of their own length.
    Rows, not ids, are queries and candidates: rows that repeat an id are candidates each, of one another too, and a
    repeated query gives its ranks once for each row. Extra columns are ignored; an empty table gives no rows.

    Each block of queries meets each block of cells once; exact vectors stay where they are. Of what the cells leave, the
    2 * k highest bounds of each query are read first, then those whose bound reaches the kth score found. Of equal
    vectors only the k + 1 of least vec_id are candidates: no other can be among any k best.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v"), is_query.alias("asks"))
    rows = rows.withColumn("dim", F.size("v")).filter((F.col("dim") > 0) & F.col("vec_id").isNotNull())
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, groups = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asking // QUERY_ROWS))
    spread = lambda parts: F.pmod(F.xxhash64("vec_id", "row"), F.lit(parts))
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    file = stored(_approximated(rows.withColumn("copy", copy).filter(F.col("copy") <= k + 1).withColumn("block", spread(blocks))), "cells")
    queries = _pack(rows.filter("asks").withColumn("block", spread(groups)))
    met = file.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).join(queries, ["group", "dim"])
    left = stored(met.mapInPandas(_scan(k), "query_row long, row long, lower double, upper double"), "bounded")

    def best(found: DataFrame, *order: Column, most: int = k) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order))).filter(F.col("rank") <= most)

    def reaching(found: DataFrame, value: str) -> DataFrame:
        """Rows of ``left`` whose bound reaches the kth value found."""
        kth = found.filter(F.col("rank") == k).select("query_row", F.col(value).cast("double").alias("kth"))
        return left.join(kth, "query_row", "left").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).drop("kth")

    first = stored(best(left, F.desc("upper"), F.col("row"), most=2 * k).select("query_row", "row"), "first-pairs")
    scored = stored(_read(first, rows, "first"), "first-scores")
    rest = reaching(best(scored, F.desc("score"), F.col("vec_id")), "score").join(first, ["query_row", "row"], "left_anti")
    ranked = best(scored.unionByName(_read(rest, rows, "rest")), F.desc("score"), F.col("vec_id"))
    ids = rows.filter("asks").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return ranked.join(ids, "query_row").select("query_id", "rank", "vec_id", "score")
