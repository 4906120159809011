"""First-wins and last-wins rules on streams: one row for each key, decided as rows come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def winners(rows: DataFrame, keys: list[str], order: str, time: str, late: str, last: bool = False) -> DataFrame:
    """A stream of the rows that win their key: each time a row comes whose ``order`` is lower (``last``: higher) than all before.

    State is one order for each key. A key whose rows are older than the watermark of column ``time`` (``late`` behind the newest)
    is forgotten; rows that come later than that are left out, as the watermark says. Rows of equal order: the least by the text of
    all its columns. A null order never wins over another. Columns are those of ``rows``.
    """
    schema = rows.schema
    names = [f.name for f in schema]
    kind = schema[order].dataType

    whole = isinstance(kind, T.IntegralType)

    def plain(value) -> object:
        """The value as the state keeps it; None if there is none."""
        if pd.isna(value):
            return None
        return int(value) if whole else value.to_pydatetime() if hasattr(value, "to_pydatetime") else value.item() if hasattr(value, "item") else value

    def before(a: tuple, b: tuple) -> bool:
        """Whether (order, text) a wins over b."""
        if a[0] is None or b[0] is None or a[0] == b[0]:
            return (a[0] is None, a[1]) < (b[0] is None, b[1])
        return a[0] > b[0] if last else a[0] < b[0]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, best_row, newest = None, None, None
        for pdf in parts:
            texts = pdf[names].astype(str).agg("\x1f".join, axis=1)
            for i in range(len(pdf)):
                own = (plain(pdf[order].iloc[i]), texts.iloc[i])
                if best is None or before(own, best):
                    best, best_row = own, pdf[names].iloc[[i]]
            at = pd.to_datetime(pdf[time]).max()
            newest = at if newest is None or at > newest else newest
        held = state.getOption
        wins = best is not None and (held is None or before(best, tuple(held)))
        if wins:
            state.update(best)
        if state.exists and newest is not None and not pd.isna(newest):
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if wins:
            yield best_row

    held = T.StructType([T.StructField("order", kind), T.StructField("text", T.StringType())])
    return rows.withWatermark(time, late).groupBy(*keys).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def write(winning: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing what :func:`winners` gives, a folder for each batch. A batch that is run again after a failure replaces its own folder, so each
    winner is there once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return winning.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").start()


def current(spark: SparkSession, path: str, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The winner of each key so far: of the rows written for it, the one of lowest (``last``: highest) order, of equal ones that of the
    latest batch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    own = [c for c in rows.columns if c != "batch"]
    by = F.when(F.col(order).isNotNull(), F.struct(F.col(order).alias("o"), (F.col("batch") if last else -F.col("batch")).alias("b")))
    pick = F.max_by if last else F.min_by
    row = F.struct(*own)
    return rows.groupBy(*keys).agg(F.coalesce(pick(row, by), F.max_by(row, "batch")).alias("row")).select("row.*")
