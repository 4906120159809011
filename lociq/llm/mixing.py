"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.common import WORD
from lociq.scratch import stored

WEIGHTS = (5, 2, 1)
RUN_ROWS = 10_000  # documents in a run of one source, about


def _key(source: Column) -> Column:
    """A text for each source; null has one of its own that sorts after all others."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source))


def _run_of(rows: DataFrame, runs: int) -> Column:
    """The run of a document, by a hash of its doc_id and, where there is one, its ``tie``: ids of any stride, repeated ones and null
    are spread."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.concat(key, F.lit(":"), F.coalesce("tie", F.lit(""))) if "tie" in rows.columns else key
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % runs


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """key, source_size, target from one row (key, source_size) for each source.

    Sources in code-point order (null last) take ``weights`` in turn and divide ``share`` of all sizes in
    proportion; a target stops at ``most`` times its source's size and the excess goes to the others, until
    none is above. That is the level at which sum(min(cap, weight * level)) is the whole share: sources
    are capped in the order of cap / weight, so the level follows from prefix sums over that order.
    The windows run over one row for each source, not over documents.
    """
    turn = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The first source that stays under its cap sets the level for itself and all later ones.
    rows = rows.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole))
    return rows.select("key", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mixed(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` (with doc_id, source and size in words) with columns source_size, target and copies (how often
    the mix takes the document).

    Each source's documents stand in runs of about RUN_ROWS (dealt by a hash, so that a source with a third of
    all rows is spread), each run in the order of size; the expected copies (target / source_size, the same for
    every document of a source) are prefix-summed through the runs, one offset drawn from the source's name
    is added, and a document is taken once for each integer that its interval crosses. As neighbours in a run
    have about the same size, the words taken come near the target. Reruns agree: nothing depends
    on partitions.

    Documents of size 0 are sampled like others; a source without words takes nothing. A null source is a
    source. Rows of equal doc_id stand by size and then by the text column ``tie``, if there is one. Other columns
    pass through; none may be called key, run, rank, first, offset or like a new column.
    """
    tie = [F.col("tie")] if "tie" in docs.columns else []
    runs = max(1, -(-docs.count() // RUN_ROWS))
    rows = docs.withColumn("key", _key(F.col("source"))).withColumn("run", _run_of(docs, runs))
    by_run = stored(rows.groupBy("key", "run").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-runs")
    goal = targets(by_run.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "key")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    places = by_run.select("key", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")).join(goal, "key").withColumn("offset", offset)
    rank = F.row_number().over(Window.partitionBy("key", "run").orderBy("size", "doc_id", *tie))
    placed = rows.withColumn("rank", rank).join(places, ["key", "run"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("first") + F.col("rank")
    copies = (F.floor(place * each + F.col("offset")) - F.floor((place - 1) * each + F.col("offset"))).cast("int")
    return placed.withColumn("copies", copies).drop("key", "run", "rank", "first", "offset")


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the columns of ``docs`` (doc_id, text, source and any others), each document as often
    as it is taken. Null or empty texts have size 0."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("tie"))
    taken = mixed(whole, seed, weights, share, most).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: The same mix in SQL (default parameters), over a view ``sized`` of doc_id, source, size and tie.
MIX_SQL = f"""
runs AS (SELECT greatest(1, cast(ceil(count(*) / {RUN_ROWS}.0) AS BIGINT)) AS n FROM sized),
keyed AS (SELECT doc_id, size, tie, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS key,
    cast('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(tie, '')), 1, 8) AS BIGINT) % runs.n AS run FROM sized, runs),
by_source AS (SELECT key, sum(size)::BIGINT AS source_size FROM keyed GROUP BY key),
weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM by_source),
levelled AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM weighted),
goal AS (SELECT key, source_size, least(cap, coalesce(max(CASE WHEN own * weight <= cap THEN own END) OVER () * weight, cap)) AS target FROM levelled),
placed AS (SELECT key, doc_id, size, row_number() OVER (PARTITION BY key ORDER BY run, size, doc_id NULLS FIRST, tie NULLS FIRST) AS place FROM keyed),
drawn AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS each,
    cast('0x' || substr(md5('mix:' || key), 1, 8) AS BIGINT)::DOUBLE / 4294967296 AS start FROM placed p JOIN goal USING (key)),
mixed AS (SELECT doc_id, size, source_size, target, cast(floor(place * each + start) - floor((place - 1) * each + start) AS BIGINT) AS copies, key FROM drawn)
"""
