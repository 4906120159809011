"""Membership in a reference panel, pools of variants and their set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions import fields

KEY = ("chrom", "pos", "ref", "alt")


def keys(*tables: DataFrame) -> DataFrame:
    """Distinct variants of all tables."""
    found = tables[0].select(*KEY)
    for t in tables[1:]:
        found = found.unionByName(t.select(*KEY))
    return found.distinct()


def defined(calls: DataFrame, panel: DataFrame) -> DataFrame:
    """Calls that the panel has, on all four key columns. The panel is as large as a genome's known variants, so
    both sides are dealt by key; Spark broadcasts it only if it is small."""
    return calls.join(panel.select(*KEY), list(KEY), "left_semi")


def denovo(calls: DataFrame, panel: DataFrame) -> DataFrame:
    return calls.join(panel.select(*KEY), list(KEY), "left_anti")


def with_origin(calls: DataFrame, panel: DataFrame) -> DataFrame:
    """Both halves in one pass: origin is ``defined`` or ``denovo``."""
    known = panel.select(*KEY).distinct().withColumn("known", F.lit(True))
    rows = calls.join(known, list(KEY), "left")
    return rows.withColumn("origin", F.when(F.col("known"), "defined").otherwise("denovo")).drop("known")


def back_annotated(phased: DataFrame, original: DataFrame, columns: list[str]) -> DataFrame:
    """Phased rows with ``columns`` of the original row of the same variant; null where there is none."""
    return phased.drop(*columns).join(original.select(*KEY, *columns), list(KEY), "left")


def valid_genotypes(rows: DataFrame, phased_too: bool = False) -> DataFrame:
    """Rows whose genotype is 0/1 or 1/1. ``0|1`` and the like are refused unless ``phased_too``."""
    gt = F.replace("gt", F.lit("|"), F.lit("/")) if phased_too else F.col("gt")
    one_way = F.when(gt == "1/0", "0/1").otherwise(gt) if phased_too else gt
    return rows.filter(one_way.isin("0/1", "1/1"))


def pool(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Variants of all sources (named, in order of precedence) with the first source's name as ``race``; the key has
    the bare chromosome."""
    rows = None
    for rank, (race, table) in enumerate(sources):
        own = table.select(fields.bare_chrom(F.col("chrom")).alias("chrom"), "pos", "ref", "alt", F.lit(race).alias("race"), F.lit(rank).alias("rank"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*KEY).agg(F.min_by("race", "rank").alias("race"))


def genotype_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("gt") == "0/1").alias("n_het"), F.count_if(F.col("gt") == "1/1").alias("n_hom"))


def overlap(a: DataFrame, b: DataFrame, on: tuple[str, ...] = KEY) -> DataFrame:
    """One row: sizes of both sets, of what they share and of their union, and the Jaccard index."""
    sides = a.select(*on).distinct().withColumn("side", F.lit(1)).unionByName(b.select(*on).distinct().withColumn("side", F.lit(2)))
    both = sides.groupBy(*on).agg(F.sum("side").alias("sides"))
    count = lambda c: F.count_if(c)
    out = both.agg(count(F.col("sides") != 2).alias("n_a"), count(F.col("sides") != 1).alias("n_b"), count(F.col("sides") == 3).alias("n_both"), F.count("*").alias("n_union"))
    return out.withColumn("jaccard", F.coalesce(F.try_divide(F.col("n_both").cast("double"), F.col("n_union").cast("double")), F.lit(0.0)))


def last_of_each(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The row of highest ``order`` for each key."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order.desc()))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")
