"""Tables behind the reports and plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts and densities of equal bins on [low, high]; the last bin is closed on the right. Values outside are left out."""
    by = by or []
    width = (high - low) / bins
    placed = rows.withColumn("value", value.cast("double")).filter(F.col("value").between(low, high))
    counted = placed.withColumn("bin", F.least(F.floor((F.col("value") - low) / width), F.lit(bins - 1)).cast("int")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    if by:
        total = counted.groupBy(*by).agg(F.sum("n").alias("total"))
        joined = counted.join(total, by)
    else:
        joined = counted.join(F.broadcast(counted.agg(F.sum("n").alias("total"))))  # one row
    return joined.withColumn("density", F.col("n") / (F.col("total") * F.lit(width))).drop("total")


def baf_histogram(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return histogram(rows, F.col("baf"), 0.0, 1.0, 20, by)


def depth_histogram(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Depths above 200 count as 200."""
    return histogram(rows, F.least("depth", F.lit(200)), 0.0, 200.0, 20, by)


def per_region(variants: DataFrame) -> DataFrame:
    return variants.groupBy("chrom").agg(F.count("*").alias("snp_count"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Of rows (duration, snp_count, status): mean duration, variants, and how many completed or failed."""
    return runs.agg(F.avg("duration").alias("mean_duration"), F.sum("snp_count").alias("total_snps"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def class_report(table: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class of a confusion table."""
    named = table.select(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("guessed"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("right"))
    named = named.unionByName(table.select(F.col("predicted").alias("class"), F.lit(0).alias("support"), F.col("n").alias("guessed"), F.lit(0).alias("right")))
    sums = named.groupBy("class").agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "guessed", "right")])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = sums.withColumns({"precision": share("right", "guessed"), "recall": share("right", "support")})
    f1 = F.coalesce(F.try_divide(2 * F.col("right"), F.col("guessed") + F.col("support")), F.lit(0.0))
    return out.select("class", "precision", "recall", f1.alias("f1"), F.col("support").cast("long").alias("support"))


def variant_f1(rows: DataFrame) -> DataFrame:
    """Mean F1 of the two variant classes over rows that are truly of one of them."""
    table = confusion(rows.filter(F.col("label").isin("heterozygous", "homozygous")))
    return class_report(table).filter(F.col("class").isin("heterozygous", "homozygous")).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("variant_f1"))


def accuracy(table: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    return table.agg(F.coalesce(F.try_divide(right.cast("double"), F.sum("n").cast("double")), F.lit(0.0)).alias("accuracy"))
