"""Genotype changes between the original and the phased calls, and the error model learned from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators.panel import last_of_each

GENOTYPES = ("0/0", "0/1", "1/1")
SHIFTED = (("0/1", "0/0"), ("0/1", "1/1"), ("1/1", "0/0"), ("1/1", "0/1"), ("0/0", "0/1"))
HOM_BAF_THRESHOLD = 0.99


def transitions(original: DataFrame, phased: DataFrame) -> DataFrame:
    """Original calls beside the phased genotype of the same position.

    The phased side keeps the last row of a position (by ``ord``); a position then matches only if its
    alleles agree. Rows without genotype, allele share or depth take no part, on either side.
    """
    kept = last_of_each(phased.dropna(subset=["gt"]), ["chrom", "pos"], F.col("ord"))
    new = kept.select("chrom", "pos", F.col("ref").alias("new_ref"), F.col("alt").alias("new_alt"), F.col("gt").alias("new_gt"))
    rows = original.dropna(subset=["gt", "baf", "dp"]).join(new, ["chrom", "pos"]).filter("ref = new_ref AND alt = new_alt")
    return rows.select("chrom", "pos", "ref", "alt", F.col("gt").alias("orig_gt"), "new_gt", "baf", F.col("dp").alias("depth"))


def counts(rows: DataFrame) -> DataFrame:
    """Count and percentage of each pair of the three genotypes."""
    seen = rows.filter(F.col("orig_gt").isin(*GENOTYPES) & F.col("new_gt").isin(*GENOTYPES)).groupBy("orig_gt", "new_gt").agg(F.count("*").alias("n"))
    return seen.withColumn("percentage", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def detail(rows: DataFrame) -> DataFrame:
    return rows.groupBy("orig_gt", "new_gt", "ref", "alt").agg(F.count("*").alias("n"))


def shifted(rows: DataFrame) -> DataFrame:
    pair = F.struct(F.col("orig_gt").alias("a"), F.col("new_gt").alias("b"))
    return rows.filter(pair.isin(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SHIFTED]))


def stable(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("orig_gt") == F.col("new_gt")) & F.col("orig_gt").isin(*GENOTYPES))


def thresholds(rows: DataFrame, hom_baf: float = HOM_BAF_THRESHOLD) -> DataFrame:
    """For each pair of alleles and original genotype that phasing turned to 0/0: exact median depth, and exact median
    allele share (0/1) or a constant one (1/1)."""
    lost = rows.filter((F.col("new_gt") == "0/0") & F.col("orig_gt").isin("0/1", "1/1"))
    found = lost.groupBy("ref", "alt", "orig_gt").agg(F.median("baf").alias("baf_median"), F.median("depth").alias("depth_thr"), F.count("*").alias("n"))
    return found.withColumn("baf_thr", F.when(F.col("orig_gt") == "0/1", F.col("baf_median")).otherwise(F.lit(hom_baf))).drop("baf_median")


_VALUES = ("baf", "depth")


def value_counts(rows: DataFrame) -> DataFrame:
    """What :func:`thresholds` needs of these transitions, in a form that adds up: (ref, alt, orig_gt, what, value, n), how many of the
    lost variants of a key have each allele share and each depth. Its size follows the different values, not the variants."""
    lost = rows.filter((F.col("new_gt") == "0/0") & F.col("orig_gt").isin("0/1", "1/1"))
    both = F.explode(F.array(*[F.struct(F.lit(v).alias("what"), F.col(v).cast("double").alias("value")) for v in _VALUES]))
    return lost.select("ref", "alt", "orig_gt", both.alias("v")).groupBy("ref", "alt", "orig_gt", "v.what", "v.value").agg(F.count("*").alias("n"))


def added(*counts: DataFrame) -> DataFrame:
    """The value counts of all sections together; the order of the sections does not matter."""
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.groupBy("ref", "alt", "orig_gt", "what", "value").agg(F.sum("n").alias("n"))


def thresholds_of(counts: DataFrame, hom_baf: float = HOM_BAF_THRESHOLD) -> DataFrame:
    """The thresholds from added value counts, without the variants: a median is where the running sum of counts passes the half.
    Equal to :func:`thresholds` of all transitions. Missing values count for n only."""
    key = Window.partitionBy("ref", "alt", "orig_gt", "what")
    known = counts.filter("value IS NOT NULL").withColumns({"upto": F.sum("n").over(key.orderBy("value")), "total": F.sum("n").over(key)})
    # The two values in the middle, counted from 0; the same one if their number is odd.
    middle = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    half = lambda: (middle(F.floor((F.col("total") - 1) / 2)) + middle(F.floor(F.col("total") / 2))) / 2
    medians = known.groupBy("ref", "alt", "orig_gt", "what").agg(half().alias("median")).groupBy("ref", "alt", "orig_gt").pivot("what", list(_VALUES)).agg(F.first("median"))
    sizes = counts.filter(F.col("what") == _VALUES[0]).groupBy("ref", "alt", "orig_gt").agg(F.sum("n").alias("n"))
    rows = sizes.join(medians, ["ref", "alt", "orig_gt"], "left")
    return rows.select("ref", "alt", "orig_gt", F.col("depth").alias("depth_thr"), "n", F.when(F.col("orig_gt") == "0/1", F.col("baf")).otherwise(F.lit(hom_baf)).alias("baf_thr"))


def error_status(calls: DataFrame, learned: DataFrame) -> DataFrame:
    """status: ``hom_ref`` (dropped by both outputs), ``missing`` (kept as no error, counted apart), ``error`` (share and
    depth at or below both thresholds) or ``no_error``. The thresholds are a row for each of at most 24 keys."""
    keyed = learned.select("ref", "alt", F.col("orig_gt").alias("gt"), "baf_thr", "depth_thr")
    rows = calls.join(F.broadcast(keyed), ["ref", "alt", "gt"], "left")
    wrong = (F.col("baf") <= F.col("baf_thr")) & (F.col("dp") <= F.col("depth_thr"))
    status = F.when(F.col("gt") == "0/0", "hom_ref").when(F.col("gt").isNull() | F.col("baf").isNull() | F.col("dp").isNull(), "missing").when(F.coalesce(wrong, F.lit(False)), "error").otherwise("no_error")
    model = F.when(status == "error", F.when(F.col("gt") == "0/1", "HET").otherwise("HOM"))
    return rows.withColumns({"status": status, "seq_error_model": model}).drop("baf_thr", "depth_thr")


def error_summary(rows: DataFrame) -> DataFrame:
    """Counters over all rows, and the percentage of errors among rows that are not 0/0."""
    is_ = lambda s: F.col("status") == s
    gt = lambda g: F.col("gt") == g
    out = rows.agg(
        F.count("*").alias("total"), F.count_if(gt("0/1")).alias("het_total"), F.count_if(gt("1/1")).alias("hom_total"), F.count_if(is_("error") & gt("0/1")).alias("het_error"),
        F.count_if(is_("error") & gt("1/1")).alias("hom_error"), F.count_if(is_("no_error")).alias("no_error"), F.count_if(is_("hom_ref")).alias("hom_ref"), F.count_if(is_("missing")).alias("missing_info"),
    )
    errors = (F.col("het_error") + F.col("hom_error")).cast("double")
    return out.withColumn("error_pct", F.coalesce(100 * F.try_divide(errors, (F.col("total") - F.col("hom_ref")).cast("double")), F.lit(0.0)))
