"""Reads against variant positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions import fields
from lociq.operators.panel import KEY

BIN = 128  # positions in a bin; about the length of a read


def first_overlaps(reads: DataFrame, positions: DataFrame, bin_size: int = BIN, exact_end: bool = False) -> DataFrame:
    """Each mapped read with the lowest position in its interval, if there is one: the read's columns and ``pos``.

    ``reads`` (read_id, chrom, start0, end0, unmapped and others): 0-based, end exclusive. The interval runs from
    start0 + 1 to end0 + 1 (to end0 with ``exact_end``), a read without end to start0 + 1 alone. Every read meets a few bins,
    every position one, so the range join is an equi-join on (chrom, bin), after which the least position of a read is
    taken while partial results combine. Chromosomes match with or without ``chr``.
    """
    end = F.coalesce(F.col("end0") + (0 if exact_end else 1), F.col("start0") + 1)
    spans = reads.filter(~F.coalesce("unmapped", F.lit(False)) & F.col("start0").isNotNull()).withColumns({"chrom": fields.bare_chrom(F.col("chrom")), "first": F.col("start0") + 1, "last": end})
    slot = lambda c: F.floor(F.col(c) / bin_size)
    binned = spans.filter("first <= last").withColumn("bin", F.explode(F.sequence(slot("first"), slot("last"))))
    targets = positions.select(fields.bare_chrom(F.col("chrom")).alias("chrom"), "pos").distinct().withColumn("bin", slot("pos"))
    met = binned.join(targets, ["chrom", "bin"]).filter("pos BETWEEN first AND last")
    own = [c for c in reads.columns if c != "read_id"]
    return met.groupBy("read_id").agg(*[F.first(c).alias(c) for c in own], F.min("pos").alias("pos"))


def detected(overlaps: DataFrame, variants: DataFrame) -> DataFrame:
    """Distinct (barcode, chrom, pos, ref, alt) that reads were credited with; of several variants at a position the
    last one (by ``ord``) counts. Chromosomes are bare."""
    alleles = variants.groupBy(fields.bare_chrom(F.col("chrom")).alias("chrom"), "pos").agg(F.max_by(F.struct("ref", "alt"), "ord").alias("a"))
    found = overlaps.select("barcode", "chrom", "pos").distinct().join(alleles, ["chrom", "pos"])
    return found.select("barcode", "chrom", "pos", "a.ref", "a.alt")


def kept_reads(reads: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Reads with a position in their interval."""
    return reads.join(overlaps.select("read_id"), "read_id", "left_semi")


def with_annotation(found: DataFrame, pool: DataFrame) -> DataFrame:
    """Detected variants with info (``.`` if unknown) and race (``unknown``) of the pool."""
    rows = found.join(pool.select(*KEY, "info", "race"), list(KEY), "left")
    return rows.withColumns({"info": F.coalesce("info", F.lit(".")), "race": F.coalesce("race", F.lit("unknown"))})


def barcode_frequency(found: DataFrame) -> DataFrame:
    """For each variant: barcodes that have it, and their share of all barcodes with any variant; if ``found`` has a
    column info, also that of the variant's least barcode (of repeated rows the least info)."""
    # One row: the number of barcodes.
    total = found.agg(F.count_distinct("barcode").alias("total"))
    first = [F.min(F.struct("barcode", "info"))["info"].alias("info")] if "info" in found.columns else []
    seen = found.groupBy(*KEY).agg(F.count_distinct("barcode").alias("n_barcodes"), *first)
    return seen.join(F.broadcast(total)).withColumn("freq", F.col("n_barcodes").cast("double") / F.col("total")).drop("total")
