"""Presence of variants in spots, as a long table or a pivoted one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.operators.ordering import numbered
from lociq.scratch import stored

BLOCK = 32  # columns in a block of the matrix


def snv_name() -> Column:
    return F.concat_ws("_", "chrom", F.col("pos").cast("string"))


def long(spot_snvs: DataFrame) -> DataFrame:
    """(barcode, snv): the canonical, sparse form; any number of variants."""
    return spot_snvs.select("barcode", snv_name().alias("snv")).distinct()


def _numbered(pairs: DataFrame) -> DataFrame:
    return numbered(pairs.select("snv").distinct(), ["snv"]).select("snv", "place")


def columns(spot_snvs: DataFrame) -> DataFrame:
    """Matrix columns in text order, numbered from 0."""
    return _numbered(long(spot_snvs))


def blocks(spot_snvs: DataFrame) -> DataFrame:
    """The whole matrix, (barcode, block, present): bit i of ``present`` says whether the spot has the variant of column
    BLOCK * block + i (see :func:`columns`). Blocks without a variant are left out."""
    pairs = stored(long(spot_snvs), "pairs")
    placed = pairs.join(_numbered(pairs), "snv")
    bit = F.expr(f"shiftleft(1L, cast(place % {BLOCK} as int))")
    return placed.groupBy("barcode", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.sum(bit).alias("present"))


def pivoted(spot_snvs: DataFrame, snvs: list[str]) -> DataFrame:
    """A row for each barcode, a 0/1 column for each of the given variants. For a known, moderate list: a column each."""
    return long(spot_snvs).groupBy("barcode").pivot("snv", sorted(snvs)).agg(F.lit(1)).na.fill(0)


def per_spot(spot_snvs: DataFrame) -> DataFrame:
    return long(spot_snvs).groupBy("barcode").agg(F.count("*").alias("n_snvs"))
