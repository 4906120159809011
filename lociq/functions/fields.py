"""Column expressions over the text fields of variant records. All are safe on malformed text: they give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def info_value(info: Column, key: str) -> Column:
    """Text of the first ``key=`` item of an INFO field, up to a second ``=``; null if there is none."""
    return F.nullif(F.regexp_extract(F.concat(F.lit(";"), info), f";{key}=([^;=]*)", 1), F.lit(""))


def format_value(format_: Column, sample: Column, key: str) -> Column:
    """The sample's value under a FORMAT key; null if the key or the value is absent."""
    return F.get(F.split(sample, ":"), (F.array_position(F.split(format_, ":"), key) - 1).cast("int"))


def whole_numbers(text: Column) -> Column:
    """Comma-separated integers as array<bigint>; null if the text is null or one item is no integer."""
    parts = F.transform(F.split(text, ","), lambda x: x.try_cast("bigint"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def i16(info: Column) -> Column:
    """The I16 counts; sixteen zeros if absent or if one of them is no integer."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), 16)
    return F.coalesce(whole_numbers(info_value(info, "I16")), zeros)


def baf(counts: Column) -> Column:
    """Share of alternative reads among the first four I16 counts; 0.0 if there are none or the vector is short."""
    ref, alt = F.get(counts, 0) + F.get(counts, 1), F.get(counts, 2) + F.get(counts, 3)
    return F.coalesce(F.try_divide(alt.cast("double"), (ref + alt).cast("double")), F.lit(0.0))


def genotype_of(likelihoods: Column) -> Column:
    """Genotype of the least phred likelihood; the first wins ties."""
    least = F.array_min(likelihoods)
    return F.when(F.get(likelihoods, 0) == least, "0/0").when(F.get(likelihoods, 1) == least, "0/1").when(F.get(likelihoods, 2) == least, "1/1")


def genotype_quality(likelihoods: Column) -> Column:
    ordered = F.array_sort(likelihoods)
    return F.get(ordered, 1) - F.get(ordered, 0)


def bare_chrom(chrom: Column) -> Column:
    return F.replace(chrom, F.lit("chr"), F.lit(""))


def prefixed_chrom(chrom: Column) -> Column:
    """``chr`` before names that are digits, X or Y; others stay."""
    return F.when(chrom.rlike("^([0-9]+|X|Y)$"), F.concat(F.lit("chr"), chrom)).otherwise(chrom)


def chrom_rank(chrom: Column) -> Column:
    """Genomic order: autosomes by number, then X, Y, and others last."""
    bare = bare_chrom(chrom)
    return F.when(bare == "X", 23).when(bare == "Y", 24).otherwise(F.coalesce(bare.try_cast("int"), F.lit(99)))


def with_tag(info: Column, key: str, value: Column) -> Column:
    """``info`` with ``;key=value`` appended."""
    return F.concat_ws(";", info, F.concat(F.lit(f"{key}="), value))


def three_decimals(value: Column) -> Column:
    """Text with three decimals, halves to even."""
    return F.bround(value.cast("decimal(20,10)"), 3).cast("decimal(20,3)").cast("string")
