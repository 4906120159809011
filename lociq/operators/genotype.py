"""Genotype calling from phred likelihoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.functions import fields

HET_BAF = (0.35, 0.65)
HOM_BAF = 0.85


def snv_sites(variants: DataFrame) -> DataFrame:
    """Rows with a single-base reference and neither a symbolic ``<X>`` allele nor an INDEL flag."""
    indel = F.array_contains(F.split(F.coalesce("info", F.lit("")), ";"), "INDEL")
    return variants.filter(F.col("ref").rlike("^[ATGC]$") & ~F.col("alt").contains("<X>") & ~indel)


def split_multiallelic(variants: DataFrame) -> DataFrame:
    """One row for each alternative allele, with the three likelihoods of that allele (from the triangular list).

    Likelihoods of genotype (j, k), j <= k, stand at k (k + 1) / 2 + j. Rows whose list is too short keep null ones.
    """
    rows = variants.select("*", F.posexplode(F.split("alt", ",")).alias("allele", "one"))
    k = F.col("allele") + 1
    at = lambda i: F.get("pl", i.cast("int"))
    own = F.array(F.get("pl", F.lit(0)), at((k * (k + 1) / 2)), at(k * (k + 1) / 2 + k))
    return rows.withColumns({"pl": F.when(~F.exists(own, lambda x: x.isNull()), own), "alt": F.col("one")}).drop("allele", "one")


def flags(gt: Column, dp: Column, gq: Column, qual: Column, baf: Column, min_depth: int, min_gq: int, min_qual: float) -> Column:
    """PASS, or the failed checks joined by semicolons in a fixed order. Depth, quality and score fail strictly below
    their minimum; the allele share must lie within its genotype's bounds, bounds included."""
    concordant = F.when(gt == "0/1", baf.between(*HET_BAF)).otherwise(baf >= HOM_BAF)
    failed = F.concat_ws(";", F.when(dp < min_depth, "LowDP"), F.when(gq < min_gq, "LowGQ"), F.when(qual < min_qual, "LowQual"), F.when(~concordant, "DiscordantBAF"))
    return F.when(failed == "", "PASS").otherwise(failed)


def parsed(variants: DataFrame) -> DataFrame:
    """Adds dp, i16, pl (null unless three integers), gt, gq and baf to variants (info, format, sample as text)."""
    listed = fields.whole_numbers(fields.format_value(F.col("format"), F.col("sample"), "PL"))
    dp = F.when(fields.info_value(F.col("info"), "DP").isNull(), F.lit(0)).otherwise(fields.info_value(F.col("info"), "DP").try_cast("int"))
    rows = variants.withColumns({"dp": dp, "i16": fields.i16(F.col("info")), "pl": F.when(F.size(listed) == 3, listed)})
    return rows.withColumns({"gt": fields.genotype_of(F.col("pl")), "gq": fields.genotype_quality(F.col("pl")).cast("int"), "baf": fields.baf(F.col("i16"))})


def called(variants: DataFrame, min_depth: int = 5, min_gq: int = 7, min_qual: float = 0.0) -> DataFrame:
    """Heterozygous and homozygous calls with FILTER set. Rows without three likelihoods, with an unreadable QUAL or
    depth, or called ``0/0`` are dropped (see :func:`rejected`). A missing QUAL counts as 0."""
    rows = parsed(variants).withColumn("qual", F.when(F.col("qual").isNull() | (F.col("qual") == "."), 0.0).otherwise(F.col("qual").try_cast("double")))
    rows = rows.filter((F.col("gt") != "0/0") & F.col("qual").isNotNull() & F.col("dp").isNotNull())
    return rows.withColumn("filter", flags(*map(F.col, ("gt", "dp", "gq", "qual", "baf")), min_depth, min_gq, min_qual))


def rejected(variants: DataFrame) -> DataFrame:
    """Rows that calling drops as malformed, with the reason."""
    qual = F.col("qual").isNull() | (F.col("qual") == ".") | F.col("qual").try_cast("double").isNotNull()
    reason = F.when(F.col("pl").isNull(), "likelihoods").when(~qual, "quality").when(F.col("dp").isNull(), "depth")
    return parsed(variants).withColumn("reason", reason).filter(F.col("reason").isNotNull())


def annotated_sample(calls: DataFrame) -> DataFrame:
    """FORMAT and sample with GT, GQ and BAF (three decimals) put in front."""
    values = F.concat_ws(":", "gt", F.col("gq").cast("string"), fields.three_decimals(F.col("baf")), "sample")
    return calls.withColumns({"format": F.concat_ws(":", F.lit("GT:GQ:BAF"), "format"), "sample": values})
