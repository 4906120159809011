"""Writers. Partitioned Parquet is the engine's own form; text forms are for other tools."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions import fields
from lociq.operators import learning
from lociq.operators.ordering import numbered
from lociq.sources.readers import VCF_COLUMNS

HEADER = "##fileformat=VCFv4.2"


def vcf_lines(variants: DataFrame) -> DataFrame:
    """One tab-separated line for each record, nulls as dots; ``chrom`` and ``pos`` stay for ordering."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in VCF_COLUMNS]
    return variants.select("chrom", "pos", F.concat_ws("\t", *text).alias("line"))


def header_lines(chroms: list[str], build: str | None = None, kept: list[str] | None = None) -> list[str]:
    """Lines of a header: ``kept`` ones of the source without its first and its column line, else the contigs by name."""
    own = [x for x in kept or [] if x.startswith("##") and not x.startswith("##fileformat")]
    if build and not any(x.startswith("##reference") for x in own):
        own.insert(0, f"##reference={build}")
    listed = {m.group(1) for x in own if (m := re.match(r"##contig=<ID=([^,>]+)", x))}
    return [HEADER, *own, *[f"##contig=<ID={c}>" for c in chroms if c not in listed]]


def write_vcf(variants: DataFrame, path: str, header: list[str] | None = None) -> None:
    """Lines in genomic order over as many files as there are ranges, each file sorted; the header (``header``, else the format alone, and the
    column line) is its own first file."""
    lines = vcf_lines(variants).withColumn("rank", fields.chrom_rank(F.col("chrom")))
    ordered = lines.repartitionByRange("rank", "chrom", "pos").sortWithinPartitions("rank", "chrom", "pos", "line")
    ordered.select("line").write.mode("overwrite").option("compression", "gzip").text(path)
    columns = "#" + "\t".join(c.upper() for c in VCF_COLUMNS)
    variants.sparkSession.createDataFrame([(x,) for x in (*(header or [HEADER]), columns)], "line string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}_header")


def write_ordered(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Rows in one total order, by ``keys`` as they compare (text as text), over many files: a folder for each range of the order, and beside
    it an index of the ranges with their first place and number of rows. No task holds more than a range; rows of equal keys keep an order
    of their own. :func:`readers.ordered` reads it back."""
    ranged = numbered(rows, keys).drop("among")
    ranged = ranged.repartitionByRange("place").withColumn("range", F.spark_partition_id()).sortWithinPartitions("place")
    ranged.write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    written.groupBy("range").agg(F.min("place").alias("first"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def write_split(rows: DataFrame, path: str, by: str) -> None:
    """One folder for each value of ``by``: origin (panel or not), status (error or not), class, or barcode."""
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def write_classes(classified: DataFrame, folder: str, model: str, threshold: float = 0.5) -> None:
    """One VCF for each class, of the variants that the model puts there with at least ``threshold``, their INFO tagged with the class and its
    probabilities."""
    sure = learning.tagged(learning.confident(classified, threshold), model)
    for name in learning.CLASSES:
        write_vcf(sure.filter(F.col("predicted") == name), f"{folder.rstrip('/')}/{model.lower()}_{name}")


def with_race(found: DataFrame) -> DataFrame:
    """Detected variants as records: the pool's info with its race, an unknown genotype, a prefixed chromosome."""
    info = fields.with_tag(F.col("info"), "RACE", F.col("race"))
    return found.select("barcode", fields.prefixed_chrom(F.col("chrom")).alias("chrom"), "pos", F.lit(".").alias("id"), "ref", "alt", F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"), F.lit("GT").alias("format"), F.lit("./.").alias("sample"))


def with_frequency(summary: DataFrame) -> DataFrame:
    """Summary records: COUNT and FREQ (four decimals) appended to the info of the first barcode, or in place of a dot."""
    info = fields.with_tag(F.nullif(F.col("info"), F.lit(".")), "COUNT", F.col("n_barcodes").cast("string"))
    return summary.withColumn("info", fields.with_tag(info, "FREQ", F.format_string("%.4f", "freq")))


def write_spot_snvs(spot_snvs: DataFrame, path: str) -> None:
    """A folder for each barcode with its "chrom pos" lines, in text order."""
    lines = spot_snvs.select("barcode", F.concat_ws(" ", "chrom", F.col("pos").cast("string")).alias("line"), F.concat_ws("_", "chrom", F.col("pos").cast("string")).alias("key"))
    lines.repartition("barcode").sortWithinPartitions("barcode", "key").select("barcode", "line").write.mode("overwrite").partitionBy("barcode").text(path)


def union_of_spots(spot_snvs: DataFrame) -> DataFrame:
    return spot_snvs.select("chrom", "pos", "ref", "alt").distinct()


def write_reads(reads: DataFrame, path: str) -> None:
    """Reads in the order of their coordinates within files, a folder for each barcode."""
    reads.repartition("barcode").sortWithinPartitions("barcode", "chrom", "start0").write.mode("overwrite").partitionBy("barcode").parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def matrix_name(dataset: str, section: str, caller: str, name: str, grouping: str) -> str:
    return f"{dataset}_{section}_{caller}_{name}_{grouping}_matrix"


def write_matrix(long: DataFrame, folder: str, name: str) -> str:
    """The long matrix, under its composed name."""
    path = f"{folder.rstrip('/')}/{name}"
    long.write.mode("overwrite").parquet(path)
    return path
