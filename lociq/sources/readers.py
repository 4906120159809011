"""Readers of the text formats; every one gives a DataFrame with fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.functions import fields

VCF_COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample")
POSITION_SCHEMA = "barcode STRING, in_tissue INT, array_row INT, array_col INT, x DOUBLE, y DOUBLE"
SCALE_SCHEMA = "spot_diameter_fullres DOUBLE, tissue_hires_scalef DOUBLE"
READ_SCHEMA = "read_id LONG, barcode STRING, chrom STRING, start0 INT, end0 INT, unmapped BOOLEAN, mapq INT, baseq INT"


def _barcode(suffixes: str) -> Column:
    """The file's base name without its suffix."""
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return F.regexp_replace(name, f"({suffixes})$", "")


#: Fields that a line needs at least, by what it is read for: its key alone, its record, or its genotype and sample.
LEAST_FIELDS = {"key": 5, "record": 8, "sample": 10}


def vcf_header(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The header lines (``##``) of the files, each once, in the order of their first file. A header's size doesn't grow with the variants."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).filter(F.col("value").startswith("##"))
    return [r["value"] for r in lines.groupBy("value").agg(F.min("ord").alias("ord")).orderBy("ord").collect()]


def vcf(spark: SparkSession, path: str | list[str], barcode_from_name: bool = False, purpose: str = "record") -> DataFrame:
    """Variant records of plain or gzipped VCF files (several: all rows). Header lines and lines with fewer fields than their
    ``purpose`` needs (LEAST_FIELDS) are skipped; absent fields are null. ``ord`` keeps the order of the lines in their file."""
    lines = spark.read.text(path)
    lines = lines.select("value", _barcode(r"\.vcf\.gz|\.vcf").alias("barcode"), F.monotonically_increasing_id().alias("ord"))
    parts = lines.filter(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).filter(F.size("f") >= LEAST_FIELDS[purpose])
    rows = parts.select(*[F.get("f", i).alias(c) for i, c in enumerate(VCF_COLUMNS)], "ord", *["barcode"] * barcode_from_name)
    return rows.withColumn("pos", F.col("pos").try_cast("int"))


def chromosome(variants: DataFrame, chrom: str) -> DataFrame:
    return variants.filter(F.regexp_replace("chrom", "chr", "") == chrom.replace("chr", ""))


def ordered(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows that sinks.write_ordered wrote, with their ``place`` (from 0) in the order: those at places first to last. Only the ranges
    that hold such places are opened; the index has a row for each range."""
    index = spark.read.parquet(f"{path}/index").filter(F.col("first") + F.col("n") > first)
    index = index if last is None else index.filter(F.col("first") <= last)
    wanted = [r["range"] for r in index.collect()]
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("range").isin(wanted) & (F.col("place") >= first))
    return (rows if last is None else rows.filter(F.col("place") <= last)).drop("range")


def positions(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Spot positions. Files differ in having a header; the columns' places are the same."""
    return spark.read.csv(path, schema=POSITION_SCHEMA, header=header)


def barcode_list(spark: SparkSession, path: str) -> DataFrame:
    """First column of a tab-separated list (gzipped or not), without blank lines."""
    return spark.read.text(path).select(F.trim(F.split("value", "\t")[0]).alias("barcode")).filter("barcode <> ''")


def missing_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """First word of each line."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("barcode")).filter("barcode <> ''")


def scale_factors(spark: SparkSession, path: str) -> dict[str, float]:
    """Diameter of a spot (100.0 if absent) and the image's scale (1.0 if absent); one small JSON object."""
    row = spark.read.schema(SCALE_SCHEMA).json(path, multiLine=True).first()
    diameter, scale = (row[0], row[1]) if row else (None, None)
    return {"spot_diameter_fullres": 100.0 if diameter is None else diameter, "tissue_hires_scalef": 1.0 if scale is None else scale}


def spot_snvs(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, chrom, pos, ref, alt) of one text file for each barcode: at least two words a line, alleles if there are
    four, else N. The union file of all barcodes and header lines are left out. Bare chromosomes."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path, pathGlobFilter="*.txt").select(_barcode(r"\.txt").alias("barcode"), words.alias("w"))
    rows = rows.filter((F.size("w") >= 2) & ~F.col("barcode").startswith("all_filtered_variants"))
    allele = lambda i: F.when(F.size("w") >= 4, F.get("w", i)).otherwise("N")
    out = rows.select("barcode", F.regexp_replace(F.get("w", F.lit(0)), "chr", "").alias("chrom"), F.get("w", F.lit(1)).try_cast("int").alias("pos"), allele(2).alias("ref"), allele(3).alias("alt"))
    return out.filter("pos IS NOT NULL")


def spot_folders(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, chrom, pos) of folders barcode=NAME with "chrom pos" lines, as sinks.write_spot_snvs writes them."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.schema("value STRING, barcode STRING").text(path).select("barcode", words.alias("w")).filter(F.size("w") >= 2)
    return rows.select("barcode", fields.bare_chrom(F.get("w", F.lit(0))).alias("chrom"), F.get("w", F.lit(1)).try_cast("int").alias("pos")).filter("pos IS NOT NULL")


def reads(spark: SparkSession, path: str, min_mapq: int = 0, min_baseq: int = 0, chrom: str | None = None) -> DataFrame:
    """Aligned reads stored as Parquet, quality limits and chromosome pushed into the scan."""
    rows = spark.read.schema(READ_SCHEMA).parquet(path).filter((F.col("mapq") >= min_mapq) & (F.col("baseq") >= min_baseq))
    return rows if chrom is None else rows.filter(F.col("chrom") == chrom)


def files_of(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(barcode, path) of the alignment files that a glob names, in the order of their names."""
    found = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^/.]+)?$", 1).alias("barcode"), "path")
    return found.orderBy("path").limit(most) if most is not None else found


def existing(barcodes: DataFrame, files: DataFrame) -> DataFrame:
    return files.join(barcodes.select("barcode"), "barcode", "left_semi")


def sections(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several sections as one, with the section's name."""
    out = None
    for name, table in tables.items():
        own = table.withColumn("section", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def variant_schema() -> T.StructType:
    kinds = {"pos": T.IntegerType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in VCF_COLUMNS])
