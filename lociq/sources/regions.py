"""Reads kept in the order of their coordinates with an index of bins, and a reader that opens only what regions need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS, FINEST = 5, 14  # a bin has 8 bins of the next level; the finest hold 2 ** 14 bases, bin 0 of level 0 holds 2 ** 29


def _offset(level: int) -> int:
    """Number of the first bin of a level."""
    return (8**level - 1) // 7


def _shift(level: int) -> int:
    return FINEST + 3 * (LEVELS - level)


def bin_of(start: Column, end: Column) -> Column:
    """The smallest bin that holds the interval (start from 0, end exclusive); what no bin holds is in bin 0."""
    last = F.greatest(end - 1, start)
    out = F.lit(0)
    for level in range(1, LEVELS + 1):
        out = F.when(F.shiftright(start, _shift(level)) == F.shiftright(last, _shift(level)), F.shiftright(start, _shift(level)) + _offset(level)).otherwise(out)
    return F.when(last < 1 << _shift(0), out).otherwise(0).cast("int")


def bins_over(start: Column, end: Column) -> Column:
    """All bins, of every level, that may hold an interval that overlaps this one."""
    last = F.least(F.greatest(end - 1, start), F.lit((1 << _shift(0)) - 1))
    first = F.least(F.greatest(start, F.lit(0)), F.lit((1 << _shift(0)) - 1))
    return F.concat(*[F.sequence((F.shiftright(first, _shift(k)) + _offset(k)).cast("int"), (F.shiftright(last, _shift(k)) + _offset(k)).cast("int")) for k in range(LEVELS + 1)])


def _end(rows: DataFrame) -> Column:
    return F.greatest(F.coalesce("end0", F.col("start0") + 1), F.col("start0") + 1).cast("long")


def write_indexed(reads: DataFrame, path: str, files: int | None = None) -> None:
    """``reads`` (chrom, start0, end0 and others) in ranges of their coordinates, a file for each, and beside them the index: for each
    chromosome, bin and file the number of reads and the stretch that they cover. Reads without a place go last and are not indexed.

    The index has a row for each bin that a file has reads in, not for each read.
    """
    keyed = reads.withColumn("bin", bin_of(F.col("start0").cast("long"), _end(reads)))
    order = [F.col("chrom").asc_nulls_last(), F.col("start0").asc_nulls_last()]
    ranged = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/reads")
    written = reads.sparkSession.read.parquet(f"{path}/reads")
    indexed = written.filter("chrom IS NOT NULL AND start0 IS NOT NULL").withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    index = indexed.groupBy("chrom", "bin", "file").agg(F.count("*").alias("n"), F.min("start0").cast("long").alias("first"), F.max(_end(indexed)).alias("last"))
    index.repartitionByRange("chrom", "bin").sortWithinPartitions("chrom", "bin").write.mode("overwrite").parquet(f"{path}/index")


def files_for(spark: SparkSession, path: str, wanted: DataFrame) -> list[str]:
    """Names of the files that may hold reads over one of the regions ``wanted`` (chrom, start from 0, end exclusive)."""
    index = spark.read.parquet(f"{path}/index")
    spread = wanted.filter("end > start").select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).withColumn("bin", F.explode(bins_over(F.col("start"), F.col("end"))))
    met = index.join(spread, ["chrom", "bin"]).filter((F.col("first") < F.col("end")) & (F.col("last") > F.col("start")))
    return sorted(r["file"] for r in met.select("file").distinct().collect())  # names of files, which the driver lists to read them


def over(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The reads that overlap one of the regions, each once however many it overlaps, from no other files than :func:`files_for` names.

    Reads meet regions by (chrom, bin): a region is sent to the few bins of each level that it touches. A read without an end covers its start.
    """
    names = files_for(spark, path, wanted)
    every = spark.read.parquet(f"{path}/reads")
    rows = spark.read.schema(every.schema).parquet(*[f"{path}/reads/{n}" for n in names]) if names else every.limit(0)
    spread = wanted.filter("end > start").select(F.col("chrom").alias("__chrom"), F.col("start").cast("long").alias("__start"), F.col("end").cast("long").alias("__end")).withColumn("__bin", F.explode(bins_over(F.col("__start"), F.col("__end")))).distinct()
    meets = (F.col("chrom") == F.col("__chrom")) & (F.col("bin") == F.col("__bin")) & (F.col("start0") < F.col("__end")) & (_end(rows) > F.col("__start"))
    return rows.join(spread, meets, "left_semi").drop("bin")
