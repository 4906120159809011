"""Columns of a pileup from aligned reads: which bases stand over each position, by strand, within quality limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.scratch import stored

BIN = 128  # positions in a bin, where deep positions meet their reads
TAIL = 25  # distances from a read's end above this count as this
BLOCKS = "array<struct<ref:int,read:int,len:int>>"
_SUMS = ("q", "mapq", "tail")


def blocks(cigar: Column) -> Column:
    """The stretches of a read that stand over the reference, as (ref, read, len): offsets from the read's start on the reference and from
    its first base. M, = and X align; insertions and soft clips pass bases of the read only; deletions and spliced gaps (N) pass the
    reference only, and nothing of the read stands over those. Null if the text is no CIGAR."""
    steps = F.zip_with(F.regexp_extract_all(cigar, F.lit(r"([0-9]+)[MIDNSHP=X]"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"[0-9]+([MIDNSHP=X])"), F.lit(1)), lambda n, op: F.struct(n.try_cast("int").alias("n"), op.alias("op")))

    def walk(at: Column, step: Column) -> Column:
        aligned = step["op"].isin("M", "=", "X")
        here = F.array(F.struct(at["ref"].alias("ref"), at["read"].alias("read"), step["n"].alias("len")))
        ref, read = at["ref"] + F.when(aligned | step["op"].isin("D", "N"), step["n"]).otherwise(0), at["read"] + F.when(aligned | step["op"].isin("I", "S"), step["n"]).otherwise(0)
        return F.struct(ref.alias("ref"), read.alias("read"), F.when(aligned & (step["n"] > 0), F.concat(at["out"], here)).otherwise(at["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("read"), F.array().cast(BLOCKS).alias("out"))
    return F.when(cigar.rlike("^([0-9]{1,9}[MIDNSHP=X])+$"), F.aggregate(steps, start, walk)["out"].cast(BLOCKS))


def _usable(alignments: DataFrame, min_mapq: int) -> DataFrame:
    rows = alignments.filter(~F.coalesce("unmapped", F.lit(False)) & (F.col("mapq") >= min_mapq) & F.col("start0").isNotNull())
    rows = rows.select("read_id", "chrom", F.col("start0").cast("int").alias("start0"), "reverse", F.col("mapq").cast("int").alias("mapq"), F.upper("bases").cast("binary").alias("bases"), F.col("quals").cast("binary").alias("quals"), F.explode(blocks(F.col("cigar"))).alias("b"))
    return rows.select("*", (F.col("start0") + 1 + F.col("b.ref")).alias("first"), (F.col("start0") + F.col("b.ref") + F.col("b.len")).alias("last"))


def _at(rows: DataFrame, pos: Column, min_baseq: int) -> DataFrame:
    """Of blocks with a position inside: the base there, its quality and its distance from the nearer end of the read."""
    offset = pos - F.col("first") + F.col("b.read")
    letter = lambda c: F.substring(c, (offset + 1).cast("int"), F.lit(1)).cast("string")
    quality = F.when(F.length(letter("quals")) > 0, F.ascii(letter("quals")) - 33)
    rows = rows.withColumns({"pos": pos.cast("int"), "base": letter("bases"), "q": quality, "tail": F.least(offset, F.length("bases") - 1 - offset, F.lit(TAIL))})
    return rows.filter(F.col("base").isin("A", "C", "G", "T") & (F.col("q") >= min_baseq))


def _counted(rows: DataFrame) -> DataFrame:
    sums = [F.sum(x).cast("long").alias(f"{name}_{c}") for c in _SUMS for name, x in (("sum", F.col(c)), ("sum2", F.col(c) * F.col(c)))]
    return rows.groupBy("chrom", "pos", "base", "reverse").agg(F.count("*").alias("n"), *sums)


def columns(alignments: DataFrame, min_mapq: int = 0, min_baseq: int = 13, max_depth: int | None = None) -> DataFrame:
    """(chrom, pos, base, reverse, n, and sums and sums of squares of base quality, mapping quality and distance from the read's
    end) for each base that stands over a position.

    ``alignments``: read_id, chrom, start0 (from 0), cigar, bases, quals (as text, from ``!`` = 0), mapq, reverse, unmapped. Reads
    below ``min_mapq``, unmapped ones and those without a CIGAR are left out, and bases below ``min_baseq`` or other than A, C, G, T.

    Reads are walked where they lie, and counts combine before they are sent, however many reads stand over a position. With
    ``max_depth`` no position counts more bases than that, the first by start and read_id. Only positions that are deeper meet
    their reads a second time, by bins; there each task passes on its first ``max_depth`` at most, and so does what these meet in.
    """
    rows = _usable(alignments, min_mapq)
    every = rows.withColumn("p", F.explode(F.sequence("first", "last")))
    counts = _counted(_at(every, F.col("p"), min_baseq))
    if max_depth is None:
        return counts
    counts = stored(counts, "pileup")
    deep = stored(counts.groupBy("chrom", "pos").agg(F.sum("n").alias("depth")).filter(F.col("depth") > max_depth).select("chrom", F.col("pos").alias("p")), "deep")
    if not deep.take(1):
        return counts
    slot = lambda c: F.floor(F.col(c) / BIN)
    met = rows.withColumn("bin", F.explode(F.sequence(slot("first"), slot("last")))).join(deep.withColumn("bin", slot("p")), ["chrom", "bin"]).filter("p BETWEEN first AND last")
    place = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("start0", "read_id", "first"))
    capped = _at(met, F.col("p"), min_baseq).withColumn("place", place).filter(F.col("place") <= max_depth)
    rest = counts.join(deep.withColumnRenamed("p", "pos"), ["chrom", "pos"], "left_anti")
    return rest.unionByName(_counted(capped).select(rest.columns))


def records(counted: DataFrame, tiled: DataFrame, tile: int) -> DataFrame:
    """Variant records (chrom, pos, ref, alt, dp, info): one for each base other than the reference's that stands over a position.
    INFO has the depth and the sixteen sums: reads of the reference and of the alternative by strand, then for either the sum and sum of squares
    of base qualities, of mapping qualities and of distances from the end.

    The reference comes in tiles (left_align.tiles); positions where it has none, or N, are left out.
    """
    size = lambda flag: F.sum(F.when(F.col("reverse") == flag, F.col("n")).otherwise(0))
    names = [f"{k}_{c}" for c in _SUMS for k in ("sum", "sum2")]
    by_base = counted.groupBy("chrom", "pos", "base").agg(size(False).alias("forward"), size(True).alias("backward"), *[F.sum(c).alias(c) for c in names])
    each = by_base.groupBy("chrom", "pos").agg(F.sum(F.col("forward") + F.col("backward")).alias("dp"), F.collect_list(F.struct("base", "forward", "backward", *names)).alias("found"))  # four at most
    placed = each.withColumn("tile", F.floor((F.col("pos") - 1) / tile)).join(tiled.select("chrom", "tile", "first", "bases"), ["chrom", "tile"])
    placed = placed.withColumn("ref", F.substring("bases", (F.col("pos") - F.col("first") + 1).cast("int"), F.lit(1))).filter(F.col("ref").isin("A", "C", "G", "T"))
    own = F.get(F.filter("found", lambda x: x["base"] == F.col("ref")), F.lit(0))
    rows = placed.withColumn("own", own).withColumn("other", F.explode(F.filter("found", lambda x: x["base"] != F.col("ref"))))
    value = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0)).cast("string")
    sums = [value(s, c) for s in ("own", "other") for c in ("forward", "backward")] + [value(s, f"{k}_{c}") for c in _SUMS for s in ("own", "other") for k in ("sum", "sum2")]
    info = F.concat(F.lit("DP="), F.col("dp").cast("string"), F.lit(";I16="), F.concat_ws(",", *sums))
    return rows.select("chrom", "pos", "ref", F.col("other.base").alias("alt"), "dp", info.alias("info"))
