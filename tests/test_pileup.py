"""Pileups against walking every read base by base."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from lociq.functions import fields
from lociq.operators import left_align, pileup

SCHEMA = "read_id long, chrom string, start0 int, cigar string, bases string, quals string, mapq int, reverse boolean, unmapped boolean"


def walked(cigar):
    """(offset on the reference, offset in the read) of every aligned base."""
    ref = read = 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if op in "M=X":
                yield ref, read
            ref += op in "M=XDN"
            read += op in "M=XIS"


def plain(rows, min_mapq, min_baseq, max_depth=None):
    at = collections.defaultdict(list)
    for read_id, chrom, start, cigar, bases, quals, mapq, reverse, unmapped in rows:
        if unmapped or mapq < min_mapq or start is None or not re.fullmatch(r"(\d+[MIDNSHP=X])+", cigar or ""):
            continue
        for ref, read in walked(cigar):
            base = bases[read : read + 1].upper()
            if base and base in "ACGT" and read < len(quals) and ord(quals[read]) - 33 >= min_baseq:
                at[chrom, start + 1 + ref].append((start, read_id, base, reverse, ord(quals[read]) - 33, mapq, min(read, len(bases) - 1 - read, 25)))
    out = {}
    for (chrom, pos), found in at.items():
        for _, _, base, reverse, *values in sorted(found)[:max_depth]:
            key = chrom, pos, base, reverse
            n, sums = out.get(key, (0, [0] * 6))
            out[key] = n + 1, [s + x for s, x in zip(sums, [y for v in values for y in (v, v * v)], strict=True)]
    return {(*k, n, *s) for k, (n, s) in out.items()}


def alignments(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        cigar = rng.choice(["20M", "3S10M2I5M", "5M3D10M300N5M", "2H4=1X15M2S", "10M1P10M", "8M200N2D12M", "*", None, "20Q", "0M20M"])
        size = rng.choice([20, 20, 20, 15])  # some shorter than their CIGAR
        rows.append((i, rng.choice("ab"), rng.choice([5, 30, 31, 32, 140, None]), cigar, "".join(rng.choice("ACGTNa") for _ in range(size)), "".join(chr(33 + rng.randrange(41)) for _ in range(size)), rng.randrange(60), rng.random() < 0.5, rng.random() < 0.1))
    return rows


@pytest.mark.parametrize("max_depth", [None, 5, 1000])
def test_equals_walking_the_reads(spark, max_depth):
    rows = alignments(2)
    got = pileup.columns(spark.createDataFrame(rows, SCHEMA).repartition(3), 10, 13, max_depth).collect()
    assert {tuple(r) for r in got} == plain(rows, 10, 13, max_depth) and len(got) > 300


def test_blocks(spark):
    one = lambda c: spark.range(1).select(pileup.blocks(F.lit(c))).first()[0]
    assert [tuple(b) for b in one("3S10M2I5M4D6N7=1H")] == [(0, 3, 10), (10, 15, 5), (25, 20, 7)]
    assert one("*") is None and one("10") is None and one("") is None and one("5S") == []


def test_a_very_deep_position_is_spread(spark):
    """Counts of a position combine in every task: what is sent does not grow with its reads."""
    one = spark.range(200_000, numPartitions=8).select(F.col("id").alias("read_id"), F.lit("a").alias("chrom"), F.lit(7).alias("start0"), F.lit("4M").alias("cigar"), F.lit("ACGT").alias("bases"), F.lit("IIII").alias("quals"), F.lit(60).alias("mapq"), (F.col("id") % 2 == 0).alias("reverse"), F.lit(False).alias("unmapped"))
    got = pileup.columns(one, 0, 0).collect()
    assert len(got) == 8 and {r["n"] for r in got} == {100_000}
    capped = pileup.columns(one.limit(20_000), 0, 0, 50)
    assert {r["n"] for r in capped.groupBy("pos").agg(F.sum("n").alias("n")).collect()} == {50}
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()


def test_records(spark):
    rows = [(1, "a", 0, "4M", "ACGT", "IIII", 60, False, False), (2, "a", 0, "4M", "AGGT", "I5II", 50, True, False), (3, "a", 1, "3M", "TGN", "III", 40, False, False)]
    counted = pileup.columns(spark.createDataFrame(rows, SCHEMA))
    tiled = left_align.tiles(spark.createDataFrame([("a", 1, "ACG")], "chrom string, start long, seq string"), 2, 1)
    got = {(r["pos"], r["ref"], r["alt"]): r for r in pileup.records(counted, tiled, 2).collect()}
    assert set(got) == {(2, "C", "G"), (2, "C", "T")}
    assert got[2, "C", "G"]["info"] == "DP=3;I16=1,0,0,1,40,1600,20,400,60,3600,50,2500,1,1,1,1"
    assert got[2, "C", "T"]["info"] == "DP=3;I16=1,0,1,0,40,1600,40,1600,60,3600,40,1600,1,1,0,0"
    share = pileup.records(counted, tiled, 2).select(fields.baf(fields.i16(F.col("info")))).first()[0]
    assert share == 0.5


def test_nothing(spark):
    assert pileup.columns(spark.createDataFrame([], SCHEMA), max_depth=3).count() == 0
