"""The region index against a full scan; winners of streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from lociq.sources import regions
from lociq.streaming import winners


@pytest.fixture
def reads(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["1", "2", None]), rng.choice([rng.randrange(1 << 20), rng.randrange(1 << 28), (1 << 14) - 5, None]), rng.choice([1, 20, 20, 90_000])) for i in range(3000)]
    rows = [(i, c, s, None if s is None or n == 1 else s + n) for i, c, s, n in rows] + [(9000, "1", (1 << 29) + 7, (1 << 29) + 9), (9001, "2", 5, 5)]
    return rows, spark.createDataFrame(rows, "read_id long, chrom string, start0 long, end0 long")


def test_regions_equal_a_full_scan(spark, reads, tmp_path):
    rows, table = reads
    path = str(tmp_path / "indexed")
    regions.write_indexed(table, path, files=24)
    every = len(spark.read.parquet(f"{path}/reads").inputFiles())
    for wanted, most in (([("1", 1000, 60_000)], 3), ([("2", 1 << 26, (1 << 26) + 10), ("2", 0, 6)], 8), ([("1", 0, 1 << 30), ("2", 0, 1 << 30)], every), ([("3", 0, 99), ("1", 7, 7)], 0), ([("1", (1 << 29) + 8, (1 << 29) + 20)], every)):
        spans = spark.createDataFrame(wanted, "chrom string, start long, end long")
        got = regions.over(spark, path, spans)
        expected = {i for i, c, s, e in rows if c is not None and s is not None and any(c == w and s < b and max(s + 1, e or 0) > a and b > a for w, a, b in wanted)}
        found = [r["read_id"] for r in got.collect()]
        assert set(found) == expected and len(found) == len(expected) and got.columns == table.columns
        assert len(regions.files_for(spark, path, spans)) <= most


@pytest.mark.parametrize(("a", "b"), [(0, 1), (16383, 16385), (0, 1 << 14), (1 << 17, (1 << 17) + 1), (5, 1 << 29), (1 << 29, (1 << 29) + 1), (100, 100)])
def test_bins(spark, a, b):
    row = spark.range(1).select(regions.bin_of(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("own"), regions.bins_over(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("over")).first()
    last = max(b - 1, a)
    plain = next((4681 // 8 ** (5 - k) * 0 + (8**k - 1) // 7 + (a >> (14 + 3 * (5 - k))) for k in range(5, 0, -1) if a >> (14 + 3 * (5 - k)) == last >> (14 + 3 * (5 - k)) and last < 1 << 29), 0)
    assert row["own"] == plain and row["own"] in row["over"]


@pytest.mark.parametrize("last", [False, True])
def test_stream_equals_batch_after_a_restart(spark, tmp_path, last):
    rng = random.Random(4)
    parts = [[(rng.choice("abcdef"), rng.choice([None, *range(9)]), f"v{b}{i}", 1_700_000_000 + b) for i in range(25)] for b in range(4)]
    schema = "key string, ord long, value string, seconds long"
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def stream():
        rows = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds("seconds"))
        query = winners.write(winners.winners(rows, ["key"], "ord", "ts", "1 hour", last), out, checkpoint)
        query.processAllAvailable()
        query.stop()

    for b, part in enumerate(parts):  # every second batch by a query that starts again from its checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        if b % 2:
            stream()
    got = {r["key"]: r["ord"] for r in winners.current(spark, out, ["key"], "ord", last).collect()}
    known = {k: [o for part in parts for key, o, *_ in part if key == k and o is not None] for k in "abcdef"}
    assert got == {k: (max if last else min)(v) for k, v in known.items()}
    written = spark.read.parquet(f"{out}/batch=*").count()
    stream()  # nothing new
    assert spark.read.parquet(f"{out}/batch=*").count() == written
