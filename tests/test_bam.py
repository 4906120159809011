"""Alignment files written by hand are read back whole, in however many ranges."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lociq.sources import bam

NAMES, LENGTHS = ["chr1", "chr2", "chrX"], [250_000_000, 100_000, 5_000]


def block(data):
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return bam.MAGIC + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, mapq, ops, bases, quals, tags):
    codes = [bam.BASES.index(b) for b in bases] + [0] * (len(bases) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(bases), -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(o)) for n, o in ops)
    body += packed + (bytes(q for q in quals) if quals else b"\xff" * len(bases)) + tags
    return struct.pack("<i", len(body)) + body


def fixture(path, n, block_bytes, seed=1):
    rng = random.Random(seed)
    text = b"@HD\tVN:1.6\n" * 40
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(NAMES))
    for name, length in zip(NAMES, LENGTHS, strict=True):
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    want = []
    for i in range(n):
        ref = rng.choice([-1, 0, 0, 1, 2])
        size = rng.choice([0, 1, 50, 51, 2000])
        bases, quals = "".join(rng.choices("ACGTN", k=size)), [rng.randrange(42) for _ in range(size)] if size and rng.random() < 0.9 else None
        ops = [(size - 1, "M"), (300, "N"), (1, "S")] if size > 1 else []
        pos = -1 if ref < 0 else rng.randrange(LENGTHS[ref] - 10)
        flag = rng.choice([0, 16]) | (4 if ref < 0 else 0)
        code = rng.choice([None, "AAAC-1", f"B{i}"])
        tags = b"NMC\x05" + b"XAZhello\0" + b"ZBBs\x02\0\0\0\x01\0\x02\0" + (b"CBZ" + code.encode() + b"\0" if code else b"") + b"UBZTT\0"
        data += record(f"read{i}", flag, ref, pos, rng.randrange(61), ops, bases, quals, tags)
        mapq = data[data.rindex(f"read{i}".encode() + b"\0") - 23]
        want.append((f"read{i}", flag, NAMES[ref] if ref >= 0 else None, pos if pos >= 0 else None, pos + size - 1 + 300 if pos >= 0 and ops else None, mapq, f"{size - 1}M300N1S" if ops else None, bases or None, "".join(chr(q + 33) for q in quals) if quals else None, code, bool(flag & 16), bool(flag & 4)))
    with open(path, "wb") as f:
        for i in range(0, len(data), block_bytes):
            f.write(block(data[i : i + block_bytes]))
        f.write(block(b""))
    return want


@pytest.fixture(scope="module")
def source(spark):
    bam.register(spark)
    return spark.read.format("bam")


@pytest.mark.parametrize("block_bytes", [300, 60_000])  # records reach over many blocks, or many stand in one
def test_read_back_whole(spark, source, tmp_path, block_bytes):
    path = str(tmp_path / "a.bam")
    want = fixture(path, 700, block_bytes)
    for parts in (1, 7):
        rows = spark.read.format("bam").option("partitions", parts).load(path)
        assert rows.rdd.getNumPartitions() == parts
        got = sorted(map(tuple, rows.collect()), key=lambda r: int(r[0][4:]))
        assert got == want
    some = spark.read.format("bam").option("partitions", 3).option("chrom", "chr2, chrX").load(path)
    assert {r["read_name"] for r in some.select("read_name").collect()} == {r[0] for r in want if r[2] in ("chr2", "chrX")}


def test_ranges_share_out_the_records(tmp_path):
    path = str(tmp_path / "a.bam")
    fixture(path, 300, 5_000)
    reader = bam.BamReader({"path": path, "partitions": "40"})
    counts = [sum(1 for _ in bam.records(p)) for p in reader.partitions()]
    assert sum(counts) == 300 and sum(c > 0 for c in counts) > 10


def test_filters_that_are_pushed(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = bam.BamReader({"path": "x"})
    kept = list(reader.pushFilters([EqualTo(("chrom",), "chr1"), GreaterThan(("start0",), 5), In(("chrom",), ("chr1", "chr2"))]))
    assert kept == [GreaterThan(("start0",), 5)] and reader.chroms == {"chr1"}


def test_folders_and_broken_files(spark, source, tmp_path):
    for name in ("one", "two"):
        fixture(str(tmp_path / f"{name}.bam"), 20, 500, seed=len(name))
    assert spark.read.format("bam").load(str(tmp_path)).count() == 40
    assert spark.read.format("bam").load(str(tmp_path)).agg(F.count_distinct("read_name")).first()[0] == 20
    fixture(str(tmp_path / "none.bam"), 0, 500)
    assert spark.read.format("bam").load(str(tmp_path / "none.bam")).count() == 0
    (tmp_path / "text.bam").write_text("no alignments here")
    with pytest.raises(Exception, match="no block"):
        spark.read.format("bam").load(str(tmp_path / "text.bam")).count()
    whole = (tmp_path / "one.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="no block|ends in"):
        spark.read.format("bam").load(str(tmp_path / "cut.bam")).count()
