"""Alignment files as a Spark source: ``spark.read.format("bam").load(path)`` after :func:`register`.

Files are read where they lie, in ranges of their compressed blocks, each in its own task. What is read of a file to plan this is its
size and header. Paths are those that pyarrow's file systems reach (local, shared, hdfs, s3, ...).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "read_name string, flag int, chrom string, start0 int, end0 int, mapq int, cigar string, bases string, quals string, barcode string, reverse boolean, unmapped boolean"
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 10_000
#: Fixed values of the format: operations of a CIGAR, bases of a sequence, and the bytes that begin a block.
OPERATIONS, BASES, MAGIC = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", b"\x1f\x8b\x08\x04"
_PAIRS = [BASES[i >> 4] + BASES[i & 15] for i in range(256)]
_FIXED = struct.Struct("<iiBBHHHiiii")  # of a record, behind its size
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_HEAD = 64 << 10
_CHECKED = 5  # records in a row that must look like records where a task finds its first


class NotABam(ValueError):
    pass


def _open(path: str):
    files, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))
    return files, name


def block_size(head: bytes, at: int = 0) -> int | None:
    """Bytes of the compressed block that begins there; null if none does."""
    if head[at : at + 4] != MAGIC or len(head) < at + 18:
        return None
    (extra,) = struct.unpack_from("<H", head, at + 10)
    field, end = at + 12, at + 12 + extra
    while field + 4 <= min(end, len(head)):
        (length,) = struct.unpack_from("<H", head, field + 2)
        if head[field : field + 2] == b"BC" and length == 2 and field + 6 <= len(head):
            return struct.unpack_from("<H", head, field + 4)[0] + 1
        field += 4 + length
    return None


class Blocks:
    """The blocks of a file from one place on: (place in the file, what it holds)."""

    def __init__(self, file: pa.NativeFile, at: int) -> None:
        self.file, self.at, self.size = file, at, file.size()

    def read(self, n: int) -> bytes:
        self.file.seek(self.at)
        return self.file.read(n)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.size:
            whole = self.read(_HEAD + 1)
            size = block_size(whole)
            if size is None or size > len(whole):
                raise NotABam(f"no block at byte {self.at}")
            place, self.at = self.at, self.at + size
            (extra,) = struct.unpack_from("<H", whole, 10)
            yield place, zlib.decompress(whole[12 + extra : size - 8], -15)

    def first_from(self, at: int) -> int | None:
        """Where the first block at or after a place begins: where a block's head stands, and another one, or the file's end, behind it."""
        self.at = at
        while self.at < self.size:
            window = self.read(2 * _HEAD + 36)
            found = window.find(MAGIC)
            while 0 <= found <= _HEAD:
                size = block_size(window, found)
                behind = found + (size or 0)
                if size and (self.at + behind == self.size or block_size(window, behind)):
                    return self.at + found
                found = window.find(MAGIC, found + 1)
            self.at += _HEAD
        return None


@dataclass(frozen=True)
class Header:
    names: tuple[str, ...]
    lengths: tuple[int, ...]
    block: int  # the place of the block in which the first record begins
    skip: int  # and where in it


def header_of(path: str) -> Header:
    files, name = _open(path)
    with files.open_input_file(name) as file:
        places, data, wanted = [], b"", 12

        def whole(n: int) -> bool:
            return len(data) >= n

        blocks = iter(Blocks(file, 0))

        def need(n: int) -> None:
            nonlocal data
            while not whole(n):
                try:
                    place, block = next(blocks)
                except StopIteration as end:
                    raise NotABam(f"{path} ends in its header") from end
                places.append((place, len(data), len(block)))
                data += block

        need(wanted)
        if data[:4] != b"BAM\x01":
            raise NotABam(f"{path} is not an alignment file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        need(at + 4)
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        names, lengths = [], []
        for _ in range(n):
            need(at + 4)
            (length,) = struct.unpack_from("<i", data, at)
            need(at + 8 + length)
            names.append(data[at + 4 : at + 3 + length].decode())
            lengths.append(struct.unpack_from("<i", data, at + 4 + length)[0])
            at += 8 + length
        for place, start, size in places:
            if start <= at < start + size:
                return Header(tuple(names), tuple(lengths), place, at - start)
        return Header(tuple(names), tuple(lengths), blocks_end(places, file), 0)


def blocks_end(places: list[tuple[int, int, int]], file: pa.NativeFile) -> int:
    """The place behind the last block that was read."""
    last = Blocks(file, places[-1][0])
    next(iter(last))
    return last.at


def looks_like_record(data: bytes, at: int, header: Header) -> int | None:
    """The end of the record that may begin there; null if what stands there can't be one. Only the part at hand is judged."""
    if at + 36 > len(data):
        return None
    size, ref, pos, name_size, _, _, n_ops, _, n_bases, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    n = len(header.names)
    if size < 32 or name_size < 1 or n_bases < 0 or not -1 <= ref < n or not -1 <= next_ref < n or pos < -1 or next_pos < -1:
        return None
    if (ref >= 0 and pos >= header.lengths[ref]) or 32 + name_size + 4 * n_ops + (n_bases + 1) // 2 + n_bases > size:
        return None
    name = data[at + 36 : at + 36 + name_size]
    if len(name) == name_size and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def first_record(data: bytes, header: Header, within: int) -> int | None:
    """Where in the first ``within`` bytes a run of records begins: _CHECKED in a row, or all up to the end of what is at hand."""
    for at in range(within):
        end, seen = at, 0
        while seen < _CHECKED and end + 36 <= len(data):
            end = looks_like_record(data, end, header)
            if end is None:
                break
            seen += 1
        if end is not None and seen and (seen == _CHECKED or end + 36 > len(data)):
            return at
    return None


def parsed(record: memoryview, header: Header) -> tuple:
    """The columns of SCHEMA from a record without its size."""
    ref, pos, name_size, mapq, _, n_ops, flag, n_bases, *_ = _FIXED.unpack_from(record)
    at = 32
    name = bytes(record[at : at + name_size - 1]).decode()
    at += name_size
    ops = struct.unpack_from(f"<{n_ops}I", record, at)
    at += 4 * n_ops
    bases = "".join([_PAIRS[b] for b in record[at : at + (n_bases + 1) // 2]])[:n_bases]
    at += (n_bases + 1) // 2
    quals = record[at : at + n_bases]
    text = None if not n_bases or quals[0] == 255 else bytes(min(q + 33, 126) for q in quals).decode()
    cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or None
    span = sum(o >> 4 for o in ops if OPERATIONS[o & 15] in "MDN=X")
    unmapped = bool(flag & 4)
    return name, flag, header.names[ref] if ref >= 0 else None, pos if pos >= 0 else None, pos + span if pos >= 0 and span else None, mapq, cigar, bases or None, text, barcode_of(record, at + n_bases), bool(flag & 16), unmapped


def barcode_of(record: memoryview, at: int, tag: bytes = b"CB") -> str | None:
    """The text of a tag; null if the record has none."""
    while at + 3 <= len(record):
        key, kind = bytes(record[at : at + 2]), chr(record[at + 2])
        at += 3
        if kind in "ZH":
            end = at
            while record[end]:
                end += 1
            if key == tag:
                return bytes(record[at:end]).decode()
            at = end + 1
        elif kind == "B":
            at += 5 + _TAG_SIZES[chr(record[at])] * struct.unpack_from("<i", record, at + 1)[0]
        else:
            at += _TAG_SIZES[kind]
    return None


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    header: Header


def records(part: Range) -> Iterator[memoryview]:
    """The records that begin in blocks of the range; the last may reach beyond it."""
    files, name = _open(part.path)
    with files.open_input_file(name) as file:
        blocks = Blocks(file, part.start)
        begin = part.header.block if part.start <= part.header.block else blocks.first_from(part.start)
        if begin is None or begin >= part.end:
            return
        blocks.at = begin
        data, known = b"", part.start <= part.header.block
        skip = part.header.skip if known else 0
        ends: list[int] = []  # how much of data blocks of the range make up
        stream = iter(blocks)

        def more() -> bool:
            nonlocal data
            got = next(stream, None)
            if got is None:
                return False
            data += got[1]
            if got[0] < part.end:
                ends[:] = [len(data)]
            return True

        while True:
            if not known:
                wanted = len(data) + 4 * _HEAD
                while len(data) < wanted and more():
                    pass
                found = first_record(data, part.header, ends[0] if ends else 0)
                if found is None:
                    if blocks.at >= part.end or blocks.at >= blocks.size:
                        return  # no record begins here: a long one passes through
                    continue
                skip, known = found, True
            elif not more() and not data[skip:]:
                return
            at, own = skip, ends[0] if ends else 0
            view = memoryview(data)
            while at < own and at + 4 <= len(data):
                (size,) = struct.unpack_from("<i", data, at)
                if at + 4 + size > len(data):
                    break
                yield view[at + 4 : at + 4 + size]
                at += 4 + size
            if at >= own and blocks.at >= part.end:
                return
            view = None
            data, skip, ends[:] = data[at:], 0, [max(0, own - at)]
            if blocks.at >= blocks.size and len(data) < 4:
                return
            if blocks.at >= blocks.size:
                (size,) = struct.unpack_from("<i", data, 0)
                if 4 + size > len(data):
                    raise NotABam(f"{part.path} ends in a record")


class BamReader(DataSourceReader):
    """Options: path, ``partitions`` (ranges of a file; by default one for each SPLIT_BYTES), ``chrom`` (names to keep, with commas)."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.parts = int(options.get("partitions", 0))
        self.chroms = frozenset(c.strip() for c in options["chrom"].split(",")) if options.get("chrom") else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Chromosomes are judged before anything else of a record is read."""
        for f in filters:
            names = None
            if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                names = frozenset([f.value])
            elif isinstance(f, In) and f.attribute == ("chrom",):
                names = frozenset(f.value)
            if names is None:
                yield f
            else:
                self.chroms = names if self.chroms is None else self.chroms & names

    def _files(self) -> list[tuple[str, int]]:
        files, name = _open(self.path)
        about = files.get_file_info(name)
        if about.type == pyarrow.fs.FileType.Directory:
            inside = [f for f in files.get_file_info(pyarrow.fs.FileSelector(name, recursive=True)) if f.is_file and f.path.endswith(".bam")]
            scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
            return sorted((scheme + f.path, f.size) for f in inside)
        if not about.is_file:
            raise FileNotFoundError(self.path)
        return [(self.path, about.size)]

    def partitions(self) -> list[Range]:
        out = []
        for path, size in self._files():
            n = self.parts or max(1, -(-size // SPLIT_BYTES))
            cuts = [size * i // n for i in range(n + 1)]
            header = header_of(path)
            out += [Range(path, a, b, header) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        wanted = None if self.chroms is None else {i for i, n in enumerate(partition.header.names) if n in self.chroms}
        for record in records(partition):
            if wanted is None or struct.unpack_from("<i", record)[0] in wanted:
                yield parsed(record, partition.header)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark push filters into sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
