"""Token-id output: whole texts to ids, ids to files of range-coded blocks, and back.

A file's rows are segments: whole documents in ascending ``doc_id`` order, cut into blocks of 4,096 ids that
are coded by :mod:`range_coder`, each on its own and with a checksum. Spark's Parquet writer holds the
segments, so files go to any store and a lost task leaves nothing behind.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm import range_coder
from lociq.llm.common import SPACE, column_of, pieces, texts_of
from lociq.scratch import new_path

FILE_SCHEMA = "part int, segment long, part_offset long, doc_ids array<bigint>, lengths array<bigint>, blocks array<binary>"
_SEGMENT_IDS = 1 << 18  # a segment closes at the first document that fills it
_GROUP_BYTES = 16 << 20  # text tokenised, and coded in lockstep, at a time

_WORDS_AT_ONCE = 20_000  # distinct words that the tokenizer gets in one text
_FOLD = bytes(32 if b in SPACE.encode() else b for b in range(256))

#: A tokenizer that normalises and splits like this gives words of visible ASCII characters the pieces of _PIECE, lower-cased.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PIECE = re.compile(" |'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
_VISIBLE = "^[!-~]+$"
#: UTF-8 of all that may be white space to the tokenizer, and of controls.
_SPACED = r"[\x00-\x20\x7f]|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xaf]|\xe3\x80\x80|\xef\xbb\xbf"

_tokenizers: dict[int, tuple] = {}


def _tokenizer(spec: bytes) -> tuple:
    """The tokenizer, its added tokens, which it finds anywhere in a text (string to id), and its model alone if words
    of visible ASCII characters can be split without it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = zlib.crc32(spec)
    if key not in _tokenizers:
        made = Tokenizer.from_str(spec.decode())
        parts = json.loads(spec)
        known = parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == _PRE_TOKENIZER
        _tokenizers[key] = (made, {t.content: i for i, t in made.get_added_tokens_decoder().items()}, made.model if known else None)
    return _tokenizers[key]


def _ids_of_words(words: list[str], tokenizer, added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, none of which holds an added token, and where each word's end. Many words go to the tokenizer
    as one text with an added token between them, if it has one."""
    ids, ends, before = [], [], 0
    between, mark = next(iter(added.items()), (None, None))
    for i in range(0, len(words), _WORDS_AT_ONCE):
        some = words[i : i + _WORDS_AT_ONCE]
        if between is None:
            found = [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            ids += [np.array(x, np.uint32) for x in found]
            upto = np.cumsum([len(x) for x in found])
        else:
            flat = np.array(tokenizer.encode_batch_fast([between.join([*some, ""])], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(flat == mark)
            ids.append(np.delete(flat, marks))
            upto = marks - np.arange(len(marks))
        ends.append(before + upto)
        before = int(ends[-1][-1])
    return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *ends])


def _spread(values: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code's stretch, one stretch after the other, and where each ends."""
    sizes = np.diff(ends, prepend=0)[codes]
    upto = np.cumsum(sizes)
    return values[np.repeat(ends[codes] - upto, sizes) + np.arange(int(upto[-1]) if len(upto) else 0)], upto


def _joined(words: pa.Array) -> str:
    """The words, a space behind each."""
    return pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(b" ", words.type))[0].as_py().decode() + " "


def _ids_of_pieces(pieces: list[str], model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words that the pieces make up, a space behind each, and where each word's end. The model gets each
    distinct piece once."""
    coded = pa.array(pieces, pa.string()).dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    found = [[] if p == " " else [t.id for t in model.tokenize(p)] for p in distinct]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ids, upto = _spread(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), np.cumsum(sizes), codes)
    return ids, upto[codes == distinct.index(" ")]


def _pieces_of_others(words: pa.Array, tokenizer) -> list[str]:
    """Pieces of words without white space, a space behind each, from the tokenizer's own parts."""
    text = tokenizer.normalizer.normalize_str(_joined(words))
    out, before = [], 0
    for piece, (start, end) in tokenizer.pre_tokenizer.pre_tokenize_str(text):
        out += [" "] * (start - before)  # only spaces lie between pieces
        out.append(piece)
        before = end
    return out + [" "] * (len(text) - before)


def _ids_of_distinct(words: pa.Array, tokenizer, added: dict[str, int], model) -> tuple[np.ndarray, np.ndarray]:
    """As _ids_of_words, for an array of words."""
    if not model or not len(words):
        return _ids_of_words([w.decode() for w in words.to_pylist()], tokenizer, added)
    visible = pc.match_substring_regex(words, _VISIBLE)
    spaced = pc.match_substring_regex(words, _SPACED)
    kinds = [visible, spaced, pc.invert(pc.or_(visible, spaced))]
    some = [words.filter(kind) for kind in kinds]
    parts = [
        _ids_of_pieces(_PIECE.findall(_joined(some[0]).lower()), model),
        _ids_of_words([w.decode() for w in some[1].to_pylist()], tokenizer, added),
        _ids_of_pieces(_pieces_of_others(some[2], tokenizer), model),
    ]
    places = np.empty(len(words), np.int64)
    places[np.concatenate([np.flatnonzero(kind.to_numpy(zero_copy_only=False)) for kind in kinds])] = np.arange(len(words))
    before = np.cumsum([0] + [len(ids) for ids, _ in parts])
    return _spread(np.concatenate([ids for ids, _ in parts]), np.concatenate([b + ends for b, (_, ends) in zip(before, parts, strict=False)]), places)


def tokenise(texts: list[bytes], spec: bytes) -> list[np.ndarray]:
    """Ids of each text, as the tokenizer gives them. It drops white space and never joins what that separates, so each
    distinct word between ASCII white space is encoded once; texts that hold an added token are encoded whole."""
    tokenizer, added, model = _tokenizer(spec)
    strings = [a.encode() for a in added]
    whole = [any(a in t for a in strings) for t in texts]
    split = pc.split_pattern(pa.array([b"" if w else t.translate(_FOLD) for w, t in zip(whole, texts, strict=True)], pa.large_binary()), b" ")
    words = split.flatten()
    filled = pc.greater(pc.binary_length(words), 0)
    text_ends = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])[np.cumsum(pc.list_value_length(split).to_numpy())]
    coded = words.filter(filled).dictionary_encode()
    ids, ends = _ids_of_distinct(coded.dictionary, tokenizer, added, model)
    flat, upto = _spread(ids.astype("<u4"), ends, coded.indices.to_numpy())
    out = np.split(flat, np.concatenate([[0], upto])[text_ends][:-1]) if texts else []
    for i in np.flatnonzero(whole):
        out[i] = np.array(tokenizer.encode_batch_fast([texts[i].decode()], add_special_tokens=False)[0].ids, dtype="<u4")
    return out


def _blocks(segments: list[tuple[list, list[np.ndarray]]]) -> list[list[bytes]]:
    """Coded blocks of each segment; the blocks of all segments are coded in lockstep."""
    cut = []
    for _, ids in segments:
        whole = np.concatenate(ids)
        cut.append([whole[i : i + range_coder.BLOCK] for i in range(0, len(whole), range_coder.BLOCK)])
    coded = iter(range_coder.encode([b for blocks in cut for b in blocks]))
    return [[next(coded) for _ in blocks] for blocks in cut]


def write(docs: DataFrame, path: str, tokenizer_json: bytes, end_id: int = 2) -> None:
    """Write the ids of every document, each followed by ``end_id``, in ascending ``doc_id`` order.

    Null texts are empty (only the end id). Null ids come first; rows of equal ``doc_id`` stay apart, in the
    order of their texts' hash. Extra columns are ignored. An empty table gives a table without rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before = pyspark.TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts, keys = texts_of(batch), column_of(batch, "doc_id")
            for a, b in pieces(batch, map(len, texts), _GROUP_BYTES):
                segments: list[tuple[list, list]] = [([], [])]
                filled = 0
                for key, ids in zip(keys[a:b], tokenise(texts[a:b], shared.value), strict=True):
                    if filled >= _SEGMENT_IDS:
                        segments.append(([], []))
                        filled = 0
                    segments[-1][0].append(key)
                    segments[-1][1].append(np.append(ids, np.uint32(end_id)))
                    filled += len(ids) + 1
                lengths = [[len(x) for x in ids] for _, ids in segments]
                offsets = before + np.concatenate([[0], np.cumsum([sum(x) for x in lengths])])
                rows = {
                    "part": pa.array([part] * len(segments), pa.int32()),
                    "segment": pa.array(range(segment, segment + len(segments)), pa.int64()),
                    "part_offset": pa.array(offsets[:-1], pa.int64()),
                    "doc_ids": pa.array([k for k, _ in segments], pa.list_(pa.int64())),
                    "lengths": pa.array(lengths, pa.list_(pa.int64())),
                    "blocks": pa.array(_blocks(segments), pa.list_(pa.binary())),
                }
                segment, before = segment + len(segments), int(offsets[-1])
                yield pa.RecordBatch.from_pydict(rows)

    tie = F.xxhash64("text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", tie)
    ordered = slim.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    ordered.mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Documents of the files at ``path``: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (unsigned, of the ids as little-endian uint32) and ids (binary, the same bytes)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = column_of(batch, "blocks")
            for a, b in pieces(batch, [4 * range_coder.BLOCK * len(x) for x in coded], 2 * _GROUP_BYTES):
                ids = iter(range_coder.decode([x for blocks in coded[a:b] for x in blocks]))
                starts, keys, lengths, sums, held = [], [], [], [], []
                for i in range(a, b):
                    whole = np.concatenate([next(ids) for _ in coded[i]]).astype("<u4")
                    at = 0
                    for key, n in zip(batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), strict=True):
                        own = whole[at : at + n].tobytes()
                        starts.append(batch.column(2)[i].as_py() + at)
                        keys.append(key)
                        lengths.append(n)
                        sums.append(zlib.crc32(own))
                        held.append(own)
                        at += n
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p for i in range(a, b) for p in [batch.column(0)[i].as_py()] * len(batch.column(3)[i])], pa.int32()),
                    "doc_id": pa.array(keys, pa.int64()), "within": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()), "ids": pa.array(held, pa.binary()),
                })

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row for each part: the ids that stand in the parts before it.
    totals = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids_in_part"))
    before = F.sum("ids_in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rows = files.mapInArrow(decode, "part int, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(docs: DataFrame, tokenizer_json: bytes, end_id: int = 2) -> DataFrame:
    """Write the documents to a new folder of token files and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write(docs, path, tokenizer_json, end_id)
    return read(spark, path)
