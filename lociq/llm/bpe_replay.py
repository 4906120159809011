"""Byte-level BPE by replaying merges over a vocabulary of words.

Each task gathers the distinct words of a chunk of its texts and lays their bytes out in one linked list. An
inverted index maps each pair's rank to the places where the pair stands. Ranks are replayed in ascending
order, each over all its places at once; a merge touches its place and the two neighbours only, whose new pairs
enter the index. Texts are then put together from their words by Arrow's dictionaries, without a step for each
occurrence of a word.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lociq.llm.common import pieces

_CHUNK_BYTES = 12 << 20  # text whose words are merged together
_SPAN_IDS = 1 << 18  # ids of a chunk's texts that are laid out at a time
_NONE = 1 << 30


class Ranks:
    """A vocabulary in tiktoken's format: one line "base64-token rank" each. Two neighbouring tokens merge if
    their joined bytes are a token, lowest rank first."""

    def __init__(self, data: bytes) -> None:
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.tokens = {b: a for a, b in self.ids.items()}
        self.end = max(self.tokens) + 1  # stands beyond a word's ends; merges with nothing
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int32)
        self.of_bytes = np.full((256, 256), _NONE, np.int32)
        #: of a token: its right (left) neighbours that it merges with, and the ranks of the merges
        rights, lefts = defaultdict(list), defaultdict(list)
        for token, rank in self.ids.items():
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    rights[a].append((b, rank))
                    lefts[b].append((a, rank))
            if len(token) == 2:
                self.of_bytes[token[0], token[1]] = rank
        self.rights, self.lefts = ({k: np.array(v, np.int32).T for k, v in pairs.items()} for pairs in (rights, lefts))
        #: tokens that can go on to make one of a lower rank
        self.hasty = {k for pairs in (self.rights, self.lefts) for k, (_, made) in pairs.items() if made.min() < k}
        self.names = pa.array([self.tokens.get(i, b"") for i in range(self.end)], pa.binary())
        self.decimals = pa.array([b"%d " % i for i in range(self.end)], pa.binary())


def _one_word(word: bytes, ranks: Ranks) -> list[int]:
    """Plain merging of one word, the lowest rank first and from the left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min((ranks.ids.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == _NONE:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks.ids[p] for p in parts]


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one word after the other, and where each word's end (int64)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), ends
    final = np.zeros(n, bool)  # places that end a word
    final[ends[lengths > 0] - 1] = True
    # The place n stands for whatever lies beyond a word.
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[:n][final] = n
    before[0] = n
    before[1:n][final[:-1]] = n
    symbol = np.append(ranks.single[data], np.int32(ranks.end))
    pair = np.full(n + 1, _NONE, np.int32)  # rank of the pair that begins at a place
    pair[: n - 1] = np.where(final[:-1], _NONE, ranks.of_bytes[data[:-1], data[1:]])
    index: dict[int, list[np.ndarray]] = {}  # rank to places
    queue: list[int] = []
    odd: list[np.ndarray] = []
    merges = np.full(ranks.end + 1, _NONE, np.int32)  # scratch: by neighbour, the rank of its merge with the new token

    def enter(places: np.ndarray, new: np.ndarray) -> None:
        hit = np.flatnonzero(new < _NONE)
        if not len(hit):
            return
        places, new = places[hit], new[hit]
        if len(hit) > 1:
            order = np.argsort(new, kind="stable")
            places, new = places[order], new[order]
            cuts = [0, *(np.flatnonzero(new[1:] != new[:-1]) + 1).tolist(), len(new)]
        else:
            cuts = [0, 1]
        for a, b, rank in zip(cuts[:-1], cuts[1:], new[cuts[:-1]].tolist(), strict=True):
            there = index.get(rank)
            if there is None:
                index[rank] = [places[a:b]]
                heapq.heappush(queue, rank)
            else:
                there.append(places[a:b])

    enter(np.arange(n, dtype=np.int32), pair[:n])
    empty = np.zeros((2, 0), np.int32)
    while queue:
        rank = heapq.heappop(queue)
        listed = index.pop(rank)
        at = listed[0] if len(listed) == 1 else np.concatenate(listed)
        at = at[pair[at] == rank]
        if not len(at):
            continue
        if rank in ranks.hasty and len(at) > 1:  # after the first of two merges in a word, a lower rank may come first
            in_word = np.sort(np.searchsorted(ends, at, side="right"))
            odd.append(in_word[1:][in_word[1:] == in_word[:-1]])
        gone = after[at]
        if (pair[gone] == rank).any():  # overlapping pairs merge from the left
            at, taken = np.sort(at), set()
            for place in at.tolist():
                if int(before[place]) not in taken:
                    taken.add(place)
            at = np.array(sorted(taken), np.int32)
            gone = after[at]
        following = after[gone]
        symbol[at], symbol[gone] = rank, -1
        pair[gone] = _NONE
        after[at], before[following] = following, at
        preceding = before[at]
        for neighbour, places, (partners, made) in ((following, at, ranks.rights.get(rank, empty)), (preceding, preceding, ranks.lefts.get(rank, empty))):
            if not len(partners):
                pair[places] = _NONE
                continue
            merges[partners] = made
            beside = symbol[neighbour]
            new = merges[beside]
            merges[partners] = _NONE
            if neighbour is preceding:  # a neighbour that is new itself has had its turn from the left
                fresh = beside != rank
                places, new = places[fresh], new[fresh]
            pair[places] = new
            enter(places, new)
        pair[n] = _NONE
    symbol = symbol[:n]
    kept = symbol >= 0
    ids, upto = symbol[kept], np.cumsum(kept)[np.maximum(ends, 1) - 1]
    upto[ends == 0] = 0
    again = np.unique(np.concatenate(odd)).tolist() if odd else []
    if again:  # they are merged word by word
        split = np.split(ids, upto[:-1])
        for i in again:
            split[i] = np.array(_one_word(words[i], ranks), np.int32)
        ids, upto = np.concatenate(split), np.cumsum([len(x) for x in split])
    return ids, upto


def _offsets(upto: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), upto])


def _together(values: pa.Array, ids: np.ndarray, upto: np.ndarray) -> pa.Array:
    """For each word, the values of its ids, joined."""
    flat = values.take(pa.array(ids))
    bounds = np.frombuffer(flat.buffers()[1], np.int32, len(ids) + 1)
    return pa.Array.from_buffers(pa.binary(), len(upto), [None, pa.py_buffer(bounds[_offsets(upto)].astype(np.int32)), flat.buffers()[2]])


def _gathered(values: np.ndarray, upto: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``values`` (they end at ``upto``), one after the other, and where each ends."""
    sizes = np.diff(_offsets(upto))[which]
    ends = np.cumsum(sizes)
    return values[np.repeat(upto[which] - ends, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class Encoded:
    """Ids of texts by way of their words: the words' ids, and each text's words as codes."""

    def __init__(self, ranks: Ranks, matches: list[str], match_ends: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> None:
        """matches: those of all distinct words, which end at match_ends (the list is emptied); codes: words of all texts, which end at ends."""
        self.ranks, self.codes, self.ends = ranks, pa.array(codes), ends
        coded = pa.array(matches, pa.string()).dictionary_encode()
        matches.clear()
        ids, upto = replay(coded.dictionary.cast(pa.binary()).to_pylist(), ranks)
        self.ids, upto = _gathered(ids, upto, coded.indices.to_numpy())
        self.upto = _offsets(upto)[match_ends]
        self.text_ends = _offsets(np.cumsum(np.diff(_offsets(self.upto))[codes]))[ends]

    def spans(self) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about _SPAN_IDS ids each (a longer text stands alone)."""
        bounds, start = _offsets(self.text_ends), 0
        while start < len(self.ends):
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + _SPAN_IDS, side="right")) - 1)
            yield start, min(stop, len(self.ends))
            start = stop

    def _codes(self, start: int, stop: int | None) -> pa.Array:
        bounds = _offsets(self.ends)[start : None if stop is None else stop + 1]
        return self.codes.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))

    def flat(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of all texts, or of a range of them."""
        return _gathered(self.ids, self.upto, self._codes(start, stop).to_numpy())[0]

    def joined(self) -> tuple[pa.Array, pa.Array]:
        """Of each word its ids in decimal, and the bytes that they stand for."""
        return _together(self.ranks.decimals, self.ids, self.upto), _together(self.ranks.names, self.ids, self.upto)

    def digests(self, words: tuple[pa.Array, pa.Array], start: int = 0, stop: int | None = None) -> tuple[list[str], list[str]]:
        """sha256 of each text's ids in decimal and of the bytes that they stand for; ``words`` is what :meth:`joined` gives."""
        out, codes = [], self._codes(start, stop)
        ends = _offsets(self.ends)[start : None if stop is None else stop + 1]
        for values, cut in zip(words, (1, 0), strict=True):
            joined = values.take(codes)
            bounds = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[ends - ends[0]].tolist()
            whole = memoryview(joined.buffers()[2] or b"")
            out.append([hashlib.sha256(whole[a : max(a, b - cut)]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)])
        return out[0], out[1]


class Encoder:
    """Encodes texts, each match of the pattern on its own. ``spaced``: the pattern takes a single space between two
    other characters only at the front of a match, and looks no further than such a space; then texts may be cut
    there (the pattern of public_tokenizers is one of these)."""

    def __init__(self, data: bytes, pattern: str, spaced: bool = True) -> None:
        self.ranks, self.match, self.spaced = Ranks(data), regex.compile(pattern).findall, spaced
        self.wide = regex.compile(r"\s\s").search

    def _of(self, texts: pa.Array) -> Encoded:
        """Texts without neighbouring white space, cut at their spaces."""
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        del split, coded
        first = ends - np.diff(_offsets(ends))  # a text's first word has no space before it
        which, new = np.unique(codes[first], return_inverse=True)
        codes[first] = len(words) + new
        # All words with their spaces make one text, whose matches end where a word ends.
        matches = self.match("".join([" " + w for w in words]))
        lengths = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        match_ends = np.searchsorted(np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches))), lengths) + 1
        heads = [self.match(words[i]) for i in which.tolist()]
        match_ends = np.concatenate([match_ends, len(matches) + np.cumsum([len(h) for h in heads], dtype=np.int64)])
        matches += [m for h in heads for m in h]
        del words, heads
        return Encoded(self.ranks, matches, match_ends, codes, ends)

    def _of_matches(self, texts: list[str]) -> Encoded:
        split = [self.match(t) for t in texts]
        coded = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
        return Encoded(self.ranks, coded.dictionary.to_pylist(), np.arange(1, len(coded.dictionary) + 1), coded.indices.to_numpy(), np.cumsum([len(x) for x in split], dtype=np.int64))

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, Encoded]]:
        """Places of texts and their ids; every text is in one of the parts."""
        plain = np.fromiter((self.spaced and not self.wide(t.as_py()) for t in texts), bool, len(texts))
        parts = []
        for some, encode in ((np.flatnonzero(plain), self._of), (np.flatnonzero(~plain), lambda t: self._of_matches(t.to_pylist()))):
            if len(some):
                parts.append((some, encode(texts if len(some) == len(texts) else texts.take(pa.array(some)))))
        return parts


_encoders: dict[int, Encoder] = {}


def encoder(data: bytes, pattern: str, spaced: bool) -> Encoder:
    """This Python worker's encoder for a vocabulary; it remembers no words."""
    key = zlib.crc32(pattern.encode(), zlib.crc32(data, int(spaced)))
    if key not in _encoders:
        _encoders[key] = Encoder(data, pattern, spaced)
    return _encoders[key]


def encoded(docs: DataFrame, vocabulary: bytes, pattern: str, with_ids: bool = True, spaced: bool = True, chunk_bytes: int = _CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the bytes
    that the ids give back), and with_ids the ids themselves. For ``spaced`` see :class:`Encoder`; words of ``chunk_bytes`` of
    text are merged together: more takes less time and more memory.

    Null texts are empty: no ids. Every row of ``docs`` gives one row, repeated ids and texts too; extra
    columns are ignored; an empty table gives no rows. Texts are encoded whole, whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def rows(keys: pa.Array, part: Encoded) -> Iterator[pa.RecordBatch]:
        words = part.joined()
        for a, b in part.spans():
            in_ids, in_bytes = part.digests(words, a, b)
            bounds = _offsets(part.text_ends)[a : b + 1]
            columns = [keys.slice(a, b - a), pa.array(np.diff(bounds)), pa.array(in_ids), pa.array(in_bytes)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(part.flat(a, b))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern, spaced)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = pc.binary_length(texts).to_pylist()
            for a, b in pieces(batch, sizes, chunk_bytes):
                for some, part in own.encode(texts.slice(a, b - a)):
                    yield from rows(batch.column(0).slice(a, b - a).take(pa.array(some)), part)
                    del part
                pa.default_memory_pool().release_unused()  # a worker keeps what one chunk took, beside the JVM's heap

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)
