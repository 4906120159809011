"""Language-model scoring: unigram counts of the corpus, and online logistic context mixing over the bits of words.

A text is its folded words, each ended by a space, and then a line feed. Each byte is a walk down a binary tree; at each
turn several predictors, chosen by hashed contexts, say how likely a 1 is, and weights mix what they say in the logistic
domain. Three things are learned from the training texts: the words' counts, the predictors' counts and the weights that
every stretch of text starts from. While a stretch is scored its weights go on learning, and so does one more predictor
that knows only the stretch.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.common import column_of, fold, pieces
from lociq.scratch import stored

FOLDS, HELD = 7, 2
#: Corpus contexts: the word's last 2, 3 and 4 bytes, and the word so far. Logarithms of the first three tables; the
#: last one grows with the distinct words, up to MOST_LOG (2 bytes a state in every worker).
SLOTS_LOG = (17, 20, 22)
LEAST_LOG, MOST_LOG, STATES_A_WORD = 18, 26, 4
CONTEXTS, GATES = 4, 8
_SEGMENT = 1 << 17  # states that travel together when counts are summed
_HELD_PLACES = 2_000_000  # partial counts that a task holds before it passes them on
_DICTIONARY_BYTES = 32 << 20  # text that shares one dictionary of words
_SCORED_BYTES = 3 << 20  # text scored in lockstep
STRETCH_WORDS = 512  # after so many words a text's own learning starts anew, so that long texts are scored in parallel
OWN_LOG = 10  # states of a stretch's own predictor, by the last 2 bytes
RATE, OWN_RATE = 0.005, 0.1
_PRIOR = .3  # added to both counts of a predictor
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))

#: A state holds two counts, a byte each: exact to 15, then in steps of a twelfth of an octave.
_LEVELS = np.array([n if n < 16 else 16 * 2 ** ((n - 16) / 12) for n in range(256)])


def quantised(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(_LEVELS, counts, side="right") - 1).astype(np.uint16)


def _looked_up(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """For counts: the stretched probability of a 1 (ten fractional bits), then a bit that tells a state seen often."""
    stretched = np.log((ones + _PRIOR) / (zeros + _PRIOR)).clip(-12, 12)
    return (np.round(stretched * 1024).astype(np.int16) << 1) | (ones + zeros >= 4).astype(np.int16)


_ONES, _ZEROS = np.repeat(_LEVELS, 256), np.tile(_LEVELS, 256)
#: By state; and, for learning, by the bit that is to be predicted and state, without that very bit.
_SAYS = _looked_up(_ONES, _ZEROS)
_SAYS_WITHOUT = np.concatenate([_looked_up(_ONES, np.maximum(0, _ZEROS - 1)), _looked_up(np.maximum(0, _ONES - 1), _ZEROS)])


def folded_words(text: bytes) -> list[bytes]:
    """Words of the text with A-Z in lower case."""
    return text.translate(_FOLD).split()


@dataclass
class Code:
    """A binary tree over byte values, frequent ones near the root. For each value: the inner nodes that its
    path passes, the turns that it takes there, and how many there are."""

    nodes: np.ndarray
    turns: np.ndarray
    lengths: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    heap = [(int(n) + 1, value, value) for value, n in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    following = 256
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[following] = (a, b)
        heapq.heappush(heap, (n + m, following, following))
        following += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
    while todo:
        node, path = todo.pop()
        if node < 256:
            paths[node] = path
        else:
            todo += [(child, [*path, (node - 256, turn)]) for turn, child in enumerate(children[node])]
    longest = max(map(len, paths.values()))
    nodes, turns = np.zeros((256, longest), np.uint32), np.zeros((256, longest), np.uint8)
    for value, path in paths.items():
        nodes[value, : len(path)], turns[value, : len(path)] = zip(*path, strict=True)
    nodes = (nodes + np.uint32(1)) * np.uint32(0x85EBCA6B)  # spread over all bits, as the contexts are
    return Code(nodes, turns, np.array([len(paths[v]) for v in range(256)], dtype=np.int64))


def _contexts(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each byte of words that begin at ``starts``, a 32-bit hash of each kind of context."""
    n, sizes = len(data), np.diff(np.append(starts, len(data)))
    place = np.arange(n) - np.repeat(starts, sizes)
    wide = data.astype(np.uint32) + np.uint32(1)
    out, value = [], np.zeros(n, np.uint32)
    for back in range(1, 5):
        shifted = np.zeros(n, np.uint32)
        shifted[back:] = wide[:-back]
        value = value * np.uint32(0x2F0B4C47) + np.where(place >= back, shifted, 0).astype(np.uint32)
        if back > 1:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append(mixed ^ (mixed >> np.uint32(13)))
    # Hash of the word so far: prefix sums of bytes times powers of an inverse, in arithmetic modulo 2**64.
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _MULTIPLIER, np.uint64))])
    inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(wide.astype(np.uint64) * inverses[:n], dtype=np.uint64)])
    begins = np.repeat(starts, sizes)
    # Times the power of the place in the word, so that a word's hash is the same wherever it stands.
    word = (sums[:n] - sums[begins]) * powers[begins] * powers[place]
    word = (word ^ (word >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    out.append((word >> np.uint64(32)).astype(np.uint32))
    return out


def first_slots(logs: tuple[int, ...]) -> list[int]:
    """Where the states of each kind begin in the one table, and where they all end."""
    return [sum(1 << x for x in logs[:k]) for k in range(CONTEXTS + 1)]


@dataclass
class Bits:
    """The decisions of some words, one word after the other: where each word's end, the turns taken, the slots of the
    corpus states (one row for each kind) and of a stretch's own state."""

    ends: np.ndarray
    turns: np.ndarray
    slots: list[np.ndarray]
    own: np.ndarray


def decisions(words: list[bytes], code: Code, logs: tuple[int, ...]) -> Bits:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data, byte_ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
    contexts = _contexts(data, byte_ends - sizes)
    lengths = code.lengths[data]
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) - np.repeat((ends - lengths).astype(np.int32), lengths)
    at += np.repeat(data.astype(np.int32) * code.nodes.shape[1], lengths)
    node = code.nodes.reshape(-1)[at]
    slots = []
    for context, log, first in zip(contexts, logs, first_slots(logs), strict=False):
        mixed = (np.repeat(context, lengths) ^ node) * np.uint32(0x9E3779B1)
        slots.append((mixed >> np.uint32(32 - log)) + np.uint32(first))
    own = ((np.repeat(contexts[0], lengths) ^ node) * np.uint32(0x9E3779B1) >> np.uint32(32 - OWN_LOG)).astype(np.int32)
    return Bits(np.concatenate([[0], ends])[byte_ends], code.turns.reshape(-1)[at], slots, own)


def _gate(said: list[np.ndarray]) -> np.ndarray:
    return (said[1] & 1) + 2 * (said[2] & 1) + 4 * (said[3] & 1)


@dataclass
class Words:
    """What is the same wherever a word stands: where its bits end, and for each bit the gated mix of what the corpus
    says (its sign: whether that is right) and the slot of a stretch's own state (its highest bit: the turn taken)."""

    ends: np.ndarray
    mixed: np.ndarray
    own: np.ndarray


@dataclass
class Mixer:
    """What the corpus has taught: the tree of byte values, the states, and the weights of the predictors by gate (which
    of the last three contexts have been seen often: 1, 2, 4).

    ``states`` are pairs of counts while weights are learned; :meth:`ready` turns them into what they say.
    """

    code: Code
    states: np.ndarray
    logs: tuple[int, ...]
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, CONTEXTS), 0.3))

    def ready(self) -> Mixer:
        return Mixer(self.code, _SAYS[self.states], self.logs, self.weights)

    def words(self, words: list[bytes]) -> Words:
        """Words, each with its ending byte, made ready for :meth:`score`."""
        n_bits = int(self.code.lengths[np.frombuffer(b"".join(words), np.uint8)].sum())
        out = Words(np.empty(len(words), np.int64), np.empty(n_bits, np.int16), np.empty(n_bits, np.uint16))
        weights, before = self.weights.astype(np.float32), 0
        for a in range(0, len(words), 10_000):
            bits = decisions(words[a : a + 10_000], self.code, self.logs)
            said = [self.states[slots] for slots in bits.slots]
            gate = _gate(said)
            mixed = sum(weights[:, k][gate] * (x >> 1) for k, x in enumerate(said))
            upto = before + len(mixed)
            out.ends[a : a + 10_000] = bits.ends + before
            out.mixed[before:upto] = np.round(np.where(bits.turns, mixed, -mixed)).clip(-32_000, 32_000)
            out.own[before:upto] = bits.own.astype(np.uint16) | (bits.turns.astype(np.uint16) << 15)
            before = upto
        return out

    @staticmethod
    def score(words: Words, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each text (numbers of its words in ``words``).

        Texts are dealt into stretches of STRETCH_WORDS words; all stretches advance in lockstep, a word a step. Each
        bit's gated mix and what the stretch's own predictor says are mixed once more, by two weights of the stretch
        (1 and 0 at first); after each word, weights and own states learn from its bits.
        """
        sizes = np.diff(np.concatenate([[0], words.ends]))
        firsts = words.ends - sizes
        cut = [(i, t[a : a + STRETCH_WORDS]) for i, t in enumerate(texts) for a in range(0, len(t), STRETCH_WORDS)]
        cut.sort(key=lambda x: -len(x[1]))
        counts = np.array([len(x[1]) for x in cut], np.int64)
        # Word by word: those of the first step of all stretches, then of the second.
        flat = np.concatenate([x[1] for x in cut] or [np.zeros(0, np.int64)])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = flat[np.argsort(step, kind="stable")]
        n = len(cut)
        corpus, mine = np.ones(n, np.float32), np.zeros(n, np.float32)
        own, total = np.zeros(n << OWN_LOG, np.float32), np.zeros(n)
        base, at = np.arange(n, dtype=np.int32) << OWN_LOG, 0
        for active in np.bincount(step, minlength=1).tolist():
            if not active:
                break
            word = flat[at : at + active]
            at += active
            size = sizes[word]
            upto = np.cumsum(size)
            begins = upto - size
            place = np.repeat(firsts[word] - begins, size) + np.arange(int(upto[-1]))
            mixed, slot = words.mixed[place].astype(np.float32), words.own[place]
            mixed *= np.float32(1 / 1024)
            sign = (slot >> 15).astype(np.float32) * 2 - 1
            slot = (slot & np.uint16((1 << OWN_LOG) - 1)) + np.repeat(base[:active], size)
            state = own[slot]
            said = sign * state
            surprise = np.exp(-(np.repeat(corpus[:active], size) * mixed + np.repeat(mine[:active], size) * said).clip(-30, 30))
            surprise += 1
            total[:active] -= np.add.reduceat(np.log(surprise), begins)
            miss = 1 - 1 / surprise
            corpus[:active] += RATE * np.add.reduceat(miss * mixed, begins)
            mine[:active] += RATE * np.add.reduceat(miss * said, begins)
            own[slot] = state + np.float32(OWN_RATE) * (4 * sign - state)  # of repeated slots in a word the last counts
        out = np.zeros(len(texts))
        np.add.at(out, [i for i, _ in cut], total)
        return out / np.log(10)


def _in_batches(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words with their ending byte, and their counts in the training texts."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            part = batch.slice(a, most)
            yield [w + b" " for w in part.column(0).to_pylist()], part.column(1).to_numpy()


_COUNT_BITS = 36  # of a number that holds a place and a count; states tell apart far smaller counts only


def _summed(packed: np.ndarray) -> np.ndarray:
    """Numbers of distinct places in ascending order, with the sums of their counts."""
    packed = np.sort(packed)
    places, counts = packed >> np.uint64(_COUNT_BITS), packed & np.uint64((1 << _COUNT_BITS) - 1)
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    sums = np.minimum(np.add.reduceat(counts, first), np.uint64(1 << _COUNT_BITS - 8))
    return (places[first] << np.uint64(_COUNT_BITS)) | sums


def _trained(words: DataFrame, n_texts: int, n_words: int) -> Mixer:
    """From the distinct training words (word, total): byte values, then the states' counts, then the weights. What
    reaches the driver and every worker is one table of states, whose size follows the number of distinct words."""
    spark = words.sparkSession

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256)
        for some, n in _in_batches(batches):
            counts += np.bincount(np.frombuffer(b"".join(some), np.uint8), np.repeat(n, [len(w) for w in some]), 256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(counts.astype(np.int64))], names=["value", "n"])

    counts = np.zeros(256, np.int64)
    for r in words.mapInArrow(values, "value int, n long").groupBy("value").agg(F.sum("n").alias("n")).collect():
        counts[r["value"]] = r["n"]
    counts[10] += n_texts
    log = min(MOST_LOG, max(LEAST_LOG, int(np.ceil(np.log2(STATES_A_WORD * max(1, n_words))))))
    shared, logs = spark.sparkContext.broadcast(huffman(counts)), (*SLOTS_LOG, log)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial counts: for each stretch of the table, places in it (slot and bit) and how often."""
        held: list[np.ndarray] = []
        for some, n in _in_batches(batches, 10_000):
            bits = decisions(some, shared.value, logs)
            times = np.repeat(np.minimum(n, 1 << _COUNT_BITS - 8), np.diff(np.concatenate([[0], bits.ends]))).astype(np.uint64)
            for slots in bits.slots:
                held.append(_summed(((slots.astype(np.uint64) * np.uint64(2) + bits.turns) << np.uint64(_COUNT_BITS)) | times))
            if sum(map(len, held)) > _HELD_PLACES:
                yield from segments(_summed(np.concatenate(held)))
                held = []
        if held:
            yield from segments(_summed(np.concatenate(held)))

    def segments(packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, n = packed >> np.uint64(_COUNT_BITS), packed & np.uint64((1 << _COUNT_BITS) - 1)
        cuts = np.searchsorted(keys, np.arange(0, int(keys[-1]) + 2 * _SEGMENT + 1, 2 * _SEGMENT, dtype=np.uint64))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                gaps = np.diff(keys[a:b], prepend=np.uint64(i * 2 * _SEGMENT)).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(gaps.tobytes(), 1)]), pa.array([zlib.compress(n[a:b].astype("<u8").tobytes(), 1)])], names=["segment", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, places, n in zip(*(column_of(batch, c) for c in ("segment", "places", "counts")), strict=True):
                if segment not in sums:
                    sums[segment] = np.zeros(2 * _SEGMENT, np.int64)
                sums[segment][np.cumsum(np.frombuffer(zlib.decompress(places), "<u4"))] += np.frombuffer(zlib.decompress(n), "<i8")
        for segment, found in sums.items():
            zeros, ones = found.reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([((quantised(ones) << 8) | quantised(zeros)).astype("<u2").tobytes()])], names=["segment", "states"])

    partial = words.mapInArrow(count, "segment int, places binary, counts binary")
    summed = stored(partial.repartition("segment").mapInArrow(add, "segment int, states binary"), "lm-states")
    states = np.zeros((-(-first_slots(logs)[-1] // _SEGMENT), _SEGMENT), np.uint16)
    for r in summed.toLocalIterator():
        states[r["segment"]] = np.frombuffer(r["states"], "<u2")
    mixer = Mixer(shared.value, states.reshape(-1), logs)
    if n_words:
        table = spark.sparkContext.broadcast(mixer)
        for _ in range(2):
            mixer.weights = _newton(words, table, mixer.weights)
        table.destroy()
    return mixer.ready()


def _newton(words: DataFrame, table, weights: np.ndarray) -> np.ndarray:
    """One step of Newton's method on all training words' bits, each predicted as if it had not been counted."""

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((GATES, CONTEXTS, CONTEXTS + 1))
        for some, n in _in_batches(batches, 10_000):
            bits = decisions(some, table.value.code, table.value.logs)
            turn = bits.turns.astype(np.int32) << 16
            said = [_SAYS_WITHOUT[turn | table.value.states[slots]] for slots in bits.slots]
            gates = _gate(said)
            times = np.repeat(n, np.diff(np.concatenate([[0], bits.ends]))).astype(np.float32)
            x = np.stack([(k >> 1) for k in said], axis=1).astype(np.float32) / 1024
            for g in range(GATES):
                here = np.flatnonzero(gates == g)
                own, many = x[here], times[here]
                p = 1 / (1 + np.exp(-(own @ weights[g].astype(np.float32))))
                sums[g, :, :CONTEXTS] += (own * (many * p * (1 - p))[:, None]).T @ own
                sums[g, :, CONTEXTS] += own.T @ (many * (bits.turns[here] - p))
        yield pa.RecordBatch.from_arrays([pa.array(range(sums.size), pa.int32()), pa.array(sums.reshape(-1))], names=["place", "value"])

    sums = np.zeros(GATES * CONTEXTS * (CONTEXTS + 1))
    for r in words.mapInArrow(gradients, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        sums[r["place"]] = r["value"]
    sums = sums.reshape(GATES, CONTEXTS, CONTEXTS + 1)
    steps = [np.linalg.solve(s[:, :CONTEXTS] + np.eye(CONTEXTS), s[:, CONTEXTS]) for s in sums]
    return np.round((weights + np.clip(steps, -1, 1)) * 4096) / 4096  # the sum's order must not show


_ROWS = "chunk long, code int, word binary, n_train long, doc_id long, held_out boolean, codes binary"


def _read(docs: DataFrame) -> DataFrame:
    """One pass over all texts: a row for each text (its words as codes of its chunk) and one for each distinct word of
    each chunk (its count in training texts)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = pyspark.TaskContext.get().partitionId() << 32
        kinds = dict(chunk=pa.int64(), code=pa.int32(), word=pa.binary(), n_train=pa.int64(), doc_id=pa.int64(), held_out=pa.bool_(), codes=pa.binary())

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[k], kind) if k in columns else pa.nulls(n, kind) for k, kind in kinds.items()], names=list(kinds))

        for batch in batches:
            keys, held, column = column_of(batch, "doc_id"), column_of(batch, "held_out"), pc.fill_null(batch.column(2), "")
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
            for a, b in pieces(batch, np.diff(at).tolist(), _DICTIONARY_BYTES):
                folded = memoryview(column.buffers()[2] or b"")[at[a] : at[b]].tobytes().translate(_FOLD)
                texts = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at[a : b + 1] - at[a]).astype(np.int32)), pa.py_buffer(folded)])
                split = pc.split_pattern(texts, b" ")
                words = split.flatten()
                filled = pc.greater(pc.binary_length(words), 0)
                ends = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])[np.cumsum(pc.list_value_length(split).to_numpy())]
                coded = words.filter(filled).dictionary_encode()
                codes, names = coded.indices.to_numpy(), coded.dictionary
                trains = np.repeat(~np.array(held[a:b], bool), np.diff(np.concatenate([[0], ends])))
                n_train = np.bincount(codes[trains], minlength=len(names))
                own = np.split(codes.astype("<i4"), ends[:-1])
                del texts, folded, split, words, filled, coded, codes
                yield rows(b - a, chunk=[chunk] * (b - a), doc_id=keys[a:b], held_out=held[a:b], codes=[c.tobytes() for c in own])
                for i in range(0, len(names), 50_000):
                    part = names.slice(i, 50_000)
                    yield rows(len(part), chunk=[chunk] * len(part), code=range(i, i + len(part)), word=part, n_train=n_train[i : i + len(part)])
                chunk += 1

    return docs.select("doc_id", "held_out", "text").mapInArrow(read, _ROWS)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram, add one), score (the mixer's log10
    probability of the words and the end) and bits_per_byte (of the mixer).

    Learns from the texts whose fold is not HELD; scores all. Null texts are empty: one token, the end. Every row of
    ``docs`` gives one row, repeated ids too; a null doc_id counts as an empty text in the fold. Extra columns are
    ignored. Without training texts all counts are 0 and the mixer starts from the same chance for every bit.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "text")
    rows = stored(_read(slim), "lm-rows")
    texts = rows.filter("codes IS NOT NULL")
    # Each chunk has a word once, so a word has a row for each chunk at most: its total over all, and in one of them a mark.
    by_word = Window.partitionBy("word")
    words = rows.filter("word IS NOT NULL").select("chunk", "code", "word", F.sum("n_train").over(by_word).alias("total"), F.min("chunk").over(by_word).alias("least"))
    words = stored(words.select("chunk", "code", "word", "total", (F.col("least") == F.col("chunk")).alias("marked")), "lm-words")
    training = stored(words.filter("marked AND total > 0").select("word", "total"), "lm-training")
    of_words = training.agg(F.sum("total").alias("n"), F.count("*").alias("v")).first()
    ends = texts.filter("NOT held_out").count()
    n, v = (of_words["n"] or 0) + ends, of_words["v"] + (1 if ends else 0)
    shared = docs.sparkSession.sparkContext.broadcast(_trained(training, ends, of_words["v"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, found = None, []
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)] if len(chunks) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if chunks[a] != chunk:
                    chunk, found, logs, ready = chunks[a], [], None, None
                of_word = part.filter(pc.is_valid(part.column(1)))
                if len(of_word):  # they come first, in the order of their codes
                    found.append(of_word.select(["word", "total"]))
                    logs = ready = None
                own = part.slice(len(of_word))
                if not len(own):
                    continue
                if logs is None:
                    table = pa.Table.from_batches(found) if found else None
                    total = table.column(1).to_numpy() if found else np.zeros(0, np.int64)
                    names = table.column(0).combine_chunks() if found else pa.array([], pa.binary())
                    logs, known = np.log10((total + 1) / (n + v + 1)), total > 0
                    sizes = pc.binary_length(names).to_numpy().astype(np.int64)
                    ready = shared.value.words([*(w + b" " for w in names.to_pylist()), b"\n"])
                end = np.log10((ends + 1) / (n + v + 1))
                codes = [np.frombuffer(c, "<i4") for c in own.column(5).to_pylist()]
                n_bytes = np.array([len(c) + int(sizes[c].sum()) + 1 for c in codes])
                for c, d in pieces(own, n_bytes.tolist(), _SCORED_BYTES):
                    some = codes[c:d]
                    scores = shared.value.score(ready, [np.append(x, len(sizes)) for x in some])
                    yield pa.RecordBatch.from_arrays([
                        own.column(3).slice(c, d - c), own.column(4).slice(c, d - c), pa.array([len(x) + 1 for x in some], pa.int64()), pa.array([int(known[x].sum()) + (ends > 0) for x in some], pa.int64()),
                        pa.array([n] * len(some), pa.int64()), pa.array([float(logs[x].sum() + end) for x in some], pa.float64()), pa.array(scores), pa.array(n_bytes[c:d]),
                    ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    none = lambda kind: F.lit(None).cast(kind)
    both = words.select("chunk", "code", "total", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("binary").alias("codes"), "word")
    both = both.unionByName(texts.select("chunk", "code", none("long").alias("total"), "doc_id", "held_out", "codes", none("binary").alias("word")))
    order = both.repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_last("code"))
    out = order.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    return out.withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).drop("n_bytes")
