"""Collocations by Toivonen's method: a sample proposes frequent phrases, a full pass counts these and their border."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import column_of, texts_of
from lociq.operators.ordering import numbered
from lociq.scratch import stored

MOST_WORDS = 5
LEAST = 100  # occurrences of a candidate
RATE = 8  # one piece (or stretch of a long one) in so many is in the sample
BEST = 2_000  # phrases returned for each language
_CHUNK_BYTES = 6 << 20  # text counted together in a task; a longer text is cut at pieces
_PER_PHRASE, _MOST_BITS = 16, 1 << 29  # bits of a filter for each phrase, and at most (64 MB)
_BYTES_PER_BUCKET = 16  # of text; there are at most _MOST_BITS buckets
_PIECE = 1 << 16  # buckets that are summed up together
_MOST_LANGS = 10_000  # languages whose totals are broadcast
_BREAK = b"\xff"  # stands in no UTF-8 text
_FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))
_SPAN = re.compile(rb"[^\xff]{1,100}[^ \xff]*")  # a piece, or so much of a long one
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words but the last and that of the last."""
    h = (before ^ (before >> np.uint64(32))) * _ODD + word
    return (h ^ (h >> np.uint64(29))) * _MIX


class Filter:
    """A set of phrases by their hashes, in a bitmap: has all of them, and about one in a hundred others (more, once the
    set outgrows the largest bitmap). Others only cost work: what is counted because of them is counted exactly."""

    def __init__(self, size: int) -> None:
        self.bits = 1 << 15
        while self.bits < min(_MOST_BITS, size * _PER_PHRASE):
            self.bits *= 2
        self.bytes = np.zeros(self.bits // 8, np.uint8)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.bits - 1)
        return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(33)) & mask).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes)
        at = lambda p: (self.bytes[p >> 3] >> (p & 7).astype(np.uint8)) & 1
        return (at(a) & at(b)).astype(bool)

    @classmethod
    def of(cls, phrases: DataFrame, size: int) -> Filter:
        """Of ``size`` rows (lang, phrase). The bitmap comes to the driver in pieces of 4 kB, put together by Spark."""
        out = cls(size)
        places = out.places

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    hashes = np.array([_hash_of(lang, phrase) for lang, phrase in zip(column_of(batch, "lang"), column_of(batch, "phrase"), strict=True)], np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places(hashes)))], names=["bit"])

        bits = phrases.select("lang", "phrase").mapInArrow(place, "bit long")
        for row in bits.groupBy((F.col("bit") / (1 << 15)).cast("long").alias("piece")).agg(F.bitmap_construct_agg(F.col("bit") % (1 << 15)).alias("map")).collect():
            out.bytes[row["piece"] << 12 : (row["piece"] + 1) << 12] = np.frombuffer(row["map"], np.uint8)
        return out


class Buckets:
    """Occurrences of phrases summed by hash (Park, Chen and Yu): a phrase that stands ``least`` times is in a bucket with as many.
    A bitmap has these buckets; phrases in others need no count of their own."""

    def __init__(self, text_bytes: int, least: int) -> None:
        self.log, self.least = 16, least
        while 1 << self.log < min(_MOST_BITS, text_bytes // _BYTES_PER_BUCKET):
            self.log += 1
        self.bytes = np.zeros((1 << self.log) // 8, np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.log)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return ((self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    def tally(self, hashes: np.ndarray, often: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows (piece, at, n): of each piece, the places in it (two bytes each) and their occurrences (four), ``least`` at most."""
        if not len(hashes):
            return
        places = self.places(hashes)
        order = np.argsort(places)
        places = places[order]
        first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        often, places = np.minimum(np.add.reduceat(often[order], first), min(self.least, (1 << 32) - 1)), places[first]
        pieces = places // _PIECE
        cuts = np.flatnonzero(np.append(True, pieces[1:] != pieces[:-1]))
        ends = np.append(cuts, len(pieces)).astype(np.int32)
        columns = [pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends * values.itemsize), pa.py_buffer(values)]) for values in ((places % _PIECE).astype("<u2"), often.astype("<u4"))]
        yield pa.RecordBatch.from_arrays([pa.array(pieces[cuts], pa.int32()), *columns], names=["piece", "at", "n"])

    def filled(self, texts: DataFrame, lengths: range, known: Filter) -> Buckets:
        """Sums of all ``texts``. What tasks send is about two bytes for each phrase of a chunk; each piece of the bitmap (8 kB) is one row."""
        least = self.least

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            piece, sums = -1, np.zeros(_PIECE, np.int64)

            def done() -> Iterator[pa.RecordBatch]:
                if (enough := sums >= least).any():
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "map": pa.array([np.packbits(enough, bitorder="little").tobytes()], pa.binary())})

            for batch in batches:
                for own, at, n in zip(*(batch.column(i) for i in range(3)), strict=True):
                    if own.as_py() != piece:
                        yield from done()
                        piece, sums[:] = own.as_py(), 0
                    sums[np.frombuffer(at.as_py(), "<u2")] += np.frombuffer(n.as_py(), "<u4")
            yield from done()

        rows = texts.select("lang", "text").mapInArrow(_counter(lengths, known, None, self, True), "piece int, at binary, n binary")
        for row in rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece int, map binary").collect():
            self.bytes[row["piece"] * _PIECE // 8 : (row["piece"] + 1) * _PIECE // 8] = np.frombuffer(row["map"], np.uint8)
        return self


class _Codes(dict):
    """Numbers words as they come; 0 is the break between pieces."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _hash_of(lang: str, phrase: str) -> np.uint64:
    hashes = _word_hashes(lang, phrase.encode().split(b" "))
    out = hashes[:1]
    for i in range(1, len(hashes)):
        out = _joined(out, hashes[i : i + 1])
    return out[0]


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """A folded text in parts of about ``most`` bytes, cut where pieces end."""
    at = 0
    while len(text) - at > most:
        end = text.find(_BREAK, at + most)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _phrases(lang: str, words: list[bytes], codes: np.ndarray, lengths: range, known: Filter | None, fresh: Filter | None) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(length, hashes, codes of the first, second, ... word, occurrences) of the distinct phrases to count in ``codes``, which has 0
    where pieces end. Of more than one word are counted those whose words but the last, and but the first, are ``known``; with
    ``fresh`` only where one of the two is in that, or is counted itself, which then makes it known."""
    hashes = _word_hashes(lang, words)
    ids, columns, often = codes.astype(np.int64), [np.arange(len(hashes))], np.bincount(codes, minlength=len(hashes))
    firsts, wanted = hashes, None
    for length in range(1, lengths.stop):
        if length > 1:
            if known is None or not len(firsts):
                return
            is_known = known.has(firsts) if wanted is None else known.has(firsts) | wanted
            if length == 2:
                is_known[0] = False
            is_fresh = None if fresh is None else fresh.has(firsts) & is_known if wanted is None else fresh.has(firsts) | wanted
            good = np.append(is_known, False)[ids]
            at = np.flatnonzero(good[:-1] & good[1:])
            keys, inverse, often = np.unique(ids[at] * len(firsts) + ids[at + 1], return_inverse=True, return_counts=True)
            before, after = keys // max(1, len(firsts)), keys % max(1, len(firsts))
            last = columns[-1][after]
            columns = [c[before] for c in columns] + [last]
            wanted = None if is_fresh is None else is_fresh[before] | is_fresh[after]
            firsts = _joined(firsts[before], hashes[last])
            ids = np.full(len(ids) - 1, len(keys), np.int64)
            ids[at] = inverse
        if length in lengths:
            pick = np.arange(1, len(often)) if length == 1 else np.arange(len(often)) if wanted is None else np.flatnonzero(wanted)
            if len(pick):
                yield length, firsts[pick], [c[pick] for c in columns], often[pick]


def _counter(lengths: range, known: Filter | None, fresh: Filter | None, buckets: Buckets | None = None, tally: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts phrases in chunks of text; rows (key, n) whose key is language, tab, phrase (words have no tab). That of an empty
    phrase has the number of words. With ``buckets`` only phrases in these; to ``tally`` gives all phrases' sums by bucket instead."""

    def flush(held: dict[str, tuple[_Codes, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, (known_words, parts) in held.items():
            words, codes = list(known_words), np.concatenate(parts)
            names = pa.array(words[1:], pa.binary()).cast(pa.string())
            names = pa.concat_arrays([pa.array([""]), names])
            parts.clear()
            head = pa.scalar(f"{lang}\t")
            if 1 in lengths:
                yield pa.RecordBatch.from_arrays([pa.array([f"{lang}\t"]), pa.array([int((codes > 0).sum())], pa.int64())], names=["key", "n"])
            for _, hashes, columns, often in _phrases(lang, words, codes, lengths, known, fresh):
                if buckets is not None:
                    pick = np.flatnonzero(buckets.has(hashes))
                    columns, often = [c[pick] for c in columns], often[pick]
                for a in range(0, len(often), 100_000):
                    phrase = pc.binary_join_element_wise(*[names.take(pa.array(c[a : a + 100_000])) for c in columns], " ")
                    yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(head, phrase, ""), pa.array(often[a : a + 100_000].astype(np.int64))], names=["key", "n"])

    def tallies(held: dict[str, tuple[_Codes, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        found = [(hashes, often) for lang, (words, parts) in held.items() for _, hashes, _, often in _phrases(lang, list(words), np.concatenate(parts), lengths, known, fresh)]
        if found:
            yield from buckets.tally(*map(np.concatenate, zip(*found, strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = tallies if tally else flush
        held: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        size = 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            for lang, text in zip(column_of(batch, "lang"), texts, strict=True):
                for part in _cut((text.as_py() or b"").translate(_FOLD), _CHUNK_BYTES):
                    if lang not in held:
                        held[lang] = (_Codes(), [])
                    words, parts = held[lang]
                    parts.append(words.of((part + _BREAK).replace(_BREAK, b" \xff ").split()))
                    size += len(part)
                    if size >= _CHUNK_BYTES:
                        yield from send(held)
                        held, size = {}, 0
                        pa.default_memory_pool().release_unused()
        yield from send(held)

    return count


def _counted(texts: DataFrame, lengths: range, known: Filter | None = None, fresh: Filter | None = None, buckets: Buckets | None = None) -> DataFrame:
    """(lang, words, phrase, n) of what is counted in all ``texts``; 0 words: the number of words."""
    rows = texts.select("lang", "text").mapInArrow(_counter(lengths, known, fresh, buckets), "key string, n long")
    counts = rows.groupBy("key").agg(F.sum("n").alias("n"))  # one short column is sent, not three
    phrase = F.substring_index("key", "\t", -1)
    lang = F.left("key", F.length("key") - F.length(phrase) - 1)
    words = F.when(phrase == "", 0).otherwise(F.regexp_count(phrase, F.lit(" ")) + 1)
    return counts.select(lang.alias("lang"), words.alias("words"), phrase.alias("phrase"), "n")


def _sample(texts: DataFrame, rate: int) -> DataFrame:
    """(lang, text) with every ``rate``-th piece of each text, or stretch of a long piece, from a first one that doc_id and text decide:
    the same ones in every run. Even a phrase that stands in one text alone is met in its share of places."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(column_of(batch, "doc_id"), texts_of(batch), strict=True):
                pieces = _SPAN.findall(text.translate(_FOLD))
                first = xxhash.xxh3_64_intdigest(text, xxhash.xxh3_64_intdigest(str(key).encode())) % rate
                out.append(b"\n".join(pieces[first::rate]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("lang")), pa.array(out)], names=["lang", "text"])

    return texts.mapInArrow(choose, "lang string, text string")


def proposed(texts: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, rate: int = RATE) -> tuple[DataFrame, int, int]:
    """(lang, words, phrase), how many, and about how many bytes all texts have: what is frequent in a sample of one piece in ``rate``, at a threshold one standard deviation below
    the expected one: in a large corpus some frequent phrase is always missed, and those few cost the second pass little, while every
    phrase proposed for nothing has a border in the first. Level by level: a phrase is counted if what it begins and ends with is proposed."""
    share = least / rate
    threshold = max(1, int(share - share**0.5))
    sample = stored(_sample(texts, rate), "phrase-sample")
    found: DataFrame | None = None
    size = 0
    for length in range(1, most_words):  # what has most_words words is a border's member at most
        level = stored(_counted(sample, range(length, length + 1), Filter.of(found, size) if size else None).filter((F.col("words") == length) & (F.col("n") >= threshold)).select("lang", "words", "phrase"), "phrase-level")
        found = level if found is None else found.unionByName(level)
        n = level.count()
        if not n:
            break
        size += n
    sampled = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return found, size, rate * sampled


def frequent(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, rate: int = RATE) -> DataFrame:
    """(lang, words, phrase, n) of every phrase of up to ``most_words`` words with at least ``least`` occurrences, exactly, and a
    row of 0 words with each language's number of words. Does not depend on what the sample proposes.

    One pass over all texts takes every word, and every longer phrase whose beginning and end (without its last, its first
    word) are proposed: those are the proposed phrases and their negative border, the least phrases that were not proposed. It
    only sums them by hash, as most of the border is rare; the next pass counts those in buckets with ``least`` occurrences.
    If one of the border is frequent, what begins or ends with it is still uncounted: another pass counts that, and what begins or ends
    with what it counts, up to ``most_words``. The beginning and the end of a frequent phrase are frequent, so that closes it: a frequent
    phrase that the first pass did not count has a failed one within it, and all between the two are counted in the second.
    """
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    known, size, text_bytes = proposed(texts, least, most_words, rate)
    enough = (F.col("words") == 0) | (F.col("n") >= least)
    lengths, begun = range(1, most_words + 1), Filter.of(known, size)
    often = Buckets(text_bytes, least).filled(texts, lengths, begun)
    counts = stored(_counted(texts, lengths, begun, buckets=often).filter(enough), "phrase-counts")
    failed = stored(counts.filter(F.col("words").between(1, most_words - 1)).select("lang", "words", "phrase").join(known, ["lang", "words", "phrase"], "left_anti"), "phrase-border")
    n = failed.count()
    if not n:
        return counts
    more = _counted(texts, range(2, most_words + 1), Filter.of(known.unionByName(failed), size + n), Filter.of(failed, n)).filter(F.col("n") >= least)
    return counts.unionByName(stored(more.join(counts, ["lang", "words", "phrase"], "left_anti"), "phrase-counts"))


def _whole(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def mined(docs: DataFrame, least: int = LEAST, best: int = BEST, most_words: int = MOST_WORDS, rate: int = RATE) -> DataFrame:
    """The ``best`` collocations of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z only), split at ``.,;:!?`` and line ends into pieces, and these at spaces and tabs into words. A
    candidate is a phrase of 2 to ``most_words`` words that stands at least ``least`` times (a) within pieces of its language's texts. Cut after
    its first k words, its parts stand l and r times; of n words in all this scores floor(1000 a n / (l r)), and the cut of lowest
    score counts, the smallest k of equals. Candidates inside a longer one that stands as often are dropped. The rank is by score,
    then a (both falling), then phrase.

    A null text is empty, a null lang is ``und``; copies count each; doc_id only draws the sample and may be null or repeated.
    Extra columns are ignored. Texts without such phrases, and no texts, give no rows.

    What a longer phrase drops can be told from phrases of one word more: any longer one that stands as often
    holds one of these, which stands as often too. Numbers are whole throughout, products have up to 38 digits.
    """
    counts = frequent(docs, least, most_words, rate)
    candidates = counts.filter("words >= 2").select("lang", "words", F.col("phrase"), F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    total = counts.filter("words = 0").select("lang", "n")
    if total.limit(_MOST_LANGS + 1).count() <= _MOST_LANGS:
        total = F.broadcast(total)  # else joined
    part = lambda first, n: F.concat_ws(" ", F.slice("w", first, n))
    inside = candidates.filter("words > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    over = inside.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = candidates.join(over, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (F.col("above") < F.col("a"))).drop("above")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    single = counts.filter("words > 0")
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(single.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"]).join(total, "lang")
    cuts = cuts.withColumn("above", _whole(F.col("a")) * 1000 * _whole(F.col("n"))).withColumn("below", _whole(F.col("l")) * _whole(F.col("r"))).withColumn("score", F.expr("above div below"))
    least_cut = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", (-F.col("cut.score")).alias("by_score"), (-F.col("a")).alias("by_a"))
    ranked = numbered(scored, ["by_score", "by_a", "phrase"], ["lang"]).filter(F.col("place") < best)
    return ranked.select("lang", (F.col("place") + 1).cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The default parameters over the view documents.
ORACLE = """
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\\n\\x0B\\x0C\\r]')), '[^ \\t]+') AS w FROM docs),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
totals AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
spans AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM starts, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, m, phrase, count(*) AS a FROM spans GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM counts WHERE m >= 2),
rated AS (SELECT c.lang, c.m, c.phrase, c.a, k, h.a AS l, t.a AS r, totals.n, (1000::HUGEINT * c.a * n) // (h.a::HUGEINT * t.a) AS score FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(w[1 : k], ' ')
    JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(w[k + 1 :], ' ') JOIN totals ON totals.lang = c.lang),
lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM lowest p WHERE NOT EXISTS (SELECT 1 FROM counts q WHERE q.lang = p.lang AND q.m > p.m AND q.a >= p.a AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
