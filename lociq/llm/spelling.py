"""Spelling variants: words one edit apart, by search schemes in FM-indexes of the words read from either end."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import column_of, texts_of
from lociq.scratch import stored

SHORTEST, LEAST, EVERY = 5, 3, 97  # code points of a word, occurrences, and which runs are misspelt on purpose
HOT_ROWS = 50_000  # words dealt to one key above which the key is split
INDEX_ROWS = 50_000  # words in one index, about
_HELD_WORDS = 400_000  # distinct words counted together in a task
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def counted(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word, n): the runs of letters of all texts, lower-cased (A-Z only), and how often they stand in them.

    Of a run whose unsigned crc32 of ``<doc_id>:<run>`` is divisible by ``every`` the code point at crc32 modulo its length is left
    out. A null text has no runs; a null doc_id is written as nothing. Runs that become shorter than SHORTEST are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(column_of(batch, "doc_id"), texts_of(batch), strict=True):
                own = Counter(_RUN.findall(text.translate(_LOWER).decode()))
                start = zlib.crc32(("" if key is None else f"{key}").encode() + b":")
                runs = list(own)
                sums = np.fromiter((zlib.crc32(r.encode(), start) for r in runs), np.uint32, len(runs))
                for i in np.flatnonzero(sums % np.uint32(every) == 0).tolist():
                    run, at = runs[i], int(sums[i]) % len(runs[i])
                    held[run[:at] + run[at + 1 :]] += own.pop(run)
                for run, n in own.items():
                    held[run] += n
                if len(held) >= _HELD_WORDS:
                    yield flush()
                    held.clear()
        yield flush()

    rows = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return rows.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.sum("n").alias("n"))


def suffix_ranks(symbols: np.ndarray, longest: int) -> np.ndarray:
    """The order of all suffixes, by doubling; no two share over ``longest`` symbols."""
    rank, step = symbols, 1
    while True:
        rank = np.unique(rank, return_inverse=True)[1]
        if step > longest or rank.max() == len(rank) - 1:
            return np.argsort(rank)
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        rank = rank * (len(rank) + 1) + after
        step *= 2


class Index:
    """An FM-index of distinct words. The text is every word from its last letter to its first, a delimiter before each and one
    at the end, so that a step backwards in the text reads a word one letter on.

    ``words`` must be sorted by their reversed letters; delimiters then sort by where they stand, and the suffix that begins with the
    delimiter of word i has rank i + 1.
    """

    def __init__(self, words: list[str]) -> None:
        text = np.frombuffer(("\0" + "\0".join(w[::-1] for w in words) + "\0").encode("utf-32-le"), np.uint32)
        self.letters, codes = np.unique(text, return_inverse=True)
        codes = codes.astype(np.int64)  # 0 is the delimiter
        breaks = np.flatnonzero(codes == 0)
        symbols = codes + len(breaks)
        symbols[breaks] = np.append(np.arange(1, len(breaks)), 0)  # the last one is the least
        order = suffix_ranks(symbols, max(map(len, words)) + 1)
        self.before = codes[order - 1]  # the Burrows-Wheeler transform
        self.size, n = len(codes), len(self.letters)
        self.sorted = np.sort(self.before * self.size + np.arange(self.size))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n))])
        self.words = len(words)

    def codes(self, text: str) -> np.ndarray:
        letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        return np.where(self.letters[at] == letters, at, -1)

    def step(self, low: np.ndarray, high: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank intervals of what is read with one letter more."""
        at = letter * self.size
        return np.searchsorted(self.sorted, at + low), np.searchsorted(self.sorted, at + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every letter that goes on from the disjoint intervals: (number of the interval, letter, new interval)."""
        n = high - low
        which = np.repeat(np.arange(len(low)), n)
        at = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        keys, count = np.unique(which * len(self.letters) + self.before[at], return_counts=True)
        keys, count = keys[keys % len(self.letters) > 0], count[keys % len(self.letters) > 0]
        which, letter = keys // len(self.letters), keys % len(self.letters)
        start = np.searchsorted(self.sorted, letter * self.size + low[which])
        return which, letter, start, start + count


def near(index: Index, queries: list[str], longer: np.ndarray, lows: np.ndarray, highs: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word of the index): the word comes from the query by one edit at a place e, lows <= e < highs.

    If ``longer`` the edit deletes letter e; else it replaces it, or inserts one before it. Of the places where an edit gives the same word
    the last counts, so each word comes once: a letter is not inserted before its like, nor deleted before its like. The part of the
    query on one side of e is matched exactly; from there one error is tried at every place, and the rest must match exactly again, up
    to the delimiter. ``backwards``: the queries and the index are the words reversed, and reading starts at their last letter.
    """
    lengths = np.array([len(q) for q in queries])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = index.codes("\0".join(queries) + "\0")  # a delimiter, code 0, behind each
    at = lambda q, j: text[starts[q] + j]
    if backwards:  # places of letters counted from the end; an insertion before letter e comes after lengths - e letters
        first, last = lengths - highs, lengths - lows
    else:
        first, last = lows, highs
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), index.words + 1)  # the suffixes that begin with a delimiter
    alive = np.arange(len(queries))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for j in range(int(lengths.max()) + 1):
        q = alive[(j >= first[alive]) & (j <= last[alive])]
        if len(q):
            place = lengths[q] - 1 - j if backwards else np.full(len(q), j)  # of letter j
            inside = (place >= lows[q]) & (place < highs[q]) & (j < lengths[q])
            states = []
            gone = q[inside & longer[q]]
            if len(gone):
                # The next letter of the word, in the order of writing, is that before in the order of reading backwards.
                after = at(gone, j - 1) if backwards else at(gone, j + 1)
                ends = j == 0 if backwards else False
                gone = gone[(at(gone, j) != after) | ends]
                states.append((gone, np.full(len(gone), j + 1), low[gone], high[gone]))
            nodes, number = np.unique(low[q], return_inverse=True)
            ends = np.zeros(len(nodes), np.int64)
            ends[number] = high[q]
            which, letter, start, stop = index.branches(nodes, ends)
            begin, many = np.searchsorted(which, np.arange(len(nodes))), np.bincount(which, minlength=len(nodes))
            for kind in ("replaced", "inserted"):
                if kind == "replaced":
                    some, rows = q[inside & ~longer[q]], number[inside & ~longer[q]]
                else:
                    gap = lengths[q] - j if backwards else np.full(len(q), j)
                    fits = ~longer[q] & (gap >= lows[q]) & (gap < highs[q])
                    some, rows = q[fits], number[fits]
                n = many[rows]
                edge = np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                some = np.repeat(some, n)
                if kind == "inserted" and backwards:
                    unlike = (letter[edge] != at(some, j - 1)) if j else np.ones(len(some), bool)
                else:
                    unlike = letter[edge] != at(some, j)
                some, edge = some[unlike], edge[unlike]
                states.append((some, np.full(len(some), j + (kind == "replaced")), start[edge], stop[edge]))
            found.append(_finished(index, states, lengths, at))
        alive = alive[(j < lengths[alive]) & (j < last[alive])]
        low[alive], high[alive] = index.step(low[alive], high[alive], at(alive, j))
        alive = alive[low[alive] < high[alive]]
        if not len(alive):
            break
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _finished(index: Index, states: list[tuple], lengths: np.ndarray, at) -> tuple[np.ndarray, np.ndarray]:
    """Match what is left of each query after its error, then the delimiter."""
    q, j, low, high = (np.concatenate(c) for c in zip(*states, strict=True))
    ended = []
    while len(q):
        low, high = index.step(low, high, at(q, j))  # the delimiter last
        over = j == lengths[q]
        hit = low < high
        ended.append((q[over & hit], low[over & hit] - 1))
        stay = hit & ~over
        q, j, low, high = q[stay], j[stay] + 1, low[stay], high[stay]
    if not ended:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([e[0] for e in ended]), np.concatenate([e[1] for e in ended])


def _key(low: Column, high: Column) -> Column:
    """What two words share whose lengths are ``m`` or ``m`` and one more, and whose edit is at a place from low on and before high."""
    head, tail = F.substring("word", F.lit(1), low), F.right("word", F.greatest(F.col("m") - high, F.lit(0)))
    return F.concat_ws("|", F.col("m").cast("string"), low.cast("string"), high.cast("string"), head, tail)


def _dealt(words: DataFrame) -> DataFrame:
    """Rows (word, n, m, low, high, half, key): each word under the keys under which it meets its near words.

    The shorter of two near words has m letters, the edit stands in its first or its second half, and the other half is the same in
    both: it is the key. A key with over HOT_ROWS words is split in two: the edit is in the first or the second part of that half, and the
    other part belongs to the key as well. With one place left a key has no more words than there are letters and
    pairs of letters.
    """
    rows = words.withColumn("m", F.explode(F.array(F.length("word") - 1, F.length("word")))).filter(F.col("m") >= SHORTEST)
    middle = F.floor(F.col("m") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("low"), middle.alias("high"), F.lit(1).alias("half")), F.struct(middle.alias("low"), (F.col("m") + 1).alias("high"), F.lit(0).alias("half")))
    rows = rows.withColumn("h", F.explode(halves)).select("word", "n", "m", "h.low", "h.high", "h.half")
    rows = rows.withColumn("key", _key(F.col("low"), F.col("high")))
    while True:
        hot = stored(rows.groupBy("key", "low", "high").agg(F.count("*").alias("rows")).filter((F.col("rows") > HOT_ROWS) & (F.col("high") - F.col("low") > 1)).select("key"), "hot-words")
        if not hot.take(1):
            return rows
        marked = rows.join(hot.withColumn("is_hot", F.lit(True)), "key", "left")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        parts = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        split = marked.withColumn("p", F.explode(F.when(F.col("is_hot"), parts).otherwise(F.array(F.struct("low", "high")))))
        split = split.select("word", "n", "m", F.col("p.low").alias("low"), F.col("p.high").alias("high"), "half")
        rows = stored(split.withColumn("key", _key(F.col("low"), F.col("high"))), "split-words")


def _searched(rows: DataFrame, parts: int) -> DataFrame:
    """(word, n_near, form_n, form): of each row of :func:`_dealt` how many near words it meets under its key, and the best of these."""

    def search_in(half: int, rows: dict[str, list]) -> pa.RecordBatch:
        backwards = half == 1
        read = [w[::-1] for w in rows["word"]] if backwards else rows["word"]
        count = dict(zip(rows["word"], rows["n"], strict=True))
        words = sorted({w[::-1] for w in read})
        index = Index([w[::-1] for w in words])
        lengths, m = np.array([len(w) for w in read]), np.array(rows["m"])
        query, hit = near(index, read, lengths > m, np.array(rows["low"]), np.array(rows["high"]), backwards)
        names = words if backwards else [w[::-1] for w in words]  # as they are written
        often = np.array([count[w] for w in names], np.int64)
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        order = np.lexsort((place[hit], -often[hit], query))
        query, hit = query[order], hit[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        best = hit[first]
        columns = [pa.array([rows["word"][i] for i in query[first].tolist()], pa.string()), pa.array(np.diff(np.append(first, len(query))).astype(np.int64)), pa.array(often[best]), pa.array([names[i] for i in best.tolist()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form_n", "form"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("word", "n", "m", "low", "high", "half", "key")
        held: dict[str, list] = {c: [] for c in names}
        for batch in batches:
            for c in names:
                held[c] += column_of(batch, c)
            n = len(held["key"])
            halves, keys = held["half"], held["key"]
            start = 0
            while start < n:
                turn = next((i for i in range(start, n) if halves[i] != halves[start]), n) if halves[-1] != halves[start] else n
                end = min(start + INDEX_ROWS, turn)
                while end < turn and keys[end] == keys[end - 1]:
                    end += 1
                if end == n:
                    break  # the last key may go on
                yield search_in(halves[start], {c: held[c][start:end] for c in names})
                start = end
            held = {c: held[c][start:] for c in names}
        if held["key"]:
            yield search_in(held["half"][0], held)

    dealt = rows.repartition(parts, "half", "key").sortWithinPartitions("half", "key")
    return dealt.select("word", "n", "m", "low", "high", "half", "key").mapInArrow(search, "word string, n_near long, form_n long, form string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each word's chain of forms followed to its end, two steps becoming one in every round.

    n doubles at least at every step of a chain, so the rounds grow with the logarithm of the logarithm of the largest n.
    """
    now = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = stepped.select("word", "root")
        if not stepped.filter("moved").take(1):
            return now


def grouped(docs: DataFrame, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """One row for each word of at least SHORTEST code points and ``least`` occurrences in all texts (:func:`counted`): word, form,
    root, n, n_near, form_n.

    Words are near if one inserted, deleted or replaced code point makes one of the other. ``form`` is the near word of largest n
    (ties: the smallest in code-point order) if that is at least twice the word's; else it and ``form_n`` are null. ``root`` is where the forms lead from a
    word, itself if it has none. Null and empty texts have no words, repeated rows count each; extra columns are ignored, no rows give none.

    Every word is searched for in an index of about INDEX_ROWS words that share half of their letters with it, so the
    work grows with the words times their letters, not with pairs. Both ends of a word are delimiters, and either half begins
    at one; so an index read in one direction serves each half, that of the words for the first and that of the
    reversed words for the second.
    """
    words = stored(counted(docs, every).filter(F.col("n") >= least), "words")
    rows = _dealt(words)
    parts = max(words.sparkSession.sparkContext.defaultParallelism, -(-4 * words.count() // INDEX_ROWS))
    met = _searched(rows, parts).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    joined = words.join(met, "word", "left").withColumn("has", F.coalesce(-F.col("best.n") >= 2 * F.col("n"), F.lit(False)))
    forms = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), -F.col("best.n")).alias("form_n")), "forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
