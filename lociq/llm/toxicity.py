"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.common import fold, pieces, texts_of

FOLDS = 5
SAMPLE_DOCS = 2_000  # labelled documents of each class that the network is trained on, at most
SAMPLE_BYTES = 200_000  # longer texts are not drawn for training (they are scored whole)
SAMPLE_TOTAL = 100_000_000  # bytes of all texts drawn; those after it in the sample's order are not trained on
SLOTS, WIDTH, FILTERS, SPANS = 1 << 17, 8, 8, (1, 2, 3)
_PAD = 2 * SLOTS
_CHUNK_BYTES = 1 << 19
_CACHED_WORDS = 500_000

#: Bytes to bytes: A-Z lower-cased, ASCII punctuation and white space to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))

#: Frequent words that tell a text's language.
_LANGUAGE = {
    "en": "the of and to in that is was for with this",
    "fr": "le la les des et que qui dans pour une sur",
    "de": "der die und das nicht ist ein mit von den",
    "es": "el los las que en por con para una del",
}
LANGUAGES = (*_LANGUAGE, "other")


class Hasher:
    """Words to their embedding slots: one for the word, one for its first four letters (inflected forms share it).
    The frequent words that speak for a language have the first codes."""

    def __init__(self) -> None:
        frequent = list(dict.fromkeys(w for words in _LANGUAGE.values() for w in words.split()))
        self.says = np.array([[w in x.split() for x in _LANGUAGE.values()] for w in frequent], dtype=np.int64)
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((1 << 16, 2), np.int32)
        self._add([w.encode() for w in frequent])

    def _add(self, words: list[bytes]) -> None:
        n = len(self.index)
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for i, w in enumerate(words, n):
            self.index[w] = i
        stems = [w.decode(errors="replace")[:4].encode() for w in words]
        self.table[n : n + len(words)] = np.array([(zlib.crc32(w) % SLOTS, SLOTS + zlib.crc32(x) % SLOTS) for w, x in zip(words, stems, strict=True)], dtype=np.int32).reshape(-1, 2)

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > _CACHED_WORDS:
            self.__init__()
        self._add([w for w in set(words) if w not in self.index])
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))


def _laid_out(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all words with pads after each text, where each text begins, and its language's number."""
    split = [t.translate(_FOLD).split() for t in texts]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    codes = hasher.codes([w for words in split for w in words])
    pads = max(SPANS)
    starts = np.concatenate([[0], np.cumsum(lengths + pads)[:-1]]).astype(np.int64)
    slots = np.full((int((lengths + pads).sum()), 2), _PAD, np.int64)
    slots[np.arange(len(codes)) + np.repeat(np.arange(len(texts)) * pads, lengths)] = hasher.table[codes]
    spoken = np.flatnonzero(codes < len(hasher.says))
    owner = np.repeat(np.arange(len(texts)), lengths)[spoken]
    says = np.stack([np.bincount(owner, hasher.says[codes[spoken], k], len(texts)) for k in range(len(_LANGUAGE))], axis=1)
    return slots, starts, np.where(says.max(axis=1) > 0, says.argmax(axis=1), len(_LANGUAGE))


@dataclass
class Network:
    """Embedding sums go through filters of several spans, the largest answer of each filter in the text
    through a logistic unit. ``shift`` moves the score of each language so that its threshold is 0.5."""

    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def answers(self, slots: np.ndarray) -> list[np.ndarray]:
        """For each span, a row for each filter: its answer at each place where a window can begin."""
        x = self.embed[slots[:, 0]] + self.embed[slots[:, 1]]
        parts = np.concatenate([w[i * WIDTH : (i + 1) * WIDTH] for h, w in zip(SPANS, self.filters, strict=True) for i in range(h)], axis=1).T @ x.T
        n, at, out = len(x) - max(SPANS) + 1, 0, []
        for h, b in zip(SPANS, self.biases, strict=True):
            own = parts[at : at + FILTERS, :n] + b[:, None]
            for i in range(1, h):
                own += parts[at + i * FILTERS : at + (i + 1) * FILTERS, i : n + i]
            out.append(own)
            at += h * FILTERS
        return out

    def logits(self, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        # Windows begin at each word of a text and at the pad after the last; those at the other pads reach into the next text.
        bounds = np.stack([starts - max(SPANS) + 1, starts], axis=1).reshape(-1)[1:]
        pooled = [np.maximum.reduceat(a, bounds, axis=1)[:, ::2] for a in self.answers(slots)]
        return self.out @ np.maximum(np.concatenate(pooled), 0) + self.bias

    def score(self, texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0), np.zeros(0, np.int64)
        slots, starts, language = _laid_out(texts, hasher)
        return 1 / (1 + np.exp(-np.clip(self.logits(slots, starts) - self.shift[language], -500, 500))), language


def train(texts: list[bytes], toxic: list[int], epochs: int = 8, rate: float = 0.01, seed: int = 7) -> Network:
    """Adagrad over single texts, the classes weighing the same; the same rows give the same network."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (2 * SLOTS + 1, WIDTH)).astype(np.float32)
    embed[_PAD] = 0
    net = Network(embed, [rng.normal(0, (h * WIDTH) ** -0.5, (h * WIDTH, FILTERS)).astype(np.float32) for h in SPANS], [np.zeros(FILTERS, np.float32) for _ in SPANS], rng.normal(0, 0.3, FILTERS * len(SPANS)).astype(np.float32), 0.0)
    label = np.array(toxic, dtype=np.int64)
    if not 0 < label.sum() < len(label):
        net.out[:], net.bias = 0, 0.0 if not len(label) else (20.0 if label[0] else -20.0)
        return net
    hasher = Hasher()
    rows = [_laid_out([t], hasher) for t in texts]
    learn, check = np.arange(len(rows)) % 5 != 4, np.arange(len(rows)) % 5 == 4
    weight = np.where(label == 1, len(label) / (2 * label.sum()), len(label) / (2 * (label == 0).sum()))
    params = [net.embed, *net.filters, *net.biases, net.out]
    grown = [np.full(p.shape, 1e-3, np.float32) for p in params]
    bias_grown = 1e-3
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(learn)):
            slots = rows[i][0]
            answers = net.answers(slots)
            best = [a.argmax(axis=1) for a in answers]
            top = np.concatenate([a[np.arange(FILTERS), b] for a, b in zip(answers, best, strict=True)])
            hidden = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.bias, -30, 30)))
            slope = np.float32((p - label[i]) * weight[i])
            back = np.where(top > 0, slope * net.out, 0).astype(np.float32)
            steps: list[tuple[int, object, np.ndarray]] = [(len(params) - 1, slice(None), slope * hidden + 1e-4 * net.out)]
            for s, h in enumerate(SPANS):
                own = back[s * FILTERS : (s + 1) * FILTERS]
                if not own.any():
                    continue
                places = best[s][:, None] + np.arange(h)  # filter, word of the window
                pair = slots[places]  # filter, word, hash
                x = (net.embed[pair[..., 0]] + net.embed[pair[..., 1]]).reshape(FILTERS, h * WIDTH)
                to_words = (own[:, None] * net.filters[s].T).reshape(FILTERS, h, WIDTH)
                steps += [(1 + s, slice(None), (own[:, None] * x).T), (1 + len(SPANS) + s, slice(None), own)]
                at, which = np.unique(pair.reshape(-1), return_inverse=True)
                slopes = np.zeros((len(at), WIDTH), np.float32)
                np.add.at(slopes, which, np.repeat(to_words.reshape(-1, WIDTH), 2, axis=0))
                slopes[at == _PAD] = 0
                steps.append((0, at, slopes))
            for k, at, slopes in steps:
                grown[k][at] += slopes * slopes
                params[k][at] -= rate * slopes / np.sqrt(grown[k][at]) * (5 if k == 0 else 1)
            bias_grown += slope * slope
            net.bias -= rate * slope / bias_grown**0.5
    # Each language's threshold: where the weighted errors on the rows not learned from are fewest, halfway to the
    # next answers; with few rows, where they are fewest over all languages.
    checked = np.flatnonzero(check)
    logits = np.array([net.logits(rows[i][0], rows[i][1])[0] for i in checked])
    language = np.array([rows[i][2][0] for i in checked])
    overall = _threshold(logits, label[checked])
    for k in range(len(LANGUAGES)):
        own = language == k
        enough = min(label[checked][own].sum(), (1 - label[checked][own]).sum()) >= 20
        net.shift[k] = _threshold(logits[own], label[checked][own]) if enough else overall
    return net


def _threshold(logits: np.ndarray, label: np.ndarray) -> float:
    if not 0 < label.sum() < len(label):
        return 0.0
    cuts = np.unique(logits)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[:-1] + cuts[1:]) / 2, [cuts[-1] + 1]])
    errors = [((logits < c) & (label == 1)).mean() / (label == 1).mean() + 4 * ((logits >= c) & (label == 0)).mean() / (label == 0).mean() for c in cuts]
    least = np.flatnonzero(np.array(errors) <= min(errors) + 1e-12)
    return float((cuts[least[0]] + cuts[least[-1]]) / 2)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """text and toxic of at most ``most`` labelled documents of each class, of folds other than 0, in the
    order of the id's hash, and of at most SAMPLE_TOTAL bytes together. A doc_id that is labelled more than once has its
    least label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != 0)).groupBy("doc_id").agg(F.min("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    chosen = [known.filter(F.col("toxic") == c).orderBy("order", "doc_id").limit(most) for c in (0, 1)]
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES)
    # At most 2 * most rows of two numbers are broadcast.
    joined = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    drawn = joined.withColumn("copy", one).filter("copy = 1")
    total = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.orderBy("order", "doc_id"))  # over at most 2 * most rows
    return drawn.withColumn("total", total).filter(F.col("total") <= SAMPLE_TOTAL).orderBy("order", "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5, else 0), and the language found.

    Trained on a bounded sample of the labelled rows (SAMPLE_DOCS of each class, see :func:`sample`); scores every whole text, and from
    the text alone. Null texts are empty and are scored like any text. Every row of ``docs`` gives one row;
    extra columns are ignored. Labels other than 0 and 1 are not learned from. If only one label is there, scores
    are near that label; without labels they are 0.5.
    """
    rows = sample(docs, labels).collect()
    net = train([r["text"].encode() for r in rows], [r["toxic"] for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = "doc_id long, score double, language string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = shared.value, Hasher()
        for batch in batches:
            texts = texts_of(batch)
            for a, b in pieces(batch, map(len, texts), _CHUNK_BYTES):
                score, language = own.score(texts[a:b], hasher)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score, pa.float64()), pa.array([LANGUAGES[k] for k in language], pa.string())], names=["doc_id", "score", "language"])

    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(judge, schema)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "language")
