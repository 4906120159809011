"""N-gram Jaccard self-join: a MinHash LSH forest finds candidates, exact shingle sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.components import components
from lociq.llm.common import Words, column_of, pieces, texts_of
from lociq.operators.ordering import numbered
from lociq.scratch import stored

WORDS = 5
TREES, DEPTH = 16, 6  # sorted tries, and labels of a signature in each
SHORTEST = 3  # labels that texts must share in a trie at least: even a pair just at 0.8 then meets with 0.99999
TARGET = 0.9999  # recall at which prefixes are not shortened further
_SIGNED = 4  # labels of each trie that a signature holds, a byte each
BLOCK_DOCS = 500  # texts of a cluster that are compared with as many others in one piece of work
BLOCK_BYTES = 4 << 20  # text in such a block, about; a text of over a quarter of it is a block of its own
HOT_ROWS = 50_000  # texts in a trie's bucket above which all are linked to its least without comparing signatures
_CHUNK_BYTES = 2 << 20
_COLUMNS = 4_096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def meets(similarity: float | np.ndarray, length: int) -> float | np.ndarray:
    """The chance that two texts of that similarity share a prefix of that length in one trie at least."""
    return 1 - (1 - similarity**length) ** TREES


def prefix_length(found: dict[int, int], threshold: float) -> int:
    """The longest prefix that finds TARGET of the links. ``found``: of the pairs that met in a trie, how many agree in
    that many of the signature's labels.

    Prefixes are shortened label by label until the recall that is to be expected of these pairs, at the similarity that
    each shows, is reached; pairs that show less than the threshold may be links, so they count as being at it. Nothing
    found: as if all were at the threshold.
    """
    shown = np.maximum(threshold, np.array(list(found) or [0]) / (TREES * _SIGNED))
    weights = np.array(list(found.values()) or [1])
    length = DEPTH
    while length > SHORTEST and np.average(meets(shown, length), weights=weights) < TARGET:
        length -= 1
    return length


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every text's word shingles, one after the other, and where each text's begin. A text of
    fewer words is one shingle; so every text has at least one."""
    split = [t.split() for t in texts]
    known = Words()
    codes = known.codes([w for x in split for w in x])
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in known.index], dtype=np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    lengths = np.array([len(x) for x in split], dtype=np.int64)
    counts = np.maximum(1, lengths - words + 1)
    starts = np.cumsum(counts) - counts
    first = np.cumsum(lengths) - lengths
    at = np.repeat(first - starts, counts) + np.arange(int(counts.sum()))
    left = np.repeat(first + lengths, counts) - at  # words from here to the text's end
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for i in range(words):
        out = (out ^ (out >> np.uint64(29))) * _ODD + np.where(i < left, padded[np.minimum(at + i, len(hashes))], np.uint64(i + 1))
    return (out ^ (out >> np.uint64(32))) * _ODD, starts


def _signatures(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """MinHash of each text: the least of ``size`` hash functions over its shingles."""
    rng = np.random.default_rng(42)
    factors, offsets = rng.integers(1 << 31, 1 << 32, size, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, size, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.empty((len(starts), size), np.uint32)
    for i in range(size):
        mixed = short * factors[i] + offsets[i]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(mixed, starts)
    return out


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_md5, bytes of the text, its labels in each trie (two bytes each), and a signature of one byte for some of them."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in pieces(batch, map(len, texts), _CHUNK_BYTES):
                labels = _signatures(*shingles(texts[a:b], words), TREES * DEPTH).astype(">u2").reshape(b - a, TREES, DEPTH)
                tries = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEPTH), (b - a) * TREES, [None, pa.py_buffer(labels.tobytes())]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(range(0, (b - a) * TREES + 1, TREES), pa.int32()), tries)
                short = labels[:, :, :_SIGNED].astype(np.uint8).reshape(b - a, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([hashlib.md5(t).digest() for t in texts[a:b]]), lists, pa.array([row.tobytes() for row in short]), pa.array([len(t) for t in texts[a:b]], pa.int64())], names=["doc_id", "text_md5", "tries", "signature", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, text_md5 binary, tries array<binary>, signature binary, n_bytes long")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows with equal ``key`` together, from batches sorted by it; runs of a single row are left out."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        keys = table.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            if sum(map(len, held)) > 1:
                yield pa.concat_tables(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            if held:
                yield pa.concat_tables([*held, table.slice(a, b - a)])
                held = []
            elif b - a > 1:
                yield table.slice(a, b - a)
        held.append(table.slice(cuts[-2]))
    if sum(map(len, held)) > 1:
        yield pa.concat_tables(held)


def spanning(n: int, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1; ``linked(a, b)`` gives the links between two sets of nodes. Only
    nodes not reached yet are asked for."""
    unseen = np.arange(n)
    while len(unseen):
        frontier, unseen = unseen[:1], unseen[1:]
        while len(frontier) and len(unseen):
            fresh = []
            for i in range(0, len(frontier), 64):
                some = frontier[i : i + 64]
                links = linked(some, unseen)
                hit = links.any(axis=0)
                for parent, child in zip(some[links[:, hit].argmax(axis=0)], unseen[hit], strict=True):
                    yield int(parent), int(child)
                fresh.append(unseen[hit])
                unseen = unseen[~hit]
                if not len(unseen):
                    break
            frontier = np.concatenate(fresh)


def levels(labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first, last): the sorted rows first..last-1 share a prefix of that length, and not all of them a longer
    one. These are the inner nodes of the trie; where a prefix begins and ends follows from what neighbours share."""
    differs = labels[1:] != labels[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), labels.shape[1])  # of each row and the next
    for length in range(labels.shape[1], SHORTEST - 1, -1):
        cuts = np.concatenate([[0], np.flatnonzero(shared < length) + 1, [len(labels)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1 and (shared[a : b - 1] == length).any():
                yield length, a, b


def _candidates(texts: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between texts that share a prefix in a trie and whose signatures agree to within chance of the
    threshold: for each inner node of the tries edges that span what is linked below it.

    Each trie is dealt out by its first SHORTEST labels and sorted by all of them; one pass finds the edges of every
    prefix length. Then the length is chosen from the agreement of what was found (:func:`prefix_length`), and the edges
    of shorter prefixes are left. Where over HOT_ROWS texts share the first labels all count as candidates: an edge
    leads from each to the least, without a task that holds them all.
    """
    size = TREES * _SIGNED
    least = int(size * (similarity - 5 * (similarity * (1 - similarity) / size) ** 0.5))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "key"):
            nodes = run.column("node").to_numpy()
            signatures = np.frombuffer(b"".join(run.column("signature").to_pylist()), np.uint8).reshape(len(nodes), size)
            labels = np.frombuffer(b"".join(run.column("labels").to_pylist()), ">u2").reshape(len(nodes), DEPTH)

            def agreeing(a: np.ndarray, b: np.ndarray, signatures: np.ndarray = signatures) -> np.ndarray:
                return np.concatenate([(signatures[a[:, None]] == signatures[b[i : i + 4096]][None]).sum(axis=2) for i in range(0, len(b), 4096)], axis=1)

            for length, first, last in levels(labels):
                at = first + np.argsort(nodes[first:last])  # from the least node, so that tries and levels give the same edges
                found = at[np.array(list(spanning(last - first, lambda a, b, at=at: agreeing(at[a], at[b]) >= least)), dtype=np.int64).reshape(-1, 2)]
                if len(found):
                    agree = (signatures[found[:, 0]] == signatures[found[:, 1]]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[found[:, 0]]), pa.array(nodes[found[:, 1]]), pa.array(np.full(len(found), length, np.int32)), pa.array(agree.astype(np.int32))], names=["a", "b", "length", "agree"])

    rows = texts.select("node", "signature", F.posexplode("tries").alias("tree", "labels"))
    rows = rows.select("node", "signature", "labels", F.xxhash64("tree", F.substring("labels", 1, 2 * SHORTEST)).alias("key"))
    # There are at most one in HOT_ROWS.
    hot = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter(F.col("n") > HOT_ROWS).select("key", "least"), "hot-buckets")
    compared = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").repartition("key").sortWithinPartitions("key", "labels")
    edges = stored(compared.mapInArrow(link, "a long, b long, length int, agree int"), "trie-edges")
    met = edges.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.first("agree").alias("agree")).groupBy("agree").count()
    length = prefix_length({r["agree"]: r["count"] for r in met.collect()}, similarity)  # a row for each number of labels
    return edges.filter(F.col("length") >= length).select("a", "b").unionByName(rows.join(F.broadcast(hot), "key").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())


def _work(slim: DataFrame, texts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows (piece, node, block, text): each cluster dealt into blocks bounded by texts and by bytes, every two blocks
    a piece."""
    placed = clusters.join(texts.select("node", "doc_id", "text_md5", "n_bytes"), "node").withColumn("long", F.col("n_bytes") > BLOCK_BYTES // 4)
    short = ~F.col("long")
    sizes = placed.groupBy("component").agg(F.count_if(short).alias("n"), F.coalesce(F.sum(F.when(short, F.col("n_bytes"))), F.lit(0)).alias("bytes"), F.count_if("long").alias("n_long"))
    sizes = sizes.withColumn("n_short", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES)))
    own = placed.filter("long").select("node", F.row_number().over(Window.partitionBy("component").orderBy("node")).alias("own"))
    placed = placed.join(sizes.select("component", "n_short", (F.col("n_short") + F.col("n_long")).alias("blocks")), "component").join(own, "node", "left")
    placed = placed.withColumn("block", F.when(F.col("long"), F.col("n_short") + F.col("own") - 1).otherwise(F.expr("pmod(xxhash64(node), greatest(n_short, 1))")))
    placed = placed.select("doc_id", "text_md5", "node", "component", "block", "blocks")
    with_text = slim.withColumn("text_md5", F.unhex(F.md5("text"))).join(placed, ["doc_id", "text_md5"])
    once = with_text.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    piece = F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"))
    return once.select(piece.alias("piece"), "node", "block", F.col("text").cast("binary").alias("text"))


def _verified(members: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """From rows (piece, node, block, text), sorted runs of equal piece: verified links. A row (a, b, 0) is an edge of
    a spanning forest; a row (a, null, n) says that a has n links within this piece."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "piece"):
            one = {(n, t): i for i, (n, t) in enumerate(zip(column_of(run, "node"), column_of(run, "text"), strict=True))}  # repeated rows once
            run = run.take(sorted(one.values()))
            nodes, blocks = run.column("node").to_numpy(), run.column("block").to_numpy()
            hashes, starts = shingles(column_of(run, "text"), words)
            ends = np.append(starts[1:], len(hashes))
            sets = [np.unique(hashes[a:b]) for a, b in zip(starts, ends, strict=True)]
            sizes = np.array([len(s) for s in sets])
            _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = often > 1
            column = np.cumsum(shared) - 1
            owner, keep = np.repeat(np.arange(len(sets)), sizes), shared[code]
            owner, at = owner[keep], column[code[keep]]
            common = np.zeros((len(nodes), len(nodes)), np.float32)
            for first in range(0, int(shared.sum()), _COLUMNS):
                inside = (at >= first) & (at < first + _COLUMNS)
                part = np.zeros((len(nodes), min(_COLUMNS, int(shared.sum()) - first)), np.float32)
                part[owner[inside], at[inside] - first] = 1
                common += part @ part.T
            # inter / union >= numerator / denominator, in whole numbers
            links = (numerator + denominator) * common.astype(np.int64) >= numerator * (sizes[:, None] + sizes[None, :])
            np.fill_diagonal(links, False)
            if (blocks != blocks[0]).any():  # two blocks: pairs within one are another piece's work
                links &= blocks[:, None] != blocks[None, :]
            counts = links.sum(axis=1)
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            inner = links[np.ix_(some, some)]
            found = np.array(list(spanning(len(some), lambda a, b, inner=inner: inner[np.ix_(a, b)])), dtype=np.int64).reshape(-1, 2)
            a = np.concatenate([nodes[some[found[:, 0]]], nodes[some]])
            b = pa.concat_arrays([pa.array(nodes[some[found[:, 1]]]), pa.nulls(len(some), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([np.zeros(len(found), np.int64), counts[some]]))], names=["a", "b", "links"])

    return members.repartition("piece").sortWithinPartitions("piece").mapInArrow(verify, "a long, b long, links long")


def _with_nodes(texts: DataFrame) -> DataFrame:
    """Adds ``node``, a number of its own for each text: its doc_id, the least of its copies; of texts that share that, the
    first by text_md5 keeps it and the others are numbered from above all doc_ids."""
    sharing = stored(texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text_md5").alias("first")).filter("n > 1").select("doc_id", "first"), "shared-ids")
    if not sharing.take(1):
        return texts.withColumn("node", F.col("doc_id"))
    others = texts.select("text_md5", "doc_id").join(sharing, "doc_id").filter("text_md5 <> first").select("doc_id", "text_md5")
    # One row: the largest doc_id.
    top = texts.agg(F.max("doc_id").alias("top"))
    own = numbered(others, ["doc_id", "text_md5"]).join(F.broadcast(top)).select("text_md5", (F.col("top") + 1 + F.col("place")).alias("own"))
    return stored(texts.join(own, "text_md5", "left").withColumn("node", F.coalesce("own", "doc_id")).drop("own"), "texts")


def joined(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = (4, 5), with_md5: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_id (the least doc_id with the very same text), class_id (the
    same for all texts that links and copies connect: their least doc_id) and n_links (different texts that share at least
    ``similarity`` of their word shingles with this one).

    Shingles are runs of five words, as sets; a text of fewer words is one shingle. Null texts are empty; texts
    without words share one shingle. Copies are collapsed first, so however many there are they cost
    one text. Rows without doc_id take no part: class_id and text_id are null, n_links is 0. Links are between texts:
    rows that share a doc_id but not the text have classes and links of their own. A text whose doc_id is already that of another
    (:func:`_with_nodes`) is known by a number above all doc_ids, so a class of such texts alone has that as class_id.
    Extra columns are ignored; an empty table gives no rows.

    ``with_md5`` adds text_md5 (binary; null without doc_id) and is_first: the text by which its class is known, one in each.

    Candidates meet in one of 16 sorted tries of MinHash labels, by a prefix that is shortened from 6 labels to as few as
    3 until the recall expected of the pairs found reaches TARGET.
    They form clusters; within a cluster every pair of texts is verified on its exact shingle sets, a cluster of
    more than BLOCK_DOCS texts or BLOCK_BYTES of text block by block.
    """
    share = similarity[0] / similarity[1]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = stored(_signed(slim, words), "signatures")
    texts = stored(signed.filter("doc_id IS NOT NULL").groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.first("tries").alias("tries"), F.first("signature").alias("signature"), F.first("n_bytes").alias("n_bytes")), "texts")
    texts = _with_nodes(texts)
    clusters = stored(components(_candidates(texts, share)), "clusters")
    found = stored(_verified(_work(slim, texts, clusters), words, *similarity), "links")
    classes = components(found.filter("b IS NOT NULL").select("a", "b"))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    known = texts.select("text_md5", "doc_id", "node").join(classes, "node", "left").join(counts, "node", "left")
    known = known.select("text_md5", F.col("doc_id").alias("text_id"), F.coalesce("component", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("component", "node") == F.col("node")).alias("is_first"))
    rows = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("text_md5")).alias("text_md5")).join(known, "text_md5", "left")
    return rows.select("doc_id", "text_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), *["text_md5", "is_first"] * with_md5)
