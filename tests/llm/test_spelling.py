"""Spelling variants against brute force, with keys split or not, and on odd tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from lociq.llm import spelling

SCHEMA = "doc_id long, text string"


def words_of(docs, least, every):
    counts = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}


def near_words(words):
    """By deletions alone: two words are one edit apart if they or their deletions at one place are the same."""
    by = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)  # one replaced: same rest around a place
    out = collections.defaultdict(set)
    for same in by.values():
        for w in same:
            out[w] |= same - {w}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                out[w].add(shorter)
                out[shorter].add(w)
    return out


def expected(docs, least=3, every=97):
    words = words_of(docs, least, every)
    near, form = near_words(words), {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return out


def corpus(seed, letters="abÉéÿ", n=40):
    rng = random.Random(seed)
    known = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 5, 6, 6, 7, 8, 13]))) for _ in range(120)]
    weights = [1 / (i + 1) for i in range(len(known))]
    return [(rng.choice([i, i, None]), " ".join(w if rng.random() < 0.9 else w.upper() for w in rng.choices(known, weights, k=rng.randrange(200))) + rng.choice(["", " ×÷ 9x_y"])) for i in range(n)]


def got_from(spark, docs, **kw):
    return {tuple(r) for r in spelling.grouped(spark.createDataFrame(docs, SCHEMA), **kw).collect()}


@pytest.mark.parametrize(("hot", "size"), [(50_000, 50_000), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, hot, size):
    monkeypatch.setattr(spelling, "HOT_ROWS", hot)
    monkeypatch.setattr(spelling, "INDEX_ROWS", size)
    docs = [*corpus(hot), (7, None), (8, "")]
    want = expected(docs, every=5)
    assert got_from(spark, docs, every=5) == want
    assert len(want) > 100 and max(r[4] for r in want) > 3 and any(r[2] not in (r[0], r[1]) for r in want)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_near_word_once(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab" if seed % 2 else "abcdé") for _ in range(rng.randrange(5, 9))) for _ in range(400)})
    near = near_words(set(words))
    total = collections.Counter()
    for backwards in (False, True):
        read = [w[::-1] for w in words] if backwards else words
        order = sorted(w[::-1] for w in read)
        index = spelling.Index([w[::-1] for w in order])
        for m in range(5, 9):
            for extra in (0, 1):
                some = [w for w in read if len(w) == m + extra]
                low, high = (0, m // 2) if backwards else (m // 2, m + 1)
                if some:
                    q, hit = spelling.near(index, some, np.full(len(some), bool(extra)), np.full(len(some), low), np.full(len(some), high), backwards)
                    for a, b in zip(q, hit, strict=True):
                        w, v = (some[a][::-1], order[b]) if backwards else (some[a], order[b][::-1])
                        total[w, v] += 1
    assert set(total) == {(w, v) for w in words for v in near[w]}
    assert set(total.values()) == {1}


def test_suffix_ranks():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 3, 300)
    text[-1] = 0
    assert spelling.suffix_ranks(text, 300).tolist() == sorted(range(300), key=lambda i: text[i:].tolist())


def test_chains_and_ties(spark):
    often = {"abcde": 40, "abcdf": 12, "abcgf": 6, "abhgf": 3, "bbhgf": 3, "zzzzz": 6, "zzzzy": 3, "zzzzx": 6, "alone": 3, "lange" * 9: 8, "lange" * 9 + "n": 3}
    docs = [(1, " ".join(w for w, n in often.items() for _ in range(n)))]
    want = expected(docs, every=10**9)
    assert got_from(spark, docs, every=10**9) == want
    by = {r[0]: r for r in want}
    assert by["abhgf"][1:3] == ("abcgf", "abcde") and by["bbhgf"][1] is None and by["zzzzy"][1] == "zzzzx" and by["alone"][2:5] == ("alone", 3, 0)


def test_odd_tables(spark, odd, nothing, clashing):
    assert spelling.grouped(nothing).collect() == []
    want = expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert {tuple(r) for r in spelling.grouped(odd).collect()} == want == {tuple(r) for r in spelling.grouped(clashing).collect()}
