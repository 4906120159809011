"""Collocations against brute force, whatever the sample proposes, and on odd tables."""

import collections
import random
import re

import numpy as np
import pytest

from lociq.llm import phrase_mining

SCHEMA = "doc_id long, text string, lang string"


def expected(docs, least, best, most_words=5):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in docs:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", folded):
            w = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, most_words + 1):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) >= 2 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            cuts = [(1000 * a * total[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best], 1)}
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "a", "of", "é", "É", "漢", "x1", "\x00", "kind", "sea"]
    fixed = ["one two three four five six", "sea of the kind", "a\ta  a a", "the the the"]
    text = lambda: "".join(rng.choice([*words, rng.choice(fixed)]) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\r\n", "! "]) for _ in range(rng.randrange(40)))
    return [(rng.choice([i, i, None, 3]), rng.choice([text(), text(), text(), None, ""]), rng.choice(["en", "en", "en", "de", None, "und"])) for i in range(n)]


@pytest.mark.parametrize(("least", "rate"), [(4, 10**6), (25, 8)])
def test_equals_brute_force(spark, least, rate):
    """With a rate of a million nothing is proposed, and every level is a border that fails."""
    docs = corpus(least + rate, 20 * least + 60)
    got = phrase_mining.mined(spark.createDataFrame(docs, SCHEMA), least, 40, 5, rate).collect()
    assert {tuple(r) for r in got} == expected(docs, least, 40) and len(got) > 8


def test_small_chunks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "_CHUNK_BYTES", 100)
    docs = [*corpus(1), (1, "so it goes on and on. " * 3000, "en"), (2, "no end " * 3000, "en")]
    got = phrase_mining.mined(spark.createDataFrame(docs, SCHEMA), 5, 100).collect()
    assert {tuple(r) for r in got} == expected(docs, 5, 100)


def test_a_crowded_filter_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "_MOST_BITS", 1)
    monkeypatch.setattr(phrase_mining.Filter, "has", lambda self, hashes: np.ones(len(hashes), bool))
    docs = corpus(9)
    assert {tuple(r) for r in phrase_mining.mined(spark.createDataFrame(docs, SCHEMA), 4, 40).collect()} == expected(docs, 4, 40)


def test_filter_has_its_phrases(spark):
    phrases = [("en", f"w{i} {'x ' * (i % 4)}y".replace("  ", " ")) for i in range(3000)]
    known = phrase_mining.Filter.of(spark.createDataFrame(phrases, "lang string, phrase string"), 3000)
    has = lambda lang, p: bool(known.has(np.array([phrase_mining._hash_of(lang, p)], np.uint64))[0])
    assert all(has(*p) for p in phrases)
    assert sum(has("de", p) for _, p in phrases) < 150


def test_rare_phrases_of_the_border_are_summed_by_hash_only(spark):
    """Their words are frequent, so all pairs are in the border: what is counted by itself, and sent as text, is the frequent ones."""
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(300)}" for _ in range(15_000)) + " so it goes" * 60
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    words = [("en", f"w{i}") for i in range(300)] + [("en", w) for w in ("so", "it", "goes")]
    known = phrase_mining.Filter.of(spark.createDataFrame(words, "lang string, phrase string"), len(words))
    often = phrase_mining.Buckets(1 << 24, 25).filled(docs, range(1, 3), known)
    plain = {(r["words"], r["phrase"]): r["n"] for r in phrase_mining._counted(docs, range(1, 3), known).collect()}
    counted = {(r["words"], r["phrase"]): r["n"] for r in phrase_mining._counted(docs, range(1, 3), known, buckets=often).collect()}
    assert {k: n for k, n in plain.items() if n >= 25} == {k: n for k, n in counted.items() if n >= 25}
    assert len(plain) > 10_000 and len(counted) < 400


def test_arithmetic_past_64_bits(spark, monkeypatch):
    big = 5 * 10**12
    rows = [("en", 0, "", 3 * big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)]
    monkeypatch.setattr(phrase_mining, "frequent", lambda docs, *_: docs)
    got = phrase_mining.mined(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).first()
    assert got["score"] == 1000 * (big - 7) * 3 * big // (big * (big - 1))


def test_odd_tables(spark, odd, nothing, clashing):
    assert phrase_mining.mined(nothing, 2).collect() == []
    a, b = phrase_mining.mined(odd, 3).collect(), phrase_mining.mined(clashing, 3).collect()
    assert a == b or sorted(a) == sorted(b)
    assert {tuple(r) for r in a} == expected([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], 3, 2000)
