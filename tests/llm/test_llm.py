"""Each operator against brute force, an exact round trip, SQL, or held-out accuracy; and on odd tables."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from comparing import rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lociq.llm import bpe_replay, common, jaccard_join, license_scan, lm_scoring, mixing, quality_classifier, quality_rules, queries, range_coder, token_output, topk_search, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents_of(spark, sf_dir):
    return common.documents(spark, sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(queries.ORACLES[name]).df())


# 1


def vocabulary(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def test_range_coder_round_trips():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 49408, 4096), np.full(4096, 7), np.tile(np.arange(50), 80), rng.zipf(1.3, 4000).clip(0, 65000), np.array([2**32 - 1]), np.arange(4096)]
    blocks = [b.astype(np.uint32) for b in blocks]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    assert all(np.array_equal(range_coder.decode([c])[0], b) for c, b in zip(coded, blocks, strict=True))  # each alone
    assert len(coded[2]) < 600 and range_coder.encode(blocks[2:3]) == coded[2:3]
    broken = bytearray(coded[3])
    broken[-9] ^= 255
    with pytest.raises((ValueError, IndexError)):
        range_coder.decode([bytes(broken)])
    assert range_coder.encode([]) == [] and range_coder.decode([]) == []


def expected_ids(texts):
    tokenizer = Tokenizer.from_str(vocabulary("word_bpe_49k.json").decode())
    return [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_tokens_are_the_library_s():
    rng = random.Random(7)
    draw = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0, 64), lambda: rng.randrange(0x80, 0x500), lambda: rng.randrange(0x1F300, 0x1F700), lambda: 32]
    texts = ["a <|endoftext|> b", "x<|startoftext|>Y z", "<|endoftext|>", "<|endof text|>", ""] + ["".join(chr(rng.choice(draw)()) for _ in range(rng.randrange(60))) for _ in range(1500)]
    got = token_output.tokenise([t.encode() for t in texts], vocabulary("word_bpe_49k.json"))
    assert [[*x.tolist(), 2] for x in got] == expected_ids(texts) and got[0].tolist() == [320, 49407, 321]
    assert token_output.tokenise([], vocabulary("word_bpe_49k.json")) == []


def test_token_files(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] or "" for r in documents_of(spark, sf_dir).collect()}
    got = queries.op1_token_output(spark, sf_dir).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(got, expected_ids([rows[k] for k in sorted(rows)]), strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_odd_tables(spark, odd, clashing, nothing, odd_texts):
    data = vocabulary("word_bpe_49k.json")
    got = token_output.round_trip(odd, data).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 4, 4, 5, 6, 7]
    for r, ids in zip(got, expected_ids([odd_texts[r["doc_id"]] for r in got]), strict=True):
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
    assert token_output.round_trip(clashing, data).count() == 10 and token_output.round_trip(nothing, data).count() == 0


# 2


def brute_rules(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, clashing, nothing, odd_texts):
    for r in quality_rules.scored(odd).collect():
        n, chars, symbols, same, repeats = brute_rules(r["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, same, repeats)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and not (r["kept"] and r["base_failed"])
    assert quality_rules.scored(clashing).count() == 10 and quality_rules.scored(nothing).count() == 0


def test_quality_rules_by_line(spark):
    good = "A quiet line of prose that ends as such lines do, with words enough for everyone to read.\n" + " ".join(f"word{i}" for i in range(30)) + ".\n"
    cases = {0: good, 1: good + "Home | News | About | Contact\n", 2: "Home | News | About | Contact | More\n" * 3 + " ".join(f"A{i}!!" for i in range(40)), 3: good + "Please read our Privacy Policy.\n"}
    got = {r["doc_id"]: r for r in quality_rules.scored(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in range(4)] == [True, True, False, True]
    assert got[1]["cleaned"] == good and got[3]["cleaned"] == good and got[0]["cleaned"] == good


def test_carriage_returns_are_white_space_in_both_engines(spark):
    import duckdb

    prose = " ".join(f"word{i}" for i in range(25))
    rows = [(i, f"{prose}\r\n{line}\r\n{prose} more") for i, line in enumerate(["a \u2022 b \u2022 c \u2022", "| | |", "a | b | c |x", "- a - b -", "a / b / c /\u2028", "a / b / c /\u0085", "x"])]
    rows += [(20, "a \u2022 b \u2022 c \u2022\r"), (21, f"{prose}\r\r\n- - - \r"), (22, f"{prose}\n- - -"), (23, f"{prose}\n- - -\n")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")  # noqa: F841
    connection = duckdb.connect()
    connection.register("documents", documents.toPandas())
    assert rows_of(quality_rules.scored(documents).select(*quality_rules.COLUMNS).toPandas()) == rows_of(connection.execute(quality_rules.ORACLE).df())


def test_quality_rules_keep_clean_documents(spark, sf_dir):
    labels = common.labels(spark, sf_dir).filter("quality = 1")
    rows = queries.op2_quality_rules(spark, sf_dir).join(labels, "doc_id").filter("n_words >= 20")
    assert rows.filter("NOT kept").count() == 0 < rows.count()


# 3


def test_targets_are_a_water_level(spark):
    rng = random.Random(5)
    for _ in range(3):
        sizes = {f"={i:02}": rng.randrange(1, 1000) for i in range(rng.randrange(1, 12))}
        got = {r["key"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "key string, source_size long")).collect()}
        goal, left, open_ = {}, 1.5 * sum(sizes.values()), dict(zip(sorted(sizes), (5, 2, 1) * 9, strict=False))
        while True:
            over = [k for k, w in open_.items() if left * w / sum(open_.values()) > 2 * sizes[k]]
            if not over:
                break
            level = left / sum(open_.values())
            for k in [k for k in over if level * open_[k] > 2 * sizes[k]]:
                goal[k] = 2.0 * sizes[k]
            left, open_ = 1.5 * sum(sizes.values()) - sum(goal.values()), {k: w for k, w in open_.items() if k not in goal}
        goal |= {k: left * w / sum(open_.values()) for k, w in open_.items()}
        assert got == pytest.approx(goal)


def test_mix(spark, sf_dir):
    rows = queries.op3_mixing(spark, sf_dir).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all()
    docs = documents_of(spark, sf_dir).select("doc_id", "source").toPandas()
    by_source = rows.merge(docs, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), largest=("size", "max"))
    assert ((by_source.taken - by_source.target).abs() <= 2 * by_source.largest).all()
    mixed = mixing.mix(documents_of(spark, sf_dir)).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert mixed == {k: v for k, v in zip(rows.doc_id, rows.copies, strict=True) if v}


def test_mix_is_the_same_again_and_bears_odd_tables(spark, odd, clashing, nothing):
    one, two = (sorted(map(str, mixing.mix(odd.repartition(n)).collect())) for n in (1, 7))
    assert one == two and one
    assert mixing.mix(clashing).columns == clashing.columns and mixing.mix(clashing).count() == len(one)
    assert mixing.mix(nothing).count() == 0


# 4


def test_runs_are_even_for_strided_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 1_000)
    for doc_id in ("id * 6", "7", "CAST(NULL AS LONG)"):
        rows = spark.range(6_000).select(F.expr(doc_id).cast("long").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 50).alias("size"), F.md5(F.col("id").cast("string")).alias("tie"))
        sizes = [r["count"] for r in rows.groupBy(mixing._run_of(rows, 6)).count().collect()]
        assert len(sizes) == 6 and max(sizes) < 2_000
        assert abs(mixing.mixed(rows).agg(F.sum(F.col("copies") * F.col("size"))).first()[0] / (1.5 * 6_000 * 24.5) - 1) < 0.02


@pytest.fixture(scope="module")
def encoder():
    return bpe_replay.Encoder(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks.ids, special_tokens={})


def test_every_token_encodes_to_itself(encoder):
    tokens = list(encoder.ranks.ids)
    ids, ends = bpe_replay.replay(tokens, encoder.ranks)
    assert ids.tolist() == [encoder.ranks.ids[t] for t in tokens] and ends.tolist() == list(range(1, len(tokens) + 1))
    assert [x.tolist() for x in bpe_replay.replay([], encoder.ranks)] == [[], []] and [x.tolist() for x in bpe_replay.replay([b"", b"a", b""], encoder.ranks)] == [[64], [0, 1, 1]]


def ids_of(encoder, texts):
    out = [None] * len(texts)
    for places, part in encoder.encode(pa.array(texts, pa.string())):
        for place, ids in zip(places, np.split(part.flat(), part.text_ends[:-1]), strict=True):
            out[place] = ids.tolist()
    return out


def test_a_merge_may_make_way_for_an_earlier_rank():
    # "xyx" comes before "xy", but is made of "xy" and "x": after the first "xy" it is the next to merge.
    ranks = [bytes([b]) for b in range(256)] + [b"xyx", b"xy"]
    data = b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(ranks))
    library = tiktoken.Encoding("small", pat_str=".+", mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    texts = ["xyxyxy", "xyxy", "axyxyb", "xyx", "xxyy"]
    assert ids_of(bpe_replay.Encoder(data, ".+", spaced=False), texts) == [library.encode_ordinary(t) for t in texts]


def test_replay_equals_the_library(encoder, reference):
    rng = random.Random(1)
    draw = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0, 64), lambda: rng.randrange(0x80, 0x500), lambda: rng.randrange(0x2000, 0x3100), lambda: rng.randrange(0x1F300, 0x1F700), lambda: 97, lambda: 32]
    texts = ["".join(chr(rng.choice(draw)()) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["".join(rng.choice("aabetionsh") for _ in range(rng.randrange(80))) for _ in range(500)]
    texts += ["", " ", "a ", " a", "a  b", "a \n b"]
    expected = [reference.encode_ordinary(t) for t in texts]
    assert ids_of(encoder, texts) == expected
    assert ids_of(bpe_replay.Encoder(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, spaced=False), texts) == expected


def test_texts_are_laid_out_a_span_at_a_time(encoder, reference, monkeypatch):
    """What a chunk's ids take beside its words does not grow with the chunk."""
    monkeypatch.setattr(bpe_replay, "_SPAN_IDS", 2_000)
    texts = ["", "long " * 5_000, "", *(f"text {i} of the same few words" for i in range(20_000)), "", "x"]
    ((_, part),) = encoder.encode(pa.array(texts, pa.string()))
    words, seen = part.joined(), 0
    tracemalloc.start()
    for a, b in part.spans():
        assert a == seen and (b == a + 1 or int(part.text_ends[b - 1] - (part.text_ends[a - 1] if a else 0)) <= 2_000)
        ids, (in_ids, in_bytes), seen = part.flat(a, b), part.digests(words, a, b), b
        if a < 3_000 or b == len(texts):
            wanted = [reference.encode_ordinary(t) for t in texts[a:b]]
            assert ids.tolist() == [i for x in wanted for i in x]
            assert in_ids == [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in wanted]
            assert in_bytes == [hashlib.sha256(t.encode()).hexdigest() for t in texts[a:b]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(texts) and peak < 8 * part.text_ends[-1]  # a span's own few arrays, of 160,000 ids in all


def test_bpe_query_and_odd_tables(spark, sf_dir, reference, odd, clashing, nothing, odd_texts):
    def digest(x):
        return hashlib.sha256(x).hexdigest()

    texts = {r["doc_id"]: r["text"] for r in documents_of(spark, sf_dir).collect()}
    for table, source in ((queries.op4_bpe_replay(spark, sf_dir), texts), (bpe_replay.encoded(odd, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), odd_texts)):
        for r in table.collect():
            text = source[r["doc_id"]]
            ids = reference.encode_ordinary(text)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest(text.encode()))
    assert bpe_replay.encoded(clashing, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 10
    assert bpe_replay.encoded(nothing, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# 5 and 10


def accuracy(rows, label):
    held = rows[rows.held_out]
    return (held.predicted == held[label]).mean()


def test_quality_classifier_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op5_quality_classifier(spark, sf_dir).join(common.labels(spark, sf_dir), "doc_id").toPandas()
    assert accuracy(rows, "quality") > 0.95 and rows.score.between(0, 1).all()
    assert rows.held_out.sum() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf_dir).join(common.labels(spark, sf_dir), "doc_id").toPandas()
    assert accuracy(rows, "toxic") > 0.95 and rows.score.between(0, 1).all()
    toxic = rows[rows.held_out & (rows.toxic == 1)]
    assert len(toxic) > 50 and toxic.predicted.mean() > 0.85  # most toxic rows are found, not only the many clean ones


@pytest.mark.parametrize("operator,column", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers_bear_odd_tables(spark, odd, clashing, nothing, operator, column):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], f"doc_id long, {column} int")
    for docs, n in ((odd, 10), (clashing, 10), (nothing, 0)):
        rows = operator.scored(docs, labels).toPandas()
        assert len(rows) == n and rows.score.between(0, 1).all()
    none = operator.scored(odd, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all()
    ones = operator.scored(odd, labels.withColumn(column, F.lit(1))).toPandas()
    assert (ones.score > 0.99).all()


def test_discriminant_equals_a_plain_version(spark, sf_dir):
    docs, labels = documents_of(spark, sf_dir), common.labels(spark, sf_dir)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    x = {k: np.array(quality_classifier.statistics(t)) for k, t in texts.items()}
    classes = [np.array([x[k] for k in sorted(x) if quality.get(k) == c and zlib.crc32(str(k).encode()) % 5]) for c in (0, 1)]
    spreads = [np.cov(c.T, bias=True) for c in classes]
    n = [len(c) for c in classes]
    pooled = (n[0] * spreads[0] + n[1] * spreads[1]) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    density = []
    for c, spread in zip(classes, spreads, strict=True):
        drawn = (0.2 * spread + 0.8 * pooled) / np.outer(scale, scale)
        drawn = 0.95 * drawn + 0.05 * max(1e-3, np.trace(drawn) / len(scale)) * np.eye(len(scale))
        density.append(lambda v, m=c.mean(axis=0), s=drawn, p=len(c) / sum(n): math.log(p) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * ((v - m) / scale) @ np.linalg.solve(s, (v - m) / scale))
    for r in queries.op5_quality_classifier(spark, sf_dir).collect():
        v = x[r["doc_id"]]
        expected = 1 / (1 + math.exp(min(500, density[0](v) - density[1](v))))
        assert r["score"] == pytest.approx(expected, abs=1e-6)


def test_network_equals_a_plain_forward_pass():
    texts = [b"", b"one", b"the cat and the dog", b"Der Hund, und die Katze!", b"le chat est dans la maison pour une nuit", b"x " * 40]
    net = toxicity.train(texts * 4, [i % 2 for i in range(24)], epochs=1)
    net.shift[:] = np.arange(len(net.shift)) / 10
    got, language = net.score(texts, toxicity.Hasher())
    assert got == pytest.approx([net.score([t], toxicity.Hasher())[0][0] for t in texts], abs=1e-6)  # each alone
    for text, score, spoken in zip(texts, got, language, strict=True):
        words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower())
        rows = [net.embed[zlib.crc32(w) % toxicity.SLOTS] + net.embed[toxicity.SLOTS + zlib.crc32(w.decode()[:4].encode()) % toxicity.SLOTS] for w in words]
        rows += [np.zeros(toxicity.WIDTH)] * max(toxicity.SPANS)
        hidden = []
        for h, w, b in zip(toxicity.SPANS, net.filters, net.biases, strict=True):
            # A window may begin at each word, and at the pad after the last.
            answers = [np.concatenate(rows[i : i + h]) @ w + b for i in range(len(words) + 1)]
            hidden += np.maximum(np.max(answers, axis=0), 0).tolist()
        says = [sum(w.decode() in own.split() for w in words) for own in toxicity._LANGUAGE.values()]
        assert spoken == (int(np.argmax(says)) if max(says) else len(says))
        assert score == pytest.approx(1 / (1 + math.exp(-(np.dot(hidden, net.out) + net.bias - net.shift[spoken]))), abs=1e-4)


@pytest.mark.parametrize("operator,column", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_repeated_labels_count_once(spark, sf_dir, operator, column):
    docs, labels = documents_of(spark, sf_dir), common.labels(spark, sf_dir).select("doc_id", column)
    again = labels.unionByName(labels.filter(f"{column} = 0")).unionByName(labels.filter(f"{column} = 0").withColumn(column, F.lit(1))).unionByName(labels.withColumn(column, F.lit(7)))
    one, two = (operator.scored(docs, x).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, again.repartition(5)))
    assert one == pytest.approx(two, abs=1e-9)


def test_training_texts_are_bounded_together(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOTAL", 1_000)
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(100)], "doc_id long, text string")
    rows = toxicity.sample(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))).collect()
    assert len(rows) == 10 and {r["toxic"] for r in rows} == {0, 1}


def test_score_column_equals_the_table(spark, sf_dir):
    docs = documents_of(spark, sf_dir)
    model = quality_classifier.train(quality_classifier.features(docs), common.labels(spark, sf_dir))
    both = docs.select("doc_id", quality_classifier.score_of(F.col("text"), model).alias("own")).join(quality_classifier.scored(docs, common.labels(spark, sf_dir)), "doc_id")
    assert both.filter(F.abs(F.col("own") - F.col("score")) > 1e-6).count() == 0


# 6


def test_unigram_counts(spark, sf_dir):
    docs = {r["doc_id"]: lm_scoring.folded_words((r["text"] or "").encode()) + [b"\n"] for r in documents_of(spark, sf_dir).collect()}
    counts = collections.Counter(w for k, words in docs.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in words)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op6_lm_scoring(spark, sf_dir).collect()
    for r in rows:
        words = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
    held = [r["bits_per_byte"] for r in rows if r["held_out"]]
    assert sum(held) / len(held) < 3.2


def mixer_of(words, logs=(10, 11, 12, 12), seed=0):
    counts = np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256)
    rng = np.random.default_rng(seed)
    states = rng.integers(0, 40, (2, lm_scoring.first_slots(logs)[-1])).astype(np.uint16)
    return lm_scoring.Mixer(lm_scoring.huffman(counts), states[0] << 8 | states[1], logs, rng.normal(0.3, 0.1, (lm_scoring.GATES, lm_scoring.CONTEXTS)))


def plain_score(mixer, words, text):
    """One bit after the other, with plain numbers."""
    bits = lm_scoring.decisions(words, mixer.code, mixer.logs)
    first, total = [0, *bits.ends.tolist()], 0.0
    for a in range(0, len(text), lm_scoring.STRETCH_WORDS):
        corpus, mine, own = 1.0, 0.0, [0.0] * (1 << lm_scoring.OWN_LOG)
        for word in text[a : a + lm_scoring.STRETCH_WORDS]:
            to_corpus, to_mine, new = 0.0, 0.0, {}
            for i in range(first[word], first[word + 1]):
                says, often = [], []
                for slots in bits.slots:
                    ones, zeros = (float(lm_scoring._LEVELS[int(mixer.states[slots[i]]) >> k & 255]) for k in (8, 0))
                    says.append(math.log((ones + 0.3) / (zeros + 0.3)))
                    often.append(ones + zeros >= 4)
                mixed = sum(w * x for w, x in zip(mixer.weights[often[1] + 2 * often[2] + 4 * often[3]], says, strict=True))
                sign, state = (1 if bits.turns[i] else -1), own[bits.own[i]]
                chance = 1 / (1 + math.exp(-sign * (corpus * mixed + mine * state)))
                total += math.log10(chance)
                to_corpus += (1 - chance) * sign * mixed
                to_mine += (1 - chance) * sign * state
                new[bits.own[i]] = state + lm_scoring.OWN_RATE * (4 * sign - state)
            corpus, mine = corpus + lm_scoring.RATE * to_corpus, mine + lm_scoring.RATE * to_mine
            for slot, state in new.items():
                own[slot] = state
    return total


def test_mixer_equals_a_plain_version(monkeypatch):
    monkeypatch.setattr(lm_scoring, "STRETCH_WORDS", 20)
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcdeor\xc3\xa9") for _ in range(rng.randrange(1, 9))) + b" " for _ in range(50)] + [b"\n"]
    mixer = mixer_of(words)
    texts = [np.array([*(rng.randrange(50) for _ in range(n)), 50]) for n in (0, 1, 7, 45, 19, 20)]
    got = mixer.ready().score(mixer.ready().words(words), texts)
    assert got == pytest.approx([plain_score(mixer, words, t.tolist()) for t in texts], rel=1e-3)
    assert mixer.ready().score(mixer.ready().words(words), texts[3:4]) == pytest.approx(got[3:4], rel=1e-6)  # each alone


def test_mixer_is_a_distribution():
    words = [bytes([b]) + b" " for b in range(256) if not bytes([b]).isspace() and not bytes([b]).isupper()]
    mixer = mixer_of(words)
    ready, table = mixer.ready(), mixer.ready().words([*words, b"\n"])
    # All texts of one one-byte word, and the empty one, have at most the whole probability.
    total = sum(10 ** ready.score(table, [np.array([i, len(words)]) for i in range(len(words))])) + 10 ** ready.score(table, [np.array([len(words)])])[0]
    assert 0 < total < 1


def test_learned_counts_and_weights(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    words = collections.Counter(rng.choice(stems) + rng.choice(["ing", "ed", "er"]) for _ in range(3000))
    table = spark.createDataFrame([(bytearray(w.encode()), n) for w, n in words.items()], "word binary, total long")
    spaced = [w.encode() + b" " for w in words]
    got = lm_scoring._trained(table, 10, len(words))
    bits = lm_scoring.decisions(spaced, got.code, got.logs)
    counts = np.zeros((2, lm_scoring.first_slots(got.logs)[-1]))
    times = np.repeat(list(words.values()), np.diff([0, *bits.ends]))
    for slots in bits.slots:
        np.add.at(counts, (bits.turns, slots), times)
    says = lm_scoring._looked_up(*(lm_scoring._LEVELS[lm_scoring.quantised(c)] for c in counts[::-1]))
    assert np.array_equal(got.states[: counts.shape[1]], says)
    start = lm_scoring.Mixer(got.code, got.states, got.logs)
    text = [np.array([*(rng.randrange(len(spaced)) for _ in range(200)), len(spaced)])]
    assert got.score(got.words([*spaced, b"\n"]), text)[0] > start.score(start.words([*spaced, b"\n"]), text)[0]  # learned weights are better


def test_states_grow_with_the_corpus(spark):
    for n, log in ((1_000, lm_scoring.LEAST_LOG), (100_000, 19)):
        table = spark.range(n).select(F.hex(F.xxhash64("id")).cast("binary").alias("word"), F.lit(1).cast("long").alias("total"))
        assert lm_scoring._trained(table, 1, n).logs == (*lm_scoring.SLOTS_LOG, log)


def test_lm_bears_odd_tables(spark, odd, clashing, nothing):
    for docs, n in ((odd, 10), (clashing, 10), (nothing, 0)):
        rows = lm_scoring.scored(docs).toPandas()
        assert len(rows) == n and (rows.score <= 0).all() and (rows.base_score <= 0).all()
    held = spark.createDataFrame([(i, "only held out") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    rows = lm_scoring.scored(held).toPandas()
    assert (rows.train_tokens == 0).all() and (rows.n_known == 0).all() and (rows.base_score == 0).all()


# 7


def brute_links(texts):
    """texts: id to text. Links between different texts and the components of copies and links."""
    by_text = collections.defaultdict(list)
    for k, t in texts.items():
        by_text[t].append(k)
    unique = list(by_text)
    sets = []
    for t in unique:
        w = t.encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent, links = list(range(len(unique))), collections.Counter()

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(unique)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, t in enumerate(unique):
        groups[root(i)] += by_text[t]
    return {k: (min(by_text[t]), min(groups[root(i)]), links[i]) for i, t in enumerate(unique) for k in by_text[t]}


def test_join_equals_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = {r["doc_id"]: r["text"] for r in documents_of(spark, sf_dir).collect()}
    for i in range(40):  # a group of near copies, over several blocks
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        texts[10_000 + i] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["text_id"], r["class_id"], r["n_links"]) for r in jaccard_join.joined(table).collect()}
    assert got == brute_links(texts)


def test_join_bounds_its_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 8_000)
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 10)
    rng = random.Random(6)
    texts = {}
    for first, n_words, n in ((0, 100, 120), (1_000, 900, 5), (2_000, 60, 4)):  # short ones, long ones, a bucket that is not hot
        base = [f"w{rng.randrange(500)}" for _ in range(n_words)]
        for i in range(n):
            words = list(base)
            words[rng.randrange(n_words)] = f"x{i}"
            texts[first + i] = " ".join(words)
    texts |= {3_000: texts[1_000] + " end", 3_001: texts[0] + " end"}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces, work = [], jaccard_join._work
    monkeypatch.setattr(jaccard_join, "_work", lambda *a: pieces.append(work(*a)) or pieces[0])
    got = {r["doc_id"]: (r["text_id"], r["class_id"], r["n_links"]) for r in jaccard_join.joined(table).collect()}
    assert got == brute_links(texts)
    largest = pieces[0].groupBy("piece").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0]
    assert largest < 4 * 8_000 < sum(len(t) for k, t in texts.items() if k < 1_000)


def test_hot_buckets_are_linked_to_their_least(spark, monkeypatch):
    trie = [bytes([i]) * 2 * jaccard_join.DEPTH for i in (7, 8)]
    rows = spark.createDataFrame([(i, bytearray(64), [bytearray(trie[0])]) for i in range(30)] + [(100 + i, bytearray(64), [bytearray(trie[1])]) for i in range(3)], "node long, signature binary, tries array<binary>")
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 10)
    monkeypatch.setattr(jaccard_join, "spanning", lambda n, linked: [(n, n)] if n > 10 else [(0, i) for i in range(1, n)])  # fails if it sees a hot bucket
    got = sorted((min(r), max(r)) for r in jaccard_join._candidates(rows, 0.8).collect())
    assert got[:29] == [(0, i) for i in range(1, 30)] and len(got) == 31 and all(a >= 100 for a, _ in got[29:])


def test_join_bears_odd_tables(spark, odd, clashing, nothing):
    rows = jaccard_join.joined(odd).collect()
    assert len(rows) == 10 and {r["class_id"] for r in rows if r["doc_id"] in (0, 4)} == {0}
    assert [(r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is None] == [(None, 0)]
    assert {r["class_id"] for r in rows if r["doc_id"] in (1, 2, 5)} == {1}  # texts without words share one shingle
    assert jaccard_join.joined(clashing).count() == 10 and jaccard_join.joined(nothing).count() == 0


def test_texts_that_share_a_doc_id_have_links_of_their_own(spark):
    rng = random.Random(11)
    make = lambda: [f"w{rng.randrange(900)}" for _ in range(60)]
    near = lambda words, i: " ".join([*words[:-1], f"end{i}"])
    bases = [make() for _ in range(12)]
    rows = [(rng.choice([1, 2, 3, 3, 3, 50, None]), near(bases[rng.randrange(12)], rng.randrange(6))) for _ in range(120)]
    rows += [(3, "a z"), (5, "a"), (5, "b"), (9, None), (9, "")]
    texts = {t or "": k for k, t in rows if k is not None}
    brute = brute_links({i: t for i, t in enumerate(texts)})  # by number of the text
    numbers = {t: i for i, t in enumerate(texts)}
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_md5=True).collect()
    assert len(got) == len(rows)
    by_md5 = {hashlib.md5(t.encode()).digest(): i for t, i in numbers.items()}
    classes, firsts = collections.defaultdict(set), collections.defaultdict(set)
    for r in got:
        if r["doc_id"] is None:
            assert r["class_id"] is None and r["n_links"] == 0
            continue
        i = by_md5[bytes(r["text_md5"])]
        assert r["n_links"] == brute[i][2] and r["text_id"] == min(k for k, t in rows if k is not None and numbers[t or ""] == i)
        classes[r["class_id"]].add(brute[i][1])
        if r["is_first"]:
            firsts[r["class_id"]].add(i)
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len({c for _, c, _ in brute.values()})
    assert all(len(firsts[c]) == 1 for c in classes)


def test_prefixes_are_shortened_to_the_recall():
    at = jaccard_join.prefix_length
    assert at({64: 10}, 0.8) == jaccard_join.DEPTH and at({}, 0.8) == at({52: 1000}, 0.8) == 3
    lengths = [at({64: 1000, 52: n}, 0.8) for n in (0, 1, 100, 10_000)]
    assert lengths == sorted(lengths, reverse=True) and len(set(lengths)) > 1  # more links at the threshold, shorter prefixes
    assert jaccard_join.meets(0.8, at({}, 0.8)) > 0.9999


def test_inner_nodes_of_a_trie():
    labels = np.array(sorted([[1, 1, 1, 1, 1, 1], [1, 1, 1, 1, 1, 1], [1, 1, 1, 2, 1, 1], [1, 1, 1, 2, 1, 3], [1, 1, 2, 1, 1, 1], [4, 4, 4, 4, 4, 4]]))
    assert sorted(jaccard_join.levels(labels)) == [(3, 0, 4), (5, 2, 4), (6, 0, 2)]


def test_join_finds_the_links_of_a_query_set(spark):
    """All links of the ids divisible by 50, against every text and planted near copies of similarity about 0.75 to 1,
    found by an inverted index of shingles."""
    rng, words = random.Random(8), jaccard_join.WORDS
    texts = {r["doc_id"]: (r["text"] or "") for r in documents_of(spark, "/root/testdata/sf0.1").collect()}
    for k in [k for k in texts if k % 50 == 0]:
        for copy in (1, 2, 3):
            own = texts[k].split()
            for _ in range(rng.randrange(max(1, len(own) // 30)) + 1 if own else 0):
                own[rng.randrange(len(own))] = f"planted{rng.randrange(99)}"
            texts[copy * 1_000_000 + k + 1] = " ".join(own)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    sets, index = {}, collections.defaultdict(list)
    for t in set(texts.values()):
        w = t.split()
        sets[t] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
        for x in sets[t]:
            index[x].append(t)
    expected = {}
    for k, t in texts.items():
        if k % 50 == 0:
            common = collections.Counter(o for x in sets[t] for o in index[x] if o != t)
            expected[k] = sum(5 * n >= 4 * (len(sets[t]) + len(sets[o]) - n) for o, n in common.items())
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.joined(table).filter("doc_id % 50 = 0").collect()}
    assert got == expected and sum(expected.values()) > 300


# 8


def test_templates():
    scanner = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES)
    labels = lambda t: scanner.scan(t.encode())[5]
    assert labels("Released under the MIT License.") == "mit" == labels("released under the terms of the MIT license")
    assert labels("released under the terms of MIT license") == "" == labels("released under MIT license")
    assert labels("Licensed under CC BY-NC 4.0.") == "cc,cc-by" and labels("Licensed under the Apache License, Version 2.0.") == "apache"
    assert labels("Copyright (c) 2020 Some Body. All rights reserved.") == "copyright,reserved"
    assert labels("licensed under the GNU General Public License, version 3") == "gpl,gpl-line"
    assert scanner.scan(b"cc by x CC-BY y")[:4] == (6, 2, 0, 3)
    for bad in ("<<optional>> a", "<<any:0-2>> b", "<<optional>>a<<end>>"):
        with pytest.raises(ValueError):
            license_scan.compile_template("bad", bad)


def test_whole_licenses():
    scanner = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES)
    for label in ("bsd-text", "isc-text", "mit-text", "boost-text", "unlicense-text", "zlib-text", "apache-header", "gpl-header", "mpl-header"):
        template = license_scan.TEMPLATES[label]
        full = re.sub(r"<<any:\d+-\d+>>", "Some, Body", re.sub(r"<<(optional|end)>>", " ", template))
        least = template
        while "<<optional>>" in least:  # the innermost optional parts first
            least = re.sub(r"<<optional>>((?!<<optional>>).)*?<<end>>", " ", least)
        for text in (full, re.sub(r"<<any:\d+-\d+>>", "(Somebody)", least)):
            assert label in scanner.scan(("Copyright 2020.\n" + text.upper() + ".").encode())[5].split(",")
            words = text.split()
            for i in (3, 9, len(words) - 1):  # other wording in place of a mandatory word
                assert label not in scanner.scan(" ".join([*words[:i], "otherwise", "not", *words[i + 1 :]]).encode())[5].split(",")
            assert label not in scanner.scan(" ".join(words[:-1]).encode())[5].split(",")


def test_score_is_the_share_of_license_wording():
    scanner = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES)
    zlib_text = re.sub(r"<<any:\d+-\d+>>", "authors", re.sub(r"<<(optional|end)>>", " ", license_scan.TEMPLATES["zlib-text"]))
    score = lambda t: scanner.scan(t.encode())[6]
    whole, half = score(zlib_text), score(zlib_text + " word" * len(zlib_text.split()))
    assert 0.9 < whole <= 1 and abs(half - whole / 2) < 0.01
    assert score(zlib_text.replace("misrepresented", "presented")) == 0 == score("")
    assert score("cc by") == 1 and score("cc by and ten other words that are not of any license") == 2 / 12


def test_license_scan_of_odd_tables_with_phrases(spark):
    notice = "released under the MIT License"
    rows = [(1, None), (1, ""), (2, "CC BY"), (2, "CC BY"), (3, "cc\n\n by, cc-by; CC"), (4, notice + " x" * 300_000 + " all rights reserved"), (None, "General Public License"), (5, "cc bye accby"), (6, "cc\u00a0by")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"labels": F.lit("x"), "score": F.lit("y"), "n_base": F.lit("z")})
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in license_scan.scanned(table.repartition(3)).collect())
    expected = [("1", 0, 0, None, None, "", ""), ("1", 0, 0, None, None, "", ""), ("2", 2, 1, 0, 0, "cc-by", "cc-by"), ("2", 2, 1, 0, 0, "cc-by", "cc-by"), ("3", 5, 2, 0, 2, "cc-by", "cc-by"), ("4", 300_008, 1, 300_005, 300_005, "reserved", "mit,reserved"), ("5", 3, 0, None, None, "", ""), ("6", 1, 0, None, None, "", ""), ("None", 3, 1, 0, 0, "gpl", "gpl")]
    assert got == expected


def test_license_scan_bears_odd_tables(odd, clashing, nothing):
    rows = license_scan.scanned(odd).collect()
    assert len(rows) == 10 and all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" and r["score"] == 0 for r in rows)
    assert license_scan.scanned(clashing).count() == 10 and license_scan.scanned(nothing).count() == 0


# 9


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 90)
    rng = np.random.default_rng(3)
    vectors = [(i, v) for i, v in enumerate(rng.normal(0, 0.3, (300, 12)).astype(np.float32).tolist())]
    vectors += [(500, vectors[7][1]), (400, vectors[7][1]), (600, None), (700, [float("nan")] * 12), (800, [None] * 12), (900, [float("inf")] * 12), (1000, [1e9] * 12), (1100, [1.0, 2.0]), (1200, []), (None, [0.1] * 12)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "rank": F.lit("y"), "v": F.lit(1), "block": F.lit(2)})
    got = collections.defaultdict(list)
    for r in topk_search.top_k(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        assert got.get(q, []) == [(i, -s) for s, i in scores[:10]]
    assert set(got) <= set(whole)
    assert topk_search.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_takes_large_vectors_and_repeated_queries(spark):
    rng = random.Random(9)
    vectors = [(100, [1e13, 3.0]), (100, [1e13, 3.0]), (1, [-1e300 / 1e280, 0.5]), (2, [8.9e12, -1.0]), (3, [0.5, 0.25]), (200, [0.1, -0.2])] + [(10 + i, [rng.uniform(-1e9, 1e9), rng.uniform(-1, 1)]) for i in range(40)]
    wide = [(1000 + i, [float(rng.randrange(1 << 23)) / 1024 for _ in range(512)]) for i in range(30)]
    whole = lambda v: [math.floor(1024 * x) for x in v]
    for rows in (vectors, wide):
        expected = []
        for i, (q, v) in enumerate(rows):
            if q % 100 == 0:
                scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole(v), whole(u), strict=True)))), c) for j, (c, u) in enumerate(rows) if j != i)
                expected += [(q, rank + 1, c, -s) for rank, (s, c) in enumerate(scores[:10])]
        got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 100 == 0)
        assert sorted(map(tuple, got.collect())) == sorted(expected)


# The pipeline


def test_pipeline_equals_a_plain_version(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = documents_of(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs}
    kept = {r["doc_id"] for r in queries.op5_quality_classifier(spark, sf_dir).collect() if r["predicted"]}
    rules = {r["doc_id"]: r["cleaned"] for r in quality_rules.scored(documents_of(spark, sf_dir)).collect() if r["kept"]}
    clean = {k: rules[k] for k in kept if k in rules}
    single = {k for k, (_, c, _) in brute_links(clean).items() if c == k}
    sources = {r["doc_id"]: r["source"] for r in docs}
    table = spark.createDataFrame([(k, clean[k], sources[k]) for k in single], "doc_id long, text string, source string")
    sized = table.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.md5("text").alias("tie"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(sized).collect()}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_replay.Ranks(vocabulary("byte_bpe_50k.tiktoken")).ids, special_tokens={})
    expected = sorted((k, tuple(reference.encode_ordinary(clean[k]))) for k, n in copies.items() for _ in range(n))
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect()) == expected
    assert len(expected) > 20 and texts


def test_one_row_of_each_class_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b), (8, c), (8, a)]
    got = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got)) == [(1, a), (5, b), (8, c)]


def test_no_text_is_lost_for_a_shared_doc_id(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(3, base + " z"), (5, base), (5, "b")]
    got = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got)) == [(3, base + " z"), (5, "b")]


def test_stages_bear_odd_tables(spark, odd, clashing):
    for docs in (odd, clashing):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == corpus_pipeline.STAGES[-1][0] or got.columns == docs.columns
            assert got.count() >= (0 if name == "quality rules" else 1)
            assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_stages_keep_the_columns(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text"))
    for _, stage in corpus_pipeline.STAGES[:1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
