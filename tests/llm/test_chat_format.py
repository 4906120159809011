"""Chat formatting against a plain version, and on odd tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lociq.llm import chat_format
from lociq.llm.chat_format import Mark, Template

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[\\INST]", "[[INST]", "<</s>", "[", "<", "[/", "a[SAYS]b[ROLE]", "", "two\nlines", "\x00é漢🙂", "$0 \\1 \\\\"]
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "[ANS]hello</s>"),
    (2, 0, "user", NASTY[0]), (2, 1, "user", "again"), (2, 2, "assistant", NASTY[1]),
    (3, 0, "assistant", "first"), (4, 0, "user", "unanswered"),
    (5, 5, "user", None), (5, 9, None, "nobody"), (5, 9, "tool[/ROLE]", "[SAYS]"), (5, None, "Assistant", "no loss"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "still no id"),
    (6, 0, "user", "twice"), (6, 0, "user", "twice"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows, template):
    found, out = {}, {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in found.items():
        turns = [t[2:] for t in sorted(turns)]
        learned = "".join(t for r, t in turns if r in template.marks and template.marks[r].loss)
        state, bad = "", None
        for i, (r, _) in enumerate(turns):
            if bad is None and r not in template.order.get(state, ()):
                bad = i
            state = r
        bad = len(turns) if bad is None and state not in template.final else bad
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned), bad)
    return out


def digested(spark, rows, template=None, extra=False):
    table = spark.createDataFrame(rows, SCHEMA)
    if extra:
        table = table.withColumns({n: F.lit("x") for n in ("chunk", "last", "segments", "name", "n_turns", "place", "loss")})
    out = chat_format.formatted(table, template)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["first_bad"]) for r in chat_format.digests(out, template).collect()}, out


@pytest.mark.parametrize("chunk", [1, 20, 1 << 20])
def test_equals_a_plain_version(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat_format, "CHUNK_CHARS", chunk)
    rows = ROWS + [(10 + i, j, ("user", "assistant", "other" + t)[j % 3], t) for i, t in enumerate(NASTY) for j in range(6)]
    got, out = digested(spark, rows, extra=True)
    assert got == expected(rows, Template())
    assert (out.count() > len(got)) == (chunk < 1 << 20)


def test_text_and_mask(spark):
    _, out = digested(spark, ROWS[:3] + [(7, 0, "tool", "x")])
    by = {r["conv_id"]: r["segments"] for r in out.collect()}
    assert "".join(s["text"] for s in by[1]) == "<s>[SYS]be kind[/SYS][INST]hi[/INST][ANS][\\ANS]hello<\\/s></s>"
    assert [s["text"] for s in by[1] if s["loss"]] == ["[\\ANS]hello<\\/s>"]
    assert "".join(s["text"] for s in by[7]) == "<s>[ROLE]tool[SAYS]x[/ROLE]"


def test_another_template(spark):
    template = Template(begins="{begin}", marks={"human": Mark("{human}", "{end}"), "bot": Mark("{bot}", "{end}", loss=True)}, other=Mark("{role}", "{/role}"), says="{says}", order={"": ("bot",), "bot": ("human",), "human": ("bot",)}, final=("human",))
    rows = [(1, 0, "bot", "{bot}{"), (1, 1, "human", "a{end}"), (2, 0, "user", "{"), (3, 0, "bot", "")]
    got, _ = digested(spark, rows, template)
    assert got == expected(rows, template) and got[1][4] is None and got[2][4] == 0 and got[3][4] == 1


@pytest.mark.parametrize("bad", [{"begins": "<"}, {"says": "[SYS]x"}, {"says": "[a[b]"}, {"begins": "\\s"}])
def test_templates_that_could_be_read_in_two_ways_are_refused(bad):
    with pytest.raises(ValueError, match="control string"):
        Template(**bad)


def test_nothing(spark):
    assert digested(spark, [])[0] == {}


def test_broken_output_is_refused():
    with pytest.raises((ValueError, IndexError)):
        list(chat_format.turns_of("<s>[INST]a", Template()))
    with pytest.raises(ValueError, match="close"):
        list(chat_format.turns_of("<s>[INST]a[/SYS]", Template()))


def test_a_very_long_conversation_stays_in_small_rows(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "word " * 2000) for i in range(600)]
    got, out = digested(spark, rows)
    assert got == expected(rows, Template())
    assert max(r["n"] for r in out.select(F.expr("aggregate(segments, 0, (a, s) -> a + length(s.text))").alias("n")).collect()) < chat_format.CHUNK_CHARS + 20_000
