"""Chat formatting: a finite-state machine over roles turns conversations into text segments with a loss flag each."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import column_of

CHUNK_CHARS = 1 << 20  # formatted characters in a row of the output, about; a row ends with a turn
_BATCH_CHARS = 4 << 20


@dataclass(frozen=True)
class Mark:
    """Control strings around a turn's text, and whether a model is trained on that text."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A format, declared: how each role's turns are marked, and which role may follow which.

    ``order`` maps the role before ('' at the start) to the roles that may follow; ``final`` are the roles that may come last.
    A role without a mark is written in ``other``, its name before ``says``. Control strings begin with a character that
    stands nowhere else in any of them, and none is the beginning of another: so a mark can't arise where a text and a mark meet.
    """

    begins: str = "<s>"
    marks: dict[str, Mark] = field(default_factory=lambda: {"system": Mark("[SYS]", "[/SYS]"), "user": Mark("[INST]", "[/INST]"), "assistant": Mark("[ANS]", "</s>", loss=True)})
    other: Mark = Mark("[ROLE]", "[/ROLE]")
    says: str = "[SAYS]"
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        controls = self.controls()
        heads = {c[:1] for c in controls}
        for c in controls:
            if len(c) < 2 or "\\" in c or heads & set(c[1:]):
                raise ValueError(f"no control string: {c!r}")
            if any(d.startswith(c) for d in controls if d is not c):
                raise ValueError(f"{c!r} begins another control string")
        if "" in self.marks:
            raise ValueError("a role needs a name")

    def controls(self) -> list[str]:
        closes = dict.fromkeys(m.closes for m in (*self.marks.values(), self.other))  # roles may share how they close
        return [self.begins, self.says, *closes, *[m.opens for m in (*self.marks.values(), self.other)]]


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def escaped(text: Column, template: Template) -> Column:
    """Reversible: a backslash is doubled, and one stands behind the first character of what would read as a control string."""
    heads = dict.fromkeys(c[0] for c in template.controls())
    parts = [f"{_quoted(h)}(?={'|'.join(_quoted(c[1:]) for c in template.controls() if c[0] == h)})" for h in heads]
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, F.lit("|".join(parts)), F.lit(r"$0\\"))


_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])


def formatted(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Rows (conv_id, chunk, last, segments, n_turns, first_bad) from rows (conv_id, turn, role, text).

    A conversation is a row; one of over about CHUNK_CHARS characters has further ones, numbered by ``chunk``, with ``last``
    on its last. ``segments`` are (text, loss): put together they are the formatted conversation, and ``loss`` is true for
    exactly the texts to be learned. The machine's state is the role before; ``first_bad`` is the place (from 0) of the first turn whose
    role may not follow it, n_turns if the conversation ends in a role that may not be last, and null if the order is
    valid. Turns in a wrong order are formatted like others.

    Turns stand by ``turn``, null first, ties by role and then text; repeated rows are turns of their own. A null text or role counts as
    empty; a null conv_id is a conversation of its own. Extra columns are ignored; no rows give none. Texts are escaped
    before the shuffle, so that work on a long conversation is spread; what one task does with it is to put it together,
    holding no more than a chunk.
    """
    template = template or Template()
    marks, other, order, final = template.marks, template.other, template.order, template.final
    slim = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "text")
    slim = slim.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.when(~F.col("role").isin(*marks), escaped(F.col("role"), template)).alias("name"), escaped(F.col("text"), template).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0  # characters in out and in segments
        now: tuple = ()
        segments: list[dict] = []
        chunk = size = place = 0
        state, bad = "", None

        def end(last: bool) -> None:
            nonlocal segments, chunk, size
            wrong = place if last and bad is None and state not in final else bad
            out.append((*now, chunk, last, segments, place, wrong))
            segments, chunk, size = [], chunk + 1, 0

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(SEGMENT), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "chunk", "last", "segments", "n_turns", "first_bad"])

        for batch in batches:
            for conv, role, name, text in zip(*[column_of(batch, c) for c in ("conv_id", "role", "name", "text")], strict=True):
                if now != (conv,):
                    if now:
                        end(True)
                    now, chunk, place, state, bad = (conv,), 0, 0, "", None
                    segments, size = [{"text": template.begins, "loss": False}], len(template.begins)
                if bad is None and role not in order.get(state, ()):
                    bad = place
                mark = marks.get(role, other)
                opens = mark.opens if name is None else f"{mark.opens}{name}{template.says}"
                segments += [{"text": opens, "loss": False}, {"text": text, "loss": mark.loss}, {"text": mark.closes, "loss": False}]
                n = len(opens) + len(text) + len(mark.closes)
                size, held, place, state = size + n, held + n, place + 1, role
                if size >= CHUNK_CHARS:
                    end(False)
                if held >= _BATCH_CHARS and out:
                    yield batch_of()
                    out, held = [], size
        if now:
            end(True)
        if out:
            yield batch_of()

    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "name", "text").mapInArrow(build, "conv_id long, chunk int, last boolean, segments array<struct<text: string, loss: boolean>>, n_turns long, first_bad long")


def turns_of(text: str, template: Template) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text, or of a part of it that ends with a turn."""
    controls = sorted(template.controls(), key=len, reverse=True)
    pieces = re.split(f"({'|'.join(map(re.escape, controls))})", text)
    roles = {m.opens: role for role, m in template.marks.items()}
    at = 1
    while at < len(pieces):
        if pieces[at] == template.begins:
            at += 2
            continue
        if pieces[at] == template.other.opens:
            role, closes, at = unescaped(pieces[at + 1]), template.other.closes, at + 2
            if pieces[at] != template.says:
                raise ValueError("a role without what it says")
        else:
            role = roles[pieces[at]]
            closes = template.marks[role].closes
        if pieces[at + 2] != closes:
            raise ValueError("a turn that does not close")
        yield role, unescaped(pieces[at + 1])
        at += 4


def digests(output: DataFrame, template: Template | None = None) -> DataFrame:
    """From the output of :func:`formatted`, by its text and mask alone, one row for each conversation: conv_id, n_turns,
    turns_sha256 (of role, newline, text, newline for each turn), loss_chars and loss_sha256 (code points and digest of all text under the
    loss mask, unescaped), formatted_chars, first_bad.

    Conversations in a single row are read where they lie; only the rows of longer ones are brought together, and one
    after the other is held.
    """
    template = template or Template()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, losses = hashlib.sha256(), hashlib.sha256()
        n_turns = n_loss = n_all = 0
        for batch in batches:
            out = []
            for conv, chunk, last, segments, bad in zip(*[column_of(batch, c) for c in ("conv_id", "chunk", "last", "segments", "first_bad")], strict=True):
                if chunk == 0:
                    turns, losses, n_turns, n_loss, n_all = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                whole = "".join(s["text"] for s in segments)
                n_all += len(whole)
                for role, text in turns_of(whole, template):
                    turns.update(f"{role}\n{text}\n".encode())
                    n_turns += 1
                under = unescaped("".join(s["text"] for s in segments if s["loss"]))
                losses.update(under.encode())
                n_loss += len(under)
                if last:
                    out.append((conv, n_turns, turns.hexdigest(), n_loss, losses.hexdigest(), n_all, bad))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "first_bad"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, first_bad long"
    slim = output.select("conv_id", "chunk", "last", "segments", "first_bad")
    single = (F.col("chunk") == 0) & F.col("last")
    longer = slim.filter(~single).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return slim.filter(single).mapInArrow(read, schema).unionByName(longer.mapInArrow(read, schema))


def oracle_sql(view: str, template: Template | None = None) -> str:
    """The rows of :func:`digests` in SQL, over a view of conv_id, turn, role and text."""
    template = template or Template()
    marks, other = template.marks, template.other

    def longer(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for c in template.controls():
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return f"length({out})"

    around = " ".join(f"WHEN '{r}' THEN {len(m.opens + m.closes)}" for r, m in marks.items())
    other_len = f"{len(other.opens + template.says + other.closes)} + {longer('role')}"
    follows = " OR ".join(f"(before = '{b}' AND role IN ({', '.join(repr(r) for r in after)}))" for b, after in template.order.items())
    loss = ", ".join(repr(r) for r, m in marks.items() if m.loss)
    final = ", ".join(map(repr, template.final))
    learned = f"coalesce(string_agg(text, '' ORDER BY place) FILTER (role IN ({loss})), '')"
    return f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({view})),
placed AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(lag(role) OVER w, '') AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM rows
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (SELECT *, CASE WHEN NOT ({follows}) THEN place WHEN place = n - 1 AND role NOT IN ({final}) THEN n END AS bad, CASE role {around} ELSE {other_len} END + {longer("text")} AS chars FROM placed)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role IN ({loss})), 0)::BIGINT AS loss_chars,
    sha256({learned}) AS loss_sha256, (sum(chars) + {len(template.begins)})::BIGINT AS formatted_chars, min(bad)::BIGINT AS first_bad FROM judged GROUP BY conv_id
"""
