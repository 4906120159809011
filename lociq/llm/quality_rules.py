"""Line-first cleaning, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import SPACE, WORD

SYMBOLS = "#*$%&|<>"
_SPACES = r"\x20\x09-\x0D"
WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
MOST_LOST = 40  # per cent of the characters in words that the line rules may remove

#: A line fails as boilerplate if it has one of these in its lower-cased text.
BOILERPLATE = (
    "lorem ipsum", "javascript is disabled", "enable javascript", "use of cookies", "cookie policy", "privacy policy",
    "terms of use", "terms of service", "click here", "read more", "sign up for our newsletter", "share this page", "powered by",
)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Words of a text. White space becomes single characters first, so that the cut needs no regular expression."""
    spaced = F.coalesce(text, F.lit(""))
    for c in SPACE[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def repeated_words(words: Column) -> Column:
    """How many words stand in an 8-word window found twice or more in the text.

    Hashes of two words make hashes of four and these of eight. A text whose four-word windows are all different has
    no repeated window of eight.
    """

    def covered(starts: Column) -> Column:
        """Words in the windows at ``starts`` (ascending): each adds what lies before the next one."""
        gaps = F.transform(starts, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - at, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def starts_of(hashes: Column) -> Column:
        places = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return _let(
            F.array_sort(places),
            lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["at"])),
        )

    def joined(parts: Column, words_each: int) -> Column:
        """Hashes of windows twice as long as those of ``parts``."""
        n = F.size(parts) - words_each
        return F.zip_with(F.slice(parts, 1, n), F.slice(parts, words_each + 1, n), lambda a, b: F.xxhash64(a, b))

    def different(hashes: Column) -> Column:
        return F.size(F.array_distinct(hashes)) == F.size(hashes)

    def of_eight(hashes: Column) -> Column:
        return _let(joined(hashes, WINDOW // 2), lambda h: F.when(different(h), F.lit(0)).otherwise(_let(starts_of(h), covered)))

    of_four = joined(joined(words, 1), 2)
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(of_four, lambda h: F.when(different(h), F.lit(0)).otherwise(of_eight(h))))


_BARS = "|>\xBB\xB7•/-"


def _has_phrase(text: Column) -> Column:
    def any_of(lower: Column) -> Column:
        found = F.lit(False)
        for p in BOILERPLATE:
            found = found | lower.contains(p)
        return found

    return _let(F.lower(text), any_of)


def line_fails(line: Column) -> Column:
    """A line with words fails by one of three rules: punctuation (symbols are more than a tenth of its
    characters, or a tenth of them are exclamation or question marks), navigation (three or more of its words are lone separators, and
    more than one in five) or boilerplate (one of the listed phrases)."""
    chars = F.length(line) - _count(line, _SPACES)
    bars = F.regexp_count(line, F.lit(rf"(?:^|[ \t])[{_BARS}](?=[ \t]|\z)"))
    navigation = _let(bars, lambda n: (n >= 3) & (5 * n > F.regexp_count(line, F.lit(WORD))))
    return (10 * _count(line, SYMBOLS) > chars) | (10 * _count(line, "!?") > chars) | navigation | _has_phrase(line)


def may_fail(text: Column) -> Column:
    """False only if no line of the text can fail: it has no symbol, no exclamation or question mark, no lone
    separator and no listed phrase."""
    return text.rlike(rf"[{SYMBOLS}!?]|(?:^|[ \t\n])[{_BARS}](?:[ \t\n]|\z)") | _has_phrase(text)


def scored(docs: DataFrame) -> DataFrame:
    """``docs`` with the base figures, base_failed, cleaned (the text without failing lines), lost_chars and kept.

    Lines that fail a rule are removed; lines without words stay and count nothing. A document is rejected if base_failed (fewer than 20 words, or more than 30 % of them in repeated 8-word
    windows) or if the removed lines held more than 40 % of its characters in words. Null texts are empty, and so
    rejected. Columns of ``docs`` with the name of a new one are replaced. Every row gives one row, repeated ones too;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    with_words = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE)) != "")
    of_words = _let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).cast("long").alias("r")))
    of_lines = _let(with_words, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    lost = F.aggregate(F.filter(with_words, line_fails), F.lit(0), lambda a, x: a + F.length(x) - _count(x, _SPACES))
    rows = docs.withColumn("n_repeat_words", of_words)
    rows = rows.withColumns({
        "n_words": F.col("n_repeat_words")["n"],
        "word_chars": F.col("n_repeat_words")["chars"],
        "n_symbols": _count(text, SYMBOLS).cast("long"),
        "n_dup_lines": of_lines,
        "lost_chars": F.when(may_fail(text), lost).otherwise(0).cast("long"),
        "cleaned": F.when(may_fail(text), F.array_join(F.filter(lines, lambda x: (F.btrim(x, F.lit(SPACE)) == "") | ~line_fails(x)), "\n")).otherwise(text),
    }).withColumn("n_repeat_words", F.col("n_repeat_words")["r"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~failed & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")

_FAILS = " OR ".join([
    "10 * (length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')) - length(regexp_replace(l, '[\\x20\\x09-\\x0D#*$%&|<>]', '', 'g'))) > length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g'))",
    "10 * (length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')) - length(regexp_replace(l, '[\\x20\\x09-\\x0D!?]', '', 'g'))) > length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g'))",
    "(len(list_filter(string_split_regex(l, '[ \\t]'), lambda w: w IN ('|', '>', '»', '·', '•', '/', '-'))) >= 3 AND 5 * len(list_filter(string_split_regex(l, '[ \\t]'), lambda w: w IN ('|', '>', '»', '·', '•', '/', '-'))) > len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')))",
    *[f"contains(lower(l), '{p}')" for p in BOILERPLATE],
])

ORACLE = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM texts),
windows AS (SELECT r, i, list_slice(w, i, i + 7) AS ws FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
doubled AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, ws) AS n FROM windows) WHERE n >= 2),
repeats AS (SELECT r, sum(least(8, coalesce(later - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS later FROM doubled) GROUP BY r),
counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    coalesce(list_sum(list_transform(list_filter(ls, lambda l: {_FAILS}), lambda l: length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')))), 0)::BIGINT AS lost_chars
    FROM split LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept, lost_chars FROM judged
"""
