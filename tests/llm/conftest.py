"""Tables with the cases that every operator must bear."""

import pytest

LONG = "Lang wie die Reise war sie doch schön. " * 4000
CASES = [
    (0, "The quick brown fox jumps over the lazy dog, and then it sleeps all day long in the sun. " * 3, "en", "a"),
    (1, "", "en", "a"),
    (2, None, None, None),
    (3, LONG, "de", "b"),
    (4, "The quick brown fox jumps over the lazy dog, and then it sleeps all day long in the sun. " * 3, "en", "a"),
    (4, "The quick brown fox jumps over the lazy dog, and then it sleeps all day long in the sun. " * 3, "en", "a"),
    (5, " \n\t\r\x0b\x0c ", "en", "c"),
    (6, "naïve Ünïcödé 漢字 🙂 \x00\x1c   end", None, "c"),
    (None, "no id but a text", "en", None),
    (7, "one\none\ntwo\n\none", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows."""
    return spark.createDataFrame(CASES, SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    return {k: t or "" for k, t, *_ in CASES}


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names that operators give."""
    from pyspark.sql import functions as F

    names = "size source_size target copies score predicted held_out n_words kept cleaned labels n_tokens ids key run rank first offset tie row copy word code chunk node block piece n_links class_id".split()
    return odd.withColumns({n: F.lit("x") for n in names})
