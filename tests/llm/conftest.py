from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _fp string, sid long, kept string, c0 string"


def docs(spark, rows):
    """Documents (doc_id, text, lang, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", 7, "y", "z") for i, t, lang, src in rows], SCHEMA)


PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near an old stone bridge at dawn and sing"


def odd_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    rows = [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (2, "another text under the same id, with a few more words in it", "en", None),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \t\n\r\x0b\x0c ", "de", "b"),
        (None, "a text without an id", None, None),
        (6, long, "en", "a"),
        (7, PROSE.replace("fox", "cat") + "\n" + PROSE + "\r\n\nshort", "fr", "b"),
        (8, "Ünïcödé ß 漢字 \U0001f600 don't we'll 123 45   x\n\n  y<|endoftext|>", "de", "c"),
        (9, "one", "en", "c"),
    ]
    return rows + [(100 + i, f"{PROSE} number {i} of many", "en", "a") for i in range(30)]


@pytest.fixture(scope="session")
def odd(spark):
    return docs(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return docs(spark, [])
