"""Queries on blank, missing and unusual texts give their SQL's rows."""

from __future__ import annotations

import sys
import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry

SPACES = [*map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)), "\u180e", "\u200b", "\ufeff"]
BLANK = ["", " ", " \n\t ", None, "a  b", "Straße\n"]


@pytest.fixture
def both(spark, tmp_path):
    """Rows by Spark and by SQL of a query on documents with the given (text, lang)."""

    def run(name: str, documents: list[tuple[str | None, str | None]]) -> tuple[list[tuple], list[tuple]]:
        rows = [(i, text, lang) for i, (text, lang) in enumerate(documents)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        got = entry.queries()[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)

    return run


def test_blank_documents_are_records_too(both):
    got, want = both("clean_qa", [(t, "en") for t in BLANK])
    assert got == want and len(got) == len(BLANK)
    assert [r[2:] for r in got] == [("", "|x y")] * 3 + [(None, None), ("a b", "a b|x y"), ("Straße", "Straße|x y")]


def test_counters_of_unusual_texts(both):
    texts = [*BLANK, "x y", " X\ty", "x", "ı", "ıI", "\uffff", "ı\uffff", "ẞ", "ŉ", "ﬁ", "ς σ", "ſ", "\u0345", *(a + s + b for s in SPACES for a in ("", "a") for b in ("", "b", s))]
    got, want = both("cleaning_counters", [(t, f"t{i}") for i, t in enumerate(texts)] + [("", None), (None, None)])
    assert got == want and len(got) == len(texts) + 2
    counts = {r[0]: r[1:] for r in got}
    assert [counts[f"t{i}"] for i in range(10)] == [(1, 2, 0), (1, 4, 0), (1, 4, 0), (1, 1, 0), (1, 4, 2), (1, 4, 2), (1, 2, 3), (1, 4, 3), (1, 2, 2), (1, 2, 1)]


def test_counters_of_characters(both):
    """All that Python's tables know, without letters of no case that stay the same and two whose capitals came after Python's tables."""
    points = [c for c in map(chr, range(1, sys.maxunicode + 1)) if c not in "\u019b\u0264" and (kind := unicodedata.category(c)) not in ("Cn", "Co", "Cs") and not (kind == "Lo" and c == c.casefold() == c.upper())]
    got, want = both("cleaning_counters", [(f"a{c}b", f"{ord(c):x}") for c in points])
    assert [p for p in zip(got, want) if p[0] != p[1]] == [] and len(got) == len(points) + 1
