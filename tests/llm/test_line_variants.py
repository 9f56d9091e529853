"""The link search of line dedup on large groups of variants, against DuckDB's edit distance over all pairs."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gistmill.llm import line_dedup


def _edited(rng: random.Random, text: str, edits: int) -> str:
    for _ in range(edits):
        at, letter = rng.randrange(len(text)), rng.choice("abcdefgh")
        text = rng.choice([text[:at] + letter + text[at + 1 :], text[:at] + letter + text[at:], text[:at] + text[at + 1 :]])
    return text


def _classes(names: list[str], links: list[tuple[str, str]]) -> dict[str, str]:
    up = {n: n for n in names}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in names}


def _lines(kind: str) -> list[str]:
    rng = random.Random(kind)
    base = "".join(rng.choice("abcdefgh ") for _ in range(36))
    if kind == "near the base":
        found = {_edited(rng, base, 2) for _ in range(2000)}
    else:  # and many that share a third, the rest a number: hardly any links
        found = {base}
        while len(found) < 200:
            found.add(_edited(rng, rng.choice(sorted(found)), rng.choice([1, 2, 3])))
        found |= {f"{base[:20]} {rng.randrange(10**9):09d}" for _ in range(300)}
    return sorted(t for t in found if t == t.strip() and len(t) >= 20)


@pytest.mark.parametrize("kind", ["near the base", "chains"])
def test_variants_of_a_line(spark, kind):
    lines = _lines(kind)
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(lines)), "text": lines})).repartition(4)
    rows = line_dedup._lines(docs, 20, "doc_id", "text")
    names = {r["h1"]: r["line"] for r in rows.collect()}
    got = [(names[r["a1"]], names[r["b1"]]) for r in line_dedup.links(rows.select("h1", "line")).collect()]
    table = pd.DataFrame({"line": lines})  # noqa: F841
    want = duckdb.sql("SELECT a.line, b.line FROM table a JOIN table b ON a.line < b.line AND abs(length(a.line) - length(b.line)) <= 2 WHERE levenshtein(a.line, b.line) <= 2".replace("table", '"table"')).fetchall()
    assert {(min(p), max(p)) for p in got} <= set(want)
    assert _classes(lines, got) == _classes(lines, want) and want
    if kind == "near the base":
        assert len(set(_classes(lines, want).values())) < 3 and len(got) < 40 * len(lines)


def test_long_and_other_lines(spark):
    long = "ab cd ef gh " * 200_000
    odd = "größer als zwölf Füße und länger als früher"
    texts = [(1, long + "x"), (2, long + "y"), (3, odd), (4, odd.replace("ö", "o")), (5, odd[:-3] + "ßßß")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select(F.col("doc_id"), "text", F.lit(1).alias("doc"), F.lit(2).alias("DROPPED"))
    assert {r["doc_id"] for r in line_dedup.apply(docs).collect()} == {1, 3, 5}
    assert line_dedup.apply(docs).columns == docs.columns
