"""Matches by marks: texts with the mark, first matches, and how often a pattern is looked for."""

import re

import pytest
from pyspark.sql import functions as F

from letterworks.functions import spans
from letterworks.operators import extract, search

TEXTS = ["", "a1 b22", "a1b22 😀 c333", "x  a1  b22", "no", None]


def test_matches_of_texts_with_and_without_the_mark(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    pattern = r"([a-z])\d+"
    rows = df.select("t", spans.matches(F.col("t"), pattern, 1).alias("m"), spans.first_match(F.col("t"), pattern, 1).alias("f")).collect()
    for r in rows:
        want = [(m.start(), m.end(), m.group(), m.group(1)) for m in re.finditer(pattern, r.t or "")]
        assert [(m.start, m.end, m.hit, m.part) for m in r.m] == want
        assert (r.f and (r.f.start, r.f.end, r.f.hit, r.f.part)) == (want[0] if want else None)


def test_a_fact_is_looked_for_once(spark):
    assert str(extract.facts(F.col("text"))).count("RiesterRente") <= 6


@pytest.mark.parametrize("n", range(8))
def test_few_and_many_matches_have_the_same_places(spark, n):
    text = "ä " + "".join(f"k{i}: 𝄞{i * 7} " for i in range(n)) + "ende"
    row = spark.createDataFrame([(text,)], "t string").select(spans.matches(F.col("t"), r"(\w)\d: (\S+)", 2).alias("m")).first().m
    assert [(r.start, r.end, r.hit, r.part) for r in row] == [(m.start(), m.end(), m[0], m[2]) for m in re.finditer(r"([a-z])\d: (\S+)", text)]


def test_search_rows_look_for_no_facts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Muster GmbH\nMietvertrag\nMieter: Ada Beispiel")], "doc_id long, text string")
    want = search.build_projection(docs).collect()
    monkeypatch.setattr(extract, "facts", None)
    assert search.build_projection(docs).collect() == want and want[0].title_text == "Muster GmbH – rental_contract"
