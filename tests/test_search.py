"""Matches of a batch of searches against plain searches of every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from letterworks.operators import search
from letterworks.plans import search_queries

SF = "/root/testdata/sf0.001"
LONG = "x" * search.TERM_CHARS
FIELDS = (*search.TEXTS, "status", "document_type", "source")


def fold(s):
    return s.lower().replace("ß", "ss")


def plain(queries, texts):
    """(query_id, number of the text) of all matches."""
    terms = lambda q: [fold(t) for t in re.findall(r"\w+(?:[-./]\w+)*", q)]
    return sorted((k, n) for k, q in queries if q is not None for n, text in enumerate(texts) if all(t in fold(text) for t in terms(q)))


def rows_of(spark, texts):
    """Search rows without an id whose fields, but for the body, are empty; ``tags_text`` is the number of the row."""
    body = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "tags_text string, body_text string")
    return body.select("*", F.lit(None).cast("long").alias("doc_id"), *[F.lit("").alias(c) for c in FIELDS if c != "body_text"], F.lit(None).cast("date").alias("document_date"))


@pytest.mark.parametrize("limit", [search.BROADCAST_QUERIES, 0])
def test_matches_are_those_of_plain_searches(spark, monkeypatch, limit):
    """Terms inside words, terms of many lengths, long ones with one beginning, signs of patterns, wide characters, no terms; rows without an id."""
    monkeypatch.setattr(search, "BROADCAST_QUERIES", limit)
    monkeypatch.setattr(search, "LISTED", 5)
    dice = random.Random(1)
    words = ["".join(dice.choice("abß1.-") for _ in range(dice.randint(1, 7))) for _ in range(60)]
    odd = [LONG, LONG + "y", LONG + "yz", "𠀀𠀁", "a𠀀b", "a.b", "a/b", "axb", "größe", "GRÖSSE", "Straße", "STRASSE", "[a]", "\\x{61}", "(?", "re-1", "re-12", "xre-123", "_"]
    texts = ["", " ", *odd, *[" ".join(dice.choices(words + odd, k=dice.randint(1, 9))) for _ in range(120)]]
    queries = ["", "  ", "?!", "a b", "b  a", "A", None, *words[:30], *odd, *[" ".join(dice.choices(words + odd, k=dice.randint(2, 3))) for _ in range(60)], "re-1", "re-1"]
    batch = spark.createDataFrame(list(enumerate(queries)), "query_id long, q string")
    want = plain(enumerate(queries), texts)
    got = search.match_lexical(batch, rows_of(spark, texts)).select("query_id", "tags_text").collect()
    assert sorted((r.query_id, int(r.tags_text)) for r in got) == want
    counted = search.match_counted(batch, rows_of(spark, texts)).groupBy("tags_text").agg(F.sum("asked").alias("n"))
    assert {int(r.tags_text): r.n for r in counted.collect()} == {n: sum(m == n for _, m in want) for n in {m for _, m in want}}


def test_batches_without_terms_or_queries(spark):
    rows = rows_of(spark, ["a", ""])
    for queries, n in (([], 0), (["", "?"], 4), ([None], 0)):
        batch = spark.createDataFrame(list(enumerate(queries)), "query_id long, q string")
        assert search.match_lexical(batch, rows).count() == n


def test_texts_are_not_shuffled_for_counts(spark):
    """Letters are read once and leave their tasks only as counts; the one exchange deals the orders of a small file to all cores."""
    counted = search.match_counted(search_queries.search_batch(spark, SF), search_queries.projection(spark, SF))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") <= 1 and "SortMergeJoin" not in plan and plan.count("orders.parquet") == 1


def test_queries_are_looked_up_by_the_term_that_fewest_have(spark):
    batch = spark.createDataFrame([("1", ["haus", "05", "ag"]), ("2", ["haus", "06", "ag"]), ("3", ["ab", "abc"]), ("4", []), ("5", [LONG + "y"])], "_key string, terms array<string>")
    got = {r._key: (r.term, r.rest) for r in search.key_terms(batch).collect()}
    assert got == {"1": ("05", ["haus", "ag"]), "2": ("06", ["haus", "ag"]), "3": ("abc", ["ab"]), "4": ("", []), "5": (LONG, [LONG + "y"])}
