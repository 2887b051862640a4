"""Passages in texts and the nearest texts by trigrams, against plain versions."""

import pytest
from pyspark.sql import functions as F

from letterworks.operators import quality, search
from letterworks.plans import import_queries

SF = "/root/testdata/sf0.001"

TEXTS = ["der alte  Mann ging", "ein anderer Mann ging heim", "xder alte Mannx", "am See", "im Wald am Seeufer", "", None, "alte\nMann ging", "der alte 𝄞ab Mann"]
NEEDLES = ["der alte Mann", "Mann ging", "am See", "alte  Mann", "alte 𝄞ab", "g", "", "fehlt ganz hier", None]


def test_texts_that_hold_a_needle(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    needles = spark.createDataFrame(list(enumerate(NEEDLES)), "query_id long, needle string")
    got = sorted(tuple(r) for r in search.holding(docs, needles).select("query_id", "doc_id").collect())
    assert got == sorted((q, d) for q, n in enumerate(NEEDLES) for d, t in enumerate(TEXTS) if n is not None and t is not None and n in t)


@pytest.mark.parametrize("k", [3, 400])
def test_best_by_trigrams_are_those_of_all_pairs(spark, k):
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("q"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    every = {(r.query_id, r.doc_id): r.similarity for r in quality.trigram_candidates(queries, docs).collect()}
    also = docs.where("doc_id % 50 = 0").select("doc_id").join(queries.select("query_id"))
    got = {(r.query_id, r.doc_id): r.similarity for r in quality.trigram_top(queries, docs, k, also).collect()}
    want = {x: s for x, s in every.items() if x[1] % 50 == 0}
    for q in {x[0] for x in every}:
        rows = sorted((-s, d) for (i, d), s in every.items() if i == q)[:k]
        want |= {(q, d): -s for s, d in rows}
    assert got == want


def test_gate_reads_no_pairs_of_all_texts_and_passages(spark, monkeypatch):
    """Passages meet texts by equality, and the ranking by trigrams does not make all pairs."""
    monkeypatch.setattr(quality, "trigram_candidates", None)
    seen = []
    real = search.query_blocks
    monkeypatch.setattr(search, "query_blocks", lambda q, key, *size: seen.append((q.columns, q.count())) or real(q, key, *size))
    import_queries.o93_hybrid_gate(spark, SF).collect()
    windows = sum(n for columns, n in seen if "window" in columns)
    assert windows > sum(n for columns, n in seen if "window" not in columns)
