"""Relations of documents: only those found are made distinct."""

from pyspark.sql import functions as F

from letterworks.operators import entities
from letterworks.plans import review_queries

SF = "/root/testdata/sf0.001"


def test_relations_are_found_before_they_are_made_distinct(spark, monkeypatch):
    seen = []
    real = entities.list_relationships
    monkeypatch.setattr(entities, "list_relationships", lambda relations, docs: seen.append(relations) or real(relations, docs))
    rows = review_queries.o51_list_relationships(spark, SF).collect()
    assert len(rows) == len(set(rows)) > 0
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_relations_come_once(spark):
    relations = spark.createDataFrame([(1, 2), (1, 2), (3, 1), (1, 1), (4, 5), (None, 1), (None, 1)], "source_id long, target_id long")
    docs = spark.createDataFrame([(1,), (1,)], "doc_id long")
    got = entities.list_relationships(relations, docs).orderBy(F.col("source_id").asc_nulls_first(), "target_id").collect()
    assert [tuple(r) for r in got] == [(None, 1), (1, 1), (1, 2), (3, 1)]
