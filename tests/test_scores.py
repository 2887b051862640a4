"""Scores of an extractor on literal cases, and readiness."""

import pytest
from pyspark.sql import functions as F

from letterworks.operators import ops, quality

FOUND = "doc_id int, field string, normalized string"
DOCS = "doc_id int, expected_type string, actual_type string, expected_contract boolean, predicted_contract boolean"


def test_all_scores(spark):
    found = spark.createDataFrame([(1, "organization", "A"), (1, "organization", "A"), (1, "payment_due_date", "x"), (2, "organization", "B"), (2, "amount", "3")], FOUND)
    truth = spark.createDataFrame([(1, "organization", "A"), (1, "payment_due_date", "y"), (2, "amount", "3"), (3, "renewal_date", "z")], FOUND)
    docs = spark.createDataFrame([(1, "invoice", "invoice", False, True), (2, None, None, False, False), (3, "contract", "invoice", True, False)], DOCS)
    r = quality.extraction_metrics(found, truth, docs).first()
    assert (r.documents, r.organization_false_positives, r.budget_pass) == (3, 1, False)
    assert [r.classification_precision, r.extraction_precision, r.field_recall, r.deadline_recall, r.false_contract_rate, r.proposal_noise_per_document] == pytest.approx([2 / 3, 0.5, 0.5, 0.0, 0.5, 2 / 3], abs=1e-6)
    good = quality.extraction_metrics(truth, truth, docs.where("doc_id = 2")).first()
    assert good.budget_pass and good.field_f1 == 1.0
    nothing = quality.extraction_metrics(found.limit(0), truth.limit(0), docs.limit(0)).first()
    assert (nothing.extraction_precision, nothing.field_recall, nothing.false_contract_rate, nothing.documents) == (1.0, 1.0, 0.0, 0)


def test_contracts_are_predicted_by_type_words_or_number(spark):
    rows = [("contract", "x", []), ("invoice", "Ihr Mietvertrag vom", []), ("invoice", "x", ["vertragsnummer"]), ("insurance_notice", "x", ["Vertragsnummer"]), (None, "x", [])]
    df = spark.createDataFrame(rows, "t string, text string, kinds array<string>")
    got = [r.p for r in df.select(quality.predicts_contract(F.col("t"), F.col("text"), F.col("kinds")).alias("p")).collect()]
    assert got == [True, True, False, True, False]


def test_readiness_from_reports(spark):
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    clean = (one([(0, 0)], "missing int, stale int"), one([], "category string"), one([], "category string, blocking boolean, n long"), spark.range(1), spark.range(1))
    verdicts = lambda *a: {r.name: r.verdict for r in ops.readiness_report(ops.readiness_checks(*a)).collect()}
    assert set(verdicts(*clean).values()) == {"PASS"}
    late = verdicts(*clean[:2], one([("x", False, 2)], "category string, blocking boolean, n long"), spark.range(1), spark.range(0))
    assert (late["import_warnings"], late["verified_backup"], late["overall"]) == ("PASS WITH WARNINGS",) * 3
    bad = verdicts(one([(1, 2)], "missing int, stale int"), one([("missing",), ("orphan_original",)], "category string"), *clean[2:3], spark.range(0), spark.range(1))
    assert (bad["search_consistent"], bad["original_assets_present"], bad["authentication"], bad["overall"]) == ("FAIL",) * 4
