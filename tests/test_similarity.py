"""Matching blocks, comparison of versions and recognised texts against plain versions."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from letterworks.functions import blocks
from letterworks.operators import quality, versions
from letterworks.plans import import_queries, report_queries

SF = "/root/testdata/sf0.001"
plain = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()


def edited(draw, text, alphabet, share):
    out = []
    for c in text:
        r = draw.random()
        out += [] if r < share / 3 else [draw.choice(alphabet), c] if r < 2 * share / 3 else [draw.choice(alphabet)] if r < share else [c]
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "etaoin shrdlu etaoin etaoin\nQXZ019", "".join(map(chr, range(0x4E00, 0x4F40))) + "😀"])
def test_ratio_is_the_plain_one(alphabet):
    draw = random.Random(len(alphabet))
    for _ in range(150):
        a = "".join(draw.choice(alphabet) for _ in range(draw.choice([0, 1, 7, 60, 199, 200, 240, 500])))
        b = edited(draw, a, alphabet, draw.choice([0, 0.01, 0.1, 0.5, 1]))
        if draw.random() < 0.3:
            b = b[len(b) // 3 :] + b[: len(b) // 3]
        assert blocks.ratio(a, b) == pytest.approx(plain(a, b), abs=1e-12)


def test_whole_documents_have_the_plain_similarity(spark):
    got = {r.sample_id: r.similarity for r in import_queries.o94_ocr_similarity(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tidy = lambda x: x.strip(" \t\n\x0b\f\r")
    assert set(got) == set(texts)
    for k, text in texts.items():
        if all(x == x.rstrip() for x in text.split("\n")) and "\n\n\n" not in text and text.isascii():
            assert got[k] == pytest.approx(plain(tidy(text), tidy(text.replace("e", "c"))), abs=1e-6)
    rows = {r.doc_id: r for r in report_queries.o39_version_similarity(spark, SF).collect()}
    for k, text in texts.items():
        cand = (f"1,00 {text}", text[1:], text)[k % 3]
        assert rows[k].similarity == pytest.approx(plain(text, cand), abs=1e-6)
        assert k % 3 != 2 or rows[k].status == "equivalent"


def test_a_long_text_is_compared_in_seconds():
    draw = random.Random(0)
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9))) for _ in range(3000)]
    text = " ".join(draw.choice(words).capitalize() if draw.random() < 0.1 else draw.choice(words) for _ in range(60_000))
    start = time.perf_counter()
    assert 0 < blocks.ratio(text, edited(draw, text, "abcxyz", 0.01)) < 1
    assert blocks.ratio(text, text[:1000] + text) > 0.99
    assert time.perf_counter() - start < 60


def test_pages_and_critical_values(spark):
    rows = [(1, "ab c", "ab c d", ["ab c", "x"], ["ab c d"], ["c", "", "zz"]), (2, "", "", [], [], []), (3, "", "a", None, [None, "a"], None)]
    df = spark.createDataFrame(rows, "id int, base string, candidate string, p array<string>, q array<string>, crit array<string>")
    got = {r.id: r for r in versions.compare_versions(df, pages=("p", "q"), critical="crit").collect()}
    assert (got[1].coverage, got[1].critical_checked, got[1].critical_preserved) == (round(4 / 3, 6), 2, 0.5)
    assert [tuple(p) for p in got[1].page_coverage] == [(1, 3, 4, 1.333333), (2, 1, 0, 0.0)]
    assert (got[2].hashes_equal, got[2].coverage, got[2].similarity, got[2].critical_preserved, got[2].page_coverage) == (True, 1.0, 1.0, None, [])
    assert (got[3].coverage, got[3].similarity) == (None, 0.0)
    status = versions.comparison_status(F.lit(False), F.lit(0.99), F.lit(1.0), F.lit(None).cast("double"))
    assert spark.range(1).select(status).first()[0] == "equivalent"


def test_recognised_samples(spark):
    out = spark.createDataFrame([(1, "a", "rechnung 12,30", "Rechnung 12,30"), (2, "a", "x", "x"), (3, "b", "", "y")], "sample_id int, category string, text string, truth string")
    crit = spark.createDataFrame([(1, "12,30"), (1, "Rechnung"), (3, "y")], "sample_id int, value string")
    got = {r.sample_id: (round(r.similarity, 4), r.critical_found, r.critical_total, r.critical_share) for r in quality.ocr_samples(out, crit).collect()}
    assert got == {1: (round(plain("Rechnung 12,30", "rechnung 12,30"), 4), 1, 2, 0.5), 2: (1.0, 0, 0, None), 3: (0.0, 0, 1, 0.0)}
    assert {r.category: (r.samples, r.critical_found) for r in quality.ocr_scorecard(out, crit).collect()} == {"a": (2, 0.5), "b": (1, 0.0)}


def test_whole_texts_reach_python_in_small_batches(spark):
    """Arrow would hand ten thousand pairs of whole texts to a worker at once; texts that cannot change are not handed over at all."""
    from letterworks.functions import text as T

    pairs = spark.createDataFrame([("Haus am See", "Hans am See"), ("x", "x"), (None, "y")], "a string, b string").repartition(1)
    rows = pairs.select(T.similarity_ratio(F.col("a"), F.col("b")).alias("r"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [r.r for r in rows.collect()] == [pytest.approx(20 / 22), 1.0, 0.0]
    seen = spark.createDataFrame([("Haus",), ("\uff21\uff11",), (None,)], "t string").repartition(1).select(T.nfkc(F.col("t")).alias("t"))
    assert {r.t for r in seen.collect()} == {"Haus", "A1", None}
    assert "CASE WHEN" in next(line for line in seen._jdf.queryExecution().optimizedPlan().toString().split("EvalPython") if "_nfkc(" in line)


def test_critical_values_with_and_without_blanks(spark):
    from letterworks.operators import quality

    outputs = spark.createDataFrame([(1, "a", "Konto  AB-123, Haus am See", "x"), (2, "a", "leer", "x"), (3, "b", "Haus\nSee Ａ1", "x")], "sample_id int, category string, text string, truth string")
    critical = spark.createDataFrame([(1, "AB-12"), (1, "Haus am"), (1, "am  See"), (1, "amSee"), (3, "A1"), (3, "Haus See")], "sample_id int, value string")
    rows = quality.ocr_samples(outputs, critical).select("sample_id", "critical_found", "critical_total")
    assert {tuple(r) for r in rows.collect()} == {(1, 2, 4), (2, 0, 0), (3, 1, 2)}
    plan = rows.select("critical_found")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "filter(" in line]
    assert filters and not any("regexp_replace" in line for line in filters)
