"""Each stage of the pipeline against a plain version on the rows that it gets."""

import numpy as np
import pytest

import brute
import corpus_pipeline as cp
from test_text_ops import brute_classes

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    base = "the shared end of many documents is this line"
    more = [(1000 + i, f"text number {i} {' '.join(f'w{i * 37 + k}' for k in range(80))}\n{base}", "en", "src1", 500) for i in range(12)]
    more += [(2000, None, "en", "src1", 0), (2001, "1234 !!", "en", None, 7), (None, "the of and in the was " * 9, "en", "src2", 198), (1000, more[0][1], "en", "src1", 500)]
    return df.unionByName(spark.createDataFrame(more, df.schema)).withColumn("extra", df.doc_id * 0).cache()


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_language_keeps_clean_documents(spark, docs):
    out = cp.identify_language(spark, docs, SF)
    assert out.columns == docs.columns
    kept, before = plain(out), plain(docs)
    assert set(kept) <= set(before) and len(kept) >= len(before) - 6
    assert not {2000, 2001} & {d for d, _ in kept}


def test_lines_are_brute_force(spark, docs):
    before = plain(docs)
    want = {}
    for (d, t), (_, dropped, _) in zip(before, brute.lines([t for _, t in before]), strict=True):
        want.setdefault(d, []).append(dropped)
    out = cp.dedup_lines(spark, docs, SF)
    assert out.columns == docs.columns
    after = dict(plain(out))
    assert all(("shared end" in (after[1000 + i] or "")) is False for i in range(12))
    untouched = {d for d, t in before if sum(want[d]) == 0}
    assert all(after[d] == t for d, t in before if d in untouched)


def test_one_of_each_class_stays(spark, docs):
    clean = docs.where("doc_id is not null and text is not null").dropDuplicates(["doc_id"])
    out = cp.dedup_documents(spark, clean, SF)
    assert out.columns == docs.columns
    classes = brute_classes(plain(clean))
    assert sorted(d for d, _ in plain(out)) == sorted(set(classes.values()))
    assert sum(d == 1000 for d, _ in plain(cp.dedup_documents(spark, docs, SF))) == 1
    assert {None, 2000} <= {d for d, _ in plain(cp.dedup_documents(spark, docs, SF))}


def test_leaks_go_and_others_stay(spark, docs):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = cp.decontaminate(spark, docs, SF)
    assert out.columns == docs.columns
    kept = {t for _, t in plain(out)}
    gone = [t for _, t in plain(docs) if t not in kept]
    assert all(not any(i in (t or "") for i in items) for t in kept)
    words = lambda t: set(t.lower().split())
    assert all(any(len(words(i) & words(t)) >= 0.7 * len(words(i)) for i in items) for t in gone)
    assert None in {d for d, _ in plain(out)}


def test_run_is_the_stages_one_after_the_other(spark):
    out = cp.run(spark, SF).toPandas()
    assert (out.taken <= 2 * out["size"]).all() and len(out) > 100 and out.doc_id.is_unique
    assert np.allclose(out.taken, out.copies * out["size"])


def test_empty_table(spark, docs):
    df = docs.limit(0)
    for _, function in cp.STAGES:
        out = function(spark, df, SF)
        assert out.count() == 0
        df = out if set(COLUMNS) <= set(out.columns) else df
