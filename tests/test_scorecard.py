"""The whole scorecard of text recognition against the plain measure and the SQL of its other columns."""

import difflib
import re
import unicodedata
from collections import defaultdict

import oracle
import pytest

from letterworks import catalog

SF = "/root/testdata/sf0.001"


def normalized(text):
    text = re.sub(r"[ \t\x0b\f]+(?=\n|$)", "", re.sub(r"\r\n?", "\n", unicodedata.normalize("NFKC", text)))
    return re.sub(r"\n{3,}", "\n\n", text).strip(" \t\n\x0b\f\r")


def test_scorecard_has_every_measure(spark):
    got = {r.category: r for r in catalog.queries()["o94_ocr_scorecard"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("source", "text").collect()
    ratios = defaultdict(list)
    for d in docs:
        ratios[d.source].append(difflib.SequenceMatcher(None, normalized(d.text), normalized(d.text.replace("e", "c"))).ratio())
    assert {c: r.similarity for c, r in got.items()} == {c: pytest.approx(sum(x) / len(x), abs=1e-5) for c, x in ratios.items()}
    rest = oracle.connect(SF).sql(f"SELECT category, samples, critical_found FROM ({catalog.oracles()['o94_ocr_critical']})").fetchall()
    assert {(r.category, r.samples, r.critical_found) for r in got.values()} == set(rest)
