"""Quarantines of tables and of runs of an extraction."""

from letterworks.operators import constraints

SPEC = constraints.Table(
    {"k": "int", "day": "date", "kind": "string", "n": "decimal(5,2)", "ref": "int"},
    required=("k", "kind"),
    enums={"kind": ("a", "b")},
    ranges={"n": (0, 10), "day": ("2020-01-01", None)},
    lengths={"kind": (1, 1)},
    unique=(("k",), ("kind", "n")),
    references={"ref": ("other", "id")},
)


def test_rows_are_typed_or_set_aside_with_all_reasons(spark):
    rows = [
        ("1", "2024-02-03", "a", "1.5", "7", "x"),
        ("2", "2024-02-30", "b", "2", None, "x"),
        ("2", None, "b", "3", "8", "x"),
        (None, "2019-01-01", "cc", "11", "7", "x"),
        ("4", None, None, None, None, "x"),
        ("5", None, "a", "1.50", None, "x"),
        ("six", None, "b", "9", None, "x"),
    ]
    df = spark.createDataFrame(rows, "k string, day string, kind string, n string, ref string, more string")
    other = spark.createDataFrame([(7,), (None,)], "id long")
    good, bad = constraints.load(df, SPEC, {"other": other})
    assert good.dtypes == [("k", "int"), ("day", "date"), ("kind", "string"), ("n", "decimal(5,2)"), ("ref", "int")] and good.collect() == []
    got = sorted((r.k or "", r.kind or "", r.n or "", sorted(r.problems)) for r in bad.collect())
    assert got == sorted(
        [
            ("1", "a", "1.5", ["unique:kind+n"]),
            ("2", "b", "2", ["type:day", "unique:k"]),
            ("2", "b", "3", ["reference:ref", "unique:k"]),
            ("", "cc", "11", ["enum:kind", "length:kind", "missing:k", "range:day", "range:n"]),
            ("4", "", "", ["missing:kind"]),
            ("5", "a", "1.50", ["unique:kind+n"]),
            ("six", "b", "9", ["type:k"]),
        ]
    )
    fine, none = constraints.load(df.where("k = '1'"), SPEC, {"other": other})
    assert [tuple(map(str, r)) for r in fine.collect()] == [("1", "2024-02-03", "a", "1.50", "7")] and none.collect() == []
    assert constraints.load(df.drop("kind").where("k = '1'"), SPEC, {"other": other})[1].first().problems == ["missing:kind"]
    report = constraints.rejection_report({"t": bad})
    assert {r.problem: r.n for r in report.collect()}["unique:k"] == 2


def test_one_bad_finding_takes_the_whole_run(spark):
    docs = spark.createDataFrame([(i, "Haus AG\nRechnung") for i in range(1, 12)], "doc_id long, text string")
    good = ("organization", "organization", "Haus AG", "Haus AG", 0.9, 0, 7, "Haus AG")
    kind = ("type", "document_type", "Rechnung", "invoice", 0.9, 8, 16, "Rechnung")
    spoil = lambda base, **kw: tuple(kw.get(n, v) for n, v in zip(("kind", "field", "value", "normalized", "confidence", "start", "end", "span"), base, strict=True))
    rows = [(1, *good), (1, *kind), (2, *good), (2, *spoil(kind, end=17)), (3, *spoil(kind, normalized="poem")), (3, *good), (4, *spoil(good, field="title")), (5, *spoil(good, value="")), (6, *kind), (6, *kind), (7, *spoil(good, kind="odd"))]
    rows += [(8, *spoil(good, confidence=1.5)), (9, *spoil(good, span="Haus KG")), (10, *spoil(good, kind="area", field="life_area", normalized="space")), (99, *good), (11, *spoil(good, span=None)), (11, *spoil(good, value="v" * 501))]
    found = spark.createDataFrame(rows, "doc_id long, kind string, field string, value string, normalized string, confidence double, start int, end int, span string")
    sound, bad = constraints.set_aside(found, docs)
    assert {r.doc_id for r in sound.collect()} == {1} and sound.count() == 2
    assert {r.doc_id: (r.n_findings, r.reasons) for r in bad.collect()} == {
        2: (2, ["evidence"]), 3: (2, ["unknown_document_type"]), 4: (1, ["wrong_section"]), 5: (1, ["value_length"]), 6: (2, ["repeated_section"]), 7: (1, ["unknown_section"]),
        8: (1, ["confidence"]), 9: (1, ["evidence"]), 10: (1, ["unknown_life_area"]), 99: (1, ["no_document"]), 11: (2, ["evidence", "evidence_length", "value_length"]),
    }
    none = constraints.set_aside(found.limit(0), docs)
    assert none[0].collect() == [] and none[1].collect() == []


def test_whole_rows_meet_only_the_keys_without_a_match(spark, monkeypatch):
    """Not all keys of the table referred to; and the texts of valid rows are not written a second time."""
    kept, keep = {}, constraints.stage
    monkeypatch.setattr(constraints, "stage", lambda df, name: kept.setdefault(name, keep(df, name)))
    spec = constraints.Table({"k": "int", "ref": "int"}, references={"ref": ("other", "id")})
    df = spark.range(200).selectExpr("cast(id as string) as k", "if(id % 50 = 7, null, cast(id % 100 as string)) as ref")
    good, bad = constraints.load(df, spec, {"other": spark.range(98).union(spark.range(5))})
    assert [tuple(r) for r in bad.orderBy("k").collect()] == [(str(k), str(k % 100), ["reference:ref"]) for k in (198, 199, 98, 99)]
    assert good.count() == 196 and good.where("ref is null").count() == 4
    assert sorted(r[0] for r in kept["lost-keys"].collect()) == [98, 99]
    assert kept["judged-rows"].where("_raw is not null").count() == 4
