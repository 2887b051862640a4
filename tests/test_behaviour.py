"""Behaviour on literal cases: rules, edge cases, idempotence, and plans."""

import datetime

import pytest
from pyspark.sql import functions as F

from letterworks.functions import stem
from letterworks.functions import text as T
from letterworks.operators import entities, extract, migrate, ops, postings, quality, review, search, temporal, versions
from letterworks.plans import frames, search_queries
from letterworks.sources import files
from letterworks.streaming import incremental

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def found(spark, text, kind=None):
    rows = extract.findings(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return [(r.field, r.normalized, r.confidence) for r in rows if kind in (None, r.kind)]


def test_text_functions(spark):
    assert value(spark, T.normalize_text(F.lit("  a \r\nb\t\n\n\n\nＡ１ "))) == "a\nb\n\nA1"
    assert value(spark, T.query_terms(F.lit("Foo foo BAR a-b/c x.y"))) == ["Foo", "BAR", "a-b/c", "x.y"]
    assert value(spark, T.normalize_name(F.lit(" Müller & Söhne GmbH, Straße "))) == "müller söhne gmbh strasse"
    assert value(spark, T.parse_german_date(F.lit("31.02.2024"))) is None
    assert value(spark, T.parse_german_date(F.lit("1.3.2024"))) == datetime.date(2024, 3, 1)
    assert str(value(spark, T.parse_german_amount(F.lit("1.234,56 €")))) == "1234.56"
    assert value(spark, T.parse_german_amount(F.lit("none"))) is None
    assert str(value(spark, T.canonical_amount(F.lit('{"amount":"1","premium":{"amount":"12,50 EUR"}}')))) == "12.50"
    assert value(spark, T.strong_identifiers(F.lit('{"tax_id":"de 12-34","vat_id":"1"}'))) == ["tax_id:DE1234"]
    assert value(spark, T.page_for_offset(F.array(F.lit("abc"), F.lit("de")), F.lit(5))) == 2
    assert value(spark, T.flatten_scalars(F.lit('{"a":[1,{"b":"x"}],"c":null,"d":true}'), "string")) == ["1", "x"]
    assert value(spark, T.content_hash(F.lit(None).cast("string").alias("a"))) != value(spark, T.content_hash(F.lit("").alias("a")))


def test_dates_need_a_label(spark):
    assert found(spark, "am 01.02.2024 nichts", "date") == []
    assert found(spark, "Kontoauszug vom 01.02.2024 bis 29.02.2024", "date") == [("statement_period_start", "2024-02-01", 0.95), ("statement_period_end", "2024-02-29", 0.95)]
    assert found(spark, "Datum: 31.02.2024", "date") == []
    assert found(spark, "Berlin, den 05.06.2024", "date") == [("document_date", "2024-06-05", 0.93)]
    twice = found(spark, "Datum: 05.06.2024\nFällig 05.06.2024", "date")
    assert {x[2] for x in twice} == {0.81, 0.82}


def test_amounts_and_ambiguity(spark):
    text = "Grundmiete: 500,00 EUR\nNebenkosten: 120,00 EUR\nBeispiel: 99,00 EUR\nohne 12,00"
    assert found(spark, text, "amount") == [("monthly_rent", "500.00 EUR", 0.86), ("service_charges", "120.00 EUR", 0.85)]


def test_types_and_titles(spark):
    text = "Muster Wohnen GmbH\nMietvertrag\nVermieter: Muster Wohnen GmbH\nMieterin: Ada Beispiel\nMietobjekt: Weg 1, Berlin"
    rows = dict((f, (n, c)) for f, n, c in found(spark, text))
    assert rows["rental_contract"] == ("rental_contract", 1.0) or rows["rental_contract"][0] == "rental_contract"
    assert rows["home"][0] == "home" and rows["tenant_name"][0] == "Ada Beispiel" and rows["rental_property_address"][0] == "Weg 1, Berlin"
    assert rows["title"][0] == "Muster Wohnen GmbH – rental_contract"


def test_every_span_is_its_text(spark):
    letters = frames.letters(spark, SF).limit(200)
    rows = extract.findings(letters).where("kind in ('date', 'amount', 'organization', 'identifier')").withColumn("span", F.col("value"))
    assert extract.verify_evidence(rows, letters).where("not verified").count() == 0


def test_impossible_date_withdraws_a_document(spark):
    df = spark.createDataFrame([(1, "Zahlbar bis zum 31.02.2024\nRechnungsdatum: 01.02.2024"), (2, "gültig ab 01.02.2024")], "doc_id long, text string")
    rows = extract.temporal(df).collect()
    assert [(r.doc_id, r.item) for r in rows] == [(1, "extraction_error"), (2, "event")]


def test_upserts_are_idempotent(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "doc long, h string")
    once = versions.upsert_versions(a.limit(0), a, ["doc", "h"])
    assert once.count() == 2 and versions.upsert_versions(once, a, ["doc", "h"]).count() == 2


def test_merge_chains_end_at_their_target(spark):
    m = spark.createDataFrame([(i, i + 1) for i in range(9)], "source_id long, target_id long")
    assert {r.target_id for r in entities.close_merges(m).collect()} == {9}


def test_no_fuzzy_match(spark):
    day = datetime.date
    rows = [(1, "Haus GmbH", day(2020, 1, 1), "active"), (2, "Alt AG", day(2019, 1, 1), "merged"), (3, "Neu AG", day(2021, 1, 1), "active"), (4, "!!", day(2021, 1, 1), "active")]
    orgs = spark.createDataFrame(rows, "org_id long, canonical_name string, created_at date, status string")
    cands = spark.createDataFrame([(1, "HAUS gmbh", None), (2, "Hauss GmbH", []), (3, "Alt AG", ["T2"]), (4, "x", ["T9", "T1"]), (5, "??", None)], "cand_id long, name string, strong array<string>")
    none = orgs.limit(0).selectExpr("org_id", "canonical_name as alias")
    accepted = spark.createDataFrame([(1, day(2022, 1, 2), 1, ["T1"]), (2, day(2022, 1, 1), 3, ["T1", "T3"]), (3, day(2020, 1, 1), 2, ["T1", "T2"])], "proposal_id long, created_at date, org_id long, strong array<string>")
    got = entities.resolve_organizations(cands, orgs, none, accepted).collect()
    assert {r.cand_id: r.org_id for r in got} == {1: 1, 2: None, 3: None, 4: 3, 5: None}
    assert {r.match_reason for r in got if r.cand_id == 4} == {"exact strong organization identifier"}


def test_accepted_resources(spark):
    rows = [(1, 7, "deadline", {"title": "a", "due_at": "2024-02-30"}, None, None), (2, 7, "deadline", {"title": "a" * 300, "due_at": ""}, {"deadline_type": "payment"}, None), (3, 7, "event", {"title": "x"}, None, 5)]
    rows += [(i, 7, "document_relationship", {"target_document_id": t, "relationship_type": "r"}, None, None) for i, t in ((4, "7"), (5, "8"), (6, "8"))]
    kept = spark.createDataFrame(rows, "proposal_id long, document_id long, proposal_type string, payload map<string,string>, overrides map<string,string>, link_id long")
    out = entities.accepted_resources(kept)
    assert [(r.proposal_id, len(r.title), r.due_at, r.deadline_type) for r in out["deadline"].collect()] == [(2, 255, None, "payment")]
    assert out["event"].isEmpty() and [r.proposal_id for r in out["document_relationship"].collect()] == [5]


def test_decisions_conflicts_and_refusals(spark):
    p = spark.createDataFrame([(1, "event", "a", True), (2, "event", "b", False)], "proposal_id long, proposal_type string, payload_value string, evidence_verified boolean")
    d = spark.createDataFrame([(1, 1, 5, None, None), (2, 1, 6, "z", None), (3, 2, 1, None, None), (4, 9, 1, None, None)], "decision_id long, proposal_id long, decided_at long, new_value string, link_id long")
    kept, refused = entities.accept_knowledge(p, d)
    assert [r.value for r in kept.collect()] == ["a"]
    assert {r.decision_id: r.reason for r in refused.collect()} == {2: "conflict", 3: "unverified_evidence", 4: "unknown_proposal"}


def test_snooze_rules(spark):
    d = spark.createDataFrame([(1, "open", None)], "deadline_id long, status string, snoozed_until date")
    log = spark.createDataFrame([(1, "snoozed", datetime.date(2020, 1, 1), 1, 1), (1, "completed", None, 0, 2)], "deadline_id long, new_status string, until date, at long, change_id long")
    out, refused = temporal.apply_status_changes(d, log, "2023-01-01")
    assert out.first().status == "completed" and refused.count() == 1


def test_p95_is_a_place_in_the_list(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "k string, v double")
    r = ops.latency_summary(df, "v", ["k"]).first()
    assert (r.samples, r["mean"], r.p95) == (100, 50.5, 95.0)
    many = [float(i * 7919 % 5003 // 3) for i in range(5003)]
    df = spark.createDataFrame([(k, v) for k in (None, "b") for v in many] + [("c", 4.0)] * 3000 + [("d", None)], "k string, v double")
    got = {r.k: r.p95 for r in ops.latency_summary(df, "v", ["k"]).collect()}
    place = sorted(many)[int(5002 * 0.95)]
    assert got == {None: place, "b": place, "c": 4.0}


def test_journal_transitions(spark):
    steps = ["queued", "claimed", "extracting", "ocr", "normalizing", "cancel_requested", "completed", "queued"]
    df = spark.createDataFrame([(1, i, i, s) for i, s in enumerate(steps)], "job_id long, event_id long, ts long, to_state string")
    assert [r.legal for r in ops.journal_replay(df).orderBy("ts").collect()] == [True] * 7 + [False]


def test_reminders_by_type(spark):
    day = datetime.date
    rows = [(1, day(2023, 6, 20), "open", None, "renewal"), (2, day(2023, 6, 20), "open", None, "payment"), (3, day(2023, 5, 1), "snoozed", day(2023, 6, 1), "other"), (4, day(2023, 5, 1), "snoozed", None, "other"), (5, day(2023, 6, 3), "open", None, "appointment")]
    d = spark.createDataFrame(rows, "deadline_id long, due_at date, status string, snoozed_until date, deadline_type string")
    got = {r.deadline_id: (r.kind, r.scheduled_for) for r in temporal.due_reminders(d, d.selectExpr("deadline_id", "'x' as kind").limit(0), "2023-06-01").collect()}
    assert got == {1: ("upcoming", day(2023, 5, 21)), 3: ("overdue", day(2023, 5, 2)), 5: ("upcoming", day(2023, 6, 1))}
    assert [r.deadline_id for r in temporal.woken_history(d, "2023-06-01").collect()] == [3]


def test_import_plan_order(spark):
    rows = [(1, "h", True), (2, "h", False), (3, "h", False), (4, "e", False)]
    src = spark.createDataFrame(rows, "source_id long, content_hash string, original_missing boolean")
    got = {r.source_id: (r.action, r.reason) for r in migrate.plan_import(src, src.where("source_id = 4").select("content_hash")).collect()}
    assert got == {1: ("failure", "original_missing"), 2: ("import", None), 3: ("skip", "duplicate_of_source"), 4: ("skip", "duplicate_of_existing")}
    assert migrate.sync_links(src.select("source_id"), src.where("source_id > 1").select("source_id"), ["source_id"]).first().op == "delete"


def test_import_verdicts(spark):
    items = spark.createDataFrame([(1, "imported", "h", "m", 1), (2, "imported", "h", None, 9)], "source_id long, status string, content_hash string, metadata_hash string, document_id long").withColumn("unsupported", F.lit(None).cast("string"))
    src = items.select("source_id", "content_hash", F.lit("m").alias("metadata_hash"), F.lit(False).alias("original_missing"), F.lit(False).alias("archive_missing"))
    docs = spark.createDataFrame([(1, "h")], "doc_id long, content_hash string")
    assert [(r.source_id, r.category) for r in migrate.import_discrepancies(src, items, docs).collect()] == [(2, "document_missing")]
    one = items.where("source_id = 1")
    verdict = lambda s, i: migrate.import_verdict(migrate.verify_import(s, i, docs), i).first().verdict
    assert (verdict(src, items), verdict(src.where("source_id = 1"), one), verdict(src.limit(0), one)) == ("FAIL", "PASS", "PASS WITH WARNINGS")


def test_hybrid_gate_adopts_only_gains(spark):
    kind = "query_id long, doc_id long, rank int"
    queries = spark.createDataFrame([(q,) for q in (1, 2, 3)], "query_id long")
    relevant = spark.createDataFrame([(1, 10), (2, 20)], "query_id long, doc_id long")
    poor = spark.createDataFrame([(1, 11, 1), (1, 10, 2)], kind)
    good = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], kind)
    r = quality.hybrid_gate(poor, good, relevant, queries).first()
    assert (r.lexical_recall, r.hybrid_recall, r.lexical_mrr, r.hybrid_mrr, r.false_positive_rate, r.decision) == (0.5, 1.0, 0.25, 1.0, 0.0, "adopt")
    loud = good.unionByName(spark.createDataFrame([(3, 30, 1)], kind))
    assert quality.hybrid_gate(poor, loud, relevant, queries).first().decision == "defer"
    assert quality.hybrid_gate(good, poor, relevant, queries).first().decision == "defer"


def test_empty_sets_have_defined_scores(spark):
    none = spark.createDataFrame([], "k long")
    one = spark.createDataFrame([(1,)], "k long")
    r = quality.precision_recall(none, one, ["k"]).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    r = quality.precision_recall(none, none, ["k"]).first()
    assert (r.precision, r.recall) == (1.0, 1.0)


@pytest.mark.parametrize(("word", "root"), [("Verträge", "vertrag"), ("Kündigungen", "kundig"), ("Häuser", "haus"), ("Rechnungen", "rechnung"), ("aufeinander", "aufeinand"), ("jahres", "jahr"), ("Bedürfnissen", "bedurfnis")])
def test_german_stems(word, root):
    assert stem.stem(word) == root


def test_indexed_search_finds_inflected_words(spark):
    df = spark.createDataFrame([(1, "", "", "RE-1", "", "die Verträge der Häuser"), (2, "Vertrag", "", "", "", "ein Haus"), (3, "", "", "", "", "nichts")], "doc_id long, title_text string, organization_text string, identifier_text string, metadata_text string, body_text string")
    df = df.withColumn("document_date", F.lit(None).cast("date"))
    q = spark.createDataFrame([(1, "vertrag haus"), (2, "re-1"), (3, "haus -verträge"), (4, "fehlt")], "query_id long, q string")
    got = {(r.query_id, r.doc_id): r.score for r in postings.search_indexed(q, postings.build_postings(df), df).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)} and got[2, 1] > 2 and got[1, 2] > got[1, 1]


def test_highlights_are_merged(spark):
    r = value(spark, search.highlights(F.lit("abcabc xx abc"), F.array(F.lit("abc"), F.lit("bca"))))
    assert [(x.start, x.end) for x in r] == [(0, 6), (10, 13)]


def test_facets_sum_to_the_matches(spark):
    rows = search_queries.projection(spark, SF)
    facets = search.search_facets(rows)
    assert facets.where("facet = 'document_type'").agg(F.sum("n")).first()[0] == rows.where("document_type is not null").count()


def test_filter_ranges_are_checked(spark):
    with pytest.raises(ValueError):
        search.search_filter(search_queries.projection(spark, SF), amount_min=2, amount_max=1)


def test_uploads(spark):
    rows = [("../a/b c.pdf", "application/pdf", b"%PDF-1"), ("x", "application/pdf", b""), ("y.png", "image/png", b"\xff\xd8\xff1")]
    got = files.validate_upload(spark.createDataFrame(rows, "name string, declared string, content binary")).collect()
    assert [(r.safe_name, r.reason) for r in got] == [("b_c.pdf", None), ("x", "empty"), ("y.png", "type_mismatch")]


def test_streamed_stability_is_the_batch_result(spark, tmp_path):
    df = spark.createDataFrame([("a", i, 1 if i < 4 else 2, 7) for i in range(9)] + [("b", i, i, i) for i in range(3)], "path string, at long, size long, mtime long")
    src = incremental.as_files(df, "at", 3)
    out = incremental.stable_files_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), 3)
    q = out.writeStream.format("memory").queryName("stable").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.sql("select path, at, since, ready from stable").collect())
    assert got == sorted(tuple(r) for r in incremental.stable_files(df, 3).select("path", "at", "since", "ready").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Filters and columns reach the scan; no cartesian product and no window without a key."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = plan(search.list_documents(docs.where("source = 'src1'"), [F.col("doc_id")], 5).select("doc_id"))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in p and "TakeOrdered" in p and "text" not in p.split("ReadSchema")[1]
    for df in (review.rank_proposals(frames.proposals(spark, SF)), ops.journal_replay(frames.jobs_events(spark, SF))):
        assert "CartesianProduct" not in plan(df) and "SinglePartition" not in plan(df)


def test_scalars_are_parsed_once_a_level(spark):
    """Each of three levels parses arrays and objects once; the text itself is made once."""
    rows = spark.createDataFrame([('{"a":[1,{"b":["x"]}],"c":null,"d":true}',), ("7",), ("[]",), (None,)], "j string").select(T.flatten_scalars(F.concat("j", F.lit("")), "string").alias("v"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 6 and plan.count("concat(") == 1
    assert [r.v for r in rows.collect()] == [["1", '["x"]'], ["7"], [], []]
