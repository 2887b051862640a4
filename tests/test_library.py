"""Foreign libraries: JSON documents of any shape, synchronisation, coverage and samples."""

import datetime

from letterworks.operators import library, postings

RAWS = [
    '{"id":1,"title":"T \\"q\\"","created":"2024-01-02T00:00","correspondent":3,"document_type":null,"tags":[7,"x",9],"custom_fields":[{"field":1,"value":{"a":1}},{"field":99,"value":null},"loose"],"storage_path":5,"notes":[{"id":1}],"rating":3,"extra":{"a":[1]},"content":"abc"}',
    '{"id":"b","rating":"five","tags":"no list","notes":null,"custom_fields":[null,3]}',
    '{"id":"b","rating":null,"created":"not a day","correspondent":4,"archived_file_name":"a","original_file":""}',
    "[1]",
    "nope",
    "{}",
    None,
]


def test_documents_of_any_shape_are_mapped(spark):
    catalogs = spark.createDataFrame([("correspondent", "3", "Corr", None), ("tag", "7", "seven", None), ("custom_field", "1", "size", "int"), ("workflows", "1", "w", None), ("workflows", "2", "w", None)], "kind string, id string, name string, detail string")
    raw = spark.createDataFrame([(r,) for r in RAWS], "raw string")
    m = library.map_library(raw, catalogs)
    got = {(r.source_id, r.unsupported.get("rating")): r for r in m.collect()}
    one = got["1", "3"]
    assert (one.title, one.created, one.correspondent, one.document_type, one.storage_path) == ('T "q"', datetime.date(2024, 1, 2), "Corr", None, "5")
    assert one.tags == ["seven", "x", "9"] and (one.n_notes, one.has_content, one.has_original) == (1, True, False)
    assert [tuple(f) for f in one.custom_fields] == [("1", "size", "int", '{"a":1}'), ("99", None, None, "null"), (None, None, None, '"loose"')]
    assert one.unsupported == {"rating": "3", "extra": '{"a":[1]}'}
    two = got["b", '"five"']
    assert (two.tags, two.n_notes, [f.value for f in two.custom_fields]) == ([], 0, ["null", "3"])
    three = got["b", "null"]
    assert (three.created, three.correspondent, three.has_original, three.has_archive) == (None, None, False, True)
    assert len(got) == 4 and library.broken_documents(raw).count() == 3
    fields = {r.field: (r.occurrences, r.value_types) for r in library.unsupported_fields(m).collect()}
    assert fields == {"rating": (3, ["integer", "null", "string"]), "extra": (1, ["object"])}
    assert {(r.source_id, r.field, r.value_type) for r in library.unsupported_values(m).collect()} == {("1", "rating", "integer"), ("1", "extra", "object"), ("b", "rating", "string"), ("b", "rating", "null")}
    assert [(r.feature, r.n, r.cutover_blocker) for r in library.feature_blockers(catalogs).collect()] == [("workflows", 2, True)]
    counts = {r.measure: r.n for r in library.library_inventory(m, catalogs).collect()}
    assert (counts["documents"], counts["repeated_ids"], counts["catalog_workflows"], counts["unsupported_occurrences"]) == (4, 1, 2, 4)
    empty = library.library_inventory(library.map_library(raw.limit(0), catalogs.limit(0)), catalogs.limit(0))
    assert {r.n for r in empty.collect()} == {0}


def test_sync_touches_only_its_own_rows_and_ends(spark):
    kind = "d int, n int, text string, origin string"
    current = spark.createDataFrame([(1, 1, "a", "foreign"), (1, 2, "b", "foreign"), (1, 3, None, "foreign"), (2, 1, "own", "user"), (3, 1, "own", "user")], kind)
    wanted = spark.createDataFrame([(1, 1, "a"), (1, 2, "B"), (1, 3, "now"), (2, 1, "other"), (4, 1, "new"), (4, 1, "new")], "d int, n int, text string")
    changes = library.sync_rows(current, wanted, ["d", "n"], ["text"], "foreign")
    assert sorted(map(tuple, changes.collect())) == [("insert", 4, 1, "new"), ("update", 1, 2, "B"), ("update", 1, 3, "now")]
    after = library.apply_sync(current, changes, ["d", "n"], ["text"], "foreign")
    assert library.sync_rows(after, wanted, ["d", "n"], ["text"], "foreign").count() == 0
    gone = library.sync_rows(after, wanted.limit(0), ["d", "n"], ["text"], "foreign")
    assert sorted((r.op, r.d, r.n) for r in gone.collect()) == [("delete", 1, 1), ("delete", 1, 2), ("delete", 1, 3), ("delete", 4, 1)]
    left = library.apply_sync(after, gone, ["d", "n"], ["text"], "foreign")
    assert {(r.d, r.text) for r in left.collect()} == {(2, "own"), (3, "own")}


def test_samples_find_their_letters(spark):
    kind = "doc_id long, title_text string, organization_text string, identifier_text string, metadata_text string, body_text string"
    rows = spark.createDataFrame([(100, "Some title", "Haus AG", "RE-1", "", "long enough: Versicherungsnehmer, here"), (200, "Other", "Haus AG", "", "", "tiny"), (201, "Third", "", "", "", "x")], kind).selectExpr("*", "cast(null as date) as document_date")
    docs = rows.selectExpr("doc_id", "title_text as title", "identifier_text as archive_serial_number", "organization_text as correspondent", "body_text as body")
    sample = library.search_sample(docs)
    assert {(r.doc_id, r.kind): r.q for r in sample.collect()} == {(100, "title"): "Some title", (100, "identifier"): "RE-1", (100, "organization"): "Haus AG", (100, "full_text"): "Versicherungsnehmer", (200, "title"): "Other", (200, "organization"): "Haus AG"}
    got = library.sample_matches(sample, postings.search_indexed(sample, postings.build_postings(rows), rows, 20)).collect()
    assert len(got) == 6 and all(r.matched and len(r.query_sha256) == 64 for r in got)
    missed = library.sample_matches(sample, sample.selectExpr("query_id", "doc_id + 1 as doc_id"))
    assert not any(r.matched for r in missed.collect())


def test_rollups(spark):
    states = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "y")], "section string, state string")
    got = {(r.section, r.state, r.is_state): r.n for r in library.state_rollup(states).collect()}
    assert got == {("a", "x", True): 2, ("a", None, True): 1, ("b", "y", True): 1, ("a", None, False): 3, ("b", None, False): 1, (None, None, False): 4}
    items = spark.createDataFrame([(1, "imported"), (1, "failed"), (2, "skipped"), (3, "imported")], "run_id int, status string")
    assert {r.run_id: r.run_status for r in library.run_rollup(items).collect()} == {1: "failed", 2: "completed_with_warnings", 3: "completed"}
    none = spark.createDataFrame([], "source_id int, content_hash string, archive_hash string, metadata_hash string, document_id int, doc_id int, indexed boolean")
    assert {(r.n, r.of, r.ratio) for r in library.import_coverage(none, none, none).collect()} == {(0, 0, None)}
