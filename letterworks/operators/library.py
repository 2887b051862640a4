"""A foreign library's documents as they come (JSON objects), mapped, analysed, synchronised and verified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterworks.functions import text as T
from letterworks.session import stage

#: Fields of a foreign document that have a place of their own; all others are unsupported and kept as they are.
KNOWN = (
    "id", "title", "created", "added", "correspondent", "document_type", "tags", "custom_fields", "notes", "archive_serial_number", "owner", "permissions", "original_file",
    "archived_file", "archived_file_name", "original_file_name", "storage_path", "modified", "content", "page_count",
)
#: Where unsupported fields are kept, and features that stand in the way of a cutover.
HANDLING = "preserved_metadata_and_canonical_metadata.migration.unsupported."
BLOCKING_FEATURES = ("workflows",)
#: Statuses of a run.
RUN_STATUS = ("failed", "completed_with_warnings", "completed")


def _fields(raw: Column) -> Column:
    """The fields of a JSON object: a map of names to JSON texts."""
    return F.transform_values(F.try_parse_json(raw).try_cast("map<string,variant>"), lambda k, v: F.to_json(v))


def _scalar(json: Column) -> Column:
    """A JSON string without its quotes, or the text of another value; null of null."""
    return F.when(json != "null", F.when(json.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), "v string")["v"]).otherwise(json))


def _list(json: Column) -> Column:
    """The elements of a JSON array as JSON texts; an empty array for anything else."""
    variants = F.try_parse_json(F.coalesce(json, F.lit("[]"))).cast("array<variant>")
    none = F.array().cast("array<string>")
    return F.when(json.startswith("["), F.coalesce(F.transform(variants, lambda v: F.coalesce(F.to_json(v), F.lit("null"))), none)).otherwise(none)


def map_library(raw: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Foreign documents (column ``raw``: a JSON object) with all ids resolved through ``catalogs`` (kind, id, name, detail).

    All references of a document (its correspondent, type, storage path, tags, and fields' definitions) are resolved in one
    join and put back in their places. What a catalog lacks: no correspondent, type or definition; a tag and a storage path
    go by their id. A row for each document: source_id, title, created, correspondent, document_type, storage_path, tags,
    custom_fields (field, name, data_type, value as JSON), n_notes, archive_serial_number, has_content, unsupported (map of
    JSON texts) and metadata_hash. Rows that are no JSON object are left out; see ``broken_documents``.
    """
    d = raw.select(_fields(F.col("raw")).alias("m"), F.sha2("raw", 256).alias("metadata_hash")).where("m is not null")
    # A document's place keeps documents of equal id apart.
    d = stage(d.withColumn("place", F.monotonically_increasing_id()), "library-fields")
    get = lambda k: F.col("m")[k]
    one = lambda kind, v: F.when(_scalar(v).isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("pos"), _scalar(v).alias("id"), F.lit(None).cast("string").alias("value"))))
    tags = F.transform(_list(get("tags")), lambda v, i: F.struct(F.lit("tag").alias("kind"), i.alias("pos"), _scalar(v).alias("id"), F.lit(None).cast("string").alias("value")))
    loose = lambda v: ~v.startswith("{")
    inner = lambda v, k: F.coalesce(F.get_json_object(v, f"$.{k}"), F.lit(None).cast("string"))
    custom = F.transform(
        _list(get("custom_fields")),
        lambda v, i: F.struct(F.lit("custom_field").alias("kind"), i.alias("pos"), F.when(~loose(v), inner(v, "field")).alias("id"), F.when(loose(v), v).otherwise(F.to_json(F.try_parse_json(v).cast("map<string,variant>")["value"])).alias("value")),
    )
    refs = F.concat(*[F.coalesce(x, F.array().cast("array<struct<kind:string,pos:int,id:string,value:string>>")) for x in (one("correspondent", get("correspondent")), one("document_type", get("document_type")), one("storage_path", get("storage_path")), tags, custom)])
    rows = d.select("place", F.explode(refs).alias("r")).select("place", "r.*")
    names = catalogs.select(F.col("kind").alias("_k"), F.col("id").cast("string").alias("_id"), "name", "detail")
    rows = rows.join(names, (F.col("kind") == F.col("_k")) & (F.col("id") == F.col("_id")), "left").drop("_k", "_id")
    found = rows.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("kind", "pos", "id", "value", "name", "detail"))).alias("refs"))
    of = lambda kind: F.filter(F.coalesce("refs", F.array().cast("array<struct<kind:string,pos:int,id:string,value:string,name:string,detail:string>>")), lambda r: r["kind"] == kind)
    first = lambda kind: F.get(of(kind), F.lit(0))
    return d.join(found, "place", "left").select(
        _scalar(get("id")).alias("source_id"),
        _scalar(get("title")).alias("title"),
        T.parse_iso_prefix(_scalar(get("created"))).alias("created"),
        first("correspondent")["name"].alias("correspondent"),
        first("document_type")["name"].alias("document_type"),
        F.coalesce(first("storage_path")["name"], first("storage_path")["id"]).alias("storage_path"),
        F.transform(of("tag"), lambda r: F.coalesce(r["name"], r["id"])).alias("tags"),
        F.transform(of("custom_field"), lambda r: F.struct(r["id"].alias("field"), r["name"].alias("name"), r["detail"].alias("data_type"), r["value"].alias("value"))).alias("custom_fields"),
        F.size(_list(get("notes"))).alias("n_notes"),
        _scalar(get("archive_serial_number")).alias("archive_serial_number"),
        F.coalesce(get("content").startswith('"'), F.lit(False)).alias("has_content"),
        (F.coalesce(_scalar(get("original_file")), _scalar(get("original_file_name")), F.lit("")) != "").alias("has_original"),
        (F.coalesce(_scalar(get("archived_file")), _scalar(get("archived_file_name")), F.lit("")) != "").alias("has_archive"),
        F.map_filter("m", lambda k, v: ~k.isin(*KNOWN)).alias("unsupported"),
        "metadata_hash",
    )


def broken_documents(raw: DataFrame) -> DataFrame:
    """Rows whose ``raw`` is no JSON object."""
    return raw.where(_fields(F.col("raw")).isNull())


def unsupported_fields(mapped: DataFrame) -> DataFrame:
    """One row for each unsupported field: occurrences, the types of its values over all of them, where they are kept, and whether that blocks."""
    each = mapped.select(F.explode("unsupported").alias("field", "value"))
    rows = each.groupBy("field").agg(F.count(F.lit(1)).alias("occurrences"), F.sort_array(F.collect_set(T.json_type(F.col("value")))).alias("value_types"))
    return rows.select("field", "occurrences", "value_types", F.concat(F.lit(HANDLING), "field").alias("handling"), F.lit(True).alias("preserved"), F.lit(False).alias("cutover_blocker"))


def unsupported_values(mapped: DataFrame) -> DataFrame:
    """source_id, field, value (long ones cut, contents by their hash), value_type of every occurrence."""
    return mapped.select("source_id", F.explode("unsupported").alias("field", "value")).select("source_id", "field", T.redact(F.col("field"), F.col("value")).alias("value"), T.json_type(F.col("value")).alias("value_type"))


def feature_blockers(catalogs: DataFrame) -> DataFrame:
    """Features of the library that are only reported: feature, n, handling, preserved, cutover_blocker."""
    rows = catalogs.where(F.col("kind").isin(*BLOCKING_FEATURES)).groupBy(F.col("kind").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("feature", "n", F.lit("reported_only_configuration_not_imported").alias("handling"), F.lit(False).alias("preserved"), F.lit(True).alias("cutover_blocker"))


def library_inventory(mapped: DataFrame, catalogs: DataFrame) -> DataFrame:
    """(measure, n): documents and what they hold, entries of each catalog, and repeated ids; one pass over each."""
    yes = lambda c: F.sum(F.col(c).cast("long"))
    measures = {
        "documents": F.count(F.lit(1)),
        "notes": F.sum(F.col("n_notes").cast("long")),
        "contents": yes("has_content"),
        "original_files": yes("has_original"),
        "archived_files": yes("has_archive"),
        "documents_with_unsupported": F.sum((F.size("unsupported") > 0).cast("long")),
        "unsupported_occurrences": F.sum(F.size("unsupported").cast("long")),
    }
    totals = mapped.agg(*[F.coalesce(v, F.lit(0).cast("long")).alias(k) for k, v in measures.items()])
    parts = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in measures])
    per_catalog = catalogs.groupBy(F.concat(F.lit("catalog_"), "kind").alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    repeats = mapped.groupBy("source_id").agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.lit("repeated_ids").alias("measure"), F.coalesce(F.sum("k"), F.lit(0).cast("long")).alias("n"))
    return totals.select(F.inline(parts)).unionByName(per_catalog).unionByName(repeats)


def sync_rows(current: DataFrame, wanted: DataFrame, keys: list[str], values: list[str], origin: str) -> DataFrame:
    """The changes (op, keys, values) that make the rows of ``origin`` in ``current`` those of ``wanted``; one full join.

    Missing rows are inserted, others updated where a value differs (null-safe), rows of the origin that are no longer wanted
    deleted. Rows of another origin stay, and hold their key.
    """
    c = current.select(*[F.col(k).alias(f"c_{k}") for k in (*keys, *values)], F.col("origin").alias("c_origin"))
    w = wanted.select(*keys, *values).dropDuplicates(keys).withColumn("w", F.lit(True))
    rows = c.join(w, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys]), "full")
    own = F.col("c_origin") == origin
    differs = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"c_{v}")) for v in values], F.lit(False))
    op = F.when(F.col("c_origin").isNull(), "insert").when(own & F.col("w").isNull(), "delete").when(own & F.col("w") & differs, "update")
    kept = lambda k: F.when(F.col("w").isNull(), F.col(f"c_{k}")).otherwise(F.col(k)).alias(k)
    return rows.withColumn("op", op).where("op is not null").select("op", *[kept(k) for k in keys], *[F.when(F.col("op") != "delete", F.col(v)).alias(v) for v in values])


def apply_sync(current: DataFrame, changes: DataFrame, keys: list[str], values: list[str], origin: str) -> DataFrame:
    """``current`` after the changes."""
    touched = changes.where("op <> 'insert'").select(*keys)
    rest = current.join(touched, keys, "left_anti") if keys else current
    new = changes.where("op <> 'delete'").select(*keys, *values, F.lit(origin).alias("origin"))
    return rest.select(*keys, *values, "origin").unionByName(new)


def run_rollup(items: DataFrame) -> DataFrame:
    """Items (run_id, status) by run: imported, skipped, failed, and the status of the run."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    rows = items.groupBy("run_id").agg(n("imported"), n("skipped"), n("failed"))
    status = F.when(F.col("n_failed") > 0, RUN_STATUS[0]).when(F.col("n_skipped") > 0, RUN_STATUS[1]).otherwise(RUN_STATUS[2])
    return rows.withColumn("run_status", status)


def import_coverage(source: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """(section, measure, n, of, ratio): links, hashes of originals and archives, metadata and searchable rows, each of how many.

    ``source``: source_id, content_hash, archive_hash (null: none), metadata_hash; ``items`` adds document_id; ``docs``: doc_id,
    content_hash, archive_hash, indexed. An archive equal to its original counts as covered.
    """
    s = source.select("source_id", F.col("content_hash").alias("sc"), F.col("archive_hash").alias("sa"), F.col("metadata_hash").alias("sm"))
    i = items.select(F.col("source_id").alias("_i"), "document_id", F.col("metadata_hash").alias("im"))
    d = docs.select("doc_id", F.col("content_hash").alias("dc"), F.col("archive_hash").alias("da"), "indexed")
    rows = s.join(i, F.col("source_id") == F.col("_i"), "left").join(d, F.col("document_id") == F.col("doc_id"), "left")
    linked = F.col("doc_id").isNotNull()
    archived = F.col("sa").isNotNull()
    same = archived & (F.col("sa") == F.col("sc"))
    tests = [
        ("coverage", "linked_documents", linked, F.lit(True)),
        ("assets", "original_hash_matches", linked & (F.col("sc") == F.col("dc")), F.lit(True)),
        ("assets", "archive_hash_matches", linked & (F.col("sa") == F.col("da")), archived),
        ("assets", "archives_covered_by_original", same, archived),
        ("metadata", "complete", linked & F.col("sm").eqNullSafe(F.col("im")), F.lit(True)),
        ("search", "projections", linked & F.col("indexed"), linked),
    ]
    n = lambda test: F.count(F.when(test, 1))
    counts = rows.agg(*[n(test).alias(f"n{k}") for k, (_, _, test, _) in enumerate(tests)], *[n(of).alias(f"of{k}") for k, (_, _, _, of) in enumerate(tests)])
    parts = F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("measure"), F.col(f"n{k}").alias("n"), F.col(f"of{k}").alias("of")) for k, (a, b, _, _) in enumerate(tests)])
    return counts.select(F.inline(parts)).withColumn("ratio", F.when(F.col("of") > 0, F.round(F.col("n") / F.col("of"), 6)))


def state_rollup(states: DataFrame) -> DataFrame:
    """(section, state, n) with the total of each section (state null) and of all: one pass with grouping sets.

    ``states``: section, state, one row for each job, document or proposal of an imported document.
    """
    rolled = states.rollup("section", "state").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    return rolled.where("_g < 3 or n > 0").select("section", "state", "n", (F.col("_g") == 0).alias("is_state"))


def search_sample(docs: DataFrame, every: int = 100) -> DataFrame:
    """(query_id, kind, doc_id, q): representative searches for documents whose id is divisible by ``every``.

    By title, by archive number, by organization and by the longest word of the text (of six characters and more, the first of
    equals). ``docs``: doc_id, title, archive_serial_number, correspondent, body.
    """
    words = F.filter(F.split("body", r"\s+"), lambda w: F.length(w) >= 6)
    ordered = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    token = F.regexp_replace(F.get(ordered, F.lit(0))["w"], r"^[.,:;()\[\]]+|[.,:;()\[\]]+$", "")
    kinds = {"title": F.col("title"), "identifier": F.col("archive_serial_number").cast("string"), "organization": F.col("correspondent"), "full_text": token}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("q")) for k, v in kinds.items()])
    rows = docs.where(F.col("doc_id") % every == 0).select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*").where("q is not null and q <> ''")
    return rows.withColumn("query_id", F.concat_ws(":", "doc_id", "kind"))


def sample_matches(sample: DataFrame, results: DataFrame) -> DataFrame:
    """``sample`` with the hash of each query instead of its text, and whether its document is among the results (query_id, doc_id)."""
    hit = results.select("query_id", "doc_id").distinct().withColumn("_hit", F.lit(True))
    rows = sample.join(hit, ["query_id", "doc_id"], "left")
    return rows.select("doc_id", "kind", F.sha2("q", 256).alias("query_sha256"), F.coalesce("_hit", F.lit(False)).alias("matched"))
