"""Import of a foreign library as set reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterworks.session import stage

#: Tags that make a document urgent.
URGENT = ("important", "urgent", "priority")


def map_metadata(docs: DataFrame, catalogs: dict[str, DataFrame]) -> DataFrame:
    """Resolve ids through catalogs (column -> frame of id, name); what a catalog lacks becomes a placeholder."""
    for column, catalog in catalogs.items():
        c = catalog.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
        named = F.when(F.col(column).isNull(), F.lit(None)).otherwise(F.coalesce("_name", F.concat(F.lit(f"missing-{column}-"), F.col(column).cast("string"))))
        docs = docs.join(c, F.col(column) == F.col("_id"), "left").withColumn(f"{column}_name", named).drop("_id", "_name")
    return docs


def analyze_library(mapped: DataFrame) -> DataFrame:
    """(category, key, n): documents, types, unsupported fields, repeated ids, missing files; one pass and one small join."""
    item = lambda category, key, test: F.when(test, F.struct(F.lit(category).alias("category"), key.alias("key")))
    yes, everything = F.lit(True), F.lit("all")
    items = F.array(
        item("documents", everything, yes),
        item("type", F.col("type_name"), F.col("type_name").isNotNull()),
        item("unsupported_field", F.col("unsupported"), F.col("unsupported").isNotNull()),
        item("missing_file", F.lit("original"), F.col("original_missing")),
        item("missing_file", F.lit("archive"), F.col("archive_missing")),
    )
    counts = mapped.select(F.explode(F.array_compact(items)).alias("x")).groupBy("x.category", "x.key").agg(F.count(F.lit(1)).alias("n"))
    repeats = mapped.groupBy("source_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    repeated = repeats.agg(F.lit("repeated_id").alias("category"), F.lit("all").alias("key"), F.count(F.lit(1)).alias("n")).where("n > 0")
    return counts.unionByName(repeated)


def plan_import(source: DataFrame, existing: DataFrame) -> DataFrame:
    """import, skip or fail for each source document: unreadable ones fail, hashes seen before are skipped.

    An existing document comes before an earlier one of the source; unreadable documents never register their hash.
    The firsts are written before they are joined, so that a hash of very many documents can be split.
    """
    readable = source.where("not original_missing")
    first = stage(readable.groupBy(F.col("content_hash").alias("_h")).agg(F.min("source_id").alias("_first")), "import-firsts")
    there = existing.select(F.col("content_hash").alias("_e")).distinct()
    rows = source.join(first, F.col("content_hash") == F.col("_h"), "left").join(there, F.col("content_hash") == F.col("_e"), "left")
    reason = (
        F.when(F.col("original_missing"), "original_missing")
        .when(F.col("_e").isNotNull(), "duplicate_of_existing")
        .when(F.col("_first") != F.col("source_id"), "duplicate_of_source")
    )
    action = F.when(reason.isNull(), "import").when(reason == "original_missing", "failure").otherwise("skip")
    return rows.withColumns({"action": action, "reason": reason}).drop("_h", "_first", "_e")


def reconcile_import(source: DataFrame, items: DataFrame) -> DataFrame:
    """(source_id, outcome) of a resumed import: import, skip, reconcile (metadata), refuse (original), vanished."""
    s = source.select("source_id", F.col("metadata_hash").alias("sm"), F.col("content_hash").alias("so"))
    i = items.select(F.col("source_id").alias("_i"), F.col("metadata_hash").alias("im"), F.col("content_hash").alias("io"))
    both = s.join(i, F.col("source_id") == F.col("_i"), "full")
    outcome = (
        F.when(F.col("_i").isNull(), "import")
        .when(F.col("source_id").isNull(), "vanished")
        .when(F.col("so") != F.col("io"), "refuse")
        .when(F.col("sm") != F.col("im"), "reconcile")
        .otherwise("skip")
    )
    return both.select(F.coalesce("source_id", "_i").alias("source_id"), outcome.alias("outcome"))


def sync_links(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to insert and to delete so that ``current`` becomes ``wanted``."""
    add = wanted.join(current, keys, "left_anti").select(*keys, F.lit("insert").alias("op"))
    return add.unionByName(current.join(wanted, keys, "left_anti").select(*keys, F.lit("delete").alias("op")))


def import_discrepancies(source: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """(source_id, category, blocking): all that an import left out or changed; one full join and one left join.

    ``source``: source_id, content_hash, metadata_hash, original_missing, archive_missing; ``items`` adds status and
    document_id; ``docs``: doc_id, content_hash. The three content hashes must agree; an unknown one does not.
    """
    s = source.select("source_id", F.col("content_hash").alias("sc"), F.col("metadata_hash").alias("sm"), "original_missing", "archive_missing")
    i = items.select(F.col("source_id").alias("_i"), "status", "document_id", F.col("content_hash").alias("ic"), F.col("metadata_hash").alias("im"))
    d = docs.select("doc_id", F.col("content_hash").alias("dc"))
    rows = s.join(i, F.col("source_id") == F.col("_i"), "full").join(d, F.col("document_id") == F.col("doc_id"), "left")
    listed, recorded = F.col("source_id").isNotNull(), F.col("_i").isNotNull()
    both = listed & recorded
    found = both & F.col("doc_id").isNotNull()
    agree = F.coalesce((F.col("sc") == F.col("ic")) & (F.col("ic") == F.col("dc")), F.lit(False))
    tests = {
        "source_item_missing": (listed & ~recorded, True),
        "source_document_removed": (recorded & ~listed, False),
        "migration_failure": (F.col("status") == "failed", True),
        "document_link_missing": (both & F.col("document_id").isNull(), True),
        "document_missing": (both & F.col("document_id").isNotNull() & F.col("doc_id").isNull(), True),
        "source_original_missing": (found & F.col("original_missing"), True),
        "original_hash_mismatch": (found & ~F.col("original_missing") & ~agree, True),
        "source_archive_missing": (found & ~F.col("original_missing") & F.col("archive_missing"), True),
        "metadata_missing_or_stale": (found & ~F.col("sm").eqNullSafe(F.col("im")), True),
    }
    one = lambda name, blocking: F.struct(F.lit(name).alias("category"), F.lit(blocking).alias("blocking"))
    each = F.array_compact(F.array(*[F.when(test, one(name, blocking)) for name, (test, blocking) in tests.items()]))
    return rows.select(F.coalesce("source_id", "_i").alias("source_id"), F.explode(each).alias("x")).select("source_id", "x.*")


def verify_import(source: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """(category, blocking, n) of the discrepancies."""
    return import_discrepancies(source, items, docs).groupBy("category", "blocking").agg(F.count(F.lit(1)).alias("n"))


def import_verdict(discrepancies: DataFrame, items: DataFrame) -> DataFrame:
    """One row: items by status, blocking and other discrepancies, and FAIL, PASS WITH WARNINGS (also for skipped or unsupported items) or PASS.

    ``discrepancies``: category, blocking, n; ``items``: status, unsupported.
    """
    n = lambda test: F.count(F.when(test, 1))
    status = F.col("status")
    counts = items.agg(
        F.count(F.lit(1)).alias("n_items"), n(status == "imported").alias("n_imported"), n(status == "skipped").alias("n_skipped"), n(status == "failed").alias("n_failed"), n(F.col("unsupported").isNotNull()).alias("n_unsupported")
    )
    found = discrepancies.agg(F.coalesce(F.sum(F.when(F.col("blocking"), F.col("n"))), F.lit(0)).alias("n_blocking"), F.coalesce(F.sum(F.when(~F.col("blocking"), F.col("n"))), F.lit(0)).alias("n_other"))
    warned = F.col("n_other") + F.col("n_skipped") + F.col("n_unsupported") > 0
    return counts.join(found).withColumn("verdict", F.when(F.col("n_blocking") > 0, "FAIL").when(warned, "PASS WITH WARNINGS").otherwise("PASS"))  # one row each


def import_priority(tags: Column, dated: Column, today: str) -> Column:
    """high for urgent tags, background for documents of the last year, else bulk."""
    urgent = F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*[F.lit(x) for x in URGENT]))
    return F.when(urgent, "high").when(F.datediff(F.lit(today).cast("date"), dated) <= 365, "background").otherwise("bulk")


def duplicate_groups(source: DataFrame) -> DataFrame:
    """Readable documents that share their content, with the size and the first of the group; no group is gathered or sorted."""
    rows = source.where("not original_missing")
    shared = rows.groupBy(F.col("content_hash").alias("_h")).agg(F.count(F.lit(1)).alias("group_size"), F.min("source_id").alias("first_id")).where("group_size > 1")
    return rows.join(stage(shared, "import-groups"), F.col("content_hash") == F.col("_h")).drop("_h")


def import_volume(planned: DataFrame) -> DataFrame:
    """Documents and bytes by action and reason of an import plan with ``n_bytes``."""
    return planned.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))
