"""Exact deduplication, immutable versions, and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterworks.functions import text as T
from letterworks.session import stage


def dedup_exact(df: DataFrame, hash_col: str, created: str, id_col: str) -> DataFrame:
    """All rows plus ``canonical_id``: of equal hashes the first created (smallest id of equals).

    The first of each hash comes from a partial aggregation, is written, and joined back: both sides of the join are
    plain, so adaptive execution broadcasts the firsts or splits a very frequent hash. A null hash equals no other.
    """
    first = stage(df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("_h")).agg(F.min(F.struct(created, id_col)).alias("_f")), "firsts")
    out = df.join(first, F.col(hash_col) == F.col("_h"), "left")
    return out.withColumn("canonical_id", F.coalesce(F.col(f"_f.{id_col}"), F.col(id_col))).withColumn("is_duplicate", F.col("canonical_id") != F.col(id_col)).drop("_h", "_f")


def upsert_versions(existing: DataFrame, incoming: DataFrame, identity: list[str]) -> DataFrame:
    """``existing`` plus the incoming rows with an unseen identity, each once; running it again changes nothing."""
    new = incoming.join(existing.select(*identity), identity, "left_anti").dropDuplicates(identity)
    return existing.unionByName(new)


def solid_chars(c: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(c, r"(?U)\s", ""))


def coverage(base: Column, candidate: Column) -> Column:
    """Share of the base's characters that the candidate has; of an empty base 1 if the candidate is empty too, else null."""
    return F.round(F.when(base > 0, candidate / base).when(candidate == 0, 1.0), 6)


def page_coverage(base: Column, candidate: Column) -> Column:
    """For each page of either version: page, base_non_whitespace, candidate_non_whitespace, coverage."""
    n = F.greatest(F.size(base), F.size(candidate))
    count = lambda pages, i: solid_chars(T.tidy_lines(F.coalesce(F.get(pages, i), F.lit(""))))
    counted = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("page"), count(base, i - 1).alias("x"), count(candidate, i - 1).alias("y")))
    rows = F.transform(
        counted, lambda p: F.struct(p["page"].alias("page"), p["x"].alias("base_non_whitespace"), p["y"].alias("candidate_non_whitespace"), coverage(p["x"], p["y"]).alias("coverage"))
    )
    return F.when(n > 0, rows).otherwise(F.array().cast("array<struct<page:int,base_non_whitespace:int,candidate_non_whitespace:int,coverage:double>>"))


def compare_versions(pairs: DataFrame, base: str = "base", cand: str = "candidate", pages: tuple[str, str] | None = None, critical: str | None = None) -> DataFrame:
    """``pairs`` plus equality of hashes, sizes, coverage, similarity, preserved critical values and coverage by page.

    ``pages``: columns with the pages of both versions (arrays of texts); without them a text is one page.
    ``critical``: a column with the values (array of texts) that the candidate should still have; empty ones do not
    count, and without any there is no preservation. Columns that are not selected are not computed.
    """
    a, b = F.col(base), F.col(cand)
    pa, pb = (F.col(c) for c in pages) if pages else (F.array(a), F.array(b))
    values = F.filter(F.col(critical), lambda v: v != "") if critical else F.array().cast("array<string>")
    kept = F.size(F.filter(values, lambda v: b.contains(v)))
    return pairs.withColumns(
        {
            "hashes_equal": F.sha2(a, 256) == F.sha2(b, 256),
            "base_chars": F.length(a),
            "candidate_chars": F.length(b),
            "coverage": coverage(solid_chars(a), solid_chars(b)),
            "base_pages": F.size(pa),
            "candidate_pages": F.size(pb),
            "critical_checked": F.size(values),
            "critical_preserved": F.round(F.when(F.size(values) > 0, kept / F.size(values)), 6),
            "page_coverage": page_coverage(pa, pb),
            "similarity": F.round(T.similarity_ratio(a, b), 6),
        }
    )


def comparison_status(equal: Column, similarity: Column, coverage: Column, preserved: Column) -> Column:
    """``equivalent`` for equal hashes, or very similar texts of about the same size without critical losses."""
    close = (similarity >= 0.985) & coverage.between(0.98, 1.2) & (preserved.isNull() | (preserved >= 1))
    return F.when(equal | close, "equivalent").otherwise("review_required")


def canonical_pointer(log: DataFrame, doc: str, version: str, order: list[str]) -> DataFrame:
    """The version that each document's log of promotions points to last, and how many promotions it had."""
    return log.groupBy(doc).agg(F.max_by(version, F.struct(*order)).alias("canonical_version"), F.count(F.lit(1)).alias("n_promotions"))


def version_history(versions: DataFrame, pointers: DataFrame, doc: str, version: str) -> DataFrame:
    """Versions with a canonical flag, normalized hash and length."""
    out = versions.join(pointers.select(doc, "canonical_version"), doc, "left")
    return out.withColumn("is_canonical", F.coalesce(F.col(version) == F.col("canonical_version"), F.lit(False))).drop("canonical_version")


def reuse_completed_runs(requests: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with the completed run of equal (null-safe) keys, the current one before the newest."""
    done = runs.where("status = 'completed'")
    renamed = done.select(*[F.col(k).alias(f"_{k}") for k in keys], "run_id", "is_current", "finished_at")
    best = renamed.groupBy(*[f"_{k}" for k in keys]).agg(F.max_by("run_id", F.struct(F.col("is_current").cast("int"), "finished_at", "run_id")).alias("reused_run"))
    on = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = test if on is None else on & test
    return requests.join(best, on, "left").drop(*[f"_{k}" for k in keys])


def supersede_pending(proposals: DataFrame, new_runs: DataFrame, doc: str) -> DataFrame:
    """Pending proposals of older runs of documents with a successful new run become superseded; others stay."""
    good = new_runs.where("status = 'completed'").groupBy(F.col(doc).alias("_d")).agg(F.max("run_id").alias("_new"))
    out = proposals.join(good, F.col(doc) == F.col("_d"), "left")
    old = (F.col("status") == "pending") & F.col("_new").isNotNull() & (F.col("run_id") != F.col("_new"))
    return out.withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).drop("_d", "_new")


def new_proposals(candidates: DataFrame, existing: DataFrame, identity: str) -> DataFrame:
    """Candidates with an unseen identity, each once, with ``evidence_verified``: some evidence, and all of it verified."""
    fresh = candidates.join(existing.select(identity), identity, "left_anti").dropDuplicates([identity])
    return fresh.withColumn("evidence_verified", (F.size("evidence") > 0) & F.forall("evidence", lambda e: e["verified"]))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
