"""Review queues and the folding of decisions into canonical values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterworks.operators.entities import resolve_organizations

#: How early a field comes in a review; others 50.
FIELD_PRIORITY = {
    "cancellation_deadline": 100,
    "payment_due_date": 100,
    "due_date": 100,
    "contract_end": 95,
    "contract_start": 95,
    "invoice_total": 94,
    "total_rent": 94,
    "account_balance": 92,
    "document_type": 90,
    "organization": 88,
    "identifier": 86,
    "product_name": 84,
    "title": 80,
    "life_area": 78,
    "document_date": 76,
    "invoice_date": 76,
    "other_date": 10,
    "other_amount": 10,
    "amount": 8,
}
DEFAULT_PRIORITY = 50


def review_queue(docs: DataFrame, proposals: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Documents with pending work: counts of pending proposals and whether a comparison is undecided, each counted before the join."""
    pending = proposals.where("status = 'pending'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pending"), F.count(F.when(F.col("critical"), 1)).alias("n_critical"))
    open_ = comparisons.where("not decided").select("doc_id").distinct().withColumn("undecided", F.lit(True))
    out = docs.join(pending, "doc_id", "left").join(open_, "doc_id", "left")
    out = out.withColumns({"n_pending": F.coalesce("n_pending", F.lit(0)), "n_critical": F.coalesce("n_critical", F.lit(0)), "undecided": F.coalesce("undecided", F.lit(False))})
    return out.where("n_pending > 0 or undecided")


def review_page(docs: DataFrame, proposals: DataFrame, knowledge: DataFrame, comparisons: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Documents that need review, oldest first: pending metadata and knowledge, an undecided comparison, and the warnings of the canonical text.

    ``docs``: doc_id, created_at, status, canonical_extraction_id, warnings; ``comparisons``: doc_id, baseline_id, review_decision (a
    comparison counts while its baseline is still the canonical one). Everything is counted before it is joined.
    """
    count = lambda df, name: df.where("status = 'pending'").groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    current = docs.select("doc_id", F.col("canonical_extraction_id").alias("baseline_id"))
    open_ = comparisons.where("review_decision is null").join(current, ["doc_id", "baseline_id"], "left_semi").select("doc_id").distinct().withColumn("extraction_review_required", F.lit(True))
    rows = docs.where("status = 'needs_review'").join(count(proposals, "proposal_count"), "doc_id", "left").join(count(knowledge, "knowledge_proposal_count"), "doc_id", "left").join(open_, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    warnings = F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings")
    out = rows.select("doc_id", "created_at", warnings, zero("proposal_count"), zero("knowledge_proposal_count"), F.coalesce("extraction_review_required", F.lit(False)).alias("extraction_review_required"))
    return out if limit is None else out.orderBy("created_at", "doc_id").offset(offset).limit(limit)


def review_detail(docs: DataFrame, jobs: DataFrame, history: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` with latest_job (by created_at, id), current_run, and the history of their fields, newest first.

    ``jobs``: doc_id, job_id, created_at, state; ``history``: doc_id, confirmed_at, field, value; ``runs``: doc_id, run_id, is_current.
    A document's history is one array.
    """
    latest = jobs.groupBy("doc_id").agg(F.max_by(F.struct("job_id", "state"), F.struct("created_at", "job_id")).alias("latest_job"))
    current = runs.where("is_current").groupBy("doc_id").agg(F.max("run_id").alias("current_run"))
    past = history.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("confirmed_at", "field", "value")), False).alias("metadata_history"))
    return reduce(lambda a, b: a.join(b, "doc_id", "left"), (latest, current, past), docs)


def field_priority(field: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FIELD_PRIORITY.items() for x in kv])
    return F.coalesce(known[field], F.lit(DEFAULT_PRIORITY))


def rank_proposals(proposals: DataFrame) -> DataFrame:
    """The place of each proposal in its document: by field, critical first, surest first, then as given."""
    w = Window.partitionBy("doc_id").orderBy(field_priority(F.col("field")).desc(), F.col("critical").desc(), F.coalesce("confidence", F.lit(0.0)).desc(), "proposal_id")
    return proposals.withColumn("rank", F.row_number().over(w))


def apply_decisions(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statuses of all proposals, and the canonical value of each decided field of a document.

    The last accepting decision of a field wins; other proposals of the field are superseded unless rejected.
    """
    last = decisions.groupBy("proposal_id").agg(F.max_by(F.struct("decision", "edited", "decided_at"), F.struct("decided_at", "decision")).alias("d"))
    rows = proposals.join(last, "proposal_id", "left")
    takes = F.col("d.decision").isin("accept", "edit")
    won = rows.where(takes).groupBy("doc_id", "field").agg(F.max_by(F.struct("proposal_id", F.coalesce("d.edited", "value").alias("value")), F.struct("d.decided_at", "proposal_id")).alias("w"))
    out = rows.join(won, ["doc_id", "field"], "left")
    status = (
        F.when(F.col("w.proposal_id") == F.col("proposal_id"), "accepted")
        .when(F.col("d.decision") == "reject", "rejected")
        .when(F.col("w").isNotNull(), "superseded")
        .otherwise("pending")
    )
    canonical = won.select("doc_id", "field", F.col("w.value").alias("value"))
    return out.select("proposal_id", "doc_id", "field", status.alias("status")), canonical


def metadata_history(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each field that changed, nulls compared as values."""
    long = lambda df, name: df.unpivot([key], [F.col(f).cast("string").alias(f) for f in fields], "field", name)
    both = long(before, "previous").join(long(after, "current"), [key, "field"], "full")
    return both.where(~F.col("previous").eqNullSafe(F.col("current")))


def knowledge_review_queue(
    proposals: DataFrame,
    sort: str = "priority",
    low: float | None = None,
    high: float | None = None,
    kind: str | None = None,
    limit: int = 50,
    document_id: int | None = None,
    document_type: str | None = None,
    docs: DataFrame | None = None,
    offset: int = 0,
) -> DataFrame:
    """A page of pending proposals in one of five orders; ``docs`` (document_id, document_type) is needed to filter by the document's type."""
    rows = proposals.where("status = 'pending'")
    if document_type is not None:
        wanted = docs.where(F.lower("document_type") == document_type.strip().casefold())
        rows = rows.join(wanted.select("document_id"), "document_id", "left_semi")
    for column, value in (("proposal_type", kind), ("document_id", document_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if low is not None:
        rows = rows.where(F.col("confidence") >= low)
    if high is not None:
        rows = rows.where(F.col("confidence") <= high)
    t = F.col("proposal_type")
    group = F.when(t.isin("deadline", "action_item"), 0).when(t.isin("contract", "event"), 1).otherwise(2)
    created, sure = F.col("created_at"), F.col("confidence")
    orders = {"priority": [group, sure.desc(), created], "confidence_desc": [sure.desc(), created], "confidence_asc": [sure, created], "oldest": [created], "newest": [created.desc(), F.col("proposal_id").desc()]}
    return rows.orderBy(*orders[sort], "proposal_id").offset(offset).limit(limit)


def with_organization_match(page: DataFrame, orgs: DataFrame, aliases: DataFrame, accepted: DataFrame) -> DataFrame:
    """A page of proposals plus, for those of organizations, possible_existing_organization_id and match_reason.

    ``page`` has proposal_id, proposal_type, name and strong (identifiers); see ``resolve_organizations``.
    """
    cands = page.where("proposal_type = 'organization'").select(F.col("proposal_id").alias("cand_id"), F.trim("name").alias("name"), "strong")
    found = resolve_organizations(cands, orgs, aliases, accepted).where("org_id is not null").select(F.col("cand_id").alias("proposal_id"), F.col("org_id").alias("possible_existing_organization_id"), "match_reason")
    return page.join(found, "proposal_id", "left")
