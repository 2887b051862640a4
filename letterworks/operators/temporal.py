"""Timelines, deadlines and reminders. ``today`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days before a deadline at which reminders begin, by type; unknown types count as ``other``.
LEAD_DAYS = {"payment": 7, "cancellation": 30, "renewal": 30, "response": 7, "submission": 7, "appointment": 2, "other": 7}
PAGE = 500


def timeline(events: DataFrame, **filters) -> DataFrame:
    """Events that meet the given filters (``organization_id``, ``event_type``, ``date_from``, ``date_to``), latest first."""
    for key in ("organization_id", "event_type", "doc_id", "life_area"):
        if filters.get(key) is not None:
            events = events.where(F.col(key) == filters[key])
    if filters.get("date_from"):
        events = events.where(F.col("event_date") >= F.lit(filters["date_from"]).cast("date"))
    if filters.get("date_to"):
        events = events.where(F.col("event_date") <= F.lit(filters["date_to"]).cast("date"))
    return events


def timeline_by_month(events: DataFrame) -> DataFrame:
    """Events by calendar month; those without a date are ``unresolved``."""
    month = F.coalesce(F.date_format("event_date", "yyyy-MM"), F.lit("unresolved"))
    return events.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("doc_id").alias("n_documents"))


def list_open(items: DataFrame, order: list[Column], limit: int = PAGE, due_before: str | None = None, **equal) -> DataFrame:
    """Deadlines or action items that meet the filters, the earliest first, those without a date last; a page of them."""
    for key, value in equal.items():
        if value is not None:
            items = items.where(F.col(key) == value)
    if due_before:
        items = items.where(F.col("due_at") <= F.lit(due_before).cast("date"))
    return items.orderBy(F.col("due_at").asc_nulls_last(), *order).limit(limit)


def deadline_state(status: Column, due: Column, snoozed_until: Column, today: str) -> Column:
    """completed, dismissed, snoozed, upcoming, due or overdue."""
    day = F.lit(today).cast("date")
    return (
        F.when(status.isin("completed", "dismissed"), status)
        .when((status == "snoozed") & (snoozed_until.isNull() | (snoozed_until > day)), "snoozed")
        .when(due.isNull() | (due > day), "upcoming")
        .when(due == day, "due")
        .otherwise("overdue")
    )


def upcoming_buckets(deadlines: DataFrame, today: str, limit: int = PAGE) -> DataFrame:
    """The first open or snoozed deadlines with their bucket."""
    day = F.lit(today).cast("date")
    first = deadlines.where("status in ('open', 'snoozed')").orderBy(F.col("due_at").asc_nulls_last(), "deadline_id").limit(limit)
    sleeping = (F.col("status") == "snoozed") & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") > day))
    left = F.datediff("due_at", day)
    bucket = (
        F.when(sleeping, "snoozed").when(left.isNull(), "future").when(left < 0, "overdue").when(left == 0, "today").when(left <= 7, "next_7").when(left <= 30, "next_30").otherwise("future")
    )
    return first.withColumn("bucket", bucket)


def _elapsed(day: Column) -> Column:
    return (F.col("status") == "snoozed") & F.col("snoozed_until").isNotNull() & (F.col("snoozed_until") <= day)


def woken_history(deadlines: DataFrame, today: str) -> DataFrame:
    """A history row for each deadline whose snooze has ended: its state before and after."""
    state = lambda s: F.lit(f'{{"status":"{s}"}}')
    rows = deadlines.where(_elapsed(F.lit(today).cast("date")))
    return rows.select("deadline_id", F.lit("snooze_elapsed").alias("action"), state("snoozed").alias("previous_json"), state("open").alias("new_json"))


def due_reminders(deadlines: DataFrame, sent: DataFrame, today: str, limit: int = PAGE) -> DataFrame:
    """Reminders of one cycle with the day they were meant for: expired snoozes wake, kinds already sent are left out, the earliest due first."""
    day = F.lit(today).cast("date")
    awake = (F.col("status") == "open") | _elapsed(day)
    leads = F.create_map(*[F.lit(x) for kv in LEAD_DAYS.items() for x in kv])
    lead = F.coalesce(leads[F.col("deadline_type")], F.lit(LEAD_DAYS["other"]))
    left = F.datediff("due_at", day)
    kind = F.when(left < 0, "overdue").when(left == 0, "due").when(left <= lead, "upcoming")
    rows = deadlines.where(awake & F.col("due_at").isNotNull()).withColumn("kind", kind).where("kind is not null")
    rows = rows.join(sent.select("deadline_id", "kind"), ["deadline_id", "kind"], "left_anti")
    meant = F.when(F.col("kind") == "overdue", F.date_add("due_at", 1)).when(F.col("kind") == "due", F.col("due_at")).otherwise(F.date_sub("due_at", lead))
    return rows.withColumns({"woken": F.col("status") == "snoozed", "scheduled_for": meant}).orderBy("due_at", "deadline_id").limit(limit)


def apply_status_changes(deadlines: DataFrame, log: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """The deadlines after the valid changes of a log, and the refused changes.

    A snooze needs a date after ``today`` and no other status may have one; the last valid change wins.
    """
    day = F.lit(today).cast("date")
    good = F.when(F.col("new_status") == "snoozed", F.coalesce(F.col("until") > day, F.lit(False))).otherwise(F.col("until").isNull())
    good = good & F.col("new_status").isin("open", "completed", "dismissed", "snoozed")
    last = log.where(good).groupBy("deadline_id").agg(F.max_by(F.struct("new_status", "until", "at"), F.struct("at", "change_id")).alias("c"))
    out = deadlines.join(last, "deadline_id", "left")
    changed = F.col("c").isNotNull()
    return out.select(
        "deadline_id",
        F.when(changed, F.col("c.new_status")).otherwise(F.col("status")).alias("status"),
        F.when(changed, F.col("c.until")).otherwise(F.col("snoozed_until")).alias("snoozed_until"),
        F.when(F.col("c.new_status") == "completed", F.col("c.at")).alias("completed_at"),
    ), log.where(~good)
