"""Reports on a job journal, stored assets, and sign-in attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterworks.session import stage

#: Which state may follow which, the active, final and unsuccessful states, and the limits of resource classes.
NEXT = {
    "queued": ("claimed", "cancelled", "failed"),
    "claimed": ("extracting", "queued", "cancel_requested", "failed", "timed_out"),
    "extracting": ("ocr", "normalizing", "queued", "cancel_requested", "failed", "timed_out"),
    "ocr": ("normalizing", "queued", "cancel_requested", "failed", "timed_out"),
    "normalizing": ("completed", "queued", "cancel_requested", "failed", "timed_out"),
    "cancel_requested": ("cancelled", "completed", "failed", "timed_out"),
    "cancelled": (),
    "timed_out": ("queued",),
    "completed": (),
    "failed": ("queued",),
}
ACTIVE = ("claimed", "extracting", "ocr", "normalizing", "cancel_requested")
FINAL = ("completed", "failed", "timed_out", "cancelled")
UNSUCCESSFUL = ("failed", "timed_out", "cancelled")
RETRYABLE = ("retryable", "timeout")
CLASS_LIMIT = 2
AGING_SECONDS = 900
#: Newest jobs whose latencies are reported, and values up to which a key's list is sorted whole for its p95.
RECENT = 1000
SORTED_WHOLE = 1000


def journal_replay(events: DataFrame) -> DataFrame:
    """Each event with the state before it and whether the transition is allowed."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in NEXT.items() for b in bs])
    step = F.concat("from_state", F.lit(">"), "to_state")
    legal = F.when(F.col("from_state").isNull(), F.col("to_state") == "queued").otherwise(F.array_contains(allowed, step))
    return events.withColumn("from_state", F.lag("to_state").over(w)).withColumn("legal", legal)


def job_states(events: DataFrame) -> DataFrame:
    """Where each job stands after its journal, and how many of its transitions were not allowed."""
    replay = journal_replay(events)
    return replay.groupBy("job_id").agg(
        F.max_by("to_state", F.struct("ts", "event_id")).alias("state"),
        F.count(F.when(F.col("to_state") == "claimed", 1)).alias("attempts"),
        F.max(F.when(F.col("to_state").isin(*FINAL), F.col("ts"))).alias("terminal_at"),
        F.count(F.when(~F.col("legal"), 1)).alias("n_illegal"),
    )


def execution_metrics(jobs: DataFrame, now: str) -> DataFrame:
    """Counts by kind and key in one pass; a count of none has no row.

    Depth by priority, running by class, failures by their class (``timeout`` and ``cancelled`` among them), retries,
    deferred admissions, degraded completions, and completions of the last hour.
    """
    hour = F.lit(now).cast("timestamp") - F.expr("interval 1 hour")
    item = lambda kind, key, test, n=1: F.when(test, F.struct(F.lit(kind).alias("metric"), key.alias("key"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.cast("long").alias("n")))
    none = F.lit("all")
    items = F.array(
        item("queue_depth", F.col("priority"), F.col("state") == "queued"),
        item("running", F.col("resource_class"), F.col("state").isin(*ACTIVE)),
        item("failures", F.col("failure_class"), F.col("state").isin(*UNSUCCESSFUL) & F.col("failure_class").isNotNull()),
        item("retries", none, F.col("attempts") > 1, F.col("attempts") - 1),
        item("admission_deferrals", none, F.col("admission_deferrals") > 0, F.col("admission_deferrals")),
        item("degraded_completions", none, (F.col("state") == "completed") & (F.col("failure_class") == "degraded")),
        item("completed_last_hour", none, (F.col("state") == "completed") & (F.col("finished_at") >= hour)),
    )
    return jobs.select(F.explode(F.array_compact(items)).alias("x")).groupBy("x.metric", "x.key").agg(F.sum("x.n").alias("n"))


def latency_summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """samples, mean and p95 (the value at place floor((n - 1) * 0.95)) of each key.

    A first pass of partial aggregations brackets the place by approximate percentiles, whose error is far smaller than
    the bracket. A second counts equal values in it, and all below as one, so that about a hundredth of the distinct
    values of a key are sorted. Keys of few values are sorted whole. Null values are no samples.
    """
    rows, v, size = df.where(F.col(value).isNotNull()), F.col(value), F.count(F.lit(1))
    near = F.when(size > SORTED_WHOLE, F.percentile_approx(v, [0.945, 0.955], 10_000))
    bounds = stage(rows.groupBy(*keys).agg(size.alias("samples"), F.round(F.avg(v), 2).alias("mean"), near.alias("_near")), "latency-bounds")
    renamed = bounds.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    both = rows.select(*keys, v.alias("_v")).join(renamed, on).where("_near is null or _v <= _near[1]")
    level = F.when(F.col("_near").isNull() | (F.col("_v") >= F.col("_near")[0]), F.col("_v"))
    counts = both.groupBy(*keys, "samples", "mean", level.alias("_v")).agg(size.alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    reached = counts.withColumn("_up_to", up_to).where(F.col("_up_to") > F.floor((F.col("samples") - 1) * 0.95))
    return reached.groupBy(*keys, "samples", "mean").agg(F.round(F.min("_v"), 2).alias("p95"))


def recent_latencies(jobs: DataFrame, now: str, newest: int = RECENT) -> DataFrame:
    """Waiting and running times in milliseconds of the newest jobs, by metric; those that still wait or run count up to ``now``."""
    at = lambda c: F.unix_micros(F.coalesce(F.col(c).cast("timestamp"), F.lit(now).cast("timestamp")))
    started, queued = F.col("started_at").isNotNull(), F.col("state") == "queued"
    wait, run = (at("started_at") - at("created_at")) / 1000, (at("finished_at") - at("started_at")) / 1000
    one = lambda metric, test, ms: F.when(test, F.struct(F.lit(metric).alias("metric"), ms.alias("ms")))
    items = F.array(one("queue_wait", queued | started, wait), one("execution_duration", started & ~queued, run))
    recent = jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(newest)
    return latency_summary(recent.select(F.explode(F.array_compact(items)).alias("x")).select("x.*"), "ms", ["metric"])


def stale_jobs(jobs: DataFrame, now: str, timeout_seconds: int, max_attempts: int = 3) -> DataFrame:
    """Active jobs without a heartbeat for too long, and what becomes of them."""
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(timeout_seconds))
    old = jobs.where(F.col("state").isin(*ACTIVE) & (F.col("heartbeat_at") < limit))
    return old.withColumn("outcome", F.when(F.col("attempts") < max_attempts, "requeued").otherwise("failed"))


def retry_plan(failure: Column, attempts: Column, max_attempts: int = 3) -> Column:
    """Struct of decision and delay in seconds: doubling from 2, at most 60, while attempts are left."""
    again = failure.isin(*RETRYABLE) & (attempts < max_attempts)
    delay = F.least(F.lit(60.0), 2 * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))
    decision = F.when(again, "retry").when(failure == "timeout", "timed_out").otherwise("failed")
    return F.struct(decision.alias("decision"), F.when(again, delay).alias("delay"))


def blocked_jobs(jobs: DataFrame) -> DataFrame:
    """Queued jobs whose predecessor has failed, timed out or been cancelled."""
    bad = jobs.where(F.col("state").isin(*UNSUCCESSFUL)).select(F.col("job_id").alias("_p"))
    return jobs.where("state = 'queued' and dependency_id is not null").join(bad, F.col("dependency_id") == F.col("_p"), "left_semi")


def next_in_line(jobs: DataFrame, now: str, priorities: tuple[str, ...], aging: int = AGING_SECONDS) -> DataFrame:
    """The next job of each resource class: aged ones first come first served, then by priority; with the class's headroom."""
    done = jobs.where("state = 'completed'").select(F.col("job_id").alias("_p"))
    running = jobs.where(F.col("state").isin(*ACTIVE)).groupBy(F.col("resource_class").alias("_c")).agg(F.count(F.lit(1)).alias("n_running"))
    ready = jobs.where("state = 'queued'").join(done, F.col("dependency_id") == F.col("_p"), "left").where("dependency_id is null or _p is not null")
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    rank = F.array_position(F.array(*[F.lit(p) for p in priorities]), F.col("priority"))
    tier = F.when(age >= aging, 0).otherwise(rank)
    w = Window.partitionBy("resource_class").orderBy(tier, "created_at", "job_id")
    first = ready.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    out = first.join(running, F.col("resource_class") == F.col("_c"), "left")
    return out.select("resource_class", "job_id", "priority", (F.lit(CLASS_LIMIT) - F.coalesce("n_running", F.lit(0))).alias("headroom"))


def reconcile_assets(records: DataFrame, files: DataFrame) -> DataFrame:
    """(storage_key, category) of every stored file or record that has no counterpart."""
    r = records.select(F.col("storage_key").alias("_r"), "kind")
    f = files.select(F.col("storage_key").alias("_f"))
    both = r.join(f, F.col("_r") == F.col("_f"), "full")
    part, derived = F.col("_f").endswith(".part"), F.col("_f").startswith("derived-")
    category = (
        F.when(F.col("_f").isNull(), F.when(F.col("kind") == "derived", "missing_derived").otherwise("missing"))
        .when(F.col("_r").isNull(), F.when(part, "stale_temporary").when(derived, "orphan_derived").otherwise("orphan_original"))
    )
    return both.select(F.coalesce("_r", "_f").alias("storage_key"), category.alias("category")).where("category is not null")


def readiness_report(counts: DataFrame) -> DataFrame:
    """Checks (name, n, blocking) with the verdict of each and of all: FAIL, PASS WITH WARNINGS or PASS."""
    verdict = F.when(F.col("n") == 0, "PASS").when(F.col("blocking"), "FAIL").otherwise("PASS WITH WARNINGS")
    rank = lambda c: F.when(c == "FAIL", 2).when(c == "PASS WITH WARNINGS", 1).otherwise(0)
    rows = counts.withColumn("verdict", verdict)
    total = rows.agg(F.lit("overall").alias("name"), F.sum("n").alias("n"), F.max("blocking").alias("blocking"), F.max(rank(F.col("verdict"))).alias("_r"))
    names = F.get(F.array(F.lit("PASS"), F.lit("PASS WITH WARNINGS"), F.lit("FAIL")), F.col("_r"))
    return rows.unionByName(total.withColumn("verdict", names).drop("_r"))


def overview(counts: dict[str, DataFrame]) -> DataFrame:
    """(measure, n): how many rows each frame has; every frame is counted where it lies."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("measure"), F.count(F.lit(1)).alias("n")) for name, df in counts.items()])


def readiness_checks(search: DataFrame, assets: DataFrame, import_found: DataFrame, active_users: DataFrame, verified_backups: DataFrame) -> DataFrame:
    """The checks of ``readiness_report`` from other reports: (name, n, blocking).

    ``search``: one row of missing and stale (the search projection's verification); ``assets``: category of each discrepancy
    of the storage; ``import_found``: category, blocking, n of an import's discrepancies. Nobody to log in is a failure, no
    verified backup a warning.
    """
    one = lambda df, name, n, blocking: df.select(F.lit(name).alias("name"), n.cast("long").alias("n"), F.lit(blocking).alias("blocking"))
    none = lambda df: df.agg((F.count(F.lit(1)) == 0).cast("long").alias("n"))
    rows = [
        one(search, "search_consistent", F.col("missing") + F.col("stale"), True),
        one(assets.agg(F.count(F.when(F.col("category") == "missing", 1)).alias("n")), "original_assets_present", F.col("n"), True),
        one(import_found.agg(F.coalesce(F.sum(F.when(F.col("blocking"), F.col("n"))), F.lit(0)).alias("n")), "import_blockers", F.col("n"), True),
        one(import_found.agg(F.coalesce(F.sum(F.when(~F.col("blocking"), F.col("n"))), F.lit(0)).alias("n")), "import_warnings", F.col("n"), False),
        one(none(active_users), "authentication", F.col("n"), True),
        one(none(verified_backups), "verified_backup", F.col("n"), False),
    ]
    return reduce(DataFrame.unionByName, rows)


def attempt_lockouts(attempts: DataFrame, window_seconds: int = 900, most: int = 5) -> DataFrame:
    """Failed attempts with the failures of the same user and source in the window up to them."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("username", "source_hash").orderBy(seconds).rangeBetween(-window_seconds * 1_000_000, 0)
    rows = attempts.withColumn("failures", F.count(F.when(~F.col("successful"), 1)).over(w))
    return rows.withColumn("locked", F.col("failures") >= most)
