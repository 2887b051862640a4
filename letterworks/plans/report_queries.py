"""Queries for versions, temporal reports and the job journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterworks.operators import ops as O
from letterworks.operators import temporal as D
from letterworks.operators import versions as V
from letterworks.plans import frames as fr
from letterworks.plans.registry import query
from letterworks.session import prepare, table


def _docs(spark, sf):
    return table(prepare(spark), sf, "documents")


@query("""WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS canonical_id FROM documents GROUP BY 1)
SELECT doc_id, canonical_id, canonical_id <> doc_id AS is_duplicate FROM documents JOIN f ON sha256(text) = h""")
def o37_dedup_exact(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"), F.lit(0).alias("created"))
    return V.dedup_exact(rows, "h", "created", "doc_id").select("doc_id", "canonical_id", "is_duplicate")


def _versions(spark, sf):
    """Two or three extracted versions of each document; the candidate differs by doc_id % 3."""
    d = _docs(spark, sf)
    k = F.col("doc_id") % 3
    changed = F.when(k == 0, F.concat(F.lit("1,00 "), "text")).when(k == 1, F.regexp_replace("text", "^.", "")).otherwise(F.col("text"))
    v = F.array(F.struct(F.lit(1).alias("version"), F.col("text").alias("body")), F.struct(F.lit(2).alias("version"), changed.alias("body")))
    return d.select("doc_id", F.inline(v))


_VERSIONS = """versions AS (SELECT doc_id, 1 AS version, text AS body FROM documents UNION ALL
  SELECT doc_id, 2, CASE doc_id % 3 WHEN 0 THEN '1,00 ' || text WHEN 1 THEN substr(text, 2) ELSE text END FROM documents)"""


@query(f"WITH {_VERSIONS} SELECT doc_id, min(version) AS version, sha256(body) AS identity FROM versions GROUP BY doc_id, sha256(body)")
def o38_upsert_versions(spark, sf):
    v = _versions(spark, sf).select("doc_id", "version", F.sha2("body", 256).alias("identity"))
    first = V.upsert_versions(v.where("version = 1"), v, ["doc_id", "identity"])
    return V.upsert_versions(first, v, ["doc_id", "identity"])


def _pairs(spark, sf):
    v = _versions(spark, sf)
    return v.where("version = 1").select("doc_id", F.col("body").alias("base")).join(v.where("version = 2").select("doc_id", F.col("body").alias("candidate")), "doc_id")


def _compared(spark, sf):
    """Pairs of versions with their lines as pages; critical are all numbers of the base."""
    lines = lambda c: F.split(c, "\n")
    p = _pairs(spark, sf).withColumns({"base_lines": lines("base"), "candidate_lines": lines("candidate"), "numbers": F.array_distinct(F.regexp_extract_all("base", F.lit(r"\d+(?:[.,]\d+)+"), F.lit(0)))})
    return V.compare_versions(p, pages=("base_lines", "candidate_lines"), critical="numbers")


_PAIRS = f"{_VERSIONS}, p AS (SELECT a.doc_id, a.body AS base, b.body AS cand FROM versions a JOIN versions b USING (doc_id) WHERE a.version = 1 AND b.version = 2)"
_COMPARED = f"""{_PAIRS},
m AS (SELECT doc_id, cand, sha256(base) = sha256(cand) AS hashes_equal, CAST(length(base) AS INTEGER) AS base_chars, CAST(length(cand) AS INTEGER) AS candidate_chars,
  CAST(len(string_split(base, chr(10))) AS INTEGER) AS base_pages, CAST(len(string_split(cand, chr(10))) AS INTEGER) AS candidate_pages,
  length(regexp_replace(base, '\\s', '', 'g')) AS sa, length(regexp_replace(cand, '\\s', '', 'g')) AS sb, list_distinct(regexp_extract_all(base, '\\d+(?:[.,]\\d+)+')) AS ca FROM p)"""


@query(f"""WITH {_COMPARED} SELECT doc_id, hashes_equal, base_chars, candidate_chars, base_pages, candidate_pages, CAST(CASE WHEN sa > 0 THEN round(sb / sa, 6) WHEN sb = 0 THEN 1.0 END AS DOUBLE) AS coverage,
 CAST(len(ca) AS INTEGER) AS critical_checked, CAST(CASE WHEN len(ca) > 0 THEN round(len(list_filter(ca, lambda x: contains(cand, x))) / len(ca), 6) END AS DOUBLE) AS critical_preserved FROM m""")
def o39_compare_versions(spark, sf):
    return _compared(spark, sf).select("doc_id", "hashes_equal", "base_chars", "candidate_chars", "base_pages", "candidate_pages", "coverage", "critical_checked", "critical_preserved")


@query(f"""WITH {_PAIRS}, l AS (SELECT doc_id, string_split(base, chr(10)) AS x, string_split(cand, chr(10)) AS y FROM p),
e AS (SELECT doc_id, i AS page, length(regexp_replace(coalesce(x[i], ''), '\\s', '', 'g')) AS nx, length(regexp_replace(coalesce(y[i], ''), '\\s', '', 'g')) AS ny FROM (SELECT *, unnest(range(1, greatest(len(x), len(y)) + 1)) AS i FROM l))
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(nx AS INTEGER) AS base_non_whitespace, CAST(ny AS INTEGER) AS candidate_non_whitespace, CAST(CASE WHEN nx > 0 THEN round(ny / nx, 6) WHEN ny = 0 THEN 1.0 END AS DOUBLE) AS coverage FROM e""")
def o39_page_coverage(spark, sf):
    return _compared(spark, sf).select("doc_id", F.inline("page_coverage"))


@query()
def o39_version_similarity(spark, sf):
    """Similarity of whole texts and the status that follows; matching blocks are no SQL, the tests hold them against a plain version."""
    rows = _compared(spark, sf).select("doc_id", "hashes_equal", "coverage", "critical_preserved", "similarity")
    return rows.select("doc_id", "similarity", V.comparison_status(*(F.col(c) for c in ("hashes_equal", "similarity", "coverage", "critical_preserved"))).alias("status"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS eq, 0.98 + (o_orderkey % 10) * 0.001 AS sim, 0.9 + (o_orderkey % 7) * 0.05 AS cov, CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 1.0 END AS kept FROM orders)
SELECT id, CASE WHEN eq OR (sim >= 0.985 AND cov BETWEEN 0.98 AND 1.2 AND kept >= 1) THEN 'equivalent' ELSE 'review_required' END AS status FROM s""")
def o40_comparison_status(spark, sf):
    k = F.col("o_orderkey")
    dec = lambda x: F.lit(x).cast("decimal(10,3)")
    status = V.comparison_status(k % 4 == 0, dec(0.98) + (k % 10) * dec(0.001), dec(0.9) + (k % 7) * dec(0.05), F.when(k % 5 == 0, 0.5).otherwise(1.0))
    return table(prepare(spark), sf, "orders").select(k.alias("id"), status.alias("status"))


def _promotions(spark, sf):
    x = table(prepare(spark), sf, "lineitem")
    return x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("version"), F.col("l_shipdate").alias("at"), F.col("l_partkey").alias("id"))


_POINTERS = "pointers AS (SELECT l_orderkey AS doc_id, arg_max(l_suppkey, (l_shipdate, l_partkey, l_suppkey)) AS canonical_version, count(*) AS n_promotions FROM lineitem GROUP BY 1)"


@query(f"WITH {_POINTERS} SELECT * FROM pointers")
def o41_canonical_pointer(spark, sf):
    return V.canonical_pointer(_promotions(spark, sf), "doc_id", "version", ["at", "id", "version"])


@query(f"WITH {_POINTERS} SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS version, l_suppkey = canonical_version AS is_canonical FROM lineitem JOIN pointers ON doc_id = l_orderkey")
def o42_version_history(spark, sf):
    log = _promotions(spark, sf)
    pointers = V.canonical_pointer(log, "doc_id", "version", ["at", "id", "version"])
    return V.version_history(log.select("doc_id", "version").distinct(), pointers, "doc_id", "version")


def _runs(spark, sf):
    o = table(prepare(spark), sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("run_id"),
        F.col("o_custkey").alias("doc_id"),
        F.when(k % 4 != 0, F.substring("o_orderpriority", 1, 1)).alias("provider"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
        (k % 7 == 0).alias("is_current"),
        F.col("o_orderdate").alias("finished_at"),
    )


_RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS doc_id, CASE WHEN o_orderkey % 4 <> 0 THEN substr(o_orderpriority, 1, 1) END AS provider,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderkey % 7 = 0 AS is_current, o_orderdate AS finished_at FROM orders)"""


@query(f"""WITH {_RUNS}, q AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 <> 0 THEN '2' END AS provider FROM customer),
b AS (SELECT doc_id, provider, arg_max(run_id, (is_current::INT, finished_at, run_id)) AS reused_run FROM runs WHERE status = 'completed' GROUP BY ALL)
SELECT q.doc_id, q.provider, reused_run FROM q LEFT JOIN b ON q.doc_id = b.doc_id AND q.provider IS NOT DISTINCT FROM b.provider""")
def o43_reuse_completed_runs(spark, sf):
    c = table(prepare(spark), sf, "customer")
    requests = c.select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 3 != 0, F.lit("2")).alias("provider"))
    return V.reuse_completed_runs(requests, _runs(spark, sf), ["doc_id", "provider"])


@query(f"""WITH {_RUNS}, p AS (SELECT run_id AS proposal_id, run_id, doc_id, CASE WHEN run_id % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status FROM runs),
n AS (SELECT doc_id, max(run_id) AS new_run FROM runs WHERE status = 'completed' GROUP BY doc_id)
SELECT proposal_id, p.doc_id, CASE WHEN status = 'pending' AND new_run IS NOT NULL AND run_id <> new_run THEN 'superseded' ELSE status END AS status FROM p LEFT JOIN n ON p.doc_id = n.doc_id""")
def o44_supersede_pending(spark, sf):
    runs = _runs(spark, sf)
    status = F.when(F.col("run_id") % 3 == 0, "accepted").otherwise("pending")
    p = runs.select(F.col("run_id").alias("proposal_id"), "run_id", "doc_id", status.alias("status"))
    return V.supersede_pending(p, runs, "doc_id").select("proposal_id", "doc_id", "status")


@query("""SELECT 'h' || (doc_id // 2) AS identity_key, bool_and(TRUE) AS new, max(CASE WHEN (doc_id // 2) % 5 = 0 THEN 0 WHEN (doc_id // 2) % 3 = 0 THEN 0 ELSE 1 END) = 1 AS evidence_verified
FROM documents WHERE (doc_id // 2) % 7 <> 0 GROUP BY doc_id // 2""")
def o45_new_proposals(spark, sf):
    h = F.floor(F.col("doc_id") / 2)
    evidence = F.when(h % 5 == 0, F.array().cast("array<struct<verified:boolean>>")).otherwise(F.array(F.struct(F.lit(True).alias("verified")), F.struct((h % 3 != 0).alias("verified"))))
    key = F.concat(F.lit("h"), h.cast("string"))
    cands = _docs(spark, sf).select(key.alias("identity_key"), evidence.alias("evidence"))
    existing = _docs(spark, sf).where(h % 7 == 0).select(key.alias("identity_key")).distinct()
    return V.new_proposals(cands, existing, "identity_key").select("identity_key", F.lit(True).alias("new"), "evidence_verified")


@query(f"WITH {fr.TIMELINE} SELECT coalesce(strftime(event_date, '%Y-%m'), 'unresolved') AS month, count(*) AS n_events, count(DISTINCT doc_id) AS n_documents FROM timeline GROUP BY 1")
def o68_timeline_by_month(spark, sf):
    return D.timeline_by_month(D.timeline(fr.timeline_events(spark, sf)))


@query(f"WITH {fr.DEADLINES} SELECT deadline_id, due_at FROM deadlines WHERE status = 'open' AND due_at <= DATE '2020-06-01' ORDER BY due_at, deadline_id LIMIT 500")
def o69_list_deadlines(spark, sf):
    return D.list_open(fr.deadlines(spark, sf), [F.col("deadline_id")], due_before="2020-06-01", status="open").select("deadline_id", "due_at")


@query(f"""WITH {fr.DEADLINES} SELECT deadline_id, CASE WHEN status IN ('completed', 'dismissed') THEN status WHEN status = 'snoozed' AND (snoozed_until IS NULL OR snoozed_until > DATE '{fr.TODAY}') THEN 'snoozed'
 WHEN due_at IS NULL OR due_at > DATE '{fr.TODAY}' THEN 'upcoming' WHEN due_at = DATE '{fr.TODAY}' THEN 'due' ELSE 'overdue' END AS state FROM deadlines""")
def o70_deadline_state(spark, sf):
    state = D.deadline_state(F.col("status"), F.col("due_at"), F.col("snoozed_until"), fr.TODAY)
    return fr.deadlines(spark, sf).select("deadline_id", state.alias("state"))


@query(f"""WITH {fr.DEADLINES}, f AS (SELECT * FROM deadlines WHERE status IN ('open', 'snoozed') ORDER BY due_at NULLS LAST, deadline_id LIMIT 500)
SELECT deadline_id, CASE WHEN status = 'snoozed' AND (snoozed_until IS NULL OR snoozed_until > DATE '{fr.TODAY}') THEN 'snoozed' WHEN due_at IS NULL THEN 'future' WHEN due_at < DATE '{fr.TODAY}' THEN 'overdue'
 WHEN due_at = DATE '{fr.TODAY}' THEN 'today' WHEN due_at <= DATE '{fr.TODAY}' + 7 THEN 'next_7' WHEN due_at <= DATE '{fr.TODAY}' + 30 THEN 'next_30' ELSE 'future' END AS bucket FROM f""")
def o71_upcoming_buckets(spark, sf):
    return D.upcoming_buckets(fr.deadlines(spark, sf), fr.TODAY).select("deadline_id", "bucket")


_LEAD = f"CASE deadline_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in D.LEAD_DAYS.items())} ELSE 7 END"


@query(f"""WITH {fr.DEADLINES}, a AS (SELECT *, due_at - DATE '{fr.TODAY}' AS n, {_LEAD} AS lead FROM deadlines
  WHERE due_at IS NOT NULL AND (status = 'open' OR (status = 'snoozed' AND snoozed_until <= DATE '{fr.TODAY}'))),
k AS (SELECT *, CASE WHEN n < 0 THEN 'overdue' WHEN n = 0 THEN 'due' WHEN n <= lead THEN 'upcoming' END AS kind FROM a)
SELECT deadline_id, kind, status = 'snoozed' AS woken, CASE kind WHEN 'overdue' THEN due_at + 1 WHEN 'due' THEN due_at ELSE due_at - lead END AS scheduled_for FROM k WHERE kind IS NOT NULL AND NOT (kind = 'overdue' AND deadline_id % 4 <> 0) ORDER BY due_at, deadline_id LIMIT 500""")
def o72_due_reminders(spark, sf):
    d = fr.deadlines(spark, sf)
    sent = d.where("deadline_id % 4 <> 0").select("deadline_id", F.lit("overdue").alias("kind"))
    return D.due_reminders(d, sent, fr.TODAY).select("deadline_id", "kind", "woken", "scheduled_for")


@query(f"""WITH {fr.DEADLINES} SELECT deadline_id, 'snooze_elapsed' AS action, '{{"status":"snoozed"}}' AS previous_json, '{{"status":"open"}}' AS new_json FROM deadlines WHERE status = 'snoozed' AND snoozed_until <= DATE '{fr.TODAY}'""")
def o72_woken_history(spark, sf):
    return D.woken_history(fr.deadlines(spark, sf), fr.TODAY)


def _changes(spark, sf):
    x = table(prepare(spark), sf, "lineitem")
    kind = F.get(F.array(F.lit("open"), F.lit("completed"), F.lit("snoozed"), F.lit("odd")), (F.col("l_suppkey") % 4).cast("int"))
    until = F.when(F.col("l_partkey") % 3 != 0, F.add_months(F.col("l_shipdate").cast("date"), 300))
    key = F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return x.select(F.col("l_orderkey").alias("deadline_id"), kind.alias("new_status"), until.alias("until"), F.col("l_shipdate").alias("at"), key.alias("change_id"))


@query(f"""WITH {fr.DEADLINES}, l AS (SELECT l_orderkey AS deadline_id, (['open', 'completed', 'snoozed', 'odd'])[l_suppkey % 4 + 1] AS ns, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_shipdate + INTERVAL 300 MONTH AS DATE) END AS until,
  l_shipdate AS ts, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS cid FROM lineitem),
g AS (SELECT * FROM l WHERE ns <> 'odd' AND CASE WHEN ns = 'snoozed' THEN coalesce(until > DATE '{fr.TODAY}', false) ELSE until IS NULL END),
c AS (SELECT deadline_id, arg_max(struct_pack(ns := ns, until := until), (ts, cid)) AS c FROM g GROUP BY 1)
SELECT d.deadline_id, CASE WHEN c.ns IS NOT NULL THEN c.ns ELSE status END AS status, CASE WHEN c.ns IS NOT NULL THEN c.until ELSE snoozed_until END AS snoozed_until FROM deadlines d LEFT JOIN c USING (deadline_id)""")
def o73_apply_status_changes(spark, sf):
    return D.apply_status_changes(fr.deadlines(spark, sf), _changes(spark, sf), fr.TODAY)[0].select("deadline_id", "status", "snoozed_until")


_LEGAL = ", ".join(f"'{a}>{b}'" for a, bs in O.NEXT.items() for b in bs)
_REPLAY = f"""{fr.JOB_EVENTS}, r AS (SELECT *, lag(to_state) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS from_state FROM job_events),
replay AS (SELECT *, CASE WHEN from_state IS NULL THEN to_state = 'queued' ELSE from_state || '>' || to_state IN ({_LEGAL}) END AS legal FROM r)"""


@query(f"""WITH {_REPLAY} SELECT job_id, arg_max(to_state, (ts, event_id)) AS state, count(*) FILTER (WHERE to_state = 'claimed') AS attempts, max(ts) FILTER (WHERE to_state IN {O.FINAL}) AS terminal_at,
 count(*) FILTER (WHERE NOT legal) AS n_illegal FROM replay GROUP BY job_id""")
def o74_journal_replay(spark, sf):
    return O.job_states(fr.jobs_events(spark, sf))


@query(f"""WITH {fr.JOBS} SELECT 'queue_depth' AS metric, priority AS key, CAST(count(*) AS BIGINT) AS n FROM jobs WHERE state = 'queued' GROUP BY 2
UNION ALL SELECT 'running', resource_class, count(*) FROM jobs WHERE state IN {O.ACTIVE} GROUP BY 2
UNION ALL SELECT 'failures', failure_class, count(*) FROM jobs WHERE state IN {O.UNSUCCESSFUL} GROUP BY 2
UNION ALL SELECT 'admission_deferrals', 'all', CAST(sum(admission_deferrals) AS BIGINT) FROM jobs HAVING sum(admission_deferrals) > 0
UNION ALL SELECT 'degraded_completions', 'all', count(*) FROM jobs WHERE state = 'completed' AND failure_class = 'degraded' HAVING count(*) > 0
UNION ALL SELECT 'retries', 'all', CAST(sum(attempts - 1) AS BIGINT) FROM jobs WHERE attempts > 1 HAVING count(*) > 0
UNION ALL SELECT 'completed_last_hour', 'all', count(*) FROM jobs WHERE state = 'completed' AND finished_at >= TIMESTAMP '{fr.NOW}' - INTERVAL 1 HOUR HAVING count(*) > 0""")
def o75_execution_metrics(spark, sf):
    return O.execution_metrics(fr.jobs(spark, sf), fr.NOW)


@query(f"""WITH {fr.JOBS}, r AS (SELECT * FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 1000), t AS (SELECT *, epoch_us(coalesce(started_at, TIMESTAMP '{fr.NOW}')) AS s FROM r),
l AS (SELECT 'queue_wait' AS metric, (s - epoch_us(created_at)) / 1000 AS ms FROM t WHERE state = 'queued' OR started_at IS NOT NULL
  UNION ALL SELECT 'execution_duration', (epoch_us(coalesce(finished_at, TIMESTAMP '{fr.NOW}')) - s) / 1000 FROM t WHERE started_at IS NOT NULL AND state <> 'queued'),
p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM l)
SELECT metric, count(*) AS samples, round(avg(ms), 2) AS mean, round(max(ms) FILTER (WHERE i = floor((n - 1) * 0.95)), 2) AS p95 FROM p GROUP BY 1""")
def o75_recent_latencies(spark, sf):
    return O.recent_latencies(fr.jobs(spark, sf), fr.NOW)


@query(f"""WITH {fr.JOB_EVENTS}, r AS (SELECT resource_class, duration_ms, row_number() OVER (PARTITION BY resource_class ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY resource_class) AS n FROM job_events WHERE duration_ms IS NOT NULL)
SELECT resource_class, count(*) AS samples, round(avg(duration_ms), 2) AS mean, round(max(duration_ms) FILTER (WHERE i = floor((n - 1) * 0.95)), 2) AS p95 FROM r GROUP BY 1""")
def o76_latency_summary(spark, sf):
    return O.latency_summary(fr.jobs_events(spark, sf), "duration_ms", ["resource_class"])


@query(f"WITH {fr.JOBS} SELECT job_id, CASE WHEN attempts < 3 THEN 'requeued' ELSE 'failed' END AS outcome FROM jobs WHERE state IN {O.ACTIVE} AND heartbeat_at < TIMESTAMP '{fr.NOW}' - INTERVAL 1 DAY")
def o77_stale_jobs(spark, sf):
    return O.stale_jobs(fr.jobs(spark, sf), fr.NOW, 86_400).select("job_id", "outcome")


@query(f"""WITH {fr.JOBS}, f AS (SELECT job_id, attempts, (['retryable', 'timeout', 'permanent'])[job_id % 3 + 1] AS fc FROM jobs WHERE state = 'failed')
SELECT job_id, CASE WHEN fc IN ('retryable', 'timeout') AND attempts < 3 THEN 'retry' WHEN fc = 'timeout' THEN 'timed_out' ELSE 'failed' END AS decision,
 CAST(CASE WHEN fc IN ('retryable', 'timeout') AND attempts < 3 THEN least(60, 2 * pow(2, greatest(attempts - 1, 0))) END AS DOUBLE) AS delay FROM f""")
def o78_retry_plan(spark, sf):
    failure = F.get(F.array(F.lit("retryable"), F.lit("timeout"), F.lit("permanent")), (F.col("job_id") % 3).cast("int"))
    return fr.jobs(spark, sf).where("state = 'failed'").select("job_id", O.retry_plan(failure, F.col("attempts")).alias("p")).select("job_id", "p.*")


@query(f"WITH {fr.JOBS} SELECT job_id, dependency_id FROM jobs WHERE state = 'queued' AND dependency_id IN (SELECT job_id FROM jobs WHERE state IN {O.UNSUCCESSFUL})")
def o79_blocked_jobs(spark, sf):
    return O.blocked_jobs(fr.jobs(spark, sf)).select("job_id", "dependency_id")


@query(f"""WITH {fr.JOBS}, q AS (SELECT *, CASE WHEN epoch(TIMESTAMP '{fr.NOW}') - floor(epoch(created_at)) >= 900 THEN 0 ELSE list_position([{', '.join(f"'{p}'" for p in fr.PRIORITIES)}], priority) END AS tier FROM jobs j
  WHERE state = 'queued' AND (dependency_id IS NULL OR dependency_id IN (SELECT job_id FROM jobs WHERE state = 'completed'))),
r AS (SELECT *, row_number() OVER (PARTITION BY resource_class ORDER BY tier, created_at, job_id) AS rn FROM q),
n AS (SELECT resource_class, count(*) AS n FROM jobs WHERE state IN {O.ACTIVE} GROUP BY 1)
SELECT r.resource_class, job_id, priority, 2 - coalesce(n, 0) AS headroom FROM r LEFT JOIN n USING (resource_class) WHERE rn = 1""")
def o80_next_in_line(spark, sf):
    return O.next_in_line(fr.jobs(spark, sf), fr.NOW, fr.PRIORITIES)


def _assets(spark, sf):
    d = _docs(spark, sf)
    k, name = F.col("doc_id"), F.col("doc_id").cast("string")
    records = d.select(F.concat(F.when(k % 3 == 0, "derived-").otherwise(""), name).alias("storage_key"), F.when(k % 3 == 0, "derived").otherwise("original").alias("kind"))
    stored = d.where(k % 40 != 0).select(F.concat(F.when(k % 3 == 0, "derived-").otherwise(""), name).alias("storage_key"))
    more = d.where(k % 45 == 0).select(F.concat(F.lit("derived-ocr-"), name).alias("storage_key"))
    parts = d.where(k % 60 == 0).select(F.concat(name, F.lit(".part")).alias("storage_key"))
    lone = d.where(k % 50 == 0).select(F.concat(F.lit("file-"), name).alias("storage_key"))
    return records, stored.unionByName(more).unionByName(parts).unionByName(lone)


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN 'derived-' ELSE '' END || doc_id AS storage_key, CASE WHEN doc_id % 3 = 0 THEN 'missing_derived' ELSE 'missing' END AS category FROM documents WHERE doc_id % 40 = 0
UNION ALL SELECT 'derived-ocr-' || doc_id, 'orphan_derived' FROM documents WHERE doc_id % 45 = 0 UNION ALL SELECT doc_id || '.part', 'stale_temporary' FROM documents WHERE doc_id % 60 = 0
UNION ALL SELECT 'file-' || doc_id, 'orphan_original' FROM documents WHERE doc_id % 50 = 0""")
def o81_reconcile_assets(spark, sf):
    return O.reconcile_assets(*_assets(spark, sf))


@query("""WITH c AS (SELECT 'documents_without_text' AS name, CAST(count(*) FILTER (WHERE coalesce(text, '') = '') AS BIGINT) AS n, TRUE AS blocking FROM documents
UNION ALL SELECT 'toxic_labels', count(*) FILTER (WHERE toxic = 1), FALSE FROM labels UNION ALL SELECT 'empty_items', count(*) FILTER (WHERE text IS NULL), TRUE FROM benchmark),
v AS (SELECT *, CASE WHEN n = 0 THEN 'PASS' WHEN blocking THEN 'FAIL' ELSE 'PASS WITH WARNINGS' END AS verdict FROM c)
SELECT * FROM v UNION ALL SELECT 'overall', CAST(sum(n) AS BIGINT), bool_or(blocking), CASE max(CASE verdict WHEN 'FAIL' THEN 2 WHEN 'PASS' THEN 0 ELSE 1 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'PASS WITH WARNINGS' ELSE 'PASS' END FROM v""")
def o82_readiness_report(spark, sf):
    check = lambda df, name, test, blocking: df.agg(F.lit(name).alias("name"), F.count(F.when(test, 1)).alias("n"), F.lit(blocking).alias("blocking"))
    rows = check(_docs(spark, sf), "documents_without_text", F.coalesce("text", F.lit("")) == "", True)
    rows = rows.unionByName(check(table(spark, sf, "labels"), "toxic_labels", F.col("toxic") == 1, False))
    return O.readiness_report(rows.unionByName(check(table(spark, sf, "benchmark"), "empty_items", F.col("text").isNull(), True)))


@query("""WITH a AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok FROM events)
SELECT event_id, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS failures,
 count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) >= 2 AS locked FROM a""")
def o83_attempt_lockouts(spark, sf):
    e = table(prepare(spark), sf, "events")
    rows = e.select("event_id", F.col("user_id").alias("username"), F.lit("one").alias("source_hash"), "ts", (F.col("event_type") != "error").alias("successful"))
    return O.attempt_lockouts(rows, 86_400, 2).select("event_id", "failures", "locked")
