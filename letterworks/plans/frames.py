"""Frames derived from the base tables, each with the DuckDB SQL that builds the same rows.

``LETTERS`` and the others are common table expressions for the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.functions.spans import once
from letterworks.operators.constraints import Table
from letterworks.operators.ops import FINAL, UNSUCCESSFUL
from letterworks.session import prepare, spread, table

TODAY = "2023-06-01"
NOW = "2024-01-31 00:00:00"


def letters(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """One generated German letter for each order, by six templates: doc_id, text, ocr, and columns of the order to keep."""
    o = spread(table(prepare(spark), sf, "orders").select(*dict.fromkeys(("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", *keep))), "o_orderkey")
    day = lambda n: F.date_format(F.date_add(F.add_months(F.col("o_orderdate").cast("date"), 300), n), "dd.MM.yyyy")
    amount = F.translate(F.format_number(F.col("o_totalprice"), 2), ",.", ".,")
    re8, c6 = F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    i2 = F.lpad((F.col("o_custkey") % 97).cast("string"), 2, "0")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    t = F.col("o_orderkey") % 6
    letter = (
        F.when(t == 0, text("Haus ", i2, " GmbH\nRechnung\nRechnungsnummer: RE-", re8, "\nKundennummer: KD-", c6, "\nRechnungsdatum: ", day(0), "\nZahlbar bis zum ", day(14), "\nGesamtbetrag: ", amount, " EUR"))
        .when(t == 1, text("Haus ", i2, " AG\nVertrag\nVertragsnummer: V-", c6, "\nVertragsbeginn: ", day(0), "\nKündigung bis ", day(330), "\nVertragssumme: ", amount, " EUR"))
        .when(t == 2, text("Haus ", i2, " AG\nNachtrag zum Vertrag\nVertragsnummer: V-", c6, "\ngültig ab ", day(0), "\nJahresbeitrag: ", amount, " EUR"))
        .when(t == 3, text("Bezirksamt Muster\nAktenzeichen: AZ-", re8, "\nDatum: ", day(0), "\nAntwort bis ", day(21)))
        .when(t == 4, text("Haus ", i2, " KG\nWiderspruch ist innerhalb eines Monats möglich\nModellrechnung bei 4 %: ", amount, " EUR"))
        .otherwise(text("Notiz ", day(0), "\nZahl ", amount))
    )
    rows = o.select(F.col("o_orderkey").alias("doc_id"), letter.alias("text"), (F.col("o_orderkey") % 10 == 0).alias("ocr"), *keep)
    return once(rows, "text").select("doc_id", "text", "ocr", *keep)  # as a stored text, not as the expression that makes it


_D = "CAST(o_orderdate + INTERVAL 300 MONTH AS DATE)"


def _day(n: int) -> str:
    return f"strftime({_D} + {n}, '%d.%m.%Y')"


_AMOUNT = "translate(format('{:,.2f}', o_totalprice), ',.', '.,')"
_RE8, _C6, _I2 = "lpad(o_orderkey::VARCHAR, 8, '0')", "lpad(o_custkey::VARCHAR, 6, '0')", "lpad((o_custkey % 97)::VARCHAR, 2, '0')"
BASE = f"""base AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS t, o_orderkey % 10 = 0 AS ocr, {_D} AS d, {_RE8} AS re8, {_C6} AS c6, {_I2} AS i2,
  {_AMOUNT} AS amt, o_totalprice, o_custkey FROM orders)"""
LETTERS = f"""letters AS (SELECT o_orderkey AS doc_id, o_orderkey % 10 = 0 AS ocr, CASE o_orderkey % 6
  WHEN 0 THEN 'Haus ' || {_I2} || ' GmbH' || chr(10) || 'Rechnung' || chr(10) || 'Rechnungsnummer: RE-' || {_RE8} || chr(10) || 'Kundennummer: KD-' || {_C6}
    || chr(10) || 'Rechnungsdatum: ' || {_day(0)} || chr(10) || 'Zahlbar bis zum ' || {_day(14)} || chr(10) || 'Gesamtbetrag: ' || {_AMOUNT} || ' EUR'
  WHEN 1 THEN 'Haus ' || {_I2} || ' AG' || chr(10) || 'Vertrag' || chr(10) || 'Vertragsnummer: V-' || {_C6} || chr(10) || 'Vertragsbeginn: ' || {_day(0)}
    || chr(10) || 'Kündigung bis ' || {_day(330)} || chr(10) || 'Vertragssumme: ' || {_AMOUNT} || ' EUR'
  WHEN 2 THEN 'Haus ' || {_I2} || ' AG' || chr(10) || 'Nachtrag zum Vertrag' || chr(10) || 'Vertragsnummer: V-' || {_C6} || chr(10) || 'gültig ab ' || {_day(0)}
    || chr(10) || 'Jahresbeitrag: ' || {_AMOUNT} || ' EUR'
  WHEN 3 THEN 'Bezirksamt Muster' || chr(10) || 'Aktenzeichen: AZ-' || {_RE8} || chr(10) || 'Datum: ' || {_day(0)} || chr(10) || 'Antwort bis ' || {_day(21)}
  WHEN 4 THEN 'Haus ' || {_I2} || ' KG' || chr(10) || 'Widerspruch ist innerhalb eines Monats möglich' || chr(10) || 'Modellrechnung bei 4 %: ' || {_AMOUNT} || ' EUR'
  ELSE 'Notiz ' || {_day(0)} || chr(10) || 'Zahl ' || {_AMOUNT} END AS text FROM orders)"""


def jobs_events(spark: SparkSession, sf: str) -> DataFrame:
    """A job journal from ``events``: job_id, event_id, ts, to_state, duration_ms, priority, resource_class."""
    e = table(prepare(spark), sf, "events")
    states = F.create_map(*[x for kind, names in STATES.items() for x in (F.lit(kind), F.array(*[F.lit(n) for n in names]))])[F.col("event_type")]
    state = F.get(states, (F.col("event_id") % 3).cast("int"))
    priority = F.get(F.array(*[F.lit(p) for p in PRIORITIES]), (F.col("event_id") % 6).cast("int"))
    return e.select(
        (F.col("user_id") * 1000 + F.col("event_id") % 7).alias("job_id"),
        "event_id",
        "ts",
        state.alias("to_state"),
        F.col("value").alias("duration_ms"),
        priority.alias("priority"),
        F.concat(F.lit("class"), (F.col("user_id") % 6).cast("string")).alias("resource_class"),
    )


STATES = {
    "signup": ("queued", "queued", "queued"),
    "view": ("claimed", "claimed", "ocr"),
    "click": ("extracting", "extracting", "normalizing"),
    "purchase": ("completed", "completed", "cancelled"),
    "error": ("failed", "timed_out", "cancel_requested"),
}
FAILURES = ("retryable", "permanent", "degraded", "timeout", "cancelled", "dependency_failed")
PRIORITIES = ("interactive", "high", "normal", "background", "maintenance", "bulk")
JOB_EVENTS = f"""job_events AS (SELECT user_id * 1000 + event_id % 7 AS job_id, event_id, ts,
  (CASE event_type {' '.join(f"WHEN '{k}' THEN {list(v)}" for k, v in STATES.items())} END)[event_id % 3 + 1] AS to_state, value AS duration_ms,
  ([{', '.join(f"'{p}'" for p in PRIORITIES)}])[event_id % 6 + 1] AS priority, 'class' || (user_id % 6) AS resource_class FROM events)"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each job: its first and last event, first claim, end, attempts (claims), failure, deferrals, and the job that it waits for."""
    e = jobs_events(spark, sf)
    last = F.max_by(F.struct("to_state", "priority", "resource_class", "duration_ms", "ts"), F.struct("ts", "event_id"))
    rows = e.groupBy("job_id").agg(
        F.min("ts").alias("created_at"),
        last.alias("l"),
        F.min(F.when(F.col("to_state") == "claimed", F.col("ts"))).alias("started_at"),
        F.count(F.when(F.col("to_state") == "claimed", 1)).alias("attempts"),
    )
    state, sixth = F.col("l.to_state"), (F.col("job_id") % 6).cast("int")
    failure = F.when(state.isin(*UNSUCCESSFUL), F.get(F.array(*[F.lit(x) for x in FAILURES]), sixth)).when((state == "completed") & (sixth == 2), "degraded")
    return rows.select(
        "job_id",
        "created_at",
        "started_at",
        F.when(state.isin(*FINAL), F.col("l.ts")).alias("finished_at"),
        failure.alias("failure_class"),
        (F.col("job_id") % 3).alias("admission_deferrals"),
        F.col("l.ts").alias("heartbeat_at"),
        F.col("l.to_state").alias("state"),
        F.col("l.priority").alias("priority"),
        F.col("l.resource_class").alias("resource_class"),
        F.col("l.duration_ms").alias("duration_ms"),
        "attempts",
        F.when(F.col("job_id") % 5 == 0, F.col("job_id") + 1).alias("dependency_id"),
    )


JOBS = (
    JOB_EVENTS
    + f""", jobs AS (SELECT *, CASE WHEN state IN {FINAL} THEN heartbeat_at END AS finished_at, job_id % 3 AS admission_deferrals,
  CASE WHEN state IN {UNSUCCESSFUL} THEN ({list(FAILURES)})[job_id % 6 + 1] WHEN state = 'completed' AND job_id % 6 = 2 THEN 'degraded' END AS failure_class FROM (
  SELECT job_id, min(ts) AS created_at, max(ts) AS heartbeat_at, min(ts) FILTER (WHERE to_state = 'claimed') AS started_at, arg_max(to_state, (ts, event_id)) AS state,
  arg_max(priority, (ts, event_id)) AS priority, arg_max(resource_class, (ts, event_id)) AS resource_class,
  arg_max(duration_ms, (ts, event_id)) AS duration_ms, count(*) FILTER (WHERE to_state = 'claimed') AS attempts,
  CASE WHEN job_id % 5 = 0 THEN job_id + 1 END AS dependency_id FROM job_events GROUP BY job_id))"""
)


def deadlines(spark: SparkSession, sf: str) -> DataFrame:
    """One deadline for each order, due 14 days after its date moved by 300 months."""
    o = table(prepare(spark), sf, "orders")
    d = F.add_months(F.col("o_orderdate").cast("date"), 300)
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "completed").otherwise("snoozed")
    return o.select(
        F.col("o_orderkey").alias("deadline_id"),
        F.when(F.col("o_orderkey") % 50 != 0, F.date_add(d, 14)).alias("due_at"),
        status.alias("status"),
        F.when(status == "snoozed", F.when(F.col("o_orderkey") % 9 != 0, F.date_add(d, 7))).alias("snoozed_until"),
        F.get(F.array(*[F.lit(x) for x in DEADLINE_TYPES]), F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("deadline_type"),
        (F.col("o_custkey") % 97).alias("organization_id"),
    )


DEADLINE_TYPES = ("payment", "cancellation", "response", "appointment", "other")
DEADLINES = f"""deadlines AS (SELECT o_orderkey AS deadline_id, CASE WHEN o_orderkey % 50 <> 0 THEN {_D} + 14 END AS due_at,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'completed' ELSE 'snoozed' END AS status,
  CASE WHEN o_orderstatus NOT IN ('O', 'F') AND o_orderkey % 9 <> 0 THEN {_D} + 7 END AS snoozed_until,
  ({list(DEADLINE_TYPES)})[substr(o_orderpriority, 1, 1)::INT] AS deadline_type, o_custkey % 97 AS organization_id FROM orders)"""


def organizations(spark: SparkSession, sf: str) -> DataFrame:
    """One organization for each supplier; some are merged and no longer active."""
    s = table(prepare(spark), sf, "supplier")
    created = F.date_add(F.lit("2020-01-01").cast("date"), F.col("s_suppkey").cast("int"))
    status = F.when(F.col("s_suppkey") % 15 == 0, "merged").otherwise("active")
    return s.select(F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("canonical_name"), created.alias("created_at"), status.alias("status"), F.concat(F.lit("TAX"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("tax_id"))


ORGS = """orgs AS (SELECT s_suppkey AS org_id, s_name AS canonical_name, DATE '2020-01-01' + CAST(s_suppkey AS INTEGER) AS created_at,
  CASE WHEN s_suppkey % 15 = 0 THEN 'merged' ELSE 'active' END AS status, 'TAX' || lpad(s_suppkey::VARCHAR, 6, '0') AS tax_id FROM supplier)"""


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Three spellings for each organization."""
    o = organizations(spark, sf)
    spellings = F.array(F.concat(F.col("canonical_name"), F.lit(" GmbH")), F.concat(F.lit("Firma "), F.col("canonical_name")), F.replace("canonical_name", F.lit("#"), F.lit(" No. ")))
    return o.select("org_id", F.explode(spellings).alias("alias"))


ALIASES = """aliases AS (SELECT org_id, unnest([canonical_name || ' GmbH', 'Firma ' || canonical_name, replace(canonical_name, '#', ' No. ')]) AS alias FROM orgs)"""


def merges(spark: SparkSession, sf: str) -> DataFrame:
    """Organizations merged into the next one, some in chains of two."""
    o = organizations(spark, sf).select(F.col("org_id").alias("source_id"), (F.col("org_id") + 1).alias("target_id"))
    return o.where("source_id % 10 = 0 or source_id % 20 = 1")


MERGES = "merges AS (SELECT org_id AS source_id, org_id + 1 AS target_id FROM orgs WHERE org_id % 10 = 0 OR org_id % 20 = 1)"


def timeline_events(spark: SparkSession, sf: str) -> DataFrame:
    """Ship dates by order and day, moved by 300 months; some without a date."""
    x = table(prepare(spark), sf, "lineitem")
    d = F.add_months(F.col("l_shipdate").cast("date"), 300)
    rows = x.groupBy("l_orderkey", d.alias("day")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("l_suppkey").alias("organization_id"))
    kind = F.get(F.array(F.lit("contract_started"), F.lit("invoice_issued"), F.lit("payment_due")), (F.col("l_orderkey") % 3).cast("int"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_orderkey") % 40 != 0, F.col("day")).alias("event_date"), kind.alias("event_type"), "organization_id", "n_lines")


TIMELINE = """timeline AS (SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 40 <> 0 THEN day END AS event_date,
  (['contract_started', 'invoice_issued', 'payment_due'])[l_orderkey % 3 + 1] AS event_type, organization_id, n_lines
  FROM (SELECT l_orderkey, CAST(l_shipdate + INTERVAL 300 MONTH AS DATE) AS day, count(*) AS n_lines, min(l_suppkey) AS organization_id FROM lineitem GROUP BY 1, 2))"""


def library(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a foreign library from ``part``; the hash repeats where names do."""
    p = table(prepare(spark), sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("source_id"),
        F.col("p_name").alias("title"),
        (k % 120).alias("correspondent"),
        F.col("p_type").alias("type_name"),
        (F.col("p_size") % 5).cast("long").alias("tag"),
        F.sha2("p_name", 256).alias("content_hash"),
        (k % 50 == 0).alias("original_missing"),
        (k % 70 == 0).alias("archive_missing"),
        F.when(k % 9 == 0, F.lit("workflow_state")).alias("unsupported"),
        F.date_add(F.lit("2022-01-01").cast("date"), (k % 700).cast("int")).alias("created"),
        (F.col("p_retailprice") * 100).cast("long").alias("n_bytes"),
    )


LIBRARY = """library AS (SELECT p_partkey AS source_id, p_name AS title, p_partkey % 120 AS correspondent, p_type AS type_name, CAST(p_size % 5 AS BIGINT) AS tag,
  sha256(p_name) AS content_hash, p_partkey % 50 = 0 AS original_missing, p_partkey % 70 = 0 AS archive_missing,
  CASE WHEN p_partkey % 9 = 0 THEN 'workflow_state' END AS unsupported, DATE '2022-01-01' + CAST(p_partkey % 700 AS INTEGER) AS created,
  CAST(trunc(p_retailprice * 100) AS BIGINT) AS n_bytes FROM part)"""


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata proposals: four fields for each document."""
    d = table(prepare(spark), sf, "documents")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("confidence"), F.lit(k).alias("critical")) for f, c, k in PROPOSED])
    rows = d.select("doc_id", "source", "lang", F.posexplode(fields).alias("pos", "p")).select(
        (F.col("doc_id") * 10 + F.col("pos")).alias("proposal_id"),
        "doc_id",
        F.col("p.field").alias("field"),
        F.concat("source", F.lit("-"), "lang", F.lit("-"), F.col("pos").cast("string")).alias("value"),
        F.round(F.col("p.confidence") - (F.col("doc_id") % 7) * 0.05, 2).alias("confidence"),
        F.col("p.critical").alias("critical"),
        (F.col("doc_id") % 11 != 0).alias("verified"),
    )
    return rows


PROPOSED = (("title", 0.9, False), ("amount", 0.82, True), ("payment_due_date", 0.94, True), ("amount", 0.97, True))
PROPOSALS = f"""proposals AS (SELECT doc_id * 10 + pos AS proposal_id, doc_id, field, source || '-' || lang || '-' || pos AS value,
  round(confidence - (doc_id % 7) * 0.05, 2) AS confidence, critical, doc_id % 11 <> 0 AS verified
  FROM documents, (VALUES {', '.join(f"({i}, '{f}', {c}::DOUBLE, {str(k).lower()})" for i, (f, c, k) in enumerate(PROPOSED))}) AS v(pos, field, confidence, critical))"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Review decisions on the proposals of labelled documents: accept, reject or edit."""
    labels = table(prepare(spark), sf, "labels")
    kind = F.when(F.col("toxic") == 1, "edit").when(F.col("quality") == 1, "accept").otherwise("reject")
    rows = labels.select("doc_id", kind.alias("decision"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("pos"))
    return rows.select(
        (F.col("doc_id") * 10 + F.col("pos") + 1).alias("proposal_id"),
        "decision",
        F.when(F.col("decision") == "edit", F.concat(F.lit("edited-"), F.col("doc_id").cast("string"))).alias("edited"),
        (F.lit(1700000000) + F.col("doc_id") % 1000).alias("decided_at"),
    ).distinct()


DECISIONS = """decisions AS (SELECT DISTINCT doc_id * 10 + pos + 1 AS proposal_id, decision, CASE WHEN decision = 'edit' THEN 'edited-' || doc_id END AS edited,
  1700000000 + doc_id % 1000 AS decided_at FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'edit' WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS decision FROM labels),
  (VALUES (0), (1)) AS v(pos))"""


#: The given tables with what should hold in them; some rows do not.
TABLES = {
    "region": Table({"r_regionkey": "int", "r_name": "string"}, ("r_regionkey",), unique=(("r_regionkey",),)),
    "nation": Table({"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, ("n_nationkey", "n_regionkey"), references={"n_regionkey": ("region", "r_regionkey")}),
    "customer": Table({"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}, ("c_custkey",), ranges={"c_acctbal": (0, None)}, unique=(("c_custkey",),), references={"c_nationkey": ("nation", "n_nationkey")}),
    "supplier": Table({"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}, ("s_suppkey",), lengths={"s_name": (1, 255)}, references={"s_nationkey": ("nation", "n_nationkey")}),
    "part": Table({"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "smallint", "p_retailprice": "decimal(18,2)"}, ("p_partkey", "p_name"), ranges={"p_size": (1, 45)}, unique=(("p_partkey",),)),
    "orders": Table({"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}, ("o_orderkey",), {"o_orderstatus": ("O", "F")}, unique=(("o_orderkey",),), references={"o_custkey": ("customer", "c_custkey")}),
    "lineitem": Table(
        {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_discount": "double", "l_returnflag": "string"}, ("l_orderkey",), {"l_returnflag": ("A", "N", "R")}, {"l_discount": (0, 0.09)},
        unique=(("l_orderkey", "l_linenumber"),), references={"l_orderkey": ("orders", "o_orderkey")},
    ),
    "events": Table({"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double"}, ("event_id", "ts"), {"event_type": ("view", "click", "purchase", "signup")}, {"value": (None, 200)}, unique=(("event_id",),)),
    "documents": Table({"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}, ("doc_id", "text"), {"lang": ("en", "de", "fr")}, lengths={"text": (1, 10_000)}, unique=(("doc_id",),)),
    "embeddings": Table({"vec_id": "bigint", "label": "int"}, ("vec_id",), unique=(("vec_id",),)),
    "pages": Table({"page_id": "bigint", "url": "string", "html": "string"}, ("page_id", "url"), unique=(("page_id",), ("url",))),
    "benchmark": Table({"item_id": "bigint", "text": "string"}, ("item_id", "text")),
    "labels": Table({"doc_id": "bigint", "quality": "int", "toxic": "int"}, ("doc_id",), ranges={"quality": (0, 1), "toxic": (0, 0)}, references={"doc_id": ("documents", "doc_id")}),
    "conversations": Table({"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}, ("conv_id", "turn"), {"role": ("user", "assistant")}, lengths={"text": (40, 4000)}, unique=(("conv_id", "turn"),)),
}


def tables_sql() -> str:
    """What ``TABLES`` forbids, counted by DuckDB: rows of (table, problem, n)."""
    parts = []
    for name, t in TABLES.items():
        say = lambda problem, test, name=name: parts.append(f"SELECT '{name}' AS \"table\", '{problem}' AS problem, count(*) AS n FROM {name} WHERE {test} HAVING count(*) > 0")
        for c in t.required:
            say(f"missing:{c}", f"{c} IS NULL")
        for c, words in t.enums.items():
            say(f"enum:{c}", f"{c} NOT IN ({', '.join(map(repr, words))})")
        for c, (low, high) in t.ranges.items():
            say(f"range:{c}", " OR ".join([f"{c} < {low}"] * (low is not None) + [f"{c} > {high}"] * (high is not None)))
        for c, (low, high) in t.lengths.items():
            say(f"length:{c}", f"length({c}) NOT BETWEEN {low} AND {high}")
        for keys in t.unique:
            say(f"unique:{'+'.join(keys)}", f"({', '.join(keys)}) IN (SELECT ({', '.join(keys)}) FROM {name} GROUP BY {', '.join(keys)} HAVING count(*) > 1)")
        for c, (other, key) in t.references.items():
            say(f"reference:{c}", f"{c} IS NOT NULL AND {c} NOT IN (SELECT {key} FROM {other} WHERE {key} IS NOT NULL)")
    return " UNION ALL ".join(parts)
