"""Queries for organizations, contracts and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterworks.operators import entities as N
from letterworks.operators import history as H
from letterworks.operators import review as R
from letterworks.plans import frames as fr
from letterworks.plans.registry import query
from letterworks.session import prepare, stage, table

_NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _cands(spark, sf):
    c, orgs = table(prepare(spark), sf, "customer"), fr.organizations(spark, sf)
    n = orgs.agg(F.count(F.lit(1)).alias("n"))
    k = c.join(F.broadcast(n)).withColumn("t", F.col("c_custkey") % (F.col("n") + 20))
    name = F.concat(F.lit("Supplier#"), F.lpad(F.col("t").cast("string"), 9, "0"))
    shown = F.when(k["c_custkey"] % 3 == 0, F.upper(name)).when(k["c_custkey"] % 3 == 1, F.concat(F.lit("firma  "), name)).otherwise(F.concat(F.lit("Unknown "), F.col("c_name")))
    tax = lambda more: F.concat(F.lit("TAX"), F.lpad((F.col("t") + more).cast("string"), 6, "0"))
    strong = F.when(k["c_custkey"] % 3 == 2, F.array(tax(0), tax(2)))
    return k.select(F.col("c_custkey").alias("cand_id"), shown.alias("name"), strong.alias("strong"))


@query(f"""WITH {fr.ORGS}, {fr.ALIASES}, n AS (SELECT count(*) AS n FROM orgs), k AS (SELECT *, c_custkey % (n + 20) AS t FROM customer, n),
c AS (SELECT c_custkey AS cand_id, CASE c_custkey % 3 WHEN 0 THEN upper('Supplier#' || lpad(t::VARCHAR, 9, '0')) WHEN 1 THEN 'firma  Supplier#' || lpad(t::VARCHAR, 9, '0') ELSE 'Unknown ' || c_name END AS name,
  CASE WHEN c_custkey % 3 = 2 THEN ['TAX' || lpad(t::VARCHAR, 6, '0'), 'TAX' || lpad((t + 2)::VARCHAR, 6, '0')] END AS strong FROM k),
live AS (SELECT * FROM orgs WHERE status = 'active'), acc AS (SELECT org_id * 10 AS pid, org_id, tax_id, created_at FROM live
  UNION ALL SELECT org_id * 10 + 1, org_id, 'TAX' || lpad((org_id - 1)::VARCHAR, 6, '0'), created_at - 5 FROM live WHERE org_id % 4 = 0),
st AS (SELECT cand_id, arg_min(org_id, (created_at, pid)) AS o3 FROM (SELECT cand_id, unnest(strong) AS s FROM c) JOIN acc ON s = tax_id GROUP BY 1),
n1 AS (SELECT {_NORM.format('canonical_name')} AS k1, min(org_id) AS o1 FROM live GROUP BY 1), n2 AS (SELECT {_NORM.format('alias')} AS k2, min(org_id) AS o2 FROM aliases JOIN live USING (org_id) GROUP BY 1),
m AS (SELECT c.cand_id, o1, o2, o3 FROM c LEFT JOIN n1 ON {_NORM.format('name')} = k1 LEFT JOIN n2 ON {_NORM.format('name')} = k2 LEFT JOIN st USING (cand_id))
SELECT cand_id, coalesce(o1, o2, o3) AS org_id, CASE WHEN o1 IS NOT NULL THEN 'exact normalized canonical name' WHEN o2 IS NOT NULL THEN 'exact normalized alias' WHEN o3 IS NOT NULL THEN 'exact strong organization identifier' END AS match_reason FROM m""")
def o46_resolve_organizations(spark, sf):
    orgs = fr.organizations(spark, sf)
    own = orgs.select((F.col("org_id") * 10).alias("proposal_id"), "org_id", F.array("tax_id").alias("strong"), "created_at")
    other = F.concat(F.lit("TAX"), F.lpad((F.col("org_id") - 1).cast("string"), 6, "0"))
    early = orgs.where("org_id % 4 = 0").select((F.col("org_id") * 10 + 1).alias("proposal_id"), "org_id", F.array(other).alias("strong"), F.date_sub("created_at", 5).alias("created_at"))
    accepted = own.unionByName(early)
    return N.resolve_organizations(_cands(spark, sf), orgs, fr.aliases(spark, sf), accepted).select("cand_id", "org_id", "match_reason")


_CLOSED = f"{fr.ORGS}, {fr.ALIASES}, {fr.MERGES}, closed AS (SELECT a.source_id, coalesce(b.target_id, a.target_id) AS target_id FROM merges a LEFT JOIN merges b ON a.target_id = b.source_id)"


@query(f"""WITH {_CLOSED}, m AS (SELECT coalesce(target_id, org_id) AS org_id, alias FROM aliases LEFT JOIN closed ON org_id = source_id UNION ALL SELECT target_id, canonical_name FROM orgs JOIN closed ON org_id = source_id),
k AS (SELECT org_id, {_NORM.format('alias')} AS normalized, min(alias) AS alias FROM m GROUP BY ALL)
SELECT k.org_id, alias, normalized FROM k JOIN orgs o ON k.org_id = o.org_id WHERE normalized <> {_NORM.format('canonical_name')}""")
def o47_merge_organizations(spark, sf):
    return N.merge_organizations(fr.organizations(spark, sf), fr.aliases(spark, sf), fr.merges(spark, sf))[1].select("org_id", "alias", "normalized")


@query(f"""WITH {_CLOSED}, {fr.DEADLINES}, r AS (SELECT 'contract' AS kind, o_orderkey AS id, o_custkey % 120 AS organization_id FROM orders UNION ALL SELECT 'deadline', deadline_id, organization_id FROM deadlines
  UNION ALL SELECT 'event', event_id, user_id % 110 FROM events UNION ALL SELECT 'document', doc_id, doc_id % 115 FROM documents)
SELECT kind, id, coalesce(target_id, organization_id) AS organization_id FROM r LEFT JOIN closed ON organization_id = source_id""")
def o47_remap_references(spark, sf):
    of = lambda name, key, org: table(spark, sf, name).select(F.col(key).alias("id"), org.alias("organization_id"))
    references = {
        "contract": of("orders", "o_orderkey", F.col("o_custkey") % 120),
        "deadline": fr.deadlines(spark, sf).withColumnRenamed("deadline_id", "id"),
        "event": of("events", "event_id", F.col("user_id") % 110),
        "document": of("documents", "doc_id", F.col("doc_id") % 115),
    }
    return N.remap_references(references, fr.merges(spark, sf))


def _knowledge(spark, sf):
    o = table(prepare(spark), sf, "orders")
    kind = F.get(F.array(*[F.lit(x) for x in (*N.PROPOSAL_TYPES, "odd")]), (F.col("o_orderkey") % 7).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("proposal_id"),
        kind.alias("proposal_type"),
        F.col("o_orderpriority").alias("payload_value"),
        (F.col("o_orderkey") % 11 != 0).alias("evidence_verified"),
        F.round(F.lit(0.5) + (F.col("o_orderkey") % 50) / 100, 2).alias("confidence"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("accepted").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


_KNOWLEDGE = f"""knowledge AS (SELECT o_orderkey AS proposal_id, ([{', '.join(f"'{x}'" for x in (*N.PROPOSAL_TYPES, 'odd'))}])[o_orderkey % 7 + 1] AS proposal_type, o_orderpriority AS payload_value,
  o_orderkey % 11 <> 0 AS evidence_verified, round(0.5 + (o_orderkey % 50) / 100, 2) AS confidence, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'accepted' END AS status, o_orderdate AS created_at FROM orders)"""


@query(f"""WITH {_KNOWLEDGE}, d AS (SELECT c_custkey AS decision_id, c_custkey * 3 % 4000 AS proposal_id, c_nationkey AS decided_at, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS new_value, CASE WHEN c_custkey % 5 = 0 THEN c_custkey END AS link_id FROM customer),
r AS (SELECT d.*, k.* EXCLUDE (proposal_id), row_number() OVER (PARTITION BY d.proposal_id ORDER BY decided_at, decision_id) AS rn FROM d LEFT JOIN knowledge k USING (proposal_id))
SELECT proposal_id, proposal_type, coalesce(new_value, payload_value) AS value, coalesce(link_id, proposal_id) AS resource_id, link_id IS NOT NULL AS linked FROM r WHERE rn = 1 AND evidence_verified AND proposal_type <> 'odd'""")
def o48_accept_knowledge(spark, sf):
    c = table(prepare(spark), sf, "customer")
    k = F.col("c_custkey")
    d = c.select(
        k.alias("decision_id"), (k * 3 % 4000).alias("proposal_id"), F.col("c_nationkey").alias("decided_at"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("new_value"), F.when(k % 5 == 0, k).alias("link_id")
    )
    return N.accept_knowledge(_knowledge(spark, sf).select("proposal_id", "proposal_type", "payload_value", "evidence_verified"), d)[0]


def _accepted(spark, sf):
    """Accepted proposals of all six kinds with payloads, edits and links, one for each order."""
    k, day = F.col("o_orderkey"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    payload = {
        "title": F.when(k % 11 != 0, text("Item ", k)),
        "canonical_name": text("  Firma ", F.col("o_custkey")),
        "contract_type": F.when(k % 4 == 1, "lease"),
        "reference_identifier": text("V-", k),
        "start_date": day,
        "event_type": F.lit("contract_started"),
        "event_date": F.when(k % 9 == 2, "soon").otherwise(day),
        "due_at": F.when(k % 10 == 3, "").otherwise(day),
        "target_document_id": text(F.col("o_custkey") + F.floor(k / 6) % 3),
        "relationship_type": F.lit("related"),
    }
    cells = F.create_map(*[x for name, cell in payload.items() for x in (F.lit(name), cell)])
    kind = F.get(F.array(*[F.lit(x) for x in N.PROPOSAL_TYPES]), (k % 6).cast("int"))
    edits = F.when(k % 5 == 0, F.create_map(F.lit("title"), text("edited-", k)))
    return table(prepare(spark), sf, "orders").select(k.alias("proposal_id"), F.col("o_custkey").alias("document_id"), kind.alias("proposal_type"), cells.alias("payload"), edits.alias("overrides"), F.when(k % 7 == 0, k).alias("link_id"))


def _accepted_sql(kind: str) -> str:
    title, due = "CASE WHEN k % 5 = 0 THEN 'edited-' || k WHEN k % 11 <> 0 THEN 'Item ' || k END", "CASE WHEN k % 10 <> 3 THEN d END AS due_at"
    no = lambda *names: ", ".join(f"NULL::VARCHAR AS {n}" for n in names)
    cells, test = {
        "organization": (f"'Firma ' || document_id AS canonical_name, {no('organization_type')}", "TRUE"),
        "contract": (
            f"coalesce({title}, 'Untitled contract') AS title, CASE WHEN k % 4 = 1 THEN 'lease' ELSE 'other' END AS contract_type, 'unknown' AS status, {no('organization_id')}, 'V-' || k AS reference_identifier, d AS start_date,"
            " NULL::DATE AS end_date, NULL::DATE AS renewal_date, NULL::DATE AS cancellation_deadline",
            "TRUE",
        ),
        "event": (f"'contract_started' AS event_type, {title} AS title, {no('description')}, d AS event_date, 'unknown' AS event_date_precision, 'other' AS life_area, {no('organization_id', 'contract_id')}", "k % 9 <> 2"),
        "deadline": (f"{title} AS title, {due}, {no('original_rule')}, 'other' AS deadline_type, {no('contract_id')}", "TRUE"),
        "action_item": (f"{title} AS title, {no('description')}, {due}, 'normal' AS priority, 'other' AS life_area, {no('contract_id', 'deadline_id')}", "TRUE"),
        "document_relationship": ("(document_id + k // 6 % 3)::VARCHAR AS target_document_id, 'related' AS relationship_type", "k // 6 % 3 <> 0"),
    }[kind]
    rows = f"SELECT k AS proposal_id, document_id, {cells} FROM a WHERE k % 6 = {N.PROPOSAL_TYPES.index(kind)} AND k % 7 <> 0 AND {test}"
    a = "WITH a AS (SELECT o_orderkey AS k, o_custkey AS document_id, CAST(o_orderdate AS DATE) AS d FROM orders)"
    if kind == "document_relationship":
        rows = f"SELECT min(proposal_id) AS proposal_id, document_id, target_document_id, relationship_type FROM ({rows}) GROUP BY ALL"
    return f"{a} {rows}"


@query(_accepted_sql("organization"))
def o48_accepted_organizations(spark, sf):
    return N.accepted_resources(_accepted(spark, sf))["organization"]


@query(_accepted_sql("contract"))
def o48_accepted_contracts(spark, sf):
    return N.accepted_resources(_accepted(spark, sf))["contract"]


@query(_accepted_sql("event"))
def o48_accepted_events(spark, sf):
    return N.accepted_resources(_accepted(spark, sf))["event"]


@query(_accepted_sql("deadline"))
def o48_accepted_deadlines(spark, sf):
    return N.accepted_resources(_accepted(spark, sf))["deadline"]


@query(_accepted_sql("action_item"))
def o48_accepted_actions(spark, sf):
    return N.accepted_resources(_accepted(spark, sf))["action_item"]


@query(_accepted_sql("document_relationship"))
def o48_accepted_relationships(spark, sf):
    return N.accepted_resources(_accepted(spark, sf))["document_relationship"]


@query(f"""WITH {fr.ORGS}, {fr.ALIASES}, h AS (SELECT org_id FROM orgs WHERE canonical_name ILIKE '%no. 00000001%' UNION SELECT org_id FROM aliases WHERE alias ILIKE '%no. 00000001%')
SELECT o.org_id, canonical_name, (SELECT string_agg(alias, '|' ORDER BY alias) FROM aliases a WHERE a.org_id = o.org_id) AS alias_list, CAST((SELECT count(*) FROM supplier s JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = o.org_id) AS INTEGER) AS n_nations
FROM orgs o JOIN h USING (org_id)""")
def o49_organization_detail(spark, sf):
    orgs, aliases = fr.organizations(spark, sf), fr.aliases(spark, sf)
    nations = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("org_id"), F.col("n_name").alias("value"))
    found = N.list_organizations(orgs, aliases, "no. 00000001")
    out = N.organization_detail(found, {"aliases": aliases.withColumnRenamed("alias", "value"), "nations": nations})
    return out.select("org_id", "canonical_name", F.array_join("aliases", "|").alias("alias_list"), F.size("nations").alias("n_nations"))


@query(f"""WITH {fr.ORGS}, {fr.TIMELINE}, c AS (SELECT o_orderkey AS contract_id, o_custkey % 120 AS organization_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O'),
e AS (SELECT doc_id, count(*) AS n_events, max(event_date) AS last_event FROM timeline GROUP BY 1)
SELECT contract_id, canonical_name, coalesce(n_events, 0) AS n_events, last_event FROM c LEFT JOIN orgs ON organization_id = org_id LEFT JOIN e ON doc_id = contract_id""")
def o50_contract_detail(spark, sf):
    o = table(prepare(spark), sf, "orders")
    contracts = o.select(F.col("o_orderkey").alias("contract_id"), (F.col("o_custkey") % 120).alias("organization_id"), F.col("o_orderstatus").alias("status"))
    events = fr.timeline_events(spark, sf).withColumnRenamed("doc_id", "contract_id")
    return N.contract_detail(contracts, fr.organizations(spark, sf), events, status="O").select("contract_id", "canonical_name", "n_events", "last_event")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS source_id, l_partkey AS target_id FROM lineitem), d AS (SELECT doc_id FROM documents WHERE source = 'src3')
SELECT * FROM r WHERE source_id IN (SELECT doc_id FROM d) OR target_id IN (SELECT doc_id FROM d)""")
def o51_list_relationships(spark, sf):
    relations = table(prepare(spark), sf, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    return N.list_relationships(relations, table(spark, sf, "documents").where("source = 'src3'")).select("source_id", "target_id")


@query(f"""WITH {fr.JOB_EVENTS}, r AS (SELECT *, lag(to_state) OVER w AS prev, row_number() OVER w AS rn FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
SELECT job_id, event_id, CASE WHEN rn = 1 THEN 'created' ELSE 'changed' END AS action, CASE WHEN prev IS NOT NULL THEN '{{"value":"' || prev || '"}}' END AS previous_json, '{{"value":"' || to_state || '"}}' AS new_json
FROM r WHERE rn = 1 OR prev IS DISTINCT FROM to_state""")
def o52_knowledge_history(spark, sf):
    return N.knowledge_history(fr.jobs_events(spark, sf), "job_id", "to_state", ["ts", "event_id"]).drop("ts")


@query(f"""WITH {fr.PROPOSALS}, p AS (SELECT *, CASE WHEN proposal_id % 3 = 0 THEN 'pending' ELSE 'accepted' END AS status FROM proposals), n AS (SELECT doc_id, count(*) AS n_pending, count(*) FILTER (WHERE critical) AS n_critical FROM p WHERE status = 'pending' GROUP BY 1)
SELECT d.doc_id, coalesce(n_pending, 0) AS n_pending, coalesce(n_critical, 0) AS n_critical, d.doc_id % 8 = 0 AS undecided FROM documents d LEFT JOIN n USING (doc_id) WHERE coalesce(n_pending, 0) > 0 OR d.doc_id % 8 = 0""")
def o53_review_queue(spark, sf):
    p = fr.proposals(spark, sf).withColumn("status", F.when(F.col("proposal_id") % 3 == 0, "pending").otherwise("accepted"))
    docs = table(spark, sf, "documents").select("doc_id")
    comparisons = docs.withColumn("decided", F.col("doc_id") % 8 != 0)
    return R.review_queue(docs, p, comparisons)


@query(f"""WITH {fr.PROPOSALS} SELECT proposal_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE field WHEN 'payment_due_date' THEN 100 WHEN 'title' THEN 80 WHEN 'amount' THEN 8 ELSE 50 END DESC, critical DESC, confidence DESC, proposal_id) AS INTEGER) AS rank FROM proposals""")
def o54_rank_proposals(spark, sf):
    return R.rank_proposals(fr.proposals(spark, sf)).select("proposal_id", "rank")


_FOLD = f"""{fr.PROPOSALS}, {fr.DECISIONS}, l AS (SELECT proposal_id, arg_max(struct_pack(decision := decision, edited := edited, decided_at := decided_at), (decided_at, decision)) AS d FROM decisions GROUP BY 1),
j AS (SELECT p.*, l.d.decision AS decision, l.d.edited AS edited, l.d.decided_at AS decided_at FROM proposals p LEFT JOIN l USING (proposal_id)),
w AS (SELECT doc_id, field, arg_max(proposal_id, (decided_at, proposal_id)) AS won, arg_max(coalesce(edited, value), (decided_at, proposal_id)) AS won_value FROM j WHERE decision IN ('accept', 'edit') GROUP BY 1, 2)"""


@query(f"""WITH {_FOLD} SELECT proposal_id, j.doc_id, CASE WHEN won = proposal_id THEN 'accepted' WHEN decision = 'reject' THEN 'rejected' WHEN won IS NOT NULL THEN 'superseded' ELSE 'pending' END AS status, won_value
FROM j LEFT JOIN w ON j.doc_id = w.doc_id AND j.field = w.field""")
def o55_apply_decisions(spark, sf):
    statuses, canonical = R.apply_decisions(fr.proposals(spark, sf), fr.decisions(spark, sf))
    return statuses.join(canonical.withColumnRenamed("value", "won_value"), ["doc_id", "field"], "left").select("proposal_id", "doc_id", "status", "won_value")


@query("""SELECT doc_id, 'lang' AS field, lang AS previous, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE upper(lang) END AS current FROM documents WHERE lang IS DISTINCT FROM CASE WHEN doc_id % 4 = 0 THEN NULL ELSE upper(lang) END
UNION ALL SELECT doc_id, 'source', source, 'src1' FROM documents WHERE source IS DISTINCT FROM 'src1'""")
def o56_metadata_history(spark, sf):
    before = table(prepare(spark), sf, "documents").select("doc_id", "lang", "source")
    after = before.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.upper("lang")).alias("lang"), F.lit("src1").alias("source"))
    return R.metadata_history(before, after, "doc_id", ["lang", "source"])


@query(f"""WITH {_KNOWLEDGE} SELECT proposal_id, proposal_type, confidence FROM knowledge WHERE status = 'pending' AND confidence >= 0.6 AND confidence <= 0.95
ORDER BY CASE WHEN proposal_type IN ('deadline', 'action_item') THEN 0 WHEN proposal_type IN ('contract', 'event') THEN 1 ELSE 2 END, confidence DESC, created_at, proposal_id LIMIT 50""")
def o57_knowledge_review_queue(spark, sf):
    return R.knowledge_review_queue(_knowledge(spark, sf), "priority", 0.6, 0.95).select("proposal_id", "proposal_type", "confidence")


_REVIEW = f"""{fr.PROPOSALS}, p AS (SELECT doc_id, count(*) AS n FROM proposals WHERE proposal_id % 3 = 0 GROUP BY 1), k AS (SELECT o_custkey % 1000 AS doc_id, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
c AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 8 = 0 AND doc_id % 16 <> 0)"""


def _review(spark, sf):
    """Documents in review with their proposals, knowledge and comparisons; some comparisons are decided or of an older text."""
    k = F.col("doc_id")
    d = table(prepare(spark), sf, "documents")
    status = F.when(k % 5 == 0, "ready").otherwise("needs_review").alias("status")
    docs = d.select("doc_id", F.col("n_chars").alias("created_at"), status, (k * 2).alias("canonical_extraction_id"), F.when(k % 7 == 0, F.array(F.concat(F.lit("empty pages in "), F.col("source")))).alias("warnings"))
    p = fr.proposals(spark, sf).withColumn("status", F.when(F.col("proposal_id") % 3 == 0, "pending").otherwise("accepted"))
    o = table(spark, sf, "orders")
    knowledge = o.select((F.col("o_custkey") % 1000).alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("accepted").alias("status"))
    comparisons = d.where(k % 4 == 0).select("doc_id", F.when(k % 16 == 0, k).otherwise(k * 2).alias("baseline_id"), F.when(k % 8 != 0, "keep").alias("review_decision"))
    return docs, p, knowledge, comparisons


@query(f"""WITH {_REVIEW} SELECT d.doc_id, n_chars AS created_at, CASE WHEN d.doc_id % 7 = 0 THEN 'empty pages in ' || source ELSE '' END AS warnings, coalesce(p.n, 0) AS proposal_count, coalesce(k.n, 0) AS knowledge_proposal_count,
 c.doc_id IS NOT NULL OR d.doc_id = 0 AS extraction_review_required FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id WHERE d.doc_id % 5 <> 0 ORDER BY n_chars, d.doc_id LIMIT 50 OFFSET 25""")
def o53_review_page(spark, sf):
    return R.review_page(*_review(spark, sf), limit=50, offset=25).withColumn("warnings", F.array_join("warnings", ","))


@query(f"""WITH {fr.JOBS}, l AS (SELECT job_id % 1000 AS doc_id, arg_max(job_id || ':' || state, (created_at, job_id)) AS latest_job FROM jobs GROUP BY 1), r AS (SELECT o_custkey % 1000 AS doc_id, max(o_orderkey) AS current_run FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1),
h AS (SELECT l_orderkey % 1000 AS doc_id, l_shipdate AS seen, l_returnflag AS field, l_partkey::VARCHAR AS value FROM lineitem WHERE l_linenumber = 1),
a AS (SELECT doc_id, string_agg(field || '=' || value, ',' ORDER BY seen DESC, field DESC, value DESC) AS history FROM h GROUP BY 1)
SELECT d.doc_id, latest_job, current_run, coalesce(history, '') AS history FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN a USING (doc_id) WHERE d.doc_id < 1000""")
def o53_review_detail(spark, sf):
    docs = table(prepare(spark), sf, "documents").where("doc_id < 1000").select("doc_id")
    jobs = fr.jobs(spark, sf).select((F.col("job_id") % 1000).alias("doc_id"), "job_id", "created_at", "state")
    runs = table(spark, sf, "orders").select((F.col("o_custkey") % 1000).alias("doc_id"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 4 == 0).alias("is_current"))
    history = table(spark, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_shipdate").alias("confirmed_at"), F.col("l_returnflag").alias("field"), F.col("l_partkey").cast("string").alias("value"))
    out = R.review_detail(docs, jobs, history, runs)
    shown = F.array_join(F.transform(F.coalesce("metadata_history", F.array().cast("array<struct<confirmed_at:timestamp_ntz,field:string,value:string>>")), lambda h: F.concat_ws("=", h["field"], h["value"])), ",")
    return out.select("doc_id", F.when(F.col("latest_job").isNotNull(), F.concat_ws(":", "latest_job.job_id", "latest_job.state")).alias("latest_job"), "current_run", shown.alias("history"))


_MATCHED = f"""{fr.ORGS}, {fr.ALIASES}, n AS (SELECT count(*) AS n FROM orgs),
c AS (SELECT c_custkey AS proposal_id, CASE WHEN c_custkey % 4 = 3 THEN 'deadline' ELSE 'organization' END AS proposal_type, CASE WHEN c_custkey % 9 = 0 THEN 'accepted' ELSE 'pending' END AS status, round(0.5 + (c_custkey % 50) / 100, 2) AS confidence, c_acctbal AS created_at, c_custkey % 1000 AS document_id,
  CASE c_custkey % 2 WHEN 0 THEN ' Supplier#' || lpad((c_custkey % (n + 20))::VARCHAR, 9, '0') ELSE 'FIRMA Supplier#' || lpad((c_custkey % (n + 20))::VARCHAR, 9, '0') END AS name FROM customer, n),
live AS (SELECT * FROM orgs WHERE status = 'active'), n1 AS (SELECT {_NORM.format('canonical_name')} AS k1, arg_min(org_id, (created_at, org_id)) AS o1 FROM live GROUP BY 1),
n2 AS (SELECT {_NORM.format('alias')} AS k2, arg_min(org_id, (created_at, org_id)) AS o2 FROM aliases JOIN live USING (org_id) GROUP BY 1),
g AS (SELECT * FROM c WHERE status = 'pending' AND confidence >= 0.6 AND document_id IN (SELECT doc_id FROM documents WHERE lower(lang) = 'en')
  ORDER BY CASE WHEN proposal_type = 'deadline' THEN 0 ELSE 2 END, confidence DESC, created_at, proposal_id LIMIT 200 OFFSET 10)"""


@query(f"""WITH {_MATCHED} SELECT proposal_id, proposal_type, confidence, CASE WHEN proposal_type = 'organization' THEN coalesce(o1, o2) END AS possible_existing_organization_id,
 CASE WHEN proposal_type = 'organization' THEN CASE WHEN o1 IS NOT NULL THEN 'exact normalized canonical name' WHEN o2 IS NOT NULL THEN 'exact normalized alias' END END AS match_reason
FROM g LEFT JOIN n1 ON {_NORM.format('name')} = k1 LEFT JOIN n2 ON {_NORM.format('name')} = k2""")
def o57_review_with_matches(spark, sf):
    """A page of one document type's pending proposals with the organization that each may be."""
    c, orgs = table(prepare(spark), sf, "customer"), fr.organizations(spark, sf)
    k = F.col("c_custkey")
    number = F.lpad((k % (F.col("n") + 20)).cast("string"), 9, "0")
    rows = c.join(F.broadcast(orgs.agg(F.count(F.lit(1)).alias("n"))))  # one row
    rows = rows.select(
        k.alias("proposal_id"), F.when(k % 4 == 3, "deadline").otherwise("organization").alias("proposal_type"), F.when(k % 9 == 0, "accepted").otherwise("pending").alias("status"),
        F.round(F.lit(0.5) + (k % 50) / 100, 2).alias("confidence"), F.col("c_acctbal").alias("created_at"), (k % 1000).alias("document_id"),
        F.when(k % 2 == 0, F.concat(F.lit(" Supplier#"), number)).otherwise(F.concat(F.lit("FIRMA Supplier#"), number)).alias("name"), F.array().cast("array<string>").alias("strong"),
    )
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("document_type"))
    page = stage(R.knowledge_review_queue(rows, "priority", 0.6, limit=200, document_type=" EN ", docs=docs, offset=10), "review-page")
    none = orgs.select((F.col("org_id") * 10).alias("proposal_id"), "org_id", F.array("tax_id").alias("strong"), "created_at").limit(0)
    out = R.with_organization_match(page, orgs, fr.aliases(spark, sf), none)
    return out.select("proposal_id", "proposal_type", "confidence", "possible_existing_organization_id", "match_reason")


@query(f"""WITH {fr.ORGS}, {fr.TIMELINE}, {fr.DEADLINES}, c AS (SELECT o_orderkey AS contract_id, o_custkey % 120 AS organization_id FROM orders WHERE o_orderstatus = 'O'),
e AS (SELECT doc_id AS contract_id, string_agg(coalesce(strftime(event_date, '%Y-%m-%d'), '') || '=' || event_type, ',' ORDER BY event_date IS NULL, event_date, event_type) AS events FROM timeline GROUP BY 1),
d AS (SELECT deadline_id AS contract_id, coalesce(strftime(due_at, '%Y-%m-%d'), '') || '=' || deadline_type AS deadlines FROM deadlines),
o AS (SELECT doc_id AS contract_id, '=' || source AS documents FROM documents), a AS (SELECT o_orderkey AS contract_id, '=' || o_orderpriority AS actions FROM orders WHERE o_orderkey % 3 = 0)
SELECT contract_id, canonical_name, coalesce(documents, '') AS documents, coalesce(events, '') AS events, coalesce(deadlines, '') AS deadlines, coalesce(actions, '') AS actions
FROM c LEFT JOIN orgs ON organization_id = org_id LEFT JOIN e USING (contract_id) LEFT JOIN d USING (contract_id) LEFT JOIN o USING (contract_id) LEFT JOIN a USING (contract_id)""")
def o50_contract_page(spark, sf):
    o = table(prepare(spark), sf, "orders")
    k, none = F.col("o_orderkey").alias("contract_id"), F.lit(None).alias("day")
    contracts = o.where("o_orderstatus = 'O'").select(k, (F.col("o_custkey") % 120).alias("organization_id"))
    parts = {
        "documents": table(spark, sf, "documents").select(F.col("doc_id").alias("contract_id"), none, F.col("source").alias("value")),
        "events": fr.timeline_events(spark, sf).select(F.col("doc_id").alias("contract_id"), F.col("event_date").alias("day"), F.col("event_type").alias("value")),
        "deadlines": fr.deadlines(spark, sf).select(F.col("deadline_id").alias("contract_id"), F.col("due_at").alias("day"), F.col("deadline_type").alias("value")),
        "actions": o.where("o_orderkey % 3 = 0").select(k, none, F.col("o_orderpriority").alias("value")),
    }
    out = N.contract_page(contracts, fr.organizations(spark, sf), parts)
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.coalesce(x["day"].cast("string"), F.lit("")), F.lit("="), x["value"])), ",").alias(c)
    return out.select("contract_id", "canonical_name", *[shown(c) for c in parts])


def _states(spark, sf):
    """What organizations, merges, metadata proposals and deadlines were from when on."""
    orgs, merges = fr.organizations(spark, sf), fr.merges(spark, sf)
    at = lambda n: F.lit(n)
    closed = stage(N.close_merges(merges), "merges-closed")
    named = orgs.join(closed, F.col("org_id") == F.col("source_id"), "left")
    created = H.resource_states("organization", orgs, "org_id", at(1), 0, {"name": F.col("canonical_name"), "status": F.lit("active")})
    again = H.resource_states("organization", orgs, "org_id", at(2), 1, {"name": F.col("canonical_name"), "status": F.lit("active")})  # nothing changed
    merged = H.resource_states("organization", named.where("target_id is not null"), "org_id", at(3), 2, {"name": F.col("canonical_name"), "status": F.lit("merged"), "merged_into": F.col("target_id")})
    p = fr.proposals(spark, sf)
    statuses, canonical = R.apply_decisions(p, fr.decisions(spark, sf))
    pending = H.resource_states("metadata_proposal", p, "proposal_id", at(1), 0, {"status": F.lit("pending")})
    decided = H.resource_states("metadata_proposal", statuses, "proposal_id", at(2), 1, {"status": F.col("status")})
    values = H.resource_states("canonical_metadata", canonical.withColumn("id", F.concat_ws(":", "doc_id", "field")), "id", at(2), 1, {"value": F.col("value")})
    return H.all_states(created, again, merged, pending, decided, values)


_LOG = f"""{_CLOSED}, {_FOLD}, s AS (SELECT proposal_id, CASE WHEN won = proposal_id THEN 'accepted' WHEN decision = 'reject' THEN 'rejected' WHEN won IS NOT NULL THEN 'superseded' ELSE 'pending' END AS status FROM j LEFT JOIN w ON j.doc_id = w.doc_id AND j.field = w.field)"""


@query(f"""WITH {_LOG} SELECT 'organization' AS resource_type, org_id::VARCHAR AS resource_id, 'created' AS action, NULL AS previous_json, '{{"name":"' || canonical_name || '","status":"active"}}' AS new_json FROM orgs
UNION ALL SELECT 'organization', source_id::VARCHAR, 'merged', '{{"status":"active"}}', '{{"merged_into":"' || target_id || '","status":"merged"}}' FROM closed
UNION ALL SELECT 'metadata_proposal', proposal_id::VARCHAR, 'created', NULL, '{{"status":"pending"}}' FROM proposals
UNION ALL SELECT 'metadata_proposal', proposal_id::VARCHAR, CASE WHEN status = 'rejected' THEN 'rejected' ELSE 'status_changed' END, '{{"status":"pending"}}', '{{"status":"' || status || '"}}' FROM s WHERE status <> 'pending'
UNION ALL SELECT 'canonical_metadata', doc_id || ':' || field, 'created', NULL, '{{"value":"' || won_value || '"}}' FROM w""")
def o52_change_log(spark, sf):
    return H.change_log(_states(spark, sf)).drop("at", "seq")


@query(f"""WITH {_LOG} SELECT 'organization' AS resource_type, org_id::VARCHAR AS resource_id, CASE WHEN target_id IS NULL THEN 'name=' || canonical_name || ',status=active' ELSE 'merged_into=' || target_id || ',name=' || canonical_name || ',status=merged' END AS state FROM orgs LEFT JOIN closed ON org_id = source_id
UNION ALL SELECT 'metadata_proposal', proposal_id::VARCHAR, 'status=' || status FROM s UNION ALL SELECT 'canonical_metadata', doc_id || ':' || field, 'value=' || won_value FROM w""")
def o52_replay(spark, sf):
    """The log read back: organizations with their merges, statuses of proposals and canonical values."""
    states = H.replay(stage(H.change_log(_states(spark, sf)), "change-log"))
    return states.select("resource_type", "resource_id", F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("state"))
