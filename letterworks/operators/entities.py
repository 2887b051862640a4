"""Organizations and contracts: resolution, merges, accepted knowledge, and their listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterworks.functions import text as T
from letterworks.session import stage

#: The closed vocabularies of accepted knowledge.
PROPOSAL_TYPES = ("organization", "contract", "event", "deadline", "action_item", "document_relationship")
#: The fields of each kind of resource with the value that stands in for one left out.
RESOURCE_FIELDS = {
    "organization": {"canonical_name": None, "organization_type": None},
    "contract": {"title": "Untitled contract", "contract_type": "other", "status": "unknown", "organization_id": None, "reference_identifier": None, "start_date": None, "end_date": None, "renewal_date": None, "cancellation_deadline": None},
    "event": {"event_type": None, "title": None, "description": None, "event_date": None, "event_date_precision": "unknown", "life_area": "other", "organization_id": None, "contract_id": None},
    "deadline": {"title": None, "due_at": None, "original_rule": None, "deadline_type": "other", "contract_id": None},
    "action_item": {"title": None, "description": None, "due_at": None, "priority": "normal", "life_area": "other", "contract_id": None, "deadline_id": None},
    "document_relationship": {"target_document_id": None, "relationship_type": None},
}
DATES = ("start_date", "end_date", "renewal_date", "cancellation_deadline", "event_date", "due_at")


def resolve_organizations(cands: DataFrame, orgs: DataFrame, aliases: DataFrame, accepted: DataFrame) -> DataFrame:
    """Candidates with org_id and match_reason: exact name, exact alias, then a strong identifier of an accepted proposal.

    ``cands``: cand_id, name, strong (an array); ``accepted``: proposal_id, created_at, org_id, strong (an array). Only
    active organizations match. Of several by name or alias the first created wins, by identifier that of the first
    accepted proposal. An empty name matches none, and nothing is matched by likeness. All joins are on equality.
    """
    live = orgs.where("status = 'active'")
    order = F.struct("created_at", "org_id")
    by_name = live.groupBy(T.normalize_name(F.col("canonical_name")).alias("_n")).agg(F.min(order).alias("_name")).where("_n <> ''")
    named = aliases.join(live.select("org_id", "created_at"), "org_id")
    by_alias = named.groupBy(T.normalize_name(F.col("alias")).alias("_a")).agg(F.min(order).alias("_alias")).where("_a <> ''")
    known = accepted.join(live.select("org_id"), "org_id").select("created_at", "proposal_id", "org_id", F.explode("strong").alias("_s"))
    first = known.groupBy("_s").agg(F.min(F.struct("created_at", "proposal_id", "org_id")).alias("_p"))
    wanted = cands.select(F.col("cand_id").alias("_c"), F.explode(F.array_distinct("strong")).alias("_s"))
    by_strong = wanted.join(first, "_s").groupBy("_c").agg(F.min("_p").alias("_strong"))
    out = cands.withColumn("_norm", T.normalize_name(F.col("name")))
    out = out.join(by_name, F.col("_norm") == F.col("_n"), "left").join(by_alias, F.col("_norm") == F.col("_a"), "left").join(by_strong, F.col("cand_id") == F.col("_c"), "left")
    reason = (
        F.when(F.col("_name").isNotNull(), "exact normalized canonical name")
        .when(F.col("_alias").isNotNull(), "exact normalized alias")
        .when(F.col("_strong").isNotNull(), "exact strong organization identifier")
    )
    return out.select(*cands.columns, F.coalesce("_name.org_id", "_alias.org_id", "_strong.org_id").alias("org_id"), reason.alias("match_reason"))


def close_merges(merges: DataFrame) -> DataFrame:
    """(source_id, target_id) with chains followed to their end; each round halves what is left of a chain."""
    while True:
        step = merges.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"))
        new = merges.join(step, F.col("target_id") == F.col("_s"), "left")
        new = stage(new.select("source_id", F.coalesce("_t", "target_id").alias("target_id"), F.col("_t").isNotNull().alias("moved")), "merges")
        merges = new.select("source_id", "target_id")
        if new.where("moved").isEmpty():
            return merges


def remap(df: DataFrame, closed: DataFrame, column: str) -> DataFrame:
    """A frame whose references to merged organizations point to their targets."""
    renamed = closed.withColumnsRenamed({"source_id": "_s", "target_id": "_t"})
    return df.join(renamed, F.col(column) == F.col("_s"), "left").withColumn(column, F.coalesce("_t", column)).drop("_s", "_t")


def merge_organizations(orgs: DataFrame, aliases: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Organizations with status and target, and the aliases of the targets: moved names and aliases, each once, none equal to the name."""
    closed = stage(close_merges(merges), "merges-closed")
    out = orgs.join(closed, F.col("org_id") == F.col("source_id"), "left")
    out = out.withColumn("status", F.when(F.col("target_id").isNotNull(), "merged").otherwise("active")).drop("source_id").withColumnRenamed("target_id", "merged_into_id")
    names = orgs.join(closed, F.col("org_id") == F.col("source_id")).select(F.col("target_id").alias("org_id"), F.col("canonical_name").alias("alias"))
    moved = remap(aliases.select("org_id", "alias"), closed, "org_id").unionByName(names)
    keyed = moved.withColumn("normalized", T.normalize_name(F.col("alias"))).groupBy("org_id", "normalized").agg(F.min("alias").alias("alias"))
    own = orgs.select("org_id", T.normalize_name(F.col("canonical_name")).alias("normalized"))
    return out, keyed.join(own, ["org_id", "normalized"], "left_anti")


def remap_references(references: dict[str, DataFrame], merges: DataFrame) -> DataFrame:
    """(kind, id, organization_id) of the resources of merged organizations, pointing to their targets.

    ``references``: kind -> frame (id, organization_id), such as contracts, events, deadlines, actions and documents.
    """
    tagged = [df.select(F.lit(kind).alias("kind"), "id", "organization_id") for kind, df in references.items()]
    return remap(reduce(DataFrame.unionByName, tagged), stage(close_merges(merges), "merges-closed"), "organization_id")


def accepted_resources(kept: DataFrame) -> dict[str, DataFrame]:
    """Accepted proposals as the six resource tables: proposal_type -> frame.

    ``kept``: proposal_id, document_id, proposal_type, payload and overrides (maps of strings), link_id. Values of the
    decision replace those of the payload; titles are cut to 255 characters and enumerations that are left out take
    their default. A linked proposal makes no resource of its own, nor does one with a value that should be an ISO date
    and is none. A relationship has two different documents and is kept once, from its first proposal.
    """
    values = F.map_zip_with(F.coalesce("payload", F.create_map().cast("map<string,string>")), F.coalesce("overrides", F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))
    made = kept.where("link_id is null").withColumn("_v", values)
    out = {}
    for kind, fields in RESOURCE_FIELDS.items():
        cells, rows = [], made.where(F.col("proposal_type") == kind)
        for name, default in fields.items():
            cell = F.try_element_at("_v", F.lit(name))
            if name in DATES:
                day = F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(cell, "yyyy-MM-dd"))
                rows = rows.where(day.isNotNull() | (F.coalesce(cell, F.lit("")) == ""))
                cell = day
            elif name in ("title", "canonical_name"):
                cell = F.substring(F.trim(cell), 1, 255)
            cells.append((cell if default is None else F.coalesce(cell, F.lit(default))).alias(name))
        out[kind] = rows.select("proposal_id", "document_id", *cells)
    links = out["document_relationship"].where(F.col("target_document_id") != F.col("document_id").cast("string"))
    out["document_relationship"] = links.groupBy("document_id", "target_document_id", "relationship_type").agg(F.min("proposal_id").alias("proposal_id"))
    return out


def accept_knowledge(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted resources, and the refused decisions with their reason.

    The first decision on a proposal counts and later ones conflict; unverified evidence and unknown types are
    refused; values of the decision replace those of the payload.
    """
    w = Window.partitionBy("proposal_id").orderBy("decided_at", "decision_id")
    ranked = decisions.withColumn("_rn", F.row_number().over(w)).join(proposals, "proposal_id", "left")
    reason = (
        F.when(F.col("proposal_type").isNull(), "unknown_proposal")
        .when(F.col("_rn") > 1, "conflict")
        .when(~F.col("evidence_verified"), "unverified_evidence")
        .when(~F.col("proposal_type").isin(*PROPOSAL_TYPES), "unknown_type")
    )
    ranked = ranked.withColumn("reason", reason).drop("_rn")
    good = ranked.where("reason is null")
    value = F.coalesce("new_value", "payload_value")
    kept = good.select("proposal_id", "proposal_type", value.alias("value"), F.coalesce("link_id", "proposal_id").alias("resource_id"), F.col("link_id").isNotNull().alias("linked"))
    return kept, ranked.where("reason is not null").select("decision_id", "proposal_id", "reason")


def list_organizations(orgs: DataFrame, aliases: DataFrame, q: str, status: str | None = None) -> DataFrame:
    """Organizations whose name or an alias contains ``q`` in any case."""
    rows = orgs if status is None else orgs.where(F.col("status") == status)
    pattern = f"%{q}%"
    hits = rows.where(F.col("canonical_name").ilike(pattern)).select("org_id").unionByName(aliases.where(F.col("alias").ilike(pattern)).select("org_id"))
    return rows.join(hits.distinct(), "org_id", "left_semi")


def organization_detail(orgs: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Each organization with sorted arrays of its parts: name -> frame (org_id, value). One shuffle of all parts together."""
    rows = None
    for name, part in parts.items():
        tagged = part.select("org_id", F.lit(name).alias("part"), F.col("value").cast("string").alias("value"))
        rows = tagged if rows is None else rows.unionByName(tagged)
    lists = rows.groupBy("org_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("part") == n, F.col("value")))).alias(n) for n in parts])
    out = orgs.join(lists, "org_id", "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in parts})


def contract_detail(contracts: DataFrame, orgs: DataFrame, events: DataFrame, status: str | None = None, contract_type: str | None = None) -> DataFrame:
    """Contracts that meet the filters with the organization's name and the number and last day of their events."""
    for column, value in (("status", status), ("contract_type", contract_type)):
        if value is not None:
            contracts = contracts.where(F.col(column) == value)
    per = events.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("event_date").alias("last_event"))
    out = contracts.join(orgs.select(F.col("org_id").alias("organization_id"), "canonical_name"), "organization_id", "left").join(per, "contract_id", "left")
    return out.withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def contract_page(contracts: DataFrame, orgs: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Contracts with the organization's name and sorted arrays of what is linked to them.

    ``parts``: name -> frame (contract_id, day, value), such as documents, events, deadlines and actions; each array has
    {day, value} by day, undated last. All parts go through one shuffle; a contract's parts are one row.
    """
    tagged = [part.select("contract_id", F.lit(name).alias("part"), F.col("day").cast("date").alias("day"), F.col("value").cast("string").alias("value")) for name, part in parts.items()]
    one = F.struct(F.col("day").isNull().alias("undated"), "day", "value")
    lists = reduce(DataFrame.unionByName, tagged).groupBy("contract_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == name, one))).alias(name) for name in parts])
    out = contracts.join(orgs.select(F.col("org_id").alias("organization_id"), "canonical_name"), "organization_id", "left").join(lists, "contract_id", "left")
    plain = lambda name: F.transform(F.coalesce(name, F.array().cast("array<struct<undated:boolean,day:date,value:string>>")), lambda x: F.struct(x["day"].alias("day"), x["value"].alias("value")))
    return out.withColumns({name: plain(name) for name in parts})


def list_relationships(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Relations that have one of the documents on either side, each once: two semi-joins instead of a disjunction.

    ``relations`` may repeat; only those that are found are made distinct.
    """
    left = relations.join(docs.select(F.col("doc_id").alias("source_id")), "source_id", "left_semi")
    right = relations.join(docs.select(F.col("doc_id").alias("target_id")), "target_id", "left_semi")
    return left.unionByName(right).distinct()


def knowledge_history(states: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """A row with the value before and after for each change of a resource; none where nothing changed."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = states.withColumns({"previous": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    changed = F.col("_first") | ~F.col("previous").eqNullSafe(F.col(value))
    action = F.when(F.col("_first"), "created").otherwise("changed")
    json = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("value"))))
    return rows.where(changed).select(key, *order, action.alias("action"), json("previous").alias("previous_json"), json(value).alias("new_json"))
