"""One log of all changes of knowledge, and its replay.

A state is what a resource was from a moment on: resource_type, resource_id, at, seq, and
values (a map of texts). The log has a row for each state that changed something, with the
changed values before and after as JSON; replaying it gives the last states back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The values whose change alone is a change of status.
STATUS_VALUES = ("status", "snoozed_until", "completed_at")


def _json(m: Column, keys: Column) -> Column:
    """Some entries of a map as JSON, in order of their keys; null without any."""
    entries = F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(m, k).alias("value")))
    return F.when(F.size(keys) > 0, F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}))


def change_log(states: DataFrame) -> DataFrame:
    """resource_type, resource_id, at, seq, action, previous_json, new_json of every change; states that repeat the one before leave no row.

    The action is ``created``, ``merged``, ``rejected``, ``linked``, ``status_changed`` or ``changed``: what the change says first.
    """
    w = Window.partitionBy("resource_type", "resource_id").orderBy("at", "seq")
    empty = F.create_map().cast("map<string,string>")
    rows = states.withColumns({"values": F.coalesce("values", empty), "_prev": F.lag("values").over(w), "_first": F.row_number().over(w) == 1})
    rows = rows.withColumn("_prev", F.coalesce("_prev", empty))
    keys = F.array_sort(F.filter(F.array_union(F.map_keys("values"), F.map_keys("_prev")), lambda k: ~F.try_element_at("values", k).eqNullSafe(F.try_element_at("_prev", k))))
    rows = rows.withColumn("_keys", keys).where("_first or size(_keys) > 0")
    has = lambda k: F.array_contains("_keys", k)
    to = lambda k, v: has(k) & (F.try_element_at("values", F.lit(k)) == v)
    only_status = F.forall("_keys", lambda k: k.isin(*STATUS_VALUES))
    action = (
        F.when(F.col("_first"), "created")
        .when(to("status", "merged"), "merged")
        .when(to("status", "rejected"), "rejected")
        .when(has("linked_to"), "linked")
        .when(only_status, "status_changed")
        .otherwise("changed")
    )
    before = F.filter("_keys", lambda k: F.map_contains_key("_prev", k))
    return rows.select("resource_type", "resource_id", "at", "seq", action.alias("action"), _json(F.col("_prev"), before).alias("previous_json"), _json(F.col("values"), F.col("_keys")).alias("new_json"))


def replay(log: DataFrame) -> DataFrame:
    """resource_type, resource_id and the values after the last change; the newest value of each key by a partial aggregation, values of null gone."""
    entries = log.select("resource_type", "resource_id", "at", "seq", F.explode_outer(F.from_json("new_json", "map<string,string>")).alias("key", "value"))
    last = entries.groupBy("resource_type", "resource_id", "key").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))
    kept = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("key", "value")))
    return last.groupBy("resource_type", "resource_id").agg(F.map_from_entries(F.array_sort(kept)).alias("values"))


def resource_states(kind: str, df: DataFrame, key: str, at: Column, seq: int, values: dict[str, Column]) -> DataFrame:
    """States of one kind from a table; values that are null are not there."""
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]), lambda x: x["value"].isNotNull())
    return df.select(F.lit(kind).alias("resource_type"), F.col(key).cast("string").alias("resource_id"), at.cast("long").alias("at"), F.lit(seq).alias("seq"), F.map_from_entries(pairs).alias("values"))


def all_states(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
