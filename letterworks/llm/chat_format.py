"""Perspective rotation for dialogues with any number of parties.

Each speaker of a conversation in turn becomes the assistant; the others are
named users. The result is one row per turn and perspective, in the order of
``turn``: chat role, name, rendered text and the loss mask (1 where the assistant
speaks). No conversation is gathered in one place, so one of any length works;
``render_dialogues`` joins the rows of conversations that fit one row.

Names and texts cannot forge the markup: ``<|`` in them is written ``<\\|`` (with one
backslash more where backslashes stand between), and control characters of a name
are blanks.

Defined results: ``system`` turns keep that role and open no perspective; a null
role is a speaker without a name, apart from all named ones (null perspective, no
name in the rendering); a null text is empty; a null conversation id is one
conversation; repeated turns are all kept; turns with equal numbers are in the order
of their rendered texts in a dialogue, and rows of their own otherwise; texts of any
length are rendered whole; other columns of the table, whatever their names, are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.session import prepare, table


def escaped(text: Column) -> Column:
    """The text without the opening of a mark; one backslash less gives it back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, chat_role, name, rendered, mask, n_chars for each turn and perspective."""
    said = turns.select("conv_id", "turn", F.col("role").alias("speaker"), F.coalesce(F.col("text"), F.lit("")).alias("content"))
    system = F.coalesce(F.col("speaker") == "system", F.lit(False))
    views = said.where(~system).select(F.col("conv_id").alias("view_id"), F.col("speaker").alias("perspective")).distinct()
    rows = said.join(views, F.col("conv_id").eqNullSafe(F.col("view_id")))
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(system, "system").when(own, "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    shown = escaped(F.regexp_replace(name, r"[\x00-\x1F]", " "))
    head = F.concat(F.lit("<|im_start|>"), role, F.coalesce(F.concat(F.lit(" name="), shown), F.lit("")), F.lit("\n"))
    rendered = F.concat(head, escaped(F.col("content")), F.lit("<|im_end|>\n"))
    return rows.select(
        "conv_id",
        "perspective",
        "turn",
        role.alias("chat_role"),
        name.alias("name"),
        rendered.alias("rendered"),
        own.cast("int").alias("mask"),
        F.length("content").cast("long").alias("n_chars"),
    )


def render_dialogues(turns: DataFrame) -> DataFrame:
    """One row per conversation and perspective: ``dialogue`` and ``masks``, an array of ``{text, mask}`` in order.

    For conversations that fit one row; ``rotate`` has no such bound.
    """
    rows = rotate(turns).groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("turn", "rendered", "mask"))).alias("t"))
    return rows.select(
        "conv_id",
        "perspective",
        F.array_join(F.col("t")["rendered"], "").alias("dialogue"),
        F.transform("t", lambda x: F.struct(x["rendered"].alias("text"), x["mask"].alias("mask"))).alias("masks"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(prepare(spark), sf_dir, "conversations"))


OP10_SQL = r"""
WITH said AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS content FROM conversations),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker IS DISTINCT FROM 'system'),
r AS (SELECT s.*, v.perspective,
        CASE WHEN speaker = 'system' THEN 'system' WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' ELSE 'user' END AS chat_role
      FROM said s JOIN views v ON s.conv_id IS NOT DISTINCT FROM v.conv_id)
SELECT conv_id, perspective, turn, chat_role,
  CASE WHEN chat_role = 'user' THEN speaker END AS name,
  '<|im_start|>' || chat_role
    || CASE WHEN chat_role = 'user' AND speaker IS NOT NULL
         THEN ' name=' || regexp_replace(regexp_replace(speaker, '[\x00-\x1F]', ' ', 'g'), '<(\\*)\|', '<\\\1|', 'g') ELSE '' END
    || chr(10) || regexp_replace(content, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS rendered,
  CAST(speaker IS NOT DISTINCT FROM perspective AS INTEGER) AS mask, CAST(length(content) AS BIGINT) AS n_chars
FROM r
"""
