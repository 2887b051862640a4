"""Search rows from approved values only: canonical fields, tags, and the pages of the canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterworks.functions import text as T

#: Canonical fields whose values are searchable beside organization and identifier.
METADATA_FIELDS = (
    "contract", "amount", "invoice_total", "monthly_rent", "service_charges", "parking_fee", "total_rent", "deposit", "contract_amount", "account_balance", "valuation", "premium",
    "refund", "other_amount", "monthly_contribution", "retirement_assets", "cancellation_value", "document_date", "due_date", "effective_date", "other_date", "tags",
)
#: Keys that stand for an object, the first that it has.
PREFERRED = {"organization": ("name", "value"), "identifier": ("normalized", "value", "source")}


#: Tokens of compact JSON: strings (keys with their colon), numbers and words.
TOKEN = r'"(?:[^"\\]|\\.)*":?|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null'


def _scalars(json: Column) -> Column:
    """The texts and numbers in a compact JSON value of any depth, in order; nulls and booleans are passed over."""
    tokens = F.filter(F.regexp_extract_all(json, F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin("true", "false", "null") & ~t.endswith('":'))
    plain = lambda t: F.when(t.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"]).otherwise(t)
    return F.coalesce(F.transform(tokens, plain), F.array().cast("array<string>"))


def field_values(fields: Column, name: str) -> Column:
    """The searchable texts of a canonical field of ``fields`` (map of JSON texts): of its preferred key, of a contract's title and reference, or all."""
    value = fields[name]
    inner = F.try_parse_json(value).try_cast("map<string,variant>")
    every = _scalars(value)
    if name == "contract":
        of = lambda k: _scalars(F.to_json(inner[k]))
        special = F.when(value.startswith("{"), F.concat(of("title"), of("reference_identifier")))
    elif name in PREFERRED:
        special = F.coalesce(*[F.when(value.startswith("{") & F.map_contains_key(inner, key), _scalars(F.to_json(inner[key]))) for key in PREFERRED[name]])
    else:
        special = F.lit(None).cast("array<string>")
    return F.coalesce(special, every, F.array().cast("array<string>"))


def build_canonical_projection(docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """One search row for each document; nothing that is not approved becomes searchable.

    ``docs``: doc_id, title, document_type, life_area, document_date, canonical_metadata (JSON object), canonical_extraction_id;
    ``extractions``: extraction_id, text, pages, content_hash. A document without a canonical text has an empty body. Equal
    lines are kept once, in order; the hash covers all that is searched.
    """
    e = extractions.select("extraction_id", F.col("text").alias("body_text"), "pages", F.col("content_hash").alias("extraction_content_hash"))
    d = docs.join(e, F.col("canonical_extraction_id") == F.col("extraction_id"), "left")
    meta = F.transform_values(F.coalesce(F.try_parse_json("canonical_metadata").try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, v: F.to_json(v))
    d = d.withColumn("_fields", meta)
    fields = F.col("_fields")
    lines = lambda values: F.array_join(F.array_distinct(F.filter(values, lambda x: x != "")), "\n")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    metadata = F.concat(F.array(text("document_type"), text("life_area"), text("document_date")), *[field_values(fields, name) for name in sorted(METADATA_FIELDS)])
    rows = d.select(
        "doc_id",
        text("title").alias("title_text"),
        lines(field_values(fields, "organization")).alias("organization_text"),
        lines(field_values(fields, "identifier")).alias("identifier_text"),
        lines(metadata).alias("metadata_text"),
        lines(field_values(fields, "tags")).alias("tags_text"),
        T.canonical_amount(F.col("canonical_metadata")).alias("amount_value"),
        text("body_text").alias("body_text"),
        F.coalesce("pages", F.array().cast("array<string>")).alias("pages"),
        "extraction_id",
        "extraction_content_hash",
        "document_type",
        "life_area",
        "document_date",
    )
    hashed = T.content_hash(*[F.col(c).cast("string") for c in ("title_text", "organization_text", "identifier_text", "metadata_text", "tags_text", "amount_value", "body_text", "extraction_id", "extraction_content_hash")], F.to_json("pages"))
    return rows.withColumn("content_hash", hashed)
