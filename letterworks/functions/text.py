"""Scalar functions on text, dates and money, all as column expressions.

Only Unicode compatibility normalization and the sequence-similarity ratio have
no built-in form; they are Python functions behind a guard or on pairs only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from letterworks.functions.blocks import ratio
from letterworks.functions.spans import let

#: The fields that may hold a document's amount, by priority.
AMOUNT_FIELDS = (
    "invoice_total",
    "total_rent",
    "account_balance",
    "contract_amount",
    "valuation",
    "premium",
    "refund",
    "monthly_rent",
    "monthly_contribution",
    "retirement_assets",
    "cancellation_value",
    "amount",
    "other_amount",
)
#: Fixed value: the pattern of a search term.
TERM = r"(?U)[\wÄÖÜäöüß]+(?:[-./][\wÄÖÜäöüß]+)*"
#: The identifier kinds strong enough to identify an organization.
STRONG_KINDS = ("company_number", "registration_number", "tax_id", "vat_id")
#: Characters that compatibility normalization leaves alone.
PLAIN = r"^[\x00-\x7FÀ-ſ€–„“‚‘’”…§]*$"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.udf(DoubleType(), useArrow=False)  # pairs of whole texts: a hundred at a time, where Arrow would hold ten thousand
def _ratio(a: str | None, b: str | None) -> float:
    return ratio(a or "", b or "")


def nfkc(c: Column) -> Column:
    """Compatibility normalization; only texts that can change go through Python."""
    return F.when(c.rlike(PLAIN), c).otherwise(_nfkc(F.when(~c.rlike(PLAIN), c)))


def similarity_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts; for pairs, not for joins."""
    return F.when(a == b, 1.0).otherwise(_ratio(a, b))


def tidy_lines(c: Column) -> Column:
    """LF line ends, no blanks at line ends, at most one empty line in a row, no blanks around."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\x0b\f]+(?=\n|$)", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def normalize_text(c: Column) -> Column:
    return tidy_lines(nfkc(c))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_query(c: Column) -> Column:
    return collapse(nfkc(c))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def query_terms(c: Column) -> Column:
    """The terms of a query in order, each once whatever its case, in the case of its first use."""
    found = F.regexp_extract_all(c, F.lit(TERM), F.lit(0))
    folded = F.transform(found, casefold)
    return F.filter(found, lambda x, i: F.array_position(folded, casefold(x)) == i + 1)


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(c), r"(?U)[^\wäöüß]+", " "))


def normalize_identifier(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def strong_identifier(c: Column) -> Column:
    """Upper-case letters and digits only; null under five of them."""
    plain = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(F.length(plain) >= 5, plain)


def strong_identifiers(payload: Column) -> Column:
    """``kind:value`` of a JSON payload's strong identifiers, also from a nested ``strong_identifiers``."""
    values = [
        F.concat(F.lit(f"{kind}:"), strong_identifier(F.get_json_object(payload, f"$.{path}{kind}")))
        for path in ("", "strong_identifiers.")
        for kind in STRONG_KINDS
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*values))))


def parse_german_date(c: Column) -> Column:
    """``d.m.yyyy``; null for what is no date."""
    return F.try_to_timestamp(c, F.lit("d.M.yyyy")).cast("date")


def parse_iso_prefix(c: Column) -> Column:
    return F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def parse_german_amount(c: Column) -> Column:
    plain = F.regexp_replace(c, r"(?i)EUR|€|\s", "")
    return F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


def amount_of(c: Column) -> Column:
    """The first number of a text in German or plain notation."""
    plain = F.regexp_replace(c, r"EUR|€| ", "")
    plain = F.when(plain.contains(","), F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(plain)
    return F.regexp_substr(plain, F.lit(r"-?\d+(?:[.]\d+)?")).try_cast("decimal(18,2)")


def canonical_amount(meta: Column) -> Column:
    """The first readable amount of a JSON object of fields, as an object's ``amount`` or as a scalar."""
    values = []
    for field in AMOUNT_FIELDS:
        whole = F.get_json_object(meta, f"$.{field}")
        values.append(amount_of(F.when(whole.startswith("{"), F.get_json_object(meta, f"$.{field}.amount")).otherwise(whole)))
    return F.coalesce(*values)


def flatten_scalars(json: Column, schema: str, depth: int = 3) -> Column:
    """The scalar leaves of JSON of at most this depth, in order; booleans and nulls are passed over."""
    leaf = lambda x: F.filter(F.array(x), lambda v: v.isNotNull() & ~v.isin("true", "false"))

    def walk(x: Column, left: int) -> Column:
        if left == 0:
            return leaf(x)
        inner = F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.startswith("{"), F.map_values(F.from_json(x, "map<string,string>")))
        # Bound, so that a value is parsed once and not again for the test.
        return let(inner, lambda y: F.when(y.isNotNull(), F.flatten(F.transform(y, lambda v: walk(v, left - 1)))).otherwise(leaf(x)))

    return let(json, lambda j: walk(j, depth))


def field_values(meta: Column, field: str) -> Column:
    """The searchable values of a canonical field: a preferred key of an object, else all scalars."""
    preferred = {"organization": ("name", "value"), "identifier": ("normalized", "value", "source")}.get(field, ())
    if field == "contract":
        return F.array_compact(F.array(F.get_json_object(meta, "$.contract.title"), F.get_json_object(meta, "$.contract.reference_identifier")))
    whole = F.get_json_object(meta, f"$.{field}")
    keyed = F.coalesce(*[F.get_json_object(meta, f"$.{field}.{k}") for k in preferred], whole) if preferred else whole
    return flatten_scalars(keyed, "string")


def content_hash(*columns: Column) -> Column:
    """SHA-256 of columns as JSON with sorted keys, whatever their order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def page_for_offset(pages: Column, offset: Column, gap: int = 2) -> Column:
    """The 1-based page of a code-point offset when pages are joined by ``gap`` characters; 1 if beyond."""
    ends = F.transform(pages, lambda p, i: F.aggregate(F.slice(pages, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + i * gap)
    return F.coalesce(F.get(F.filter(F.transform(ends, lambda e, i: F.when(offset <= e, i + 1)), lambda x: x.isNotNull()), F.lit(0)), F.lit(1))


def char_trigrams(c: Column) -> Column:
    """Distinct three-character runs of the words of a text, sorted; words are runs of 0-9, a-z and German letters."""
    return F.sort_array(F.array_distinct(trigram_runs(c)))


def trigram_runs(c: Column) -> Column:
    """As ``char_trigrams``, in order of the text and as often as they occur."""
    return F.regexp_extract_all(casefold(c), F.lit("(?=([0-9a-zäöüß]{3}))"), F.lit(1))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = char_trigrams(a), char_trigrams(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def text_usability(pages: Column, min_chars: int = 40) -> Column:
    """Struct of characters without blanks, empty and useful pages, whether OCR is required, and why."""
    counts = F.transform(pages, lambda p: F.length(F.regexp_replace(p, r"\s", "")))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    useful = F.size(F.filter(counts, lambda x: x >= min_chars))
    empty = F.when(F.size(pages) == 0, 1).otherwise(F.size(F.filter(counts, lambda x: x < 10)))
    n = F.greatest(F.size(pages), F.lit(1))
    required = (total < min_chars * n) | (useful < n)
    reason = F.when(required, F.concat((n - useful).cast("string"), F.lit("_of_"), n.cast("string"), F.lit("_pages_without_usable_text"))).otherwise("embedded_text_sufficient")
    return F.struct(total.alias("total"), empty.alias("empty"), useful.alias("useful"), required.alias("required"), reason.alias("reason"))


def redact(field: Column, value: Column) -> Column:
    """``content`` becomes its length and hash; other long values a preview of 500 characters."""
    hidden = F.concat(F.lit("length="), F.length(value), F.lit(" sha256="), F.sha2(value, 256))
    return F.when(field == "content", hidden).when(F.length(value) > 500, F.substring(value, 1, 500)).otherwise(value)


def json_type(value: Column) -> Column:
    """The JSON type name of a JSON text."""
    return (
        F.when(value.isNull() | (value == "null"), "null")
        .when(value.isin("true", "false"), "boolean")
        .when(value.startswith("{"), "object")
        .when(value.startswith("["), "array")
        .when(value.startswith('"'), "string")
        .when(value.rlike(r"^-?\d+$"), "integer")
        .otherwise("number")
    )


def sanitize_map(m: Column) -> Column:
    """Drops the entries whose key speaks of a secret, token, password or text."""
    return F.map_filter(m, lambda k, v: ~F.lower(k).rlike("secret|token|password|text"))


def confidence(base: Column, ocr: Column, ambiguous: Column, critical: bool = True) -> Column:
    """Base less 0.12 for competing values and for critical values read by OCR; 0.2 at least."""
    value = base - F.when(ambiguous, 0.12).otherwise(0.0) - (F.when(ocr, 0.12).otherwise(0.0) if critical else 0.0)
    return F.greatest(F.lit(0.2), F.round(value, 2))


def confidence_notes(ocr: Column, ambiguous: Column, critical: bool = True) -> Column:
    notes = [F.when(ambiguous, F.lit("competing_candidates"))]
    if critical:
        notes.append(F.when(ocr, F.lit("ocr_sensitive_value")))
    return F.array_compact(F.array(*notes))


