"""Declared constraints of tables, compiled to one pass that parts valid rows from a quarantine.

A ``Table`` names the type of each column and what must hold: required columns, closed
vocabularies, ranges, lengths, unique keys, references to other tables. ``load`` casts a
table of any column types, and gives the valid rows as typed and the others with all
reasons. ``set_aside`` does the same for runs of an extraction: one bad finding takes its
document's whole run out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.operators import extract as X
from letterworks.session import stage

#: The fields that each section of an extraction's result may hold.
SECTION_FIELDS = {
    "type": ("document_type",),
    "area": ("life_area",),
    "title": ("title",),
    "organization": ("organization",),
    "date": (
        "document_date", "invoice_date", "due_date", "payment_due_date", "effective_date", "other_date", "valuation_date", "contract_start", "contract_end", "cancellation_deadline",
        "renewal_date", "statement_period_start", "statement_period_end", "planned_retirement_start", "retirement_start", "event_date",
    ),
    "amount": (
        "amount", "invoice_total", "monthly_rent", "service_charges", "parking_fee", "total_rent", "deposit", "contract_amount", "account_balance", "valuation", "premium", "refund",
        "other_amount", "monthly_contribution", "retirement_assets", "cancellation_value",
    ),
    "identifier": ("identifier",),
    "fact": ("product_name", "rental_property_address", "tenant_name", "landlord_name"),
}
#: Sections of one finding at most, the longest value, and the areas of life.
SINGLE = ("type", "area", "title")
LONGEST = 500
LIFE_AREAS = (*dict.fromkeys(X.AREA_OF_TYPE.values()), "other")


@dataclass(frozen=True)
class Table:
    """Column types and constraints of one table."""

    columns: dict[str, str]
    required: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[float | str | None, float | str | None]] = field(default_factory=dict)
    lengths: dict[str, tuple[int, int]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    #: column -> (table, its column); a null refers to nothing.
    references: dict[str, tuple[str, str]] = field(default_factory=dict)

    def problems(self) -> list[Column]:
        """The reasons that a row (with ``_raw``, the columns as they came, and the typed ones) fails by itself; null where it does not."""
        say = lambda name, c: F.lit(f"{name}:{c}")
        out = [F.when(F.col("_raw")[c].isNotNull() & F.col(c).isNull(), say("type", c)) for c in self.columns]
        out += [F.when(F.col("_raw")[c].isNull(), say("missing", c)) for c in self.required]
        out += [F.when(~F.col(c).isin(*words), say("enum", c)) for c, words in self.enums.items()]
        for c, (low, high) in self.ranges.items():
            below = F.lit(False) if low is None else F.col(c) < F.lit(low).cast(self.columns[c])
            above = F.lit(False) if high is None else F.col(c) > F.lit(high).cast(self.columns[c])
            out.append(F.when(below | above, say("range", c)))
        out += [F.when(~F.length(c).between(*bounds), say("length", c)) for c, bounds in self.lengths.items()]
        return out


def load(df: DataFrame, spec: Table, others: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The valid rows of ``df``, typed, and the others as they came (texts) with ``problems``.

    Columns that are missing are null; columns that are not declared are left out. Keys and references are compared as
    typed; ``others`` are the tables referred to. A key with a null is not compared. The checked rows are written once.
    """
    have = set(df.columns)
    text = lambda c: F.col(c).cast("string") if "[" not in (k := dict(df.dtypes)[c]) and not k.startswith(("array", "map", "struct")) else F.to_json(c)
    raw = F.struct(*[(text(c) if c in have else F.lit(None).cast("string")).alias(c) for c in spec.columns])
    cell = lambda c, kind: (F.col(c).cast(kind) if dict(df.dtypes)[c] == kind else F.col(c).try_cast(kind)) if c in have else F.lit(None).cast(kind)
    rows = df.select(raw.alias("_raw"), *[cell(c, kind).alias(c) for c, kind in spec.columns.items()])
    rows = rows.withColumn("problems", F.array_compact(F.array(*spec.problems())))
    rows = checked = stage(rows, "checked-rows")
    for keys in spec.unique:
        repeated = rows.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        repeated = stage(repeated.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_again")), "repeated-keys")
        rows = rows.join(repeated, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]), "left")
        rows = _with(rows, F.col("_again"), f"unique:{'+'.join(keys)}").drop("_again", *[f"_k{i}" for i in range(len(keys))])
    for c, (name, key) in spec.references.items():
        there = others[name].select(F.col(key).cast(spec.columns[c]).alias("_key"))
        # Keys alone look for their match; whole rows meet only the keys without one, mostly a small side.
        keys = checked.select(F.col(c).alias("_lost")).where("_lost is not null").distinct()
        lost = stage(keys.join(there, F.col("_lost") == F.col("_key"), "left_anti"), "lost-keys")
        rows = rows.join(lost, F.col(c) == F.col("_lost"), "left")
        rows = _with(rows, F.col("_lost").isNotNull(), f"reference:{c}").drop("_lost")
    # Texts as they came are kept of rejected rows only.
    rows = rows.withColumn("_raw", F.when(F.size("problems") > 0, F.col("_raw")))
    rows = stage(rows, "judged-rows")
    return rows.where("size(problems) = 0").select(*spec.columns), rows.where("size(problems) > 0").select("_raw.*", "problems")


def _with(rows: DataFrame, test: Column, reason: str) -> DataFrame:
    return rows.withColumn("problems", F.when(F.coalesce(test, F.lit(False)), F.concat("problems", F.array(F.lit(reason)))).otherwise(F.col("problems")))


def load_all(spark: SparkSession, tables: dict[str, DataFrame], specs: dict[str, Table]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Every table that has a spec: valid rows by name, and rejected ones. References look at the tables as they came."""
    done = {name: load(tables[name], spec, tables) for name, spec in specs.items()}
    return {k: v[0] for k, v in done.items()}, {k: v[1] for k, v in done.items()}


def rejection_report(rejected: dict[str, DataFrame]) -> DataFrame:
    """(table, problem, n) of all quarantines; a row with two problems counts for both."""
    parts = [df.select(F.lit(name).alias("table"), F.explode("problems").alias("problem")) for name, df in rejected.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("table", "problem").agg(F.count(F.lit(1)).alias("n"))


def finding_problems(text: Column) -> Column:
    """The reasons that a finding (kind, field, value, normalized, confidence, start, end, span) does not hold for its document's text."""
    fields = F.create_map(*[x for k, v in SECTION_FIELDS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    allowed = fields[F.col("kind")]
    outside = lambda c: F.coalesce(~F.length(c).between(1, LONGEST), F.lit(True))
    exact = (F.col("start") >= 0) & (F.col("end") <= F.length(text)) & (F.col("end") > F.col("start")) & (F.substring(text, F.col("start") + 1, F.col("end") - F.col("start")) == F.col("span"))
    tests = {
        "unknown_section": allowed.isNull(),
        "wrong_section": allowed.isNotNull() & ~F.coalesce(F.array_contains(allowed, F.col("field")), F.lit(False)),
        "value_length": outside("value") | outside("normalized"),
        "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "unknown_document_type": (F.col("kind") == "type") & ~F.col("normalized").isin(*X.AREA_OF_TYPE),
        "unknown_life_area": (F.col("kind") == "area") & ~F.col("normalized").isin(*LIFE_AREAS),
        "evidence_length": outside("span"),
        "evidence": ~F.coalesce(exact, F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def set_aside(found: DataFrame, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The findings of sound runs, and (doc_id, n_findings, reasons) of the runs that are set aside.

    ``found``: doc_id, kind, field, value, normalized, confidence, start, end, span. A run is all findings of a document; any
    finding that does not hold, a second one in a section of one, or a document that is not there, takes it out whole.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = found.join(texts, F.col(id_col) == F.col("_id"), "left")
    rows = stage(rows.withColumn("_why", F.when(F.col("_id").isNull(), F.array(F.lit("no_document"))).otherwise(finding_problems(F.col("_text")))).drop("_text", "_id"), "checked-findings")
    more = F.greatest(*[F.count(F.when(F.col("kind") == k, 1)) for k in SINGLE]) > 1
    # At most as many different reasons as there are tests.
    runs = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_findings"), F.array_distinct(F.flatten(F.collect_set("_why"))).alias("_whys"), more.alias("_more"))
    reasons = F.array_sort(F.concat("_whys", F.when(F.col("_more"), F.array(F.lit("repeated_section"))).otherwise(F.array().cast("array<string>"))))
    bad = stage(runs.select(id_col, "n_findings", reasons.alias("reasons")).where("size(reasons) > 0"), "runs-aside")
    return rows.drop("_why").join(bad.select(id_col), id_col, "left_anti"), bad
