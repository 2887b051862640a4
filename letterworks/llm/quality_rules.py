"""Quality rules with verdicts on hosts.

Each text is measured in its own row and held against four rules: too few words,
too many repeated words (these two are the base), too many symbols for its words,
and too many repeated lines for its words. Failures of each rule are summed by host
and each host's failure rates are shrunk towards an empirical beta prior of the rule
(moments of the rates over hosts; worth ``MAX_PRIOR`` documents at most, so that what
a host has shown always counts). The host's verdicts are joined back to its documents:

* a host whose shrunk rate of base failures is over ``MAX_RATE`` loses all documents;
* a document that fails the rule of symbols or of lines is in doubt: it is kept only
  if its host's shrunk rate for that rule is not over ``DOUBT`` times the corpus rate.

A document is kept if it passes the base rules and its host's verdicts; one that
fails no rule goes only with its whole host.

Defined results: a null text has no words and fails; a null host is a host of its
own; repeated rows are measured and counted each; ties of a rate with its bound are
kept; texts of any length are measured whole; columns of the table that are called
like a measure give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.llm.columns import let, whole, words
from letterworks.session import prepare, stage, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A text is in doubt above these: symbols for a hundred words, repeated lines for a hundred words.
MAX_SYMBOL_PERCENT = 10
MAX_LINE_PERCENT = 5
#: A host goes if more than this share of its documents is expected to fail.
MAX_RATE = 0.8
#: A host does not vouch for doubtful documents above this many times the corpus rate.
DOUBT = 1.25
#: Documents that the prior weighs, at least and at most.
MIN_PRIOR, MAX_PRIOR = 2.0, 100.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RULES = ("base", "symbols", "lines")


def repeated_words(w: Column) -> Column:
    """How many words lie in runs of three words that the text has twice or more."""
    runs = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def same(s: Column, i: Column, x: Column) -> Column:
        return F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            places,
            start,
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    return let(runs, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted(h)))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (but those called like a measure) plus ``MEASURES``."""
    text = whole(F.col(text_col))
    measured = let(
        words(F.col(text_col)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = F.struct(
        measured.alias("m"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = docs.select(F.struct(*docs.columns).alias("_row"), found.alias("_found"))
    n, repeat = F.col("_found.m.n_words"), F.col("_found.m.n_repeat_words")
    failed = (n < MIN_WORDS) | (F.lit(100) * repeat > F.lit(MAX_REPEAT_PERCENT) * n)
    return out.select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c not in MEASURES],
        n.alias("n_words"),
        F.col("_found.m.word_chars").alias("word_chars"),
        F.col("_found.n_symbols").alias("n_symbols"),
        F.col("_found.n_dup_lines").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
    )


def failures() -> dict[str, Column]:
    """Whether a measured row fails each of ``RULES``."""
    return {
        "base": F.col("base_failed"),
        "symbols": F.lit(100) * F.col("n_symbols") > F.lit(MAX_SYMBOL_PERCENT) * F.col("n_words"),
        "lines": F.lit(100) * F.col("n_dup_lines") > F.lit(MAX_LINE_PERCENT) * F.col("n_words"),
    }


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and weight of the failure rates over hosts for each rule, by the method of moments; one row reaches the driver."""
    n = F.col("n_docs")
    row = hosts.agg(
        F.sum("n_docs").alias("n"),
        F.avg(1 / n).alias("inverse"),
        *[F.sum(f"n_{r}").alias(f"f_{r}") for r in RULES],
        *[F.var_pop(F.col(f"n_{r}") / n).alias(f"v_{r}") for r in RULES],
    ).first()
    if not row.n:
        return {r: (0.5, MIN_PRIOR) for r in RULES}
    out = {}
    for r in RULES:
        mean = row[f"f_{r}"] / row.n
        noise = mean * (1 - mean)
        between = row[f"v_{r}"] - noise * row.inverse  # what the rates vary beyond chance
        size = noise / between - 1 if between * MAX_PRIOR > noise else MAX_PRIOR
        out[r] = mean, min(max(size, MIN_PRIOR), MAX_PRIOR)
    return out


def host_verdicts(measured: DataFrame, host_col: str, max_rate: float = MAX_RATE) -> DataFrame:
    """host, n_docs, and for each rule n_ (failures), rate_ (shrunk) and ok_ (the verdict)."""
    sums = [F.sum(failed.cast("long")).alias(f"n_{r}") for r, failed in failures().items()]
    hosts = stage(measured.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *sums), "host-failures")
    out = hosts
    for r, (mean, size) in beta_priors(hosts).items():
        rate = (F.col(f"n_{r}") + mean * size) / (F.col("n_docs") + size)
        bound = max_rate if r == "base" else DOUBT * mean
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"ok_{r}", rate <= bound)
    return out


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_cols``, ``host_col``, the measures, ``host_rate`` (of base failures) and ``kept`` for every row.

    Texts are read once and not shuffled. A row for each host is written and joined back to the measures; Spark
    broadcasts it if it is small and else splits a large host's rows.
    """
    rest = [c for c in dict.fromkeys((*keep_cols, host_col)) if c not in (*MEASURES, "host_rate", "kept")]
    row = F.struct(*[F.col(c) for c in rest], F.lit(0).alias("_")).alias("_row")
    measured = measure(docs.select(row, F.col(host_col).alias("_host"), F.col(text_col).alias("_text")), "_text")
    measured = stage(measured.select("_row", "_host", *MEASURES), "quality-measures")
    hosts = stage(host_verdicts(measured, "_host"), "host-verdicts")
    hosts = hosts.select("host", F.col("rate_base").alias("host_rate"), *[f"ok_{r}" for r in RULES])
    joined = measured.join(hosts, F.col("_host").eqNullSafe(F.col("host")))
    fails = failures()
    doubted = F.lit(False)
    for r in RULES[1:]:
        doubted |= fails[r] & ~F.col(f"ok_{r}")
    kept = ~F.col("base_failed") & F.col("ok_base") & ~doubted
    return joined.select(*[F.col("_row")[c].alias(c) for c in rest], *MEASURES, "host_rate", kept.alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
words AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
runs AS (SELECT rid, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM runs WHERE z IS NOT NULL),
covered AS (SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS at FROM twice WHERE n > 1),
repeats AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid),
lines AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dups AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
      FROM w LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 5 * n_words AS lines FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE base_failed) AS fb,
        count(*) FILTER (WHERE symbols) AS fs, count(*) FILTER (WHERE lines) AS fl FROM f GROUP BY source),
p AS (SELECT avg(1 / n) AS inverse, sum(fb) / sum(n) AS mb, var_pop(fb / n) AS vb,
        sum(fs) / sum(n) AS ms, var_pop(fs / n) AS vs, sum(fl) / sum(n) AS ml, var_pop(fl / n) AS vl FROM h),
q AS (SELECT mb, ms, ml,
        CASE WHEN (vb - mb * (1 - mb) * inverse) * 100 > mb * (1 - mb) THEN least(greatest(mb * (1 - mb) / (vb - mb * (1 - mb) * inverse) - 1, 2), 100) ELSE 100 END AS zb,
        CASE WHEN (vs - ms * (1 - ms) * inverse) * 100 > ms * (1 - ms) THEN least(greatest(ms * (1 - ms) / (vs - ms * (1 - ms) * inverse) - 1, 2), 100) ELSE 100 END AS zs,
        CASE WHEN (vl - ml * (1 - ml) * inverse) * 100 > ml * (1 - ml) THEN least(greatest(ml * (1 - ml) / (vl - ml * (1 - ml) * inverse) - 1, 2), 100) ELSE 100 END AS zl FROM p),
v AS (SELECT source, (fb + mb * zb) / (n + zb) <= 0.8 AS ok_base, (fs + ms * zs) / (n + zs) <= 1.25 * ms AS ok_symbols,
        (fl + ml * zl) / (n + zl) <= 1.25 * ml AS ok_lines FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND ok_base AND NOT (symbols AND NOT ok_symbols) AND NOT (lines AND NOT ok_lines) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
