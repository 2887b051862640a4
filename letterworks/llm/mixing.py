"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. The rates nearest to one document each
(in relative entropy, none above two copies) that meet a source's target are
``min(2, exp(lambda * size / mean size))``; the multipliers are found by Newton
steps on the convex dual. Every step is one distributed sum over a histogram of
document sizes; sources are independent, so the Hessian is diagonal. Rates become
whole copies by carrying the rounding error from long to short documents inside
bins of bounded size, so a large source is spread over many tasks.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; documents without words are taken as 0 words; a source without
words has target 0; repeated rows are documents of their own, and those of equal id
and size may be taken in any order; texts of any length count whole; other columns of
the table, whatever their names, are not read; an empty table gives an empty result.
Reruns give the same rows. A source whose multiplier is not found raises an error
instead of missing its target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.llm.columns import n_words
from letterworks.session import prepare, stage, table

#: Weights of the sources in order, repeating; total words as a share of all; most copies of a document.
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_COPIES = 2
#: Newton steps before the bracket of a source is only halved, and steps in all (halving to the last digit takes 60).
STEPS, MOST_STEPS = 30, 100
TOLERANCE = 1e-6
#: Documents in a rounding bin on average.
BIN_DOCS = 2000


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, most: float = MAX_COPIES) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    caps = most * sizes.astype(float)
    target = np.zeros(len(sizes))
    free = caps > 0
    left = min(float(total), float(caps.sum()))
    while free.any() and left > 0:
        level = left / weights[free].sum()
        over = free & (weights * level >= caps)
        if not over.any():
            target[free] = weights[free] * level
            break
        target[over] = caps[over]
        left -= caps[over].sum()
        free &= ~over
    return target


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE) -> DataFrame:
    """source, n_docs, source_size, target. One row for each source is sorted and filled; the rows of documents are not."""
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rows = totals.toPandas()
    # Code point order of valid UTF-8 is the order of its bytes.
    order = sorted(range(len(rows)), key=lambda i: (rows.source[i] is None, (rows.source[i] or "").encode()))
    rows = rows.iloc[order].reset_index(drop=True)
    by = np.array([weights[i % len(weights)] for i in range(len(rows))])
    n = rows.source_size.to_numpy(dtype=float) if len(rows) else np.zeros(0)
    rows["target"] = water_fill(n, by, share * n.sum())
    schema = "source string, n_docs long, source_size long, target double"
    data = [(None if s is None else s, int(a), int(b), float(t)) for s, a, b, t in rows.itertuples(index=False)]
    return sizes.sparkSession.createDataFrame(data, schema)


def balance(histogram: DataFrame, targets: DataFrame, steps: int = STEPS, most_steps: int = MOST_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``targets`` plus the multiplier of each source, by Newton steps safeguarded by a bracket.

    ``histogram``: source, x (size over the source's mean size), size, n. At a
    multiplier ``m`` a source takes ``sum n * size * min(2, exp(m * x))``, which
    grows with ``m``; a step that leaves the bracket is replaced by its middle, and
    after ``steps`` all are.
    Each step's sums come from one aggregation; the driver holds a row for each
    source.
    """
    spark = histogram.sparkSession
    state = {r.source: {"t": r.target, "m": 0.0, "lo": -60.0, "hi": 60.0, "cap": MAX_COPIES * r.source_size} for r in targets.collect()}
    open_ = {s for s, v in state.items() if 0 < v["t"] < v["cap"] * (1 - 1e-12)}
    for s, v in state.items():
        if s not in open_:
            v["m"] = None if v["t"] > 0 else -np.inf
    for turn in range(most_steps):
        if not open_:
            break
        at = spark.createDataFrame([(s, state[s]["m"]) for s in open_], "s string, m double")
        rate = F.exp(F.least(F.col("m") * F.col("x"), F.lit(1.0)))
        clipped = rate >= MAX_COPIES
        sums = (
            histogram.join(F.broadcast(at) if len(open_) <= 10_000 else at, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(
                F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(float(MAX_COPIES)))).alias("took"),
                F.sum(F.when(clipped, 0.0).otherwise(F.col("n") * F.col("size") * F.col("x") * rate)).alias("slope"),
            )
        )
        for r in sums.collect():
            v = state[r.s]
            gap = r.took - v["t"]
            if abs(gap) <= tolerance * v["t"]:
                open_.discard(r.s)
                continue
            v["hi" if gap > 0 else "lo"] = v["m"]
            step = v["m"] - gap / r.slope if r.slope > 0 and turn < steps else np.inf
            v["m"] = step if v["lo"] < step < v["hi"] else (v["lo"] + v["hi"]) / 2
            if v["m"] in (v["lo"], v["hi"]):  # the bracket has no number inside: this is the multiplier
                open_.discard(r.s)
    if open_:
        raise ArithmeticError(f"no multiplier found for {len(open_)} sources after {most_steps} steps")
    found = [(s, v["m"]) for s, v in state.items()]
    found = spark.createDataFrame(found, "s string, multiplier double")
    return targets.join(found, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def round_copies(sizes: np.ndarray, rates: np.ndarray, most: int = MAX_COPIES) -> np.ndarray:
    """Whole copies, each rate rounded up or down so that the words owed so far stay nearest to zero."""
    copies = np.zeros(len(sizes), np.int64)
    owed = 0.0
    for i, (size, rate) in enumerate(zip(sizes.tolist(), rates.tolist(), strict=True)):
        low = int(rate)
        owed += (rate - low) * size
        more = rate > low and low < most and owed >= size / 2
        copies[i] = low + more
        owed -= size * more
    while True:  # what is still owed goes to the documents nearest to it in size; it shrinks with each turn
        sign = 1 if owed > 0 else -1
        free = (copies < most) if sign > 0 else (copies > 0)
        left = np.where(free & (sizes > 0), np.abs(abs(owed) - sizes), np.inf)
        if not len(left) or left.min() >= abs(owed):
            return copies
        i = int(left.argmin())
        copies[i] += sign
        owed -= sign * sizes[i]


def _round_bin(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "row_key"], ascending=[False, True], kind="stable")
    rows["copies"] = round_copies(rows["size"].to_numpy(), rows["rate"].to_numpy())
    return rows[["doc_id", "size", "source_size", "target", "rate", "copies"]]


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken for every document."""
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    row_key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "size")
    sizes = stage(sizes.withColumns({"row_key": row_key, "place": F.monotonically_increasing_id()}), "mix-sizes")
    targets = stage(source_targets(sizes), "mix-targets")
    t = targets.select(F.col("source").alias("s"), "n_docs", "source_size", "target")
    histogram = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("size") > 0)
    histogram = histogram.join(t, F.col("source").eqNullSafe(F.col("s")))
    mean = F.col("source_size") / F.col("n_docs")
    histogram = stage(histogram.select("source", "size", "n", (F.col("size") / mean).alias("x")), "mix-histogram")
    solved = balance(histogram, targets).withColumnRenamed("source", "s")
    m = F.col("multiplier")
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    rate = (
        F.when((F.col("size") == 0) | (m == float("-inf")), 0.0)
        .when(m.isNull(), float(MAX_COPIES))
        .otherwise(F.least(F.exp(F.least(m * x, F.lit(1.0))), F.lit(float(MAX_COPIES))))
    )
    bins = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BIN_DOCS)).cast("int")
    rated = sizes.join(solved, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate)
    # Bins are drawn by id and size. Rows that repeat both oftener than a bin holds are alike, so any order spreads them.
    often = stage(sizes.groupBy("row_key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BIN_DOCS), "mix-often")
    spread = F.when(F.col("rows").isNull(), F.col("row_key")).otherwise(F.col("place"))
    rated = rated.join(often, "row_key", "left").withColumn("bin", F.pmod(spread, bins))
    schema = "doc_id long, size long, source_size long, target double, rate double, copies long"
    rounded = rated.select("s", "bin", "doc_id", "size", "source_size", "target", "rate", "row_key").groupBy("s", "bin").applyInPandas(_round_bin, schema)
    return rounded.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
