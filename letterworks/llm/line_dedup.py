"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` keeps counts of line keys in sorted runs on levels. A new batch is
joined once with the keys of all runs: what they do not hold (the anti-join) becomes
a new run on level 0, so a key is in one run only; what they hold is kept beside the
runs as increments of those keys. When a level has ``fanout`` runs they are merged,
with the increments so far, into one run of the next level; keys that reach the
threshold are written to the frequent run and count as held from then on. Runs hold
16-byte keys and counts, never lines.

Defined results: a null or empty text has one empty line; empty keys are never
dropped; rows count as documents, whether or not their ids repeat; a key in exactly
``min_docs`` documents is dropped; a text all of whose lines go becomes empty; a text
of any length is one row with all its lines; columns of the table called
``kept_text``, ``n_lines`` or ``n_dropped`` give way to the results, all others are
returned whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.llm.columns import BLANK_CHARS, ascii_lower, let, text_key, whole
from letterworks.session import prepare, stage, table

MIN_DOCS = 10
N_BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANK_CHARS)))


def keyed_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each line with a key: text_key, pos, key (16 bytes), first (no earlier line of the row has the key)."""
    lines = F.split(whole(F.col(text_col)), "\n", -1)
    keyed = F.filter(F.transform(lines, lambda x, i: F.struct(line_key(x).alias("k"), i.alias("pos"))), lambda x: x["k"] != "")
    hashed = F.sort_array(F.transform(keyed, lambda x: F.struct(F.unhex(F.md5(x["k"])).alias("key"), x["pos"].alias("pos"))))
    marked = let(
        hashed,
        lambda s: F.transform(
            s,
            lambda x, i: F.struct(x["key"].alias("key"), x["pos"].alias("pos"), (~F.coalesce(F.get(s, i - 1)["key"] == x["key"], F.lit(False))).alias("first")),
        ),
    )
    return docs.select(text_key(F.col(text_col)).alias("text_key"), marked.alias("lines")).select("text_key", F.inline("lines"))


class LineRuns:
    """Levelled sorted runs of (key, n_docs); see the module's text."""

    def __init__(self, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self._frequent: list[DataFrame] = []
        self._increments: list[DataFrame] = []

    def _held(self) -> list[DataFrame]:
        """The keys of all runs, each in one of them."""
        return [run.select("key") for level in self.levels for run in level] + self._frequent

    def add(self, lines: DataFrame) -> None:
        """Count a batch of keyed lines; keys that no run holds become a run."""
        run = lines.groupBy("key").agg(F.sum(F.col("first").cast("long")).alias("n_docs"))
        held = self._held()
        if not held:
            self._push(0, self._store(run))
            return
        known = reduce(DataFrame.unionByName, held).withColumn("held", F.lit(True))
        marked = self._store(run.join(known, "key", "left"))
        self._increments.append(marked.where("held").select("key", "n_docs"))
        self._push(0, marked.where("held is null").select("key", "n_docs"))

    def _store(self, run: DataFrame) -> DataFrame:
        return stage(run.sortWithinPartitions("key"), "line-run")

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._merged(runs))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Merge runs and the increments of their keys; keys at the threshold go to the frequent run, the others are returned as a run."""
        added, self._increments = self._increments, []
        parts = [r.withColumn("own", F.lit(True)) for r in runs] + [x.withColumn("own", F.lit(False)) for x in added]
        sums = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("own").alias("own"))
        sums = self._store(sums)
        if added and any(self.levels):
            self._increments = [sums.where("not own").select("key", "n_docs")]  # of keys in other runs
        self._frequent.append(sums.where(F.col("own") & (F.col("n_docs") >= self.min_docs)).select("key"))
        return sums.where(F.col("own") & (F.col("n_docs") < self.min_docs)).select("key", "n_docs")

    def frequent(self) -> DataFrame:
        """Compact all runs; the keys found in ``min_docs`` documents or more, each once."""
        runs = [run for level in self.levels for run in level]
        self.levels = []
        if runs:
            self.levels = [[self._merged(runs)]]
        return reduce(DataFrame.unionByName, self._frequent)


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, n_batches: int = N_BATCHES) -> DataFrame:
    """All columns of ``docs`` plus ``kept_text``, ``n_lines`` and ``n_dropped``.

    The lines of all rows are written once as keys; batches of texts go through
    ``LineRuns``. What is dropped from a text comes back as positions, joined by
    the key of the text, so texts are shuffled once and lines never. The frequent keys
    and the positions are written before they are joined, so that Spark can split a very
    common line or the copies of one text.
    """
    lines = stage(keyed_lines(docs, text_col), "line-keys")
    runs = LineRuns(min_docs)
    for batch in range(n_batches):
        runs.add(lines.where(F.pmod(F.xxhash64("text_key"), F.lit(n_batches)) == batch))
    frequent = stage(runs.frequent(), "line-frequent")
    hits = lines.select("text_key", "pos", "key").join(frequent, "key").groupBy("text_key").agg(F.collect_set("pos").alias("drop"))
    hits = stage(hits, "line-drops")
    parts = F.split(F.col("_text"), "\n", -1)
    kept = let(
        parts,
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drop")), lambda i: F.get(ls, i)), "\n"),
    )
    rest = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    # The text rides once, as its own column.
    row = F.struct(*[F.col(c) for c in rest if c != text_col], F.col(text_col).isNull().alias("_null")).alias("_row")
    joined = docs.select(row, whole(F.col(text_col)).alias("_text"), text_key(F.col(text_col)).alias("text_key")).join(hits, "text_key", "left")
    # In a step of its own, so that no name of the table is taken for one of these columns.
    joined = joined.select(
        "_row",
        F.when(~F.col("_row")["_null"], F.col("_text")).alias("_text"),
        F.when(F.col("drop").isNull(), F.col("_text")).otherwise(kept).alias("kept_text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    kept_cols = [(F.col("_text") if c == text_col else F.col("_row")[c]).alias(c) for c in rest]
    return joined.select(*kept_cols, "kept_text", "n_lines", "n_dropped")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY rid
"""
