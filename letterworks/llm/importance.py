"""Importance resampling towards the distribution of a target: hashed word n-grams, bag by bag.

Words come from bytes: a table of 256 bytes lower-cases A-Z and blanks the separators,
``bytes.split`` gives the words, ``zlib.crc32`` of a word seeds that of the next longer
run, and counters add up the runs of a batch before its buckets leave the task. A document
weighs the sum of its features' log ratios between target and source; Gumbel noise from a
hash of its id makes the highest scores a sample without replacement. Ranks come from a
sort by range and the sizes of its partitions, so no task sees all documents.

Defined results: a null or wordless text has no features and weight 0; a null id hashes
as an empty one and comes last among equal scores; rows of equal id are documents of their
own, ties between them go by weight and number of features; texts of any length are read
whole, in pieces; other columns of the tables, whatever their names, are not read; an
empty target or corpus counts as no features; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.session import prepare, stage, table

NGRAM = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of a long text that are split at once.
PIECE = 1 << 20

#: Letters in lower case; every other ASCII byte that is no digit is a blank.
BYTES = bytes(b if b > 127 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def features(text: str | None, ngram: int = NGRAM) -> Iterator[tuple[int, list[int]]]:
    """Pieces of a text: how many words each has, and the hashes of all runs of words that end in it."""
    data = (text or "").encode().translate(BYTES)
    begin, carry = 0, []
    while begin < len(data):
        end = data.find(b" ", begin + PIECE)
        end = len(data) if end < 0 else end
        own = data[begin:end].split()
        words = carry + own
        runs = [zlib.crc32(w) for w in words]
        hashes = runs[len(carry) :]
        for k in range(1, ngram):
            runs = [zlib.crc32(w, zlib.crc32(b" ", seed)) for seed, w in zip(runs, words[k:])]  # noqa: B905  runs that end with the text
            hashes += runs[max(0, len(carry) - k) :]
        yield len(own), hashes
        carry = words[len(words) - ngram + 1 :] if ngram > 1 else []
        begin = end


def _count(rows: Iterator[pa.RecordBatch], ngram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The buckets of a task's features."""
    total = np.zeros(buckets, np.int64)
    for batch in rows:
        counts: Counter[int] = Counter()
        for text in batch.column(0):
            for _, hashes in features(text.as_py(), ngram):
                counts.update(hashes)
            if len(counts) > PIECE:
                np.add.at(total, np.fromiter(counts, np.int64) % buckets, np.fromiter(counts.values(), np.int64))
                counts.clear()
        np.add.at(total, np.fromiter(counts, np.int64, len(counts)) % buckets, np.fromiter(counts.values(), np.int64, len(counts)))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "n": total[used]})


def bucket_counts(texts: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: one row for each bucket reaches the driver."""
    parts = texts.select(F.col(text_col).cast("string")).mapInArrow(lambda it: _count(it, ngram, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket a thousand times the log ratio of its smoothed shares of target and source, rounded down."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    ratios = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weigh(rows: Iterator[pa.RecordBatch], gain: np.ndarray, ngram: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        n_words, n_features, weight = [], [], []
        for text in batch.column(1):
            words = runs = total = 0
            for k, hashes in features(text.as_py(), ngram):
                words += k
                runs += len(hashes)
                total += int(gain[np.array(hashes, np.int64) % len(gain)].sum())
            n_words.append(words)
            n_features.append(runs)
            weight.append(total)
        data = {"doc_id": batch.column(0), "n_words": n_words, "n_features": n_features, "weight": weight}
        yield pa.RecordBatch.from_pydict({k: v if k == "doc_id" else pa.array(v, pa.int64()) for k, v in data.items()})


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel variate from a hash of the id, rounded down."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` plus ``rank`` from 1 in the given order, without a task that sees them all."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    spread = spread.withColumns({"_part": F.shiftright(place, 33).cast("int"), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))})
    spread = stage(spread, "ranked-rows")
    sizes = sorted(spread.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    before = dict(zip([r._part for r in sizes], [0, *np.cumsum([r.n for r in sizes]).tolist()], strict=False))
    offsets = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
    return spread.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    ``percent`` of the documents of at least ``min_words`` words are drawn.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(rows, "text", ngram, buckets), bucket_counts(target, text_col, ngram, buckets))
    weighed = rows.mapInArrow(lambda it: _weigh(it, gain, ngram), "doc_id long, n_words long, n_features long, weight long")
    scored = stage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance-scores")
    able = F.col("n_words") >= min_words
    n = scored.where(able).count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    best = ranked(scored.where(able), order)
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    return best.withColumn("rank", drawn).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    out = resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH RECURSIVE step AS (SELECT range AS b, range AS c, 0 AS i FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM step WHERE i = 8),
x AS (SELECT 's' AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, rid, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM x),
e AS (SELECT side, rid, unnest(ws) AS word FROM w),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM e)),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) + 1, 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, crc),
f AS (SELECT side, rid, bucket FROM e JOIN k USING (word)),
n AS (SELECT count(*) FILTER (WHERE side = 's') AS s_all, count(*) FILTER (WHERE side = 't') AS t_all FROM f),
b AS (SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM b, n),
d AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE side = 's' GROUP BY rid),
z AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM w LEFT JOIN d USING (rid) WHERE side = 's'),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, weight DESC) END AS place,
        count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN CAST(place AS BIGINT) END AS rank FROM r
"""
