"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of one to three characters of the whole text, letters in lower
case and everything else a blank, hashed to ``BUCKETS``; their weight is the share
of the text's n-grams times an IDF that is counted over all training documents.
The weights are fitted by follow-the-regularised-leader with elastic-net penalties
on a bounded sample (``SAMPLE_DOCS``, spread evenly over the languages and drawn by
a hash), then one temperature is fitted on other documents of the sample. Every
text is scored whole.

Learning sees text and language of documents with ``crc32(doc_id) % FOLDS <> 0``
only; prediction sees the text only. Defined results: a text that is null or has
no letter is ``und`` with score 0; without training documents every text is; a
row with a null id is predicted, not learned from, and not held out; null
languages are not learned from; repeated rows are predicted each; of languages with
equal logits the first in order is predicted; a table too small to spare documents
for the temperature keeps it at 1, and one whose documents all fall to it is fitted on
them; texts of any length are scored whole; columns called ``lang_pred`` or ``score``
give way to the results, all others are returned whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from letterworks.llm.textvec import pieces
from letterworks.session import prepare, stage, table

BITS = 15
BUCKETS = 1 << BITS
FOLDS = 5
#: Bound of the sample on which the weights are fitted, and the share of it that fits the temperature instead.
SAMPLE_DOCS = 6000
CALIBRATION_SHARE = 0.25
EPOCHS = 3
#: Step size, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
SCALE = 100.0
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def characters(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a run of texts with single blanks (0) between and around, and where each text begins."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    x = np.concatenate([raw, np.zeros(3, np.uint8)])
    b0, b1, b2, b3 = (x[lead + k].astype(np.uint32) for k in range(4))
    b1, b2, b3 = b1 & 0x3F, b2 & 0x3F, b3 & 0x3F
    code = np.where(
        b0 < 0x80,
        b0,
        np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)),
    )
    c = _letters()[np.minimum(code, 0x10FFFF)]
    begin = np.searchsorted(lead, offs)
    c = np.insert(c, begin, 0)
    begin = begin + np.arange(len(offs))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    keep[begin] = True
    place = np.cumsum(keep) - 1
    return c[keep], place[begin]


def ngrams(c: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Buckets of the runs of 1, 2 and 3 characters that start at each place, as rows; ``BUCKETS`` where there is none."""
    n = len(c)
    stop = np.repeat(begin[1:], np.diff(begin))
    x = np.concatenate([c, np.zeros(3, np.uint32)])
    at = np.arange(len(stop))
    out = np.empty((3, len(stop)), np.int32)
    h = np.zeros(n, np.uint32)
    letters = x[:n] != 0
    for k in range(3):
        h = (h + x[k : k + n] + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        good = (at + k <= stop) & (letters[: len(stop)] | (k > 0) & (x[1 : len(stop) + 1] != 0))
        out[k] = np.where(good, (h[: len(stop)] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS), BUCKETS)
    return out


def counted(grams: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, bucket and count of the distinct n-grams of each text."""
    owner = np.repeat(np.arange(len(begin) - 1, dtype=np.int64), np.diff(begin))
    keys = ((owner << (BITS + 1)) | grams).reshape(-1)
    keys = np.sort(keys[(keys & (2 * BUCKETS - 1)) != BUCKETS])
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first] >> (BITS + 1), keys[first] & (BUCKETS - 1), np.diff(np.append(first, len(keys)))


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are; all rows are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, raw, offs in pieces(batch.column(0)):
                c, begin = characters(raw, offs)
                df += np.bincount(counted(ngrams(c, begin), begin)[1], minlength=BUCKETS)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1), pa.int32()), pa.array(np.append(df[there], n), pa.int64())], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS, np.int64)
    there = rows.bucket.to_numpy() >= 0
    df[rows.bucket.to_numpy()[there]] = rows.n.to_numpy()[there]
    return df, int(rows.n.to_numpy()[~there].sum())


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal steps on (buckets, values, class) samples."""
    z = np.zeros((BUCKETS + 1, n_classes))
    n = np.zeros_like(z)

    def solved(i):
        size = np.maximum(np.abs(z[i]) - L1, 0)
        return -np.sign(z[i]) * size / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            buckets, values, label = samples[k]
            i = np.append(buckets, BUCKETS)  # the last row is the bias
            v = np.append(values, 1.0)
            w = solved(i)
            p = np.exp((s := v @ w) - s.max())
            p /= p.sum()
            p[label] -= 1
            g = v[:, None] * p
            new = n[i] + g * g
            z[i] += g - (np.sqrt(new) - np.sqrt(n[i])) / ALPHA * w
            n[i] = new
    w = solved(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least loss on a grid of even ratios."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 121):
        s = logits / t
        m = s.max(axis=1, keepdims=True)
        loss = (m[:, 0] + np.log(np.exp(s - m).sum(axis=1)) - s[np.arange(len(s)), labels]).mean() if len(s) else 0
        best = min(best, (loss, float(t)))
    return best[1]


class Model:
    """Languages, IDF-scaled weights, biases and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.idf, self.t = langs, idf, 1.0
        self.table = np.zeros((BUCKETS + 1, max(len(langs), 1)), np.float32)
        self.table[:BUCKETS, : len(langs)] = weights * idf[:, None] * SCALE
        self.bias = bias

    def logits(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and whether it has a letter."""
        c, begin = characters(raw, offs)
        grams = ngrams(c, begin)
        total = np.zeros((len(offs) - 1, self.table.shape[1]), np.float32)
        n = np.zeros(len(offs) - 1, np.int64)
        for row in grams:
            total += np.add.reduceat(self.table[row], begin[:-1])
            n += np.add.reduceat((row != BUCKETS).astype(np.int64), begin[:-1])
        return total / np.maximum(n, 1)[:, None] + self.bias, n > 0


def in_training(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds != 0, F.lit(False))


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from (id, text, lang) rows with a language; None without any."""
    spark = labelled.sparkSession
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    df, n_docs = document_counts(labelled)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    # More languages than places in the sample: the most frequent ones have one each.
    placed = sorted(langs, key=lambda k: (-sizes[k], k))[:sample_docs]
    quota = sample_docs // max(len(placed), 1)
    rates = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 2 * quota / sizes[k]) if k in placed else 0.0)])
    draw = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 20)) / float(1 << 20)
    part = F.pmod(F.hash("id", F.lit(1)), F.lit(1000)) < CALIBRATION_SHARE * 1000
    # Twice as many are drawn by hash as have a place, then exactly so many stay, however often rows repeat.
    order_of = Window.partitionBy("lang").orderBy(F.xxhash64("id", "lang"), "id", F.xxhash64("text"))
    drawn = labelled.where(draw < rates[F.col("lang")]).withColumn("_n", F.row_number().over(order_of)).where(F.col("_n") <= quota).drop("_n")
    sample = stage(drawn.withColumn("calibrate", part), "lang-sample")
    order = {k: i for i, k in enumerate(langs)}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for batch in batches:
            labels = [order[x] for x in batch.column(1).to_pylist()]
            for row, raw, offs in pieces(batch.column(0)):
                c, begin = characters(raw, offs)
                owner, bucket, count = counted(ngrams(c, begin), begin)
                bounds = np.searchsorted(owner, np.arange(len(offs)))
                for k in range(len(offs) - 1):
                    b, x = bucket[bounds[k] : bounds[k + 1]], count[bounds[k] : bounds[k + 1]]
                    if len(b):
                        samples.append((b, x / x.sum() * idf[b] * SCALE, labels[row + k]))
        w, bias = fit(samples, len(order))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([bias.tobytes()], pa.binary())], names=["w", "bias"])

    fitting = sample.where("not calibrate")
    if fitting.isEmpty():
        fitting = sample
    # The sample is bounded, so one task can hold it; rows come in a fixed order.
    fitted = fitting.select("text", "lang", "id").repartition(1).sortWithinPartitions("id", "lang", F.xxhash64("text")).mapInArrow(learn, "w binary, bias binary").first()
    if fitted is None:  # the draw took no document at all
        return Model(langs, idf, np.zeros((BUCKETS, len(langs))), np.zeros(len(langs)))
    model = Model(langs, idf, np.frombuffer(fitted.w, np.float32).reshape(BUCKETS, -1), np.frombuffer(fitted.bias))
    rest = scored(sample.where("calibrate").select("text", "lang"), model, spark).where("has").select("lang", "logits").toPandas()
    if len(rest):
        model.t = temperature(np.stack(rest.logits.to_numpy()), rest.lang.map(order).to_numpy())
    return model


def scored(docs: DataFrame, model: Model, spark: SparkSession) -> DataFrame:
    """The columns of ``docs`` but ``text``, logits, and ``has`` (a letter). The others are read by place, so any names do."""
    shared = spark.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            logits, has = np.zeros((batch.num_rows, m.table.shape[1])), np.zeros(batch.num_rows, bool)
            for row, raw, offs in pieces(batch.column(at)):
                logits[row : row + len(offs) - 1], has[row : row + len(offs) - 1] = m.logits(raw, offs)
            own = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(list(logits), pa.list_(pa.float64())), pa.array(has)], names=[*[f.name for f in rest], "logits", "has"])

    return docs.mapInArrow(run, StructType([*rest, StructField("logits", ArrayType(DoubleType())), StructField("has", BooleanType())]))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus ``lang_pred`` and ``score`` (the calibrated probability)."""
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    if model is None:
        return docs.select(*rest, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    row = F.struct(*[F.col(c) for c in rest], F.lit(0).alias("_")).alias("_row")
    out = scored(docs.select(row, F.col(text_col).alias("text")), model, docs.sparkSession)
    best = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp((x - best) / model.t))
    names = F.array(*[F.lit(k) for k in model.langs])
    lang = F.when(F.col("has"), F.get(names, (F.array_position("logits", best) - 1).cast("int"))).otherwise(UNKNOWN)
    # In a step of its own, so that no name of the table is taken for one of these columns.
    out = out.select("_row", lang.alias("lang_pred"), F.when(F.col("has"), 1 / total).otherwise(0.0).alias("score"))
    return out.select(*[F.col("_row")[c].alias(c) for c in rest], "lang_pred", "score")


def labelled_rows(docs: DataFrame) -> DataFrame:
    rows = docs.where(in_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col("doc_id").cast("long").alias("id"), "text", "lang")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    model = train(labelled_rows(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
