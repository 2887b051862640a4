"""Scoring documents with a gated recurrent language model and a smoothed unigram base.

Word counts cover all training documents and stay distributed. The most frequent
words of a fixed number are broadcast; the others of each document are joined with
their counts by hash. The recurrent model's vocabulary is the head of the counts;
each text is written once as the ids of its words, two bytes each.

The model learns from every window of every training document, each in one of
``ROUNDS``. In a round the documents are dealt by a hash of their row to trainers of
about ``TRAINER_TOKENS`` words, whose number grows with the corpus; each goes on from
the model of the round before, and their parameters are averaged in a tree, so no task
holds more than ``FAN`` of them. Documents, order and averages follow from the rows
alone: the same table gives the same model however its files are laid out. Then every
text is scored whole, its state carried across windows.

A text's score is the log10-probability of its words and of the end that follows
them. The class of all words outside the vocabulary spreads its probability by the
smoothed counts of those words.

Defined results: a null or empty text is the end alone; a row with a null id is
neither learned from nor held out; repeated rows count and are scored each;
without training documents all words are unknown and the model is the base; of words
with equal counts at the edge of the vocabulary those with the smaller hash are in it;
texts of any length are scored whole; columns called like a result give way to it, all
others are returned whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from letterworks.llm import gru
from letterworks.llm.textvec import Words, pieces
from letterworks.session import prepare, stage, table

FOLDS = 10
SMOOTH = 0.1
#: Words of the recurrent model, and words whose counts are broadcast.
VOCABULARY = 4096
HEAD = 1 << 18
SLOT_BITS = 20
#: The end of a text as a word; no word of a text has this hash but by chance.
END = np.uint64(0x1F83D9ABFB41BD6B)
#: Sixteenths of the training documents that each round learns from; together all of them, each once.
ROUNDS = (range(0, 1), range(1, 4), range(4, 16))
#: Words of a trainer's documents, about.
TRAINER_TOKENS = 4 << 20
#: Trainers whose parameters one task averages, and the parts in which they are sent.
FAN = 64
SHARDS = 16
FLUSH = 1 << 20


def in_training(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds != 0, F.lit(False))


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and the bounds of the texts."""
    w = Words(raw, offs, fold=True)
    return np.insert(w.hashes, w.bounds[1:], END), w.bounds + np.arange(len(w.bounds))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word hash occurs in the texts (column ``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate([w for w, _ in waiting]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in waiting]).astype(float), len(words)).astype(np.int64)
            waiting[:] = []
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for _, raw, offs in pieces(batch.column(0)):
                waiting.append(np.unique(tokens(raw, offs)[0], return_counts=True))
                if sum(len(w) for w, _ in waiting) > FLUSH:
                    yield merged()
        if waiting:
            yield merged()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Counts of the head words, ids of the vocabulary, and the totals of all."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        """``words`` and ``counts`` by falling count."""
        self.total, self.distinct = total, distinct
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.ids = np.where(order < VOCABULARY, order, min(VOCABULARY, len(words))).astype(np.int32)
        self.vocabulary = counts[:VOCABULARY].astype(float)
        self.other = float(total - self.vocabulary.sum())
        self.other_distinct = distinct - len(self.vocabulary)

        # Places of the words by their first bits: most words that are not there are turned away at once.
        self.slots = np.searchsorted(self.words >> np.uint64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the head (-1: not there) and ids in the vocabulary."""
        at = np.full(len(hashes), -1)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        place, stop = self.slots[slot], self.slots[slot + 1]
        left = np.flatnonzero(place < stop)
        while len(left):
            own = place[left]
            good = self.words[own] == hashes[left]
            at[left[good]] = own[good]
            left = left[~good]
            place[left] += 1
            left = left[place[left] < stop[left]]
        ids = np.full(len(hashes), len(self.vocabulary), np.int32)
        there = at >= 0
        ids[there] = self.ids[at[there]]
        return at, ids


def lexicon(counts: DataFrame) -> Lexicon:
    """Totals, and the most frequent words, at most ``HEAD``: of bounded size whatever the corpus.

    A histogram of the counts (steps of one, above 1024 of a hundredth) gives the least count of a head word, so only the head itself reaches the driver.
    """
    n = F.col("n").cast("double")
    step = F.when(n < 1024, n).otherwise(1024 + F.floor(F.log2(n / 1024) * 64)).cast("long")
    rows = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).toPandas().sort_values("step", ascending=False)
    fits = rows.words.cumsum() <= HEAD
    least = int(rows.step[fits].min()) if fits.any() else 1 << 60
    head = counts.where(step >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    return Lexicon(head.word.to_numpy(np.int64).view(np.uint64), head.n.to_numpy(np.int64), int(rows.n.sum()), int(rows.words.sum()))


def averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """The mean of parameters of one shard, weighted by the words behind them."""
    rows = rows.sort_values("trainer")
    mean = sum(np.frombuffer(p, np.float32).astype(float) * n for p, n in zip(rows.params, rows.tokens, strict=True)) / rows.tokens.sum()
    return pd.DataFrame({"trainer": [rows.trainer.iloc[0] // FAN], "shard": rows["shard"].iloc[:1].to_numpy(), "tokens": [rows.tokens.sum()], "params": [mean.astype(np.float32).tobytes()]})


def trainer(shared: Broadcast, turn: int) -> Callable[[pa.Table], pa.Table]:
    """The work of one trainer: from its documents (trainer, key, ids) to its parameters in shards."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        own = gru.Gru({k: v.copy() for k, v in shared.value.p.items()})
        ids, bounds = listed_ids(rows.column("ids"))
        tokens = own.learn(ids, bounds, own.memory(), seed=turn)
        shards = [x.tobytes() for x in np.array_split(own.flat(), SHARDS)]
        me = rows.column("trainer")[0].as_py()
        return pa.table({"trainer": [me] * SHARDS, "shard": pa.array(range(SHARDS), pa.int32()), "tokens": [tokens] * SHARDS, "params": pa.array(shards, pa.binary())})

    return run


def listed_ids(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and the bounds of the texts."""
    parts = texts.to_pylist()
    bounds = np.concatenate([[0], np.cumsum([len(x) // 2 for x in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint16).astype(np.int64), bounds


def train(coded: DataFrame, lex: Lexicon, rounds: tuple[range, ...] = ROUNDS, trainer_tokens: int = TRAINER_TOKENS) -> gru.Gru:
    """The model of the texts in ``coded`` (key, ids): in each round trainers go on from the model, and their mean is the next."""
    model = gru.Gru.start(lex.vocabulary, lex.other)
    schema = "trainer long, shard int, tokens long, params binary"
    for turn, part in enumerate(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(model)
        n = max(1, round(lex.total * len(part) / 16 / trainer_tokens))
        drawn = coded.where(F.pmod(F.shiftright("key", 32), F.lit(16)).between(part.start, part.stop - 1))
        means = drawn.withColumn("trainer", F.pmod("key", F.lit(n))).groupBy("trainer").applyInArrow(trainer(shared, turn), schema)
        while n > 1:
            means = means.groupBy("shard", F.floor(F.col("trainer") / FAN)).applyInPandas(averaged, schema)
            n = -(-n // FAN)
        found = sorted(means.collect(), key=lambda r: r["shard"])
        if found:
            model = model.with_flat(np.concatenate([np.frombuffer(r.params, np.float32) for r in found]))
    return model


CODED = "row long, n_tokens long, head_n long, head_known long, head_log double, other_n long, other_head_log double, tail binary, ids binary"


def coded_rows(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Per row: its other columns, n_tokens, what the head tells, the hashes of its other words, and the ids of all its words."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    text_at = docs.columns.index("text")
    schema = StructType([*rest, *StructType.fromDDL(CODED).fields])
    names = StructType.fromDDL(CODED).fieldNames()
    numbers = names[1:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lex = shared.value
        logs = np.log10(lex.counts + SMOOTH)
        row = TaskContext.get().partitionId() << 40
        outside = len(lex.vocabulary)
        for batch in batches:
            n = batch.num_rows
            out = {k: np.zeros(n, float if k.endswith("log") else np.int64) for k in numbers}
            tails: list[bytes] = []
            coded: list[bytes] = []
            for first, raw, offs in pieces(batch.column(text_at)):
                hashes, at = tokens(raw, offs)
                place, word = lex.look_up(hashes)
                there = place >= 0
                own = slice(first, first + len(offs) - 1)
                known = np.where(there, logs[place] if len(logs) else 0.0, 0.0)
                other = word == outside
                # Every text has its end, so no run of words is empty.
                count = lambda x, at=at: np.add.reduceat(x, at[:-1])
                out["n_tokens"][own] = np.diff(at)
                out["head_n"][own] = out["head_known"][own] = count(there.astype(np.int64))
                out["head_log"][own] = count(known)
                out["other_n"][own] = count(other.astype(np.int64))
                out["other_head_log"][own] = count(np.where(other, known, 0.0))
                tail = hashes[~there]
                cuts = np.cumsum(count((~there).astype(np.int64)))
                tails += [tail[a:b].tobytes() for a, b in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True)]
                word = word.astype(np.uint16)
                coded += [word[a:b].tobytes() for a, b in itertools.pairwise(at.tolist())]
            own = [c for i, c in enumerate(batch.columns) if i != text_at]
            made = [pa.array(row + np.arange(n)), *[pa.array(out[k]) for k in numbers], pa.array(tails, pa.binary()), pa.array(coded, pa.binary())]
            row += n
            yield pa.RecordBatch.from_arrays([*own, *made], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def modelled(rows: DataFrame, model: gru.Gru) -> DataFrame:
    """The columns of ``rows`` but ``ids``, and ``gru_log``: the log10-probability of the ids by the recurrent model."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index("ids")
    schema = StructType([*[f for f in rows.schema.fields if f.name != "ids"], StructField("gru_log", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            logs = net.score(*listed_ids(batch.column(at))) / np.log(10)
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(logs)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def tail_sums(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, tail_known, tail_log): the words outside the head, joined with their counts."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, tails = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for k in range(0, len(row), 256):
                sizes = [len(t) // 8 for t in tails[k : k + 256]]
                words = np.frombuffer(b"".join(tails[k : k + 256]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(row[k : k + 256], sizes))], names=["word", "row"])

    words = rows.select("row", "tail").mapInArrow(listed, "word long, row long")
    found = words.join(counts, "word")
    return found.groupBy("row").agg(F.count(F.lit(1)).alias("tail_known"), F.sum(F.log10(F.col("n") + SMOOTH)).alias("tail_log"))


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, learn: Column, text_col: str = "text") -> DataFrame:
    """The other columns of ``docs``, n_tokens, n_known, train_tokens, base_score and score; ``learn`` picks training rows."""
    keep = [c for c in docs.columns if c != text_col and c not in RESULTS]
    training = docs.where(learn).select(F.col(text_col).alias("text"))
    counts = stage(word_counts(training), "lm-counts")
    lex = lexicon(counts)
    # The row's own columns travel in one struct, so their names cannot clash.
    row = F.struct(*[F.col(c) for c in keep], F.lit(0).alias("_")).alias("_row")
    slim = docs.select(row, F.coalesce(learn, F.lit(False)).alias("_learn"), F.xxhash64(*docs.columns).alias("key"), F.col(text_col).alias("text"))
    rows = stage(coded_rows(slim, lex), "lm-rows")
    model = train(rows.where("_learn").select("key", "ids"), lex)
    scored = stage(modelled(rows.drop("_learn", "key", "tail"), model), "lm-scores")
    sums = scored.join(tail_sums(rows, counts), "row", "left")
    n, known = F.col("n_tokens"), F.coalesce("tail_known", F.lit(0))
    unknown = n - F.col("head_n") - known
    tail = F.coalesce("tail_log", F.lit(0.0)) + unknown * float(np.log10(SMOOTH))
    base = F.col("head_log") + tail - n * float(np.log10(lex.total + SMOOTH * (lex.distinct + 1)))
    spread = float(np.log10(lex.other + SMOOTH * (lex.other_distinct + 1)))
    whole = F.col("gru_log") + F.col("other_head_log") + tail - F.col("other_n") * spread
    out = sums.select(
        "_row",
        "n_tokens",
        (F.col("head_known") + known).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        whole.alias("score"),
    )
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], *RESULTS)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), in_training(F.col("doc_id")))
