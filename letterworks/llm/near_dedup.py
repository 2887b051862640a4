"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

A shingle is a run of five words; its weight is its count in the text times its
IDF, 1 + log10(1 / share of the documents with it) / ``DAMPING``. Document frequencies
are counted over the whole corpus in a count-min sketch of fixed size. The sketch's
error is a fixed share of the corpus, its load (shingles of an average text over its
width), so shares below ``FLOOR_LOADS`` loads, about two in a thousand, count as that:
every passage more common than that weighs less the more documents share it. The
logarithm is damped because the members of a large class share their passages with the
whole class, and their few differences would else outweigh them.

Improved consistent weighted sampling draws 24 samples of each text; 8 bands of 3
give buckets. In a bucket all members are first compared with its leader, so that
a large class is a star. Those left over are then compared with one another and
with the members that the leader has, in blocks of bounded size, until no two of
different classes are left that might be linked: samples in numpy, and what agrees by its whole texts in the same task. Candidate pairs whose samples agree
too rarely are passed over (for a pair at the threshold that has a chance under
1e-4); the others are verified exactly by weighted Jaccard similarity of the whole
texts, but for pairs that other links have put into one class before. Verified
links give classes as connected components.

Defined results: a text without words is alone in its class; texts of fewer than
five words are one shingle; equal texts are always one class, handled as one text
until the end; repeated rows are rows of one class; the class id is the smallest
document id in the class (null if it has none); an empty table gives an empty
result; texts of any length are compared whole; of ties for the smallest id or text
either is taken, being equal; other columns of the table, whatever their names, are
not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.llm.columns import text_key
from letterworks.llm.graph import connected_components
from letterworks.llm.textvec import BASE, GAP, Words, mix, pieces, runs_hash
from letterworks.session import prepare, stage, table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
SAMPLES = BANDS * ROWS
#: Samples of a candidate pair that must agree before it is verified.
MIN_AGREE = 10
#: About how many members of a bucket are compared at once with as many others.
BLOCK = 512
#: Columns of a matrix of texts and shingles at once.
TOKENS = 4096
DAMPING, FLOOR_LOADS = 2, 4
SKETCH_BITS, SKETCH_ROWS, SKETCH_BLOCKS = 20, 2, 16
ID_BITS = 50


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 65536 even steps, and their logarithms."""
    grid = np.linspace(0, 40, 400_001)
    share = 1 - np.exp(-grid) * (1 + grid)
    gamma = np.interp((np.arange(65536) + 0.5) / 65536, share, grid)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32)


GAMMA, LOG_GAMMA = _tables()


class Shingles:
    """Distinct shingles of a run of texts: 50-bit ids, counts, owners; ``starts`` of each owner that has any."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        w = Words(raw, offs, fold=True)
        hashes, at = runs_hash(w, SHINGLE)
        owner = np.searchsorted(w.bounds, at, "right") - 1
        keys = (owner.astype(np.uint64) << np.uint64(ID_BITS)) | (hashes >> np.uint64(64 - ID_BITS))
        keys.sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        found = np.flatnonzero(new)
        self.keys = keys[found]
        self.count = np.diff(np.append(found, len(keys)))
        self.owner = (self.keys >> np.uint64(ID_BITS)).astype(np.int64)
        self.ids = self.keys & np.uint64((1 << ID_BITS) - 1)
        first = np.ones(len(found), bool)
        first[1:] = self.owner[1:] != self.owner[:-1]
        self.starts = np.flatnonzero(first)


def _cells(ids: np.ndarray) -> list[np.ndarray]:
    return [(mix(ids * GAP + np.uint64(r)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) for r in range(SKETCH_ROWS)]


def document_sketch(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """The count-min sketch of document frequencies (fixed size) and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.uint32)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for _, raw, offs in pieces(batch.column(0)):
                for row, cells in zip(sketch, _cells(Shingles(raw, offs).ids), strict=True):
                    row += np.bincount(cells, minlength=len(row)).astype(np.uint32)
        parts = np.array_split(sketch.reshape(-1), SKETCH_BLOCKS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()), pa.array([n] + [0] * (SKETCH_BLOCKS - 1), pa.int64())],
            names=["block", "counts", "n"],
        )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in rows.counts)
        return pd.DataFrame({"block": rows.block[:1], "counts": [zlib.compress(total.tobytes(), 1)], "n": [rows.n.sum()]})

    schema = "block int, counts binary, n long"
    merged = docs.select(F.col(text_col)).mapInArrow(count, schema).groupBy("block").applyInPandas(merge, schema).collect()
    if not merged:
        return np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS)), 0
    counts = np.concatenate([np.frombuffer(zlib.decompress(r.counts), np.uint64) for r in sorted(merged, key=lambda r: r.block)])
    return counts.reshape(SKETCH_ROWS, -1), sum(r.n for r in merged)


def idf_table(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """IDF of each sketch cell; shares below the sketch's error, or one document, count as that."""
    n = max(n_docs, 1)
    floor = min(max(1 / n, FLOOR_LOADS * counts.mean() / n), 1)
    return (1 - np.log10(np.clip(counts / n, floor, 1)) / DAMPING).astype(np.float32)


def weights(s: Shingles, idf: np.ndarray) -> np.ndarray:
    """Count times IDF; the least estimate of a sketch, and so the largest IDF, is the nearest."""
    cells = _cells(s.ids)
    return s.count.astype(np.float32) * reduce(np.maximum, (row[c] for row, c in zip(idf, cells, strict=True)))


def draw(s: Shingles, w: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: for each owner with shingles a row of ``SAMPLES`` 32-bit sample ids."""
    out = np.empty((len(s.starts), SAMPLES), np.uint32)
    if not len(s.starts):
        return out
    log_w = np.log(w)
    low = np.uint64(0xFFFF)
    for k in range(SAMPLES):
        x = mix(s.ids * GAP + np.uint64((k + 1) * int(BASE) & 0xFFFFFFFFFFFFFFFF))
        r = GAMMA[(x & low).astype(np.int64)]
        beta = ((x >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + beta)
        log_a = LOG_GAMMA[((x >> np.uint64(16)) & low).astype(np.int64)] - r * (t - beta + 1)
        order = (np.maximum(log_a + np.float32(4096), np.float32(0))).astype(np.float64)
        key = (order * 2.0**19).astype(np.uint64) << np.uint64(32)
        key |= ((x >> np.uint64(24)) ^ (t.astype(np.int64).astype(np.uint64) * GAP)) & np.uint64(0xFFFFFFFF)
        out[:, k] = (np.minimum.reduceat(key, s.starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def signatures(docs: DataFrame, text_col: str, idf: np.ndarray) -> DataFrame:
    """``docs`` (columns but the text) with ``sig``: the samples and the weight of the whole text as bytes, null for texts without words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs: list[bytes | None] = [None] * batch.num_rows
            for row, raw, offs in pieces(batch.column(batch.schema.get_field_index(text_col))):
                s = Shingles(raw, offs)
                w = weights(s, shared.value)
                total = np.add.reduceat(w, s.starts, dtype=float).astype(np.float32) if len(s.starts) else np.zeros(0, np.float32)
                for owner, sample, whole in zip(s.owner[s.starts].tolist(), draw(s, w), total, strict=True):
                    sigs[row + owner] = sample.tobytes() + whole.tobytes()
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(sigs, pa.binary())], names=[*rest, "sig"])

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in rest], "sig binary"]))


def similarity(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of whole texts, row by row."""
    out = np.zeros(len(left))
    row = 0
    while row < len(left):
        # Rows whose texts are about a piece together; at least one.
        stop = row + 1
        size = len(left[row].as_py() or "") + len(right[row].as_py() or "")
        while stop < len(left) and size < 1 << 20 and stop - row < 4096:
            size += len(left[stop].as_py() or "") + len(right[stop].as_py() or "")
            stop += 1
        sides = []
        for column in (left, right):
            _, raw, offs = next(pieces(column[row:stop], 1 << 62))
            s = Shingles(raw, offs)
            sides.append((s, weights(s, idf).astype(float)))
        (a, wa), (b, wb) = sides
        _, i, j = np.intersect1d(a.keys, b.keys, assume_unique=True, return_indices=True)
        n = stop - row
        both = np.bincount(a.owner[i], np.minimum(wa[i], wb[j]), n)
        union = np.bincount(a.owner, wa, n) + np.bincount(b.owner, wb, n) - both
        out[row:stop] = np.divide(both, union, out=np.zeros(n), where=union > 0)
        row = stop
    return out


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (with sig_a and sig_b) whose samples agree often enough."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(SAMPLES - 1)),
        F.lit(0),
        lambda n, k: n + (F.substring("sig_a", k * 4 + 1, F.lit(4)) == F.substring("sig_b", k * 4 + 1, F.lit(4))).cast("int"),
    )
    return pairs.where(same >= MIN_AGREE)


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold. A leader of very many pairs is split by Spark's skew join."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = similarity(batch.column(2), batch.column(3), shared.value) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def leader_links(members: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links of bucket members (bucket, node, sig) with the smallest node of their bucket, so that large classes are stars."""
    # Written, so that both sides of the join are plain and a large bucket can be split.
    leaders = stage(members.groupBy("bucket").agg(F.min(F.struct("node", "sig")).alias("lead")), "near-leaders")
    pairs = members.join(leaders.select("bucket", F.col("lead.node").alias("a"), F.col("lead.sig").alias("sig_a")), "bucket")
    pairs = pairs.where(F.col("node") != F.col("a")).withColumnsRenamed({"node": "b", "sig": "sig_b"})
    return stage(verified(stage(_agreeing(pairs).select("a", "b").distinct(), "near-pairs"), texts, idf, threshold), "near-links")


def _blocks(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (bucket, x, y, own, node, root, sig) dealt to the pairs of blocks in which they meet all that may yet be linked to them.

    Members of the leader's class have negative blocks, which are not compared with one another, being one class; the
    rest of the bucket has blocks from 0, each compared with itself and all others. No block grows with its bucket.
    """
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lead = rooted.groupBy("bucket").agg(F.min(F.struct("node", "root")).alias("lead"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    lead = stage(lead.select("bucket", F.col("lead.root").alias("lead")), "near-leads")
    rooted = rooted.join(lead, "bucket").withColumn("led", F.col("root") == F.col("lead"))
    n_blocks = lambda led: F.ceil(F.count(F.when(F.col("led") == F.lit(led), 1)) / BLOCK).cast("int")
    rooted = stage(rooted, "near-rooted")
    sizes = stage(rooted.groupBy("bucket").agg(n_blocks(True).alias("n_led"), n_blocks(False).alias("n_rest")), "near-blocks")
    place = F.xxhash64("node", "bucket")
    own = F.when(F.col("led"), -1 - F.pmod(place, F.col("n_led"))).otherwise(F.pmod(place, F.col("n_rest"))).cast("int")
    others = F.sequence(F.when(F.col("led"), F.lit(0)).otherwise(-F.col("n_led")), F.col("n_rest") - 1)
    dealt = rooted.join(sizes, "bucket").withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root", "sig")


def _fixed(column: pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _compare(rows: pa.Table, diagonal: bool, left: np.ndarray, right: np.ndarray, root: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the pairs of two blocks that are of different classes and agree often enough, and how often.

    Texts whose whole weights differ by more than the threshold allows cannot reach it and are left out.
    """
    sigs = _fixed(rows.column("sig"), "u4", SAMPLES + 1)
    total = sigs[:, SAMPLES].view("f4")
    pair = lambda test, of: test(of[left][:, None], of[right][None, :])
    near = pair(np.not_equal, root) & (pair(np.minimum, total) >= pair(np.maximum, total) * np.float32(threshold - 1e-3))
    if diagonal:
        near &= np.tri(len(left), len(right), -1, bool).T
    agree = np.zeros(near.shape, np.uint8)
    if near.any():
        for k in range(SAMPLES):
            agree += pair(np.equal, sigs[:, k])
    i, j = np.nonzero(near & (agree >= MIN_AGREE))
    return left[i], right[j], agree[i, j]


def _shared_weight(s: Shingles, w: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The weight that texts ``left`` share with texts ``right`` of ``n`` texts, to about six digits, as products of matrices.

    The k-th occurrence of a shingle in a text is a token of its own, so a token is in a text or not.
    """
    _, code, docs = np.unique(s.ids, return_inverse=True, return_counts=True)
    often = np.flatnonzero(docs[code] > 1)
    count = s.count[often]
    token = np.repeat(code[often], count).astype(np.uint64) << np.uint64(32)
    token |= (np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    owner = np.repeat(s.owner[often], count)
    weight = np.repeat(w[often] / count, count)
    _, first, token = np.unique(token, return_index=True, return_inverse=True)
    order = np.argsort(token, kind="stable")
    token, owner, weight = token[order], owner[order], weight[first]
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(weight), TOKENS):
        high = min(low + TOKENS, len(weight))
        part = slice(*np.searchsorted(token, [low, high]))
        has = np.zeros((n, high - low), np.float32)
        has[owner[part], token[part] - low] = 1
        both += (has[left] * weight[low:high]) @ has[right].T
    return both


def _joining(texts: pa.Array, root: np.ndarray, i: np.ndarray, j: np.ndarray, agree: np.ndarray, idf: np.ndarray, threshold: float) -> list[int]:
    """Places in the candidates (i, j) of pairs that reach the threshold, enough to join all classes that some pair joins."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    at_i, at_j = at[: len(i)], at[len(i) :]
    _, raw, offs = next(pieces(texts.take(pa.array(used)), 1 << 62))
    s = Shingles(raw, offs)
    w = weights(s, idf)
    total = np.bincount(s.owner, w, len(used))
    likely = agree.astype(float)
    if len(i) > 64:
        left, row = np.unique(at_i, return_inverse=True)
        right, column = np.unique(at_j, return_inverse=True)
        both = _shared_weight(s, w, len(used), left, right)[row, column]
        likely = both / (total[at_i] + total[at_j] - both)
    bounds = np.searchsorted(s.owner, np.arange(len(used) + 1))
    parent = list(range(int(root.max()) + 1))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    out = []
    order = np.argsort(-likely, kind="stable")
    for k in (order if len(i) <= 64 else order[likely[order] >= threshold - 1e-3]).tolist():
        x, y = top(int(root[i[k]])), top(int(root[j[k]]))
        if x == y:
            continue
        a, b = (slice(bounds[d], bounds[d + 1]) for d in (at_i[k], at_j[k]))
        _, p, q = np.intersect1d(s.ids[a], s.ids[b], assume_unique=True, return_indices=True)
        both = np.minimum(w[a][p], w[b][q]).sum(dtype=float)
        if both >= threshold * (total[at_i[k]] + total[at_j[k]] - both):
            parent[x] = y
            out.append(k)
    return out


def block_links(blocks: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Verified links (a, b) of the texts in each pair of blocks, as many as join their classes; pairs never leave their task."""
    shared = blocks.sparkSession.sparkContext.broadcast(idf)

    def found(rows: pa.Table, key: tuple[int, int], own: np.ndarray) -> pa.RecordBatch | None:
        _, root = np.unique(_fixed(rows.column("root"), "S16", 1), return_inverse=True)
        root = root.reshape(-1)
        i, j, agree = _compare(rows, key[0] == key[1], np.flatnonzero(own == key[0]), np.flatnonzero(own == key[1]), root, threshold)
        if not len(i):
            return None
        good = _joining(rows.column("text"), root, i, j, agree, shared.value, threshold)
        node = rows.column("node")
        return pa.RecordBatch.from_arrays([node.take(pa.array(x[good])).combine_chunks() for x in (i, j)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            rows = pa.Table.from_batches([*kept, batch] if batch is not None else kept) if batch is not None or kept else []
            if not len(rows):
                continue
            bucket, x, y, own = (rows.column(c).to_numpy() for c in ("bucket", "x", "y", "own"))
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            cuts = [0, *cuts.tolist(), *([len(rows)] if batch is None else [])]
            for start, stop in itertools.pairwise(cuts):
                out = found(rows.slice(start, stop - start), (x[start], y[start]), own[start:stop]) if stop - start > 1 else None
                if out is not None and len(out):
                    yield out
            kept = rows.slice(cuts[-1]).to_batches()

    dealt = blocks.join(texts, "node").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return dealt.mapInArrow(run, "a binary, b binary")


def bucket_links(members: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b) between similar texts of a bucket, as many as make their classes: leaders first, then blocks."""
    links = leader_links(members, texts, idf, threshold)
    roots = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return links.unionByName(block_links(_blocks(members, roots), texts, idf, threshold))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, sig) for each band; a bucket is a hash of the band and its samples."""
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(BANDS)])
    return nodes.select(F.explode(keys).alias("bucket"), "node", "sig")


def near_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, root) of every document, and the verified links (src, dst) between different texts.

    ``node`` is the key of the text; ``root`` the smallest node of the class, null for texts without words.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    counts, n_docs = document_sketch(slim, "text")
    idf = idf_table(counts, n_docs)
    rows = stage(signatures(slim, "text", idf), "near-signatures")
    nodes = rows.where("sig is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    banded = _buckets(nodes)
    shared = stage(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "near-shared")
    members = stage(banded.join(shared, "bucket"), "near-members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("least").alias("doc_id"))
    # Joined by text and id, copies of one text lie in many tasks; one of them stays.
    wanted = wanted.withColumnsRenamed({"node": "n", "doc_id": "d"})
    one = slim.join(wanted, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    texts = stage(one.select("node", "text").dropDuplicates(["node"]), "near-texts")
    links = bucket_links(members, texts, idf, threshold)
    links = stage(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "near-edges")
    roots = connected_components(links)
    joined = rows.select("doc_id", "node", F.col("sig").isNotNull().alias("worded")).join(roots, "node", "left")
    root = F.when(F.col("worded"), F.coalesce("root", "node"))
    return joined.select("doc_id", "node", root.alias("root")), links


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the smallest id of the class), class_size and keep (the row that stays) of every document."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    rows, _ = near_classes(docs)
    rows = stage(rows, "near-classes")
    classes = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    out = rows.join(stage(classes, "near-sizes"), "root", "left")  # written, so that a large class can be split in the join
    class_id = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select(
        "doc_id",
        class_id.alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
        F.col("doc_id").eqNullSafe(class_id).alias("keep"),
    )
