"""Removal of repeated passages with prefix-partitioned suffix trees over words.

A suffix is a place in a text where at least ``min_words`` words are left. Texts are
packed into blocks. The suffixes are dealt into groups by variable-length prefixes: a
suffix goes by the shortest of its prefixes that stands in no more than a group's worth
of places (counted over all texts in cells of hashed prefixes), and small prefixes share
a group. A task grows the subtree of its group from the top, one range of words after
the other; what has become a leaf is left alone, so only repeated prefixes are followed.
The internal nodes at a depth of ``min_words`` are the repeats: all places below such a
node but the first one repeat it, and repeats at successive places of a text join to
the maximal repeat. The prefix of a very frequent passage cannot be split further: its
places are dealt over salts, and the first place of every salt is compared again.

What is no repeat is screened before it is shuffled, without loss: equal windows
have the same smallest hash among the runs of half their words, so only windows whose
smallest run is found elsewhere become suffixes; of windows repeated in a block the first
goes on. Of exact copies of a text only the first takes part.

Order of places: smaller ``doc_id``, null last; then (ids that repeat) the key of the
text; then the place. Words are compared by 64-bit hashes of single words, windows by
128 bits of these.

Defined results: a null text has no words; a text of fewer than ``min_words`` words loses
none; repeated rows are documents of their own, and one of those alike in id and text
stays; texts are read whole, at any length; a text that keeps no word becomes empty; other
columns of the table, whatever their names, are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.llm.textvec import BASE, Words, mix, pieces
from letterworks.session import prepare, stage, table

MIN_WORDS = 20
#: Bytes of text in a block; a block holds at least one whole text.
BLOCK_BYTES = 1 << 21
#: Most suffixes in a group, and the fewest worth a group of their own.
MOST, LEAST = 1 << 22, 1 << 15
#: Bytes of text for each cell of prefixes, and the smallest number of cells as a power of two.
CELL_BYTES, LEAST_BITS = 1 << 28, 12
CHUNK = 1 << 12
NO_ID = np.iinfo(np.int64).max

BLOCK_SCHEMA = "block long, texts array<struct<doc_id:long,key:binary>>, ends binary, packed binary, size long, cells binary"
RECORD = (("id", np.int64), ("key", np.uint64), ("path", np.uint64), ("full", np.uint64), ("pos", np.uint32))
RECORD_BYTES = sum(np.dtype(t).itemsize for _, t in RECORD)


def prefix_depths(size: int) -> list[int]:
    """Lengths of the prefixes that may name a group."""
    return sorted({d for d in (1, 2, 4, 8) if d < size} | {size})


def range_depths(size: int) -> list[int]:
    """Ends of the ranges of words by which a subtree grows; the last is the whole window."""
    return [max(1, size * k // 5) for k in range(1, 5)] + [size]


def prefix_hashes(words: Words, depths: list[int]) -> dict[int, np.ndarray]:
    """For each depth the hash of so many words from each word on; no regard to ends of texts."""
    h, n = words.hashes, len(words.hashes)
    padded = np.concatenate([h, np.zeros(max(depths), np.uint64)])
    out, found = np.zeros(n, np.uint64), {}
    for k in range(max(depths)):
        out = out * BASE + padded[k : k + n]
        if k + 1 in depths:
            found[k + 1] = mix(out)
    return found


def window_starts(words: Words, size: int) -> np.ndarray:
    left = np.repeat(words.bounds[1:], words.counts()) - np.arange(len(words.hashes))
    return np.flatnonzero(left >= size)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[: len(x) - (width - span)], x[width - span :])


class Block:
    """Some whole texts: their words, windows and identities."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, size: int):
        self.raw, self.offs, self.size = raw, offs, size
        self.words = Words(raw, offs)
        self.at = window_starts(self.words, size)

    def screen(self) -> tuple[np.ndarray, np.ndarray]:
        """The smallest run of each window, and all runs, as hashes that are spread evenly (smallest ones are not)."""
        half = max(1, self.size // 2)
        runs = prefix_hashes(self.words, [half])[half]
        return mix(sliding_min(runs, self.size - half + 1)[self.at]), mix(runs)


def read_blocks(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[dict, Block]]:
    for batch in rows:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            raw = pa.decompress(row["packed"].as_buffer(), row["size"].as_py(), "zstd") if row["size"].as_py() else b""
            offs = np.concatenate([np.zeros(1, np.int64), np.frombuffer(row["ends"].as_buffer(), np.int64)])
            yield row, Block(np.frombuffer(raw, np.uint8), offs, size)


def _pack(rows: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() << 32) - 1
    mask = np.uint64((1 << bits) - 1)
    for batch in rows:
        ids = batch.column(0).to_pylist()
        for first, raw, offs in pieces(batch.column(1), BLOCK_BYTES):
            number += 1
            block = Block(raw, offs, size)
            hashes = prefix_hashes(block.words, prefix_depths(size))
            cells = [np.bincount((h[block.at] & mask).astype(np.int64), minlength=1 << bits) for h in hashes.values()]
            texts = [{"doc_id": ids[first + i], "key": hashlib.md5(raw[offs[i] : offs[i + 1]]).digest()} for i in range(len(offs) - 1)]
            data = {
                "block": [number],
                "texts": pa.array([texts], pa.list_(pa.struct([("doc_id", pa.int64()), ("key", pa.binary())]))),
                "ends": [offs[1:].tobytes()],
                "packed": [pa.compress(raw.tobytes(), "zstd", asbytes=True)],
                "size": [len(raw)],
                "cells": [np.concatenate(cells).astype(np.uint32).tobytes()],
            }
            yield pa.RecordBatch.from_pydict(data)


def _chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of a task's blocks, summed, in chunks."""
    total = None
    for batch in rows:
        for x in batch.column(0):
            one = np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64)
            total = one if total is None else total + one
    if total is not None:
        parts = [total[k : k + CHUNK].tobytes() for k in range(0, len(total), CHUNK)]
        yield pa.RecordBatch.from_pydict({"chunk": np.arange(len(parts), dtype=np.int32), "cells": parts})


def _sum_chunks(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in group.column("cells"))
    return pa.table({"chunk": group.column("chunk")[:1], "cells": pa.array([total.tobytes()], pa.binary())})


def count_cells(blocks: DataFrame) -> np.ndarray:
    """Suffixes in every cell of hashed prefixes. The number of cells follows the number of groups, not of suffixes."""
    parts = blocks.select("cells").mapInArrow(_chunks, "chunk int, cells binary").groupBy("chunk").applyInArrow(_sum_chunks, "chunk int, cells binary")
    found = sorted(parts.collect())
    return np.concatenate([np.frombuffer(r.cells, np.int64) for r in found]) if found else np.zeros(0, np.int64)


class Groups:
    """Which group a suffix goes to: per prefix length the group of each cell, -1 where a longer prefix is needed."""

    def __init__(self, counts: np.ndarray, parallel: int):
        total = int(counts[0].sum())
        self.most = int(np.clip(total // (4 * parallel), LEAST, MOST))
        self.mask = np.uint64(counts.shape[1] - 1)
        self.tables, self.n = [], 0
        #: Place of the prefix length that names each group.
        self.level: list[int] = []
        for k, c in enumerate(counts):
            fits = (c <= self.most) | (k == len(counts) - 1)
            sums = np.cumsum(np.where(fits, c, 0)) // self.most
            self.tables.append(np.where(fits, self.n + sums, -1).astype(np.int64))
            self.n += int(sums[-1]) + 1
            self.level += [k] * (self.n - len(self.level))
        #: Over how many salts the cells of whole windows are dealt.
        self.salts = np.maximum(1, -(-counts[-1] // self.most))

    def of(self, prefixes: list[np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray]:
        """Group and salt (-1 if the cell has one only) of suffixes, from their prefixes' hashes."""
        group = np.full(len(prefixes[0]), -1, np.int64)
        for h, groups in zip(prefixes, self.tables, strict=True):
            todo = group < 0
            deepest = todo
            group[todo] = groups[(h[todo] & self.mask).astype(np.int64)]
        n = self.salts[(prefixes[-1] & self.mask).astype(np.int64)]
        return group, np.where(deepest & (n > 1), block % n, -1)


def _screen(rows: Iterator[pa.RecordBatch], size: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The smallest runs of a block's windows, each once, in ranges of hashes."""
    for row, block in read_blocks(rows, size):
        least, runs = block.screen()
        own = np.unique(least)
        if not len(own):
            continue
        place = np.searchsorted(own, runs)
        place[place == len(own)] = 0
        many = np.bincount(place[own[place] == runs], minlength=len(own)) > 1
        part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        used, begins = np.unique(part, return_index=True)
        ends = np.append(begins[1:], len(own))
        data = {
            "part": used.astype(np.int32),
            "block": [row["block"].as_py()] * len(used),
            "hashes": [own[a:b].tobytes() for a, b in zip(begins, ends, strict=True)],
            "many": [np.packbits(many[a:b]).tobytes() for a, b in zip(begins, ends, strict=True)],
        }
        yield pa.RecordBatch.from_pydict(data)


def _flag(group: pa.Table) -> pa.Table:
    """Which runs of each block are found at two places or more."""
    hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
    many = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))[: len(h)] for x, h in zip(group.column("many"), hashes, strict=True)]
    _, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    found = (n[at] > 1) | np.concatenate(many).astype(bool)
    cuts = np.cumsum([0, *map(len, hashes)])
    bits = [np.packbits(found[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    n_own = pa.array(np.diff(cuts).astype(np.int64))
    return pa.table({"part": group.column("part"), "block": group.column("block"), "bits": pa.array(bits, pa.binary()), "n": n_own})


def _copies(row: dict, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[np.array(row["copies"].as_py() or [], np.int64)] = True
    return out


def _local(row: dict, block: Block) -> tuple[np.ndarray, np.ndarray, dict, dict]:
    """The windows of texts that are no copies; which of them are the first of their kind in the block; identity and hashes."""
    copy = _copies(row, len(block.offs) - 1)
    owner = block.words.owners()
    at = block.at[~copy[owner[block.at]]]
    texts = row["texts"].values
    ids = np.array([NO_ID if x is None else x for x in texts.field("doc_id").to_pylist()], np.int64)
    keys = np.array([int.from_bytes(k[:8], "big") for k in texts.field("key").to_pylist()], np.uint64)
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((keys, ids))] = np.arange(len(ids))
    depths = range_depths(block.size)
    hashes = prefix_hashes(block.words, sorted({*depths, *prefix_depths(block.size)}))
    path = np.zeros(len(at), np.uint64)
    for d in depths[:-1]:
        path = (path << np.uint64(16)) | (hashes[d][at] >> np.uint64(48))
    full = hashes[block.size][at]
    own = owner[at]
    by = np.lexsort((at, rank[own], path, full))
    new = np.ones(len(by), bool)
    new[1:] = (full[by][1:] != full[by][:-1]) | (path[by][1:] != path[by][:-1])
    first = np.zeros(len(at), bool)
    first[by[new]] = True
    return at, first, {"id": ids[own], "key": keys[own], "path": path, "full": full, "pos": at.astype(np.uint32)}, hashes


def _suffixes(rows: Iterator[pa.RecordBatch], size: int, groups: Groups) -> Iterator[pa.RecordBatch]:
    for row, block in read_blocks(rows, size):
        least, _ = block.screen()
        own = np.unique(least)
        flags = [np.unpackbits(np.frombuffer(x["bits"].as_buffer(), np.uint8))[: x["n"].as_py()] for x in sorted(row["flags"], key=lambda x: x["part"].as_py())]
        found = np.concatenate(flags).astype(bool)
        repeated = np.zeros(len(block.words.hashes), bool)
        repeated[block.at] = found[np.searchsorted(own, least)]
        at, first, record, hashes = _local(row, block)
        take = np.flatnonzero(first & repeated[at])
        if not len(take):
            continue
        number = row["block"].as_py()
        group, salt = groups.of([hashes[d][at[take]] for d in prefix_depths(size)], number)
        by = np.lexsort((take, salt, group))
        pair = np.stack([group[by], salt[by]])
        begins = np.flatnonzero(np.append(True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)))
        ends = np.append(begins[1:], len(by))
        sorted_ = {k: v[take[by]] for k, v in record.items()}
        data = {
            "grp": group[by][begins],
            "salt": salt[by][begins],
            "block": [number] * len(begins),
            "records": [b"".join(sorted_[k][a:b].astype(t).tobytes() for k, t in RECORD) for a, b in zip(begins, ends, strict=True)],
        }
        yield pa.RecordBatch.from_pydict(data)


def deep_nodes(path: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes below the deep internal nodes of a subtree, and the node of each.

    The subtree grows by one range of words at a time: every node's suffixes are
    divided by their next range, and those that are alone are leaves.
    """
    alive = np.arange(len(full))
    node = np.zeros(len(full), np.int64)
    for code in (*((path >> np.uint64(s)) & np.uint64(0xFFFF) for s in (48, 32, 16, 0)), full):
        next_ = code[alive]
        by = np.lexsort((next_, node))
        new = np.ones(len(by), bool)
        new[1:] = (node[by][1:] != node[by][:-1]) | (next_[by][1:] != next_[by][:-1])
        child = np.cumsum(new) - 1
        inner = (np.bincount(child)[child] > 1) if len(child) else np.zeros(0, bool)
        alive, node = alive[by][inner], child[inner]
    return alive, node


def _grow(group: pa.Table) -> pa.Table:
    """The subtree of a group: rows of (block, places that repeat an earlier one); of a salt also its first places, with their group."""
    blobs = [x.as_buffer() for x in group.column("records")]
    counts = [x.size // RECORD_BYTES for x in blobs]
    cols = {k: [] for k, _ in RECORD}
    for x, n in zip(blobs, counts, strict=True):
        begin = 0
        for k, t in RECORD:
            cols[k].append(np.frombuffer(x, t, n, begin))
            begin += n * np.dtype(t).itemsize
    r = {k: np.concatenate(v) for k, v in cols.items()}
    block = np.repeat(np.array(group.column("block").to_pylist(), np.int64), counts)
    alive, node = deep_nodes(r["path"], r["full"])
    by = np.lexsort((r["pos"][alive], r["key"][alive], r["id"][alive], node))
    alive, node = alive[by], node[by]
    new = np.ones(len(node), bool)
    new[1:] = node[1:] != node[:-1]
    out = {"grp": [], "block": [], "blob": []}

    def put(grp, chosen, blob):
        if not len(chosen):
            return
        chosen = chosen[np.lexsort((r["pos"][chosen], block[chosen]))]
        numbers, begins = np.unique(block[chosen], return_index=True)
        for b, a, e in zip(numbers.tolist(), begins, np.append(begins[1:], len(chosen)), strict=True):
            out["grp"].append(grp)
            out["block"].append(b)
            out["blob"].append(blob(chosen[a:e]))

    put(None, alive[~new], lambda x: r["pos"][x].tobytes())
    if group.column("salt")[0].as_py() >= 0:
        rest = np.ones(len(block), bool)
        rest[alive[~new]] = False
        put(group.column("grp")[0].as_py(), np.flatnonzero(rest), lambda x: b"".join(r[k][x].tobytes() for k, _ in RECORD))
    return pa.table({"grp": pa.array(out["grp"], pa.int64()), "block": pa.array(out["block"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})


def _apply(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each text without the words of its repeated windows."""
    for row, block in read_blocks(rows, size):
        at, first, *_ = _local(row, block)
        w = block.words
        n = len(w.hashes)
        hit = np.zeros(n, bool)
        hit[at[~first]] = True
        for x in row["repeats"].values if row["repeats"].is_valid else []:
            hit[np.frombuffer(x.as_buffer(), np.uint32)] = True
        steps = np.zeros(n + size, np.int64)
        places = np.flatnonzero(hit)
        np.add.at(steps, places, 1)
        np.add.at(steps, places + size, -1)
        gone = np.cumsum(steps)[:n] > 0
        counts = w.counts()
        copy = _copies(row, len(counts))
        gone |= np.repeat(copy & (counts >= size), counts)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.bounds])
        raw = block.raw.tobytes()
        kept, spans = [], []
        for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
            if not removed[i]:
                kept.append(b" ".join(raw[block.offs[i] : block.offs[i + 1]].split()))
                spans.append([])
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).reshape(-1, 2)
            cuts = np.concatenate([[0], edges.ravel(), [b - a]]).reshape(-1, 2) + a
            kept.append(b" ".join(x for s, e in cuts.tolist() if s < e for x in raw[w.starts[s] : w.ends[e - 1]].split()))
            spans.append([{"first": s, "last": e} for s, e in edges.tolist()])
        data = {
            "doc_id": row["texts"].values.field("doc_id"),
            "n_words": counts.astype(np.int64),
            "n_removed": removed.astype(np.int64),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        }
        yield pa.RecordBatch.from_pydict(data)


def dedup_substrings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the spans of removed words (first, and one after the last) of every row."""
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    spark = docs.sparkSession
    size = min_words
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_bytes = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, (n_bytes // CELL_BYTES).bit_length())
    blocks = stage(rows.mapInArrow(lambda it: _pack(it, size, bits), BLOCK_SCHEMA), "substring-blocks")
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = count_cells(blocks)
    groups = Groups(counts.reshape(len(prefix_depths(size)), -1) if len(counts) else np.zeros((len(prefix_depths(size)), 1 << bits), np.int64), parallel)

    # Exact copies: every row of a text but its first.
    texts = blocks.select("block", F.posexplode("texts").alias("idx", "t")).select("block", "idx", F.col("t.key").alias("key"), F.col("t.doc_id").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block", "idx")
    firsts = stage(texts.groupBy("key").agg(F.min(order).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "low"), "substring-firsts")
    copies = texts.join(firsts, "key").where(order > F.col("low")).groupBy("block").agg(F.collect_list("idx").alias("copies"))
    copies = stage(copies, "substring-copies")

    packed = blocks.select("block", "texts", "ends", "packed", "size")
    parts = max(parallel, n_bytes >> 24)
    runs = packed.mapInArrow(lambda it: _screen(it, size, parts), "part int, block long, hashes binary, many binary")
    flags = runs.groupBy("part").applyInArrow(_flag, "part int, block long, bits binary, n long")
    flags = flags.groupBy("block").agg(F.collect_list(F.struct("part", "bits", "n")).alias("flags"))
    flagged = packed.join(flags, "block").join(copies, "block", "left")
    record = "grp long, salt long, block long, records binary"
    suffixes = flagged.mapInArrow(lambda it: _suffixes(it, size, groups), record)
    grown = stage(suffixes.groupBy("grp", "salt").applyInArrow(_grow, "grp long, block long, blob binary"), "substring-repeats")
    again = grown.where("grp is not null").select("grp", F.lit(-1).cast("long").alias("salt"), "block", F.col("blob").alias("records"))
    again = again.groupBy("grp").applyInArrow(_grow, "grp long, block long, blob binary")
    repeats = grown.where("grp is null").unionByName(again).groupBy("block").agg(F.collect_list("blob").alias("repeats"))
    final = packed.join(repeats, "block", "left").join(copies, "block", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<first:long,last:long>>"
    return final.mapInArrow(lambda it: _apply(it, size), schema)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT rid, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM d),
k AS (SELECT *, CASE WHEN pos + 19 <= n THEN md5(array_to_string(list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), ' ')) END AS h FROM e),
r AS (SELECT *, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, rid, pos) > 1 AS again FROM k),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
o AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (rid)
"""
