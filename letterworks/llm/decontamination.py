"""Benchmark decontamination by an embedding of edit distance, bit sampling and exact verification.

A passage leaks an item if some run of the document's words is within
``MAX_EDITS`` (share of the item's words) word edits of it. Windows of the item's
size are embedded by the CGK random walk: at each step the symbol under the
walker is written, and a random bit of step and symbol says whether the walker
moves on; close windows fall into step again after each edit, so edit distance
becomes Hamming distance. Each repetition samples ``SAMPLES`` places of a walk of
its own as a hash. The number of repetitions is, for each class of item sizes, the
least that finds fresh copies with as many edits as allowed: ``COPIES`` of every group of
like sizes, half with substitutions only, half with edits of all kinds, and of the worst
group the lower confidence bound must reach ``RECALL``. Windows and items with an equal
hash are verified by exact alignment. Items of a class that ``MAX_REPEATS`` repetitions do
not bring to the target are aligned with every window that shares a seed with them instead.

Only windows that can hold a match are embedded: within the allowed edits at
least one run of ``q`` words of the item is untouched (q, at most 3, follows from the
item's length), and it fixes where the window would lie. That test loses nothing.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.
Defined results: null or wordless texts leak nothing, wordless items never match; items
of fewer than ``EXACT_BELOW`` words allow no edit and match word for word; repeated
items and documents give their own rows, null ids included; of windows with equally
few edits the first is reported; texts of any length are searched whole; other columns
of both tables, whatever their names, are not read; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.llm.textvec import BASE, Words, mix, pieces
from letterworks.session import prepare, table

MAX_EDITS = 0.2
RECALL = 0.99
SAMPLES = 2
MAX_REPEATS = 96
#: Edited copies of each group of sizes, groups of a class at most, and the normal quantile of the confidence bound (95 %).
COPIES, SIZE_GROUPS, QUANTILE = 1024, 8, 1.645
#: Smaller items allow no edit: they are looked up as they are.
EXACT_BELOW = ceil(1 / MAX_EDITS)
#: Bytes of items that are sent to all tasks at once; more are done in several passes.
BLOCK_BYTES = 16 << 20
PAD = np.uint64(0x5851F42D4C957F2D)


def allowed(m: int) -> int:
    return int(MAX_EDITS * m)


def seed_size(m: int) -> int:
    """Words of the longest run, up to 3, that survives the allowed edits somewhere in the item."""
    e = allowed(m)
    return max(1, min(3, (m - e) // (e + 1)))


def seed_hashes(h: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(max(len(h) - q + 1, 0), np.uint64)
    for k in range(q):
        out = out * BASE + h[k : k + len(out)]
    return mix(out)


class Walks:
    """Sampled places and the moves of every repetition, for sizes from ``low`` up to twice that."""

    def __init__(self, low: int, repeats: int):
        rng = np.random.default_rng(low)
        self.places = np.sort(rng.integers(0, 2 * low, (MAX_REPEATS, SAMPLES)), axis=1)[:repeats]
        self.moves = rng.integers(0, 1 << 63, (MAX_REPEATS, 2 * low), dtype=np.uint64)[:repeats] * np.uint64(2) + np.uint64(1)

    def keys(self, h: np.ndarray, start: np.ndarray, size: np.ndarray, repeat: int) -> np.ndarray:
        """The hash of each window ``h[start : start + size]`` in one repetition."""
        at = np.zeros(len(start), np.int64)
        key = np.full(len(start), np.uint64(repeat + 1))
        last = len(h) - 1
        for j in range(self.places[repeat, -1] + 1):
            symbol = np.where(at < size, h[np.minimum(start + at, last)], PAD)
            for _ in range(int((self.places[repeat] == j).sum())):
                key = mix(key * BASE + symbol)
            at += ((symbol * self.moves[repeat, j]) >> np.uint64(63)).astype(np.int64)
        return key


def size_class(m: np.ndarray | int):
    """The power of two at or below a size."""
    return 1 << (np.frexp(m)[1] - 1) if not isinstance(m, int) else 1 << (m.bit_length() - 1)


def edited(h: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """An item with ``n`` random edits."""
    out = h.tolist()
    for _ in range(n):
        kind, at = rng.integers(0, 3), int(rng.integers(0, max(len(out), 1)))
        if kind == 0 and out:
            out[at] = int(rng.integers(1, 1 << 63))
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, int(rng.integers(1, 1 << 63)))
    return np.array(out, np.uint64)


def substituted(h: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """An item with ``n`` other words in place of its own."""
    out = h.copy()
    out[rng.choice(len(h), n, replace=False)] = rng.integers(1, 1 << 63, n).astype(np.uint64)
    return out


def lower_bound(found: int, n: int) -> float:
    """Lower confidence bound of a share of which ``found`` of ``n`` were seen."""
    p, z = found / n, QUANTILE**2 / n
    return (p + z / 2 - (z * (p * (1 - p) + z / 4)) ** 0.5) / (1 + z)


def repeats_for(items: list[np.ndarray], walks: Walks, recall: float = RECALL, copies: int = COPIES) -> int | None:
    """The least number of repetitions that finds the copies of every group of sizes; None if ``walks`` has too few."""
    rng = np.random.default_rng(7)
    by_size = sorted(items, key=len)
    n_groups = min(len({len(h) for h in items}), max(1, min(SIZE_GROUPS, 512 // len(by_size[0]))))
    groups = [g for g in (by_size[k * len(by_size) // n_groups : (k + 1) * len(by_size) // n_groups] for k in range(n_groups)) if g]
    both, item, group = list(by_size), [], []
    number = 0
    for k, own in enumerate(groups):
        for c in range(max(copies, 2 * len(own))):
            i = (c // 2) % len(own)
            h = own[i]
            both.append((edited, substituted)[c % 2](h, allowed(len(h)), rng)[: len(h)])
            item.append(number + i)
            group.append(k)
        number += len(own)
    size = np.array([len(x) for x in both])
    start = np.cumsum(size) - size
    flat = np.concatenate(both)
    n = len(items)
    item, group = np.array(item), np.array(group)
    missed, of_group = np.arange(len(item)), np.bincount(group)
    for r in range(len(walks.places)):
        keys = walks.keys(flat, start[:n], size[:n], r)
        missed = missed[walks.keys(flat, start[n + missed], size[n + missed], r) != keys[item[missed]]]
        left = np.bincount(group[missed], minlength=len(of_group))
        if min(lower_bound(int(a - m), int(a)) for a, m in zip(of_group, left, strict=True)) >= recall:
            return r + 1
    return None


def alignment(item: np.ndarray, text: np.ndarray) -> int:
    """Least word edits between the item and any run of the text."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, symbol in enumerate(item.tolist()):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != symbol))
        new[0] = i + 1
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


class Index:
    """A block of items, ready to be looked up by the windows of documents."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids, self.items = [], []
        for i, text in zip(ids, texts, strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h = Words(raw, np.array([0, len(raw)]), fold=True, loose=True).hashes
            if len(h):
                self.ids.append(i)
                self.items.append(h)
        #: Sizes without edits -> sorted hashes of the items of that size, with the items.
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, EXACT_BELOW):
            own = np.array([i for i, h in enumerate(self.items) if len(h) == m], np.int64)
            if len(own):
                keys = np.array([seed_hashes(self.items[i], m)[0] for i in own], np.uint64)
                order = np.argsort(keys, kind="stable")
                self.exact[m] = keys[order], own[order]
        #: q -> sorted seeds, bounds of their places, and (offset in the item, size of the item) of each place.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        for h in self.items:
            if len(h) < EXACT_BELOW:
                continue
            q = seed_size(len(h))
            s = seed_hashes(h, q)
            found.setdefault(q, []).append(np.rec.fromarrays([s, np.arange(len(s)), np.full(len(s), len(h))], names="s,o,m"))
        for q, parts in found.items():
            rows = np.unique(np.concatenate(parts))
            seeds, first = np.unique(rows["s"], return_index=True)
            self.seeds[q] = seeds, np.append(first, len(rows)), np.stack([rows["o"], rows["m"]])
        flat = np.concatenate(self.items) if self.items else np.zeros(1, np.uint64)
        sizes = np.array([len(h) for h in self.items], np.int64)
        starts = np.cumsum(sizes) - sizes
        #: size class -> walks, and for each repetition sorted keys with their items.
        self.classes: dict[int, tuple[Walks, list[tuple[np.ndarray, np.ndarray]]]] = {}
        #: Sizes whose items are aligned with all their seeded windows, and these items by size.
        self.aligned: dict[int, np.ndarray] = {}
        classes = size_class(sizes) if len(sizes) else sizes
        for low in np.unique(classes).tolist():
            own = np.flatnonzero((classes == low) & (sizes >= EXACT_BELOW))
            if not len(own):
                continue
            walks, tables = Walks(low, MAX_REPEATS), []
            repeats = repeats_for([self.items[i] for i in own], walks)
            if repeats is None:
                self.aligned |= {m: own[sizes[own] == m] for m in np.unique(sizes[own]).tolist()}
                continue
            for r in range(repeats):
                keys = walks.keys(flat, starts[own], sizes[own], r)
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], own[order]))
            self.classes[low] = walks, tables
        self.item_seeds = {i: np.unique(seed_hashes(self.items[i], seed_size(len(self.items[i])))) for own in self.aligned.values() for i in own.tolist()}

    def windows(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """owner, start and size of every window that can hold a match, each once."""
        out = []
        h, stop = w.hashes, np.repeat(w.bounds[1:], w.counts())
        for q, (seeds, bounds, places) in self.seeds.items():
            s = seed_hashes(h, q)
            at = np.searchsorted(seeds, s)
            at[at == len(seeds)] = 0
            hit = np.flatnonzero((seeds[at] == s) & (np.arange(len(s)) + q <= stop[: len(s)]))
            lo, n = bounds[at[hit]], np.diff(bounds)[at[hit]]
            which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            pos = np.repeat(hit, n)
            owner = np.searchsorted(w.bounds, pos, "right") - 1
            offset, size = places[:, which]
            start = np.maximum(pos - offset, w.bounds[owner])
            out.append(np.stack([owner, start, np.minimum(size, w.bounds[owner + 1] - start)]))
        rows = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), np.int64)
        return rows[0], rows[1], rows[2]

    def _seeded(self, w: Words, owner: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """Windows and items to align for the items in ``aligned``: every window that begins where a seed of the item says."""
        out = []
        for m, items in self.aligned.items():
            q = seed_size(m)
            s = seed_hashes(w.hashes, q)
            for i in items.tolist():
                seeds = self.item_seeds[i]
                at = np.minimum(np.searchsorted(seeds, s), len(seeds) - 1)
                places = np.flatnonzero(seeds[at] == s)
                if len(places):
                    near = np.unique(np.searchsorted(w.bounds, places, "right") - 1)
                    first, last = np.searchsorted(places, w.bounds[near]), np.searchsorted(places, w.bounds[near + 1])
                    for text, a, b in zip(near.tolist(), first.tolist(), last.tolist(), strict=True):
                        own = np.flatnonzero((owner == text) & (start >= places[a] - m) & (start <= places[b - 1]))
                        out.append(np.stack([own, np.full(len(own), i)]))
        return out

    def _exact(self, w: Words) -> list[tuple[int, int, int, int, int]]:
        """The first place of each text where an item without edits stands."""
        out = []
        stop = np.repeat(w.bounds[1:], w.counts())
        for m, (keys, items) in self.exact.items():
            s = seed_hashes(w.hashes, m)
            lo, hi = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
            at = np.flatnonzero((hi > lo) & (np.arange(len(s)) + m <= stop[: len(s)]))
            owner = np.searchsorted(w.bounds, at, "right") - 1
            _, first = np.unique(np.stack([owner, lo[at]]), axis=1, return_index=True)
            for k in first.tolist():
                for j in range(lo[at[k]], hi[at[k]]):
                    out.append((int(owner[k]), int(items[j]), int(at[k] - w.bounds[owner[k]]), m, 0))
        return out

    def leaks(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word of the window, words of the item, edits) of each leak, the best for each text and item."""
        w = Words(raw, offs, fold=True, loose=True)
        if not self.items or not len(w.hashes):
            return []
        exact = self._exact(w)
        owner, start, size = self.windows(w)
        pairs = []
        # A window may be cut at the end of a text, so it is looked up among the items of its class and the next.
        for low, (walks, tables) in self.classes.items():
            own = np.flatnonzero((size_class(size) == low) | (size_class(size) * 2 == low))
            for r, (keys, items) in enumerate(tables if len(own) else []):
                k = walks.keys(w.hashes, start[own], size[own], r)
                lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                n = hi - lo
                which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                pairs.append(np.stack([np.repeat(own, n), items[which]]))
        pairs += self._seeded(w, owner, start)
        if not pairs:
            return exact
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i, item in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
            h = self.items[item]
            e = allowed(len(h))
            if best.get((owner[i], item), (1 << 30, 0))[0] == 0:
                continue
            lo, hi = w.bounds[owner[i]], w.bounds[owner[i] + 1]
            near = w.hashes[max(lo, start[i] - e) : min(hi, start[i] + len(h) + e)]
            if np.isin(h, near).sum() < len(h) - e:  # each other word of the item costs an edit
                continue
            edits = alignment(h, near)
            if edits <= e:
                best[owner[i], item] = min(best.get((owner[i], item), (1 << 30, 0)), (edits, int(start[i] - lo)))
        return exact + [(int(o), item, at, len(self.items[item]), edits) for (o, item), (edits, at) in best.items()]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The items in blocks of at most about ``BLOCK_BYTES``, whatever their number."""
    items = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, ceil(total / BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        yield Index([r.i for r in rows], [r.t for r in rows])


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item it leaks: doc_id, item_id, at_word, item_words, edits.

    Documents are read once for each block of items; nothing is shuffled. Ids are whole numbers or binary keys.
    """
    spark = docs.sparkSession
    kind = "binary" if dict(docs.dtypes)[id_col] == "binary" else "long"
    kinds = [pa.binary() if kind == "binary" else pa.int64()] + [pa.int64()] * 4
    schema = f"doc_id {kind}, item_id long, at_word long, item_words long, edits long"
    slim = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = []
                ids = batch.column(0)
                for first, raw, offs in pieces(batch.column(1)):
                    rows += [(ids[first + o].as_py(), index.ids[i], at, m, e) for o, i, at, m, e in index.leaks(raw, offs)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "at_word", "item_words", "edits"])

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
