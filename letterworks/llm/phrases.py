"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z) and split into pieces and words. Words of every block of
texts are counted first; those of ``min_count`` occurrences and more get numbers. Each
place where two such words follow each other in a piece is a suffix of at most
``max_words`` words, cut at the first infrequent word. Suffixes are routed globally by
their leading words: by two, or by as many more as it takes to keep a group small (a
frequent pair is divided by its third word, and so on; counts of prefixes come from
cells of hashes, over all texts). In a task the pointers of a group are sorted by
multikey three-way quicksort down to the last word: the size of an equal partition is
the count of its phrase, and partitions below ``min_count`` are abandoned unsorted.
Phrases shorter than the words that routed them are counted in parts and summed. A
whole phrase too frequent for one group is dealt over salts.

The score of a phrase is that of its weakest cut, in exact decimals.

Defined results: a null text has no words; a null language is ``und`` (as is one of that
name); repeated rows are documents of their own; phrases do not cross pieces or texts;
equal scores are ranked by count, then by phrase; texts of any length are read whole; other
columns of the table, whatever their names, are not read; an empty table gives an empty
result. Words are compared by 64-bit hashes of language and word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterworks.llm.substring_dedup import BLOCK_BYTES, CELL_BYTES, LEAST_BITS, Groups, count_cells
from letterworks.llm.textvec import BASE, Words, mix, pieces
from letterworks.session import prepare, stage, table

MAX_WORDS = 5
MIN_COUNT = 100
#: A phrase goes if a longer one has this share of its count, in hundredths.
INSIDE = 100
TOP = 2000
NO_LANG = "und"

#: Upper case to lower case; ends of pieces to line feeds.
_bytes = np.arange(256, dtype=np.uint8)
_bytes[65:91] += 32
_bytes[[ord(c) for c in ".,;:!?\x0b\x0c\r"]] = 10

BLOCK_SCHEMA = "block long, langs array<string>, totals array<long>, lang_of binary, ends binary, packed binary, size long, cells binary"


def lang_code(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "big"))


class Pieces:
    """Words of some texts, as hashes of language and word, and how many words are left in the piece at each."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, langs: np.ndarray):
        """``raw`` is already translated; ``langs``: the code of each text's language."""
        self.raw = raw
        w = self.words = Words(raw, offs)
        n = len(w.hashes)
        self.owner = w.owners()
        self.codes = mix(w.hashes ^ langs[self.owner]) if n else w.hashes
        ends = np.concatenate([[0], np.cumsum(raw == 10)])
        last = np.ones(n, bool)
        if n:
            last[:-1] = (ends[w.starts[1:]] > ends[w.ends[:-1]]) | (self.owner[1:] != self.owner[:-1])
        stops = np.flatnonzero(last)
        self.left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)

    def prefixes(self, longest: int) -> list[np.ndarray]:
        """For 2 to ``longest`` words the hash of so many words from each word on, as far as its piece goes."""
        n = len(self.codes)
        padded = np.concatenate([self.codes, np.zeros(longest, np.uint64)])
        out, found = np.zeros(n, np.uint64), []
        for k in range(longest):
            out = out * BASE + np.where(self.left > k, padded[k : k + n], np.uint64(0))
            if k:
                found.append(mix(out))
        return found


def _pack(rows: Iterator[pa.RecordBatch], longest: int, bits: int) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() << 32) - 1
    mask = np.uint64((1 << bits) - 1)
    for batch in rows:
        langs = batch.column(0).to_pylist()
        for first, raw, offs in pieces(batch.column(1), BLOCK_BYTES):
            number += 1
            raw = _bytes[raw]
            own = langs[first : first + len(offs) - 1]
            names = sorted(set(own))
            place = {x: i for i, x in enumerate(names)}
            lang_of = np.array([place[x] for x in own], np.int32)
            p = Pieces(raw, offs, np.array([lang_code(x) for x in names], np.uint64)[lang_of])
            at = p.left >= 2
            cells = [np.bincount((h[at] & mask).astype(np.int64), minlength=1 << bits) for h in p.prefixes(longest)]
            data = {
                "block": [number],
                "langs": [names],
                "totals": [np.bincount(lang_of[p.owner], minlength=len(names)).tolist()],
                "lang_of": [lang_of.tobytes()],
                "ends": [offs[1:].tobytes()],
                "packed": [pa.compress(raw.tobytes(), "zstd", asbytes=True)],
                "size": [len(raw)],
                "cells": [np.concatenate(cells).astype(np.uint32).tobytes()],
            }
            yield pa.RecordBatch.from_pydict(data)


def read_blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Pieces, np.ndarray, list[str]]]:
    for batch in rows:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            size = row["size"].as_py()
            raw = np.frombuffer(pa.decompress(row["packed"].as_buffer(), size, "zstd") if size else b"", np.uint8)
            offs = np.concatenate([np.zeros(1, np.int64), np.frombuffer(row["ends"].as_buffer(), np.int64)])
            names = row["langs"].as_py()
            lang_of = np.frombuffer(row["lang_of"].as_buffer(), np.int32)
            yield row, Pieces(raw, offs, np.array([lang_code(x) for x in names], np.uint64)[lang_of]), lang_of, names


def _words(rows: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The words of each block, each once with its count, in ranges of hashes."""
    for row, p, lang_of, names in read_blocks(rows):
        own, at, n = np.unique(p.codes, return_index=True, return_counts=True)
        if not len(own):
            continue
        part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        used, begins = np.unique(part, return_index=True)
        ends = np.append(begins[1:], len(own))
        raw = p.raw.tobytes()
        texts = [raw[a:b] for a, b in zip(p.words.starts[at].tolist(), p.words.ends[at].tolist(), strict=True)]
        langs = lang_of[p.owner[at]]
        data = {
            "part": used.astype(np.int32),
            "block": [row["block"].as_py()] * len(used),
            "langs": pa.array([names] * len(used), pa.list_(pa.string())),
            "hashes": [own[a:b].tobytes() for a, b in zip(begins, ends, strict=True)],
            "counts": [n[a:b].astype(np.int64).tobytes() for a, b in zip(begins, ends, strict=True)],
            "lang_of": [langs[a:b].tobytes() for a, b in zip(begins, ends, strict=True)],
            "words": [pa.compress(b"\n".join(texts[a:b]), "zstd", asbytes=True) for a, b in zip(begins, ends, strict=True)],
            "size": [sum(map(len, texts[a:b])) + int(b - a) - 1 for a, b in zip(begins, ends, strict=True)],
        }
        yield pa.RecordBatch.from_pydict(data)


def _number(group: pa.Table, parts: int, least: int) -> pa.Table:
    """Numbers of the frequent words of a range of hashes: a row for each block (its words' numbers, 0 for the others) and each word."""
    hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group.column("counts")])
    own, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, counts)
    often = total >= least
    part = group.column("part")[0].as_py()
    number = np.where(often, 1 + part + parts * np.cumsum(often), 0)
    if len(number) and number.max() >= 1 << 31:
        raise OverflowError("too many frequent words for 31 bits")
    number = number.astype(np.int32)
    cuts = np.cumsum([0, *map(len, hashes)])
    n_rows = len(hashes)
    out = {
        "part": [part] * n_rows,
        "block": group.column("block").to_pylist(),
        "numbers": [number[at[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
        "id": [None] * n_rows,
        "lang": [None] * n_rows,
        "word": [None] * n_rows,
        "n": [None] * n_rows,
    }
    wanted = np.flatnonzero(often)
    holder = np.searchsorted(cuts, first[wanted], "right") - 1
    for j in np.unique(holder).tolist():
        texts = pa.decompress(group.column("words")[j].as_buffer(), group.column("size")[j].as_py(), "zstd", asbytes=True).split(b"\n")
        lang_of, names = np.frombuffer(group.column("lang_of")[j].as_buffer(), np.int32), group.column("langs")[j].as_py()
        for k in wanted[holder == j].tolist():
            place = int(first[k] - cuts[j])
            out["part"].append(part)
            out["block"].append(None)
            out["numbers"].append(None)
            out["id"].append(int(number[k]))
            out["lang"].append(names[lang_of[place]])
            out["word"].append(texts[place].decode())
            out["n"].append(int(total[k]))
    types = {"part": pa.int32(), "block": pa.int64(), "numbers": pa.binary(), "id": pa.int32(), "lang": pa.string(), "word": pa.string(), "n": pa.int64()}
    return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})


def _suffixes(rows: Iterator[pa.RecordBatch], longest: int, groups: Groups) -> Iterator[pa.RecordBatch]:
    """The suffixes of each block, alike ones counted, by group."""
    for row, p, *_ in read_blocks(rows):
        own, at = np.unique(p.codes, return_inverse=True)
        if not len(own):
            continue
        numbers = np.concatenate([np.frombuffer(x["numbers"].as_buffer(), np.int32) for x in sorted(row["numbers"], key=lambda x: x["part"].as_py())])[at]
        n = len(numbers)
        padded = np.concatenate([numbers, np.zeros(longest, np.int32)])
        take = np.flatnonzero((p.left >= 2) & (numbers > 0) & (padded[1 : n + 1] > 0))
        if not len(take):
            continue
        cols = [numbers[take]]
        for k in range(1, longest):
            cols.append(np.where((p.left[take] > k) & (cols[-1] > 0), padded[take + k], 0).astype(np.int32))
        group, salt = groups.of([h[take] for h in p.prefixes(longest)], row["block"].as_py())
        key = np.zeros(len(take), np.uint64)
        for c in cols:
            key = key * BASE + c.astype(np.uint64)
        key = mix(key)
        by = np.lexsort((key, salt, group))
        new = np.ones(len(by), bool)
        alike = (key[by][1:] == key[by][:-1]) & (group[by][1:] == group[by][:-1]) & (salt[by][1:] == salt[by][:-1])
        new[1:] = ~alike
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(by))).astype(np.int32)
        chosen = by[heads]
        chosen_group, chosen_salt = group[chosen], salt[chosen]
        begins = np.flatnonzero(np.append(True, (chosen_group[1:] != chosen_group[:-1]) | (chosen_salt[1:] != chosen_salt[:-1])))
        ends = np.append(begins[1:], len(chosen))
        data = {
            "grp": chosen_group[begins],
            "salt": chosen_salt[begins],
            "records": [b"".join([*(c[chosen[a:b]].tobytes() for c in cols), counts[a:b].tobytes()]) for a, b in zip(begins, ends, strict=True)],
        }
        yield pa.RecordBatch.from_pydict(data)


def quicksort_counts(cols: list[np.ndarray], weight: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a pointer to it, words, count) of every phrase of two words or more that reaches ``least``.

    Multikey three-way quicksort: the pointers are divided by the word at the present
    depth into less, equal and greater; the equal ones go on with the next word. The
    sum of weights of the equal ones is the count of their common words; what is below
    ``least`` is abandoned. 0 stands for the end of a phrase.
    """
    found = []
    todo = [(np.arange(len(weight)), 0)]
    while todo:
        at, depth = todo.pop()
        keys = cols[depth][at]
        middle = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        for side in (keys < middle, keys > middle):
            part = at[side]
            if len(part) and weight[part].sum() >= least:
                todo.append((part, depth))
        same = at[keys == middle]
        n = int(weight[same].sum())
        if middle == 0 or n < least:
            continue
        if depth:
            found.append((int(same[0]), depth + 1, n))
        if depth + 1 < len(cols):
            todo.append((same, depth + 1))
    return found


def _sort(group: pa.Table, longest: int, least: int, depths: list[int]) -> pa.Table:
    """Phrases of a group with their counts; those that other groups share come with the part counted here."""
    parts = [np.frombuffer(x.as_buffer(), np.int32).reshape(longest + 1, -1) for x in group.column("records")]
    rows = np.concatenate(parts, axis=1)
    cols, weight = list(rows[:longest]), rows[longest].astype(np.int64)
    grp, salt = group.column("grp")[0].as_py(), group.column("salt")[0].as_py()
    routed = depths[grp] if salt < 0 else longest + 1
    ids, counts = [], []
    for at, size, n in quicksort_counts(cols, weight, least) if routed <= longest else []:
        if size >= routed:
            ids.append([int(c[at]) for c in cols[:size]])
            counts.append(n)
    for size in range(2, min(routed, longest + 1)):
        some = np.flatnonzero(cols[size - 1] > 0)
        by = some[np.lexsort([c[some] for c in reversed(cols[:size])])]
        if not len(by):
            continue
        new = np.ones(len(by), bool)
        new[1:] = np.any([c[by][1:] != c[by][:-1] for c in cols[:size]], axis=0)
        heads = np.flatnonzero(new)
        counts += np.add.reduceat(weight[by], heads).tolist()
        ids += np.stack([c[by[heads]] for c in cols[:size]], axis=1).tolist()
    return pa.table({"ids": pa.array(ids, pa.list_(pa.int32())), "f": pa.array(counts, pa.int64())})


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (id, lang, word, n), frequent phrases of two words or more (ids, f) and the words of each language (lang, n)."""
    if max_words < 2:
        raise ValueError("a phrase has at least 2 words")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    n_bytes = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, (n_bytes // CELL_BYTES).bit_length())
    blocks = stage(rows.mapInArrow(lambda it: _pack(it, max_words, bits), BLOCK_SCHEMA), "phrase-blocks")
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = count_cells(blocks)
    groups = Groups(counts.reshape(max_words - 1, -1) if len(counts) else np.zeros((max_words - 1, 1 << bits), np.int64), parallel)
    depths = [2 + k for k in groups.level]

    packed = blocks.select("block", "langs", "lang_of", "ends", "packed", "size")
    parts = max(parallel, n_bytes >> 24)
    schema = "part int, block long, langs array<string>, hashes binary, counts binary, lang_of binary, words binary, size long"
    words = packed.mapInArrow(lambda it: _words(it, parts), schema)
    numbered = words.groupBy("part").applyInArrow(lambda g: _number(g, parts, min_count), "part int, block long, numbers binary, id int, lang string, word string, n long")
    numbered = stage(numbered, "phrase-words")
    vocabulary = numbered.where("id is not null").select("id", "lang", "word", "n")
    of_block = numbered.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "numbers")).alias("numbers"))
    suffixes = packed.join(of_block, "block").mapInArrow(lambda it: _suffixes(it, max_words, groups), "grp long, salt long, records binary")
    found = suffixes.groupBy("grp", "salt").applyInArrow(lambda g: _sort(g, max_words, min_count, depths), "ids array<int>, f long")
    phrases = stage(found.groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "phrase-counts")
    totals = blocks.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    return vocabulary, phrases, stage(totals, "phrase-totals")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase that no longer one covers."""
    vocabulary, phrases, totals = phrase_counts(docs, text_col, lang_col, max_words, min_count)
    counts = phrases.unionByName(vocabulary.select(F.array("id").alias("ids"), F.col("n").alias("f")))
    size = F.size("ids")
    longer = phrases.where(size > 2).select(F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids"), "f")
    covers = longer.groupBy("ids").agg(F.max("f").alias("longest"))
    kept = phrases.join(covers, "ids", "left").where(f"longest is null or 100 * longest < {inside} * f").select("ids", F.col("f").alias("a"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("tail"))
    cuts = cuts.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    # The words of a phrase all have its language.
    spelled = kept.select("ids", F.posexplode("ids").alias("place", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(F.sort_array(F.collect_list(F.struct("place", "word")))["word"], " ").alias("phrase"))
    scored = cuts.join(spelled.join(totals, "lang"), "ids")
    scored = scored.withColumn("score", F.expr("(1000BD * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = scored.groupBy("ids", "lang", "phrase", "a", "n").agg(least)
    return best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("lang", "text")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT rid, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pn FROM (SELECT rid, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS ps FROM d)),
w AS (SELECT rid, lang, pn, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ws[i:i + m - 1] AS ph, m FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(ws)),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, ph, m, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY lang, ph, m HAVING count(*) >= 100),
s AS (SELECT lang, sub, max(f) AS longest FROM (SELECT lang, unnest([ph[1:m - 1], ph[2:m]]) AS sub, f FROM f WHERE m > 2) GROUP BY lang, sub),
c AS (SELECT f.lang, f.ph, f.m, f.f AS a FROM f LEFT JOIN s ON s.lang = f.lang AND s.sub = f.ph WHERE f.m >= 2 AND (longest IS NULL OR 100 * longest < 100 * f.f)),
k AS (SELECT c.*, u.k, x.f AS l, y.f AS r, n.n, CAST((1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c) u JOIN c USING (lang, ph, m, a)
      JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:u.k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[u.k + 1:c.m] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM b)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM o QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
