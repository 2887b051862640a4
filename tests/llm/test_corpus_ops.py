"""Substring dedup, phrases and importance resampling against plain versions."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from letterworks.llm import importance, phrases, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WEIRD = [None, "", "   \n\t", "a", "é ü😀 b\x0bc", "x " * 700, "w" * 5000]


def brute_substrings(rows, size):
    """(id, kept text, spans) of rows in the order of their ids; ids are distinct."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        spans = [(g[0], g[-1] + 1) for k, g in ((k, list(g)) for k, g in itertools.groupby(range(len(w)), lambda i: gone[i])) if k]
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), spans))
    return out


def passages(seed, n):
    """Texts that share passages of many lengths, some of them very often, some within a text, and near copies."""
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefgh") + draw.choice("aeiou") + draw.choice(["", "n", "é"])
    shared = [" ".join(word() for _ in range(k)) for k in (3, 6, 7, 8, 15, 40)]
    hot = " ".join(word() for _ in range(12))
    texts = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(draw.randrange(30))) for _ in range(3)]
        parts += draw.sample(shared, 2) + [hot] * (i % 3)
        draw.shuffle(parts)
        texts.append(draw.choice([" ", "  ", "\n", " \t"]).join(parts))
    texts += texts[:20] + [texts[0]] * 30 + ["x1 " + t for t in texts[:5]] + [hot] * 7
    return texts


@pytest.mark.parametrize("size", [1, 2, 7, 20])
@pytest.mark.parametrize("small_groups", [False, True])
def test_repeated_passages_are_brute_force(spark, monkeypatch, size, small_groups):
    if small_groups:  # many groups, hot ones dealt over salts, blocks of few texts
        monkeypatch.setattr(substring_dedup, "LEAST", 40)
        monkeypatch.setattr(substring_dedup, "MOST", 40)
    texts = passages(size, 150) + WEIRD
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(1).shuffle(ids)
    rows = list(zip([None, *ids[1:]], texts, strict=True))
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, kept_text string").repartition(5)
    got = substring_dedup.dedup_substrings(df, min_words=size).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text, [tuple(s) for s in r.spans]) for r in got), key=lambda r: (r[0] is None, r[0]))
    assert got == brute_substrings(rows, size)


def test_one_of_repeated_rows_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text)] * 5 + [(2, text), (None, text), (None, "short")], "doc_id long, text string").repartition(3)
    got = substring_dedup.dedup_substrings(df).collect()
    assert sorted(r.n_removed for r in got) == [0, 0] + [30] * 6
    assert {r.doc_id for r in got if r.n_removed == 0 and r.n_words == 30} == {1}
    empty = substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "n_removed", "kept_text", "spans"]


def test_deep_nodes_are_the_equal_windows():
    draw = np.random.default_rng(3)
    path, full = draw.integers(0, 3, 500).astype(np.uint64) << np.uint64(16), draw.integers(0, 40, 500).astype(np.uint64)
    alive, node = substring_dedup.deep_nodes(path, full)
    want = Counter(zip(path.tolist(), full.tolist(), strict=True))
    below = {}
    for i, k in zip(alive.tolist(), node.tolist(), strict=True):
        below.setdefault(k, []).append((int(path[i]), int(full[i])))
    assert all(len(set(x)) == 1 and len(x) == want[x[0]] for x in below.values())
    assert len(alive) == sum(n for n in want.values() if n > 1)


def brute_phrases(rows, longest, least, inside=100):
    """{(lang, phrase): (a, l, r, n, score)}."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    f = Counter({k: v for k, v in f.items() if v >= least})
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or any(f.get((lang, q), 0) * 100 >= inside * a for (la, q) in f if la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    return out


@pytest.mark.parametrize("inside", [100, 60])
@pytest.mark.parametrize("small_groups", [False, True])
def test_phrases_are_brute_force(spark, monkeypatch, inside, small_groups):
    if small_groups:
        monkeypatch.setattr(substring_dedup, "LEAST", 30)
        monkeypatch.setattr(substring_dedup, "MOST", 30)
    draw = random.Random(5)
    texts = passages(5, 120) + [f"The Hot pair {draw.choice('xyz')}{i % 9}, the hot pair; of all The hot Pair" for i in range(90)] + WEIRD
    rows = [(draw.choice(["en", "de", None, "und"]), t) for t in texts]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "lang string, text string, score int").repartition(5)
    got = phrases.collocations(df, max_words=4, min_count=12, inside=inside).collect()
    assert len(got) > 100
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in got} == brute_phrases(rows, 4, 12, inside)
    assert len({(r.lang, r.phrase) for r in got}) == len(got)


def test_phrases_of_nothing(spark):
    for rows in ([], [("en", None), (None, "")]):
        assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_quicksort_counts_prefixes():
    draw = np.random.default_rng(1)
    cols = [draw.integers(1, 4, 400) for _ in range(3)]
    cols.append(draw.integers(0, 3, 400))
    weight = draw.integers(1, 4, 400)
    want = Counter()
    for row in zip(*cols, weight, strict=True):
        for m in (2, 3, 4):
            if row[m - 1]:
                want[tuple(map(int, row[:m]))] += int(row[4])
    got = {tuple(int(c[at]) for c in cols[:m]): n for at, m, n in phrases.quicksort_counts(cols, weight, 8)}
    assert got == {k: v for k, v in want.items() if v >= 8}


def test_products_past_64_bits_are_exact(spark):
    big = 10**15 + 7
    row = spark.createDataFrame([(big, big - 2, 3 * 10**9 + 1, 10**9 + 7)], "a long, n long, l long, r long")
    made = "(1000BD * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    assert row.selectExpr(made).first()[0] == 1000 * big * (big - 2) // ((3 * 10**9 + 1) * (10**9 + 7))


def grams(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    return w, [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


@pytest.mark.parametrize("ngram", [1, 3])
@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_features_are_the_hashes_of_the_runs(monkeypatch, ngram, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    for text in ["", None, "A", "One, two-THREE four", "x_y é1É\x00b", "a b c d e f g h i", "  . ", "Ünï cödé über " * 9]:
        words, want = grams(text, ngram)
        parts = list(importance.features(text, ngram))
        assert sum(k for k, _ in parts) == len(words)
        assert Counter(h for _, x in parts for h in x) == Counter(zlib.crc32(g.encode()) for g in want)


def test_weights_and_draw_are_brute_force(spark):
    import hashlib

    texts = passages(9, 60) + WEIRD + ["Same text of more than nothing"] * 3
    target = [texts[3], texts[5], None, "other words entirely"]
    ids = [None, 7, 7, *range(20, 20 + len(texts) - 3)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("weight", importance.F.lit("x"))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, bench, ngram=2, buckets=50, min_words=5, percent=30).collect()
    bucket = lambda g: zlib.crc32(g.encode()) % 50
    s = Counter(bucket(g) for t in texts for g in grams(t, 2)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, 2)[1])
    s_all, t_all = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 50) / ((s[b] + 1) * (t_all + 50)))) for b in range(50)]
    rows = []
    for i, text in zip(ids, texts, strict=True):
        words, runs = grams(text, 2)
        weight = sum(gain[bucket(g)] for g in runs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= 5), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    want = [(*r, k if k <= 30 * len(able) // 100 else None) for k, r in enumerate(able, 1)] + [(*r, None) for r in rows if r[1] < 5]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    empty = importance.resample(df.limit(0), bench.limit(0))
    assert empty.collect() == []
