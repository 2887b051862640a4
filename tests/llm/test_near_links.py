"""Near copies that their bucket's leader does not show."""

import collections

import numpy as np

from letterworks.llm import near_dedup


def classes(spark, rows):
    out, _ = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r.root].add(r.doc_id)
    return sorted(sorted(x) for x in got.values())


def test_pairs_among_many_that_share_a_passage(spark):
    """2200 texts of a common passage and a few words of their own (similarity about 0.6); 200 are near copies of one other."""
    rng = np.random.default_rng(11)
    passage = [f"p{k}" for k in range(150)]
    rows, want = [], []
    for i in range(2000):
        own = [f"o{i}x{k}" for k in range(8)]
        rows.append((i, " ".join(passage + own)))
        want.append([i])
        if i % 10 == 0:
            own[-1] = "edited"
            rows.append((10_000 + i, " ".join(passage + own)))
            want[-1].append(10_000 + i)
    rng.shuffle(rows)
    rows = [(int(i), str(t)) for i, t in rows]
    assert classes(spark, rows) == sorted(want)


def test_chains_of_versions(spark):
    """Each version is a near copy of the one before only; with the smallest node in the middle or at an end, all are one class."""
    rng = np.random.default_rng(12)
    rows, want = [], []
    for c in range(400):
        words = [f"c{c}w{k}" for k in range(200)]
        for v in range(3):
            for k in (30, 80, 130):  # three edits: similarity 0.86 to the version before, 0.74 to the one before that
                if v:
                    words[k + 10 * v] = f"c{c}v{v}k{k}"
            rows.append((10 * c + v, " ".join(words)))
        want.append([10 * c, 10 * c + 1, 10 * c + 2])
    rng.shuffle(rows)
    got = classes(spark, [(int(i), str(t)) for i, t in rows])
    whole = [x for x in got if len(x) == 3]
    assert all(x in want for x in whole) and len(whole) >= 0.99 * len(want)
