"""The positional index and web-search queries against a plain version that tries every stretch of words."""

import random
import re

import pytest

from letterworks.functions.stem import stem
from letterworks.operators import postings
from letterworks.operators.search import FIELD_WEIGHT

WORD = re.compile(r"\w+(?:[-./]\w+)*")
FIELDS = list(FIELD_WEIGHT)


def plain_words(row):
    out = []
    for f in FIELDS:
        out += [(stem(w), FIELD_WEIGHT[f]) for w in WORD.findall(row[f].lower())]
    return out


def plain_parse(q):
    """Branches of (needed, forbidden) lists of phrases."""
    branches, at = [([], [])], 0
    while at < len(q):
        m = re.compile(r'(-?)"([^"]*)"|(-?)(\w+(?:[-./]\w+)*)').match(q, at)
        if m is None or ("-" in (m[1], m[3]) and at and not q[at - 1].isspace()):
            at += 1
            continue
        at = m.end()
        if m[4] and m[4].lower() == "or" and not m[3]:
            branches.append(([], []))
            continue
        phrase = [stem(w) for w in WORD.findall((m[4] or m[2]).lower())]
        if phrase:
            branches[-1][m[1] == "-" or m[3] == "-"].append(phrase)
    return [b for b in branches if b[0] or b[1]]


def plain_rank(branches, words):
    """Rank by trying every stretch; None without a match."""
    stems, n = [w for w, _ in words], len(words)
    at = lambda p, i: stems[i : i + len(p)] == p
    inside = lambda p, a, b: any(at(p, i) for i in range(a, b - len(p) + 2))
    good = [b for b in branches if all(inside(p, 0, n - 1) for p in b[0]) and not any(inside(p, 0, n - 1) for p in b[1])]
    if branches and not good:
        return None
    needed = [b[0] for b in good if b[0]]
    holds = {(a, b) for a in range(n) for b in range(a, n) if any(all(inside(p, a, b) for p in x) for x in needed)}
    covers = [(a, b) for a, b in holds if (a + 1, b) not in holds and (a, b - 1) not in holds]
    asked = {i + k for x in needed for p in x for i in range(n) if at(p, i) for k in range(len(p))}
    r = 0.0
    for a, b in covers:
        own = [words[i][1] for i in range(a, b + 1) if i in asked]
        r += len(own) / sum(1 / w for w in own) / (1 + b - a + 1 - len(own))
    return r / (r + 1)


QUERIES = [
    "vertrag haus",
    '"haus 07 ag"',
    "Häuser -Verträge",
    'haus or "zwei drei"',
    '"eins zwei" OR drei -vier',
    "OR haus OR OR zwei OR",
    'eins "zwei eins" eins',
    "-haus",
    '-"eins zwei" or vierzehn',
    "a-b/c re-1",
    "re-1",
    "",
    '""',
    "fehlt haus",
    'kündigungen "des vertrags"',
    "x-haus -x",
]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    words = "haus häuser vertrag verträge vertrags eins zwei drei vier des kündigung 07 ag a-b/c x fehlte".split()
    some = lambda n: " ".join(draw.choice(words) for _ in range(draw.randrange(n)))
    return [dict(zip(FIELDS, (some(5), some(4), draw.choice(["", "RE-1", "re-2"]), some(3), some(14) + draw.choice([" ", "\n. "]) + some(9)), strict=True)) | {"doc_id": i} for i in range(60)]


def test_answers_are_those_of_a_plain_version(spark, rows, tmp_path):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", *FIELDS)) for r in rows], "doc_id long, " + ", ".join(f"{f} string" for f in FIELDS)).selectExpr("*", "cast(null as date) as document_date")
    path = str(tmp_path / "index")
    postings.write_postings(postings.build_postings(df), path, 4)
    index = postings.read_postings(spark, path)
    q = spark.createDataFrame([*enumerate(QUERIES), (99, "vertrag  haus")], "query_id long, q string")
    got = {(r.query_id, r.doc_id): r.score for r in postings.search_indexed(q, index, df, k=1000).collect()}
    want = {}
    for k, text in [*enumerate(QUERIES), (99, "vertrag haus")]:
        for r in rows:
            rank = plain_rank(plain_parse(text), plain_words(r))
            low = text.lower()
            same = r["identifier_text"].lower() == low
            if rank is not None or same:
                boosts = 2.0 * same + 0.8 * (r["organization_text"].lower() == low) + 0.6 * (low in r["title_text"].lower()) + 0.3 * (low in r["metadata_text"].lower())
                want[k, r["doc_id"]] = pytest.approx((rank or 0) + boosts, abs=2e-6)
    assert got == want
    assert len({k for k, _ in want}) >= 12


def test_stored_index_opens_only_the_folders_of_its_stems(spark, rows, tmp_path):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", *FIELDS)) for r in rows], "doc_id long, " + ", ".join(f"{f} string" for f in FIELDS))
    index = postings.build_postings(df)
    path = str(tmp_path / "index")
    postings.write_postings(index, path, 16)
    some = postings.read_postings(spark, path, ["haus", "vertrag"], 16)
    key = lambda r: (r.term, r.doc_id)
    assert sorted(some.collect(), key=key) == sorted(index.where("term in ('haus', 'vertrag')").collect(), key=key)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan and "In(term" in plan
    for r in index.collect():
        assert [p.pos for p in r.places] == sorted({p.pos for p in r.places})


def test_covers_hold_every_item():
    draw = random.Random(2)
    for _ in range(300):
        items = [sorted({(a, a + k) for a in draw.choices(range(25), k=draw.randrange(1, 6))}) for k in draw.choices((0, 0, 1, 2), k=draw.randrange(1, 4))]
        holds = {(a, b) for a in range(30) for b in range(a, 30) if all(any(a <= x and y <= b for x, y in i) for i in items)}
        assert postings.minimal_covers(items) == sorted((a, b) for a, b in holds if (a + 1, b) not in holds and (a, b - 1) not in holds)


def test_stored_filters_are_counted_as_by_a_plain_loop(spark):
    import datetime

    from letterworks.operators import search

    draw = random.Random(8)
    day = lambda: draw.choice([None, datetime.date(2020, 1, draw.randrange(1, 28))])
    some = lambda *x: draw.choice([None, *x])
    rows = [(i, some("a", "b"), some("x", "y"), some("r"), draw.choice([None, 7.25, float(draw.randrange(50)), draw.randrange(2000) / 100]), day()) for i in range(400)]
    filters = [(i, some("a", "b"), some("x"), some("r"), some(7.25, float(draw.randrange(30)), 49.0), some(7.25, float(draw.randrange(60))), day(), day()) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id int, life_area string, document_type string, status string, v double, document_date date").selectExpr("*", "cast(v as decimal(18,2)) as amount_value")
    saved = spark.createDataFrame(filters, "saved_id int, life_area string, document_type string, status string, lo double, hi double, date_from date, date_to date").selectExpr("*", "cast(lo as decimal(18,2)) as amount_min", "cast(hi as decimal(18,2)) as amount_max")
    fits = lambda test, bound: bound is None or test
    above = lambda v, lo: lo is None or v is not None and v >= lo
    below = lambda v, hi: hi is None or v is not None and v <= hi
    want = {f[0]: sum(all(fits(r[i] == f[i], f[i]) for i in (1, 2, 3)) and above(r[4], f[4]) and below(r[4], f[5]) and above(r[5], f[6]) and below(r[5], f[7]) for r in rows) for f in filters}
    found = search.run_saved_searches(saved, df)
    assert {r.saved_id: r.hits for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.hits for r in search.run_saved_searches(saved, df.limit(0)).collect()} == {0}
    assert search.run_saved_searches(saved.limit(0), df).collect() == []
    named = saved.selectExpr("*", "'o' as owner", "cast(saved_id % 100 as string) as name")
    good, bad = search.check_saved_searches(named)
    assert {(r.saved_id, r.reason) for r in bad.collect() if r.saved_id >= 100} == {(i, "name_in_use") for i in range(100, 120)}
    assert good.count() + bad.count() == 120


def test_queries_that_forbid_different_rare_phrases_share_their_matches(spark, monkeypatch):
    """Forty documents and thirty such queries are forty pairs and a few, not twelve hundred; answers stay those of the plain version."""
    docs = [dict(zip(FIELDS, ("Haus", "", "", "", f"vertrag x{i} y{i % 3}"), strict=True)) | {"doc_id": i} for i in range(40)]
    docs[3] |= {"title_text": "Haus -x3 Vertrag"}
    docs[4] |= {"identifier_text": "haus -x4"}
    docs[5] |= {"organization_text": "Haus -X7"}
    docs[6] |= {"metadata_text": "alt haus -x88 neu"}
    docs[9] |= {"body_text": "haus haus vertrag"}
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", *FIELDS)) for r in docs], "doc_id long, " + ", ".join(f"{f} string" for f in FIELDS)).selectExpr("*", "cast(null as date) as document_date")
    asked = [*[f"haus -x{i}" for i in range(30)], "haus -x8", "haus -x8 -x9", "haus -y1", "-x1 haus", 'haus -"vertrag x2" -y9', "haus or vertrag -x1"]
    pairs = []
    keep = postings.stage
    monkeypatch.setattr(postings, "stage", lambda frame, name: [out := keep(frame, name), name == "search-pairs" and pairs.append(out.count())][0])
    monkeypatch.setattr(postings, "SLACK", 10)
    q = spark.createDataFrame([*enumerate(asked)], "query_id long, q string")
    for k in (3, 1000):
        got = {(r.query_id, r.doc_id): r.score for r in postings.search_indexed(q, postings.build_postings(df), df, k=k).collect()}
        want = {}
        for n, text in enumerate(asked):
            scores = []
            for r in docs:
                rank, low = plain_rank(plain_parse(text), plain_words(r)), text.lower()
                same = r["identifier_text"].lower() == low
                if rank is not None or same:
                    scores.append((round((rank or 0) + 2.0 * same + 0.8 * (r["organization_text"].lower() == low) + 0.6 * (low in r["title_text"].lower()) + 0.3 * (low in r["metadata_text"].lower()), 6), r["doc_id"]))
            want |= {(n, d): pytest.approx(s, abs=2e-6) for s, d in sorted(scores, key=lambda x: (-x[0], str(x[1])))[:k]}
        assert got == want
    assert pairs[0] < 300
