import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from letterworks.llm import decontamination, graph, near_dedup, textvec, warc

SF = "/root/testdata/sf0.001"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_words_are_the_words_of_the_texts():
    texts = ["", None, " a  b\tc\n", "x", "é A😀 ü", "   ", "end", "A-b c", "w" * 3000]
    for bound in (1, 1 << 20):
        seen, hashes = [], {}
        for first, raw, offs in textvec.pieces(pa.array(texts), bound):
            w = textvec.Words(raw, offs)
            for i in range(len(offs) - 1):
                span = range(w.bounds[i], w.bounds[i + 1])
                got = [raw[w.starts[k] : w.ends[k]].tobytes().decode() for k in span]
                assert got == re.findall(r"[^\x20\x09-\x0D]+", texts[first + i] or "")
                seen += got
                for k, word in zip(span, got, strict=True):
                    assert hashes.setdefault(word, w.hashes[k]) == w.hashes[k]
        assert len(set(hashes.values())) == len(hashes) and len(seen) == 11


def shingles(text):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_weights(rows):
    """Shingles of each (id, text) with their weights, from exact document frequencies."""
    s = [shingles(t) for _, t in rows]
    df = Counter(g for c in s for g in c)
    n = max(len(rows), 1)
    floor = max(1 / n, near_dedup.FLOOR_LOADS * sum(df.values()) / (1 << near_dedup.SKETCH_BITS) / n)
    idf = {g: 1 - np.log10(min(max(k / n, floor), 1)) / near_dedup.DAMPING for g, k in df.items()}
    return [{g: k * idf[g] for g, k in c.items()} for c in s]


def brute_links(rows):
    """Pairs of places whose weighted Jaccard similarity reaches the threshold."""
    s = brute_weights(rows)
    by = {}
    for i, c in enumerate(s):
        for g in c:
            by.setdefault(g, []).append(i)
    total = [sum(c.values()) for c in s]
    for a, b in {p for x in by.values() for p in itertools.combinations(x, 2)}:
        both = sum(min(w, s[b].get(g, 0)) for g, w in s[a].items())
        if both >= 0.8 * (total[a] + total[b] - both):
            yield a, b


def brute_classes(rows):
    """Classes of (id, text) by pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_links(rows):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


def test_near_classes_are_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    got = {r.doc_id: r.class_id for r in near_dedup.op5_near_dedup(spark, SF).collect()}
    assert got == brute_classes(rows)


def test_weights_are_those_of_exact_frequencies(spark):
    df = docs(spark).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    idf = near_dedup.idf_table(*near_dedup.document_sketch(df.select("text"), "text"))
    assert np.unique(idf).size > 8
    for (_, text), want in zip(rows, brute_weights(rows), strict=True):
        for _, raw, offs in textvec.pieces(pa.array([text])):
            got = near_dedup.weights(near_dedup.Shingles(raw, offs), idf)
            assert got.sum() == pytest.approx(sum(want.values()), rel=0.01)
            assert np.sort(got)[::-1][:5] == pytest.approx(sorted(want.values(), reverse=True)[:5], rel=0.01)


def test_groups_of_one_template(spark):
    """60 groups of 6 texts that all share a template: no linked pair is parted."""
    rng = np.random.default_rng(9)
    template = [f"t{k}" for k in range(100)]
    rows = []
    for g in range(60):
        own = [f"g{g}w{k}" for k in range(60)]
        for v in range(6):
            w = template + own
            for k in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[k] = f"e{g}v{v}k{k}"
            rows.append((len(rows), " ".join(w)))
    out, _ = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    root = {r.doc_id: r.root for r in out.collect()}
    pairs = list(brute_links(rows))
    assert len(pairs) > 200 and sum(root[a] == root[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert {(a // 6 == b // 6) for a, b in pairs} == {True} and len({(i // 6, r) for i, r in root.items()}) == len(set(root.values()))


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 9999, 150)]
    rows = []
    for i in range(300):
        w = list(base)
        w[int(rng.integers(0, 150))] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{x}" for x in rng.integers(0, 99999, 60))) for i in range(300)]
    out, links = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {}
    for r in out.collect():
        got.setdefault(r.root, []).append(r.doc_id)
    assert sorted(map(len, got.values()))[-1] == 300 and len(got) == 301
    assert links.count() < 3000  # stars, not pairs


def test_near_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, "One TWO"), (7, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as sig")
    out, _ = near_dedup.near_classes(df)
    got = sorted(((r.doc_id or 0, r.root is None, r.root) for r in out.collect()), key=repr)
    assert len(got) == len(rows) and sum(x[1] for x in got) == 3
    assert len({x[2] for x in got if x[2] is not None}) == 2
    assert near_dedup.near_classes(df.limit(0))[0].count() == 0


def test_samples_agree_as_often_as_weights_overlap():
    a = np.arange(400)
    texts = [" ".join(f"t{i}" for i in a), " ".join(f"t{i}" for i in np.append(a[:350], a[350:] + 10_000))]
    _, raw, offs = next(textvec.pieces(pa.array(texts)))
    s = near_dedup.Shingles(raw, offs)
    idf = near_dedup.idf_table(np.zeros((2, 1 << 20)), 10)
    assert (idf == 1.5).all()
    sim = near_dedup.similarity(pa.array(texts[:1]), pa.array(texts[1:]), idf)[0]
    assert abs(sim - 346 / (396 + 396 - 346)) < 1e-6
    x, y = near_dedup.draw(s, near_dedup.weights(s, idf))
    assert abs((x == y).mean() - sim) < 0.3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 3)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (a != b)))
        row = new
    return min(row)


@pytest.mark.parametrize("most", [decontamination.MAX_REPEATS, 3])
def test_leaks_are_brute_force(spark, monkeypatch, most):
    """With enough repetitions, and with so few that items are aligned with their seeded windows."""
    monkeypatch.setattr(decontamination, "MAX_REPEATS", most)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = np.random.default_rng(5)
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    for k in range(60):  # edited passages among other words
        w = items[k % len(items)][1].split()
        for _ in range(int(rng.integers(0, max(1, len(w) // 6)))):
            w[int(rng.integers(0, len(w)))] = "zzz"
        rows.append((10_000 + k, f"some words before {' '.join(w)} and after"))
    words = lambda t: [x.lower() for x in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t or "")]
    want = set()
    for i, text in items:
        item = words(text)
        vocabulary = set(item)
        for d, t in rows:
            w = words(t)
            if sum(x in vocabulary for x in w) >= 0.8 * len(item) and edit_distance_in(item, w) <= int(0.2 * len(item)):
                want.add((d, i))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontamination.find_leaks(df.selectExpr("*", "0 as item_id"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) >= 60
    (index,) = decontamination._blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert bool(index.aligned) == (most == 3) and bool(index.classes) == (most > 3)


def test_leaks_in_odd_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, "too short"), (4, "Alpha, beta gamma delta epsilon zeta")], "item_id long, text string")
    rows = [(1, None), (2, ""), (None, "alpha beta gamma delta epsilon zeta"), (4, "x " * 50_000 + "ALPHA beta gamma-delta epsilon\nzeta"), (5, "too short"), (4, "alpha")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id, r.edits) for r in decontamination.find_leaks(df, items).collect()))
    assert got == [(0, 1, 0), (0, 4, 0), (4, 1, 0), (4, 4, 0), (5, 3, 0)]
    assert decontamination.find_leaks(df, items.limit(0)).count() == 0
    assert decontamination.find_leaks(df.limit(0), items).count() == 0


@pytest.mark.parametrize("n_items", [1, 5, 40])
@pytest.mark.parametrize("size", [7, 25, 60, 100])
def test_recall_at_the_edit_limit(size, n_items):
    """Fresh copies with all the edits allowed, of benchmarks of few and of many items."""
    rng = np.random.default_rng(size + n_items)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [rng.choice(vocabulary, size + int(rng.integers(0, 3))).tolist() for _ in range(n_items)]
    index = decontamination.Index(list(range(n_items)), [" ".join(w) for w in items])
    found = planted = 0
    for k in range(400):
        item = k % n_items
        w = list(items[item])
        for at in rng.choice(len(w), decontamination.allowed(len(w)), replace=False):
            w[at] = f"zz{k}x{at}"
        raw = np.frombuffer(f"before it {' '.join(w)} after it".encode(), np.uint8)
        planted += 1
        found += item in {x[1] for x in index.leaks(raw, np.array([0, len(raw)]))}
    assert found >= 0.98 * planted


def test_repetitions_are_not_those_of_lucky_copies():
    rng = np.random.default_rng(0)
    items = [rng.integers(1, 1 << 63, 60).astype(np.uint64)]
    walks = decontamination.Walks(32, decontamination.MAX_REPEATS)
    few, many = decontamination.repeats_for(items, walks, copies=8), decontamination.repeats_for(items, walks)
    assert few is None and many >= 12  # eight copies cannot vouch for the recall
    assert decontamination.lower_bound(1024, 1024) > 0.99 > decontamination.lower_bound(256, 256)


def test_short_items_match_word_for_word(spark):
    items = spark.createDataFrame([(1, "alpha"), (2, "Beta gamma"), (3, "beta, gamma"), (4, "a b c d"), (5, "")], "item_id long, text string")
    rows = [(1, "x alpha alpha y"), (2, "beta gamm"), (3, "z Beta-GAMMA"), (4, "a b c"), (5, "d a b c d"), (6, "beta"), (7, "gamma alphabet")]
    got = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, 1, 0), (3, 2, 1, 2, 0), (3, 3, 1, 2, 0), (5, 4, 1, 4, 0)]


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, 7).astype(np.uint64), rng.integers(0, 4, 12).astype(np.uint64)
        assert decontamination.alignment(a, b) == edit_distance_in(a.tolist(), b.tolist())


@pytest.fixture
def pages(spark):
    big = "<p>" + "é" * 60_000
    rows = [(1, "http://a/1", "short"), (2, "http://a/2", "short"), (5, "http://a/5", big), (3, None, big), (4, "http://b/4", None), (None, "http://b/0", big), (6, "http://b/6", "")]
    rows += [(100 + i, f"http://c/{i}", "x" * (90 + i // 2)) for i in range(60)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as n")


def test_warc_round_trip(spark, pages, tmp_path):
    warc.write_warc(pages, str(tmp_path / "w"))
    rows = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert len(rows) == pages.count()
    assert (rows[3].record_type, rows[3].refers_to, rows[3].target_uri) == ("response", None, None)
    assert {(rows[i].record_type, rows[i].refers_to) for i in (5, None)} == {("revisit", 3)}
    assert rows[5].payload is None and rows[5].payload_bytes == rows[3].payload_bytes == 120_003
    assert rows[1].record_type == rows[2].record_type == "response" and bytes(rows[4].payload) == b""
    html = {r.page_id: r.html or "" for r in pages.collect()}
    assert all(bytes(r.payload).decode() == html[i] for i, r in rows.items() if r.payload is not None)
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_pushes_header_filters(spark, pages, tmp_path):
    warc.write_warc(pages, str(tmp_path / "w"))
    df = warc.read_warc(spark, str(tmp_path / "w")).where("record_type = 'revisit' and target_uri like 'http://c/%'")
    assert df.count() == sum(1 for i in range(60) if 90 + i // 2 >= 100 and i % 2)
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    from pyspark.sql.datasource import EqualTo, IsNotNull

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), IsNotNull(("page_id",))]))
    assert left == [IsNotNull(("page_id",))] and reader.wanted({"record_type": "response"}) and not reader.wanted({"record_type": "revisit"})


def test_foreign_archives(spark, tmp_path):
    import gzip

    data = [warc.record_bytes(i, f"http://x/{i}", b"p" * i * 5000, "ab", "response", None) for i in range(6)]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in data))
    for payload in (True, False):
        got = warc.read_warc(spark, str(tmp_path), payload).where("target_uri <> 'http://x/0'").collect()
        assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted((i, 5000 * i) for i in range(1, 6) for _ in range(2))
        assert all((r.payload is not None) == payload for r in got)


def test_many_records_in_a_member_and_damage(spark, tmp_path):
    import gzip

    data = [warc.record_bytes(i, f"http://x/{i}", bytes([65 + i]) * i * 5000, "ab", "response", None) for i in range(6)]
    one = gzip.compress(b"".join(data))
    (tmp_path / "one.warc.gz").write_bytes(one + gzip.compress(b"".join(data[:2])))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(data[0]) + gzip.compress(data[5])[:-30])
    (tmp_path / "cut.warc").write_bytes(b"".join(data[:3])[:-100])
    (tmp_path / "own.warc.gz").write_bytes(warc.member(data[1]) + warc.member(data[2])[:-20])
    (tmp_path / "junk.warc").write_bytes(b"no archive at all\r\n\r\n")
    (tmp_path / "zip.warc.gz").write_bytes(b"\x1f\x8b\x08")
    for payload in (True, False):
        rows = warc.read_warc(spark, str(tmp_path), payload).collect()
        got = {f: sorted((r.page_id, r.payload_bytes) for r in rows if r.file == f and r.record_type == "response") for f in {r.file for r in rows}}
        assert got == {
            "one.warc.gz": sorted([(i, 5000 * i) for i in range(6)] + [(0, 0), (1, 5000)]),
            "cut.warc.gz": [(0, 0)] if payload else got["cut.warc.gz"], "cut.warc": [(0, 0), (1, 5000)] if payload else got["cut.warc"],
            "own.warc.gz": [(1, 5000)] if payload else got["own.warc.gz"], "junk.warc": [], "zip.warc.gz": [],
        }
        assert sorted(r.file for r in rows if r.record_type == "damaged") == ["cut.warc", "cut.warc.gz", "junk.warc", "own.warc.gz", "zip.warc.gz"]
        assert all(bytes(r.payload) == bytes([65 + r.page_id]) * r.page_id * 5000 for r in rows if r.payload is not None)
    (r,) = warc.read_warc(spark, str(tmp_path)).where("target_uri = 'http://x/4'").collect()
    assert r.file == "one.warc.gz" and len(r.payload) == 20_000


def test_foreign_headers_cost_no_record(spark, tmp_path):
    """Other writers may use our headers' names for something else."""
    data = b"".join(warc.record_bytes(i, f"http://x/{i}", b"body" * 50, "ab", "response", None) for i in range(1, 4))
    for name, value in (("text", b"abc-17"), ("big", b"9" * 30), ("huge", b"9300000000000000000"), ("blank", b""), ("odd", "²".encode())):
        (tmp_path / f"{name}.warc").write_bytes(data.replace(b"X-Page-Id: 2\r\n", b"X-Page-Id: " + value + b"\r\nX-Target-URI: {broken\r\n"))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 15 and {r.record_type for r in rows} == {"response"}
    assert {(r.page_id, r.target_uri) for r in rows} == {(1, "http://x/1"), (None, "http://x/2"), (3, "http://x/3")}
    assert warc.read_warc(spark, str(tmp_path)).where("page_id is null").count() == 5


def test_urls_read_back_as_they_were(spark, tmp_path):
    urls = ["http://x/a  b", " lead", "tab\there", "two\r\nlines: x", "", "é ü", "plain", '"quoted"']
    df = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls)], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"))
    assert [r.target_uri for r in warc.read_warc(spark, str(tmp_path / "w")).orderBy("page_id").collect()] == urls
    assert warc.read_warc(spark, str(tmp_path / "w")).where("target_uri = 'http://x/a  b'").count() == 1
