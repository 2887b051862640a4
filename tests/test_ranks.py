"""Ranks of documents that are alike in the stems of a search."""

import pyarrow as pa

from letterworks.operators import postings


def test_documents_that_are_alike_are_ranked_once(monkeypatch):
    calls = []
    keep = postings.cover_rank
    monkeypatch.setattr(postings, "cover_rank", lambda plan, held: [calls.append(held), keep(plan, held)][1])
    plan = [{"branch": 0, "item": 0, "absent": False, "terms": ["haus"]}, {"branch": 0, "item": 1, "absent": False, "terms": ["07"]}]
    at = lambda a, b: [{"term": "07", "places": [{"pos": b, "weight": 0.1}]}, {"term": "haus", "places": [{"pos": a, "weight": 1.0}]}]
    words = [at(0, 1), at(0, 1), at(0, 3), at(0, 1), []]
    places = pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.struct([("pos", pa.int32()), ("weight", pa.float64())])))]))
    phrases = pa.list_(pa.struct([("branch", pa.int32()), ("item", pa.int32()), ("absent", pa.bool_()), ("terms", pa.list_(pa.string()))]))
    columns = {"key": pa.array(["q"] * 5), "doc_id": pa.array(range(5)), "plan": pa.array([plan] * 5, phrases), "words": pa.array(words, places), "seen": pa.array([f"q {w}" for w in words])}
    batch = pa.RecordBatch.from_pydict(columns)
    (one, two) = postings._ranked(iter([batch, batch]))
    held = [{x["term"]: {p["pos"]: p["weight"] for p in x["places"]} for x in w} for w in words]
    want = [keep(plan, h) for h in held]
    assert one["rank_score"].to_pylist() == two["rank_score"].to_pylist() == want and want[4] is None and want[0] != want[2]
    assert one["doc_id"].to_pylist() == list(range(5)) and len(calls) == 3
