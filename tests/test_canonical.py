"""Search rows from canonical fields against a plain version."""

import datetime
import json

from letterworks.operators import canonical


def scalars(v):
    if v is None or isinstance(v, bool):
        return []
    if isinstance(v, (list, dict)):
        return [x for y in (v.values() if isinstance(v, dict) else v) for x in scalars(y)]
    return [str(v)]


def values(meta, name):
    v = meta.get(name)
    if isinstance(v, dict):
        if name == "contract":
            return scalars(v.get("title")) + scalars(v.get("reference_identifier"))
        for key in canonical.PREFERRED.get(name, ()):
            if key in v:
                return scalars(v[key])
    return scalars(v)


METAS = [
    {},
    {"organization": {"name": "Haus AG", "organization_id": "x"}, "identifier": {"normalized": "RE-1", "value": "re 1"}, "amount": {"amount": "1.234,50 EUR", "currency": "EUR"}, "tags": ["a", "b", "a", ""]},
    {"organization": {"value": ["A", "B", "A"]}, "identifier": {"source": "s", "value": None}, "contract": {"title": "Vertrag", "reference_identifier": "V-1", "type": "hidden"}, "due_date": "2024-05-06"},
    {"organization": "Plain", "identifier": ["X-1", {"k": "X-2", "n": 7}], "contract": "just text", "deposit": {"a": [1, True, None, 2.5]}, "secret_note": "never", "tags": "one"},
    {"organization": None, "identifier": False, "valuation": 12, "invoice_total": "3,20"},
]


def test_only_canonical_fields_are_searchable(spark):
    rows = [(i, f"T{i}", None if i == 0 else "invoice", "finance" if i % 2 else None, datetime.date(2024, 1, 1 + i) if i else None, json.dumps(m), 10 + i if i % 2 else None) for i, m in enumerate(METAS)]
    rows.append((9, None, None, None, None, "broken json", 999))
    docs = spark.createDataFrame(rows, "doc_id int, title string, document_type string, life_area string, document_date date, canonical_metadata string, canonical_extraction_id int")
    texts = spark.createDataFrame([(11, "body one", ["p1", "p2"], "h1"), (13, "body three", ["q"], "h3")], "extraction_id int, text string, pages array<string>, content_hash string")
    got = {r.doc_id: r for r in canonical.build_canonical_projection(docs, texts).collect()}
    join = lambda x: "\n".join(dict.fromkeys(v for v in x if v))
    for i, m in enumerate(METAS):
        r = got[i]
        base = [rows[i][2] or "", rows[i][3] or "", rows[i][4].isoformat() if rows[i][4] else ""]
        want = (f"T{i}", join(values(m, "organization")), join(values(m, "identifier")), join(base + [x for f in sorted(canonical.METADATA_FIELDS) for x in values(m, f)]), join(values(m, "tags")))
        assert (r.title_text, r.organization_text, r.identifier_text, r.metadata_text, r.tags_text) == want, i
        assert (r.body_text, r.pages) == {1: ("body one", ["p1", "p2"]), 3: ("body three", ["q"])}.get(i, ("", []))
        assert "never" not in r.metadata_text
    assert (got[9].title_text, got[9].metadata_text, got[9].body_text) == ("", "", "")
    assert len({r.content_hash for r in got.values()}) == len(got)
    assert str(got[1].amount_value) == "1234.50" and str(got[4].amount_value) == "3.20" and got[0].amount_value is None
    other = canonical.build_canonical_projection(docs, texts.selectExpr("extraction_id", "text", "array('p1') as pages", "content_hash"))
    assert {r.doc_id for r in other.collect() if r.content_hash != got[r.doc_id].content_hash} == {1, 3}
