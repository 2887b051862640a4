"""Queries for the scalar functions and the extraction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterworks.functions import text as T
from letterworks.functions.spans import once
from letterworks.operators import constraints as K
from letterworks.operators import extract as X
from letterworks.plans import frames as fr
from letterworks.plans.registry import query
from letterworks.session import prepare, spread, table

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _docs(spark, sf):
    return table(prepare(spark), sf, "documents")


def dirty(spark, sf):
    """Documents spoiled in a known way by doc_id % 4."""
    k = F.col("doc_id") % 4
    text = (
        F.when(k == 0, F.replace("text", F.lit("\n"), F.lit("\r\n")))
        .when(k == 1, F.replace("text", F.lit("\n"), F.lit("  \n")))
        .when(k == 2, F.replace("text", F.lit("\n"), F.lit("\n\n\n\n")))
        .otherwise(F.concat("text", F.lit("\nＡ１")))
    )
    return _docs(spark, sf).select("doc_id", text.alias("text"))


@query(f"""SELECT doc_id, sha256(trim(CASE doc_id % 4 WHEN 2 THEN regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')
  WHEN 3 THEN text || chr(10) || 'A1' ELSE text END, {WS})) AS h FROM documents""")
def o08_normalize_text(spark, sf):
    return dirty(spark, sf).select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("h"))


@query("""WITH q AS (SELECT item_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^ | $', '', 'g') AS q FROM benchmark),
t AS (SELECT item_id, q, unnest(regexp_extract_all(q, '[\\p{L}\\p{N}_]+(?:[-./][\\p{L}\\p{N}_]+)*')) AS term, generate_subscripts(regexp_extract_all(q, '[\\p{L}\\p{N}_]+(?:[-./][\\p{L}\\p{N}_]+)*'), 1) AS i FROM q),
f AS (SELECT item_id, q, term, i, row_number() OVER (PARTITION BY item_id, replace(lower(term), 'ß', 'ss') ORDER BY i) AS rn FROM t)
SELECT item_id, any_value(q) AS normalized, string_agg(term, '|' ORDER BY i) FILTER (WHERE rn = 1) AS terms FROM f GROUP BY item_id""")
def o09_query_terms(spark, sf):
    q = table(prepare(spark), sf, "benchmark").select("item_id", T.normalize_query(F.col("text")).alias("normalized"))
    return once(q, "normalized").withColumn("terms", F.array_join(T.query_terms(F.col("normalized")), "|"))


@query(f"WITH {fr.ORGS}, {fr.ALIASES} SELECT org_id, alias, trim(regexp_replace(replace(lower(alias), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS normalized FROM aliases")
def o10_normalize_name(spark, sf):
    return fr.aliases(spark, sf).select("org_id", "alias", T.normalize_name(F.col("alias")).alias("normalized"))


@query("""SELECT s_suppkey AS id, upper(regexp_replace(' de ' || lpad(s_suppkey::VARCHAR, 4, '0') || ' x', '\\s+', '', 'g')) AS identifier,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'company_number:' || upper('hrb' || s_suppkey || 'ab') || ',' END || 'tax_id:DE' || lpad(s_suppkey::VARCHAR, 5, '0') AS strong FROM supplier""")
def o11_strong_identifiers(spark, sf):
    k = F.col("s_suppkey")
    company = F.when(k % 3 != 0, F.concat(F.lit("hrb "), k.cast("string"), F.lit("-ab"))).otherwise("a-1")
    nested = F.struct(F.concat(F.lit("de/"), F.lpad(k.cast("string"), 5, "0")).alias("tax_id"))
    payload = F.to_json(F.struct(company.alias("company_number"), nested.alias("strong_identifiers")))
    spaced = F.concat(F.lit(" de "), F.lpad(k.cast("string"), 4, "0"), F.lit(" x"))
    return table(prepare(spark), sf, "supplier").select(k.alias("id"), T.normalize_identifier(spaced).alias("identifier"), F.array_join(T.strong_identifiers(payload), ",").alias("strong"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS german, CAST(o_orderdate AS DATE) AS iso FROM orders""")
def o12_parse_dates(spark, sf):
    d = F.col("o_orderdate").cast("date")
    german = F.when(F.col("o_orderkey") % 7 == 0, F.lit("31.02.2023")).otherwise(F.date_format(d, "d.M.yyyy"))
    iso = F.concat(d.cast("string"), F.lit("T10:00:00Z"))
    return table(prepare(spark), sf, "orders").select(F.col("o_orderkey").alias("id"), T.parse_german_date(german).alias("german"), T.parse_iso_prefix(iso).alias("iso"))


@query("SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders")
def o13_parse_amounts(spark, sf):
    text = F.concat(F.translate(F.format_number(F.col("o_totalprice"), 2), ",.", ".,"), F.lit(" EUR"))
    return table(prepare(spark), sf, "orders").select(F.col("o_orderkey").alias("id"), T.parse_german_amount(text).alias("amount"))


def meta(spark, sf):
    """Canonical metadata of orders as JSON: an amount as an object or a scalar, names, identifiers and tags."""
    k = F.col("o_orderkey")
    amount = F.translate(F.format_number(F.col("o_totalprice"), 2), ",.", ".,")
    plain = F.format_string("%.2f", F.col("o_totalprice"))
    fields = F.struct(
        F.when(k % 3 == 0, F.struct(F.concat(amount, F.lit(" EUR")).alias("amount"), F.lit("EUR").alias("currency"))).alias("invoice_total"),
        F.when(k % 3 == 1, plain).alias("premium"),
        F.when(k % 5 == 0, F.lit("9,99 EUR")).alias("other_amount"),
        F.struct(F.concat(F.lit("Haus "), (F.col("o_custkey") % 97).cast("string")).alias("name"), F.lit("x").alias("note")).alias("organization"),
        F.array(F.concat(F.lit("tag"), (k % 4).cast("string")), F.lit("all")).alias("tags"),
    )
    rows = spread(table(prepare(spark), sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    return once(rows.select(k.alias("doc_id"), F.to_json(fields).alias("meta")), "meta")  # as stored, not made anew for every field


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN o_orderkey % 5 = 0 THEN 9.99::DECIMAL(18,2) END AS amount FROM orders""")
def o14_canonical_amount(spark, sf):
    return meta(spark, sf).select("doc_id", T.canonical_amount(F.col("meta")).alias("amount"))


@query("""SELECT o_orderkey AS doc_id, 'Haus ' || (o_custkey % 97) AS organization, 'tag' || (o_orderkey % 4) || '|all' AS tags, 'Haus ' || (o_custkey % 97) || '|x|tag' || (o_orderkey % 4) || '|all' AS leaves FROM orders""")
def o15_flatten_scalars(spark, sf):
    m = F.col("meta")
    part = F.to_json(F.struct(F.get_json_object(m, "$.organization.name").alias("a"), F.get_json_object(m, "$.organization.note").alias("b"), F.from_json(F.get_json_object(m, "$.tags"), "array<string>").alias("c"), F.lit(True).alias("d")))
    return meta(spark, sf).select(
        "doc_id",
        F.array_join(T.field_values(m, "organization"), "|").alias("organization"),
        F.array_join(T.field_values(m, "tags"), "|").alias("tags"),
        F.array_join(T.flatten_scalars(part, "string"), "|").alias("leaves"),
    )


@query("""SELECT doc_id, sha256(text) AS text_hash, sha256('{"doc_id":' || doc_id || ',"source":"' || source || '"}') AS identity FROM documents""")
def o16_content_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", T.text_hash(F.col("text")).alias("text_hash"), T.content_hash(F.col("doc_id"), F.col("source")).alias("identity"))


@query(f"""WITH {fr.LETTERS} SELECT doc_id, CAST(sum(CASE WHEN e < 25 THEN 1 ELSE 0 END) + 1 AS INTEGER) AS page FROM
 (SELECT doc_id, sum(length(l) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2 AS e, i, count(*) OVER (PARTITION BY doc_id) AS n FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM letters)) GROUP BY doc_id
 HAVING max(e) >= 25 UNION ALL SELECT doc_id, 1 FROM letters WHERE length(replace(text, chr(10), '  ')) < 25""")
def o17_page_for_offset(spark, sf):
    pages = F.split(F.col("text"), "\n")
    return fr.letters(spark, sf).select("doc_id", T.page_for_offset(pages, F.lit(25)).cast("int").alias("page"))


_GRAMS = """list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^0-9a-zäöüß]+', ' ', 'g'), ' '), lambda w: length(w) >= 3),
  lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))))"""


@query(f"""WITH g AS (SELECT c_custkey AS id, {_GRAMS.format("c_name || ' ' || c_mktsegment")} AS a, {_GRAMS.format("'Customer building' || c_nationkey")} AS b FROM customer)
SELECT id, len(a) AS n_trigrams, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) END AS similarity FROM g""")
def o18_trigram_similarity(spark, sf):
    a, b = F.concat("c_name", F.lit(" "), "c_mktsegment"), F.concat(F.lit("Customer building"), F.col("c_nationkey").cast("string"))
    return table(prepare(spark), sf, "customer").select(F.col("c_custkey").alias("id"), F.size(T.char_trigrams(a)).cast("long").alias("n_trigrams"), F.round(T.trigram_similarity(a, b), 6).alias("similarity"))


@query("""WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '\\s', '', 'g'))) AS c FROM documents),
s AS (SELECT doc_id, list_sum(c) AS total, len(list_filter(c, lambda x: x < 10)) AS empty, len(list_filter(c, lambda x: x >= 40)) AS useful, len(c) AS n FROM p)
SELECT doc_id, CAST(total AS INTEGER) AS total, CAST(empty AS INTEGER) AS empty, CAST(useful AS INTEGER) AS useful, total < 40 * n OR useful < n AS required,
 CASE WHEN total < 40 * n OR useful < n THEN (n - useful) || '_of_' || n || '_pages_without_usable_text' ELSE 'embedded_text_sufficient' END AS reason FROM s""")
def o19_text_usability(spark, sf):
    return _docs(spark, sf).select("doc_id", T.text_usability(F.split("text", "\n")).alias("u")).select("doc_id", "u.*")


@query("""SELECT doc_id, 'length=' || length(text) || ' sha256=' || sha256(text) AS content, substr(text, 1, 500) AS preview, 'integer' AS id_type, 'string' AS text_type, 'name' AS keys FROM documents""")
def o20_redact(spark, sf):
    keys = T.sanitize_map(F.create_map(F.lit("name"), F.lit("a"), F.lit("api_token"), F.lit("b"), F.lit("Full_Text"), F.lit("c")))
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id",
        T.redact(F.lit("content"), t).alias("content"),
        T.redact(F.lit("title"), t).alias("preview"),
        T.json_type(F.col("doc_id").cast("string")).alias("id_type"),
        T.json_type(F.concat(F.lit('"'), "lang", F.lit('"'))).alias("text_type"),
        F.array_join(F.map_keys(keys), ",").alias("keys"),
    )


@query("""SELECT doc_id, CAST(greatest(0.2, round(0.3 + (doc_id % 7) * 0.1 - CASE WHEN doc_id % 2 = 0 THEN 0.12 ELSE 0 END - CASE WHEN doc_id % 3 = 0 THEN 0.12 ELSE 0 END, 2)) AS DOUBLE) AS confidence,
 CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'competing_candidates,ocr_sensitive_value' WHEN doc_id % 2 = 0 THEN 'competing_candidates' WHEN doc_id % 3 = 0 THEN 'ocr_sensitive_value' ELSE '' END AS notes FROM documents""")
def o21_confidence(spark, sf):
    k = F.col("doc_id")
    many, ocr = k % 2 == 0, k % 3 == 0
    return _docs(spark, sf).select("doc_id", F.round(T.confidence(0.3 + (k % 7) * 0.1, ocr, many), 6).alias("confidence"), F.array_join(T.confidence_notes(ocr, many), ",").alias("notes"))


def _found(spark, sf, kind):
    return X.findings(fr.letters(spark, sf), kinds=(kind,))


_TYPE = "CASE t WHEN 0 THEN 'invoice' WHEN 1 THEN 'contract' WHEN 2 THEN 'contract' ELSE 'official_letter' END"
_SURE = "CASE t WHEN 0 THEN 0.94 WHEN 1 THEN 0.92 WHEN 2 THEN 0.92 ELSE 0.9 END"


@query(f"WITH {fr.BASE} SELECT doc_id, {_TYPE} AS document_type, CAST({_SURE} AS DOUBLE) AS confidence FROM base WHERE t < 4")
def o22_document_type(spark, sf):
    return _found(spark, sf, "type").select("doc_id", F.col("value").alias("document_type"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {fr.BASE} SELECT doc_id, CASE WHEN t = 0 THEN 'finance' ELSE 'personal' END AS life_area, round(CAST({_SURE} AS DOUBLE) - 0.04, 3) AS confidence FROM base WHERE t < 4")
def o23_life_area(spark, sf):
    return _found(spark, sf, "area").select("doc_id", F.col("value").alias("life_area"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {fr.BASE}, f AS (SELECT doc_id, ocr, unnest(CASE t WHEN 0 THEN [{{f: 'invoice_date', n: 0, c: 0.93}}, {{f: 'payment_due_date', n: 14, c: 0.94}}]
  WHEN 1 THEN [{{f: 'contract_start', n: 0, c: 0.97}}, {{f: 'cancellation_deadline', n: 330, c: 0.97}}] WHEN 2 THEN [{{f: 'effective_date', n: 0, c: 0.92}}]
  WHEN 3 THEN [{{f: 'document_date', n: 0, c: 0.93}}, {{f: 'event_date', n: 21, c: 0.84}}] ELSE [] END) AS x, d FROM base)
SELECT doc_id, x.f AS field, strftime(d + x.n, '%Y-%m-%d') AS day, round(CAST(x.c AS DOUBLE) - CASE WHEN ocr THEN 0.12 ELSE 0 END, 2) AS confidence FROM f""")
def o24_extract_dates(spark, sf):
    return _found(spark, sf, "date").select("doc_id", "field", F.col("normalized").alias("day"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {fr.BASE} SELECT doc_id, CASE t WHEN 0 THEN 'invoice_total' WHEN 1 THEN 'contract_amount' ELSE 'premium' END AS field, CAST(o_totalprice AS DECIMAL(18,2)) || ' EUR' AS normalized,
 round(CASE t WHEN 0 THEN 0.98 WHEN 1 THEN 0.96 ELSE 0.97 END::DOUBLE - CASE WHEN ocr THEN 0.12 ELSE 0 END, 2) AS confidence FROM base WHERE t < 3""")
def o25_extract_amounts(spark, sf):
    return _found(spark, sf, "amount").select("doc_id", "field", "normalized", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {fr.BASE} SELECT doc_id, 'Haus ' || i2 || CASE t WHEN 0 THEN ' GmbH' WHEN 4 THEN ' KG' ELSE ' AG' END AS organization, 0.94::DOUBLE AS confidence FROM base WHERE t IN (0, 1, 2, 4)")
def o26_extract_organizations(spark, sf):
    return _found(spark, sf, "organization").select("doc_id", F.col("value").alias("organization"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {fr.BASE} SELECT doc_id, 'rechnungsnummer' AS label, 'RE-' || re8 AS normalized FROM base WHERE t = 0 UNION ALL SELECT doc_id, 'kundennummer', 'KD-' || c6 FROM base WHERE t = 0
UNION ALL SELECT doc_id, 'vertragsnummer', 'V-' || c6 FROM base WHERE t IN (1, 2) UNION ALL SELECT doc_id, 'aktenzeichen', 'AZ-' || re8 FROM base WHERE t = 3""")
def o27_extract_identifiers(spark, sf):
    return _found(spark, sf, "identifier").select("doc_id", F.col("field").alias("label"), "normalized")


@query("""SELECT c_custkey AS doc_id, unnest(['product_name', 'rental_property_address', 'tenant_name', 'landlord_name']) AS field,
 unnest(['RiesterRente CLASSIC ' || c_nationkey, 'Weg ' || c_custkey, c_name, 'Haus ' || c_nationkey || ' GmbH']) AS value FROM customer""")
def o28_extract_facts(spark, sf):
    c = spread(table(prepare(spark), sf, "customer").select("c_custkey", "c_nationkey", "c_name"), "c_custkey")
    nation, key = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    text = F.concat(F.lit("Ihre RiesterRente CLASSIC "), nation, F.lit("\nMietobjekt: Weg "), key, F.lit("\nMieterin:  "), "c_name", F.lit("\nVermieter: Haus "), nation, F.lit(" GmbH\nEnde"))
    found = X.findings(once(c.select(F.col("c_custkey").alias("doc_id"), text.alias("text")), "text"), kinds=("fact",))
    return found.select("doc_id", "field", "value")


@query(f"""WITH {fr.BASE} SELECT doc_id, CASE WHEN t < 3 THEN 'Haus ' || i2 || CASE t WHEN 0 THEN ' GmbH' ELSE ' AG' END || ' – ' || {_TYPE} ELSE {_TYPE} || ' – ' || year(d) END AS title,
 round(CASE t WHEN 3 THEN CASE WHEN ocr THEN 0.81 ELSE 0.9 END WHEN 0 THEN 0.94 ELSE 0.92 END::DOUBLE, 2) AS confidence FROM base WHERE t < 4""")
def o29_compose_title(spark, sf):
    return _found(spark, sf, "title").select("doc_id", F.col("value").alias("title"), F.round("confidence", 6).alias("confidence"))


def _spans(spark, sf):
    """Spans over letters: their first three words' characters, some of them shifted."""
    k = F.col("doc_id")
    length = F.least(F.lit(12), F.length("text"))
    span = F.struct(F.lit(0).alias("start"), length.alias("end"), F.substring("text", F.when(k % 13 == 0, 2).otherwise(1), F.lit(12)).alias("span"))
    second = F.struct(F.lit(5).alias("start"), F.when(k % 17 == 0, F.length("text") + 1).otherwise(8).alias("end"), F.substring("text", 6, 3).alias("span"))
    return fr.letters(spark, sf).select("doc_id", F.inline(F.array(span, second)))


@query(f"""WITH {fr.LETTERS}, s AS (SELECT doc_id, text, unnest([0, 5]) AS st, unnest([12, CASE WHEN doc_id % 17 = 0 THEN length(text) + 1 ELSE 8 END]) AS en,
  unnest([substr(text, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END, 12), substr(text, 6, 3)]) AS span FROM letters),
v AS (SELECT doc_id, st, en <= length(text) AND substr(text, st + 1, CAST(en - st AS BIGINT)) = span AS verified FROM s)
SELECT doc_id, CAST(st AS INTEGER) AS start, verified, bool_and(verified) OVER (PARTITION BY doc_id) AS doc_ok FROM v""")
def o30_verify_evidence(spark, sf):
    return X.verify_evidence(_spans(spark, sf), fr.letters(spark, sf)).select("doc_id", "start", "verified", "doc_ok")


def _run(spark, sf):
    """Types, organizations and identifiers of all letters, each in its section's one field, some of them spoilt by the document's key."""
    letters = fr.letters(spark, sf)
    k = F.col("doc_id")
    found = X.findings(letters, kinds=("type", "organization", "identifier")).join(letters.select("doc_id", F.col("text").alias("_t")), "doc_id")
    span = F.substring("_t", F.col("start") + 1, F.col("end") - F.col("start"))
    spoilt = {
        "span": F.when(k % 13 == 0, F.concat(span, F.lit("x"))).otherwise(span),
        "field": F.when((k % 17 == 0) & (F.col("kind") == "identifier"), "invoice_date").otherwise(F.when(F.col("kind") == "type", "document_type").otherwise(F.col("kind"))),
        "normalized": F.when((k % 19 == 0) & (F.col("kind") == "type"), "poem").otherwise(F.col("normalized")),
        "confidence": F.when(k % 23 == 0, F.col("confidence") + 1).otherwise(F.col("confidence")),
    }
    return found.withColumns(spoilt).drop("_t", "notes"), letters


_ASIDE = f"""{fr.BASE}, n AS (SELECT doc_id, t, CASE WHEN t < 4 THEN 1 ELSE 0 END AS types, CASE WHEN t IN (0, 1, 2, 4) THEN 1 ELSE 0 END AS orgs, CASE t WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS ids FROM base),
r AS (SELECT doc_id, types + orgs + ids AS n_findings, list_sort(list_filter([CASE WHEN doc_id % 23 = 0 THEN 'confidence' END, CASE WHEN doc_id % 13 = 0 THEN 'evidence' END, CASE WHEN doc_id % 19 = 0 AND types > 0 THEN 'unknown_document_type' END,
  CASE WHEN doc_id % 17 = 0 AND ids > 0 THEN 'wrong_section' END], lambda x: x IS NOT NULL)) AS reasons FROM n WHERE types + orgs + ids > 0)"""


@query(f"WITH {_ASIDE} SELECT doc_id, n_findings, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0")
def o30_runs_aside(spark, sf):
    return K.set_aside(*_run(spark, sf))[1].withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {_ASIDE} SELECT doc_id, n_findings FROM r WHERE len(reasons) = 0")
def o30_sound_runs(spark, sf):
    return K.set_aside(*_run(spark, sf))[0].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_findings"))


@query(f"""WITH {fr.BASE} SELECT doc_id, CASE t WHEN 0 THEN 'invoice_issued' WHEN 1 THEN 'contract_started' ELSE 'contract_changed' END AS event_type, d AS event_date, 0.9::DOUBLE AS confidence FROM base WHERE t < 3
UNION ALL SELECT doc_id, 'payment_due', d + 14, 0.95 FROM base WHERE t = 0""")
def o31_extract_events(spark, sf):
    rows = X.temporal(fr.letters(spark, sf)).where("item = 'event'")
    return rows.select("doc_id", F.col("item_type").alias("event_type"), F.col("day").alias("event_date"), "confidence")


@query(f"""WITH {fr.BASE}, x AS (SELECT doc_id, t, d + CASE t WHEN 0 THEN 14 WHEN 1 THEN 330 WHEN 3 THEN 21 ELSE 0 END AS day, CASE t WHEN 0 THEN 'payment' WHEN 1 THEN 'cancellation' ELSE 'response' END AS k FROM base WHERE t IN (0, 1, 3, 4))
SELECT doc_id, 'deadline' AS item, k AS item_type, CASE WHEN t <> 4 THEN day END AS day, CAST(CASE WHEN t = 4 THEN 0.45 ELSE 0.95 END AS DOUBLE) AS confidence FROM x
UNION ALL SELECT doc_id, 'action', k, day, 0.9 FROM x WHERE t <> 4""")
def o32_extract_deadlines(spark, sf):
    return X.temporal(fr.letters(spark, sf)).where("item in ('deadline', 'action')").select("doc_id", "item", "item_type", "day", "confidence")


@query(f"""WITH {fr.BASE} SELECT doc_id, 'Haus ' || i2 || ' AG – contract' AS title, 'other' AS contract_type, CASE WHEN t = 1 THEN strftime(d, '%Y-%m-%d') END AS start_date,
 'V-' || c6 AS reference_identifier, round(0.96 - CASE WHEN ocr THEN 0.12 ELSE 0 END, 2)::DOUBLE AS confidence, 'exact_identifier' AS note FROM base WHERE t IN (1, 2)""")
def o33_propose_contracts(spark, sf):
    return X.propose_contracts(fr.letters(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {fr.BASE}, c AS (SELECT doc_id, t, c6 FROM base WHERE t IN (1, 2))
SELECT a.doc_id, b.doc_id AS target_id, CASE WHEN a.t = 2 THEN 'amends' ELSE 'belongs_to_same_case' END AS relation, 'V-' || a.c6 AS identifier FROM c a JOIN c b ON a.c6 = b.c6 AND a.doc_id <> b.doc_id""")
def o34_propose_relationships(spark, sf):
    return X.propose_relationships(fr.letters(spark, sf))


@query(f"""WITH {fr.BASE} SELECT doc_id, CASE WHEN t = 0 AND doc_id % 3 = 0 THEN amt || ' EUR' ELSE '' END AS missing_amounts, CASE WHEN t = 0 AND doc_id % 3 = 0 THEN '0,01 EUR' ELSE '' END AS added_amounts,
 CASE WHEN t = 0 AND doc_id % 4 = 0 THEN strftime(d + 14, '%d.%m.%Y') ELSE '' END AS missing_dates, CAST(0 AS INTEGER) AS n_missing_identifiers FROM base""")
def o35_text_differences(spark, sf):
    k = F.col("doc_id")
    changed = F.when(k % 3 == 0, F.regexp_replace("text", r"Gesamtbetrag: \S+", "Gesamtbetrag: 0,01")).otherwise(F.col("text"))
    changed = F.when(k % 4 == 0, F.regexp_replace(changed, r"Zahlbar bis zum \S+", "Zahlbar bis zum")).otherwise(changed)
    pairs = fr.letters(spark, sf).select("doc_id", F.col("text").alias("base"), changed.alias("candidate"))
    out = X.text_differences(pairs)
    return out.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("missing_amounts", "added_amounts", "missing_dates")], "n_missing_identifiers")


@query("""SELECT doc_id, 'first_word' AS provider, '2' AS provider_version, 'word' AS field, regexp_extract(text, '^\\S+') AS value FROM documents""")
def o36_registered_extractor(spark, sf):
    first = lambda c: F.array(F.struct(F.lit("word").alias("field"), F.regexp_extract(c, r"^\S+", 0).alias("value")))
    X.register_extractor("first_word", first, "2")
    return X.run_extractors(_docs(spark, sf), ["first_word"])
