"""Queries for sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterworks.operators import constraints as K
from letterworks.operators import search as S
from letterworks.plans import frames as fr
from letterworks.plans.registry import query
from letterworks.session import prepare, scratch, stage, table
from letterworks.sources import cursor as C
from letterworks.sources import files as A
from letterworks.streaming import incremental as I
from letterworks.streaming.readiness import ready_files
from letterworks.streaming.segments import SegmentLog


@query("SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN length(text) < 100 THEN 'too_short' END AS problem FROM conversations WHERE role NOT IN ('user', 'assistant') OR length(text) < 100")
def o01_read_corpus(spark, sf):
    checks = {"role": F.col("role").isin("user", "assistant"), "too_short": F.length("text") >= 100}
    return A.read_corpus(prepare(spark), sf, "conversations", "conv_id long, turn long, role string, text string", checks)[1].select("conv_id", "turn", "problem")


def _tables(spark, sf):
    """All tables as they come from a text export: every value a text."""
    prepare(spark)
    read = {name: table(spark, sf, name) for name in fr.TABLES}
    return {name: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns if c in fr.TABLES[name].columns]) for name, df in read.items()}


@query(fr.tables_sql())
def o01_load_tables(spark, sf):
    return K.rejection_report(K.load_all(spark, _tables(spark, sf), fr.TABLES)[1])


@query("""SELECT doc_id, lang, source, n_chars FROM documents WHERE text IS NOT NULL AND (lang IS NULL OR lang IN ('en', 'de', 'fr')) AND length(text) BETWEEN 1 AND 10000""")
def o01_valid_documents(spark, sf):
    return K.load(_tables(spark, sf)["documents"], fr.TABLES["documents"])[0].select("doc_id", "lang", "source", "n_chars")


@query("SELECT lang, TRUE AS stored, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY 1")
def o02_asset_inventory(spark, sf):
    """Texts stored as files by language, a language in several, then listed."""
    path = scratch(prepare(spark), "assets")
    table(spark, sf, "documents").select("text", "lang").repartition("lang", F.pmod(F.xxhash64("text"), F.lit(64))).write.partitionBy("lang").text(path, lineSep="\n")
    files = A.asset_inventory(spark, path).where("storage_key like '%lang=%'")
    lang = F.regexp_extract("storage_key", "lang=([a-z]+)", 1)
    return files.groupBy(lang.alias("lang")).agg((F.count(F.lit(1)) > 0).alias("stored"), F.sum("n_bytes").alias("n_bytes"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN NULL ELSE 'application/pdf' END AS found, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'type_mismatch' WHEN 2 THEN 'unsupported_type' END AS reason,
 'a_' || page_id || '_b.pdf' AS safe_name FROM pages""")
def o03_sniff_type(spark, sf):
    k = F.col("page_id")
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.when(k % 4 == 1, F.lit(bytearray(A.MAGIC["image/png"]))).when(k % 4 != 2, F.lit(bytearray(A.MAGIC["application/pdf"]))).otherwise(F.lit(bytearray(b"")))
    up = table(prepare(spark), sf, "pages").select("page_id", F.concat(F.lit("../x/a "), k.cast("string"), F.lit("ä b.pdf")).alias("name"), F.lit("application/pdf").alias("declared"), F.concat(head, html).alias("content"))
    return A.validate_upload(up).select("page_id", "found", "reason", "safe_name")


@query("SELECT p_partkey AS id, p_name AS title, p_size AS tag, CAST(1 + (p_partkey % 100 = 0)::INT AS BIGINT) AS times FROM part")
def o04_read_library_export(spark, sf):
    """A manifest written from ``part`` (some ids twice) and read back."""
    p = table(prepare(spark), sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("tag"))
    path = scratch(spark, "manifest")
    both = p.unionByName(p.where("id % 100 = 0"))
    # One manifest for each block of ids: no array holds the whole library.
    blocks = both.groupBy(F.floor(F.col("id") / 500).alias("block")).agg(F.collect_list(F.struct("id", "title", "tag")).alias("documents"))
    blocks.drop("block").write.json(path)
    docs, repeats = A.read_library_export(spark, path, multi_line=False)
    rows = docs.select("id", "title", F.col("tag").cast("int").alias("tag")).distinct().join(repeats, "id", "left")
    return rows.select("id", "title", "tag", F.coalesce("n", F.lit(1)).cast("long").alias("times"))


@query("SELECT 'customer' AS name, count(*) AS n_rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'documents', count(*) FROM documents")
def o05_write_export(spark, sf):
    return A.write_export({n: table(prepare(spark), sf, n) for n in ("customer", "nation", "documents")}, scratch(spark, "export"))


@query("""SELECT 'file-' || doc_id AS name, CASE WHEN doc_id % 20 = 0 THEN 'missing' WHEN doc_id % 30 = 7 THEN 'mismatch' ELSE 'ok' END AS outcome FROM documents
UNION ALL SELECT 'more/../file-' || doc_id, 'unsafe' FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'more-' || doc_id, 'unexpected' FROM documents WHERE doc_id % 40 = 0""")
def o06_verify_export(spark, sf):
    d, k = table(prepare(spark), sf, "documents"), F.col("doc_id")
    name = lambda prefix: F.concat(F.lit(prefix), k.cast("string")).alias("name")
    digest = F.sha2("text", 256)
    expected = d.select(name("file-"), digest.alias("sha256"))
    actual = d.where("doc_id % 20 <> 0").select(name("file-"), F.when(k % 30 == 7, "x").otherwise(digest).alias("sha256"))
    actual = actual.unionByName(d.where("doc_id % 50 = 0").select(name("more/../file-"), digest.alias("sha256"))).unionByName(d.where("doc_id % 40 = 0").select(name("more-"), digest.alias("sha256")))
    return A.verify_export(expected, actual)


@query("""SELECT o_orderkey AS id, v AND row_number() OVER (PARTITION BY o_custkey, v ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3 AS keep FROM (SELECT *, o_orderstatus <> 'P' AS v FROM orders)""")
def o07_retention_prune(spark, sf):
    o = table(prepare(spark), sf, "orders")
    records = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scope"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "P").alias("verified"))
    return A.retention_prune(records, 3).select("id", "keep")


@query("SELECT sha256(text) AS hash, count(*) AS n_rows, count(*) - 1 AS n_duplicates FROM documents GROUP BY 1")
def o95_stream_ingest(spark, sf):
    d = table(prepare(spark), sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return I.stream_ingest(spark, I.as_files(d, "doc_id", 10), d.schema, "hash", "doc_id").groupBy("hash").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("duplicate"), 1)).alias("n_duplicates"))


_OBSERVED = "obs AS (SELECT (user_id % 40)::VARCHAR AS path, event_id AS p, CAST(floor(value / 40) AS BIGINT) AS size, CAST(user_id // 80 AS BIGINT) AS mtime FROM events)"


def _observations(spark, sf):
    e = table(prepare(spark), sf, "events")
    return e.select((F.col("user_id") % 40).cast("string").alias("path"), F.col("event_id").alias("at"), F.floor(F.col("value") / 40).alias("size"), F.floor(F.col("user_id") / 80).alias("mtime"))


@query(f"""WITH {_OBSERVED}, c AS (SELECT *, CASE WHEN size IS DISTINCT FROM lag(size) OVER w OR mtime IS DISTINCT FROM lag(mtime) OVER w THEN 1 ELSE 0 END AS c FROM obs WINDOW w AS (PARTITION BY path ORDER BY p)),
i AS (SELECT *, sum(c) OVER (PARTITION BY path ORDER BY p) AS island FROM c)
SELECT path, p AS "at", min(p) OVER (PARTITION BY path, island) AS since, p - min(p) OVER (PARTITION BY path, island) >= 60 AS ready FROM i""")
def o96_stable_files(spark, sf):
    return I.stable_files(_observations(spark, sf), 60).select("path", "at", "since", "ready")


_READY = """WITH obs AS (SELECT user_id::VARCHAR AS path, event_id + 1 AS p, CAST(floor(value / 150) AS BIGINT) AS size, CAST(user_id // 80 AS BIGINT) AS mtime FROM events),
c AS (SELECT *, size IS DISTINCT FROM lag(size) OVER w OR mtime IS DISTINCT FROM lag(mtime) OVER w AS changed FROM obs WINDOW w AS (PARTITION BY path ORDER BY p)),
i AS (SELECT *, lead(p) OVER (PARTITION BY path ORDER BY p) AS ended FROM c WHERE changed)
SELECT path, size AS n_bytes, mtime, p AS since, p + 300 AS ready_at FROM i WHERE p + 300 <= (SELECT max(event_id) + 1 FROM events) AND (ended IS NULL OR ended >= p + 300)"""


def _seen(spark, sf):
    """Observations of a file for each user."""
    e = table(prepare(spark), sf, "events")
    return e.select(F.col("user_id").cast("string").alias("path"), (F.col("event_id") + 1).alias("at"), F.floor(F.col("value") / 150).alias("size"), F.floor(F.col("user_id") / 80).alias("mtime"))


@query(_READY)
def o96_ready_files(spark, sf):
    return ready_files(_seen(spark, sf), 300)


@query(_READY)
def o96_ready_stream(spark, sf):
    rows = _seen(spark, sf)
    return I.ready_files_result(spark, I.as_files(rows, "at", 6), rows.schema, 300)


@query("""WITH s AS (SELECT doc_id AS cursor, source, doc_id % 2 AS epoch FROM documents), st AS (SELECT source, doc_id % 2 AS epoch, max(doc_id) AS c FROM documents WHERE doc_id % 3 = 0 AND doc_id < 500 AND source <> 'src1' GROUP BY ALL)
SELECT cursor, s.source, CAST(s.epoch AS BIGINT) AS epoch FROM s LEFT JOIN st ON s.source = st.source AND s.epoch = st.epoch WHERE c IS NULL OR cursor > c""")
def o97_incremental_by_cursor(spark, sf):
    rows = table(prepare(spark), sf, "documents").select(F.col("doc_id").alias("cursor"), "source", (F.col("doc_id") % 2).alias("epoch"))
    state = rows.where("cursor % 3 = 0 and cursor < 500 and source <> 'src1'")
    return I.incremental_by_cursor(rows, state).select("cursor", "source", "epoch")


_FEED = """feed AS (SELECT source, CAST(doc_id % 2 AS BIGINT) AS epoch, doc_id AS cursor, text AS payload FROM documents WHERE doc_id % 2 = 0 OR source <> 'src1')"""


def _feed(spark, sf):
    """Every document as a row of its source's feed; all sources but one have changed their identity."""
    rows = table(prepare(spark), sf, "documents").where("doc_id % 2 = 0 or source <> 'src1'")
    return rows.select("source", (F.col("doc_id") % 2).alias("epoch"), F.col("doc_id").alias("cursor"), F.col("text").alias("payload"))


@query(f"""WITH {_FEED} SELECT source, epoch, count(*) AS n_rows, max(cursor) AS last_cursor, sum(length(payload)) AS chars
FROM feed JOIN (SELECT source, max(epoch) AS epoch FROM feed GROUP BY 1) USING (source, epoch) GROUP BY 1, 2""")
def o97_read_cursors(spark, sf):
    """The feed written for its file form, then streamed: only the present identity of each source is read."""
    root, out = scratch(spark, "feed"), scratch(spark, "feed-out")
    C.write_feed(_feed(spark, sf), root)
    q = C.read_cursors(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "feed-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(C.SCHEMA).parquet(out)
    return rows.groupBy("source", "epoch").agg(F.count(F.lit(1)).alias("n_rows"), F.max("cursor").alias("last_cursor"), F.sum(F.length("payload")).alias("chars"))


@query("""WITH p AS (SELECT 'user-' || user_id AS source, ts AS seen, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'OSError: detail ' || event_id END AS error FROM events),
s AS (SELECT DISTINCT 'user-' || user_id AS source, user_id % 10 <> 3 AS enabled FROM events UNION ALL SELECT 'new-' || r_regionkey, true FROM region),
l AS (SELECT source, max(seen) AS last_checked_at, max(seen) FILTER (WHERE ok) AS last_success_at, max(seen) FILTER (WHERE NOT ok) AS last_failure_at, arg_max(ok, (seen, NOT ok)) AS k, count(*) AS polls, count(*) FILTER (WHERE NOT ok) AS failures FROM p GROUP BY 1)
SELECT source, CASE WHEN NOT enabled THEN 'disabled' WHEN last_checked_at IS NULL THEN 'unknown' WHEN k THEN 'healthy' ELSE 'degraded' END AS health, last_checked_at, last_success_at, last_failure_at,
 CASE WHEN NOT k THEN 'OSError' END AS last_error, coalesce(polls, 0) AS polls, coalesce(failures, 0) AS failures FROM s LEFT JOIN l USING (source)""")
def o97_source_health(spark, sf):
    e = table(prepare(spark), sf, "events")
    name, failed = F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.col("event_type") == "error"
    polls = e.select(name.alias("source"), F.col("ts").alias("at"), (~failed).alias("ok"), F.when(failed, F.concat(F.lit("OSError: detail "), F.col("event_id").cast("string"))).alias("error"))
    new = table(spark, sf, "region").select(F.concat(F.lit("new-"), F.col("r_regionkey").cast("string")).alias("source"), F.lit(True).alias("enabled"))
    return C.source_health(polls, e.select(name.alias("source"), (F.col("user_id") % 10 != 3).alias("enabled")).distinct().unionByName(new))


@query(f"""WITH {_FEED}, now AS (SELECT source, max(epoch) AS e FROM feed GROUP BY 1)
SELECT source, epoch, cursor, CASE WHEN epoch = e THEN 'retry' ELSE 'identity_changed' END AS outcome FROM feed JOIN now USING (source) WHERE cursor % 7 = 0""")
def o97_void_retries(spark, sf):
    rows = _feed(spark, sf).drop("payload")
    return C.void_retries(rows.where("cursor % 7 = 0"), C.last_cursors(rows))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def o98_journal_stream(spark, sf):
    e = table(prepare(spark), sf, "events").select("ts", "event_type")
    out = I.journal_stream(spark, I.as_files(e, "ts", 10), e.schema)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, first DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def o98_sessions(spark, sf):
    out = I.sessions(table(prepare(spark), sf, "events"), "user_id", "6 hours")
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query(f"""WITH {fr.BASE} SELECT doc_id, CASE WHEN t = 0 THEN 'RE-' || re8 || chr(10) || 'KD-' || c6 WHEN t = 3 THEN 'AZ-' || re8 WHEN t < 3 THEN 'V-' || c6 ELSE '' END AS identifier_text, CASE WHEN t < 3 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount_value FROM base""")
def o99_stream_projection(spark, sf):
    letters = fr.letters(spark, sf)
    path = I.as_files(letters, "doc_id", 6, ordered=False)
    out = I.stream_projection(spark, path, letters.schema, S.build_projection, "doc_id", I.files_of(spark, path, 3))
    return out.select("doc_id", "identifier_text", "amount_value")


@query("""WITH u AS (SELECT l_orderkey AS doc_id, l_linenumber AS batch, count(*) AS n, sum(l_quantity) AS quantity, bool_or(l_linestatus = 'O' AND l_linenumber % 3 = 0) AS removed FROM lineitem GROUP BY 1, 2),
n AS (SELECT doc_id, max(batch) AS batch FROM u GROUP BY 1) SELECT doc_id, batch, n, CAST(quantity AS DOUBLE) AS quantity FROM u JOIN n USING (doc_id, batch) WHERE NOT removed""")
def o99_segment_log(spark, sf):
    """Seven batches of changes, some of them removals, through the levelled log."""
    x = table(prepare(spark), sf, "lineitem")
    gone = F.max((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 3 == 0)).alias("removed")
    rows = x.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"), gone)
    rows = stage(rows, "changes")
    log = SegmentLog(spark, scratch(spark, "segments"), rows.drop("removed").schema, "doc_id", 3)
    for b in range(1, 8):
        own = rows.where(F.col("batch") == b)
        log.append(own.where("not removed").drop("removed"), b, own.where("removed"))
    return log.read()
