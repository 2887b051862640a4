"""Search over letters: projection, filters, ranking, facets, snippets.

Queries are a frame too: a batch of them is answered in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterworks.functions import text as T
from letterworks.functions.spans import once
from letterworks.operators import extract as X
from letterworks.session import stage

TEXTS = ("title_text", "organization_text", "identifier_text", "metadata_text", "body_text")
#: Weights of a title, organization or identifier, of metadata, and of the body.
FIELD_WEIGHT = {"title_text": 1.0, "organization_text": 1.0, "identifier_text": 1.0, "metadata_text": 0.4, "body_text": 0.1}
SNIPPETS, SNIPPET_CHARS, SNIPPET_LEAD = 2, 320, 120
#: Queries that are broadcast at once to be compared with every row; larger sets are done in several blocks.
BLOCK_QUERIES = 1000
#: So many first characters of a term are looked up in texts at once; so many characters at a place of terms are listed in a pattern.
TERM_CHARS, LISTED = 64, 64
#: Different queries that are broadcast with their terms; larger batches are joined by shuffles.
BROADCAST_QUERIES = 200_000
#: Three characters before a blank and three behind it, by which a passage is looked up in texts; passages that are broadcast at once.
WINDOW, BLOCK_PASSAGES = r"(?s)(?= )(?<=(?=(.{7})).{3})", 50_000


#: The kinds of findings that a search row shows.
PROJECTED = ("type", "area", "title", "organization", "date", "amount", "identifier")


def build_projection(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One search row for each document from its findings: texts of the fields, amount, and the hash of all."""
    base = once(X.analyze(docs, text_col, PROJECTED), "found")
    values = lambda test: F.array_distinct(F.transform(F.filter("found", test), lambda x: x["normalized"]))
    first = lambda test: F.get(F.filter("found", test), F.lit(0))
    kind, area, day = (first(_is(k)) for k in ("type", "area", "date"))
    rows = base.select(
        id_col,
        F.coalesce(first(lambda x: x["kind"] == "title")["value"], F.lit("")).alias("title_text"),
        F.array_join(values(lambda x: x["kind"] == "organization"), "\n").alias("organization_text"),
        F.array_join(values(lambda x: x["kind"] == "identifier"), "\n").alias("identifier_text"),
        F.concat_ws("\n", kind["value"], area["value"], day["normalized"]).alias("metadata_text"),
        T.parse_german_amount(first(lambda x: x["kind"] == "amount")["value"]).alias("amount_value"),
        F.col(text_col).alias("body_text"),
    )
    return rows.withColumn("content_hash", projection_hash())


def _is(kind: str):
    return lambda x: x["kind"] == kind


def projection_hash() -> Column:
    return T.content_hash(*[F.col(c) for c in (*TEXTS, "amount_value")])


def refresh_projection(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, outcome): created, updated, unchanged or removed, by content hash."""
    both = new.select(F.col("doc_id").alias("n"), F.col("content_hash").alias("nh")).join(old.select(F.col("doc_id").alias("o"), F.col("content_hash").alias("oh")), F.col("n") == F.col("o"), "full")
    outcome = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "removed").when(F.col("nh").eqNullSafe(F.col("oh")), "unchanged").otherwise("updated")
    return both.select(F.coalesce("n", "o").alias("doc_id"), outcome.alias("outcome"))


def verify_projection(docs: DataFrame, projection: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: documents, indexed, missing and stale."""
    rows = docs.select("doc_id").join(projection.select("doc_id", F.col("content_hash").alias("h")), "doc_id", "left").join(expected.select("doc_id", F.col("content_hash").alias("x")), "doc_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count("h").alias("indexed"),
        F.count(F.when(F.col("h").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("h") != F.col("x"), 1)).alias("stale"),
    )


def exact_line(lines: Column, value: Column) -> Column:
    """Whether some line equals the value, whatever the case."""
    return F.array_contains(F.split(T.casefold(lines), "\n"), T.casefold(value)) & (lines != "")


def search_filter(df: DataFrame, **f) -> DataFrame:
    """The rows that meet the given predicates; only those given reach the plan. Links are semi-joins."""
    for key in ("status", "life_area", "document_type", "source"):
        if f.get(key) is not None:
            df = df.where(F.col(key) == f[key])
    for low, high, column, kind in (("date_from", "date_to", "document_date", "date"), ("amount_min", "amount_max", "amount_value", "decimal(18,2)")):
        if f.get(low) is not None and f.get(high) is not None and f[low] > f[high]:
            raise ValueError(f"{low} is above {high}")
        if f.get(low) is not None:
            df = df.where(F.col(column) >= F.lit(f[low]).cast(kind))
        if f.get(high) is not None:
            df = df.where(F.col(column) <= F.lit(f[high]).cast(kind))
    if f.get("tag") is not None:
        df = df.where(exact_line(F.col("tags_text"), F.lit(f["tag"])))
    for links in ("organization_docs", "contract_docs", "event_docs", "deadline_docs"):
        if f.get(links) is not None:
            df = df.join(f[links].select("doc_id").distinct(), "doc_id", "left_semi")
    return df


def prepare_queries(queries: DataFrame) -> DataFrame:
    """(query_id, q) with the normalized query and its terms in lower case."""
    q = once(queries.select("query_id", T.normalize_query(F.col("q")).alias("q")), "q")
    return q.withColumn("terms", F.transform(T.query_terms(F.col("q")), lambda t: T.casefold(t)))


def query_blocks(queries: DataFrame, key: str, size: int = BLOCK_QUERIES) -> list[DataFrame]:
    """Any number of queries in blocks small enough to be broadcast; together all of them."""
    n = -(-queries.count() // size)
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)] if n > 1 else [queries]


def key_terms(q: DataFrame) -> DataFrame:
    """The queries (_key, terms) with the ``term`` by which they are looked up and the other terms, ``rest``.

    Of a query's terms it is that which the fewest queries have, so that a term in a text brings few queries; of equals the
    longest. Queries without terms have the empty one. A long term is looked up by its beginning and so stays in ``rest``.
    """
    own = q.select("_key", F.explode("terms").alias("term"))
    shared = own.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(shared, "term").groupBy("_key").agg(F.min(F.struct("n", -F.length("term"), "term"))["term"].alias("_term"))
    keyed = q.where("terms is not null").join(rarest, "_key", "left")
    term = F.coalesce(F.substring("_term", 1, TERM_CHARS), F.lit(""))
    return keyed.withColumns({"term": term, "rest": F.filter("terms", lambda t: t != term)}).drop("_term")


def _places(keyed: DataFrame) -> list[str]:
    """A pattern for each length of the key terms: behind a place, at every position, one of the characters that the terms have there."""
    chars = keyed.where("term <> ''").select("term", F.length("term").alias("n"), F.explode(F.sequence(F.lit(1), F.length("term"))).alias("at"))
    sets = chars.groupBy("n", "at").agg(F.slice(F.collect_set(F.expr("substring(term, at, 1)")), 1, LISTED + 1).alias("c"))
    listed: dict[int, dict[int, str]] = {}
    for n, at, c in sets.collect():  # at most the square of TERM_CHARS
        listed.setdefault(n, {})[at] = "(?s:.)" if len(c) > LISTED else "[" + "".join(rf"\x{{{ord(x):x}}}" for x in sorted(c)) + "]"
    return ["(?=(" + "".join(places[i] for i in sorted(places)) + "))" for _, places in sorted(listed.items())]


def meet(folded: DataFrame, keyed: DataFrame) -> DataFrame:
    """The rows of ``folded``, each with the queries of ``key_terms`` whose terms are all in its text ``_all``.

    A text holds a term if one of its runs of so many characters is the term: runs that can be terms meet the terms by
    equality, without a shuffle of texts, and the other terms are looked for in the same task.
    """
    runs = [F.regexp_extract_all("_all", F.lit(p), F.lit(1)) for p in _places(keyed)]
    if not runs or not keyed.where("term = ''").isEmpty():
        runs.append(F.array(F.lit("")))
    found = folded.withColumn("term", F.explode(F.array_distinct(F.concat(*runs))))
    few = keyed.count() <= BROADCAST_QUERIES
    held = F.forall("rest", lambda t: F.col("_all").contains(t))
    return found.join(F.broadcast(keyed) if few else keyed, "term").where(held).drop("term", "rest")


def _windows(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WINDOW), F.lit(1))


def holding(docs: DataFrame, needles: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of ``needles`` with ``keep`` of each document whose text contains the ``needle``, character by character.

    A text that contains a needle has all windows around the needle's blanks. Windows of texts meet one window of each
    needle, that which the fewest needles have, by equality, and only these texts are searched. Needles without a window meet all texts.
    """
    own = stage(needles.select("needle").where("needle is not null").distinct().select("needle", F.explode_outer(F.array_distinct(_windows(F.col("needle")))).alias("window")), "needles")
    counts = own.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(counts, "window").groupBy("needle").agg(F.min(F.struct("n", "window"))["window"].alias("window"))
    windows = docs.select(*keep, F.col(text_col).alias("_text"), F.explode(F.array_distinct(_windows(F.col(text_col)))).alias("window"))
    held = F.col("_text").contains(F.col("needle"))
    found = [windows.join(F.broadcast(b), "window").where(held).select("needle", *keep) for b in query_blocks(stage(rarest, "needle-windows"), "needle", BLOCK_PASSAGES)]
    plain = own.where("window is null").select("needle")
    if not plain.isEmpty():
        found += [docs.select(*keep, F.col(text_col).alias("_text")).join(F.broadcast(b), held).select("needle", *keep) for b in query_blocks(plain, "needle")]
    return needles.join(reduce(DataFrame.unionByName, found), "needle")


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, _key) of all queries, and (_key, q, terms) of the different ones."""
    asked = stage(prepare_queries(queries).withColumn("_key", F.sha2("q", 256)), "search-queries")
    return asked.select("query_id", "_key"), asked.groupBy("_key").agg(F.first("q").alias("q"), F.first("terms").alias("terms"))


def _match(q: DataFrame, projection: DataFrame) -> DataFrame:
    """Every (query, document) in which all terms of the query (_key, q, terms) occur, with the score; one without terms matches every document."""
    folded = once(projection.withColumn("_all", T.casefold(F.concat_ws("\n", *TEXTS))), "_all")
    pairs = meet(folded, stage(key_terms(stage(q, "search-distinct")), "search-terms"))
    low = T.casefold(F.col("q"))
    has = lambda c: T.casefold(F.col(c)).contains(low)
    score = (
        F.size("terms") * 0.05
        + F.when(exact_line(F.col("identifier_text"), F.col("q")), 2.0).otherwise(0.0)
        + F.when(T.casefold(F.col("organization_text")) == low, 0.8).otherwise(0.0)
        + F.when(has("title_text"), 0.6).otherwise(0.0)
        + F.when(has("metadata_text"), 0.3).otherwise(0.0)
    )
    return pairs.withColumn("score", F.round(score, 6)).drop("_all")


def match_lexical(queries: DataFrame, projection: DataFrame) -> DataFrame:
    """Every (query, document) in which all terms of the query occur, with the score; any number of queries, equal ones answered once."""
    asked, q = _asked(queries)
    return _match(q, projection).join(asked, "_key").drop("_key")


def match_counted(queries: DataFrame, projection: DataFrame) -> DataFrame:
    """The matches of the different queries, each with ``asked``: how many queries are equal to it. For counts over all queries."""
    asked, q = _asked(queries)
    return _match(q.join(asked.groupBy("_key").agg(F.count(F.lit(1)).alias("asked")), "_key"), projection).drop("_key")


def top_k(matched: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    """The best matches of each query: by score, the newest first (undated last), then id."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("document_date").desc_nulls_last(), F.col("doc_id").cast("string"))
    return matched.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_lexical(queries: DataFrame, projection: DataFrame, k: int = 10) -> DataFrame:
    asked, q = _asked(queries)
    return top_k(_match(q, projection), k, "_key").join(asked, "_key").drop("_key")


def search_facets(matched: DataFrame, limit: int = 20) -> DataFrame:
    """(facet, value, label, n) of all matches: the most frequent values, equal ones by value; one pass over the matches.

    A match counts ``asked`` times if there is such a column. Matches equal in all facets are counted before they are taken apart.
    """
    values = {"document_type": F.col("document_type"), "year": F.year("document_date"), "review_state": F.col("status"), "source": F.col("source"), "organization": F.col("organization_text")}
    times = (F.col("asked") if "asked" in matched.columns else F.lit(1)).cast("long").alias("times")
    alike = matched.select(*[c.alias(name) for name, c in values.items()], times).groupBy(*values).agg(F.sum("times").alias("times"))
    facets = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value")) for name in values])
    rows = alike.select(F.explode(facets).alias("f"), "times").select("f.*", "times").where("value is not null and value <> ''")
    counts = rows.groupBy("facet", "value").agg(F.sum("times").alias("n"))
    w = Window.partitionBy("facet").orderBy(F.col("n").desc(), "value")
    most = F.when(F.col("facet") == "organization", 50).otherwise(limit)
    first = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    label = F.when(F.col("facet") == "organization", F.col("value")).otherwise(F.initcap(F.replace("value", F.lit("_"), F.lit(" "))))
    return first.select("facet", "value", label.alias("label"), "n")


def snippets(pages: Column, terms: Column) -> Column:
    """At most two snippets, of pages with a term: page, text, and the merged ranges of the terms in it."""

    def one(page: Column, number: Column) -> Column:
        low = F.lower(page)
        places = F.filter(F.transform(terms, lambda t: F.instr(low, F.lower(t))), lambda i: i > 0)
        at = F.array_min(places)
        start = F.greatest(at - 1 - SNIPPET_LEAD, F.lit(0))
        end = F.least(F.length(page), start + SNIPPET_CHARS)
        start = F.greatest(end - SNIPPET_CHARS, F.lit(0))
        return F.when(at.isNotNull(), F.struct((number + 1).alias("page"), F.substring(page, start + 1, end - start).alias("text")))

    found = F.slice(F.array_compact(F.transform(pages, one)), 1, SNIPPETS)
    return F.transform(found, lambda s: F.struct(s["page"].alias("page"), s["text"].alias("text"), highlights(s["text"], terms).alias("ranges")))


def highlights(text: Column, terms: Column) -> Column:
    """Ranges of the terms in a text, overlapping and touching ones merged, in order."""
    low = F.lower(text)
    at = lambda t: F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - F.length(t), F.lit(0))), lambda i: F.substring(low, i + 1, F.length(t)) == F.lower(t))
    ranges = F.sort_array(F.flatten(F.transform(terms, lambda t: F.transform(at(t), lambda i: F.struct(i.alias("start"), (i + F.length(t)).alias("end"))))))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (r["start"] <= F.when(F.size(out) > 0, last["end"])), joined).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(ranges.cast("array<struct<start:int,end:int>>"), empty, add)


#: Columns that a stored filter may fix, and the binned and the other ranges that it may set (column: lowest, highest).
SAVED_EQUAL = ("life_area", "document_type", "status", "source")
SAVED_AMOUNT = ("amount_value", "amount_min", "amount_max")
SAVED_DATE = ("document_date", "date_from", "date_to")
SAVED_BINS = 64


def check_saved_searches(saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored filters that hold, and (saved_id, reason) of the others: a name its owner has used before, or an empty range."""
    order = Window.partitionBy("owner", "name").orderBy("saved_id")
    wrong = lambda low, high: F.col(low) > F.col(high)
    reason = F.when(F.row_number().over(order) > 1, "name_in_use").when(wrong(*SAVED_AMOUNT[1:]), "amount_range").when(wrong(*SAVED_DATE[1:]), "date_range")
    rows = saved.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("saved_id", "reason")


def run_saved_searches(saved: DataFrame, projection: DataFrame) -> DataFrame:
    """Hit counts of any number of stored filter sets; a filter column that is null or absent means any.

    An index of the filters is joined by equality: the fixed columns are a key (with the set of those fixed), amounts are
    binned by quantiles. Rows are counted by values first. Bins that lie within a filter's range are answered from the
    counts of bins; rows are compared with a filter's ends only in the bins of these ends, or in all of its bins if it
    has a range of dates too.
    """
    have = [c for c in SAVED_EQUAL if c in saved.columns]
    amount, low, high = SAVED_AMOUNT
    day, since, until = SAVED_DATE
    dated = since in saved.columns or until in saved.columns
    given = lambda c, kind: F.col(c).cast(kind) if c in saved.columns else F.lit(None).cast(kind)
    mask = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(have)), F.lit(0))
    s = saved.select("saved_id", mask.alias("mask"), *[F.col(c).alias(f"_{c}") for c in have], given(low, "decimal(18,2)").alias("lo"), given(high, "decimal(18,2)").alias("hi"), given(since, "date").alias("since"), given(until, "date").alias("until"))
    cuts = projection.agg(F.percentile_approx(amount, [i / SAVED_BINS for i in range(1, SAVED_BINS)])).first()[0] or []
    edges = F.array(*[F.lit(c).cast("decimal(18,2)") for c in sorted(set(cuts))]).cast("array<decimal(18,2)>")
    bin_of = lambda v: F.size(F.filter(edges, lambda c: c < v))
    whole = F.col("lo").isNull() & F.col("hi").isNull() & F.col("since").isNull() & F.col("until").isNull()
    ranged = F.col("lo").isNotNull() | F.col("hi").isNotNull()
    first, last = bin_of(F.col("lo")), F.when(F.col("hi").isNull(), len(set(cuts))).otherwise(bin_of(F.col("hi")))
    # Bin -1 holds every row, with and without an amount.
    bins = F.when(whole | ~ranged, F.array(F.lit(-1))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    inner = ((F.col("bin") > F.col("first")) | F.col("lo").isNull()) & ((F.col("bin") < F.col("last")) | F.col("hi").isNull()) & F.col("since").isNull() & F.col("until").isNull()
    s = s.withColumns({"first": first, "last": last}).select("*", F.explode(bins).alias("bin")).withColumn("inner", inner)
    s = stage(s, "saved-filters")

    masks = [r.mask for r in s.select("mask").distinct().collect()]  # sets of fixed columns: at most two to the number of them
    rows = projection.groupBy(*have, amount, *([day] if dated else [])).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks]))) if masks else rows.withColumn("mask", F.lit(0)).limit(0)
    fixed = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    rows = rows.select("mask", *[F.when(fixed(i), F.col(c)).alias(f"_{c}") for i, c in enumerate(have)], F.col(amount).alias("v"), (F.col(day) if dated else F.lit(None).cast("date")).alias("d"), "n")
    own = F.when(F.col("v").isNotNull(), F.array(F.lit(-1), bin_of(F.col("v")))).otherwise(F.array(F.lit(-1)))
    keys = ["mask", *[f"_{c}" for c in have], "bin"]
    rows = stage(rows.select("*", F.explode(own).alias("bin")).groupBy(*keys, "v", "d").agg(F.sum("n").alias("n")), "saved-rows")
    same = lambda x, y: reduce(lambda p, q: p & q, [x[k].eqNullSafe(y[k]) for k in keys])
    counts = rows.groupBy(*keys).agg(F.sum("n").alias("n"))
    full, edge = s.where("inner"), s.where("not inner")
    sums = full.join(counts, same(full, counts)).select("saved_id", "n")
    fits = lambda test, c: F.col(c).isNull() | test
    within = fits(F.col("v") >= F.col("lo"), "lo") & fits(F.col("v") <= F.col("hi"), "hi") & fits(F.col("d") >= F.col("since"), "since") & fits(F.col("d") <= F.col("until"), "until")
    met = edge.join(rows, same(edge, rows)).where(within).select("saved_id", "n")
    hits = sums.unionByName(met).groupBy("saved_id").agg(F.sum("n").alias("hits"))
    return saved.select("saved_id").join(hits, "saved_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def list_documents(docs: DataFrame, order: list[Column], limit: int, offset: int = 0, contains: tuple[str, str] | None = None) -> DataFrame:
    """A page of documents in order, optionally those with a text in a column."""
    if contains:
        docs = docs.where(F.lower(contains[0]).contains(contains[1].lower()))
    return docs.orderBy(*order).offset(offset).limit(limit)
