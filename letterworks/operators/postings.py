"""A positional index of search rows, and ranked answers to queries in web-search syntax.

``build_postings`` gives for each stem and document the places of the stem and their
weights; the words of a row's fields are numbered through, title first and body last.
``write_postings`` stores an index by ranges of hashed
stems; ``read_postings`` opens it, for some queries only the folders that hold their stems.

Syntax of a query: words are all needed, ``"quoted words"`` must follow each other,
``OR`` (in any case) parts alternatives, a minus before a word or phrase forbids it. A
query is thus a list of branches, each of needed and forbidden phrases (a word is a phrase
of one). A branch that needs nothing matches every document it does not forbid.

Rank: covers are the shortest stretches of a document that hold an occurrence of every
needed phrase of some branch. A cover counts the harmonic mean of the weights of the words
asked for in it, divided by one more than its other words; ``r`` is the sum over all covers
and the rank is ``r / (r + 1)``. Boosts for equal identifiers, organizations, titles and
metadata are added.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.functions import text as T
from letterworks.functions.spans import once
from letterworks.functions.stem import german_stem, stem
from letterworks.operators.search import FIELD_WEIGHT, query_blocks, top_k
from letterworks.session import stage

#: Fixed value: the pattern of a word of the index.
WORD = r"(?U)\w+(?:[-./]\w+)*"
#: A phrase in quotes or a word, either with a minus in front if nothing but a blank is before it.
TOKEN = r"(?U)(?:(?<!\S)-)?(?:\"[^\"]*\"|\w+(?:[-./]\w+)*)"
BUCKETS = 64
#: Most documents with forbidden phrases of a query that shares its matches, and of a search that is not called busy.
SLACK, BUSY = 1000, 1000


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def build_postings(projection: DataFrame) -> DataFrame:
    """(term, doc_id, places): each stem of a document with its places (pos from 0, weight) in order.

    A document's places of one stem are one row, made from its row alone, without a shuffle. Stems are made for the distinct
    words of a batch only.
    """
    fields = [F.coalesce(_words(F.col(c)), F.array().cast("array<string>")).alias(f"_{i}") for i, c in enumerate(FIELD_WEIGHT)]
    schema = f"term string, doc_id {dict(projection.dtypes)['doc_id']}, places array<struct<pos:int,weight:double>>"
    return projection.select("doc_id", *fields).mapInArrow(_places, schema)


def _places(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, str] = {}
    for batch in rows:
        n = batch.num_rows
        begun = np.zeros(n, np.int64)
        docs, spots, weights, words = [], [], [], []
        for column, weight in zip(batch.columns[1:], FIELD_WEIGHT.values(), strict=True):
            sizes = np.diff(column.offsets.to_numpy())
            docs.append(np.repeat(np.arange(n), sizes))
            spots.append(np.arange(sizes.sum()) + np.repeat(begun - np.cumsum(sizes) + sizes, sizes))
            weights.append(np.full(sizes.sum(), weight))
            words.append(column.flatten())
            begun += sizes
        coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
        if len(known) > 1_000_000:
            known.clear()
        stems = [known[w] if w in known else known.setdefault(w, stem(w)) for w in coded.dictionary.to_pylist()]
        terms = {t: i for i, t in enumerate(dict.fromkeys(stems))}
        term = np.array([terms[t] for t in stems], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        doc, spot, weight = (np.concatenate(x) for x in (docs, spots, weights))
        order = np.lexsort((spot, term, doc))
        doc, term = doc[order], term[order]
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(doc) else np.zeros(0, np.int64)
        each = pa.StructArray.from_arrays([pa.array(spot[order], pa.int32()), pa.array(weight[order], pa.float64())], ["pos", "weight"])
        places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(doc)], pa.int32()), each)
        yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()).take(pa.array(term[starts])), batch.column(0).take(pa.array(doc[starts])), places], ["term", "doc_id", "places"])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def write_postings(postings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store an index in ``buckets`` folders of hashed stems, sorted by stem in each."""
    rows = postings.withColumn("bucket", _bucket(buckets))
    # A folder's rows are spread by document too, so that a frequent stem is not one task.
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc_id")
    rows.write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: Iterable[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """An index that was written; with ``terms`` (stems) only the folders and rows that hold them."""
    rows = spark.read.parquet(path)
    if terms is not None:
        wanted = sorted(set(terms))
        found = spark.createDataFrame([(t,) for t in wanted], "term string").select(_bucket(buckets).alias("b")).distinct().collect()
        rows = rows.where(F.col("bucket").isin([r.b for r in found]) & F.col("term").isin(wanted))
    return rows.select("term", "doc_id", "places")


def parse_queries(queries: DataFrame) -> DataFrame:
    """(key, q, plan) of the different queries; ``plan`` has an item for each phrase: branch, absent, terms (stems in order)."""
    q = queries.select("key", "q", F.regexp_extract_all("q", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    is_or = lambda x: F.lower(x) == "or"
    numbered = F.transform("tokens", lambda x, i: F.struct(F.size(F.filter(F.slice("tokens", F.lit(1), i), is_or)).alias("branch"), i.alias("item"), x.alias("token")))
    items = q.select("key", F.explode(F.filter(numbered, lambda x: ~is_or(x["token"]))).alias("x")).select("key", "x.*")
    words = items.select("key", "branch", "item", F.col("token").startswith("-").alias("absent"), F.posexplode(_words(F.col("token"))).alias("at", "word"))
    words = words.withColumn("term", german_stem(F.col("word")))
    phrases = words.groupBy("key", "branch", "item", "absent").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("w"))
    one = F.struct("branch", "item", "absent", F.transform("w", lambda x: x["term"]).alias("terms"))
    plans = phrases.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("plan"))
    return q.select("key", "q").join(plans, "key", "left")


def occurrences(terms: list[str], places: dict[str, dict[int, float]]) -> list[tuple[int, int]]:
    """First and last word of each place where the stems follow one another."""
    more = [places.get(t, {}) for t in terms[1:]]
    return [(p, p + len(more)) for p in sorted(places.get(terms[0], ())) if all(p + k + 1 in x for k, x in enumerate(more))]


def minimal_covers(items: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The stretches with an occurrence of every item that hold no shorter such stretch; a merge of the lists by their ends."""
    found: list[tuple[int, int]] = []
    latest = [-1] * len(items)
    for last, first, k in sorted((last, first, k) for k, x in enumerate(items) for first, last in x):
        latest[k] = max(latest[k], first)
        begin = min(latest)
        if begin >= 0 and (not found or begin > found[-1][0]):
            if found and found[-1][1] == last:
                found.pop()  # a shorter one with the same end
            found.append((begin, last))
    return found


def cover_rank(plan: list[dict], places: dict[str, dict[int, float]]) -> float | None:
    """The rank of a document by its places of the plan's stems; null if no branch matches."""
    branches: dict[int, tuple[list, list]] = {}
    for x in plan:
        branches.setdefault(x["branch"], ([], []))[x["absent"]].append(x["terms"])
    covers: set[tuple[int, int]] = set()
    matched = not branches
    asked: dict[int, float] = {}
    for needed, forbidden in branches.values():
        items = [occurrences(t, places) for t in needed]
        if not all(items) or any(occurrences(t, places) for t in forbidden):
            continue
        matched = True
        if items:
            covers.update(minimal_covers(items))
            for t, x in zip(needed, items, strict=True):
                for first, _ in x:
                    asked.update((first + k, places[term][first + k]) for k, term in enumerate(t))
    if not matched:
        return None
    total, begun = 0.0, -1
    spots = sorted(asked)
    for begin, end in sorted(covers, key=lambda c: (c[1], -c[0])):  # one that holds another comes after it
        if begin <= begun:
            continue
        begun = begin
        weights = [asked[p] for p in spots if begin <= p <= end]
        total += len(weights) / sum(1 / w for w in weights) / (1 + end - begin + 1 - len(weights))
    return total / (total + 1)


def _ranked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plans: dict[str, list[dict]] = {}
    known: dict[str, float | None] = {}
    for batch in rows:
        key, doc, plan, words, seen = batch.columns
        coded = seen.dictionary_encode()
        codes, at = np.unique(coded.indices.to_numpy(zero_copy_only=False), return_index=True)
        first = np.empty(len(codes), np.int64)
        first[codes] = at
        if len(plans) > 100_000:
            plans.clear()
        if len(known) > 1_000_000:
            known.clear()
        ranks = []
        for i, same in zip(first.tolist(), coded.dictionary.to_pylist(), strict=True):
            if same not in known:
                name = key[i].as_py()
                if name not in plans:
                    plans[name] = plan[i].as_py() or []
                held = {w["term"]: {p["pos"]: p["weight"] for p in w["places"]} for w in words[i].as_py()}
                known[same] = cover_rank(plans[name], held)
            ranks.append(known[same])
        yield pa.RecordBatch.from_pydict({"key": key, "doc_id": doc, "rank_score": pa.array(ranks, pa.float64()).take(coded.indices)})


def _single(plan: str, needed: bool) -> str:
    return f"filter({plan}, x -> {'not ' if needed else ''}x.absent)"


def _terms(q: DataFrame) -> DataFrame:
    return q.select("key", F.explode("plan").alias("x")).select("key", "x.branch", "x.absent", F.explode("x.terms").alias("term"))


def held_postings(q: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of an index with the stems of (key, plan), and (term, n): the documents of each."""
    held = stage(postings.join(_terms(q).select("term").distinct(), "term", "left_semi"), "search-postings")
    return held, stage(held.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "search-counts")


def part_queries(q: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, q, plan) with ``core``, ``shared``, ``slack`` and ``forbidden``.

    Queries that differ only in what they forbid have one core: the needed phrases. That holds for queries of one branch whose
    forbidden phrases are together in at most ``SLACK`` documents, ``slack`` by their rarest stems; ``forbidden`` are the keys
    of those phrases. Any other query is its own core.
    """
    q = q.withColumns({"_need": F.expr(_single("plan", True)), "_not": F.expr(_single("plan", False))})
    one = F.coalesce((F.size("_need") > 0) & (F.size("_not") > 0) & (F.size(F.array_distinct(F.transform("plan", lambda x: x["branch"]))) == 1), F.lit(False))
    # Where its minus stands behind a blank, a field that holds the whole query is found by what is around the minus.
    able = one & F.col("q").contains(" -") & ~F.col("q").startswith("-")
    phrases = q.where(able).select("key", F.explode("_not").alias("x")).select("key", F.col("x.terms").alias("terms"))
    sizes = phrases.select("key", "terms", F.explode("terms").alias("term")).join(counts, "term", "left").groupBy("key", "terms").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
    slack = sizes.groupBy("key").agg(F.sum("n").alias("slack"), F.collect_list(_core_key(F.array("terms"))).alias("forbidden")).where(F.col("slack") <= SLACK)
    plain = F.coalesce((F.size("_not") == 0) & (F.size(F.array_distinct(F.transform("plan", lambda x: x["branch"]))) == 1), F.lit(False))
    core = F.when(F.col("slack").isNotNull() | plain, _core_key(F.transform("_need", lambda x: x["terms"]))).otherwise(F.col("key"))
    return q.join(slack, "key", "left").select("key", "q", "plan", core.alias("core"), F.col("slack").isNotNull().alias("shared"), "slack", "forbidden", "_need", "_not")


def _core_key(phrases: Column) -> Column:
    return F.concat(F.lit("+"), F.sha2(F.to_json(F.struct(F.array_sort(phrases).alias("p"))), 256))


def cores(parted: DataFrame) -> DataFrame:
    """(key, plan) of all cores, and of each forbidden phrase of shared ones as a search of its own."""
    own = parted.select(F.col("core").alias("key"), F.when(F.col("shared"), F.col("_need")).otherwise(F.col("plan")).alias("plan"))
    phrase = F.array(F.struct(F.lit(0).alias("branch"), F.lit(0).alias("item"), F.lit(False).alias("absent"), F.col("x.terms").alias("terms")))
    kind = dict(parted.dtypes)["plan"]
    phrases = parted.where("shared").select(F.explode("_not").alias("x")).select(_core_key(F.array("x.terms")).alias("key"), phrase.cast(kind).alias("plan"))
    return own.unionByName(phrases).groupBy("key").agg(F.first("plan").alias("plan"))


def match_indexed(q: DataFrame, held: DataFrame, counts: DataFrame, projection: DataFrame) -> DataFrame:
    """(key, doc_id, rank_score) of all documents that match (key, plan); ``held`` and ``counts`` as of ``held_postings``.

    Of each branch only the documents of its rarest needed stem are looked at. The held stems of a document are gathered
    once, whatever the number of searches, and meet the documents of each search by the document.
    """
    needed = _terms(q).where("not absent").join(counts, "term", "left").select("key", "branch", "term", F.coalesce("n", F.lit(0)).alias("n"))
    lead = needed.groupBy("key", "branch").agg(F.min(F.struct("n", "term")).alias("x")).where("x.n > 0").select("key", "x.term", "x.n")
    # Searches with many documents are few, so that their plans are a small side of their own.
    busy = stage(lead.groupBy("key").agg((F.max("n") > BUSY).alias("busy")), "search-busy")
    pairs = lead.select("key", "term").distinct().join(busy, "key").join(held.select("term", "doc_id"), "term").select("key", "busy", "doc_id")
    free = q.where(F.expr("plan is null or exists(plan, x -> not exists(plan, y -> y.branch = x.branch and not y.absent))")).select("key")
    for block in query_blocks(free, "key"):
        pairs = pairs.unionByName(projection.select("doc_id").join(F.broadcast(block)).join(busy.select("key", "busy"), "key", "left").select("key", F.coalesce("busy", F.lit(True)).alias("busy"), "doc_id"))
    pairs = stage(pairs.distinct(), "search-pairs")
    words = held.groupBy("doc_id").agg(F.collect_list(F.struct("term", "places")).alias("words"))
    marked = q.join(busy, "key", "left").withColumn("busy", F.coalesce("busy", F.lit(True)))
    # Only documents with all stems of a branch have their places compared.
    whole = "plan is null or exists(plan, x -> forall(filter(plan, y -> y.branch = x.branch and not y.absent), y -> forall(y.terms, t -> array_contains(terms, t))))"
    parts = []
    for some in ("busy", "not busy"):
        rows = pairs.where(some).select("key", "doc_id").join(words, "doc_id", "left").join(marked.where(some).select("key", "plan"), "key")
        rows = rows.withColumn("terms", F.coalesce("words.term", F.array().cast("array<string>"))).where(whole)
        # Only the places of a search's own stems are handed over; documents that are alike in them have one rank.
        own = F.coalesce(F.expr("filter(words, w -> exists(plan, x -> array_contains(x.terms, w.term)))"), F.array().cast(dict(words.dtypes)["words"]))
        rows = rows.select("key", "doc_id", "plan", F.array_sort(own).alias("words"))
        parts.append(once(rows, "words").withColumn("seen", F.concat("key", F.lit(" "), F.to_json("words"))).mapInArrow(_ranked, f"key string, doc_id {dict(pairs.dtypes)['doc_id']}, rank_score double"))
    return parts[0].unionByName(parts[1]).where("rank_score is not null")


def _scored(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """(key, q, doc_id, rank_score) with the other columns of the documents and the score; those that do not match in any way go."""
    rows = rows.join(narrow, "doc_id")
    low = F.lower("q")
    same = F.lower("identifier_text") == low
    score = (
        F.coalesce("rank_score", F.lit(0.0))
        + F.when(same, 2.0).otherwise(0.0)
        + F.when(F.lower("organization_text") == low, 0.8).otherwise(0.0)
        + F.when(F.lower("title_text").contains(low), 0.6).otherwise(0.0)
        + F.when(F.lower("metadata_text").contains(low), 0.3).otherwise(0.0)
    )
    return rows.where(F.col("rank_score").isNotNull() | same).withColumn("score", F.round(score, 6))


def _around_minus(c: Column) -> Column:
    """The runs of two to five characters that begin with a blank and a minus."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)) == " -")
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(2), F.lit(5)), lambda n: F.substring(c, i, n)))))


def _boosted(q: DataFrame, projection: DataFrame) -> DataFrame:
    """(key, doc_id) where a query that holds a blank and a minus may gain from a document's fields."""
    low = q.select("key", F.lower("q").alias("_q"))
    docs = projection.select("doc_id", *[F.lower(c).alias(c) for c in ("identifier_text", "organization_text", "title_text", "metadata_text")])
    equal = [low.join(docs.where(F.col(c).contains(" -")).select("doc_id", F.col(c).alias("_q")), "_q").select("key", "doc_id") for c in ("identifier_text", "organization_text")]
    texts = F.array("title_text", "metadata_text")
    runs = docs.select("doc_id", F.explode(texts).alias("text")).where(F.col("text").contains(" -")).select("doc_id", "text", F.explode(_around_minus(F.col("text"))).alias("run"))
    held = low.withColumn("run", F.substring("_q", F.instr("_q", " -"), F.lit(5))).join(runs, "run").where(F.col("text").contains(F.col("_q"))).select("key", "doc_id")
    return equal[0].unionByName(equal[1]).unionByName(held).distinct()


def search_indexed(queries: DataFrame, postings: DataFrame, projection: DataFrame, k: int = 10) -> DataFrame:
    """The best matches of any number of queries (query_id, q) through the postings.

    Equal queries are answered once. An identifier equal to the query matches even where
    its words do not, and the empty query matches every document. Queries that only forbid different rare phrases share
    their matches: each reads the first of them, by as many more as it forbids, and the documents whose fields raise its score.
    """
    asked = stage(once(queries.select("query_id", T.normalize_query(F.col("q")).alias("q")), "q").withColumn("key", F.sha2("q", 256)), "search-queries")
    q = stage(parse_queries(asked.groupBy("key").agg(F.first("q").alias("q"))), "search-distinct")
    held, counts = held_postings(q, postings)
    parted = stage(part_queries(q, counts), "search-parted")
    found = stage(match_indexed(stage(cores(parted), "search-cores"), held, counts, projection), "search-found")
    narrow = projection.drop("body_text")  # bodies are fetched for the best matches only

    single = parted.where("not shared").select("key", "q", "core")
    mine = found.withColumnRenamed("key", "core").join(single, "core").select("key", "q", "doc_id", "rank_score")
    exact = single.withColumn("_q", F.lower("q")).join(projection.select("doc_id", F.lower("identifier_text").alias("_q")), "_q").select("key", "q", "doc_id")
    other = exact.join(mine.join(exact.select("key", "doc_id"), ["key", "doc_id"], "left_semi").select("key", "doc_id"), ["key", "doc_id"], "left_anti")
    best = top_k(_scored(mine.unionByName(other.withColumn("rank_score", F.lit(None).cast("double"))), narrow), k, "key")

    shared = parted.where("shared").select("key", "q", "core", "slack")
    if not shared.isEmpty():
        bases = found.withColumnRenamed("key", "core").join(shared.select("core").distinct(), "core", "left_semi").withColumn("score", F.round("rank_score", 6))
        head = stage(top_k(bases.join(projection.select("doc_id", "document_date"), "doc_id"), k + SLACK, "core").select("core", "doc_id", "rank_score", F.col("rank").alias("_at")), "search-heads")
        first = shared.join(head, "core").where(F.col("_at") <= k + F.col("slack")).select("key", "q", "doc_id", "rank_score")
        raised = shared.join(_boosted(shared, projection), "key").join(found.withColumnRenamed("key", "core"), ["core", "doc_id"], "left").select("key", "q", "doc_id", "rank_score")
        gone = parted.where("shared").select("key", F.explode("forbidden").alias("_p")).join(found.select(F.col("key").alias("_p"), "doc_id"), "_p").select("key", "doc_id", F.lit(True).alias("_gone")).distinct()
        rows = first.unionByName(raised).distinct().join(gone, ["key", "doc_id"], "left")
        rows = rows.withColumn("rank_score", F.when(F.col("_gone").isNull(), F.col("rank_score"))).drop("_gone")
        best = best.unionByName(top_k(_scored(rows, narrow), k, "key"))
    best = best.join(asked.select("query_id", "key"), "key").drop("key")
    return best.join(projection.select("doc_id", "body_text"), "doc_id")
