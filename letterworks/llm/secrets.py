"""Secret scans with multipart credential linking.

Base findings are regular-expression matches of three kinds. The linking step
looks at parts that prove nothing alone: account names and mail addresses, short
or unlabelled secrets, and service endpoints (addresses of hosts and URLs). Each
has a scope, its span widened by ``SCOPE`` code points on either side. Parts are
interval-joined with the parts of other roles in their scope (equal text and bin of
positions, then the exact overlap, as semi-joins, so pairs are never listed); a
weak part is reported only where a complementary part co-occurs:

* ``ident`` and ``endpoint`` where a secret is in scope;
* ``weak`` (secret) where an identifier or an endpoint is in scope.

Secrets are base findings of kind ``assign``, those of kind ``hex`` that have both
a letter and a digit (a run of digits alone is no secret), and weak secrets.

Offsets are code points, ends exclusive. Defined results: null and empty texts
have no findings; equal texts have equal findings; repeated rows are scanned each;
weak parts that overlap a base finding, and endpoints inside an identifier, are
left out; texts of any length are scanned whole, in time that grows with their
length; kept columns may have any name, those named ``base`` or ``linked`` give way
to the results; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterworks.llm.columns import let, text_key, whole
from letterworks.session import prepare, stage, table

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN, MIN_ACCESS = 12, 18

#: Patterns of the weak parts.
IDENT = r"""(?i:(user(?:name|_?id)?|login|client_?id|account(?:_?id)?|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
#: Identifiers whose makers mark them by a prefix.
MARKED = r"(?<![A-Za-z0-9])(?:ASIA[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|[0-9]{12}-[a-z0-9]{32}\.apps)(?![A-Za-z0-9])"
BLOB = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,88}={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\x20\x09-\x0D"'<>,;]+"""

ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9]|\.[0-9])"

KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
SCOPE = 200
BIN = 512
MIN_WEAK = 6
#: Matches that are located together; see ``_spans``.
BLOCK = 256
#: A text has fewer spans of a pattern than two to this.
MOST_SPANS_BITS = 28


def _spans(text: Column, pattern: str, kind: str, keep, group: int = 0, signs: tuple[str, ...] = ()) -> Column:
    """Spans of the leftmost non-overlapping matches of a pattern for which ``keep(match, group)`` holds.

    Splitting at the pattern gives the texts between the matches; running lengths of both give the places. A match holds
    one of ``signs``, so texts without them are passed over.
    """
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    rank = KINDS.index(kind)

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        good = x["hit"].isNotNull() & keep(x["hit"], x["part"])
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(good, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    def in_block(a: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(a["at"].alias("at"), empty.alias("out")), step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    def located(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
        found = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), hits.alias("hit"), parts.alias("part"))
        # Appending copies, so spans are gathered in blocks and the blocks in a list of their own.
        blocks = let(found, lambda f: F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / BLOCK).cast("int")), lambda k: F.slice(f, k * BLOCK + 1, BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,rank:int,end:int>>>").alias("out"))
        return F.aggregate(blocks, start, in_block, lambda a: F.flatten(a["out"]))

    test = text.rlike(pattern)
    if signs:
        test = reduce(lambda a, b: a | b, [text.contains(x) for x in signs]) & test
    return F.when(test, let(F.split(text, pattern, -1), located)).otherwise(empty)


def _over(x: Column, spans: Column) -> Column:
    """Whether a span overlaps one of ``spans``, which are in order and do not overlap each other: by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_SPANS_BITS))])
    further = lambda at, step: (at + step <= F.size(spans)) & F.coalesce(F.get(spans, at + step - 1)["start"] < x["end"], F.lit(False))
    before = F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, before - 1)["end"] > x["start"], F.lit(False))


def _distinct(spans: Column) -> Column:
    """The different spans in order."""
    return let(F.sort_array(spans), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))


def base_spans(text: Column) -> Column:
    """Array of ``{start, rank, end}`` of the three base kinds in order of start, then kind."""
    return F.sort_array(
        F.concat(
            _spans(text, ASSIGN, "assign", lambda m, g: F.length(g) >= MIN_ASSIGN, 2, (":", "=")),
            _spans(text, ACCESS, "access", lambda m, g: F.length(m) >= MIN_ACCESS, signs=("AKIA",)),
            # A run of 16 or more is a whole run: shorter runs are passed over and nothing else can start inside one.
            _spans(text, HEX, "hex", lambda m, g: F.lit(True)),
        )
    )


def weak_spans(text: Column, base: Column) -> Column:
    """Array of the spans of weak parts, without those that overlap a base span."""
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    every = lambda m, g: F.lit(True)
    names = (
        _spans(text, IDENT, "ident", every, 2, (":", "=")),
        _spans(text, MAIL, "ident", every, signs=("@",)),
        _spans(text, MARKED, "ident", every, signs=("ASIA", "AIza", ".apps")),
    )
    short = _spans(text, ASSIGN, "weak", lambda m, g: F.length(g).between(MIN_WEAK, MIN_ASSIGN - 1), 2, (":", "="))
    secrets = F.concat(short, _spans(text, BLOB, "weak", lambda m, g: mixed(m)))
    ends = F.concat(_spans(text, ENDPOINT, "endpoint", every, signs=("://",)), _spans(text, ADDRESS, "endpoint", every, signs=(".",)))

    def outside(spans: Column, others: Column) -> Column:
        return F.filter(spans, lambda x: ~_over(x, others))

    def free(found: Column) -> Column:
        """``found``: the spans of each pattern of names; each is in order."""
        ends_left = reduce(outside, [found[f"n{k}"] for k in range(3)], ends)
        every_name = _distinct(F.concat(*[found[f"n{k}"] for k in range(3)]))
        return F.concat(every_name, _distinct(secrets), _distinct(ends_left))

    weak = let(F.struct(*[n.alias(f"n{k}") for k, n in enumerate(names)]), free)
    of_kind = lambda k: F.filter(base, lambda b: b["rank"] == k)
    return let(F.struct(*[of_kind(k).alias(f"b{k}") for k in range(3)]), lambda b: reduce(outside, [b[f"b{k}"] for k in range(3)], weak))


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts to report of ``parts`` (text_key, start, rank, end, secret): interval semi-joins by role."""
    rank = {k: i for i, k in enumerate(KINDS)}
    binned = lambda df, low, high: df.withColumn("bin", F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN))))
    others = binned(parts, F.col("start"), F.col("end")).select(
        F.col("text_key").alias("k"), F.col("bin").alias("b"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("rank").alias("r"), F.col("secret").alias("proof")
    )

    def near(kinds: tuple[str, ...], there) -> DataFrame:
        weak = parts.where(F.col("rank").isin([rank[k] for k in kinds])).select("text_key", "start", "rank", "end").distinct()
        weak = binned(weak, F.col("start") - scope, F.col("end") + scope)
        on = (F.col("text_key") == F.col("k")) & (F.col("bin") == F.col("b")) & (F.col("s") <= F.col("end") + scope) & (F.col("e") >= F.col("start") - scope)
        return weak.join(others.where(there), on, "left_semi").select("text_key", "start", "rank", "end").distinct()

    company = F.col("r").isin([rank[k] for k in ("access", "ident", "endpoint")])
    return near(("ident", "endpoint"), F.col("proof")).unionByName(near(("weak",), company))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",), scope: int = SCOPE) -> DataFrame:
    """``keep_cols``, base (array of spans) and linked (array of reported weak spans) for every row.

    Texts are read once and never shuffled; only parts of texts with weak parts are. What is linked is written before it
    is joined back, so that copies of one text can be split in that join.
    """
    text = whole(F.col(text_col))
    rest = [c for c in keep_cols if c not in ("base", "linked")]
    row = F.struct(*[F.col(c) for c in rest], F.lit(0).alias("_")).alias("_row")
    found = docs.select(row, text_key(F.col(text_col)).alias("text_key"), text.alias("_text"), base_spans(text).alias("base"))
    found = found.select("_row", "text_key", "_text", "base", weak_spans(F.col("_text"), F.col("base")).alias("weak"))
    both = lambda m: m.rlike("[0-9]") & m.rlike("[a-f]")
    hexed = _spans(F.col("_text"), HEX, "hex", lambda m, g: both(m))
    secret = let(hexed, lambda h: F.transform("base", lambda x: (x["rank"] == KINDS.index("assign")) | (x["rank"] == KINDS.index("hex")) & _over(x, h)))
    found = found.select("_row", "text_key", "base", "weak", F.when(F.size("weak") > 0, secret).alias("proofs"))
    found = stage(found, "secret-spans")
    part = lambda x, proof: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), proof.alias("secret"))
    proved = F.concat(F.transform("base", lambda x, i: part(x, F.get("proofs", i))), F.transform("weak", lambda x: part(x, x["rank"] == KINDS.index("weak"))))
    parts = found.where(F.size("weak") > 0).select("text_key", F.explode(proved).alias("p")).select("text_key", "p.*").distinct()
    linked = link(stage(parts, "secret-parts"), scope).groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("linked"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    out = found.join(stage(linked, "secret-links"), "text_key", "left")
    return out.select(*[F.col("_row")[c].alias(c) for c in rest], "base", F.coalesce("linked", none).alias("linked"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == KINDS.index(kind))).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
