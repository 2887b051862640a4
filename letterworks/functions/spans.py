"""Places of regular-expression matches as column expressions (code points, ends exclusive)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Parts a text's matches from the rest; texts that hold it are read another way.
MARK = "\ue000"
#: So many matches of a text are placed without a loop.
FEW = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use at many places of ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of ``{start, end, hit, part}`` of the leftmost matches; ``part`` is a group of each.

    Each match is put between marks, with its group behind it, in one pass of the pattern, and the text cut at the marks; the
    lengths of the pieces give running offsets, so no Python is needed. A text that holds the mark itself is read pass by pass.
    """
    kind = "array<struct<start:int,end:int,hit:string,part:string>>"
    width = 3 if group else 2

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        found = F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["part" if group else "hit"].alias("part")))
        return F.struct(end.alias("at"), F.concat(a["out"], found).alias("out"))

    def few_at(pieces: Column, i: int) -> Column:
        piece = lambda k: F.get(pieces, F.lit(k))
        before = [F.length(piece(j * width + k)) for j in range(i + 1) for k in ((0, 1) if j < i else (0,))]
        begin, hit = reduce(Column.__add__, before), piece(i * width + 1)
        return F.struct(begin.alias("start"), (begin + F.length(hit)).alias("end"), hit.alias("hit"), piece(i * width + (2 if group else 1)).alias("part"))

    def in_block(a: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(a["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    def located(pieces: Column) -> Column:
        piece = lambda i, k: F.get(pieces, i * width + k)
        rest = lambda i: [piece(i, 2).alias("part")] if group else []
        items = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / width).cast("int") - 1), lambda i: F.struct(F.length(piece(i, 0)).alias("gap"), piece(i, 1).alias("hit"), *rest(i)))
        # Appending copies, so matches are gathered in blocks and the blocks in a list of their own.
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        found = F.aggregate(in_blocks(items), start, in_block, lambda a: F.flatten(a["out"]))
        # Few matches, as most texts have, need neither blocks nor running sums.
        few = F.filter(F.array(*[few_at(pieces, i) for i in range(FEW)]), lambda x: x["hit"].isNotNull())
        return F.when(F.size(pieces) <= width, F.array().cast(kind)).when(F.size(pieces) <= FEW * width + 1, few.cast(kind)).otherwise(found)

    extracts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in ((0, group) if group else (0,))]
    passes = F.arrays_zip(F.split(text, pattern, -1), *extracts)
    slow = F.flatten(F.transform(passes, lambda x: F.array(*[x[str(k)] for k in range(width)])))
    fast = F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK + (f"${group}{MARK}" if group else "")), MARK, -1)
    return F.when(text.isNull(), F.array().cast(kind)).otherwise(let(F.when(text.contains(MARK), slow).otherwise(fast), located))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first of ``matches``, or null, without looking for others."""
    start = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
    hit, part = (F.regexp_extract(text, pattern, g) for g in (0, group))
    found = let(F.struct(start.alias("start"), hit.alias("hit"), part.alias("part")), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), x["part"].alias("part")))
    return F.when(text.rlike(pattern), found)


def holds(text: Column, words: Iterable[str]) -> Column:
    """Whether a text holds some of the words: plain searches."""
    return reduce(Column.__or__, [text.contains(w) for w in words])


def folded(text: Column) -> Column:
    """Lower case as patterns without regard to case see it, so that also the long s and the i without and with a dot are letters."""
    return F.lower(F.when(text.rlike("[ſıİ]"), F.translate(text, "ſıİ", "siI")).otherwise(text))


def in_blocks(items: Column, size: int = 256) -> Column:
    """The array cut into arrays of ``size``."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda k: F.slice(x, k * size + 1, size)))


def line_around(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The line that holds a span, and the offset of the span in it."""
    before = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    return F.concat(before, F.substring_index(F.substr(text, start + 1), "\n", 1)), F.length(before)


def once(df: DataFrame, name: str) -> DataFrame:
    """The frame with a costly column computed once, however often it is used later.

    A generator of one row stands between; expressions and filters are not moved through it.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(name)).alias(name))
