"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed character class: the six ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"
BLANK_CHARS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use at many places of ``body``, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: Column) -> Column:
    """The text itself; null is the empty text."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters that are no ASCII blank."""
    return F.array_remove(F.split(whole(text), BLANK + "+", -1), "")


def n_words(text: Column) -> Column:
    """How many words a text has, without building them."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def text_key(text: Column) -> Column:
    """A 128-bit key of a whole text; equal texts, and in practice only those, share it. Null is the empty text."""
    return F.unhex(F.md5(whole(text)))
