"""German suffix stripping after the published Snowball rules, applied to distinct words in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Vowels, and the letters before which a final ``s`` or ``st`` may go.
VOWELS, S_BEFORE, ST_BEFORE = "aeiouyäöü", "bdfghklmnrt", "bdfghklmnt"


def _region(word: str, begin: int) -> int:
    """Where the part after the first vowel and consonant from ``begin`` starts."""
    found = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, begin)
    return found.end() if found else len(word)


def stem(word: str) -> str:
    w = word.lower().replace("ß", "ss")
    w = re.sub(f"(?<=[{VOWELS}])([uy])(?=[{VOWELS}])", lambda m: m[1].upper(), w)
    first = _region(w, 0)
    r2, r1 = _region(w, first), max(first, 3)
    if m := re.search("(ern|em|er)$|(en|es|e)$", w):
        if m.start() >= r1:
            w = w[: m.start()]
            if m[2] and w.endswith("niss"):
                w = w[:-1]
    elif w.endswith("s") and len(w) - 1 >= r1 and w[-2] in S_BEFORE:
        w = w[:-1]
    if m := re.search("(est|en|er)$", w):
        if m.start() >= r1:
            w = w[: m.start()]
    elif w.endswith("st") and len(w) - 2 >= r1 and len(w) >= 6 and w[-3] in ST_BEFORE:
        w = w[:-2]
    if m := re.search("(isch|ig|ik|end|ung|lich|heit|keit)$", w):
        if m.start() >= r2 and not (m[1] in ("isch", "ig", "ik") and w[: m.start()].endswith("e")):
            w = w[: m.start()]
            again = {"end": "ig", "ung": "ig", "lich": "er|en", "heit": "er|en", "keit": "lich|ig"}.get(m[1])
            if again and (n := re.search(f"({again})$", w)) and n.start() >= (r1 if m[1] in ("lich", "heit") else r2):
                w = w[: n.start()]
    return w.lower().translate(str.maketrans("äöü", "aou"))


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return words.map(lambda x: None if x is None else known[x] if x in known else known.setdefault(x, stem(x)))


def german_stem(c: Column) -> Column:
    return _stems(c)
