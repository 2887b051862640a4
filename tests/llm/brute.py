"""Plain single-machine versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines(texts, min_docs=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for ls in split for k in {key(x) for x in ls})
    out = []
    for ls in split:
        kept = [x for x in ls if not (key(x) and n[key(x)] >= min_docs)]
        out.append((len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def quality(text):
    w = WORD.findall(text or "")
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(runs)
    in_twice = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(w) < 50 or 100 * len(in_twice) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(in_twice), failed


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    listed = [f"{k}:{s}:{e}" for s, _, e, k in found]
    n = Counter(k for *_, k in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(listed).encode()).hexdigest(), listed


def weak_parts(text, patterns, base):
    """(start, end, role) of the parts to link: ``patterns`` are (pattern, role, test of the match)."""
    found = set()
    for pattern, role, test in patterns:
        found |= {(m.start(), m.end(), role) for m in re.finditer(pattern, text) if test(m)}
    over = lambda x, y: x[0] < y[1] and y[0] < x[1]
    names = [x for x in found if x[2] == "ident"]
    found = {x for x in found if x[2] != "endpoint" or not any(over(x, n) for n in names)}
    return sorted(x for x in found if not any(over(x, b) for b in base))


def links(text, patterns, scope=200):
    """Weak parts with a complementary part in scope, by pairs."""
    text = text or ""
    base = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in secrets(text)[4])]
    weak = weak_parts(text, patterns, base)
    digits = lambda x: x[2] == "hex" and (text[x[0] : x[1]].isdigit() or text[x[0] : x[1]].isalpha())
    proof = [x for x in base if x[2] == "assign" or x[2] == "hex" and not digits(x)] + [x for x in weak if x[2] == "weak"]
    company = [x for x in base if x[2] == "access"] + [x for x in weak if x[2] != "weak"]
    near = lambda x, y: x[0] <= y[1] + scope and x[1] >= y[0] - scope
    return [x for x in weak if any(near(y, x) for y in (company if x[2] == "weak" else proof))]
