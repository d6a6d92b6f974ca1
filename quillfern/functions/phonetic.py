"""Similarity and sound codes of words; Arrow-batched, computed once for each distinct pair or word."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F


def jaro_winkler_similarity(a: str, b: str, weight: float = 0.1, boost_above: float = 0.7) -> float:
    """Jaro's similarity, raised by up to four common first characters where it is above boost_above."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    ours = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                ours.append(ch)
                break
    m = len(ours)
    if not m:
        return 0.0
    theirs = [ch for ch, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(ours, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= boost_above:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro)


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


_SILENT_START = ("kn", "gn", "pn", "wr", "ae")
_PLAIN = {"d": "T", "f": "F", "j": "J", "l": "L", "m": "M", "n": "N", "q": "K", "r": "R", "v": "F", "z": "S"}


def metaphone(word: str) -> str:
    """A sound code after Philips' rules of 1990 for one lower-case Latin word; characters outside a-z are skipped."""
    s = "".join(c for c in word.lower() if "a" <= c <= "z")
    if s[:2] in _SILENT_START:
        s = s[1:]
    if s[:1] == "x":
        s = "s" + s[1:]
    if s[:2] == "wh":
        s = "w" + s[2:]
    out = []
    at = lambda i: s[i] if 0 <= i < len(s) else ""
    i = 0
    while i < len(s):
        c, nxt, prev = s[i], at(i + 1), at(i - 1)
        if c == prev and c != "c":
            i += 1
            continue
        if c in "aeiou":
            if i == 0:
                out.append(c.upper())
        elif c == "b":
            if not (prev == "m" and i == len(s) - 1):
                out.append("B")
        elif c == "c":
            if nxt == "h":
                out.append("K" if prev == "s" else "X")
                i += 1
            elif s[i : i + 3] == "cia":
                out.append("X")
            elif nxt and nxt in "iey":
                if prev != "s":
                    out.append("S")
            else:
                out.append("K")
        elif c == "d" and nxt == "g" and at(i + 2) and at(i + 2) in "eiy":
            out.append("J")
            i += 2
        elif c == "g":
            if nxt == "h" and not (at(i + 2) and at(i + 2) in "aeiou"):
                i += 1
            elif nxt == "n" and (i + 2 >= len(s) or s[i:] == "gned"):
                pass
            elif nxt and nxt in "iey":
                out.append("J")
            else:
                out.append("K")
        elif c == "h":
            if nxt and nxt in "aeiou" and prev not in ("c", "s", "p", "t", "g"):
                out.append("H")
        elif c == "k":
            if prev != "c":
                out.append("K")
        elif c == "p":
            if nxt == "h":
                out.append("F")
                i += 1
            else:
                out.append("P")
        elif c == "s":
            if nxt == "h" or s[i : i + 3] in ("sio", "sia"):
                out.append("X")
                i += nxt == "h"
            else:
                out.append("S")
        elif c == "t":
            if s[i : i + 3] in ("tia", "tio"):
                out.append("X")
            elif nxt == "h":
                out.append("0")
                i += 1
            elif s[i : i + 3] != "tch":
                out.append("T")
        elif c in "wy":
            if nxt and nxt in "aeiou":
                out.append(c.upper())
        elif c == "x":
            out += ["K", "S"]
        elif c in _PLAIN:
            out.append(_PLAIN[c])
        i += 1
    return "".join(out)


def pair_udf(fn):
    """A pandas UDF of two string columns from a function of two strings that gives a number; null if either is null."""

    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(each, "double")


def word_udf(fn):
    """A pandas UDF of a string column from a function of a string that gives a string; null stays null."""

    def each(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in a], dtype="object")

    return F.pandas_udf(each, "string")
