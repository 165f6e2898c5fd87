"""Edit distance with transpositions, and candidate search by deletion neighbourhoods.

Two words within ``k`` edits (insertion, deletion, substitution, swap of neighbours) share a
word that both become by deleting at most ``k`` characters, so an equality join on those
deletions finds every pair within the bound; the distance then verifies each candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: str, b: str, most: int = 99) -> int:
    """Restricted Damerau-Levenshtein distance, or ``most + 1`` where it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) or len(b), most + 1)
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most and min(one) > most:
            return most + 1
        two, one = one, now
    return min(one[-1], most + 1)


def deletions(word: str, k: int) -> set[str]:
    """The word and every word it becomes by deleting at most ``k`` characters."""
    out = level = {word}
    for _ in range(k):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def deletions_of(word: Column, k: Column) -> Column:
    """array<string> of :func:`deletions`; null words give an empty array."""

    @F.pandas_udf("array<string>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, ks in batches:
            yield pd.Series([sorted(deletions(w, int(n))) if w else [] for w, n in zip(words, ks, strict=True)], dtype=object)

    return of(word, k)


def distance_of(a: Column, b: Column) -> Column:
    """int distance of two string columns (both not null)."""

    @F.pandas_udf("int")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([distance(p, q) for p, q in zip(x, y, strict=True)], dtype="int32")

    return of(a, b)
