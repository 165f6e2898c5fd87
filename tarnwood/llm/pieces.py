"""Oversized texts cut into overlapping pieces at natural boundaries, by dynamic programming.

A piece is a stretch [start, end) of at most ``limit`` characters.  The next piece starts at
most ``overlap`` characters before the end of the last one.  Ends and starts are chosen among
the natural boundaries of the text (paragraph, line, sentence, clause, word); where a stretch
has none, a cut between characters is allowed at a high price.

A piece costs the penalty of the cut at its end, half the penalty of the place it starts at,
how far its overlap falls short of the wanted one, and the squared imbalance against equal
pieces.  ``cost[e]`` is the least cost of covering the text up to boundary ``e``, ``begun[s]``
the least cost with the next piece begun at ``s``; ends and starts are both chosen over all
boundaries, in one pass over an array.  A cover found greedily bounds the cost from above;
places whose cost passes that bound are left out, which loses no cheaper cover.  Cuts between
characters are tried, at every character, where no cover of natural boundaries alone is as
cheap as one with a single such start can be.  At last each start goes back to the farthest
natural place that the wanted overlap and the limit allow.

Defined results: null and empty texts give no piece; a text within the limit is one piece; the
pieces cover the text whole and in order; code points are never split.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Boundaries, as pattern and penalty of a cut after the match.
BOUNDARIES = (
    (re.compile(r"\n[^\S\n]*\n\s*"), 0.0),
    (re.compile(r"\n"), 2.0),
    (re.compile(r"[。！？．]|[.!?][\"'”’)\]]*\s"), 1.0),
    (re.compile(r"[;；]\s*|[:：,，、]\s?"), 4.0),
    (re.compile(r"\s+"), 8.0),
)
FORCED = 60.0
PIECE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def boundaries(text: str, cell: int = 1, forced: bool = True) -> tuple[list[int], list[float]]:
    """Places (ascending) and penalties of all natural cuts; with ``forced`` also a cut in the
    middle of each cell of ``cell`` characters that has none."""
    n = len(text)
    best: dict[int, float] = {}
    for pattern, penalty in BOUNDARIES:
        for m in pattern.finditer(text):
            at = m.end()
            if 0 < at < n and penalty < best.get(at, FORCED):
                best[at] = penalty
    if forced:
        taken = {at // cell for at in best}
        for c in range(n // cell + 1):
            if c not in taken and 0 < (at := min(n - 1, c * cell + cell // 2)) < n:
                best[at] = FORCED
    places = sorted(best)
    return [0, *places, n], [0.0, *(best[at] for at in places), 0.0]


def _imbalance(size: int, ideal: float) -> float:
    return 12.0 * ((size - ideal) / ideal) ** 2 + 3.0


def _greedy(at: list[int], penalty: list[float], limit: int, overlap: int, ideal: float) -> float:
    """The cost of one cover, each piece ended and the next begun where that is cheapest by itself;
    infinite if it comes to a stretch without places."""
    n, start, end, total = at[-1], 0, 0, 0.0
    while n - at[start] > limit:
        ends = range(max(end, start) + 1, bisect_right(at, at[start] + limit))
        far = [j for j in ends if at[j] > at[start] + overlap] or ends
        if not far:
            return float("inf")
        end = min(far, key=lambda j: penalty[j] + _imbalance(at[j] - at[start], ideal))
        total += penalty[end] + _imbalance(at[end] - at[start], ideal)
        price = lambda j: penalty[j] * 0.5 + (10.0 * (overlap - (at[end] - at[j])) / overlap if overlap else 0.0)  # noqa: B023, E731
        start = min(range(bisect_left(at, max(at[end] - overlap, at[start] + 1)), end + 1), key=price)
        total += price(start)
    return total + _imbalance(n - at[start], ideal)


def _cover(at: list[int], penalty: list[float], limit: int, overlap: int, ideal: float) -> tuple[float, list[tuple[int, int]]]:
    """(cost, pieces) of the cheapest cover over all the given places."""
    most = _greedy(at, penalty, limit, overlap, ideal) + 1e-9
    place, half = np.array(at), np.array(penalty) * 0.5
    price = np.array([_imbalance(d, ideal) for d in range(limit + 1)])
    short = np.array([10.0 * (overlap - d) / overlap if overlap else 0.0 for d in range(overlap + 1)])
    rest = 3.0 * -((place - place[-1]) // limit)  # each piece yet to come costs at least that
    begun, of = np.full(len(at), np.inf), np.zeros(len(at), dtype=np.int64)  # of: the end before the start
    begun[0] = 0.0
    before: dict[int, tuple[int, int]] = {}
    total, last, first_open = float("inf"), len(at) - 1, 1
    lows, highs = np.searchsorted(place, place - limit).tolist(), np.searchsorted(place, place - overlap).tolist()
    rest_of = rest.tolist()
    for j in range(1, last + 1):
        lo, hi = lows[j], min(j, first_open)
        if lo >= hi:
            continue
        costs = begun[lo:hi] + price[at[j] - place[lo:hi]]
        i = int(costs.argmin())
        cost = float(costs[i]) + penalty[j]
        if cost + rest_of[j] > most:
            continue
        before[j] = lo + i, int(of[lo + i])
        if j == last:
            total = cost
            break
        lo = highs[j]
        starts = cost + half[lo : j + 1] + short[at[j] - place[lo : j + 1]]
        better = starts < begun[lo : j + 1]
        begun[lo : j + 1][better] = starts[better]
        of[lo : j + 1][better] = j
        first_open = j + 1
    out, j = [], last
    while j > 0 and j in before:
        start, end = before[j]
        out.append((at[start], at[j]))
        j = end
    return total, out[::-1]


def cut_points(text: str, limit: int, overlap: int, cell: int = 1) -> list[tuple[int, int]]:
    """(start, end) of each piece."""
    n = len(text)
    if not n:
        return []
    if n <= limit:
        return [(0, n)]
    count = max(2, -(-(n - overlap) // max(1, limit - overlap)))
    ideal = overlap + (n - overlap) / count
    natural, penalty = boundaries(text, forced=False)
    total, out = _cover(natural, penalty, limit, overlap, ideal)
    if total > FORCED * 0.5 + 3.0 * -(-n // limit):
        total, out = _cover(*boundaries(text, cell), limit, overlap, ideal)
    # between fixed ends nothing but its limit keeps a piece from a longer overlap
    for k in range(1, len(out)):
        start, end = out[k]
        far = natural[bisect_left(natural, max(out[k - 1][1] - overlap, end - limit, out[k - 1][0] + 1))]
        out[k] = min(start, far), end
    return out


def split_long(df: DataFrame, key: str, text: str, limit: int = 1920, overlap: int = 160, whole: bool = False) -> DataFrame:
    """(key, piece_no, start_at, piece) of every text over ``limit`` characters (of all with ``whole``).

    ``start_at`` counts characters from 0.  Each row is cut by itself: no shuffle, and the
    filter on the length runs before any text reaches Python.
    """

    @F.pandas_udf(PIECE)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b} for a, b in cut_points(t, limit, overlap)] for t in texts], dtype=object)

    long = df.where(F.length(text) > (0 if whole else limit)).select(F.col(key), F.col(text).alias("__text"))
    pieces = long.select(key, "__text", F.posexplode(cut("__text")).alias("__i", "__p"))
    return pieces.select(key, (F.col("__i") + 1).cast("int").alias("piece_no"), F.col("__p.start").alias("start_at"), F.substring("__text", F.col("__p.start") + 1, F.col("__p.end") - F.col("__p.start")).alias("piece"))
