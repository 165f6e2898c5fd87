"""Quantities recorded in different units: a unit grammar over exponent vectors.

A unit expression is parsed into (factor, offset, dimension), where the dimension is the
vector of exponents of (length, mass, time, temperature).  Two units measure the same thing
exactly when their vectors are equal, so no list of convertible pairs is kept:

    expression := power-of-ten? factor ((·|*|blank|per|/) factor)*
    factor     := (square|cubic)? prefix? symbol exponent?

Defined results: a null, blank or unparsable unit gives null; so does a value that is null
or not above 0.  Rows are kept one to one; repeated rows convert alike; an empty table gives
an empty table.  Parsing is memoised by expression, values convert row by row without shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction as Q
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Dim = tuple[int, int, int, int]
NONE: Dim = (0, 0, 0, 0)
LENGTH, MASS, TIME, TEMPERATURE = (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)
FORCE, PRESSURE, SPEED = (1, 1, -2, 0), (-1, 1, -2, 0), (1, 0, -1, 0)
G = Q("9.80665")
LB = Q("0.45359237")

# Symbols in SI base units as (factor, dimension, takes prefixes).
SYMBOLS: dict[str, tuple[Q, Dim, bool]] = {
    "m": (Q(1), LENGTH, True), "g": (Q(1, 1000), MASS, True), "s": (Q(1), TIME, True), "K": (Q(1), TEMPERATURE, True),
    "N": (Q(1), FORCE, True), "Pa": (Q(1), PRESSURE, True), "bar": (Q(100000), PRESSURE, True), "dyn": (Q(1, 100000), FORCE, True),
    "gf": (G / 1000, FORCE, True), "lbf": (LB * G, FORCE, False), "ozf": (LB * G / 16, FORCE, False), "psi": (LB * G / Q("0.0254") ** 2, PRESSURE, False),
    "atm": (Q(101325), PRESSURE, False), "Torr": (Q(101325, 760), PRESSURE, True), "in": (Q("0.0254"), LENGTH, False), "ft": (Q("0.3048"), LENGTH, False),
    "min": (Q(60), TIME, False), "h": (Q(3600), TIME, False), "sec": (Q(1), TIME, False), "hr": (Q(3600), TIME, False), "kp": (G, FORCE, False), "p": (G / 1000, FORCE, False),
    "%": (Q(1, 100), NONE, False), "‰": (Q(1, 1000), NONE, False), "lb": (LB, MASS, False), "oz": (LB / 16, MASS, False),
}
# Names of units, in lower case and singular, by their symbol.
NAMES = {
    "metre": "m", "meter": "m", "gram": "g", "gramme": "g", "second": "s", "kelvin": "K", "newton": "N", "pascal": "Pa", "bar": "bar", "dyne": "dyn", "gram-force": "gf", "gram force": "gf",
    "pound-force": "lbf", "ounce-force": "ozf", "inch": "in", "inches": "in", "foot": "ft", "feet": "ft", "minute": "min", "hour": "h", "percent": "%", "per cent": "%", "pct": "%", "permille": "‰",
    "per mille": "‰", "per mil": "‰", "g-force": "gf", "pond": "p", "atmosphere": "atm",
}
# Names of plain numbers.
PLAIN = ("ratio", "fraction", "unitless", "dimensionless")
# Prefixes by symbol and by name.
PREFIX = {"p": -12, "n": -9, "u": -6, "m": -3, "c": -2, "d": -1, "h": 2, "k": 3, "M": 6, "G": 9}
PREFIX_NAMES = {"nano": -9, "micro": -6, "milli": -3, "centi": -2, "deci": -1, "hecto": 2, "kilo": 3, "mega": 6, "giga": 9}
# Scales with an offset: kelvin = (value + offset) * factor.
OFFSET = {"°C": (Q(1), Q("273.15")), "°F": (Q(5, 9), Q("459.67"))}

# The metrics with a common unit.
METRICS = {
    "thrust": "N", "thrust force": "N", "holding force": "N", "thrust density": "N/cm2", "shear stress": "kPa", "normal pressure": "kPa",
    "speed": "mm/s", "max speed": "mm/s", "maximum speed": "mm/s", "efficiency": "%",
}

_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_MICRO = str.maketrans("µμ−–·⋅∙", "uu--***")
_FACTOR = re.compile(r"\s*(?P<sq>(?:square|sq\.?|cubic)\s+)?(?P<name>[A-Za-z%‰°]+(?:-[A-Za-z]+)*)\s*(?:\^?\s*\(?(?P<exp>[+-]?\d+)\)?)?")
_TEN = re.compile(r"\s*(?:[x×*]\s*)?(?:10\s*\^?\s*(?P<a>[+-]?\d+)(?![\d.])|1\s*e\s*(?P<b>[+-]?\d+))\s*[*·]?\s*", re.I)
_LINK = re.compile(r"\s*(?P<op>\bper\b|/|\*|(?=\s*[A-Za-z%‰]))\s*")


def _symbol(word: str, fold: bool) -> tuple[Q, Dim] | None:
    """Factor and dimension of one unit word, prefix included.  ``fold`` ignores case; symbols
    and prefixes are then tried in the order of the tables, so the plain unit wins."""
    low = word.lower()
    for name in (low, low.removesuffix("s")):
        for prefix, power in [("", 0), *PREFIX_NAMES.items()]:
            rest = name.removeprefix(prefix).lstrip("-") if prefix else name
            if (not prefix or name.startswith(prefix)) and rest in NAMES:
                f, d, _ = SYMBOLS[NAMES[rest]]
                return f * Q(10) ** power, d
        if name.startswith("k") and name[1:].lstrip("-") in NAMES:  # kg-force, k-newton
            f, d, _ = SYMBOLS[NAMES[name[1:].lstrip("-")]]
            return f * 1000, d
    same = (lambda a, b: a.lower() == b.lower()) if fold else (lambda a, b: a == b)
    for s, (f, d, _) in SYMBOLS.items():
        if same(s, word):
            return f, d
    for s, (f, d, prefixed) in SYMBOLS.items():
        if prefixed and len(word) > len(s) and same(word[-len(s) :], s):
            for p, power in PREFIX.items():
                if same(p, word[: -len(s)]):
                    return f * Q(10) ** power, d
    return None


@lru_cache(maxsize=65536)
def parse_unit(text: str | None) -> tuple[Q, Q, Dim] | None:
    """(factor, offset, dimension) of a unit expression, or None: canonical = (value + offset) * factor."""
    s = (text or "").strip()
    while len(s) > 1 and s[0] + s[-1] in ("()", "[]", "{}"):
        s = s[1:-1].strip()
    s = s.translate(_SUPER).translate(_MICRO).rstrip(".").strip()
    if not s:
        return None
    if s in OFFSET:
        f, o = OFFSET[s]
        return f, o, TEMPERATURE
    if s.lower() in PLAIN:
        return Q(1), Q(0), NONE
    low = re.sub(r"\s+", " ", s.lower())
    if low in NAMES:
        f, d, _ = SYMBOLS[NAMES[low]]
        return f, Q(0), d
    for fold in (False, True):
        if (got := _product(s, fold)) is not None:
            return got[0], Q(0), got[1]
    return None


def _product(s: str, fold: bool) -> tuple[Q, Dim] | None:
    factor, dim, at, sign = Q(1), list(NONE), 0, 1
    if m := _TEN.match(s):
        factor, at = Q(10) ** int(m["a"] or m["b"]), m.end()
    first = True
    while at < len(s):
        if not first:
            m = _LINK.match(s, at)
            if not m:
                return None
            if m["op"] in ("per", "/"):
                sign = -1
            at = m.end()
        m = _FACTOR.match(s, at)
        if not m:
            return None
        word, at = m["name"], m.end()
        # a lone prefix letter before a blank belongs to the next word: "m N", "k Pa"
        if m["exp"] is None and word in PREFIX and (n := _FACTOR.match(s, at)) and (u := SYMBOLS.get(n["name"])) and u[2] and n["name"] in ("N", "Pa"):
            word, m, at = word + n["name"], n, n.end()
        got = _symbol(word, fold)
        if got is None:
            return None
        power = sign * int(m["exp"] or 1) * {"s": 2, "c": 3}.get((m["sq"] or "").strip().lower()[:1], 1)
        factor *= got[0] ** power
        dim = [a + b * power for a, b in zip(dim, got[1], strict=True)]
        first = False
    return None if first else (factor, tuple(dim))


_METRIC = re.compile(r"^\s*(?P<name>.*?)\s*(?:[\[(](?P<a>[^\])]*)[\])]|,\s*(?P<b>.+)|\s+in\s+(?P<c>.+))?\s*$", re.S)


@lru_cache(maxsize=65536)
def parse_metric(text: str | None) -> tuple[str | None, str | None]:
    """(name in lower case with single blanks, unit stated beside it) of a metric field."""
    if not text:
        return None, None
    m = _METRIC.match(text)
    name = re.sub(r"[\s_\-.]+", " ", m["name"]).strip().lower()
    return name, m["a"] or m["b"] or m["c"]


_NUMBER = r"[+-]?\d+(?:[.,]\d+)?(?:e[+-]?\d+)?"
_CUE = re.compile(rf"(?i)(?:^|\b)(?:(?:values?|readings?|data|numbers?)\s+(?:are\s+)?in|given\s+(?:as|in)|(?:table|column)\s+head(?:er|ing)?\s+says|units?\s*(?:is|are|:|=)|(?:stated|reported|expressed)\s+(?:as|in)|(?:reported|stated|measured)\s+(?:as\s+)?{_NUMBER}|^in)\s+(?P<unit>.+)$")


@lru_cache(maxsize=65536)
def note_unit(note: str | None) -> str | None:
    """The unit that the words of a note state for the value itself.  A quantity mentioned
    beside it ("gap 40 um", "target was 3 N") states none; a unit in brackets states itself."""
    for m in re.finditer(r"[\[(]([^\])]+)[\])]", note or ""):
        if parse_unit(m[1]) is not None:
            return m[1]
    for part in re.split(r"[,;](?!\d)", note or ""):
        if (m := _CUE.search(part.strip())) and parse_unit(m["unit"]) is not None:
            return m["unit"]
    return None


def stated_unit(metric: str | None, unit: str | None, note: str | None) -> str | None:
    """The unit of a row: its own field first, then the metric's words, then the note's."""
    if unit and unit.strip() not in ("", "-", "–", "—"):
        return unit
    return parse_metric(metric)[1] or note_unit(note)


def to_common(metric: str | None, value: float | None, unit: str | None, note: str | None) -> tuple[str, float, str] | None:
    """(metric, value in its common unit, common unit), or None where the point is not usable."""
    if value is None or not (isinstance(value, (int, float)) and math.isfinite(value) and value > 0):
        return None
    name = parse_metric(metric)[0]
    common = METRICS.get(name or "")
    parsed = parse_unit(stated_unit(metric, unit, note)) if common else None
    target = parse_unit(common) if common else None
    if parsed is None or parsed[2] != target[2]:
        return None
    exact = (Q(repr(float(value))) + parsed[1]) * parsed[0] / target[0] - target[1]
    if common == "%" and exact > 100:
        return None
    return name, float(exact), common


OUT = "common_metric string, common double, common_unit string"


def normalise(df: DataFrame, metric: str = "metric", value: str = "value", unit: str = "unit", note: str = "note") -> DataFrame:
    """``df`` with a struct column ``__common`` (metric, value, unit), null where no case."""

    @F.pandas_udf(OUT)
    def convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for m, v, u, n in batches:
            rows = [to_common(a, b, c, d) or (None, None, None) for a, b, c, d in zip(_none(m), _none(v), _none(u), _none(n), strict=True)]
            yield pd.DataFrame(rows, columns=["common_metric", "common", "common_unit"])

    return df.withColumn("__common", convert(F.col(metric), F.col(value).cast("double"), F.col(unit), F.col(note)))


def _none(s: pd.Series) -> list:
    return s.astype(object).where(s.notna(), None).tolist()
