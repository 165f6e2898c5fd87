"""Several values packed in one field: a quote-aware finite-state tokenizer.

The scanner walks one field from left to right and keeps three pieces of state: the open
quote (if any), whether the next character is escaped, and the bracket depth.  Only
delimiters outside quotes and at bracket depth 0 end a value, so a quoted ``"Doe, Jane"``
stays whole.  Plain runs are skipped with one compiled pattern; the automaton is stepped
at the few characters that can change its state.

Defined results
* null, empty and blank fields give no row; empty places between delimiters give no row
  and take no position;
* positions count the emitted values from 1 within a field;
* repeated rows give the same values again (ask for ``distinct`` input where that matters);
* a quote that is never closed is an ordinary character; so is a bracket never closed;
* texts of any length are scanned whole, once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delimiters that always separate, the quotes and the brackets.
STRONG = ";；|/\n\r\t、，･·"
WEAK = ","
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}
BRACKETS = {"[": "]", "(": ")", "{": "}"}
WORD_DELIMITERS = ("and", "und", "&", "＆")
# Words that stand for unnamed further values.
UNNAMED = re.compile(
    r"(?i)(?:^|(?<=\s)|(?<=等))(?:\[?\(?et\.?\s+al(?:ii|\.)?\.?\)?\]?|(?:and|&)\s+(?:others?|co-?workers)|others|u\.\s?a\.|et\s+coll\.?|and\s+colleagues|等|…|\.\.\.)\s*$"
)

_SPECIAL = re.compile("[" + re.escape(STRONG + WEAK + "\\" + "".join(QUOTES) + "".join(QUOTES.values()) + "".join(BRACKETS) + "".join(BRACKETS.values())) + "]")
_WORDS = re.compile(r"(?:(?<=\s)|(?<=,)|^)(?:and|und|&|＆)(?=\s)")
_INITIALS = re.compile(r"(?:[^\W\d_](?:\.[\s\-]?|[\s\-]|$))+")
_SPACE = re.compile(r"\s+")


def scan(text: str) -> list[tuple[str, str, bool]]:
    """The values of a field as (delimiter before it, value, quoted).

    A field that is one bracketed list (``["a", "b"]``) is read as the list inside.
    """
    s = text.strip()
    while len(s) > 1 and s[0] in BRACKETS and s[-1] == BRACKETS[s[0]] and _closes(s) == len(s) - 1:
        s = s[1:-1].strip()
    out: list[tuple[str, str, bool]] = []
    buf: list[str] = []
    quoted, before, at, depth, n = False, "", 0, 0, len(s)
    while at < n:
        m = _SPECIAL.search(s, at)
        if m is None:
            buf.append(s[at:])
            break
        buf.append(s[at : m.start()])
        c, at = m.group(), m.end()
        if c == "\\":
            buf.append(s[at : at + 1] or c)
            at += 1
        elif c in QUOTES and not depth and not "".join(buf).strip():
            value, end = _quoted(s, at, QUOTES[c])
            if end < 0:
                buf.append(c)
            else:
                buf, quoted, at = [value], True, end
        elif c in BRACKETS and (end := _closes(s[m.start() :])) > 0:
            buf.append(s[m.start() : m.start() + end + 1])
            at = m.start() + end + 1
        elif c in STRONG or c == WEAK:
            out += _ended(before, buf, quoted)
            buf, quoted, before = [], False, c
        else:
            buf.append(c)
    return out + _ended(before, buf, quoted)


def _ended(before: str, buf: list[str], quoted: bool) -> list[tuple[str, str, bool]]:
    """The value in ``buf``; words behind a closing quote that go on with the list are its own piece."""
    tail = "".join(buf[1:]).strip() if quoted else ""
    if tail and (_WORDS.match(tail + " ") or UNNAMED.search(tail)):
        return [(before, buf[0], True), ("&", tail, False)]
    return [(before, "".join(buf), quoted)]


def _quoted(s: str, at: int, close: str) -> tuple[str, int]:
    """The text up to the closing quote and the place after it; (…, -1) if it never closes.
    A backslash escapes one character, a doubled quote stands for one."""
    buf: list[str] = []
    while at < len(s):
        c = s[at]
        if c == "\\" and at + 1 < len(s):
            buf.append(s[at + 1])
            at += 2
        elif c == close:
            if s[at + 1 : at + 2] == close:
                buf.append(c)
                at += 2
            else:
                return "".join(buf), at + 1
        else:
            buf.append(c)
            at += 1
    return "", -1


def _closes(s: str) -> int:
    """Place of the bracket that closes s[0], quotes and nesting respected; -1 if none does."""
    stack, at = [], 0
    while at < len(s):
        c = s[at]
        if c == "\\":
            at += 1
        elif c in QUOTES:
            end = _quoted(s, at + 1, QUOTES[c])[1]
            at = end - 1 if end > 0 else at
        elif c in BRACKETS:
            stack.append(BRACKETS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return at
        at += 1
    return -1


def split_values(text: str | None, names: bool = True) -> list[str]:
    """The values of one field in order.

    With ``names``, the words ``and``/``und``/``&`` also separate, a family name and the
    given names after a comma are one value, and words for unnamed further people fall out.
    A piece of one word cannot be a whole name, so the comma after it joins; a comma after
    a piece of several words separates.
    """
    if not text or text.isspace():
        return []
    pieces: list[tuple[str, str, bool]] = []
    for before, value, quoted in scan(text):
        if quoted or not names:
            pieces.append((before, value, quoted))
            continue
        for i, part in enumerate(_WORDS.split(value)):
            pieces.append((before if i == 0 else "&", part, False))
    out: list[str] = []
    single = False  # the last value is one unquoted word that may take given names
    for before, value, quoted in pieces:
        value = _SPACE.sub(" ", value).strip()
        while len(value) > 1 and BRACKETS.get(value[0]) == value[-1] and _closes(value) == len(value) - 1:
            value = value[1:-1].strip()
        if not value:
            single = single and before == WEAK
            continue
        if names and not quoted:
            value = _SPACE.sub(" ", UNNAMED.sub("", value)).strip().rstrip(",").strip()
            if not value or value.lower() in ("et al", "et al.", "others", "al.", "al"):
                single = False
                continue
        words = value.split(" ")
        if names and single and before == WEAK and not quoted and _given(words):
            out[-1] += ", " + value
            single = False
            continue
        out.append(value)
        single = not quoted and len(words) == 1 and not _INITIALS.fullmatch(value)
    return out


def _given(words: Sequence[str]) -> bool:
    """Whether the words can be given names: at most one is a full word, or none is."""
    return sum(not _INITIALS.fullmatch(w) for w in words) <= 1 or all(w[:1].isupper() for w in words[:2]) and len(words) == 2


def packed_values(value: Column, names: bool = True) -> Column:
    """array<string> of the values packed in ``value`` (Arrow batches, each text scanned once)."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known: dict[str, list[str]] = {}
            yield pd.Series([known[t] if t in known else known.setdefault(t, split_values(t, names)) for t in batch])

    return split(value)


def unpack(df: DataFrame, value: str, keys: Sequence[str], out: str = "value", pos: str = "pos", names: bool = True) -> DataFrame:
    """One row per value of ``df[value]``: the key columns, ``pos`` (int from 1) and ``out``.

    Rows equal in keys and field are read once, so double imports give no double rows; the
    only shuffle is that ``distinct`` on short rows.  All other columns of ``df`` are left out.
    """
    rows = df.select(*keys, F.col(value).alias("__packed")).where(F.col("__packed").isNotNull()).distinct()
    split = rows.withColumn("__packed", packed_values(F.col("__packed"), names))
    return split.select(*keys, F.posexplode("__packed").alias("__i", out)).select(*keys, (F.col("__i") + 1).cast("int").alias(pos), out)
