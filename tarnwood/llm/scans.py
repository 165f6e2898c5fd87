"""Repair of text read from scanned pages.

Kinds of noise found per line: words broken to fit the line (``hyphen``), misread characters
(``char``), running heads (``header``) and page numbers (``pageno``).

* Vocabulary: one pass counts the words of the whole corpus, pre-aggregated per task; words of
  at least ``LEAST`` occurrences are the vocabulary, whatever the size of the corpus.  The
  ``MOST_WORDS`` most frequent are broadcast.  If there are more, the spellings of each text that
  are not among those are joined to the counts of the others, by the word, its skeleton and the
  skeleton less one character, and each text is judged with the rare words it asked for.
* Misread words: scanners confuse characters that look alike.  Every word is written in a skeleton
  alphabet in which such characters are equal; the vocabulary's skeletons form a trie and its words
  another, and the Levenshtein automaton of a spelling is intersected with both, which retrieves all
  vocabulary words within the bound: look-alikes first, then any one letter put in, left out or
  replaced.  A candidate must be far more frequent than the spelling it explains, the more so the
  shorter the word; other forms of a word are no candidates.  Candidates are ranked by edits, then by the
  neighbouring words, then by frequency.
* Broken words: the halves around page furniture are joined and looked up with and without the
  hyphen; the more frequent spelling decides whether the sign belongs to the word.
* Page furniture: a line that repeats the paper's title (whole, or its beginning after names), that
  gives a short title of the journal with volume and year, or that interrupts the text on many pages of one file only, is a running head; a number alone on a
  line is a page number if it fits the file's own distance between printed and counted pages, else
  if it is dressed as one or stands outside columns of numbers.

Defined results: null and empty texts have no noise and come out as they are; texts are read
whole; copies of a segment are judged alike; a file without a title is judged by its name; an
empty table gives empty results.  A file that holds a third of all rows is spread over tasks as
it lies; only its counted facts come together.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.session import cut

#: A vocabulary word has at least so many occurrences; so many words are broadcast.
LEAST, MOST_WORDS = 3, 100_000
#: Pairs of neighbouring words up to which their counts are broadcast; beyond, each text is joined to those it asks for.
PAIRS = 200_000
#: A spelling is a misreading only if the word it stands for is this many times as frequent; one that is a word of
#: the vocabulary itself is the misreading of another letter only if that word is FAR times as frequent.
TIMES, FAR = 16, 4096
#: Lines of an unrecognised figure or table that may stand between the halves of a word, with the line of the second half.
BETWEEN = 6
BREAKS = "-‐‑¬­"
FACT_ROWS = 1_000_000

# Characters and pairs that scanners confuse, each written as one skeleton.
SKELETON = {
    "0": "o", "1": "l", "|": "l", "!": "l", "i": "l", "ı": "l", "5": "s", "$": "s", "@": "a", "€": "c", "e": "c", "f": "t", "9": "g", "q": "g", "6": "b", "8": "b",
    "n": "rl", "m": "rrl", "d": "cl", "h": "ll", "w": "vv", "u": "ll", "£": "e", "¬": "", "­": "", "7": "t", "2": "z",
}
_SKELETON = str.maketrans(SKELETON)
_OUTER = ".,;:()[]{}\"'“”‘’«»!?…–—"
_PLAIN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]")
_BROKEN = re.compile(rf"[{BREAKS}][^\S\n]*\n\s*")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_DIGITS = str.maketrans("OoIlSsBZ|/", "0011558217")


def skeleton(s: str) -> str:
    return s.lower().translate(_SKELETON)


def core(token: str) -> str:
    """The word in a token: lower case, no outer punctuation, no possessive ending."""
    t = token.strip(_OUTER).lower()
    return t[:-2] if t.endswith(("'s", "’s")) else t


def form_of(a: str, b: str) -> bool:
    """Whether two words one letter apart may be forms or spellings of one word: an ending more or another
    ending, a- or e- before it, a consonant doubled before an ending, s or z, or or our, e or ae."""
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return p == len(a) - 1 and {a[p], b[p]} <= set("sdrny") or {a[p], b[p]} == {"s", "z"}
    long = max(a, b, key=len)
    if p in (0, len(long) - 1):
        return long[p] in ("ae" if p == 0 else "sdrny")
    return long[p] == long[p - 1] and long[p] in "lpst" and long[p + 1] in "ei" or long[p - 1 : p + 2] == "our" or long[p - 1 : p + 1] == "ae" or long[p : p + 2] == "ae"


def reach_of(token: str) -> str:
    """How far candidates may lie from a token as it stands in a text: ``name`` where it may be a name, else ``word``."""
    t = token.strip(_OUTER)
    return "name" if t[:1].isupper() and not t.isupper() else "word"


class Trie:
    """Words by skeleton, searched with a Levenshtein automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, word: str) -> None:
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(word)

    def within(self, key: str, k: int) -> list[tuple[int, str]]:
        """(edits, word) of all words whose key is within ``k`` edits.  A state is the set of
        (place in the key, edits so far) the automaton can be in after the letters of a node."""
        if k == 0:
            node = self.root
            for c in key:
                node = node.get(c)
                if node is None:
                    return []
            return [(0, w) for w in node.get("", ())]
        n, out = len(key), []
        stack = [(self.root, {i: i for i in range(min(k, n) + 1)})]
        while stack:
            node, states = stack.pop()
            ends = [e + n - i for i, e in states.items() if e + n - i <= k]
            if ends and "" in node:
                out += [(min(ends), w) for w in node[""]]
            # a state without edits left goes on with its own letter only
            if min(states.values()) < k:
                ways = [(c, child) for c, child in node.items() if c]
            else:
                ways = [(c, node[c]) for c in {key[i] for i in states if i < n} if c in node]
            for c, child in ways:
                nxt: dict[int, int] = {}
                for i, e in states.items():
                    if i < n:
                        cost = e + (key[i] != c)
                        if cost <= k and cost < nxt.get(i + 1, k + 1):
                            nxt[i + 1] = cost
                    if e < k and e + 1 < nxt.get(i, k + 1):
                        nxt[i] = e + 1
                for i in sorted(nxt):  # letters of the key left out
                    e = nxt[i]
                    while e < k and i < n:
                        i, e = i + 1, e + 1
                        if e < nxt.get(i, k + 1):
                            nxt[i] = e
                if nxt:
                    stack.append((child, nxt))
        return out


class Lexicon:
    """The vocabulary with what is asked of it; answers are remembered."""

    def __init__(self, counts: dict[str, int], pairs: dict[tuple[str, str], int] | None = None):
        self.counts, self.pairs = counts, pairs or {}
        self.source = None
        self.alike, self.letters = Trie(), Trie()
        heads: Counter = Counter()
        for w, n in counts.items():
            if _PLAIN.fullmatch(w):
                self.alike.add(skeleton(w), w)
                if n >= TIMES:
                    self.letters.add(w, w)
                for i, c in enumerate(w):
                    if c == "-":
                        heads[w[:i]] += n
        self.heads = heads
        self.meant: dict[tuple[str, str], list[tuple[int, str]]] = {}
        self.bad: dict[str, str] = {}
        self.good: set[str] = set()
        self.sure: set[str] = set()

    def candidates(self, word: str, reach: str = "word") -> list[tuple[int, str]]:
        """(edits, vocabulary word) that a spelling may stand for, the likeliest first; empty if it stands for itself.

        ``reach`` is ``alike`` for look-alike characters, ``word`` for any letter, ``name`` for any letter of
        what may be a name, which asks for more evidence."""
        got = self.meant.get((word, reach))
        if got is None:
            if len(self.meant) > 500_000:
                self.meant.clear()
            got = self.meant[(word, reach)] = self._candidates(word, reach)
        return got

    def _candidates(self, word: str, reach: str) -> list[tuple[int, str]]:
        if len(_LETTERS.findall(word)) < 2:
            return []
        own, key, plain = self.counts.get(word, 0), skeleton(word), _PLAIN.fullmatch(word) is not None
        enough = TIMES * max(1, own)
        near = [(e, w) for e, w in self.alike.within(key, 0) if w != word and self.counts[w] >= enough]
        if not near and not plain and len(word) >= 5 and "." not in word:
            near = [(e, w) for e, w in self.alike.within(key, 1) if self.counts[w] >= enough and len(w) >= 4]
        if not near and plain and reach != "alike" and len(word) > 2 and not _CJK.search(word):
            n = len(word)
            enough = max(FAR * own, TIMES * (1 if n >= 7 else 4 if n >= 5 else 64)) * (TIMES if reach == "name" else 1)
            near = [(e, w) for e, w in self.letters.within(word, 1) if e and self.counts[w] >= enough and not form_of(word, w)]
        if not near and "-" in word and own == 0:
            parts = [p for p in word.split("-") if p]
            read = [(p, self.candidates(p, "alike")) for p in parts]
            if any(c for _, c in read) and all(c or self.counts.get(p, 0) >= LEAST for p, c in read):
                near = [(sum(min(c)[0] for _, c in read if c), "-".join(min(c, key=self._rank)[1] if c else p for p, c in read))]
        return sorted(near, key=self._rank)

    def _rank(self, c: tuple[int, str]) -> tuple[int, int, str]:
        return c[0], -self.counts.get(c[1], 0), c[1]

    def tied(self, word: str, reach: str = "word") -> list[str]:
        """The candidates of least edits."""
        near = self.candidates(word, reach)
        return [w for e, w in near if e == near[0][0]]

    def best(self, word: str, left: str = "", right: str = "", reach: str = "word") -> str | None:
        """The likeliest candidate between its neighbours, or None."""
        tied = self.tied(word, reach)
        if len(tied) < 2 or not self.pairs:
            return tied[0] if tied else None
        context = lambda w: self.pairs.get((left, w), 0) + self.pairs.get((w, right), 0)
        return max(tied, key=lambda w: (context(w), self.counts.get(w, 0), w))

    def known(self, word: str) -> int:
        """How frequent a spelling is, or the word it is misread from."""
        n = self.counts.get(word, 0)
        near = self.candidates(word, "alike")
        return self.counts.get(near[0][1], 1) if near else n

    def misread(self, tokens: set[str]) -> dict[str, str]:
        """Of tokens as they stand in a text, those that are misread, with their word."""
        found: dict[str, str] = {}
        for t in tokens - self.good:
            w = self.bad.get(t)
            if w is None:
                near = self.candidates(core(t), reach_of(t))
                if not near:
                    self.good.add(t)
                    continue
                w = self.bad[t] = near[0][1]
            found[t] = w
        if len(self.good) > 1_000_000:
            self.good.clear()
        if len(self.bad) > 1_000_000:
            self.bad.clear()
        return found


class Both:
    """Two tries asked as one."""

    def __init__(self, one: Trie, other: Trie):
        self.one, self.other = one, other

    def within(self, key: str, k: int) -> list[tuple[int, str]]:
        return self.one.within(key, k) + self.other.within(key, k)


class Local(Lexicon):
    """A lexicon with the rare words that one text asks for and, where they are not broadcast, its pairs of
    neighbours.  A word of the base is more frequent than any rare one, so the base answers for it."""

    def __init__(self, base: Lexicon, rare: dict[str, int], pairs: dict[tuple[str, str], int] | None = None):
        self.base, self.pairs = base, base.pairs if pairs is None else pairs
        words = {w: n for w, n in rare.items() if not w.endswith("-")}
        self.counts = ChainMap(words, base.counts)
        self.heads = ChainMap({w[:-1]: n for w, n in rare.items() if w.endswith("-")}, base.heads)
        alike, letters = Trie(), Trie()
        for w, n in words.items():
            alike.add(skeleton(w), w)
            if n >= TIMES:
                letters.add(w, w)
        self.alike, self.letters = Both(base.alike, alike), Both(base.letters, letters)
        self.meant, self.bad, self.good = {}, {}, set()

    def candidates(self, word: str, reach: str = "word") -> list[tuple[int, str]]:
        return self.base.candidates(word, reach) if word in self.base.counts else super().candidates(word, reach)

    def misread(self, tokens: set[str]) -> dict[str, str]:
        rest, sure = set(), self.base.sure
        for t in tokens - sure:
            w = core(t)
            if w in self.base.counts and not self.base.candidates(w, reach_of(t)):
                sure.add(t)
            else:
                rest.add(t)
        if len(sure) > 1_000_000:
            sure.clear()
        return super().misread(rest)


class Asked:
    """Stands in for a lexicon and notes the spellings it is asked for, but for ``frequent`` ones.
    It knows no word, so that all places for the second half of a broken word are tried, and
    counts every part, so that the other part is asked for too."""

    def __init__(self, frequent: dict[str, int]):
        self.frequent, self.words, self.sure = frequent, set(), set()
        self.counts, self.heads = self, _Heads(self)

    def note(self, word: str) -> None:
        if word not in self.frequent and _LETTERS.search(word):
            self.words.add(word)
            if "-" in word:
                self.words.update(p for p in word.split("-") if p and p not in self.frequent)

    def get(self, word: str, _: int = 0) -> int:
        self.note(word)
        return LEAST

    def known(self, word: str) -> int:
        self.note(word)
        return 0

    def best(self, word: str, left: str = "", right: str = "", reach: str = "word") -> None:
        self.note(word)

    def candidates(self, word: str, reach: str = "word") -> list:
        return []

    def misread(self, tokens: set[str]) -> dict[str, str]:
        for t in tokens - self.sure:
            w = core(t)
            if w in self.frequent:
                self.sure.add(t)
            else:
                self.note(w)
        if len(self.sure) > 1_000_000:
            self.sure.clear()
        return {}


class _Heads:
    def __init__(self, asked: Asked):
        self.asked = asked

    def get(self, word: str, _: int = 0) -> int:
        self.asked.words.add(word + "-")
        return 1


_ROMAN = re.compile(r"(?=[ivxlc])(?:x[lc]|l?x{0,4}|c{1,3}l?x{0,4})(?:ix|iv|v?i{0,4})", re.I)
_NUMBER = re.compile(r"(?:[\d OIlSBZ|/]|of){1,12}")
_DRESSED = re.compile(r"(?i)(?:[-–—~•]\s*(?P<a>[\dOIlSsBZ|/]{1,5}|[ivxlc]+)\s*[-–—~•]|\[\s*(?P<b>[\dOIlSsBZ|/]{1,5}|[ivxlc]+)\s*\]|\(\s*(?P<g>[\dOIlSsBZ|/]{1,5})\s*\)|(?:page|pagc|pg\.?|p\.|seite|s\.)\s*(?P<c>[\dOIlSsBZ|/]{1,5}|[ivxlc]+)|(?P<d>[\dOIlSsBZ|/]{1,5})\s+(?:of|ot|0f|from)\s+[\dOIlSsBZ|/]{1,5}|(?P<e>[\dOIlSsBZ|/]{1,5}))")
_LABEL = re.compile(r"[A-Z][A-Za-z. ]{1,24}(?:\s*[\[(][^\])]{1,12}[\])])?")
_SIDE = re.compile(r"^(?:[\dOIlSBZ|/]{1,5}|[ivxlc]{1,7})\s{2,}(?=\S)|(?<=\S)\s{2,}(?:[\dOIlSBZ|/]{1,5}|[ivxlc]{1,7})$")
_ISSUE = re.compile(r"[A-Z][A-Za-z]{1,9}\s+(?:[Vv][o0][l1I|]\.?\s*)?[\dOIlS/]{1,4}\s*\([\dOIlSB/]{4}\)\s*[/,:|–-]?\s*\S.{2,60}")
_VOLUME = re.compile(r".{8,70}?[,.]?\s(?:[Vv][o0][l1I|]\.?|No\.?)\s*[\dOIlS]{1,4}\b.{0,40}")
_WORDS = re.compile(r"[^\s:;,.\-–—/()\[\]]+(?:-[^\s:;,./()\[\]]+)*")


def page_number(line: str) -> tuple[int | None, bool] | None:
    """(number, dressed) of a line that is nothing but a page number, None otherwise.  Roman
    numbers have None as number."""
    s = line.strip()
    if not s or len(s) > 16:
        return None
    m = _DRESSED.fullmatch(s)
    if m:
        for group in "abgcde":
            if (v := m[group]) is not None:
                d = v.translate(_DIGITS)
                if d.isdigit() and any(c.isdigit() for c in v):
                    return int(d), group != "e"
                if group in "abc" and _ROMAN.fullmatch(v):
                    return None, True
        if m["e"] is None:
            return None
    if s == s.lower() and _ROMAN.fullmatch(s) or m and s.isupper() and len(s) > 1 and _ROMAN.fullmatch(s):
        return None, True
    return None


def title_words(title: str | None, file: str | None) -> list[list[str]]:
    """Skeletons of the words of the title and of the file name."""
    out = []
    stem = re.sub(r"^[\d_\W]+|[_\W]*(?:\.[A-Za-z]{2,4})?$", "", (file or "").replace("_", " "))
    for t in (title, stem):
        words = [skeleton(w) for w in _WORDS.findall(t or "")]
        if len(words) >= 2 and words not in out:
            out.append(words)
    return out


def repeats_title(line: str, titles: list[list[str]]) -> bool:
    """Whether a line is the title or its beginning, after names or not, with a number beside it or not."""
    s = line.strip()
    key = skeleton(s)
    if not any(t[0] in key and t[1] in key or s.isupper() and t[-1] in key for t in titles):
        return False
    s = _SIDE.sub("", s)
    words = [skeleton(w) for w in _WORDS.findall(s)]
    if len(words) < 2:
        return False
    for title in titles:
        n, first = len(title), title[0]
        for i, w in enumerate(words):
            if w == first:
                rest = words[i:]
                if rest == title[: len(rest)] and (len(rest) >= 3 or len(rest) == n) and (i == 0 or re.search(r"[:\-–—/|)]\s", s)):
                    return True
                break
        if s.isupper() and len(words) >= 4 and words == title[-len(words) :]:
            return True
    return False


def page_width(lines: list[str]) -> float:
    """How long a printed line of a text may be: a little over nine of ten of its lines."""
    lengths = sorted(len(x) for x in lines if x.strip())
    return 1.1 * lengths[int(len(lengths) * 0.9)] if lengths else 0.0


def interrupts(lines: list[str], i: int, width: float) -> bool:
    """Whether a line may be a running head by its looks: it fits the page, begins like a title, ends
    like none of the text, and stands at an edge or after a line that ends within a sentence."""
    s = lines[i].strip()
    if not 8 <= len(s) <= width or not (s[0].isupper() or s[0].isdigit()) or s[-1] in ".,;:":
        return False
    before = next((x.strip() for x in lines[i - 1 :: -1] if x.strip()), "") if i else ""
    return not before or i == len(lines) - 1 or before[-1] not in ".:!?。"


def columns(lines: list[str]) -> set[int]:
    """Lines that belong to a column of numbers under its label."""
    out: set[int] = set()
    i, n = 0, len(lines)
    bare = [bool(re.fullmatch(r"\s*\d{1,4}(?:[.,]\d+)?\s*", x)) for x in lines]
    while i < n:
        if bare[i] and i not in out:
            j = i - 1
            label = j >= 0 and _LABEL.fullmatch(lines[j].strip()) is not None and len(lines[j].split()) <= 3
            run, k, last = [i], i + 1, i
            while k < n and (bare[k] or k - last <= 2 and lines[k].strip() and k + 1 < n and (bare[k + 1] or k - last == 1 and k + 2 < n and bare[k + 2])):
                if bare[k]:
                    run.append(k)
                    last = k
                k += 1
            if label and (len(run) > 1 or len(lines[j].split()) == 1 or lines[j].rstrip()[-1] in ")]") or len(run) >= 3:
                out.update(run)
                i = last
        i += 1
    return out


class Facts:
    """What is known of a segment's file: titles, distance of page numbers, repeated heads."""

    def __init__(self, title: str | None, file: str | None, offset: int | None, heads: list[str] | None):
        self.titles = title_words(title, file)
        self.offset = offset
        self.heads = set(heads or ())
        self.near = Trie()
        for key in self.heads:
            self.near.add(key, key)
        self.sizes = {len(key) for key in self.heads}

    def is_head(self, line: str) -> bool:
        """Whether a line is a printing of a repeated head, one edit allowed in ten characters, three at most."""
        if not self.heads:
            return False
        key = head_key(line)
        if key in self.heads:
            return True
        k = min(3, len(key) // 10)
        return k > 0 and any(abs(n - len(key)) <= k for n in self.sizes) and bool(self.near.within(key, k))


_FREE_NUMBER = re.compile(r"(?:\s*\b(?=[olisbzg|]*\d)[\dolisbzg|]+(?!\w))+\s*")


def head_key(line: str) -> str:
    """The same for all printings of a running head, whatever its page number and look-alike misreadings:
    free-standing numbers are one sign, digits within words are what they look like."""
    return _FREE_NUMBER.sub("#", re.sub(r"\s+", " ", _SIDE.sub("", line.strip()).lower())).translate(_SKELETON)


def as_page(page: str | None) -> int | None:
    return int(page) if page and page.strip().isdigit() and len(page.strip()) <= 7 else None


def furniture(lines: list[str], facts: Facts, page: str | None) -> dict[int, str]:
    """line index -> ``header`` or ``pageno``."""
    out: dict[int, str] = {}
    counted = as_page(page)
    numbers = {i: p for i, x in enumerate(lines) if (p := page_number(x)) is not None}
    if numbers:
        cells = columns(lines)
        for i, (value, dressed) in numbers.items():
            fits = value is not None and counted is not None and facts.offset is not None and value == counted + facts.offset
            if fits and (i not in cells or _edge(i, cells, lines)):
                out[i] = "pageno"
            elif i not in cells and (dressed or facts.offset is None or counted is None or _misread_number(lines[i])):
                out[i] = "pageno"
    for i, x in enumerate(lines):
        s = x.strip()
        if len(s) < 6 or s[-1] in ".,;。" or i in out:
            continue
        # heads begin with a capital or a number, or with what a capital is misread as
        c = s[0]
        if not (c.isupper() or c.isdigit() or c in "|[€@" or s[:2] in ("cl", "li", "rn", "ri", "vv", "ii")):
            continue
        if repeats_title(s, facts.titles) or "(" in s and _ISSUE.fullmatch(s) or ("ol" in s or "o1" in s or "No" in s) and _VOLUME.fullmatch(s) and interrupts(lines, i, page_width(lines)) or facts.is_head(s):
            out[i] = "header"
    return out


def _misread_number(line: str) -> bool:
    return bool(re.search(r"[OIlSBZ|]", line) and re.search(r"\d", line))


def _edge(i: int, cells: set[int], lines: list[str]) -> bool:
    """Whether a number in a column is its last line (a page number that follows a table)."""
    return i + 1 not in cells


def broken(lines: list[str], i: int, skip: dict[int, str], lexicon: Lexicon) -> tuple[bool, int, str] | None:
    """For a line that ends in a break sign: (sign is not part of the word, index of the line with the second half, -1 if
    there is none here, the whole word).  None where the line does not end within a word."""
    s = lines[i].rstrip()
    sign = s[-1]
    token = s.split()[-1].lstrip(_OUTER)
    a = token[:-1].lower()
    if not a or not _LETTERS.search(a[-1]):
        return None
    first, tried = None, 0
    for j in range(i + 1, len(lines)):
        if tried == BETWEEN:
            break
        words = lines[j].split()
        if not words or j in skip:
            continue
        tried += 1
        b = core(words[0])
        if b.endswith(tuple(BREAKS)):
            b = b[:-1]
        if not b or not _LETTERS.match(b[0]) and not b[0] in "|€@":
            continue
        if first is None:
            first = (j, b)
        joined, kept = lexicon.known(a + b), lexicon.known(f"{a}-{b}")
        if not joined and not kept and words[0][-1:] in BREAKS:
            joined = kept = 0
        if joined or kept:
            return joined >= kept, j, a + b if joined >= kept else f"{a}-{b}"
    if first is None:
        a1 = a.rsplit("-", 1)[-1]
        compound = lexicon.heads.get(a, 0) > 0 and lexicon.counts.get(a1, 0) >= 3
        return not (sign in "-‐‑" and compound), -1, a
    j, b = first
    a1, b1 = a.rsplit("-", 1)[-1], b.split("-", 1)[0]
    whole = lexicon.counts.get(a1, 0) >= 3 and lexicon.counts.get(b1, 0) >= 3 and sign in "-‐‑"
    return not whole, j, f"{a}-{b}" if whole else a + b


def analyse(text: str, facts: Facts, page: str | None, lexicon: Lexicon) -> tuple[list[str], dict[int, str], dict[int, tuple[bool, int, str]], dict[int, dict[int, str]]]:
    """(lines, furniture, breaks, misread words by line and place)."""
    lines = text.split("\n")
    skip = furniture(lines, facts, page)
    breaks: dict[int, tuple[bool, int, str]] = {}
    second: set[int] = set()
    wrong: dict[int, dict[int, str]] = {}
    for i, x in enumerate(lines):
        if i not in skip and x and x.rstrip()[-1:] in BREAKS and x.strip() and (got := broken(lines, i, skip, lexicon)):
            breaks[i] = got
            if got[1] >= 0:
                second.add(got[1])
                meant = lexicon.best(got[2], reach="alike")
                if meant:  # the half that differs from the word holds the misread character
                    a = x.rstrip().split()[-1].lstrip(_OUTER)[:-1].lower()
                    hit = False
                    if not meant.startswith(a):
                        wrong.setdefault(i, {})[-1] = meant
                        hit = True
                    b = core(lines[got[1]].split()[0])
                    if not meant.endswith(b) or not hit:
                        if not b[-1:] in BREAKS or b[:-1] not in meant:
                            wrong.setdefault(got[1], {})[0] = meant
    bad = lexicon.misread(set(text.split()))
    if bad:
        for i, x in enumerate(lines):
            if i in skip:
                continue
            words = x.split()
            for k, w in enumerate(words):
                if w in bad and not (k == 0 and i in second) and not (k == len(words) - 1 and i in breaks):
                    # a text may begin or end within a word
                    edge = i == k == 0 or i == len(lines) - 1 and k == len(words) - 1
                    if edge and not lexicon.candidates(core(w), "alike"):
                        continue
                    left = core(words[k - 1]) if k else ""
                    right = core(words[k + 1]) if k + 1 < len(words) else ""
                    wrong.setdefault(i, {})[k] = lexicon.best(core(w), left, right, reach_of(w)) or bad[w]
    return lines, skip, breaks, wrong


def _dress(token: str, word: str) -> str:
    """``word`` with the case and outer punctuation of ``token``."""
    inner = core(token)
    at = token.lower().find(inner)
    old = token[at : at + len(inner)]
    if old.isupper() and len(old) > 1:
        word = word.upper()
    elif old[:1].isupper():
        word = word[:1].upper() + word[1:]
    return token[:at] + word + token[at + len(inner) :]


def repaired(text: str, facts: Facts, page: str | None, lexicon: Lexicon) -> str:
    """Continuous paragraphs: furniture out, misread words replaced, broken words joined, lines
    flowed together between blank lines, headings and short lines kept apart."""
    lines, skip, breaks, wrong = analyse(text, facts, page, lexicon)
    width = sorted(len(x) for x in lines if x.strip())
    wide = width[int(len(width) * 0.9)] if width else 0
    if not skip and not breaks and not wrong and wide > 140:
        return text
    taken: dict[int, str] = {}
    out: list[str] = []
    paragraph: list[str] = []

    def flush() -> None:
        if paragraph:
            out.append(" ".join(paragraph))
            paragraph.clear()

    gap = False
    for i, x in enumerate(lines):
        if i in skip:
            continue
        words = x.split()
        if not words:
            gap = True
            continue
        # a blank line within a sentence stood around page furniture
        if gap and paragraph and (paragraph[-1][-1] in ".!?:;)]。！？" or not words[0][:1].islower()):
            flush()
        gap = False
        for k, w in wrong.get(i, {}).items():
            if 0 <= k < len(words) and not (k == 0 and i in taken):
                words[k] = _dress(words[k], w)
        if i in taken:
            words = words[1:]
        if i in breaks and breaks[i][1] >= 0:
            sign_out, j, whole = breaks[i]
            word = lexicon.best(whole, reach="alike") or whole
            tail = lines[j].split()[0]
            tail = tail[len(tail.rstrip(_OUTER)) :] if not tail.endswith(tuple(BREAKS)) else ""
            if words:
                old = words[-1]
                lead = old[: len(old) - len(old.lstrip(_OUTER))]
                body = word[:1].upper() + word[1:] if old.lstrip(_OUTER)[:1].isupper() else word
                words[-1] = lead + body + tail
            taken[j] = word
        elif i in breaks and words:
            words[-1] = words[-1][:-1] if breaks[i][0] else words[-1]
        paragraph += words
        # a short line ends a paragraph if it ends a sentence, or is a heading by itself
        if len(x.strip()) < 0.6 * wide and (x.rstrip()[-1] in ".!?:。" or len(paragraph) == len(words) and x.rstrip()[-1] not in BREAKS):
            flush()
    flush()
    return "\n\n".join(out)


#: Characters read and entries counted after which a task hands on what it has counted.
FLUSH_CHARS, FLUSH_ROWS = 200_000_000, 1_000_000


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    read = 0

    def emit() -> pd.DataFrame:
        words: Counter = Counter()
        for t, n in counts.items():
            w = core(t)
            if _PLAIN.fullmatch(w):
                words[w] += n
        counts.clear()
        return pd.DataFrame([*words.items()], columns=["word", "n"])

    for batch in batches:
        for t in batch["text"]:
            if t:
                # halves of broken words stay one token that is no plain word
                counts.update((_BROKEN.sub("\x00", t) if "\n" in t else t).split())
                read += len(t)
        if len(counts) > FLUSH_ROWS or read > FLUSH_CHARS:
            yield emit()
            read = 0
    yield emit()


def vocabulary(df: DataFrame, text: str) -> tuple[dict[str, int], DataFrame | None]:
    """The most frequent words of the vocabulary with their counts (at most ``MOST_WORDS``), and (word, n)
    of the others, None if there are no others."""
    counted = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(_count_words, "word string, n long")
    counted = cut(counted.groupBy("word").agg(F.sum("n").alias("n")), df.sparkSession).where(F.col("n") >= LEAST)
    rows = counted.orderBy(F.desc("n")).limit(MOST_WORDS + 1).collect()
    if len(rows) <= MOST_WORDS:
        return {r["word"]: r["n"] for r in rows}, None
    floor = rows[-1]["n"] + 1
    return {r["word"]: r["n"] for r in rows if r["n"] >= floor}, counted.where(F.col("n") < floor)


def _near_keys(word: str) -> set[str]:
    """Keys of which words within one edit share one: the word less any one letter; of long words, whose keys
    would be many, the halves before and after the edit."""
    n = len(word)
    if n <= 64:
        return {word, *(word[:i] + word[i + 1 :] for i in range(n))}
    return {k for h in (n // 2, (n - 1) // 2) for k in ("^" + word[:h], "$" + word[n - h :])} | {word[:i] + word[i + 1 :] for i in range(n) if n == 65}


def _asked_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for w in batch["word"]:
            out.append(("=" + w, w))
            if not w.endswith("-"):
                out.append(("0" + skeleton(w), w))
                if _PLAIN.fullmatch(w):
                    out += [("2" + k, w) for k in _near_keys(w) if len(w) > 2 and not _CJK.search(w)]
                elif len(w) >= 5 and "." not in w:
                    out += [("1" + k, w) for k in _near_keys(skeleton(w))]
        yield pd.DataFrame(out, columns=["key", "word"])


def _rare_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for w, n in zip(batch["word"], batch["n"], strict=True):
            out.append(("=" + w, w, n))
            if n >= TIMES and not w.endswith("-"):
                out.append(("0" + skeleton(w), w, n))
                out += [("2" + k, w, n) for k in _near_keys(w)]
                if len(w) >= 4:
                    out += [("1" + k, w, n) for k in _near_keys(skeleton(w))]
        yield pd.DataFrame(out, columns=["key", "rare", "n"])


def _with_rare(rows: DataFrame, rare: DataFrame, words) -> DataFrame:
    """``rows`` with ``rare``: the rare words, with their counts, that may answer for the spellings of
    the text.  Words ending in a hyphen are the beginnings of hyphenated ones."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = Asked(words.value[0])
        for batch in batches:
            out = []
            for (_, t, p, facts), i in zip(_rows(batch), batch["id"], strict=True):
                asked.words = set()
                analyse(t, facts, p, asked)
                out += [(i, w) for w in asked.words]
            yield pd.DataFrame(out, columns=["id", "word"])

    rows = rows.withColumn("id", F.xxhash64("text"))
    asked = cut(rows.mapInPandas(ask, "id long, word string").distinct(), rows.sparkSession)
    parts = F.split("word", "-")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "-"), F.lit("-")))
    heads = rare.where(F.col("word").contains("-")).select(F.explode(heads).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    keys = rare.unionByName(heads).mapInPandas(_rare_keys, "key string, rare string, n long")
    answers = asked.select("word").distinct().mapInPandas(_asked_keys, "key string, word string").join(keys, "key").select("word", "rare", "n").distinct()
    found = asked.join(answers, "word").groupBy("id").agg(F.collect_set(F.struct("rare", "n")).alias("rare"))
    return rows.join(found, "id", "left").drop("id")


def _asked_pairs(rows: DataFrame, words) -> DataFrame:
    """(id, a, b): the pairs of neighbours that tell the candidates of a misread word apart, for each text with such a word."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(words)
        for batch in batches:
            out = []
            for (_, t, p, facts), own, i in zip(_rows(batch), _locals(batch, lexicon), batch["id"], strict=True):
                lines, _, _, wrong = analyse(t, facts, p, own)
                for at in wrong:
                    tokens = lines[at].split()
                    for k in wrong[at]:
                        tied = own.tied(core(tokens[k]), reach_of(tokens[k])) if k >= 0 else ()
                        if len(tied) > 1:
                            out += [(i, core(tokens[k - 1]), w) for w in tied if k]
                            out += [(i, w, core(tokens[k + 1])) for w in tied if k + 1 < len(tokens)]
            yield pd.DataFrame(out, columns=["id", "a", "b"])

    return rows.mapInPandas(ask, "id long, a string, b string").distinct()


def pair_counts(texts: DataFrame, wanted: set[tuple[str, str]] | None) -> DataFrame:
    """(a, b, n): how often two words stand side by side in ``texts`` (text), for ``wanted`` pairs or for all."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                cores = [core(x) for x in t.split()]
                near = zip(cores, cores[1:], strict=False)
                pairs.update(near if wanted is None else (p for p in near if p in wanted))
            if len(pairs) > FLUSH_ROWS:
                yield pd.DataFrame([(*k, n) for k, n in pairs.items()], columns=["a", "b", "n"])
                pairs.clear()
        yield pd.DataFrame([(*k, n) for k, n in pairs.items()], columns=["a", "b", "n"])

    return texts.mapInPandas(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _page_facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    facts: Counter = Counter()
    rows = lambda: pd.DataFrame([(*k, n) for k, n in facts.items()], columns=["file", "kind", "key", "n"])
    read = 0
    for batch in batches:
        for file, page, text in zip(batch["file"], batch["page"], batch["text"], strict=True):
            if not text or file is None:
                continue
            facts[(file, "n", "")] += 1
            if "\n" not in text:
                continue
            lines = text.split("\n")
            counted = as_page(page)
            numbers = {i: p for i, x in enumerate(lines) if len(x) < 20 and (p := page_number(x)) is not None}
            if numbers and counted is not None:
                cells = columns(lines)
                for i, (value, _) in numbers.items():
                    if value is not None and i not in cells:
                        facts[(file, "o", str(value - counted))] += 1
            width = page_width(lines)
            seen = {head_key(x) for i, x in enumerate(lines) if len(x) >= 8 and x[-1] not in ".,;:" and interrupts(lines, i, width)}
            for key in seen:
                facts[(file, "h", key)] += 1
            read += len(text)
        if len(facts) > FLUSH_ROWS or read > FLUSH_CHARS:
            yield rows()
            facts.clear()
            read = 0
    yield rows()


def file_facts(df: DataFrame, text: str, file: str, page: str, least: int = 3, share: float = 0.05) -> DataFrame:
    """(file, offset, heads): the usual distance between printed and counted page numbers, where
    two pages agree on it, and the lines that interrupt the text in at least ``share`` of a
    file's segments and in no third file."""
    counted = df.select(F.col(file).alias("file"), F.col(page).cast("string").alias("page"), F.col(text).alias("text")).mapInPandas(_page_facts, "file string, kind string, key string, n long")
    counted = cut(counted.groupBy("file", "kind", "key").agg(F.sum("n").alias("n")), df.sparkSession)
    offset = counted.where("kind = 'o'").groupBy("file").agg(F.max(F.struct("n", (-F.abs(F.col("key").cast("int"))).alias("near"), F.col("key").cast("int").alias("offset"))).alias("m")).where("m.n >= 2").select("file", "m.offset")
    size = counted.where("kind = 'n'").select("file", F.col("n").alias("segments"))
    often = counted.where(f"kind = 'h' and n >= {least}").join(size, "file").where(F.col("n") >= share * F.col("segments")).select("file", "key")
    spread = counted.where("kind = 'h'").select("file", "key").join(often.select("key").distinct(), "key").groupBy("key").agg(F.count("*").alias("files")).where("files <= 2")
    heads = often.join(spread, "key").groupBy("file").agg(F.collect_set("key").alias("heads"))
    return cut(offset.join(heads, "file", "full_outer").select("file", "offset", "heads"), df.sparkSession)


def _prepared(df: DataFrame, key: str, text: str, file: str, page: str, title: str, context: bool = False) -> tuple[DataFrame, object]:
    """(rows with what is known of their files, broadcast vocabulary); with ``context`` also the counts of the
    neighbours that tell tied candidates apart, which what is noise does not depend on."""
    spark = df.sparkSession
    counts, rare = vocabulary(df, text)
    words = spark.sparkContext.broadcast((counts, {}))
    facts = file_facts(df, text, file, page)
    facts = F.broadcast(facts) if facts.limit(FACT_ROWS + 1).count() <= FACT_ROWS else facts
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(file).alias("file"), F.col(page).cast("string").alias("page"), F.col(title).alias("title"))
    rows = rows.join(facts, "file", "left")
    if rare is not None:
        rows = _with_rare(rows, rare, words)
    if context:
        rows = rows.withColumn("id", F.xxhash64("text"))
        asked = cut(_asked_pairs(rows, words), spark)
        wanted = asked.select("a", "b").distinct().limit(PAIRS + 1).collect()
        texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
        if len(wanted) <= PAIRS:
            counted = pair_counts(texts, {(r["a"], r["b"]) for r in wanted}).collect() if wanted else []
            words = spark.sparkContext.broadcast((counts, {(r["a"], r["b"]): r["n"] for r in counted}))
        else:
            counted = asked.join(pair_counts(texts, None), ["a", "b"]).groupBy("id").agg(F.collect_set(F.struct("a", "b", "n")).alias("pairs"))
            rows = rows.join(counted, "id", "left")
    return rows, words


_LEXICONS: dict[int, Lexicon] = {}  # by the broadcast value, which the lexicon keeps alive


def _lexicon(words) -> Lexicon:
    """One lexicon for each vocabulary in a Python worker."""
    known = _LEXICONS.get(id(words.value))
    if known is None:
        _LEXICONS.clear()
        known = _LEXICONS[id(words.value)] = Lexicon(*words.value)
        known.source = words.value
    return known


def _locals(batch: pd.DataFrame, lexicon: Lexicon) -> Iterator[Lexicon]:
    """The lexicon of each row."""
    none = [None] * len(batch)
    for rare, pairs in zip(batch.get("rare", none), batch.get("pairs", none), strict=True):
        if rare is None and pairs is None:
            yield lexicon
        else:
            yield Local(lexicon, {} if rare is None else {r["rare"]: r["n"] for r in rare}, None if pairs is None else {(r["a"], r["b"]): r["n"] for r in pairs})


def _rows(batch: pd.DataFrame) -> Iterator[tuple]:
    last: tuple | None = None
    facts = None
    offsets = batch["offset"].astype(object).where(batch["offset"].notna(), None)
    for key, text, file, page, title, offset, heads in zip(batch["key"], batch["text"], batch["file"], batch["page"], batch["title"], offsets, batch["heads"], strict=True):
        now = (file, title)
        if now != last:
            facts = Facts(title, file, None if offset is None else int(offset), None if heads is None else list(heads))
            last = now
        yield key, text, page, facts


def find_noise(df: DataFrame, key: str, text: str, file: str, page: str, title: str) -> DataFrame:
    """(key, line_no, kind): the noise of every line."""
    rows, words = _prepared(df, key, text, file, page, title)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(words)
        for batch in batches:
            out: list[tuple] = []
            for (k, t, p, facts), own in zip(_rows(batch), _locals(batch, lexicon), strict=True):
                _, skip, breaks, wrong = analyse(t, facts, p, own)
                out += [(k, i + 1, kind) for i, kind in skip.items()]
                out += [(k, i + 1, "hyphen") for i, b in breaks.items() if b[0]]
                out += [(k, i + 1, "char") for i in wrong]
            yield pd.DataFrame(out, columns=[key, "line_no", "kind"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType())])
    return rows.mapInPandas(find, schema)


def repair(df: DataFrame, key: str, text: str, file: str, page: str, title: str, out: str = "clean") -> DataFrame:
    """(key, out): every text as continuous paragraphs; null stays null."""
    rows, words = _prepared(df, key, text, file, page, title, context=True)

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(words)
        for batch in batches:
            yield pd.DataFrame([(k, repaired(t, facts, p, own)) for (k, t, p, facts), own in zip(_rows(batch), _locals(batch, lexicon), strict=True)], columns=[key, out])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.StringType())])
    return rows.mapInPandas(mend, schema).unionByName(df.where(F.col(text).isNull()).select(key, F.lit(None).cast("string").alias(out)))
