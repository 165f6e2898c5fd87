"""Reading level: the median of classic readability grades, placed on a rated scale.

Per text: sentences, words, letters, syllables (counted by hyphenation-style rules: vowel
groups are nuclei, silent endings and split vowel pairs corrected), long and polysyllabic
words.  From these the published grade formulas (Flesch-Kincaid, Gunning fog, SMOG, automated
readability index, Coleman-Liau, Dale-Chall) and their median.  Dale-Chall's list of familiar
words is taken from the rated texts of the easy levels.

On the scale of the ratings each formula gives an estimate of its own: its published inputs and the
shares of unfamiliar words, weighted anew by a softmax regression on at most ``SAMPLE`` rated texts
(those of the smallest key hash).  The level is the median of these seven estimates (the six formulas and
LIX).  Without ratings the levels are cut from the median grade at fixed grades.

Defined results: null, empty and blank texts and texts without letters have null grades and
level; texts in Chinese or Japanese are measured by characters (two count as one word); texts
of any length are read whole; rows stay one to one; repeated rows are graded alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.session import cut

#: Most rated texts that are collected for the fit.
SAMPLE = 5_000
#: Grades at which the median is cut where nothing is rated: end of early school, of school, of a first degree.
CUTS = (4.8, 8.9, 14.1)
GRADES = ("flesch_kincaid", "fog", "smog", "ari", "coleman_liau", "dale_chall")

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SENTENCE = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s+[\"'“‘(\[]*[^\W\d_a-zß-ÿ]|\s*$)|[。！？]|\n\s*\n")
_NUCLEUS = re.compile(r"[aeiouyàâäåæèéêëìíîïòóôöøùúûüœ]+")
# Vowel pairs that are two nuclei, and endings that are none.
_SPLIT = re.compile(r"(?<![tcsxg])i[ao](?!u)|eo|ua(?!r)|[aeiou]ing$|uous$|[aeiou]ism$|ie[nt](?=c|t|$)|iu|yo|[^l]ia$")
_SILENT = re.compile(r"[^aeiouyl]es?$|[^td]ed$|[^aeiouy]eful|eless|ely$|ement|[aeiou]le$")


def syllables(word: str) -> int:
    """Nuclei of a word in lower case, one at least."""
    n = len(_NUCLEUS.findall(word)) + len(_SPLIT.findall(word)) - len(_SILENT.findall(word))
    return max(1, n)


@dataclass
class Scale:
    """Familiar words by level and each formula's (mean, spread, weights) (empty: the median grade is cut)."""

    familiar: list[frozenset] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)
    fits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The level of each row of :func:`measures`: the median of the formulas' estimates."""
        best = [(_expand(_inputs(rows, i), mean, spread) @ w).argmax(1) for i, (mean, spread, w) in enumerate(self.fits)]
        return np.array(self.levels)[np.median(best, axis=0).astype(int)]


def measures(text: str | None, familiar: list[frozenset], known: dict[str, int]) -> list[float] | None:
    """[words, sentences, words a sentence, syllables a word, polysyllables, six grades, median,
    LIX, letters a word, shares of words outside each familiar list], or None where there are no words."""
    if not text:
        return None
    words = _WORD.findall(text)
    cjk = _CJK.findall(text)
    if len(cjk) * 2 > sum(map(len, words)) and cjk:
        n = max(1.0, len(cjk) / 2)
        s = max(1, len(_SENTENCE.findall(text)))
        asl = n / s
        grade = 0.39 * asl + 2.0
        return [n, s, asl, 1.5, 0.0, *[grade] * 6, grade, asl, 4.5, *[0.0] * len(familiar)]
    if not words:
        return None
    n, s = len(words), 0
    start = 0
    for m in _SENTENCE.finditer(text):
        if _WORD.search(text, start, m.end()):
            s += 1
        start = m.end()
    s = max(1, s + (1 if _WORD.search(text, start) else 0))
    low = [w.lower() for w in words]
    counts = Counter(low)
    syl = poly = letters = long = 0
    for w, c in counts.items():
        k = known.get(w)
        if k is None:
            k = known[w] = syllables(w)
        syl += k * c
        poly += c * (k >= 3)
        letters += c * len(w)
        long += c * (len(w) > 6)
    outside = [sum(c for w, c in counts.items() if w not in f) / n for f in familiar]
    asl, spw = n / s, syl / n
    unfamiliar = 100 * outside[-1] if outside else 100 * poly / n
    grades = [
        0.39 * asl + 11.8 * spw - 15.59, 0.4 * (asl + 100 * poly / n), 1.043 * (30 * poly / s) ** 0.5 + 3.1291, 4.71 * letters / n + 0.5 * asl - 21.43,
        5.88 * letters / n - 29.6 * s / n - 15.8, 0.1579 * unfamiliar + 0.0496 * asl + (3.6365 if unfamiliar > 5 else 0),
    ]
    return [float(n), float(s), asl, spw, poly / n, *grades, float(np.median(grades)), asl + 100 * long / n, letters / n, *outside]


#: Inputs of each formula, as columns of :func:`measures`: words a sentence and syllables, polysyllables, letters or
#: long words; Dale-Chall has the shares of unfamiliar words, which are put to all.
FORMULAS = (lambda m: (m[:, 2], m[:, 3]), lambda m: (m[:, 2], m[:, 4]), lambda m: (np.sqrt(30 * m[:, 4] * m[:, 2]), m[:, 4]), lambda m: (m[:, 2], m[:, 13]), lambda m: (1 / m[:, 2], m[:, 13]), lambda m: (m[:, 2],), lambda m: (m[:, 2], m[:, 12] - m[:, 2]))


def _inputs(rows: np.ndarray, formula: int) -> np.ndarray:
    return np.column_stack([*FORMULAS[formula](rows), rows[:, 14:]])


def _expand(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -4, 4)
    i, j = np.triu_indices(z.shape[1])
    return np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]])


def _regression(z: np.ndarray, y: np.ndarray, steps: int, ridge: float) -> np.ndarray:
    """Weights of a softmax regression by gradient steps with momentum."""
    w, a, b = np.zeros((z.shape[1], y.shape[1])), 0.0, 0.0
    for k in range(1, steps + 1):
        p = z @ w
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ (p - y) / len(y) + ridge * w
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        w = w - 0.05 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)
    return w


def _easy(levels: list[int]) -> list[int]:
    """The levels whose words, and those of the levels below, are familiar ones."""
    return levels[: max(1, len(levels) // 2)]


def fitted(rows: np.ndarray, levels: list[int], familiar: list[frozenset], steps: int = 1000, ridge: float = 1e-3) -> Scale:
    """The scale of rated rows of :func:`measures`."""
    scale = Scale(familiar=familiar, levels=sorted(set(levels)))
    if len(scale.levels) < 2:
        return scale
    y = np.array([[v == k for k in scale.levels] for v in levels], float)
    for i in range(len(FORMULAS)):
        x = _inputs(rows, i)
        mean, spread = x.mean(0), x.std(0) + 1e-9
        scale.fits.append((mean, spread, _regression(_expand(x, mean, spread), y, steps, ridge)))
    return scale


def fit(texts: list[str], levels: list[int]) -> Scale:
    """The scale of rated texts: familiar words (in two easy texts or more), then the formulas."""
    familiar, known = [], {}
    for top in _easy(sorted(set(levels))):
        c = Counter(w for t, v in zip(texts, levels, strict=True) if v <= top for w in words_of(t))
        familiar.append(frozenset(w for w, k in c.items() if k >= 2))
    rows = [(measures(t, familiar, known), v) for t, v in zip(texts, levels, strict=True)]
    rows = [(m, v) for m, v in rows if m is not None]
    return fitted(np.array([m for m, _ in rows]), [v for _, v in rows], familiar)


def words_of(text: str | None) -> set[str]:
    return {w.lower() for w in _WORD.findall(text or "")}


def fit_on(docs: DataFrame, ratings: DataFrame, key: str, text: str, level: str, sample: int = SAMPLE) -> Scale:
    """The scale fitted on the rated documents, at most ``sample`` of them.

    Words are counted and texts measured where they lie; the driver gets the familiar words and a row of
    numbers for each rated text, never a text."""
    rated = docs.select(key, text).join(ratings.select(key, F.col(level).cast("int").alias("__level")).where(F.col(level).isNotNull()), key).where(F.col(text).isNotNull())
    rated = cut(rated.orderBy(F.xxhash64(key), text, "__level").limit(sample).select(F.col(text).alias("text"), F.col("__level").alias("level")), docs.sparkSession)
    easy = _easy(sorted(r[0] for r in rated.select("level").distinct().collect()))

    @F.pandas_udf("array<string>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([sorted(words_of(t)) for t in b], dtype=object)

    counts = []
    if easy:
        per_word = rated.where(F.col("level").isin(easy)).select("level", F.explode(words("text")).alias("w")).groupBy("w")
        counts = per_word.agg(*[F.count_if(F.col("level") <= top).alias(str(top)) for top in easy]).where(F.col(f"`{easy[-1]}`") >= 2).collect()
    familiar = [frozenset(r["w"] for r in counts if r[str(top)] >= 2) for top in easy]

    @F.pandas_udf("array<double>")
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for b in batches:
            yield pd.Series([measures(t, familiar, known) for t in b], dtype=object)

    rows = rated.select(numbers("text").alias("m"), "level").where("m is not null").collect()
    return fitted(np.array([r["m"] for r in rows]), [r["level"] for r in rows], familiar)


RESULT = T.StructType([T.StructField("words", T.LongType()), T.StructField("sentences", T.LongType())] + [T.StructField(g, T.DoubleType()) for g in GRADES] + [T.StructField("grade", T.DoubleType()), T.StructField("level", T.IntegerType())])


def read_levels(df: DataFrame, text: str, scale: Scale, out: str = "reading") -> DataFrame:
    """``df`` with a struct ``out``: counts, the six grades, their median ``grade``, and ``level``."""

    @F.pandas_udf(RESULT)
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for texts in batches:
            if len(known) > 1_000_000:
                known.clear()
            got = [measures(t, scale.familiar, known) for t in texts]
            level = np.full(len(got), np.nan)
            at = [i for i, m in enumerate(got) if m is not None]
            if at and scale.fits:
                level[at] = scale.place(np.array([got[i] for i in at]))
            elif at:
                level[at] = [1 + sum(got[i][11] > c for c in CUTS) for i in at]
            rows = [(int(m[0]), int(m[1]), *[round(v, 4) for v in m[5:11]], round(m[11], 4)) if m else (None,) * 9 for m in got]
            frame = pd.DataFrame(rows, columns=[f.name for f in RESULT.fields[:-1]])
            frame["words"], frame["sentences"] = frame["words"].astype("Int64"), frame["sentences"].astype("Int64")
            frame["level"] = pd.array([None if np.isnan(v) else int(v) for v in level], dtype="Int32")
            yield frame

    return df.withColumn(out, grade(F.col(text)))
