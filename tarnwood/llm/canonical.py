"""Free-entered values mapped to a canonical list, by token repair and soft TF-IDF.

1. Every distinct value is cut into parts at ``, / ( ) ;`` and each part into folded tokens
   (lower case, no accents, no punctuation).
2. Each distinct token is joined to the vocabulary of the reference names by edit distance
   (equality join on deletion neighbourhoods, verified with the exact distance).
3. Repaired tokens are combined with soft TF-IDF, so ``Unmted Staates`` scores on two repaired
   tokens and ``united`` alone counts little.  A part is also read as one word, which repairs
   blanks that were lost or misplaced.
4. The code field breaks ties and speaks where the value field means no entry.

The reference's other names are not complete.  Names that the rows themselves show for an
entry (a value that stands beside one valid code in nearly all of its rows) join the
vocabulary.  Up to ``MOST_NAMES`` names make one index that every task holds, against which each
distinct value is matched once; more names are joined to the values, with equal results.

Defined results: one row per input row in which a value or code holds more than blanks;
``none`` where neither means an entry; repeated rows and repeated keys are mapped alike and
kept; empty tables give empty results; a null in any column counts as blank.  Texts of any
length are read whole.  Rows of one hot value are never gathered: matching runs on distinct
values, and only (value, result) pairs are joined back.  Tables read more than once are cut
with checkpoint(), so plans stay small.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnwood.llm.edits import deletions, deletions_of, distance, distance_of
from tarnwood.session import cut

#: Names up to which all are held in every task, as an index; more names are joined.
MOST_NAMES = 100_000
STOP = frozenset("the of and".split())
_PART = re.compile(r"[,/();|\[\]\n]+")
_FOLD = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "ı": "i", "'": "", "’": "", ".": "", "-": " ", "_": " "})
PART = T.ArrayType(T.StructType([T.StructField("part", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("joined", T.StringType())]))


def fold(text: str) -> str:
    """Lower case without accents, apostrophes and full stops; other punctuation is a blank."""
    s = unicodedata.normalize("NFKD", text.casefold().translate(_FOLD))
    s = "".join(c for c in s if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", s).split())


def parts_of(value: str | None) -> list[tuple[str, list[str], str]]:
    out = []
    for p in _PART.split(value or ""):
        f = fold(p)
        if f:
            out.append((f, [t for t in f.split() if t not in STOP] or f.split(), f.replace(" ", "")))
    return out


@F.pandas_udf(PART)
def _parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield pd.Series([[{"part": a, "tokens": b, "joined": c} for a, b, c in parts_of(v)] for v in values], dtype=object)


def _allowed(length):
    """Edits allowed in a vocabulary word of this length."""
    return F.when(length >= 8, 2).when(length >= 4, 1).otherwise(0)


def _allowed_in(word: str) -> int:
    return 2 if len(word) >= 8 else 1 if len(word) >= 4 else 0


def reference_names(ref: DataFrame, code: str = "iso3", name: str = "name", others: str | None = "other_names") -> DataFrame:
    """(code, part, tokens, joined): every known name of every entry, folded."""
    more = F.coalesce(F.col(others), F.array().cast("array<string>")) if others else F.array().cast("array<string>")
    names = ref.select(F.col(code).alias("code"), F.explode(F.concat(F.array(name), more)).alias("n")).where("n is not null").withColumn("p", _parts("n"))
    # a comma in a name ("Korea, Republic of") is part of it: the parts are read as one
    return names.select("code", F.array_join("p.part", " ").alias("part"), F.flatten("p.tokens").alias("tokens"), F.array_join("p.joined", "").alias("joined")).where(F.size("tokens") > 0).distinct()


class Vocabulary:
    """Words by their deletion neighbourhoods; answers are remembered."""

    def __init__(self, words: set[str]):
        self.by_key: dict[str, list[str]] = {}
        for w in words:
            for d in deletions(w, _allowed_in(w)):
                self.by_key.setdefault(d, []).append(w)
        self.seen: dict[str, dict[str, float]] = {}

    def near(self, token: str) -> dict[str, float]:
        """word -> similarity of all words within the edits that the word allows."""
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            n, got = len(token), {}
            for w in {w for d in deletions(token, 2 if n >= 7 else 1 if n >= 3 else 0) for w in self.by_key.get(d, ())}:
                e, allowed = distance(token, w, 2), _allowed_in(w)
                # an abbreviation of three letters allows one letter typed too many, nothing else
                if e <= allowed or len(w) == 3 and n == 4 and e == 1:
                    got[w] = 1 - e / max(n, len(w))
            self.seen[token] = got
        return got


class Names:
    """The names of all entries as one index: (code, part, tokens, joined) rows and the codes by their spellings."""

    def __init__(self, names: list[tuple], codes: list[tuple[str, str]]):
        self.codes: dict[str, list[str]] = {}
        for code, c in codes:
            self.codes.setdefault(c, []).append(code)
        of: dict[str, set[str]] = {}
        self.holders: dict[str, list[int]] = {}
        self.whole: dict[str, list[str]] = {}
        self.code = [n[0] for n in names]
        for i, (code, _, tokens, joined) in enumerate(names):
            for t in set(tokens):
                of.setdefault(t, set()).add(code)
                self.holders.setdefault(t, []).append(i)
            self.whole.setdefault(joined, []).append(code)
        every = len(set(self.code))
        self.rare = math.log1p(every)
        self.idf = {t: math.log1p(every / len(c)) for t, c in of.items()}
        self.norm = [math.sqrt(sum(self.idf[t] ** 2 for t in set(tokens))) for _, _, tokens, _ in names]
        self.words, self.joined = Vocabulary(set(self.idf)), Vocabulary(set(self.whole))
        self.seen: dict[str, list[tuple[str, float]]] = {}

    def found(self, value: str, least: float) -> list[tuple[str, float]]:
        """(code, score) of the entries that a value may mean."""
        got = self.seen.get(value)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[value] = self._found(value, least)
        return got

    def _found(self, value: str, least: float) -> list[tuple[str, float]]:
        score: dict[str, float] = {}

        def raise_to(code: str, s: float) -> None:
            if s >= least and s > score.get(code, 0.0):
                score[code] = s

        for part, tokens, joined in parts_of(value):
            dot: dict[int, float] = {}
            covered: dict[int, float] = {}
            length = 0.0
            for t in set(tokens):
                near = self.words.near(t)
                w = max(((s, self.idf[x]) for x, s in near.items()), default=(0.0, self.rare))[1]
                length += w * w
                best: dict[int, tuple[float, float]] = {}
                for x, s in near.items():
                    idf = self.idf[x]
                    for i in self.holders[x]:
                        a, b = best.get(i, (0.0, 0.0))
                        best[i] = max(a, s * idf), max(b, s * idf * idf)
                for i, (a, b) in best.items():
                    dot[i] = dot.get(i, 0.0) + a * w
                    covered[i] = covered.get(i, 0.0) + b
            for i, d in dot.items():
                # more than half of the name must be there: "Northern Sea" is not Northern Ireland
                if covered[i] >= 0.55 * self.norm[i] ** 2:
                    raise_to(self.code[i], d / (self.norm[i] * math.sqrt(length)))
            for x, s in self.joined.near(joined).items():
                for code in self.whole[x]:
                    raise_to(code, s)
            if 2 <= len(part) <= 3:
                for code in self.codes.get(part.upper(), ()):
                    raise_to(code, 1.0)
        return list(score.items())


FOUND = "array<struct<code:string,score:double>>"


def _found_by_index(values: DataFrame, names: list[tuple], codes: list[tuple[str, str]], least: float) -> DataFrame:
    """``values`` with ``found``: every distinct value once against the index of all names, no join."""
    shared = values.sparkSession.sparkContext.broadcast((names, codes))

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Names(*shared.value)
        for b in batches:
            yield pd.Series([[{"code": c, "score": s} for c, s in index.found(v, least)] for v in b], dtype=object)

    return values.withColumn("found", found("value"))


def _found_by_joins(values: DataFrame, names: DataFrame, codes: DataFrame, least: float) -> DataFrame:
    """The same by joins on deletion neighbourhoods, for any number of names."""
    spark = values.sparkSession
    parts = cut(values.select("value", F.posexplode("p").alias("i", "p")).select("value", "i", "p.part", "p.tokens", "p.joined"), spark)
    names = cut(names.withColumn("name_id", F.xxhash64("code", "part")), spark)
    # vocabulary: name tokens with idf, and each name as one word
    total = F.broadcast(names.agg(F.countDistinct("code").alias("all")))
    words = names.select("code", "name_id", F.explode(F.array_distinct("tokens")).alias("word"))
    idf = cut(words.groupBy("word").agg(F.countDistinct("code").alias("df")).join(total).select("word", F.log1p(F.col("all") / F.col("df")).alias("idf")), spark)
    norm = words.join(idf, "word").groupBy("name_id").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("norm"))

    def near(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """(token, word, sim) of every pair within the edits that the word allows."""
        a = tokens.select("token", F.explode(deletions_of(F.col("token"), F.when(F.length("token") >= 7, 2).when(F.length("token") >= 3, 1).otherwise(0))).alias("d"))
        b = vocabulary.select("word", F.explode(deletions_of(F.col("word"), _allowed(F.length("word")))).alias("d"))
        pairs = a.join(b, "d").select("token", "word").distinct().withColumn("edits", distance_of(F.col("token"), F.col("word")))
        extra = (F.length("word") == 3) & (F.length("token") == 4) & (F.col("edits") == 1)
        return pairs.where((F.col("edits") <= _allowed(F.length("word"))) | extra).select("token", "word", (1 - F.col("edits") / F.greatest(F.length("token"), F.length("word"))).alias("sim"))

    tokens = parts.select("value", "i", F.explode(F.array_distinct("tokens")).alias("token"))
    pairs = cut(near(tokens.select("token").distinct(), idf.select("word")).join(idf, "word"), spark)
    rare = F.log1p(F.col("all").cast("double"))
    weight = tokens.join(pairs.groupBy("token").agg(F.max_by("idf", F.struct("sim", "idf")).alias("w")), "token", "left").join(total).withColumn("w", F.coalesce("w", rare)).drop("all")
    length = weight.groupBy("value", "i").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("length"))
    hits = weight.join(pairs, "token").join(words, "word").groupBy("value", "i", "code", "name_id", "token", "w").agg(F.max(F.col("sim") * F.col("idf")).alias("s"), F.max(F.col("sim") * F.col("idf") ** 2).alias("c"))
    soft = hits.groupBy("value", "i", "code", "name_id").agg(F.sum(F.col("s") * F.col("w")).alias("dot"), F.sum("c").alias("covered")).join(norm, "name_id").join(length, ["value", "i"])
    soft = soft.where(F.col("covered") >= 0.55 * F.col("norm") ** 2).select("value", "code", (F.col("dot") / (F.col("norm") * F.col("length"))).alias("score"))

    # each part as one word, against names as one word
    one = near(parts.select(F.col("joined").alias("token")).distinct(), names.select(F.col("joined").alias("word")).distinct())
    whole = parts.select("value", F.col("joined").alias("token")).join(one, "token").join(names.select("code", F.col("joined").alias("word")).distinct(), "word").select("value", "code", F.col("sim").alias("score"))
    stated = parts.select("value", F.upper("part").alias("c")).where(F.length("c").between(2, 3)).join(codes, "c").select("value", "code", F.lit(1.0).alias("score"))
    best = soft.unionByName(whole).unionByName(stated).groupBy("value", "code").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    return values.join(best.groupBy("value").agg(F.collect_list(F.struct("code", "score")).alias("found")), "value", "left")


def map_to_canonical(df: DataFrame, key: str, value: str, code: str, ref: DataFrame, codes: tuple[str, ...] = ("iso3", "iso2"), name: str = "name", others: str | None = "other_names", least: float = 0.56, learn_rows: int = 3, learn_share: float = 0.8) -> DataFrame:
    """(key, ref_code, score, by_code): the entry meant by each row, ``none`` where there is none.

    ``codes`` are the columns of ``ref`` whose values the code column may hold, the first of them the code of the
    result; ``name`` and ``others`` (a list, or None) are its names."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"), F.upper(F.trim(F.col(code).cast("string"))).alias("c"))
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) == ""
    rows = rows.where(~blank(F.col("value")) | ~blank(F.col("c")))
    spelled = ref.select(F.col(codes[0]).alias("code"), F.explode(F.array_distinct(F.transform(F.array(*codes), F.upper))).alias("c")).where("c is not null")
    rows = rows.join(spelled.withColumnRenamed("code", "by_code"), "c", "left")

    # every distinct value once, with how often each valid code stands beside it
    counted = rows.where("value is not null").groupBy("value", "by_code").agg(F.count("*").alias("n"))
    values = cut(counted.groupBy("value").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("by_code").isNotNull(), F.struct("by_code", "n"))).alias("beside")).withColumn("p", _parts("value")), spark)
    sole = values.where(F.size("p") == 1).select(F.col("p")[0].alias("p"), F.explode("beside").alias("b")).select("p.*", "b.by_code", "b.n")
    beside = sole.groupBy("part", "tokens", "joined", "by_code").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("part")))
    learned = beside.where((F.col("n") >= learn_rows) & (F.col("n") >= learn_share * F.col("all")) & (F.length("joined") >= 4)).select(F.col("by_code").alias("code"), "part", "tokens", "joined")
    listed = reference_names(ref, codes[0], name, others)
    names = listed.unionByName(learned.join(listed, "part", "left_anti"))
    held = names.limit(MOST_NAMES + 1).collect()
    if len(held) <= MOST_NAMES:
        found = _found_by_index(values, [tuple(r) for r in held], [tuple(r) for r in spelled.collect()], least)
    else:
        found = _found_by_joins(values, names, spelled, least)
    found = cut(found.select("value", "n", F.coalesce("found", F.array().cast(FOUND)).alias("found")), spark)
    # among equals the entry that is named exactly more often
    prior = found.select("n", F.explode("found").alias("f")).where("f.score > 0.999").groupBy("f.code").agg(F.sum("n").alias("prior"))
    scored = found.select("value", F.explode("found").alias("f")).select("value", "f.code", "f.score").join(prior, "code", "left")
    ranked = scored.groupBy("value").agg(F.sort_array(F.collect_list(F.struct(F.round("score", 6).alias("score"), F.coalesce("prior", F.lit(0)).alias("prior"), "code")), asc=False).alias("found"))
    best = F.element_at("found", 1)
    agreed = F.exists("found", lambda x: (x["code"] == F.col("by_code")) & (x["score"] >= best["score"] - 0.12))
    # part of a name that several entries share means none of them
    vague = (best["score"] < 0.75) & (F.size("found") > 1) & (F.try_element_at("found", F.lit(2))["score"] == best["score"])
    # an exact name is never overruled by the code beside it
    chosen = F.when(F.col("found").isNull() | vague, F.col("by_code")).when((best["score"] < 0.999) & agreed, F.col("by_code")).otherwise(best["code"])
    return rows.join(ranked, "value", "left").select("key", F.coalesce(chosen, F.lit("none")).alias("ref_code"), F.round(best["score"], 4).alias("score"), "by_code")
