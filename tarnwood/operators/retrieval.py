"""Hybrid retrieval over batches of queries: BM25 keyword route, dense vector route, reciprocal
rank fusion.  A query is a row, so any number of queries is one plan."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tarnwood.functions import text as tx
from tarnwood.session import cut, kept

K_ROUTE, K_FINAL, RRF_K = 30, 8, 60


def latest(papers: DataFrame) -> DataFrame:
    """One row per file: the last import (most cited where two came at once)."""
    w = Window.partitionBy("file").orderBy(F.desc_nulls_last("ingested_at"), F.desc_nulls_last("cited"))
    return papers.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def query_phrases(queries: DataFrame, query: str = "query", qid: str = "query_id") -> DataFrame:
    """(query_id, phrase, times): the tokens of each query, repeated ones counted."""
    t = queries.select(F.col(qid).alias("query_id"), F.explode(tx.query_tokens(F.col(query))).alias("phrase"))
    return t.groupBy("query_id", "phrase").agg(F.count("*").alias("times"))


@dataclass(frozen=True)
class Index:
    """Postings (term, key, dl, f, at) and one row of (docs, avgdl)."""

    postings: DataFrame
    size: DataFrame

    @staticmethod
    def over(chunks: DataFrame, key: str = "rowid", columns: Sequence[str] = ("text", "title")) -> Index:
        """The index as a plan over the texts, tokenised each time it is read.  ``key`` tells the rows apart."""
        # all columns as one list of terms; the empty term between two columns keeps phrases apart
        joined = F.concat(*[x for c in columns for x in (tx.terms(F.col(c)), F.array(F.lit("")))])
        # exploded from a list of one, the terms are computed once and not by each column that names them
        doc = chunks.select(F.col(key).alias("key"), *columns).repartition("key").select("key", F.explode(F.array(joined)).alias("ts")).withColumn("dl", F.size("ts") - len(columns))
        terms = doc.select("key", "dl", F.posexplode("ts").alias("pos", "term")).where("term <> ''")
        postings = terms.groupBy("key", "term").agg(F.first("dl").alias("dl"), F.count("*").alias("f"), F.collect_list("pos").alias("at"))
        return Index(postings, Index._size(postings, chunks))

    @staticmethod
    def _size(postings: DataFrame, chunks: DataFrame) -> DataFrame:
        """Documents without terms count too."""
        total = postings.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("terms"))
        return total.join(chunks.agg(F.count("*").cast("double").alias("docs"))).select("docs", (F.col("terms") / F.nullif("docs", F.lit(0.0))).alias("avgdl"))

    @staticmethod
    def built(chunks: DataFrame, key: str = "rowid", columns: Sequence[str] = ("text", "title")) -> Index:
        """The index written once for an application and a state of the files, then read.

        The texts are shuffled once, by key; a frequent term is spread over all files.  Files are sorted by term,
        so a search for few terms reads the row groups of these only."""
        spark, name = chunks.sparkSession, f"terms-{key}-{'-'.join(columns)}"
        postings = kept(spark, name, chunks, lambda: Index.over(chunks, key, columns).postings.sortWithinPartitions("term"))
        return Index(postings, kept(spark, name + "-size", chunks, lambda: Index._size(postings, chunks)))


#: Terms of all different questions up to which these are scored together by numbers, and terms up to which the texts are cut to them before they are handed to Python.
ASKED, NAMED = 1_000_000, 1_000
#: Questions and terms of one matrix of weights, and the rows it is multiplied with at once.
TILE, WIDE, ROWS = 1024, 256, 4096


def _matches(postings: DataFrame, phrases: DataFrame, hint=lambda df: df) -> DataFrame:
    """(phrase, key, dl, f) of (phrase, ts): how often each phrase occurs in each document.  Several terms match
    by aligned positions, so ``multi-layer`` matches its words side by side; one term needs no positions."""
    one = phrases.where(F.size("ts") == 1).select("phrase", F.col("ts")[0].alias("term"))
    single = postings.join(hint(one), "term").select("phrase", "key", "dl", "f")
    parts = phrases.where(F.size("ts") > 1).select("phrase", F.size("ts").alias("m"), F.posexplode("ts").alias("k", "term"))
    hits = postings.join(hint(parts), "term").select("phrase", "m", "key", "dl", "k", F.explode("at").alias("pos"))
    whole = hits.groupBy("phrase", "m", "key", "dl", (F.col("pos") - F.col("k")).alias("at")).agg(F.count("*").alias("n")).where("n = m")
    return single.unionByName(whole.groupBy("phrase", "key", "dl").agg(F.count("*").alias("f")))


def _rarity(docs: Column | float, n: Column | int):
    return (docs - n + 0.5) / (n + 0.5)


def keyword_scores(chunks: DataFrame | Index, queries: DataFrame, key: str = "rowid", columns: Sequence[str] = ("text", "title"), k1: float = 1.2, b: float = 0.75, mode: str = "OR") -> DataFrame:
    """(query_id, key, score): BM25 of every document with at least one phrase (all phrases with mode AND).

    Document frequencies and lengths come from the whole table."""
    index = chunks if isinstance(chunks, Index) else Index.over(chunks, key, columns)
    wanted = query_phrases(queries)
    tf = _matches(index.postings, wanted.select("phrase").distinct().withColumn("ts", tx.terms(F.col("phrase"))))
    df = tf.groupBy("phrase").agg(F.count("*").alias("n"))
    weight = F.greatest(F.log(_rarity(F.col("docs"), F.col("n"))), F.lit(1e-6))
    asked = df.join(F.broadcast(index.size)).join(wanted, "phrase").select("query_id", "phrase", (F.col("times") * weight).alias("weight"), "avgdl")
    part = F.col("weight") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(asked, "phrase").groupBy("query_id", "key").agg(F.sum(part).alias("score"), F.count("*").alias("met"))
    if mode == "AND":
        scored = scored.join(wanted.groupBy("query_id").agg(F.count("*").alias("all")), "query_id").where("met = all")
    return scored.select("query_id", F.col("key").alias(key), F.round("score", 6).alias("score"))


class Best:
    """The best ``k`` of each of several questions, fed with scores slice by slice; equal scores by key."""

    def __init__(self, questions: int, k: int):
        self.k, self.score, self.key = k, np.empty((questions, 0)), np.empty((questions, 0), dtype=object)

    def add(self, score: np.ndarray, keys: np.ndarray) -> None:
        """``score`` is questions x keys; -inf is no hit."""
        score = np.hstack([self.score, score])
        key = np.hstack([self.key, np.broadcast_to(keys.astype(object), (len(score), len(keys)))])
        if score.shape[1] > self.k:
            least = np.partition(score, -self.k, axis=1)[:, -self.k, None]
            take, equal = score > least, score == least
            free = self.k - take.sum(1)
            for i in np.flatnonzero(equal.sum(1) > free):
                tied = sorted(np.flatnonzero(equal[i]), key=key[i].__getitem__) if np.isfinite(least[i]) else np.flatnonzero(equal[i])
                equal[i] = False
                equal[i, tied[: free[i]]] = True
            take |= equal
            score, key = score[take].reshape(len(score), self.k), key[take].reshape(len(score), self.k)
        self.score, self.key = score, key

    def rows(self, ids: np.ndarray, id_: str = "query_id") -> pd.DataFrame:
        real = np.isfinite(self.score)
        return pd.DataFrame({id_: np.repeat(ids, real.sum(1)), "key": self.key[real], "score": self.score[real]})


def _held(chunks: DataFrame, key: str, columns: Sequence[str], forms: Sequence[str]) -> DataFrame:
    """(key, dl, form, f) of every text: the places of the ``forms`` (terms joined by blanks) that it holds and how
    often, counted in one pass over the texts; nothing is shuffled."""
    named = sorted({t for x in forms for t in x.split()})
    joined = F.concat(*[x for c in columns for x in (tx.terms(F.col(c)), F.array(F.lit("")))])
    doc = chunks.select(F.col(key).alias("key"), F.explode(F.array(joined)).alias("ts")).withColumn("dl", F.size("ts") - len(columns))
    at = F.sequence(F.lit(0), F.size("ts") - 1)
    doc = doc.withColumn("at", F.filter(at, lambda i: F.get("ts", i).isin(named)) if len(named) <= NAMED else at)
    doc = doc.select("key", "dl", "at", F.transform("at", lambda i: F.get("ts", i)).alias("term"))
    place = {t: i for i, t in enumerate(named)}
    split = [[place[t] for t in x.split()] for x in forms]
    shared = chunks.sparkSession.sparkContext.broadcast((named, split))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, split = shared.value
        values = pa.array(named, pa.string())
        single = np.full(len(named) + 1, -1)
        for i, x in enumerate(split):
            if len(x) == 1:
                single[x[0]] = i
        several = [(i, x) for i, x in enumerate(split) if len(x) > 1]
        for batch in batches:
            term = pc.fill_null(pc.index_in(batch["term"].flatten(), value_set=values), len(named)).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch["term"]).to_numpy())
            form = single[term]
            rows, found = [row[form >= 0]], [form[form >= 0]]
            if several and len(term):
                at = batch["at"].flatten().to_numpy().astype(np.int64)
                wide = int(at.max()) + max(len(x) for _, x in several) + 1
                place = row * wide + at
                order = np.argsort(term, kind="stable")
                begin = np.searchsorted(term[order], np.arange(len(named) + 1))
                of = lambda t: place[order[begin[t] : begin[t + 1]]]
                for i, x in several:  # a form of several terms is there where these stand side by side
                    start = of(x[0])
                    for k, t in enumerate(x[1:], 1):
                        start = start[np.isin(start + k, of(t), assume_unique=True)] if len(start) else start
                    rows.append(start // wide)
                    found.append(np.full(len(start), i))
            pair, f = np.unique(np.concatenate(rows) * max(1, len(split)) + np.concatenate(found), return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(batch) + 1) * max(1, len(split))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % max(1, len(split)), f)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["dl"], *lists], ["key", "dl", "form", "f"])

    schema = T.StructType([doc.schema["key"], doc.schema["dl"], T.StructField("form", T.ArrayType(T.IntegerType())), T.StructField("f", T.ArrayType(T.IntegerType()))])
    return doc.mapInArrow(count, schema)


class Leaders:
    """The best ``k`` of each of ``questions`` questions, fed with hits; equal scores by key."""

    def __init__(self, questions: int, k: int):
        self.k, self.least, self.last = k, np.full(questions, -np.inf), np.empty(questions, dtype=object)
        self.question, self.score, self.key = np.empty(0, dtype=np.int64), np.empty(0), None

    def add(self, question: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        take = score > self.least[question]
        tied = np.flatnonzero(score == self.least[question])
        take[tied] = key[tied] < self.last[question[tied]]
        if not take.any():
            return
        question, score = np.concatenate([self.question, question[take]]), np.concatenate([self.score, score[take]])
        key = key[take] if self.key is None else np.concatenate([self.key, key[take]])
        order = np.lexsort((key, -score, question))
        question = question[order]
        place = np.arange(len(order)) - np.searchsorted(question, question)
        full = order[place == self.k - 1]
        kept = order[place < self.k]
        self.least[question[place == self.k - 1]], self.last[question[place == self.k - 1]] = score[full], key[full]
        self.question, self.score, self.key = question[place < self.k], score[kept], key[kept]


def _tiles(bags: Sequence[Sequence[int]]) -> list[list[int]]:
    """Numbers of the questions, those of like forms together: at most ``TILE`` of them with ``WIDE`` forms, or one alone."""
    out: list[list[int]] = []
    held: set[int] = set()
    for i in sorted(range(len(bags)), key=lambda i: bags[i]):
        if not out or len(out[-1]) == TILE or len(held.union(bags[i])) > WIDE:
            out.append([])
            held = set()
        out[-1].append(i)
        held.update(bags[i])
    return out


def _best_of(docs: DataFrame, frequency: dict[int, int], size: tuple[float, float], bags: list, forms: dict[str, int], k: int, k1: float, b: float, mode: str) -> DataFrame:
    """(number, key, score): best ``k`` of each task for each of the ``bags`` (forms, times) by its number.

    Rows of ``docs`` times weights of questions are multiplied in single precision, a tile of both at a time; what may
    be among the best is scored again in double precision.  No pair of a question and a document is ever a row."""
    spark, (count, mean) = docs.sparkSession, size
    rarity = np.array([max(math.log(_rarity(count, n)), 1e-6) if n else 0.0 for n in (frequency.get(i, 0) for i in range(len(forms)))])
    own = [[forms[x] for x in r["forms"]] for r in bags]
    shared = spark.sparkContext.broadcast([(np.array(tile), np.repeat(np.arange(len(tile)), [len(own[i]) for i in tile]), np.array([x for i in tile for x in own[i]], dtype=np.int64), np.array([t for i in tile for t in bags[i]["times"]], dtype=float)) for tile in _tiles(own)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = []
        for numbers, column, form, times in shared.value:
            used, line = np.unique(form, return_inverse=True)
            weight = np.zeros((len(used), len(numbers)))
            weight[line, column] = times * rarity[form]
            tiles.append((numbers, used, weight.astype(np.float32), weight, np.bincount(column, minlength=len(numbers)), Leaders(len(numbers), k)))
        here, rows = np.full(len(rarity), -1), 64
        for batch in batches:
            i = 0
            while i < len(batch):
                part = batch.slice(i, rows)
                i, rows = i + rows, min(2 * rows, ROWS)
                row = np.repeat(np.arange(len(part)), pc.list_value_length(part["form"]).to_numpy())
                col, f = part["form"].flatten().to_numpy(), part["f"].flatten().to_numpy().astype(float)
                value = f * (k1 + 1) / (f + k1 * (1 - b + b * part["dl"].to_numpy()[row] / mean))
                key = part["key"].to_numpy(zero_copy_only=False)
                for _, used, coarse, weight, needed, best in tiles:
                    here[used] = np.arange(len(used))
                    mine = here[col] >= 0
                    found = np.zeros((len(part), len(used)))
                    found[row[mine], here[col[mine]]] = value[mine]
                    here[used] = -1
                    about = found.astype(np.float32) @ coarse
                    # a sum of n positive parts errs by less than n * 2e-7 of it in single precision, rounding by 5e-7
                    maybe = about > np.maximum(best.least * (1 - 1e-5 - 2e-7 * len(used)) - 1e-6, 0).astype(np.float32)
                    if mode == "AND":
                        maybe &= (found > 0).astype(np.float32) @ (coarse > 0).astype(np.float32) >= needed
                    r, q = np.nonzero(maybe)
                    for j in range(0, len(r), 65_536):
                        x, y = r[j : j + 65_536], q[j : j + 65_536]
                        best.add(y, np.round(np.einsum("ij,ji->i", found[x], weight[:, y]), 6), key[x])
        for numbers, *_, best in tiles:
            if best.key is not None:
                yield pa.RecordBatch.from_arrays([pa.array(numbers[best.question], pa.int64()), pa.array(best.key, types["key"]), pa.array(best.score)], ["number", "key", "score"])

    schema = T.StructType([T.StructField("number", T.LongType()), docs.schema["key"], T.StructField("score", T.DoubleType())])
    types = {"key": to_arrow_type(docs.schema["key"].dataType)}
    # each task gives the best of every question, so there are few tasks
    return docs.where(F.size("form") > 0).coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(score, schema)


def top_k(scores: DataFrame, k: int, key: str = "rowid", per: str = "query_id") -> DataFrame:
    """``scores`` with ``rank`` from 1, the best ``k`` of each query; equal scores by key."""
    w = Window.partitionBy(per).orderBy(F.desc("score"), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_search(chunks: DataFrame | Index, queries: DataFrame, scope: DataFrame | None = None, k: int = K_ROUTE, key: str = "rowid", columns: Sequence[str] = ("text", "title"), k1: float = 1.2, b: float = 0.75, mode: str = "OR") -> DataFrame:
    """Keyword route: best ``k`` chunks of each query among those in ``scope`` (key); written, as routes are read again.

    Equal questions are scored once.  Up to ``ASKED`` terms of different questions are scored together, over the
    texts in one pass or over an index; more are scored as rows, with equal results."""
    spark = queries.sparkSession
    asked = query_phrases(queries).groupBy("query_id", F.array_join(tx.terms(F.col("phrase")), " ").alias("form")).agg(F.sum("times").alias("times"))
    bag = F.sort_array(F.collect_list(F.struct("form", "times")))
    asked = cut(asked.groupBy("query_id").agg(bag.alias("bag")).select("query_id", F.col("bag.form").alias("forms"), F.col("bag.times").alias("times")), spark)
    bags = asked.select("forms", "times").distinct()
    if bags.agg(F.coalesce(F.sum(F.size("forms")), F.lit(0))).first()[0] > ASKED:
        index = chunks if isinstance(chunks, Index) else Index.over(chunks, key, columns)
        scores = keyword_scores(index, queries, key, columns, k1, b, mode)
        scores = scores.join(scope, key, "left_semi") if scope is not None else scores
        return cut(top_k(scores.select("query_id", key, "score"), k, key), spark)
    bags = bags.collect()
    forms = {x: i for i, x in enumerate(sorted({x for r in bags for x in r["forms"]}))}
    if isinstance(chunks, Index):
        named = sorted({t for x in forms for t in x.split()})
        postings = chunks.postings.where(F.col("term").isin(named)) if len(named) <= NAMED else chunks.postings
        matches = _matches(postings, spark.createDataFrame([(i, x.split()) for x, i in forms.items()], "phrase int, ts array<string>"), F.broadcast)
        docs, size = matches.groupBy("key").agg(F.first("dl").alias("dl"), F.collect_list("phrase").alias("form"), F.collect_list(F.col("f").cast("int")).alias("f")), chunks.size
    else:
        docs, size = _held(chunks, key, columns, list(forms)), None
    # read for the frequencies and for the scores
    docs = cut(docs, spark)
    frequency = dict(docs.select(F.explode("form").alias("i")).groupBy("i").agg(F.count("*").alias("n")).collect())
    size = docs.agg(F.count("*").cast("double").alias("docs"), F.avg("dl").alias("avgdl")).first() if size is None else size.first()
    if scope is not None:
        docs = docs.join(scope.withColumnRenamed(key, "key"), "key", "left_semi")
    best = top_k(_best_of(docs, frequency, (size["docs"], size["avgdl"] or 1.0), bags, forms, k, k1, b, mode), k, "key", "number")
    numbers = spark.createDataFrame([(i, r["forms"], r["times"]) for i, r in enumerate(bags)], "number long, forms array<string>, times array<long>")
    hits = best.join(asked.join(F.broadcast(numbers), ["forms", "times"]).select("query_id", "number"), "number")
    return cut(hits.select("query_id", F.col("key").alias(key), "score", "rank"), spark)


#: Different keys up to which a table is cut to them where it lies.
FEW = 1_000_000


def among(rows: DataFrame, keys: DataFrame, key: str = "rowid") -> DataFrame:
    """``rows`` of the ``keys``, for a join with them; up to ``FEW`` are broadcast, so that only rows asked for are shuffled,
    with more of them ``rows`` is left whole.  ``keys`` are counted, so they should be written."""
    keys = keys.select(key).distinct()
    return rows.join(F.broadcast(keys), key, "left_semi") if keys.count() <= FEW else rows


def normalised(vector: Column) -> Column:
    """Vector divided by its length, which counts as 1e-12 at least."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(length, F.lit(1e-12)))


SLICE = 1024


def _by_cell(v: DataFrame, q: DataFrame, k: int, key: str, block: int, shard: int) -> DataFrame:
    """Exact best ``k`` of (query_id, asked, cell) among the (key, held, cell) of the same cells.

    A cell of many vectors is cut into shards and its queries into blocks by their hashes, so the rows a task
    holds are bounded however the cells are filled; of each pair of them only the best ``k`` a query leave it."""
    sizes = v.groupBy("cell").agg(F.count("*").alias("n")).join(q.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    sizes = F.broadcast(sizes.select("cell", F.greatest(F.ceil(F.col("n") / shard), F.least(F.lit(8), F.floor(F.col("n") / 512)), F.lit(1)).alias("shards"), F.ceil(F.col("m") / block).alias("blocks")))
    part = lambda c, n: F.pmod(F.xxhash64(c), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    v = v.join(sizes, "cell").select("key", "held", "cell", part("key", F.col("shards")).alias("s"), every("blocks").alias("b"))
    q = q.join(sizes, "cell").select("query_id", "asked", "cell", part("query_id", F.col("blocks")).alias("b"), every("shards").alias("s"))
    schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("key", v.schema["key"].dataType), T.StructField("score", T.DoubleType())])

    def best(right: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        if right.empty or left.empty:  # a shard without vectors or a block without queries
            return pd.concat([left["query_id"][:0], right["key"][:0], pd.Series(dtype=float, name="score")], axis=1)
        out, asked, held, keys = [], left["asked"].to_numpy(), right["held"].to_numpy(), right["key"].to_numpy()
        for i in range(0, len(left), SLICE):  # scores are made for slices of both sides only
            best = Best(len(asked[i : i + SLICE]), k)
            for j in range(0, len(right), SLICE):
                best.add(np.round(np.stack(asked[i : i + SLICE]).astype(float) @ np.stack(held[j : j + SLICE]).astype(float).T, 6), keys[j : j + SLICE])
            out.append(best.rows(left["query_id"].to_numpy()[i : i + SLICE]))
        return pd.concat(out)

    found = v.groupBy("cell", "s", "b").cogroup(q.groupBy("cell", "s", "b")).applyInPandas(best, schema)
    return top_k(found.withColumnRenamed("key", key), k, key)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = K_ROUTE, key: str = "rowid", block: int = 1024, shard: int = 16384) -> DataFrame:
    """(query_id, key, score, rank): exact best ``k`` by inner product; ``vectors`` is (key, vector), ``queries``
    (query_id, vector).  Null vectors take no part."""
    v = vectors.where("vector is not null").select(F.col(key).alias("key"), F.col("vector").alias("held"), F.lit(0).alias("cell"))
    q = queries.where("vector is not null").select("query_id", F.col("vector").alias("asked"), F.lit(0).alias("cell"))
    return _by_cell(v, q, k, key, block, shard)


class VectorIndex:
    """Every vector in the cell of its nearest centre; a search reads the cells nearest to each query and scores
    their vectors exactly.  The centres come from at most ``sample`` vectors (those of the smallest key hash)."""

    def __init__(self, vectors: DataFrame, key: str = "rowid", cells: int = 64, sample: int = 20_000, rounds: int = 8):
        self.key, vectors = key, vectors.where("vector is not null").select(F.col(key).alias("key"), "vector")
        some = [r[0] for r in vectors.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").collect()]
        self.centres = _centres(np.array(some, dtype=float), cells, rounds) if some else np.zeros((1, 1))
        self.held = self._near(vectors.withColumnRenamed("vector", "held"), "held", 1)
        self.sample = some

    def _near(self, df: DataFrame, vector: str, n: int) -> DataFrame:
        """``df`` with ``cell``, a row for each of the ``n`` cells nearest to its vector."""
        centres = self.centres

        @F.pandas_udf("array<int>")
        def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                near = np.stack(b.to_numpy()).astype(float) @ centres.T if len(b) else np.empty((0, 1))
                yield pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :n].astype("int32")), dtype=object)

        return df.withColumn("cell", F.explode(cells(F.col(vector))))

    def search(self, queries: DataFrame, k: int = K_ROUTE, probes: int | None = None, block: int = 1024, shard: int = 16384) -> DataFrame:
        """(query_id, key, score, rank); ``probes`` cells a query, by default as many as :meth:`probes_for` asks."""
        q = self._near(queries.where("vector is not null").select("query_id", F.col("vector").alias("asked")), "asked", probes or self.probes_for(k))
        return _by_cell(self.held, q, k, self.key, block, shard)

    def probes_for(self, k: int, recall: float = 0.95, asked: int = 200) -> int:
        """The fewest cells that hold ``recall`` of the true best ``k``, measured within the sample by brute force."""
        x = np.array(self.sample)
        if len(x) <= k:
            return len(self.centres)
        own = (x @ self.centres.T).argmax(1)
        scores = x[:asked] @ x.T
        best = np.argsort(-scores, axis=1)[:, :k]
        order = np.argsort(np.argsort(-(x[:asked] @ self.centres.T), axis=1), axis=1)
        place = np.take_along_axis(order, own[best], 1).ravel()
        return int(np.quantile(place, recall, method="higher")) + 1


def _centres(x: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """``n`` centres of unit length by Lloyd's rounds, begun at rows spread over ``x``; empty cells keep their centre."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    centres = unit(x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit(x))
        centres = np.where((np.bincount(own, minlength=len(centres)) > 0)[:, None], unit(sums), centres)
    return centres


def fuse(routes: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, rowid, score, routes, kw_rank, vec_rank) of (query_id, rowid, route, rank, weight)
    by reciprocal rank fusion; a route of weight 0 still contributes its rows."""
    g = routes.groupBy("query_id", "rowid").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "rank")))).alias("routes"),
    )
    return g.withColumn("kw_rank", F.try_element_at("routes", F.lit("keyword"))).withColumn("vec_rank", F.try_element_at("routes", F.lit("vector")))


def routed(keyword: DataFrame, vector: DataFrame, w_keyword: float = 1.0, w_vector: float = 1.0) -> DataFrame:
    a = keyword.select("query_id", "rowid", F.lit("keyword").alias("route"), "rank", F.lit(w_keyword).alias("weight"))
    return a.unionByName(vector.select("query_id", "rowid", F.lit("vector").alias("route"), "rank", F.lit(w_vector).alias("weight")))


def in_order(fused: DataFrame) -> DataFrame:
    """``fused`` with its place: by score, equal scores in the order of the keyword route, then the vector route."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("kw_rank"), F.asc_nulls_last("vec_rank"), "rowid")
    return fused.withColumn("place", F.row_number().over(w))


def year_filter(hits: DataFrame, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """Rows within the bounds; a bound of 0 or None is no bound, an unknown year fails any bound."""
    year = F.nullif(F.col("year"), F.lit(0))
    if year_min:
        hits = hits.where(F.coalesce(year, F.lit(0)) >= year_min)
    if year_max:
        hits = hits.where(F.coalesce(year, F.lit(9999)) <= year_max)
    return hits


def search(chunks: DataFrame, papers: DataFrame, vectors: DataFrame, queries: DataFrame, index: Index | None = None, category: str = "film_motor", tier: str | None = None, year_min: int | None = None, year_max: int | None = None, k: int = K_FINAL) -> DataFrame:
    """Final hits of each query: scope and tier before each route's cut, the year after the cut to
    max(5k, 40) fused rows, so fewer than ``k`` may be left.  ``queries`` is (query_id, query, vector); without an
    ``index`` the texts are tokenised anew."""
    own = papers.where(F.col("category") == category)
    if tier:
        own = own.where(F.col("tier").contains(tier))
    scope = chunks.select("rowid", "file").join(own.select("file"), "file", "left_semi").select("rowid")
    keyword = keyword_search(index or chunks, queries, scope)
    vector = vector_search(vectors.join(scope, "rowid", "left_semi"), queries.where("vector is not null").select("query_id", "vector"))
    cand = in_order(fuse(routed(keyword, vector))).where(F.col("place") <= max(5 * k, 40))
    meta = own.select("file", "year", "tier", F.col("title").alias("paper_title"))
    hits = year_filter(cand.join(chunks.select("rowid", "file"), "rowid").join(meta, "file"), year_min, year_max)
    w = Window.partitionBy("query_id").orderBy("place")
    return hits.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k)


def context_block(hits: DataFrame) -> DataFrame:
    """(query_id, context): the numbered snippets of a query as one prompt block."""
    or_ = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d))
    block = F.concat(
        F.lit("["), F.col("n"), F.lit("] "), or_("title", "(untitled)"), F.lit(" | "), F.coalesce(F.split("authors", ",")[0], F.lit("")), F.lit(" et al. | "), or_("year", "?"), F.lit(" | "), or_("venue", "?"),
        F.lit(" | "), or_("tier", "?"), F.lit(" | DOI "), or_("doi", "—"), F.lit(" | p. "), or_("page", "not verified"), F.lit("\n"), F.trim(F.coalesce("text", F.lit(""))),
    )
    rows = hits.select("query_id", F.struct(F.col("n"), block.alias("b")).alias("s"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]), "\n\n").alias("context"))


def batches_of(embed, column: Column, size: int = 10) -> Column:
    """An injected embedder (list of texts to list of vectors) over ``column``, at most ``size`` texts a call."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            texts = ["" if t is None else t for t in p]
            out: list = []
            for i in range(0, len(texts), size):
                got = embed(texts[i : i + size])
                if len(got) != len(texts[i : i + size]):
                    raise ValueError("the embedder returned another number of vectors")
                out += got
            yield pd.Series(out, dtype=object)

    return run(column)
