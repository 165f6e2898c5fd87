"""Retrieval evaluation: distinct papers in rank order, recall, reciprocal rank, nDCG, sweeps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwood.operators import retrieval

# Weights of the keyword and the vector route that a sweep tries, in order.
SWEEP = ((1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (1.0, 3.0), (3.0, 1.0))


@dataclass(frozen=True)
class Gold:
    """Gold sets that questions share: (query_id, topic) of the questions and (topic, file) of the papers right for a topic.

    Measured as they are: their pairs of a question and a paper grow as questions x papers.  A paper is right for one topic
    of a question at most."""

    asked: DataFrame
    right: DataFrame

    def pairs(self) -> DataFrame:
        """(query_id, file)."""
        return self.asked.join(self.right, "topic").select("query_id", "file")

    def sizes(self) -> DataFrame:
        """(query_id, gold): how many papers are right."""
        n = self.right.distinct().groupBy("topic").agg(F.count("*").alias("n"))
        return self.asked.distinct().join(n, "topic").groupBy("query_id").agg(F.sum("n").alias("gold"))

    def met(self, papers: DataFrame) -> DataFrame:
        """The rows of ``papers`` (query_id, file, …) that are right."""
        return papers.join(self.asked.distinct(), "query_id").join(self.right, ["topic", "file"], "left_semi").drop("topic")


def to_papers(ranked: DataFrame, chunks: DataFrame, by: tuple[str, ...] = ("query_id",), place: str = "place") -> DataFrame:
    """(by…, file, rank): the distinct papers of ranked chunks, each at its first chunk."""
    first = ranked.join(chunks.select("rowid", "file"), "rowid").groupBy(*by, "file").agg(F.min(place).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).drop("at")


def measures(papers: DataFrame, gold: DataFrame | Gold, k: int = 8, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by…, recall, mrr, ndcg) of every question with a gold set, over the first ``k`` papers; ``gold`` is (query_id, file) or shared.

    ``by`` begins with query_id; further columns (a mode, a weight) split the runs."""
    size = gold.sizes() if isinstance(gold, Gold) else gold.select("query_id", "file").distinct().groupBy("query_id").agg(F.count("*").alias("gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    runs = papers.select(*by[1:]).distinct() if len(by) > 1 else None
    asked = size.join(runs) if runs is not None else size  # a row for each run is a handful
    hits = papers.where(F.col("rank") <= k)
    hits = gold.met(hits) if isinstance(gold, Gold) else hits.join(gold.select("query_id", "file").distinct(), ["query_id", "file"], "left_semi")
    g = hits.groupBy(*by).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    m = asked.join(g, list(by), "left")
    return m.select(
        *by, F.round(F.coalesce(F.col("hits") / F.col("gold"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
    )


def sweep(keyword: DataFrame, vector: DataFrame, chunks: DataFrame, gold: DataFrame | Gold, weights: Sequence[tuple[float, float]] = SWEEP, depth: int = 32) -> DataFrame:
    """(run, recall, mrr, ndcg, best): the fused routes under each pair of weights; the first of the runs of the highest nDCG is the best."""
    runs = keyword.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(weights)], "run int, wk double, wv double")
    each = retrieval.routed(keyword, vector).drop("weight").join(F.broadcast(runs)).withColumn("weight", F.when(F.col("route") == "keyword", F.col("wk")).otherwise(F.col("wv")))
    at = lambda r: F.min(F.when(F.col("route") == r, F.col("rank")))
    g = each.groupBy("run", "query_id", "rowid").agg(F.round(F.sum(F.col("weight") / (retrieval.RRF_K + F.col("rank"))), 9).alias("score"), at("keyword").alias("kw_rank"), at("vector").alias("vec_rank"))
    w = Window.partitionBy("run", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("kw_rank"), F.asc_nulls_last("vec_rank"), "rowid")
    by = ("query_id", "run")
    m = macro(measures(to_papers(g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= depth), chunks, by), gold, by=by), "run")
    best = F.first("run").over(Window.orderBy(F.desc("ndcg"), "run"))  # one row for each pair of weights
    return m.select("run", "recall", "mrr", "ndcg", (F.col("run") == best).alias("best"))


def macro(per_query: DataFrame, *by: str) -> DataFrame:
    """Means over the questions."""
    return per_query.groupBy(*by).agg(F.count("*").alias("questions"), *[F.round(F.avg(m), 6).alias(m) for m in ("recall", "mrr", "ndcg")])


def gain(per_mode: DataFrame) -> DataFrame:
    """One row of (recall_gain, mrr_gain, ndcg_gain): hybrid less the better single route, from (mode, recall, mrr, ndcg)."""
    at = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    return per_mode.agg(*[F.round(at("hybrid", c) - F.greatest(at("keyword", c), at("vector", c)), 6).alias(f"{c}_gain") for c in ("recall", "mrr", "ndcg")])


def nominate(keyword: DataFrame, chunks: DataFrame, old: DataFrame | None = None, n: int = 8) -> DataFrame:
    """(query_id, file, rank, kept): papers a person should judge, and whether they are in the old gold set."""
    first = to_papers(keyword, chunks, place="rank").where(F.col("rank") <= n)
    if old is None:
        return first.withColumn("kept", F.lit(False))
    return first.join(old.select("query_id", "file", F.lit(True).alias("kept")), ["query_id", "file"], "left").na.fill(False, ["kept"])
