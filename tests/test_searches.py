"""Searches with many questions over many texts: one pass over the texts, no index written, no row for a question and a text."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwood.operators import evaluate, retrieval
from tarnwood.plans import registry
from tests.oracle import same

NAMES = """bm25_topk beginner_path build_context learn_overlap presented_path scoped_tiered_search bm25_all_words cited_works hybrid_search
legacy_search eval_nomination rrf_fusion weight_sweep mode_compare hybrid_gain retrieval_metrics hydrated_hits""".split()


def refused(*_, **__):
    raise AssertionError("an index is written or pairs are scored as rows")


@pytest.mark.parametrize("name", NAMES)
def test_one_pass(spark, data, monkeypatch, name):
    monkeypatch.setattr(retrieval, "kept", refused)
    monkeypatch.setattr(retrieval, "keyword_scores", refused)
    same(spark, registry.QUERIES[name], registry.SQL[name], data)


def _texts(spark):
    return spark.createDataFrame([(i, f"w{i % 7} w{i % 11} multi layer" * (i % 3), f"w{i % 5}") for i in range(60)], "rowid long, text string, title string")


def test_many_questions_are_no_rows(spark, monkeypatch):
    q = spark.range(12_000).select(F.col("id").alias("query_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") % n) for n in (7, 11, 5, 13)], F.lit("multi-layer")).alias("query"))
    few = q.where("query_id % 1000 = 7")
    want = sorted(map(repr, retrieval.keyword_search(_texts(spark), few, k=5).collect()))
    monkeypatch.setattr(retrieval, "keyword_scores", refused)
    got = retrieval.keyword_search(_texts(spark), q, k=5)
    assert got.select("query_id").distinct().count() == 12_000
    assert sorted(map(repr, got.where("query_id % 1000 = 7").collect())) == want


@pytest.mark.parametrize("mode", ["OR", "AND"])
def test_small_tiles_and_all_terms_give_the_same(spark, monkeypatch, mode):
    texts, q = _texts(spark), spark.createDataFrame([(i, f"W{i % 7} w{i % 11} w{i % 7} multi-layer" if i % 4 else "multi_layer w3 w4 W4") for i in range(40)], "query_id long, query string")
    for df in (texts, texts.withColumn("rowid", F.format_string("k%03d", "rowid"))):
        found = lambda: sorted(tuple(r) for r in retrieval.keyword_search(df, q, k=6, mode=mode).collect())  # noqa: B023, E731
        want = found()
        assert want
        for limits in ({"TILE": 3, "WIDE": 2, "ROWS": 5}, {"NAMED": 0}, {"ASKED": 0}):
            with monkeypatch.context() as m:
                for name, value in limits.items():
                    m.setattr(retrieval, name, value)
                assert found() == want


@pytest.mark.parametrize("kind", [int, str])
def test_leaders_take_equal_scores_by_key(kind):
    rng = np.random.default_rng(5)
    score, keys = rng.integers(1, 4, (6, 200)).astype(float), np.array([kind(x) for x in rng.permutation(200)], dtype=int if kind is int else object)
    best = retrieval.Leaders(6, 9)
    for i in range(0, 200, 37):
        q, x = np.nonzero(score[:, i : i + 37] > 1)
        best.add(q, score[:, i : i + 37][q, x], keys[i : i + 37][x])
    for i in range(6):
        want = sorted((-s, key) for s, key in zip(score[i], keys, strict=True) if s > 1)[:9]
        assert [(-s, key) for s, key in zip(best.score[best.question == i], best.key[best.question == i], strict=True)] == want


@pytest.mark.parametrize("name", ["retrieval_metrics", "mode_compare", "hybrid_gain", "weight_sweep"])
def test_gold_makes_no_pairs(spark, data, monkeypatch, name):
    monkeypatch.setattr(evaluate.Gold, "pairs", refused)
    same(spark, registry.QUERIES[name], registry.SQL[name], data)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hydrated_hits"])
def test_chunks_are_cut_to_the_hits_where_they_lie(spark, data, monkeypatch, name):
    monkeypatch.setattr(retrieval, "keyword_scores", refused)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert re.search(r"BroadcastHashJoin \[rowid#\d+L?\], \[rowid#\d+L?\], LeftSemi, BuildRight", _plan(registry.QUERIES[name](spark, data)))
        monkeypatch.setattr(retrieval, "FEW", 0)  # more hits than may be broadcast
        assert "LeftSemi, BuildRight" not in _plan(registry.QUERIES[name](spark, data))
        same(spark, registry.QUERIES[name], registry.SQL[name], data)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_presented_path_is_found_once(spark, data):
    assert "FileScan" not in _plan(registry.QUERIES["presented_path"](spark, data))
