"""Small fixtures for the rules of the retrieval, analytics and ingestion operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwood.functions import text as tx
from tarnwood.operators import corpus, evaluate, geo, ingest, points, retrieval, tree


def values(spark, column, rows, type_="string"):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {type_}").orderBy("i").select(column(F.col("x"))).collect()]


def test_query_tokens(spark):
    got = values(spark, tx.query_tokens, ["what is V_max * (gap) : 100um?", "!!!???", "", None, "静电薄膜电机的推力密度", "a 5"])
    assert got == [["is", "V_max", "gap", "100", "um"], [], [], [], ["静电薄膜电机的推力密度"], ["5"]]


def test_match_expression(spark):
    assert values(spark, tx.match_expression, ["film-motor gap", "??"]) == ['"film-motor" OR "gap"', None]


def test_author_names(spark):
    got = values(spark, tx.author_name, ["T. Higuchi", "Toshiro Higuchi", "Higuchi, Toshiro", "et al.", "Li", "Niino", None])
    assert [g and g["key"] for g in got] == ["higuchi|t"] * 3 + [None] * 4


def test_author_pieces(spark):
    assert [p.strip() for p in values(spark, tx.author_pieces, ["T. Higuchi and A. Yamamoto、S. Egawa；Anderson"])[0]] == ["T. Higuchi", "A. Yamamoto", "S. Egawa", "Anderson"]


def test_institutions_and_codes(spark):
    assert values(spark, tx.institution_name, ["The University of Tokyo, Dept. X", "Department of Physics (A)", "N/A", "MIT", None]) == ["University of Tokyo", "Physics", None, None, None]
    assert values(spark, tx.country_code, [" jpn ", "TWN", "HKG", "NUL", "N/A", "JP", None]) == ["JPN", "CHN", "CHN", None, None, None, None]


def test_page_order(spark):
    assert values(spark, tx.page_order, [None, "x", "2", "10", "12a"]) == [None, 0, 2, 10, 12]


def test_watermark(spark):
    text = "A Authorized licensed use limited to: X\nY. Downloaded on Z from IEEE Xplore. Restrictions apply. B"
    assert values(spark, tx.strip_watermark, [text, None, "plain"]) == ["A B", "", "plain"]


def test_json_span(spark):
    assert values(spark, tx.json_span, ['x [{"a": 1}] y', 'x {"a": [1]} y', "none", "{ open", None]) == ['[{"a": 1}]', '{"a": [1]}', None, None, None]


def test_chunker_lengths():
    sizes = lambda t: [len(c) for c in ingest.chunks_of(t)]
    assert sizes("x" * 199) == [] and sizes("x" * 200) == [200] and sizes("x" * 1680) == [1680]
    assert sizes("x" * 5000) == [1200, 1200, 1200, 1400]
    assert sizes("\n\n".join(["x" * 700] * 2)) == [1402]
    assert sizes("\n\n".join(["x" * 900] * 2)) == [900, 900]
    assert sizes("\n\n".join(["x" * 900, "x" * 900, "x" * 50])) == [900, 952]


def test_rrf(spark):
    rows = [(1, i, "keyword", n, 1.0) for n, i in enumerate([1, 2, 3], 1)] + [(1, i, "vector", n, 1.0) for n, i in enumerate([4, 2, 5], 1)]
    got = retrieval.in_order(retrieval.fuse(spark.createDataFrame(rows, "query_id int, rowid int, route string, rank int, weight double"))).orderBy("place").collect()
    assert [r["rowid"] for r in got] == [2, 1, 4, 3, 5] and got[0]["score"] == pytest.approx(2 / 62, abs=1e-6)


def test_keyword_phrases_and_idf_floor(spark):
    c = spark.createDataFrame([(1, "multi layer film", None), (2, "layer multi film", None), (3, "film", "film Électrode"), (4, None, None)], "rowid long, text string, title string")
    q = spark.createDataFrame([(10, "multi-layer"), (11, "film"), (12, "electrode"), (13, "!!")], "query_id long, query string")
    got = {(r["query_id"], r["rowid"]) for r in retrieval.keyword_search(c, q).collect()}
    assert got == {(10, 1), (11, 1), (11, 2), (11, 3), (12, 3)}


def test_vectors_equal_full_sort(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8)).astype("float32")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "rowid long, vector array<float>")
    q = v.where("rowid < 5").select(F.col("rowid").alias("query_id"), "vector")
    got = retrieval.vector_search(v, q, k=7, block=2, shard=64).orderBy("query_id", "rank").collect()
    for i in range(5):
        s = np.round(m.astype(float) @ m[i].astype(float), 6)
        assert [r["rowid"] for r in got if r["query_id"] == i] == sorted(range(300), key=lambda j: (-s[j], j))[:7]
    assert retrieval.vector_search(v.limit(0), q).count() == 0


def test_year_bounds(spark):
    h = spark.createDataFrame([(1, 2005), (2, None), (3, 0), (4, 1990)], "id int, year int")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(retrieval.year_filter(h, 2000)) == [1] and ids(retrieval.year_filter(h, 0, 0)) == [1, 2, 3, 4] and ids(retrieval.year_filter(h, None, 1999)) == [4]


def test_scope_never_widens(spark):
    p = spark.createDataFrame([("a", "film_motor"), ("b", "cross")], "file string, category string")
    assert corpus.scoped(p, "cross").count() == 0 and corpus.scoped(p, None).count() == 1
    with pytest.raises(ValueError):
        corpus.domain("other")


def test_points(spark):
    rows = [(1, "f", "thrust", 828.0, "mN", None, None), (2, "f", "thrust", 0.828, "N", None, None), (3, "f", "thrust", 5.0, "foo", None, None), (4, "f", "efficiency", 230.0, "%", None, None), (5, "f", "speed", 0.0, "m/s", None, None)]
    df = spark.createDataFrame(rows, "id long, file string, metric string, value double, unit string, voltage_kv double, gap_um double")
    assert tuple(points.counters(df).first()) == (1, 3, 1)
    four = spark.createDataFrame([(i, "f", "thrust", float(v), "N", None, None) for i, v in enumerate([1, 2, 3, 10])], df.schema)
    assert points.metric_stats(four).first()["median"] == 3


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, f, i) for i, f in enumerate("abcd", 1)], "query_id int, file string, rank int")
    gold = spark.createDataFrame([(1, f) for f in "bdx"] + [(2, "a")], "query_id int, file string")
    got = {r["query_id"]: r for r in evaluate.measures(ranked, gold, k=3).collect()}
    assert got[1]["recall"] == pytest.approx(1 / 3, abs=1e-6) and got[1]["mrr"] == 0.5 and got[1]["ndcg"] == pytest.approx(0.2961, abs=1e-4)
    assert got[2]["recall"] == 0


def test_tree(spark):
    t = tree.nodes(spark)
    assert t.count() == 23 and tree.leaves(t).count() == 17 and t.select("id").distinct().count() == 23
    assert [r["id"] for r in tree.preorder(t).orderBy("place").limit(3).collect()] == ["fm_root", "fm_fund", "fm_force"]


def test_last_position_counts(spark):
    q = spark.createDataFrame([(1, "a", 1), (1, "a", 6)], "query_id long, file string, rank int")
    n = spark.createDataFrame([("fm_force", "a")], "id string, file string")
    best = lambda p: tree.focus(q, n, tree.nodes(spark), position=p).where("id = 'fm_force'").first()["score"]
    assert best("last") == pytest.approx(1 / 6) and best("first") == 1


def test_votes(spark):
    p = spark.createDataFrame([("a", "fm", None, "①x"), ("b", "fm", None, "③y"), ("c", "both", None, None)], "file string, folder string, direction string, tier string")
    got = {r["file"]: (r["category"], r["cross"], r["by"]) for r in ingest.classify(p, {"fm": "F", "both": "CROSS"}, {}, {"③": "E", "①": "F"}, "F").collect()}
    assert got == {"a": ("F", False, "metadata"), "b": ("E", True, "tier"), "c": ("F", True, "tier")}


def test_catalogs(spark):
    a = spark.createDataFrame([("d\\x.pdf", 1, "", "2001-02"), ("d/x", 2, "T", None)], "path string, seq int, title string, year string")
    b = spark.createDataFrame([("e/x.pdf", 1, "U"), ("1999_y", 2, None)], "path string, seq int, title string")
    got = {r["file"]: (r["title"], r["year"]) for r in ingest.paper_rows(ingest.merge_catalogs([a, b], ["title", "year", "authors", "venue", "cited", "abstract"])).collect()}
    assert got == {"x.pdf": ("T", 2001), "1999_y.pdf": ("1999 y", 1999)}


def test_rings():
    assert geo.rings("M0 0 L1 0 1 1 Z") == [[(0, 0), (1, 0), (1, 1)]]
    assert geo.rings("m1,1 h2 v2 h-2 z m5 5 1 0") == [[(1, 1), (3, 1), (3, 3), (1, 3)]]
    assert geo.rings(None) == [] and geo.rings("Z 5 5") == []
    assert geo.area([(0, 0), (2, 0), (2, 2), (0, 2)]) == 4
    assert geo.shape("M0 0 L1 0 1 1 Z") == ("", 0.7, 0.3)


def test_injected_model(spark):
    def model(prompt):
        if prompt == "bad":
            raise ValueError
        return prompt.upper()

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "p string")
    assert [r["reply"] for r in ingest.ask_rows(df, F.col("p"), model).collect()] == ["A", None, None]


def test_embedder(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(25)], "i int, t string").coalesce(1)
    got = df.select("i", retrieval.batches_of(lambda ts: [[float(len(t))] for t in ts], F.col("t")).alias("v")).collect()
    assert all(r["v"] == [float(r["i"])] for r in got)


def test_incremental_upsert(spark, tmp_path):
    from tarnwood.streaming import incremental

    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    a = spark.createDataFrame([("k", 1, 1), ("l", 1, 1)], "k string, v int, t int")
    a.coalesce(1).write.parquet(src)
    run = lambda: incremental.run_available(incremental.read_new(spark, src, a.schema), incremental.upsert_batches(target, "k", "t"), str(tmp_path / "ck"))
    run()
    spark.createDataFrame([("k", 2, 2)], a.schema).coalesce(1).write.mode("append").parquet(src)
    run()
    rows = lambda: sorted(map(tuple, incremental.upserted(spark, target, a.schema).collect()))
    assert rows() == [("k", 2, 2), ("l", 1, 1)] and len(list((tmp_path / "out" / "v=1").glob("b=*"))) == 1  # only the bucket of k
    # a lost checkpoint reads everything again and changes nothing; an unfinished version is not read
    run = lambda: incremental.run_available(incremental.read_new(spark, src, a.schema), incremental.upsert_batches(target, "k", "t"), str(tmp_path / "other"))
    run()
    assert rows() == [("k", 2, 2), ("l", 1, 1)]
    (tmp_path / "out" / "v=2" / "_SUCCESS").unlink()
    assert rows() == [("k", 2, 2), ("l", 1, 1)]


def test_files_upserts_and_evolution(spark, tmp_path):
    from tarnwood.sources import tables

    files = spark.createDataFrame([("b/x.pdf", "x.pdf"), ("a/x.pdf", "x.pdf"), ("b/y.pdf", "y.pdf")], "path string, name string")
    assert {r["path"] for r in ingest.newest_files(files).collect()} == {"a/x.pdf", "b/y.pdf"}
    disk, have = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "file string"), spark.createDataFrame([("b",)], "file string")
    assert sorted(str(r["file"]) for r in ingest.pending(disk, have).collect()) == ["None", "a"]
    assert sorted(str(r["file"]) for r in ingest.pending(disk, have, have).collect()) == ["None", "a", "b"]
    old = spark.createDataFrame([(1, "u"), (2, None)], "k int, v string")
    assert sorted(map(tuple, ingest.update_column(old, spark.createDataFrame([(2, "w"), (9, "z")], old.schema), "k", "v").collect())) == [(1, "u"), (2, "w")]
    assert tables.with_columns(old, v=F.lit("x"), w=F.lit(0)).columns == ["k", "v", "w"]
    assert tables.table_or_none(spark, str(tmp_path), "absent") is None
    old.write.parquet(str(tmp_path / "here.parquet"))
    assert tables.table_or_none(spark, str(tmp_path), "here").count() == 2


def test_replies_and_vectors(spark):
    df = spark.createDataFrame([(1, 'x [{"k": 1}, {"k": null}] y'), (2, "{\"k\": 3}"), (3, "nothing"), (4, None), (5, "[broken")], "id int, reply string")
    assert sorted(map(str, [tuple(r) for r in ingest.reply_rows(df, "id", "reply", "k bigint").collect()])) == ["(1, 1)", "(1, None)", "(2, 3)"]
    c = spark.createDataFrame([(1,), (2,), (3,)], "rowid long")
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0])], "rowid long, vector array<float>")
    assert {r["rowid"]: r["reused"] for r in ingest.reuse_vectors(c, v).collect()} == {1: False, 2: True, 3: False}
    edited, embedded = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "rowid long, digest string"), spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0])], "rowid long, digest string, vector array<float>")
    assert sorted(tuple(r) for r in ingest.reuse_vectors(edited, embedded).collect()) == [(1, True), (2, False), (2, True)]
    unit = v.select(retrieval.normalised(F.col("vector")).alias("n")).collect()
    assert [r["n"] for r in unit] == [[0.0, 0.0], [0.0, 1.0]]


def test_keyword_route_as_matrix_and_as_rows(spark, data, monkeypatch):
    from tarnwood.plans import reference
    from tarnwood.sources.tables import table

    chunks = table(spark, data, "chunks")
    q = table(spark, data, "documents").where("title is not null and doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "title", F.col("title").alias("query"))
    q = q.unionByName(spark.createDataFrame([(-1, None, None), (-2, "", "the"), (-3, "", "zzzz no-such-word"), (-4, "", "film film motor")], q.schema))
    for mode in ("OR", "AND"):
        rows = lambda source, mode=mode: sorted(map(repr, retrieval.keyword_search(source, q, chunks.where("rowid % 2 = 0").select("rowid"), 7, mode=mode).collect()))
        one = rows(retrieval.Index.built(chunks))
        assert one == rows(chunks)
        with monkeypatch.context() as m:
            m.setattr(retrieval, "ASKED", 0)
            assert one == rows(chunks)
    assert reference.bm25_topk(spark, data).count() > 0


def test_best_takes_equal_scores_by_key():
    rng = np.random.default_rng(5)
    score, keys = rng.integers(0, 4, (6, 200)).astype(float), rng.permutation(200)
    score[5] = -np.inf
    best = retrieval.Best(6, 9)
    for i in range(0, 200, 37):
        best.add(score[:, i : i + 37], keys[i : i + 37])
    got = best.rows(np.arange(6))
    for i in range(6):
        want = sorted(zip(-score[i], keys, strict=True))[:9] if i < 5 else []
        assert sorted(zip(-got[got["query_id"] == i]["score"], got[got["query_id"] == i]["key"], strict=True)) == want


def test_vector_index_finds_nine_of_ten(spark, data):
    from tarnwood.sources.tables import table

    v = table(spark, data.replace("sf0.001", "sf0.1"), "embeddings").select(F.col("vec_id").alias("rowid"), F.col("embedding").alias("vector"))
    q = v.where("rowid % 20 = 0").select(F.col("rowid").alias("query_id"), "vector")
    index = retrieval.VectorIndex(v, cells=32)
    assert index.held.count() == v.count()
    pairs = lambda df: {(r["query_id"], r["rowid"]) for r in df.select("query_id", "rowid").collect()}
    true = pairs(retrieval.vector_search(v, q, 10))
    assert len(true & pairs(index.search(q, 10))) >= 0.9 * len(true)
    # a hot cell is cut into shards and its queries into blocks, with equal results; all cells probed are exact
    assert pairs(index.search(q, 10, probes=32, block=7, shard=100)) == true
    empty = retrieval.VectorIndex(v.limit(0))
    assert empty.search(q, 3).count() == 0


def test_snippet(spark):
    df = spark.createDataFrame([("one two three film, four motor film five six", ["film", "motor"]), ("nothing here", ["film"]), ("", ["x"]), (None, ["x"])], "t string, w array<string>")
    got = [r[0] for r in df.select(tx.snippet(F.col("t"), F.col("w"), 3)).collect()]
    assert got == ["…【film】, four 【motor】…", "nothing here", "", ""]
    assert spark.range(1).select(tx.html_marked(F.lit("a<b 【x&y】"))).first()[0] == "a&lt;b <b>x&amp;y</b>"


def test_two_trees_in_one_plan(spark):
    a, b = tree.nodes(spark, "r | | 0 | R |\nx | r | 1 | X | q"), tree.nodes(spark, "r | | 0 | R |\ny | r | 1 | Y | q")
    both = tree.preorder(a).unionByName(tree.preorder(b))
    assert sorted(r["id"] for r in both.collect()) == ["r", "r", "x", "y"]
    ids = spark.createDataFrame([("x",), ("y",), ("z",), ("r",)], "id string")
    assert {r["id"]: r["domain"] for r in tree.domain_of({"a": a, "b": b}, ids).collect()} == {"x": "a", "y": "b", "z": None, "r": "a"}


def test_labels_and_gain(spark):
    b = spark.createDataFrame([("A", 9, 0.0, 0.0), ("B", 8, 50.0, 50.0), ("C", 7, 500.0, 0.0)], "iso3 string, papers long, x double, y double")
    assert [r["iso3"] for r in geo.labels(b).orderBy(F.desc("papers")).collect()] == ["A", "C"]
    m = spark.createDataFrame([("keyword", 0.2, 0.5, 0.3), ("vector", 0.4, 0.1, 0.2), ("hybrid", 0.5, 0.4, 0.4)], "mode string, recall double, mrr double, ndcg double")
    assert tuple(evaluate.gain(m).first()) == (0.1, -0.1, 0.1)


def test_empty_tables(spark, data):
    """Every operator that reads papers, chunks or points gives an empty or zero result on empty tables."""
    from tarnwood.sources.tables import table

    papers, chunks, geo_, bench = (table(spark, data, t).limit(0) for t in ("papers", "chunks", "paper_geo", "benchmark"))
    q = spark.createDataFrame([(1, "film motor", None)], "query_id long, query string, vector array<float>")
    v = spark.createDataFrame([], "rowid long, vector array<float>")
    own = retrieval.latest(papers)
    assert corpus.stats(own, chunks, None).first()["papers"] == 0
    for df in (corpus.authors(own), corpus.institutions(own, geo_), corpus.countries(own, geo_), corpus.timeline(own), corpus.paper(own, chunks), points.metric_stats(bench), retrieval.keyword_search(chunks, q), retrieval.search(chunks, own, v, q), ingest.first_chunks(chunks), ingest.candidate_segments(chunks, own)):
        assert df.count() == 0


def test_gold_of_topics_is_the_gold_of_its_pairs(spark):
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "none"), (4, "a"), (5, "b"), (5, "a")], "query_id long, topic string")
    right = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("a", "f2"), ("b", "f3"), ("b", None), ("c", "f4")], "topic string, file string")
    ranked = spark.createDataFrame([(q, f"f{i}", i, mode) for q in range(1, 7) for i in range(1, 5) for mode in "xy" if (q + i) % 3 or mode == "x"], "query_id long, file string, rank int, mode string")
    gold, by = evaluate.Gold(asked, right), ("query_id", "mode")
    found = lambda g: sorted(map(repr, evaluate.measures(ranked, g, k=3, by=by).collect()))
    assert len(found(gold)) == 8 and found(gold) == found(gold.pairs())
