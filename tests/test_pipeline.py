from pyspark.sql import functions as F

from tarnwood.operators import pipeline as pl


def test_files_to_chunks(spark, tmp_path):
    for folder, name, content in (("b", "x.pdf", b"old"), ("a", "x.pdf", b"one|" + b"y" * 300), ("a", "y.pdf", b" | "), ("a", "z.pdf", b"!bad"), ("a", "n.txt", b"no")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(content)

    def reader(content):
        if content.startswith(b"!"):
            raise ValueError("broken file")
        return content.decode().split("|")

    pages = pl.extract_pages(pl.binary_files(spark, str(tmp_path)), reader)
    assert {r["state"]: r["files"] for r in pl.ingest_report(pages).collect()} == {"read": 1, "empty": 1, "broken": 1}
    assert [tuple(r) for r in pl.chunk_rows(pages).collect()] == [("x.pdf", "2", 1, "y" * 300)]


def test_build_vectors(spark):
    chunks = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "bad", None), (4, None, None)], "rowid long, text string, title string")

    def embed(texts):
        if "bad" in texts:
            raise OSError
        return [[float(len(t)), 1.0] for t in texts]

    empty = spark.createDataFrame([], "rowid long, digest string, vector array<float>")
    first = pl.build_vectors(chunks, empty, embed, 2, size=1, tries=2, wait=lambda s: None)
    got = {r["rowid"]: list(r["vector"]) for r in first.collect()}
    assert got == {1: [1.0, 1.0], 2: [1.0, 1.0], 3: [0.0, 0.0], 4: [0.0, 1.0]}
    again = pl.build_vectors(chunks.withColumn("text", F.when(F.col("rowid") == 2, "longer").otherwise(F.col("text"))), first, lambda ts: [[9.0, 9.0] for _ in ts], 2)
    assert {r["rowid"]: r["vector"][0] for r in again.collect()} == {1: 1.0, 2: 9.0, 3: 9.0, 4: 0.0}


def test_build_vectors_in_parts(spark):
    chunks = spark.createDataFrame([(i, "t" * i, None) for i in range(1, 7)], "rowid long, text string, title string")
    empty = spark.createDataFrame([], "rowid long, digest string, vector array<float>")
    turned = lambda ts: [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(ts)))]
    part = pl.build_vectors(chunks, empty, turned, 2, most=2)
    assert {r["rowid"]: list(r["vector"]) for r in part.collect()} == {1: [1, 1], 2: [2, 1]} | {i: [0, 0] for i in range(3, 7)}
    assert {r["rowid"]: r["vector"][0] for r in pl.build_vectors(chunks, part, lambda ts: [[9.0, 9.0]] * len(ts), 2).collect()} == {1: 1, 2: 2, 3: 9, 4: 9, 5: 9, 6: 9}
    assert {r["vector"][0] for r in pl.build_vectors(chunks, part, lambda ts: [[9.0, 9.0]] * len(ts), 2, restart=True).collect()} == {9}
    waits = []
    assert pl.patiently(lambda: 1 / 0, 7, waits.append) is None and waits == [1, 2, 4, 8, 16, 30]


def test_search_behind_the_breaker(spark):
    chunks = spark.createDataFrame([(1, "f", "1", "film motor thrust", "t"), (2, "f", "2", "other words", "t"), (3, "g", "1", "gripper", "u")], "rowid long, file string, page string, text string, title string")
    papers = spark.createDataFrame([("f", "film_motor", "①", 2000, "t"), ("g", "film_motor", "①", 2001, "u")], "file string, category string, tier string, year int, title string")
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 1.0])], "rowid long, vector array<float>")
    q = spark.createDataFrame([(7, "film thrust")], "query_id long, query string")

    def down(texts):
        raise OSError

    b = pl.Breaker(2)
    run = lambda e: {(r["rowid"], r["kw_rank"], r["vec_rank"]) for r in pl.guarded_search(chunks, papers, vectors, q, e, b).collect()}
    assert run(lambda ts: [[1.0, 0.5]] * len(ts)) == {(1, 1, None), (2, None, 1), (3, None, 2)} and not b.open
    assert run(down) == run(down) == {(1, 1, None)} and b.open
    assert run(lambda ts: [[1.0, 0.5]] * len(ts)) == {(1, 1, None)}


def test_breaker():
    def fail():
        raise OSError

    b = pl.Breaker(2)
    assert b.call(fail) is None and b.call(lambda: 5) == 5 and b.failures == 0
    b.call(fail), b.call(fail)
    assert b.open and b.call(lambda: 5) is None


def test_messages_and_citations(spark):
    df = spark.createDataFrame([("q", None, "w ")], "q string, c string, w string")
    m = df.select(pl.messages(F.col("q"), F.col("c"), F.lit(0)).alias("m"), pl.expanded(F.col("q"), F.col("w")).alias("e"), pl.expanded(F.col("q"), F.col("c")).alias("n")).first()
    assert [x["role"] for x in m["m"]] == ["system", "user"] and m["m"][1]["content"].endswith("Question: q") and m["e"] == "q w" and m["n"] == "q"
    answers = spark.createDataFrame([(1, "a [2] b [1][2] c [99] d [3]"), (2, None)], "query_id long, answer string")
    hits = spark.createDataFrame([(1, 1, "f"), (1, 2, "g"), (1, 3, "g")], "query_id long, n int, file string")
    assert sorted(tuple(r) for r in pl.cited_hits(answers, hits).collect()) == [(1, "f", 1, 1), (1, "g", 2, 2)]
    none = spark.createDataFrame([(1, "nothing"), (3, None)], "query_id long, answer string")
    assert sorted(tuple(r) for r in pl.cited_hits(none, hits).collect()) == [(1, "f", 1, 1), (1, "g", 2, 2)]


def test_focus_and_regions(spark):
    assert pl.planned_focus(["fm_dual", "made_up", "fm_dual"]) == ["fm_dual"] and len(pl.planned_focus(None)) == 3
    rows = spark.createDataFrame([("cn", 5), ("tw", 1)], "code string, papers int")
    assert sorted(map(tuple, pl.propagated(rows, "code", {"tw": "cn", "hk": "cn", "mo": "xx"}).collect())) == [("cn", 5), ("hk", 5), ("tw", 1)]


def test_small_columns(spark):
    df = spark.createDataFrame([(1.0, "归档版本 only", "Lee; May"), (0.1, None, None)], "v double, s string, a string")
    got = df.select(pl.log_position(F.col("v"), F.lit(0.01), F.lit(1.0)).alias("p"), pl.source_limits(F.col("s")).alias("s"), pl.first_author(F.col("a")).alias("a"), pl.as_json(v=F.col("v")).alias("j")).collect()
    assert [tuple(r) for r in got] == [(100.0, True, "Lee", '{"v":1.0}'), (50.0, False, "", '{"v":0.1}')]


def test_clean_and_sync(spark):
    from tarnwood.plans.reference import MARK

    chunks = spark.createDataFrame([(1, "x" * 300 + MARK), (2, MARK), (3, "plain")], "rowid long, text string")
    v = spark.createDataFrame([(i, [1.0]) for i in (1, 2, 3)], "rowid long, vector array<float>")
    kept, vectors = pl.clean_and_sync(chunks, v)
    assert {r["rowid"]: r["text"] for r in kept.collect()} == {1: "x" * 300, 3: "plain"} and [r["rowid"] for r in vectors.collect()] == [3]
