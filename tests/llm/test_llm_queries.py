"""Queries of the subpackage on the smallest data: SQL where there is some, held-out checks elsewhere."""

import pytest

from tarnwood.llm import queries, reading
from tarnwood.sources.tables import table
from tests.oracle import same

COLUMNS = {
    "p1_found": ["rowid", "line_no", "kind"], "p4_found": ["rowid", "line_no"], "p5_found": ["rowid"], "p6_found": ["kind", "name_a", "name_b"], "p7_found": ["file", "ref_code"],
    "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "level"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    if name in queries.SQL:
        same(spark, queries.QUERIES[name], queries.SQL[name], data)
    df = queries.QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()


def test_every_document_is_encoded(spark, data):
    assert queries.p8_ids(spark, data).count() == table(spark, data, "documents").count()


def test_levels_held_out(spark, data):
    """Fitted on half of the rated texts of a larger set, judged on the other half."""
    larger = data.replace("sf0.001", "sf0.1")
    rated = table(spark, larger, "documents").join(table(spark, larger, "level_labels"), "doc_id").select("doc_id", "text", "level").toPandas().sort_values("doc_id")
    fit, held = rated.iloc[::2], rated.iloc[1::2]
    scale = reading.fit(fit["text"].tolist(), fit["level"].tolist())
    got = reading.read_levels(spark.createDataFrame(held), "text", scale).select("level", "reading.level").toPandas()
    assert (got.iloc[:, 0] == got.iloc[:, 1]).mean() > 0.95


def test_pieces_give_back_the_text(spark, data):
    text = {r["rowid"]: r["text"] for r in table(spark, data, "chunks").select("rowid", "text").collect()}
    end: dict = {}
    for r in queries.p5_pieces(spark, data).orderBy("rowid", "piece_no").collect():
        assert text[r["rowid"]][r["start_at"] :].startswith(r["piece"]) and r["start_at"] <= end.get(r["rowid"], 0)
        end[r["rowid"]] = r["start_at"] + len(r["piece"])
    assert all(len(text[k]) == n for k, n in end.items())
