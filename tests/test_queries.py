"""Every query of the core against its SQL on the smallest data; those without SQL must run."""

import pytest

from tarnwood.plans import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, name):
    if name in registry.SQL:
        same(spark, registry.QUERIES[name], registry.SQL[name], data)
    else:
        assert registry.QUERIES[name](spark, data).count() >= 0


def test_entry_without_llm(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) tarnwood\.llm", f.read_text(), re.M), f
