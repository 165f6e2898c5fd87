"""Queries of the general data-repair operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.operators import packed, units
from tarnwood.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per author in ``papers.authors`` with its place in the list."""
    return packed.unpack(table(spark, sf_dir, "papers"), "authors", ["file"], out="author").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable point of ``benchmark`` in the common unit of its metric, four significant digits."""
    points = units.normalise(table(spark, sf_dir, "benchmark").select("id", "metric", "value", "unit", "note"))

    @F.pandas_udf("string")
    def four_digits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield v.map(lambda x: f"{x:.3e}", na_action="ignore")

    usable = points.select("id", F.col("__common.common").alias("common")).where(F.col("common").isNotNull())
    return usable.select("id", four_digits("common").alias("common_value"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found}
SQL: dict[str, str] = {}
