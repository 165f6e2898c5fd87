"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwood.plans import reference, reference_sql, repair, stages

QUERIES = {**reference.QUERIES, **stages.QUERIES, **repair.QUERIES}
SQL: dict[str, str] = {**reference_sql.SQL, **stages.SQL, **repair.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: keyword and vector routes, fused, scoped and cut."""
    return QUERIES["hybrid_search"](spark, sf_dir)
