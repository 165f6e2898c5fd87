"""Parquet sources: every table of a data directory is one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_SCHEMAS: dict[tuple, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir`` (one Parquet file or folder).

    Its schema is read from the files once, until they change, so a plan over many tables does not begin with a job for each."""
    path = f"{sf_dir}/{name}.parquet"
    known = (path, *changed(spark, path))
    if known not in _SCHEMAS:
        _SCHEMAS[known] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[known]).parquet(path)


def changed(spark: SparkSession, path: str) -> tuple:
    """Length and time of change of a file or folder; nothing where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(p):
        return ()
    status = files.getFileStatus(p)
    return status.getLen(), status.getModificationTime()


def with_columns(df: DataFrame, **defaults) -> DataFrame:
    """Schema evolution: add each named column that is missing, keep those present.

    A value is a Column, so the caller states type and default together.
    """
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def table_or_none(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """Capability probe: the table, or None where it does not exist."""
    from pyspark.errors import AnalysisException

    try:
        return table(spark, sf_dir, name)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where it comes in fewer splits than there are (a small table in one
    file); a table of many splits is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
