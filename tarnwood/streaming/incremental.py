"""Incremental runs as streams that stop when the input is read: new files, late rows, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_new(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what has arrived since the last run and stop; ``write`` gets each batch and its number,
    and must give the same result if a batch comes again."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def newest_parts(spark: SparkSession, target: str) -> tuple[int, dict[int, str]]:
    """(newest finished version, path of each bucket's newest part) below ``target``; version -1 where there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    list_ = lambda path, sign: {int(st.getPath().getName()[2:]): st.getPath() for st in files.listStatus(path) if st.getPath().getName().startswith(sign)}
    newest, parts = -1, {}
    for v, path in sorted(list_(root, "v=").items() if files.exists(root) else ()):
        newest = v
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            parts |= {b: p.toString() for b, p in list_(path, "b=").items()}
    return newest, parts


def upserted(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The table kept by :func:`upsert_batches`."""
    parts = newest_parts(spark, target)[1]
    return spark.read.schema(schema).parquet(*parts.values()) if parts else spark.createDataFrame([], schema)


def upsert_batches(target: str, key: str, order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the last row by key below ``target``.

    Rows lie in buckets by the hash of their key; a batch reads and writes the buckets it touches, as a new version,
    and the others stay.  A version that was not finished is not read, and a batch that comes again, or a
    new checkpoint, goes on from the newest one with equal results."""
    from tarnwood.operators.ingest import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
        newest, parts = newest_parts(spark, target)
        paths = [parts[b] for b in touched if b in parts]
        old = spark.read.schema(batch.schema).parquet(*paths) if paths else batch.limit(0)
        upsert(old, batch, key, order).withColumn("b", bucket).write.partitionBy("b").parquet(f"{target}/v={newest + 1}")

    return write


def counts_by_window(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n): events by tumbling window; on a stream, rows later than ``late`` are left out."""
    t = events.withColumn(time, F.col(time).cast("timestamp"))
    t = t.withWatermark(time, late) if events.isStreaming else t
    return t.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
