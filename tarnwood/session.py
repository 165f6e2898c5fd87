"""What a Spark session needs before a query with Python stages runs."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application.

    The archive is only read by the driver, whose file server hands it to the executors.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tarnwood_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tarnwood"), "tarnwood.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tarnwood", os.path.relpath(full, PACKAGE)))
    sc.addPyFile(path)
    sc._tarnwood_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: the one the cluster names.

    Only a local session may do without: its executors share the machine.  On a cluster a folder of
    one machine would lose the tables with it, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tarnwood-checkpoint"))
    return sc.getCheckpointDir()


def cut(df, spark: SparkSession):
    """``df`` written to the shared checkpoint folder: read often, computed once, and it
    survives the loss of executors."""
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def kept(spark: SparkSession, name: str, source, build):
    """The table ``build()`` makes from ``source``, written below the checkpoint folder of this application the
    first time it is asked for and read from there afterwards, until a file of ``source`` changes.  A source
    that does not lie in files is not kept."""
    files = source.inputFiles()
    if not files:
        return build()
    from tarnwood.sources.tables import changed

    stamp = hashlib.md5(repr(([(f, *changed(spark, f)) for f in sorted(files)], source.columns)).encode()).hexdigest()
    path = f"{checkpoint_dir(spark)}/{name}-{stamp}"
    made = build()
    if not changed(spark, f"{path}/_SUCCESS"):
        made.write.mode("overwrite").parquet(path)
    return spark.read.schema(made.schema).parquet(path)
