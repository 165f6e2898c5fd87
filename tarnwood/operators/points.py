"""Measured points by family-specific unit tables, with duplicates and medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Factors to the shown unit, by metric family and folded unit.
FACTORS = {
    "thrust_density": {"n/cm2": 1.0, "kn/m2": 0.1, "kpa": 0.1, "mpa": 100.0, "mn/cm2": 1e-3, "n/m2": 1e-4, "pa": 1e-4},
    "pressure": {"kpa": 1.0, "pa": 1e-3, "mpa": 1e3, "n/cm2": 10.0, "kn/m2": 1.0, "n/m2": 1e-3, "mn/cm2": 1e-2},
    "force": {"n": 1.0, "mn": 1e-3, "kn": 1e3, "μn": 1e-6, "un": 1e-6, "gf": 9.80665e-3, "g": 9.80665e-3, "kgf": 9.80665, "kg": 9.80665},
    "speed": {"mm/s": 1.0, "mm/sec": 1.0, "m/s": 1e3, "cm/s": 10.0, "μm/s": 1e-3, "um/s": 1e-3, "m/min": 1000 / 60},
    "efficiency": {"%": 1.0, "percent": 1.0, "": 1.0},
}
FAMILY = {"thrust_density": "thrust_density", "shear_stress": "pressure", "normal_pressure": "pressure", "thrust": "force", "holding_force": "force", "speed": "speed", "efficiency": "efficiency"}
#: Metrics that are shown.
SHOWN = ("thrust_density", "thrust", "speed", "efficiency")


def unit_table(spark) -> DataFrame:
    """(metric, unit_key, factor): the fixed table as a dimension."""
    rows = [(m, u, f) for m, fam in FAMILY.items() for u, f in FACTORS[fam].items()]
    return spark.createDataFrame(rows, "metric string, unit_key string, factor double")


def unit_key(unit):
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return F.replace(F.translate(u, " ^", ""), F.lit("²"), F.lit("2"))


def converted(points: DataFrame) -> DataFrame:
    """``points`` of known metrics with ``v``, the value in the metric's unit, null where dropped
    (unknown unit, value not above 0, an efficiency above 100)."""
    p = points.withColumn("unit_key", unit_key(F.col("unit"))).join(F.broadcast(unit_table(points.sparkSession)), ["metric", "unit_key"], "left")
    v = F.col("value") * F.col("factor")
    return p.withColumn("v", F.when((v > 0) & ~((F.col("metric") == "efficiency") & (v > 100)), v))


def deduplicated(points: DataFrame) -> DataFrame:
    """Usable points of the shown metrics, one of equal ones (the first by id)."""
    ok = converted(points).where(F.col("metric").isin(*SHOWN) & F.col("v").isNotNull())
    w = Window.partitionBy("file", "metric", F.round("v", 6), "voltage_kv", "gap_um").orderBy("id")
    return ok.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def listed(points: DataFrame, papers: DataFrame) -> DataFrame:
    """The points that are shown, largest first in each metric: place, converted and printed value, conditions and paper."""
    d = deduplicated(points).join(papers.select("file", "title", "year"), "file").withColumn("shown", F.round("v", 4))
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("shown"), "id"))
    return d.select("metric", place.alias("place"), "id", "shown", F.col("value").alias("printed"), "unit", "voltage_kv", "gap_um", "medium", "file", "title", "year")


def metric_stats(points: DataFrame) -> DataFrame:
    """(metric, n, lowest, highest, median): the upper median, over values of four decimals."""
    v = F.round("v", 4)
    d = deduplicated(points).withColumn("v4", v)
    return d.groupBy("metric").agg(F.count("*").alias("n"), F.min("v4").alias("lowest"), F.max("v4").alias("highest"), F.expr("percentile_disc(0.5) within group (order by v4 desc)").alias("median"))


def counters(points: DataFrame) -> DataFrame:
    """One row: points, dropped (of the shown metrics) and removed as duplicates."""
    c = converted(points).where(F.col("metric").isin(*SHOWN))
    kept = deduplicated(points).agg(F.count("*").alias("points"))
    return c.agg(F.count_if(F.col("v").isNull()).alias("dropped"), F.count("v").alias("usable")).crossJoin(kept).select("points", "dropped", (F.col("usable") - F.col("points")).alias("deduped"))
