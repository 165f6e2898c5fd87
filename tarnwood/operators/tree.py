"""Knowledge tree: adjacency rows, traversal, leaves, outline and the choice of focus nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwood.session import cut

# The tree in its order, "id | parent | level | label | query words" a line.
NODES = """
fm_root | | 0 | Electrostatic Film Motor |
fm_fund | fm_root | 1 | Fundamentals |
fm_force | fm_fund | 1 | Electrostatic tangential force | electrostatic tangential force thrust Maxwell stress electrode overlap film actuator
fm_dielectric | fm_fund | 1 | Dielectric & charge relaxation | dielectric constant volume resistivity charge relaxation time constant film material
fm_breakdown | fm_fund | 1 | Breakdown limit | breakdown voltage Paschen law electric field limit air gap insulation electrostatic actuator
fm_electret | fm_fund | 2 | Electret | electret charge retention surface potential corona charging low voltage electrostatic motor
fm_mech | fm_root | 2 | Driving principles |
fm_induction | fm_mech | 2 | Induction type | induction type electrostatic motor traveling wave slip high resistivity slider asynchronous
fm_sync | fm_mech | 2 | Synchronous type | synchronous electrostatic film motor voltage driven stator slider electrode phase
fm_dual | fm_mech | 3 | Dual excitation multiphase | dual excitation multiphase electrostatic drive Niino Higuchi thrust improvement
fm_charge | fm_mech | 3 | Charge induction & variants | charge induction electrostatic motor hybrid excitation variant scheme comparison
fm_dev | fm_root | 2 | Devices & fabrication |
fm_electrode | fm_dev | 2 | Electrode pitch & gap | electrode pitch spacing gap width design thrust optimization electrode pattern film motor
fm_multilayer | fm_dev | 3 | Multi-layer stacking | multi-layer multilayered stacked electrostatic film actuator thrust density
fm_fab | fm_dev | 3 | Flexible substrate & fabrication | fabrication printing photolithography flexible substrate electrode film actuator process
fm_model | fm_root | 3 | Modeling & control |
fm_analytic | fm_model | 3 | Analytical model | analytical model equivalent circuit identification electrostatic motor simulation thrust
fm_sensing | fm_model | 3 | Position self-sensing | position self-sensing sensorless slider detection capacitance charge induction estimation
fm_control | fm_model | 3 | Force control | force control closed loop feedback hysteresis creep compensation electrostatic actuator
fm_app | fm_root | 2 | Applications |
fm_robot | fm_app | 2 | Robotics & artificial muscle | robot actuator artificial muscle soft robotics bio-inspired electrostatic film drive
fm_precision | fm_app | 3 | Precision positioning | precision positioning long stroke planar stage micromanipulation electrostatic actuator
fm_special | fm_app | 3 | Special environments | MRI compatible nonmagnetic vacuum environment electrostatic actuator special application
"""
# Words of a beginner's question, and the factors of the levels for one.
BEGINNER = ("什么是", "入门", "没接触", "从哪", "新手", "初学", "零基础")
PRIOR = {1: 1.35, 2: 1.0, 3: 0.75}


def parsed(text: str = NODES) -> list[tuple[str, str | None, int, int, str, str | None]]:
    """(id, parent, ord, level, label, q) of each line."""
    out = []
    for n, line in enumerate(x for x in text.strip().splitlines() if x.strip()):
        a, parent, level, label, q = [p.strip() or None for p in line.split("|")]
        out.append((a, parent, n, int(level), label, q))
    return out


def nodes(spark: SparkSession, text: str = NODES) -> DataFrame:
    return spark.createDataFrame(parsed(text), "id string, parent string, ord int, level int, label string, q string")


def preorder(tree: DataFrame) -> DataFrame:
    """``tree`` with depth, path and place: every node before its children, in listed order."""
    walked = tree.sparkSession.sql("""
        with recursive w(id, depth, path) as (
            select id, 0, lpad(cast(ord as string), 6, '0') from {tree} where parent is null
            union all
            select t.id, w.depth + 1, concat(w.path, '/', lpad(cast(t.ord as string), 6, '0')) from {tree} t join w on t.parent = w.id)
        select id, depth, path from w""", tree=tree)
    return tree.join(walked, "id").withColumn("place", F.row_number().over(Window.orderBy("path")))


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("parent").alias("id")), "id", "left_anti")


def outline(tree: DataFrame) -> DataFrame:
    """(place, line): groups by their label, leaves indented with id and label."""
    walked = preorder(tree).where("depth > 0")
    return walked.select("place", F.when(F.col("q").isNull(), F.col("label")).otherwise(F.concat(F.lit("  - "), "id", F.lit(": "), "label")).alias("line"))


def find(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (id) that name a node, the root and groups too, with what the node holds; of equal ids the first in order."""
    first = preorder(tree).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where("r = 1").drop("r", "path")
    return ids.join(first, "id")


def domain_of(trees: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(id, domain): the first of the named trees that holds each id, null where none does."""
    held = [t.select("id", F.lit(n).alias("at"), F.lit(d).alias("domain")) for n, (d, t) in enumerate(trees.items())]
    every = reduce(DataFrame.unionByName, held).groupBy("id").agg(F.min_by("domain", "at").alias("domain"))
    return ids.select("id").join(every, "id", "left")


def is_beginner(question: Column) -> Column:
    """Whether a question holds a beginner's word."""
    return F.exists(F.array(*[F.lit(w) for w in BEGINNER]), lambda w: F.contains(F.coalesce(question, F.lit("")), w))


def presented(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, id, number): every node for every question, with its place on the path, null where it stands aside."""
    chosen = cut(chosen, tree.sparkSession)  # read twice
    asked = chosen.select("query_id").distinct().withColumn("id", F.explode(F.array(*[F.lit(r["id"]) for r in tree.select("id").collect()])))
    return asked.join(chosen.select("query_id", "id", F.col("place").alias("number")), ["query_id", "id"], "left")


def focus(question: DataFrame, node_hits: DataFrame, tree: DataFrame, beginner: DataFrame | None = None, position: str = "last", n: int = 3) -> DataFrame:
    """(query_id, id, score, place): the ``n`` leaves whose papers overlap most with the question's.

    ``question`` is (query_id, file, rank) over hits, ``node_hits`` (id, file).  A file weighs 1/(1+i)
    by its last (or first) position i; scores choose the nodes, levels order them.  ``beginner`` are the (query_id)
    of beginners, for whom the first level counts more and the third less."""
    at = F.max("rank") if position == "last" else F.min("rank")
    weight = question.groupBy("query_id", "file").agg((1 / at).alias("w"))
    prior = F.coalesce(*[F.when((F.col("level") == k) & F.col("new"), F.lit(v)) for k, v in PRIOR.items()], F.lit(1.0))
    asked = question.select("query_id").distinct()
    asked = asked.withColumn("new", F.lit(False)) if beginner is None else asked.join(beginner.select("query_id", F.lit(True).alias("new")).distinct(), "query_id", "left").na.fill(False, ["new"])
    overlap = weight.join(node_hits.select("id", "file").distinct(), "file").groupBy("query_id", "id").agg(F.sum("w").alias("s"))
    # few leaves: every question is scored on all of them, those without overlap with 0
    every = asked.withColumn("id", F.explode(F.array(*[F.lit(r[0]) for r in parsed() if r[5]])))
    scored = every.join(overlap, ["query_id", "id"], "left").join(F.broadcast(tree.select("id", "level", "ord")), "id")
    scored = scored.withColumn("score", F.round(F.coalesce("s", F.lit(0.0)) * prior, 9))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))).where(F.col("r") <= n)
    return top.select("query_id", "id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("level", "r")).alias("place"))
