"""Mixing sources to target weights with hash-threshold histograms.

Each document has a size (tokens of a public vocabulary) and a hash of its key.  A source's
budget is met by taking every document a number of whole times and the documents whose hash
lies under a threshold once more.  The threshold is found without sorting: sizes are summed by
(source, top bits of the hash), cumulated over the at most 2^BITS buckets, and only the bucket
the budget ends in is refined by the next bits, until it holds one document.  One hash serves
all mixes, so a larger budget contains a smaller one.

The total of a mix is the largest at which every source with documents can reach its share
within its allowed repeats; the source that sets it is reported as ``binding``, with what each
source has left.  With a given total (a number of tokens, or ``available`` for as many as the
sources hold) a source that cannot reach its share gives all its repeats and the others fill its
part in proportion to their shares, until all are used up; the report shows what was reached.

Defined results: documents without a source or without tokens take no part; so do sources
outside the mix; a source of weight 0, null weight or without documents has a budget of 0 and
is reported; repeated documents are documents of their own; a source listed twice in a mix has
its weights added and its smallest repeats; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwood.session import cut

BITS = 12
#: Targets (rows of mix and source) up to which they are broadcast; more are joined.
MOST_TARGETS = 100_000


def budgets(sizes: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """(mix_id, source, weight, max_repeats, available, docs, share, budget, binding), one row per target."""
    listed = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("docs"))
    t = listed.join(have, "source", "left").na.fill(0, ["available", "docs"])
    mix = Window.partitionBy("mix_id")
    usable = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("weight")).otherwise(0.0)
    t = t.withColumn("share", F.coalesce(usable / F.nullif(F.sum(usable).over(mix), F.lit(0.0)), F.lit(0.0)))
    t = t.withColumn("most", (F.col("available") * F.col("max_repeats")).cast("double")).withColumn("reach", F.when(F.col("share") > 0, F.col("most") / F.col("share")))
    if total is None:
        level = F.min("reach").over(mix)
    else:
        # sources in the order in which a rising level uses them up; with the first of them used up the others carry
        # the rest, and the level is the highest of those that any such beginning asks for
        wanted = F.sum(F.when(F.col("share") > 0, F.col("available"))).over(mix).cast("double") if total == "available" else F.lit(float(total))
        before = Window.partitionBy("mix_id").orderBy(F.asc_nulls_last("reach"), "source").rowsBetween(Window.unboundedPreceding, -1)
        used, given = F.coalesce(F.sum(F.when(F.col("share") > 0, F.col("most"))).over(before), F.lit(0.0)), F.coalesce(F.sum("share").over(before), F.lit(0.0))
        t = t.withColumn("asked", F.when(F.col("share") > 0, (wanted - used) / F.greatest(1 - given, "share")))
        level = F.max("asked").over(mix)
    t = t.withColumn("level", F.coalesce(level, F.lit(0.0)))
    binding = F.coalesce((F.col("share") > 0) & (F.col("reach") <= F.col("level") * (1 + 1e-12)), F.lit(False))
    return t.withColumn("budget", F.least(F.col("share") * F.col("level"), "most")).withColumn("binding", binding).drop("most", "reach", "level", "asked")


def thresholds(sizes: DataFrame, budget: DataFrame) -> DataFrame:
    """``budget`` with ``times`` (whole copies) and ``below`` (hash under which once more), as
    an unsigned 60-bit number."""
    spark = sizes.sparkSession
    b = budget.withColumn("times", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available") + F.lit(1e-12))).otherwise(0).cast("long"))
    b = b.withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("times") * F.col("available")))
    b = cut(b.withColumn("below", F.lit(0).cast("long")).withColumn("open", F.col("rest") >= 1), spark)
    held = _held(b)
    small = sizes.select("source", "h", "tokens")
    for level in range(60 // BITS):
        shift = 60 - BITS * (level + 1)
        want = b.where("open").select("mix_id", "source", "rest", F.col("below").alias("base"))
        # documents of the boundary buckets only: at the first level these are the sources in use
        boundary = held(want.select("source", "base").distinct())
        inside = small.join(boundary, "source") if level == 0 else small.join(boundary.withColumn("k", F.shiftright("base", shift + BITS)), (small.source == boundary.source) & (F.shiftright(small.h, shift + BITS) == F.shiftright(boundary["base"], shift + BITS))).drop(boundary.source)
        bucket = F.shiftright("h", shift)
        hist = inside.groupBy("source", "base", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        order = Window.partitionBy("source", "base").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("tokens").over(order))
        hit = want.join(hist, ["source", "base"]).withColumn("before", F.col("upto") - F.col("tokens")).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        # one document left, or no bits: it is taken if that comes nearer to the budget
        last = (F.col("n") == 1) | F.lit(shift == 0)
        nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("before")
        edge = F.when(last & nearer, F.shiftleft(F.col("bucket") + 1, shift)).otherwise(F.shiftleft("bucket", shift))
        hit = hit.select("mix_id", "source", edge.alias("edge"), (F.col("rest") - F.col("before")).alias("left"), (~last).alias("more"))
        b = b.join(hit, ["mix_id", "source"], "left").withColumn("below", F.coalesce("edge", "below")).withColumn("rest", F.coalesce("left", "rest")).withColumn("open", F.col("open") & F.coalesce("more", F.lit(False))).drop("edge", "left", "more")
        b = cut(b, spark)
        if not b.where("open").limit(1).count():
            break
    return b


def _held(targets: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``F.broadcast`` for tables of no more rows than the targets have, if these are few."""
    return F.broadcast if targets.count() <= MOST_TARGETS else lambda df: df


def mix(docs: DataFrame, targets: DataFrame, key: str, source: str, tokens: str, total: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    """((mix_id, key, source, tokens, copies), report): documents with their number of copies, and
    (mix_id, source, weight, max_repeats, target_share, actual_share, tokens, docs_used, most_copies, available, binding, unused).

    ``unused`` are the tokens that the allowed repeats of a source still hold."""
    spark = docs.sparkSession
    sizes = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(tokens).alias("tokens")).where("source is not null and tokens > 0")
    sizes = cut(sizes.withColumn("h", F.shiftrightunsigned(F.xxhash64("key"), 4)), spark)
    plan = thresholds(sizes, budgets(sizes, targets, total))
    used = _held(plan)(plan.where("times > 0 or below > 0").select("mix_id", "source", "times", "below"))
    copies = F.col("times") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    chosen = sizes.join(used, "source").withColumn("copies", copies.cast("int")).where("copies > 0")
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"))
    report = plan.select("mix_id", "source", "weight", "max_repeats", F.col("share").alias("target_share"), "available", "binding").join(got, ["mix_id", "source"], "left").na.fill(0, ["tokens", "docs_used", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    report = report.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)))
    report = report.withColumn("unused", F.greatest(F.lit(0).cast("long"), F.col("available") * F.col("max_repeats") - F.col("tokens")))
    return chosen.select("mix_id", F.col("key").alias(key), "source", "tokens", "copies"), report
