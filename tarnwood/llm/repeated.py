"""Lines repeated across one source's documents: heavy hitters, exact counts, removal.

First pass: one mergeable heavy-hitter summary (frequent-items sketch) per source over the
64-bit hashes of its folded lines, built by partial aggregation, so a source with a third of
all rows is summarised where its rows lie and only summaries are shuffled.  A summary of
``m`` counters keeps every line above 3.5/m of all lines; with L lines per file an excessive
line is above share/L, so ``m = 64 L`` (L measured, not assumed) loses none.  Sources whose
files have so many lines that this exceeds the largest summary skip it: all their lines are
candidates.
Second pass: candidate occurrences alone are counted exactly as distinct files of the source.
Third: the confirmed lines, a set bounded by lines-per-file / share per source, mark or remove
the occurrences.

Defined results: null and empty texts have no lines and come out unchanged; documents without
a source take no part; several occurrences in one file count once, each is reported; lines
shorter than ``shortest`` after folding never count; repeated rows are each cleaned; an empty
table gives empty results; extra columns pass through :func:`remove_lines` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwood.session import cut

#: Largest side that is broadcast, in rows of two or three longs; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Counters of the largest summary (Spark allows 1,000,000), and counters per line of a file.
MOST_COUNTERS, PER_LINE = 1 << 19, 64


def folded(line: Column) -> Column:
    """Lower case, trimmed, each run of white space one blank, each run of digits one ``0``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), r"(?U)\s+", " "))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its row count, measured here, is within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _lines(docs: DataFrame, text: str, file: str, shortest: int, *keep: str) -> DataFrame:
    """(keep…, f, line_no, line): hashes of the folded lines that are long enough."""
    raw = docs.select(*keep, F.xxhash64(file).alias("f"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "raw"))
    # folding can only lengthen a character in case mapping, so half the length is a safe filter
    raw = raw.where(F.length("raw") * 2 >= shortest).withColumn("folded", folded(F.col("raw")))
    return raw.where(F.length("folded") >= shortest).select(*keep, "f", (F.col("i") + 1).cast("int").alias("line_no"), F.xxhash64("folded").alias("line"))


def excessive_occurrences(docs: DataFrame, sources: DataFrame, key: str, text: str, file: str, least_files: int = 3, share: float = 0.25, shortest: int = 20) -> DataFrame:
    """(key, line_no, s, line, files, of_files) of each occurrence of an excessive line.

    ``sources`` is (file, source); ``s`` and ``line`` are hashes of the source and the folded line.
    """
    spark = docs.sparkSession
    of = sources.where("source is not null").select(F.xxhash64("file").alias("f"), F.xxhash64("source").alias("s")).distinct()
    of = _small(cut(of, spark))
    # lines and files per source: the sizes of the summaries
    per_file = docs.select(F.xxhash64(file).alias("f"), F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n")).groupBy("f").agg(F.sum("n").alias("n"))
    per_source = cut(per_file.join(of, "f").groupBy("s").agg(F.count("*").alias("of_files"), F.sum("n").alias("lines")), spark)
    per_source = per_source.withColumn("least", F.greatest(F.lit(least_files), F.ceil(F.col("of_files") * F.lit(str(share)).cast("decimal(9,6)")))).where("of_files >= least")
    fits = F.col("lines") / F.col("of_files") * PER_LINE <= MOST_COUNTERS
    most = per_source.where(fits).agg(F.max(F.col("lines") / F.col("of_files"))).first()[0] or 1
    counters = min(MOST_COUNTERS, max(1024, 1 << int(most * PER_LINE).bit_length()))
    totals = _small(per_source.select("s", "of_files", "least"))
    lines = _lines(docs, text, file, shortest, key).join(of, "f")

    heavy = lines.join(_small(per_source.where(fits).select("s")), "s").groupBy("s").agg(F.expr(f"approx_top_k(line, {counters}, {counters})").alias("top"))
    heavy = heavy.select("s", F.explode("top").alias("t")).select("s", F.col("t.item").alias("line"), F.col("t.count").alias("n"))
    heavy = cut(heavy.join(totals, "s").where(F.col("n") >= F.col("least")).select("s", "line"), spark)
    found = lines.join(_small(heavy), ["s", "line"])
    if per_source.where(~fits).limit(1).count():
        found = found.unionByName(lines.join(_small(per_source.where(~fits).select("s")), "s").select(*found.columns))
    found = cut(found, spark)

    files = found.select("s", "line", "f").distinct().groupBy("s", "line").agg(F.count("*").alias("files"))
    confirmed = files.join(totals, "s").where(F.col("files") >= F.col("least")).select("s", "line", "files", "of_files")
    return found.join(_small(confirmed), ["s", "line"]).select(key, "line_no", "s", "line", "files", "of_files")


def remove_lines(docs: DataFrame, occurrences: DataFrame, key: str, text: str, out: str = "clean") -> DataFrame:
    """``docs`` with ``out``: the text without its excessive lines.

    Occurrences are few beside the documents; they are gathered per document (bounded by its
    own lines) and joined on the key.  Documents without any keep their text as it is.
    """
    bad = occurrences.groupBy(F.col(key).alias("__key")).agg(F.collect_set("line_no").alias("__bad"))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains("__bad", i + 1))
    joined = docs.join(_small(bad), F.col(key) == F.col("__key"), "left")
    return joined.withColumn(out, F.when(F.col("__bad").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__key", "__bad")


def report(docs: DataFrame, occurrences: DataFrame, key: str, text: str) -> DataFrame:
    """(s, line, example, files, of_files, occurrences): each excessive line once, with one printing of it."""
    first = occurrences.groupBy("s", "line", "files", "of_files").agg(F.count("*").alias("occurrences"), F.min(F.struct(key, "line_no")).alias("at"))
    at = first.select("s", "line", "files", "of_files", "occurrences", F.col(f"at.{key}").alias(key), F.col("at.line_no").alias("n"))
    return docs.join(_small(at), key).select("s", "line", F.element_at(F.split(F.col(text), "\n", -1), F.col("n")).alias("example"), "files", "of_files", "occurrences")
