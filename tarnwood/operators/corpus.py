"""Corpus statistics: histograms, timelines, authors, institutions, countries, most cited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwood.functions import text as tx

SCOPE = "film_motor"


def scoped(papers: DataFrame, category: str | None = SCOPE) -> DataFrame:
    """Papers of the domain; a category other than the domain's gives an empty result."""
    if category not in (None, SCOPE):
        return papers.limit(0)
    return papers.where(F.col("category") == SCOPE)


def domain(slug: str | None) -> str:
    """The category of a request's domain word; an unknown word is an error."""
    if slug in (None, "fm", "all"):
        return SCOPE
    raise ValueError(f"unknown domain: {slug!r}")


def stats(papers: DataFrame, chunks: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """One row: papers, chunks and vectors in scope, first and last year, and the mode of search."""
    own = scoped(papers)
    inside = chunks.select("rowid", "file").join(own.select("file"), "file", "left_semi")
    a = own.agg(F.count("*").alias("papers"), F.min(F.when(F.col("year") > 1900, F.col("year"))).alias("year_min"), F.max(F.when(F.col("year") > 1900, F.col("year"))).alias("year_max"))
    b = inside.agg(F.count("*").alias("chunks"))
    if vectors is None:
        return a.crossJoin(b).withColumns({"vectors": F.lit(0).cast("long"), "mode": F.lit("keyword-only")})
    c = inside.join(vectors.select("rowid"), "rowid", "left_semi").agg(F.count("*").alias("vectors"))
    return a.crossJoin(b).crossJoin(c).withColumn("mode", F.when(F.col("vectors") > 0, "hybrid").otherwise("keyword-only"))


def tier_histogram(papers: DataFrame, unnamed: str = "unclassified") -> DataFrame:
    """(tier, n); null and empty tiers are counted apart and then both labelled ``unnamed``."""
    return scoped(papers).groupBy("tier").agg(F.count("*").alias("n")).select(F.coalesce(F.nullif("tier", F.lit("")), F.lit(unnamed)).alias("tier"), "n")


def category_rollup(papers: DataFrame, chunks: DataFrame, categories: list[str]) -> DataFrame:
    """(category, papers, cross_papers, chunks), a row for each named category, even if empty."""
    named = papers.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    per_file = chunks.groupBy("file").agg(F.count("*").alias("c"))
    counts = papers.join(per_file, "file", "left").groupBy("category").agg(
        F.count("*").alias("papers"), F.sum(F.coalesce("cross_topic", F.lit(0))).alias("cross_papers"), F.sum(F.coalesce("c", F.lit(0))).alias("chunks"))
    return named.join(counts, "category", "left").na.fill(0, ["papers", "cross_papers", "chunks"])


def timeline(papers: DataFrame) -> DataFrame:
    """(year, total, in_scope) of plausible years."""
    ok = papers.where((F.col("year") > 1900) & (F.col("year") < 2100))
    return ok.groupBy("year").agg(F.count("*").alias("total"), F.count_if(F.col("category") == SCOPE).alias("in_scope"))


def authors(papers: DataFrame, order: str = "file") -> DataFrame:
    """(key, name, papers, cited, first_author, span, category) of every author mention by key.

    The longest spelling is shown, the first seen of equals; the most frequent category, the first
    seen of equals.  Piece 0 counts as first author even where it is no name."""
    rows = papers.select(order, "year", F.coalesce("cited", F.lit(0)).alias("cited"), "category", F.posexplode(tx.author_pieces(F.col("authors"))).alias("i", "piece"))
    rows = rows.withColumn("a", tx.author_name(F.col("piece"))).where("a is not null").select("*", "a.key", "a.name", F.struct(order, "i").alias("seq"))
    category = rows.where("category is not null and category <> ''").groupBy("key", "category").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), F.asc("first"))
    category = category.withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "category")
    # the longest name, and of the longest the first seen
    longest = rows.groupBy("key", "name").agg(F.min("seq").alias("first")).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.length("name")), F.asc("first")))).where("r = 1").select("key", "name")
    base = rows.groupBy("key").agg(
        F.count("*").alias("papers"), F.sum("cited").alias("cited"), F.count_if(F.col("i") == 0).alias("first_author"),
        F.concat(F.min("year").cast("string"), F.lit("–"), F.max("year").cast("string")).alias("span"),
    )
    return base.join(longest, "key").join(category, "key", "left").select("key", "name", "papers", "cited", "first_author", "span", "category")


def institutions(papers: DataFrame, geo: DataFrame) -> DataFrame:
    """(key, name, iso3, papers, cited) of papers with an institution; name and country as first seen."""
    rows = geo.select("file", tx.institution_name(F.col("institution")).alias("name"), "iso3").where("name is not null").join(papers.select("file", F.coalesce("cited", F.lit(0)).alias("cited")), "file")
    return rows.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "file").alias("name"), F.min_by("iso3", "file").alias("iso3"), F.count("*").alias("papers"), F.sum("cited").alias("cited"))


def countries(papers: DataFrame, geo: DataFrame) -> DataFrame:
    """(iso3, country, papers, cited); merged regions carry the name of the country they join."""
    rows = geo.select("file", "country", F.upper(F.trim("iso3")).alias("raw"), tx.country_code(F.col("iso3")).alias("code")).where("code is not null").join(papers.select("file", F.coalesce("cited", F.lit(0)).alias("cited")), "file")
    merged = F.col("raw").isin(*tx.MERGED)
    label = F.when(merged, F.lit("China")).otherwise(F.coalesce("country", "code"))
    return rows.withColumn("label", label).groupBy(F.col("code").alias("iso3")).agg(F.min_by("label", "file").alias("country"), F.count("*").alias("papers"), F.sum("cited").alias("cited"))


def like(papers: DataFrame, words: str, n: int = 20) -> DataFrame:
    """The ``n`` most cited papers whose title or authors hold ``words`` in any case, with their rank."""
    found = papers.where(F.col("title").ilike(f"%{words}%") | F.col("authors").ilike(f"%{words}%"))
    return best(found, n, F.desc_nulls_last("cited"), "file")


def best(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows by ``order``, with their rank (a report, so the limit is its feature)."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def overview_totals(papers: DataFrame, geo: DataFrame) -> DataFrame:
    """One row: citations, papers with a country, and how many authors, institutions and countries there are."""
    own = scoped(papers)
    return (
        own.agg(F.count("*").alias("papers"), F.sum(F.coalesce("cited", F.lit(0))).alias("cited"))
        .crossJoin(geo.join(own.select("file"), "file", "left_semi").agg(F.count_if(F.coalesce("iso3", F.lit("")) != "").alias("geo_coverage")))
        .crossJoin(authors(own).agg(F.count("*").alias("authors")))
        .crossJoin(institutions(own, geo).agg(F.count("*").alias("institutions")))
        .crossJoin(countries(own, geo).agg(F.count("*").alias("countries")))
    )


def paper(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, title, place, rowid, page): the segments of each paper in scope in page order; a paper without any has one row without place.

    Each segment stays a row, so a file of any number of segments is sorted, never gathered."""
    order = Window.partitionBy("file").orderBy(F.asc_nulls_first(tx.page_order(F.col("page"))), "rowid")
    segments = chunks.select("file", F.row_number().over(order).alias("place"), "rowid", "page")
    return scoped(papers).select("file", "title").join(segments, "file", "left")
