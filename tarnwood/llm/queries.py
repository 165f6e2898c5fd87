"""Queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.llm import bpe, canonical, mixing, pieces, reading, repeated, scans, variants
from tarnwood.operators import packed
from tarnwood.sources.tables import spread, table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of ``country_ref`` meant by each row of ``paper_geo``, or ``none``."""
    got = canonical.map_to_canonical(table(spark, sf_dir, "paper_geo"), "file", "country", "iso3", table(spark, sf_dir, "country_ref"))
    return got.select(F.col("key").alias("file"), "ref_code").distinct()


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "chunks").select("rowid", "file", "page", "text", "title"), "rowid")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan noise of every line of ``chunks``."""
    return scans.find_noise(_segments(spark, sf_dir), "rowid", "text", "file", "page", "title").distinct()


def p1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment as continuous, readable paragraphs."""
    return scans.repair(_segments(spark, sf_dir), "rowid", "text", "file", "page", "title")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, source): the venue of each paper, trimmed and in lower case."""
    return table(spark, sf_dir, "papers").where("venue is not null").select("file", F.lower(F.trim(F.regexp_replace("venue", r"(?U)^\s+|\s+$", ""))).alias("source")).distinct()


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated.excessive_occurrences(spread(table(spark, sf_dir, "chunks").select("rowid", "file", "text"), "rowid"), _sources(spark, sf_dir), "rowid", "text", "file")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each occurrence in ``chunks`` of a line that its venue prints in very many of its papers."""
    return _occurrences(spark, sf_dir).select("rowid", "line_no").distinct()


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment without the lines of its venue."""
    return repeated.remove_lines(table(spark, sf_dir, "chunks").select("rowid", "text"), _occurrences(spark, sf_dir), "rowid", "text").select("rowid", "clean")


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removed lines, each with one printing of it and its counts."""
    chunks = table(spark, sf_dir, "chunks").select("rowid", "text")
    return repeated.report(chunks, _occurrences(spark, sf_dir), "rowid", "text").select("example", "files", "of_files", "occurrences")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all segments over 1,920 characters."""
    return pieces.split_long(table(spark, sf_dir, "chunks").select("rowid", "text"), "rowid", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that were cut: those with more than 1,920 characters."""
    return p5_pieces(spark, sf_dir).where("piece_no = 1").select("rowid")


def _entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    authors = packed.unpack(table(spark, sf_dir, "papers"), "authors", ["file"], out="author")
    return variants.link_people(authors, "author"), variants.link_organisations(table(spark, sf_dir, "paper_geo"), "institution", "city")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person (``papers.authors``) or one organisation (``paper_geo.institution``)."""
    people, organisations = (variants.linked_pairs(e) for e in _entities(spark, sf_dir))
    return people.select(F.lit("author").alias("kind"), "*").unionByName(organisations.select(F.lit("institution").alias("kind"), "*"))


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every spelling and how many other spellings it is linked to: the result that grows with the
    spellings and not with their pairs."""
    people, organisations = _entities(spark, sf_dir)
    both = people.select(F.lit("author").alias("kind"), "*").unionByName(organisations.select(F.lit("institution").alias("kind"), "*"))
    links = both.groupBy("kind", "entity").agg((F.count("*") - 1).alias("links"))
    return both.join(links, ["kind", "entity"]).select("kind", "spelling", "entity", "links")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document in the vocabulary byte_bpe_50k."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", bpe.token_ids(F.col("text")).alias("ids"))


def _mix(spark: SparkSession, sf_dir: str, total: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id").select("doc_id", "source", bpe.token_count(F.col("text")).alias("tokens"))
    return mixing.mix(docs, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens", total)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix with their number of copies."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source of each mix."""
    return _mix(spark, sf_dir)[1]


def p9_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for mixes of as many tokens as their sources hold: scarce sources give all their repeats, the others fill up."""
    return _mix(spark, sf_dir, "available")[1]


def p9_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of each mix in characters, for the largest total of exact shares and for all that there is."""
    sizes, targets = table(spark, sf_dir, "documents").where("source is not null and n_chars > 0").select("source", F.col("n_chars").alias("tokens")), table(spark, sf_dir, "mix_targets")
    exact, filled = mixing.budgets(sizes, targets), mixing.budgets(sizes, targets, "available").select("mix_id", "source", F.round("budget", 3).alias("filled"))
    return exact.select("mix_id", "source", F.round("share", 9).alias("share"), F.round("budget", 3).alias("budget"), "binding").join(filled, ["mix_id", "source"])


#: Characters that separate words when texts are counted for p10_found.
_BLANK = r"[ \t\n\x0B\f\r]+"


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every English document with at least 60 words."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    scale = reading.fit_on(docs, table(spark, sf_dir, "level_labels"), "doc_id", "text", "level")
    long = docs.where(F.col("lang") == "en").where(F.size(F.filter(F.split("text", _BLANK), lambda w: w != "")) >= 60)
    # a text of digits alone has words but no letters: it is read by the easiest reader
    return reading.read_levels(long, "text", scale).select("doc_id", F.coalesce("reading.level", F.lit(1)).alias("level"))


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How demanding each source is: documents by level and the mean of the median grades."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    scale = reading.fit_on(docs, table(spark, sf_dir, "level_labels"), "doc_id", "text", "level")
    got = reading.read_levels(docs, "text", scale).select("source", "reading.*")
    return got.groupBy("source", "level").agg(F.count("*").alias("docs"), F.round(F.avg("grade"), 3).alias("grade"), F.sum("words").alias("words"))


QUERIES = {"p1_found": p1_found, "p1_text": p1_text, "p4_found": p4_found, "p4_clean": p4_clean, "p4_lines": p4_lines, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_entities": p6_entities, "p7_found": p7_found, "p8_ids": p8_ids, "p9_shares": p9_shares, "p9_mix": p9_mix, "p9_filled": p9_filled, "p9_budgets": p9_budgets, "p10_found": p10_found, "p10_profile": p10_profile}
#: CTEs of the excessive lines of each source.
_BAD = r"""with src as (select distinct file, lower(trim(regexp_replace(venue, '^\s+|\s+$', '', 'g'))) as source from papers where venue is not null),
    doc as (select c.rowid as id, c.file, s.source, c.text from chunks c join src s using (file)),
    total as (select source, count(distinct file) as n from doc group by 1),
    split as (select id, file, source, string_split(text, chr(10)) as ls from doc where text is not null),
    line as (select id, file, source, cast(i as int) as line_no, trim(regexp_replace(regexp_replace(lower(ls[i]), '[0-9]+', '0', 'g'), '\s+', ' ', 'g')) as l
             from split, unnest(generate_series(1, len(ls))) as u(i)),
    bad as (select source, l from line join total using (source) where length(l) >= 20 group by source, l, n
            having count(distinct file) >= 3 and count(distinct file) >= 0.25 * n)"""

SQL: dict[str, str] = {
    "p4_found": f"{_BAD} select distinct id as rowid, line_no from line join bad using (source, l)",
    "p4_clean": f"""{_BAD}, drops as (select id, list(distinct line_no) as ns from line join bad using (source, l) group by id)
        select c.rowid, case when ns is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(ns, i)), chr(10)) end as clean from chunks c left join drops d on d.id = c.rowid""",
    "p4_lines": f"""{_BAD}, occ as (select distinct id, line_no, source, l from line join bad using (source, l)), files as (select source, l, count(distinct file) as files from line join bad using (source, l) group by all),
        firsts as (select source, l, count(*) as occurrences, min({{'i': id, 'n': line_no}}) as at0 from occ group by all)
        select string_split(text, chr(10))[at0.n] as example, files, n as of_files, occurrences from firsts join files using (source, l) join total using (source) join chunks c on c.rowid = at0.i""",
    "p9_budgets": """with have as (select source, sum(n_chars)::double as a from documents where n_chars > 0 and source is not null group by 1),
        l as (select mix_id, source, sum(greatest(coalesce(weight, 0.0), 0.0)) as w, min(greatest(coalesce(max_repeats, 1), 0)) as r from mix_targets where mix_id is not null and source is not null group by all),
        u as (select mix_id, source, coalesce(a, 0) as a, coalesce(a, 0) * r as cap, case when coalesce(a, 0) > 0 and r > 0 then w else 0 end as w from l left join have using (source)),
        s as (select *, coalesce(w / nullif(sum(w) over (partition by mix_id), 0), 0.0) as share from u),
        m as (select mix_id, min(cap / share) as low, sum(a) as total from s where share > 0 group by 1),
        f as (select p.mix_id, p.cap / p.share as at0, sum(least(q.cap, q.share * p.cap / p.share)) as filled, sum(case when q.cap / q.share > p.cap / p.share then q.share else 0 end) as slope from s p join s q on q.mix_id = p.mix_id where p.share > 0 and q.share > 0 group by p.mix_id, p.source, p.cap / p.share),
        -- the last corner of the filling curve that does not pass the total, and the way on from there
        z as (select mix_id, 0.0 as at0, 0.0 as filled, 1.0 as slope from m union all select * from f),
        c as (select mix_id, max_by(at0 + case when slope > 1e-12 then (total - filled) / slope else 0 end, at0) as level from z join m using (mix_id) where filled <= total group by mix_id)
        select s.mix_id, source, round(share, 9) as share, round(least(share * coalesce(low, 0), cap), 3) as budget, coalesce(share > 0 and cap / share <= low * (1 + 1e-12), false) as binding, round(least(share * coalesce(level, 0), cap), 3) as filled
        from s left join m using (mix_id) left join c using (mix_id)""",
    "p5_found": "select distinct rowid from (select rowid, text from chunks) where length(text) > 1920",
}
