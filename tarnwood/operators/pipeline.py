"""Longer pipelines around injected callables: reading files, building vectors, answering.

A callable is given by the user (a PDF reader, an embedder, a model); everything around it is a
plan.  A callable that fails on one row costs that row only, and the report says so.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwood.functions import text as tx
from tarnwood.operators import ingest, retrieval, tree
from tarnwood.session import cut

PAGES = "path string, page string, text string, error string"


def binary_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, name, content) of the files below ``folder``, of equal names the one of the first path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return ingest.newest_files(files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content"))


def extract_pages(files: DataFrame, reader: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """(path, page, text, error): the pages of each file that hold more than blanks, numbered from 1.

    A file the reader fails on gives one row with its error, a file without text one row without page."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages = [(path, str(i), t, None) for i, t in enumerate(reader(content), 1) if t and t.strip()]
                    rows += pages or [(path, None, None, None)]
                except Exception as e:  # noqa: BLE001 - a broken file is reported, the others go on
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    return files.select("path", "content").mapInPandas(read, PAGES)


def ingest_report(pages: DataFrame) -> DataFrame:
    """(state, files): how many files were read, are empty or broken."""
    state = F.when(F.col("error").isNotNull(), "broken").when(F.col("page").isNull(), "empty").otherwise("read")
    return pages.groupBy("path").agg(F.max(state).alias("state")).groupBy("state").agg(F.count("*").alias("files"))


def chunk_rows(pages: DataFrame) -> DataFrame:
    """(file, page, chunk_no, text): the pages cut into chunks."""
    p = pages.where("text is not null").select(F.struct(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "page").alias("key"), "text")
    return ingest.chunk_texts(p, "key", "text").select("key.file", "key.page", "chunk_no", F.col("chunk").alias("text"))


def patiently(call: Callable, tries: int, wait: Callable[[float], None] = time.sleep):
    """The result of ``call``, tried again after 1, 2, 4 … seconds, 30 at most; None if it fails ``tries`` times."""
    for n in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001 - tried again, then left for the next run
            if n + 1 < tries:
                wait(min(2.0**n, 30.0))
    return None


def in_order(got: Sequence, n: int) -> list:
    """``n`` vectors of a reply in the order of the texts; a reply may be vectors, or (index of the text, vector) pairs in any order."""
    if len(got) != n:
        raise ValueError("the embedder returned another number of vectors")
    if got and isinstance(got[0], tuple):
        if sorted(i for i, _ in got) != list(range(n)):
            raise ValueError("the embedder returned other texts")
        return [v for _, v in sorted(got, key=lambda p: p[0])]
    return list(got)


def build_vectors(chunks: DataFrame, old: DataFrame, embed: Callable[[Sequence[str]], Sequence], width: int, size: int = 10, tries: int = 5, most: int | None = None, restart: bool = False, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(rowid, digest, vector): one vector per chunk.

    ``old`` is (rowid, digest, vector); a vector that is not all zero is kept if the text's digest is
    the same, so an edited text is embedded again.  A call that fails ``tries`` times gives zero
    vectors, which the next run takes up again; only missing rows reach the embedder.  ``most`` embeds no more than so
    many of them, in the order of rowid, the others get zero vectors; ``restart`` keeps no old vector.  Written as Parquet the
    result appears whole or not at all."""
    old = old.limit(0) if restart else old
    wanted = ingest.embed_input(chunks).withColumn("digest", F.md5("input"))
    usable = old.where(F.exists("vector", lambda x: x != 0)).select("rowid", "digest", "vector")
    kept = wanted.drop("input").join(usable, ["rowid", "digest"])
    missing = wanted.join(kept.select("rowid"), "rowid", "left_anti")
    later = None
    if most is not None:
        now = missing.orderBy("rowid").limit(most)
        later = missing.join(now.select("rowid"), "rowid", "left_anti").select("rowid", "digest", F.array_repeat(F.lit(0.0).cast("float"), width).alias("vector"))
        missing = now

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts, out = b.tolist(), []
            for i in range(0, len(texts), size):
                part = texts[i : i + size]
                got = patiently(lambda part=part: in_order(embed(part), len(part)), tries, wait)
                out += [list(v) for v in got] if got is not None else [[0.0] * width] * len(part)
            yield pd.Series(out, dtype=object)

    made = kept.select("rowid", "digest", "vector").unionByName(missing.select("rowid", "digest", vectors("input").alias("vector")))
    return made if later is None else made.unionByName(later)


class Breaker:
    """Driver-side state of the vector route: after ``most`` failures in a row it stays open, and
    searches are keyword-only; a success before that sets the count back."""

    def __init__(self, most: int = 3):
        self.most, self.failures = most, 0

    @property
    def open(self) -> bool:
        return self.failures >= self.most

    def call(self, run: Callable, *args):
        """The result of ``run``, or None if it fails or the breaker is open."""
        if self.open:
            return None
        try:
            out = run(*args)
        except Exception:  # noqa: BLE001 - any failure counts
            self.failures += 1
            return None
        self.failures = 0
        return out


#: What an answer must do; put before the snippets.
CONTRACT = (
    "Answer only from the numbered snippets. Put the number of the snippet, like [1], behind every claim. Say so where the snippets do not hold the answer. "
    "Give measured values with their conditions, in SI units and as printed. End with the list of the works used and with their evaluations."
)


def messages(question: Column, context: Column, snippets: Column) -> Column:
    """array of (role, content): the contract, then snippets and question."""
    user = F.concat(F.lit("Snippets ("), snippets.cast("string"), F.lit("):\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(CONTRACT).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def expanded(question: Column, words: Column) -> Column:
    """The question with a model's search words behind it, where it returned any."""
    return F.when(F.trim(words) != "", F.concat_ws(" ", question, F.trim(words))).otherwise(question)


def cited_hits(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, file, n, place): the works of the hits an answer cites as [n], in the order of the hits, one row per
    file; all works where it cites none of them."""
    said = answers.select("query_id", F.explode(F.regexp_extract_all("answer", F.lit(r"\[([0-9]{1,2})\]"), F.lit(1))).alias("n")).select("query_id", F.col("n").cast("int").alias("n"), F.lit(True).alias("cited")).distinct()
    known = hits.select("query_id", F.col("n").cast("int").alias("n"), "file").join(answers.select("query_id").distinct(), "query_id", "left_semi").join(said, ["query_id", "n"], "left").na.fill(False, ["cited"])
    any_ = F.max("cited").over(Window.partitionBy("query_id"))
    shown = known.withColumn("any", any_).where("cited or not any").groupBy("query_id", "file").agg(F.min("n").alias("n"))
    return shown.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n")))


def asked_words(questions: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(query_id, query): each question with the search words an injected model gives for it; a call that fails leaves it as it is."""
    return ingest.ask_rows(questions, F.col("query"), model, "__words", 1).select("query_id", expanded(F.col("query"), F.col("__words")).alias("query"))


def guarded_search(chunks: DataFrame, papers: DataFrame, vectors: DataFrame, questions: DataFrame, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], breaker: Breaker, **options) -> DataFrame:
    """:func:`retrieval.search` of (query_id, query), embedded behind the breaker: where that fails or the breaker is
    open, the keyword route answers alone."""
    empty = F.lit(None).cast("array<float>")
    embedded = breaker.call(lambda: cut(questions.select("query_id", "query", retrieval.batches_of(embed, F.col("query")).alias("vector")), questions.sparkSession))
    return retrieval.search(chunks, papers, vectors, questions.select("query_id", "query", empty.alias("vector")) if embedded is None else embedded, **options)


def hydrated(hits: DataFrame, chunks: DataFrame, papers: DataFrame, queries: DataFrame) -> DataFrame:
    """``hits`` (query_id, rowid, …) as they are shown: what the chunk and its paper hold, missing fields with their
    defaults, and the preview around the words of the question.  Only texts of hits are shuffled, so ``hits`` should be written."""
    or_ = lambda c, d="": F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d)).alias(c)
    fields = ["authors", "venue", "doi", "tier", "category", "paper_id", "index_status", "corresponding_author", "abstract_data", "innovation", "abstract_source", "evaluation"]
    meta = papers.select("file", or_("title", "(untitled)"), "year", "cited", F.coalesce("cross_topic", F.lit(0)).alias("cross_topic"), *[or_(f) for f in fields])
    rows = hits.join(retrieval.among(chunks, hits).select("rowid", "file", or_("page"), F.coalesce("text", F.lit("")).alias("text")), "rowid").join(meta, "file").join(queries.select("query_id", "query"), "query_id")
    return rows.withColumn("preview", tx.preview(F.col("text"), tx.query_tokens(F.col("query")))).drop("query")


def planned_focus(ids: Sequence[str] | None, nodes: Sequence[str] | None = None, default: Sequence[str] = ("fm_force", "fm_induction", "fm_electrode")) -> list[str]:
    """Node ids a model proposed, unknown and repeated ones left out; the default path where none is left."""
    known = set(nodes if nodes is not None else (r[0] for r in tree.parsed()))
    kept = [i for i in dict.fromkeys(ids or ()) if i in known]
    return kept or list(default)


def propagated(rows: DataFrame, code: str, merged: dict[str, str]) -> DataFrame:
    """``rows`` with a row for each merged region that has none, a copy of the row of the code it joins."""
    spark = rows.sparkSession
    pairs = spark.createDataFrame(list(merged.items()), "__region string, __of string")
    have = rows.select(F.col(code).alias("__region"))
    extra = pairs.join(have, "__region", "left_anti").join(rows, F.col("__of") == F.col(code)).withColumn(code, F.col("__region")).select(*rows.columns)
    return rows.unionByName(extra)


def log_position(v: Column, lowest: Column, highest: Column) -> Column:
    """Place of a value between the ends of a logarithmic scale, in per cent; missing ends count as 0.001 and 1."""
    lo, hi = F.log10(F.coalesce(lowest, F.lit(1e-3))), F.log10(F.coalesce(highest, F.lit(1.0)))
    return F.round(100 * (F.log10(v) - lo) / F.nullif(hi - lo, F.lit(0.0)), 4)


def as_json(**columns: Column) -> Column:
    """Several columns as one JSON text, for a map or a page."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def clean_and_sync(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) after the watermark is cut: dropped chunks leave both, edited ones get the
    new text and lose their vector, so the next build embeds them again."""
    decided = ingest.watermark_decisions(chunks)
    dropped, edited = decided.where("decision = 'drop'"), decided.where("decision = 'edit'")
    kept = ingest.update_column(chunks.join(dropped.select("rowid"), "rowid", "left_anti"), edited.select("rowid", "text"), "rowid", "text")
    return kept, vectors.join(decided.select("rowid"), "rowid", "left_anti")


def source_limits(index_status: Column, mark: str = "归档版本") -> Column:
    """Whether only an archived scan of the source is there."""
    return F.coalesce(F.contains(index_status, F.lit(mark)), F.lit(False))


def first_author(authors: Column) -> Column:
    """The text before the first separator of an author field; empty for null."""
    return F.trim(F.split(F.coalesce(authors, F.lit("")), "[,，;；]")[0])

