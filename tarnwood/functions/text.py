"""Text functions as Column expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query words that carry no meaning (English and Chinese).
STOPWORDS = (
    "the and for with that this from are was were has have had not but its it's can will how what why which when who does did you your "
    "请 帮我 介绍 一下 什么 怎么 如何 是否 以及 关于"
).split()
# A query token, and a term of the index.
QUERY_TOKEN = r"[A-Za-z][A-Za-z0-9\-_.]*|[0-9]+(?:\.[0-9]+)?|[一-鿿]+"
TERM = r"[\p{L}\p{N}]+"
#: Accented letters and what they are folded to; the same table serves the oracle.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿł", "aaaaaaceeeeiiiinoooooouuuuyyl")


def query_tokens(text: Column) -> Column:
    """Tokens of a query in order, duplicates kept: stopwords out, single characters only if digits."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUERY_TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~F.lower(t).isin(*STOPWORDS) & ((F.length(t) >= 2) | t.rlike("^[0-9]$")))


def match_expression(text: Column, mode: str = "OR") -> Column:
    """The tokens as quoted phrases joined by the mode; null where there are none."""
    tokens = query_tokens(text)
    quoted = F.transform(tokens, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(tokens) > 0, F.array_join(quoted, f" {mode} "))


def terms(text: Column) -> Column:
    """Index terms: lower case, accents folded, split at everything else."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), *ACCENTS), F.lit(TERM), F.lit(0))


def preview(text: Column, tokens: Column, width: int = 340) -> Column:
    """A window of ``width`` characters that begins a third of it before the first token, with
    every token marked by 【】; the longest tokens are marked first."""
    body = F.coalesce(text, F.lit(""))
    places = F.filter(F.transform(tokens, lambda t: F.instr(F.lower(body), F.lower(t))), lambda p: p > 0)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(places) - 1, F.lit(0)) - F.lit(width // 3))
    seg = F.trim(F.replace(F.substring(body, start + 1, F.lit(width)), F.lit("\n"), F.lit(" ")))
    ordered = F.array_sort(F.array_distinct(tokens), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    escaped = lambda t: F.regexp_replace(t, r"([.\\\-])", r"\\$1")
    marked = F.aggregate(ordered, seg, lambda s, t: F.regexp_replace(s, F.concat(F.lit("(?i)("), escaped(t), F.lit(")")), F.lit("【$1】")))
    out = F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), marked, F.when(start + width < F.length(body), F.lit("…")).otherwise(F.lit("")))
    return F.when(body == "", F.lit("")).otherwise(out)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def snippet(text: Column, words: Column, size: int = 22) -> Column:
    """The ``size`` words that begin at a hit and hold the most different ones of ``words`` (index terms), the first
    of equals, each hit marked by 【】; the beginning where nothing hits."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM + r"[^\p{L}\p{N}]*"), F.lit(0))
    hit = lambda t, ws: let(F.translate(F.lower(F.regexp_extract(t, TERM, 0)), *ACCENTS), lambda f: F.when(F.array_contains(ws, f), f))

    def cut_out(ts: Column, hits: Column) -> Column:
        begins = F.filter(F.transform(hits, lambda h, i: F.when(h.isNotNull(), F.struct((-F.size(F.array_distinct(F.array_compact(F.slice(hits, i + 1, size))))).alias("s"), (i + 1).alias("i")))), lambda b: b.isNotNull())
        return let(F.coalesce(F.array_min(begins)["i"], F.lit(1)), lambda start: shown(ts, hits, start))

    def shown(ts: Column, hits: Column, start: Column) -> Column:
        marked = F.zip_with(F.slice(ts, start, size), F.slice(hits, start, size), lambda t, h: F.when(h.isNotNull(), F.regexp_replace(t, "^(" + TERM + ")", "【$1】")).otherwise(t))
        return F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), F.trim(F.array_join(marked, "")), F.when(start + size <= F.size(ts), F.lit("…")).otherwise(F.lit("")))

    return let(words, lambda ws: let(tokens, lambda ts: let(F.transform(ts, lambda t: hit(t, ws)), lambda hits: cut_out(ts, hits))))


def html_marked(preview: Column) -> Column:
    """A preview for a page: markup escaped first, then 【x】 set in bold."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        preview = F.replace(preview, F.lit(sign), F.lit(name))
    return F.regexp_replace(preview, "【(.+?)】", "<b>$1</b>")


def one_blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# Separators of an author list, and pieces that name nobody.
AUTHOR_SEPARATOR = r"[,;；、]|\band\b"
NO_AUTHOR = r"(?i)^(et al\.?|and others|anonymous)$"


def author_pieces(authors: Column) -> Column:
    """Non-blank pieces of an author field in order."""
    return F.filter(F.split(F.coalesce(authors, F.lit("")), AUTHOR_SEPARATOR), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")


def author_name(piece: Column) -> Column:
    """struct(key, name) of one author, null where the piece is no full name.

    The key is family name and first initial, so a name spelled out, shortened or turned has one key."""
    s = F.regexp_replace(one_blank(F.regexp_replace(one_blank(piece), r"^[.,;]+|[.,;]+$", "")), r"^[.,;]+|[.,;]+$", "")
    comma = F.instr(s, ",") > 0
    last = F.trim(F.when(comma, F.substring_index(s, ",", 1)).otherwise(F.substring_index(s, " ", -1)))
    first = F.trim(F.when(comma, F.regexp_replace(s, r"^[^,]*,", "")).otherwise(F.regexp_replace(s, r"\s*\S+$", "")))
    usable = (F.length(s) >= 3) & ~s.rlike(NO_AUTHOR) & (comma | (F.instr(s, " ") > 0)) & (F.length(last) >= 2)
    return F.when(usable, F.struct(F.concat(F.lower(last), F.lit("|"), F.lower(F.substring(first, 1, 1))).alias("key"), F.trim(F.concat(first, F.lit(" "), last)).alias("name")))


# Institution fields that are empty in words.
NO_VALUE = ("", "null", "none", "n/a", "na", "unknown", "-")


def institution_name(raw: Column) -> Column:
    """Institution without what follows a comma or bracket and without one leading article or department word."""
    s = F.regexp_replace(one_blank(F.coalesce(raw, F.lit(""))), r"\s*[,，(（].*$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)^(the|dept\.?|department of)\s+", ""), r"^[ .,]+|[ .,]+$", "")
    return F.when(~F.lower(s).isin(*NO_VALUE) & (F.length(s) >= 4), s)


# Codes that are none, and regions counted under another code.
NO_CODE = ("NUL", "N/A", "NON", "UNK")
MERGED = {"TWN": "CHN", "HKG": "CHN", "MAC": "CHN"}


def country_code(raw: Column) -> Column:
    c = F.upper(F.trim(raw))
    merged = c
    for a, b in MERGED.items():
        merged = F.when(c == a, F.lit(b)).otherwise(merged)
    return F.when(c.rlike("^[A-Z]{3}$") & ~c.isin(*NO_CODE), merged)


# Publisher noise cut from extracted text.
NOISE = (
    r"(?is)Authorized licensed use limited to:.{0,120}?Restrictions apply\.",
    r"(?i)Downloaded on .{0,60}?from IEEE Xplore\.",
    r"(?is)This article has been accepted for publication.{0,160}?content may change",
)
WATERMARK = r"(?is)Authorized licensed use limited to:.{0,120}?Downloaded on .{0,80}?from IEEE Xplore\.\s*Restrictions apply\."
WATERMARK_LINE = r"(?i)Authorized licensed use limited to:[^\n]*(?:\n|$)"
WATERMARK_SIGN = "Authorized licensed use"


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_extracted(text: Column) -> Column:
    """Text without publisher noise, blanks and blank lines squeezed."""
    c = F.coalesce(text, F.lit(""))
    for p in NOISE:
        c = F.regexp_replace(c, p, " ")
    return squeeze(c)


def strip_watermark(text: Column) -> Column:
    """Text without watermark sentences; where the strict form leaves one, to the end of its line."""
    strict = F.regexp_replace(F.coalesce(text, F.lit("")), WATERMARK, " ")
    loose = F.when(F.instr(strict, WATERMARK_SIGN) > 0, F.regexp_replace(strict, WATERMARK_LINE, " ")).otherwise(strict)
    return F.regexp_replace(F.regexp_replace(loose, r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


def page_order(page: Column) -> Column:
    """The whole number a page begins with, 0 where it has none; null stays null (and sorts first)."""
    return F.when(page.isNotNull(), F.coalesce(F.regexp_extract(page, r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int"), F.lit(0)))


def year_of(year: Column, file: Column) -> Column:
    """The first four characters as a year, else the four digits a file name begins with."""
    return F.coalesce(F.substring(year.cast("string"), 1, 4).try_cast("int"), F.nullif(F.regexp_extract(file, r"^([0-9]{4})", 1), F.lit("")).try_cast("int"))


def json_span(reply: Column) -> Column:
    """The part of a reply from its first bracket to the last one that closes the same kind."""
    at_list, at_object = F.instr(reply, "["), F.instr(reply, "{")
    is_list = (at_list > 0) & ((at_object == 0) | (at_list < at_object))
    start = F.when(is_list, at_list).otherwise(at_object)
    end = F.length(reply) - F.instr(F.reverse(reply), F.when(is_list, F.lit("]")).otherwise(F.lit("}"))) + 1
    closed = F.instr(reply, F.when(is_list, F.lit("]")).otherwise(F.lit("}"))) > 0
    return F.when((start > 0) & closed & (end > start), F.substring(reply, start, end - start + 1))


def said(c: Column) -> Column:
    """A string a model returned, null where it says nothing in words."""
    return F.when(~F.lower(F.trim(c)).isin(*NO_VALUE), F.trim(c))
