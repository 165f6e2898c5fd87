"""Variant spellings of names linked by noisy-channel attribution.

A spelling is read as words; each word is attributed to the frequent word it most probably
stands for (prior: in how many different spellings the word occurs; channel: typing errors by
edit distance, abbreviations, nicknames; evidence: context).  The spellings whose words are
attributed alike belong to one entity.

* Organisations: word order, legal forms, "the", and departments do not matter; the words left
  over (kind and place) are the entity.  A context column (the city) supports an attribution.
* People: a spelling gives a family name and given names.  Which word is which is read from
  commas and capitals, else from how often a word stands in either place elsewhere in the data.
  A misspelled family is attributed to a more widespread one only if a person there bears a
  compatible given name; nicknames and initials go to the most frequent compatible person.

Defined results: nulls, blanks and values that name nobody link to nothing; a spelling belongs
to exactly one entity; equal spellings are one spelling, however often they occur; an empty
table has no links.  All work is on distinct spellings and distinct words by equality joins on
deletion neighbourhoods; rows of a hot name are counted before any join and never gathered.
Steps that are read more than once are cut with checkpoint(), so plans stay small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnwood.llm.canonical import fold
from tarnwood.llm.edits import deletions, deletions_of, distance, distance_of
from tarnwood.session import cut

# Values that name nobody.
NOBODY = frozenset(["", "null", "none", "n/a", "na", "nan", "unknown", "-", "--", "?", "??", "???", "anonymous", "various", "not given", "none given", "n.a.", "nil", "."])
# Legal forms and small words that do not tell organisations apart.
LEGAL = frozenset("the of for and in at de der du la le inc corp corporation co company ltd limited llc gmbh ag sa plc kk bv nv srl spa incorporated".split())
# Words that head a department.
DEPARTMENT = frozenset("dept department departement school faculty fac division div group graduate section chair".split())
# Words of organisations with their abbreviations; the first stands for all.
# "tech" stays one word: the words beside it tell a technical university from an institute.
ORGANISATION = """
university univ u universite universitat universita universidad uni; tech technical technology technological technische tecnologico;
institute inst institut instituto istituto; polytechnic polytech politechnic poly politecnico polytechnique; laboratory lab labs laboratories laboratoire laboratorium;
national natl nationale nacional; academy acad; college coll; center centre ctr; research res; engineering eng engng; science sci sciences;
international intl int; association assoc assn; hospital hosp; department dept
"""
# Words that head a whole organisation, and words that may name a part of one.
HEADS = frozenset("university polytechnic college academy hospital".split())
UNITS = frozenset("laboratory center group department institute engineering".split())
# Phrases of organisation words by their acronym.
ACRONYMS = {"tu": ("tech", "university"), "eth": ("eth",)}
# Short and pet forms by the given names they stand for.
NICKNAMES = """
bill: william; billy: william; will: william; willy: william; liam: william; bob: robert; bobby: robert; rob: robert; robbie: robert; bert: robert albert; dick: richard; rick: richard;
rich: richard; ritchie: richard; mike: michael mikhail; mick: michael; mickey: michael; misha: mikhail; tom: thomas; tommy: thomas; joe: joseph jose; joey: joseph; jo: joseph josephine; pepe: jose giuseppe;
beppe: giuseppe; peppe: giuseppe; pino: giuseppe; nick: nicholas; nicky: nicholas; klaus: nicholas; kolya: nikolai; tony: anthony antonio; toni: anthony; andy: andrew andreas; drew: andrew;
alex: alexander alexandra alexei; sasha: alexander alexandra; sandy: alexander alexandra; xander: alexander; ted: theodore edward; teddy: theodore edward; theo: theodore; ed: edward; eddie: edward; ned: edward;
chris: christopher christian christina; kit: christopher; topher: christopher; kate: katherine ekaterina; kathy: katherine; katie: katherine; kat: katherine; kitty: katherine; katya: ekaterina; katia: ekaterina;
liz: elizabeth; lizzie: elizabeth; beth: elizabeth; betty: elizabeth; eliza: elizabeth; lisa: elizabeth; peggy: margaret; meg: margaret; maggie: margaret; marge: margaret; greta: margaret;
trish: patricia; pat: patricia patrick; patty: patricia; tricia: patricia; sue: susanna susan; susie: susanna; susi: susanna; sanna: susanna; lottie: charlotte; charlie: charlotte charles; lotte: charlotte;
fritz: friedrich; fred: friedrich frederick alfred; freddy: friedrich frederick; hans: johannes; jan: johannes; johann: johannes; hannes: johannes; franco: francesco; cecco: francesco; frank: francesco francis;
dima: dmitri; mitya: dmitri; pasha: pavel; zoli: zoltan; jurg: jurgen; jorg: jurgen; irina: irena; ira: irena; lars: laurentius; larry: lawrence; jim: james; jimmy: james; jack: john; johnny: john; dave: david; dan: daniel;
danny: daniel; sam: samuel samantha; ben: benjamin; matt: matthew; steve: steven stephen; greg: gregory; jeff: jeffrey; ken: kenneth kenji; pete: peter; phil: philip; ron: ronald; don: donald; tim: timothy; vicky: victoria;
jenny: jennifer; debbie: deborah; cathy: catherine; nat: nathaniel natalie; max: maximilian; seb: sebastian; leo: leonard leonardo; gabe: gabriel; abe: abraham; hank: henry; harry: henry harold; walt: walter
"""


def _table(text: str) -> dict[str, list[str]]:
    return {k.strip(): v.split() for k, v in (e.split(":") for e in text.split(";") if e.strip())}


@lru_cache(maxsize=8)
def _groups(text: str) -> dict[str, str]:
    return {w: g.split()[0] for g in text.split(";") if g.strip() for w in g.split()}


def squeeze(c: Column) -> Column:
    """Trimmed, each run of white space one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def names_somebody(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(c).isin(*NOBODY) & F.regexp_like(c, F.lit(r"(?U)\p{L}.*\p{L}"))


@lru_cache(maxsize=65536)
def _organisation_word(word: str) -> str:
    """The word that stands for an abbreviation or a misspelling of a word of organisations."""
    org = _groups(ORGANISATION)
    if word in org or len(word) < 7:
        return org.get(word, word)
    close = [w for w in org if len(w) >= 7 and distance(word, w, 1) <= 1]
    return org[close[0]] if close else word


def organisation_words(text: str) -> list[str]:
    """The words that tell the organisation apart: abbreviations written out, legal forms and departments left out."""
    segments = [[_organisation_word(w) for w in fold(s).split()] for s in re.split(r"[,()/;|\[\]]+", text)]
    segments = [s for s in segments if s]
    kept = [s for s in segments if not DEPARTMENT & set(s)] or segments
    headed = [bool(HEADS & set(s)) or {"institute", "tech"} <= set(s) for s in kept]
    if any(headed):
        kept = [s for s, head in zip(kept, headed, strict=True) if head or not UNITS & set(s)]
    words = [x for s in kept for w in s for x in ACRONYMS.get(w, (w,))]
    return sorted({w for w in words if w not in LEGAL}) or sorted(set(words))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _organisation_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield pd.Series([organisation_words(v) for v in values], dtype=object)


#: Words up to which all are held in every task, as an index of deletions; more words are joined.
MOST_WORDS = 100_000
NEAR = "array<struct<other:string,edits:int>>"


def _allowed(length: int) -> int:
    """Typing errors looked for in a word of this length."""
    return 2 if length >= 9 else 1 if length >= 5 else 0


def _edits(length: Column) -> Column:
    return F.when(length >= 9, 2).when(length >= 5, 1).otherwise(0)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, edits) of all pairs of different words within the edits both lengths allow."""
    words = words.select("word").distinct()
    held = words.limit(MOST_WORDS + 1).collect()
    if len(held) > MOST_WORDS:
        keys = words.select(F.col("word").alias("w"), F.explode(deletions_of(F.col("word"), _edits(F.length("word")))).alias("d"))
        pairs = keys.join(keys.withColumnRenamed("w", "o"), "d").where("w <> o").select("w", "o").distinct()
        pairs = pairs.withColumn("edits", distance_of(F.col("w"), F.col("o")))
        return pairs.where(F.col("edits") <= F.least(_edits(F.length("w")), _edits(F.length("o")))).select(F.col("w").alias("word"), F.col("o").alias("other"), "edits")
    shared = words.sparkSession.sparkContext.broadcast([r["word"] for r in held])

    @F.pandas_udf(NEAR)
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by_key: dict[str, list[str]] = {}
        for w in shared.value:
            for d in deletions(w, _allowed(len(w))) if _allowed(len(w)) else ():
                by_key.setdefault(d, []).append(w)
        for b in batches:
            out = []
            for w in b:
                k = _allowed(len(w))
                others = {o for d in deletions(w, k) for o in by_key.get(d, ())} - {w} if k else ()
                measured = [(o, distance(w, o, min(k, _allowed(len(o))))) for o in others]
                out.append([{"other": o, "edits": e} for o, e in measured if e <= min(k, _allowed(len(o)))])
            yield pd.Series(out, dtype=object)

    return words.select("word", F.explode(near("word")).alias("p")).select("word", "p.other", "p.edits")


def written_out(keyed: DataFrame, stats: DataFrame) -> DataFrame:
    """(spelling, bag) with abbreviations of three to five letters and a full stop replaced by a longer word.

    The likelihood of an abbreviation is fitted on the data: in how many of its spellings the name with the longer word
    in its place is itself a name there.  A spelling takes the word its own name is found with, else the word of
    most such spellings; without any the abbreviation stays."""
    dotted = F.array_distinct(F.regexp_extract_all(F.lower("spelling"), F.lit(r"(?U)\b(\p{L}{3,5})\."), F.lit(1)))
    cases = keyed.select("spelling", "bag", F.explode(F.array_intersect(dotted, "bag")).alias("abbr"))
    size = F.length("word")
    heads = F.transform(F.sequence(F.lit(3), F.least(F.lit(5), size - 2)), lambda n: F.substring("word", F.lit(1), n))
    longs = stats.where(size >= 5).select(F.col("word").alias("long"), "forms", F.explode(heads).alias("abbr"))
    full = F.array_sort(F.array_distinct(F.concat(F.array_remove("bag", F.col("abbr")), F.array("long"))))
    agreeing = cases.join(longs, "abbr").select("spelling", "abbr", "long", "forms", full.alias("full")).join(keyed.select(F.col("bag").alias("full")).distinct(), "full", "left_semi")
    own = cut(agreeing.groupBy("spelling", "abbr").agg(F.max_by("long", F.struct("forms", "long")).alias("own")), keyed.sparkSession)
    usual = own.groupBy("abbr", F.col("own").alias("long")).agg(F.count("*").alias("n")).groupBy("abbr").agg(F.max_by("long", F.struct("n", "long")).alias("usual"))
    read = cases.join(own, ["spelling", "abbr"], "left").join(usual, "abbr").select("spelling", "abbr", F.coalesce("own", "usual").alias("long"))
    read = read.groupBy("spelling").agg(F.collect_list("abbr").alias("out"), F.collect_list("long").alias("put"))
    bag = F.when(F.col("out").isNull(), F.col("bag")).otherwise(F.array_sort(F.array_distinct(F.concat(F.array_except("bag", "out"), "put"))))
    return keyed.join(read, "spelling", "left").select("spelling", bag.alias("bag"))


def link_organisations(df: DataFrame, name: str, context: str | None = None) -> DataFrame:
    """(spelling, entity) of every spelling in ``df[name]`` that names somebody."""
    spelled = df.select(squeeze(F.col(name)).alias("spelling"), (squeeze(F.lower(F.col(context))) if context else F.lit(None).cast("string")).alias("context"))
    spelled = spelled.where(names_somebody(F.col("spelling"))).groupBy("spelling", "context").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    spelled = cut(spelled, spark)
    forms = cut(spelled.groupBy("spelling").agg(F.sum("n").alias("n")).withColumn("words", _organisation_words("spelling")), spark)
    words = forms.select("spelling", "n", F.explode("words").alias("word"))
    # acronyms: three letters or more that are the initials of a frequent phrase of the data
    stats = cut(words.groupBy("word").agg(F.count("*").alias("forms"), F.sum("n").alias("n")), spark)
    # how often each word stands beside each context word
    beside = (
        words.select("spelling", "word").join(spelled.where("context is not null"), "spelling")
        .groupBy("word", F.col("context").alias("other")).agg(F.sum("n").alias("together"))
    )
    pairs = near_words(stats).join(stats.withColumnsRenamed({"word": "other", "forms": "o_forms", "n": "o_n"}), "other").join(stats, "word")
    pairs = pairs.join(beside, ["word", "other"], "left").na.fill(0, ["together"])
    # prior times channel: a misspelling shows in few forms; the place named beside it decides
    typo = (F.col("o_forms") >= F.when(F.col("edits") == 1, 2).otherwise(4) * F.col("forms")) | ((F.col("forms") == 1) & (F.col("edits") == 1) & (F.struct("o_n", "other") > F.struct("n", "word")))
    score = F.log(F.col("o_forms").cast("double")) - 3 * F.col("edits") + 4 * F.log1p(F.col("together").cast("double"))
    best = pairs.where(typo | (F.col("together") > 0)).groupBy("word").agg(F.max_by("other", F.struct(score.alias("s"), "o_n", "other")).alias("canon"))
    best = cut(best, spark)
    # a second step follows a word attributed to a word that is itself a misspelling; two words
    # attributed to each other stand for one, whichever it is
    again = best.select(F.col("word").alias("canon"), F.col("canon").alias("next"))
    best = best.join(again, "canon", "left").select("word", F.when(F.col("next") == F.col("word"), F.least("word", "canon")).otherwise(F.coalesce("next", "canon")).alias("canon"))
    read = words.join(best, "word", "left").select("spelling", F.coalesce("canon", "word").alias("canon"))
    keyed = cut(read.groupBy("spelling").agg(F.array_sort(F.collect_set("canon")).alias("bag")), spark)
    keyed = cut(written_out(keyed, stats), spark)
    # an acronym of three letters or more stands for the phrase with these initials: the
    # phrase is read from spellings in full, in their own order, and must be widespread
    ordered = forms.select("spelling", F.lower("spelling").alias("low")).select("spelling", F.regexp_extract_all("low", F.lit(r"(?U)\p{L}{3,}[\p{L}'.]*"), 0).alias("ws"))
    phrase = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - 3, F.lit(0))), lambda i: F.transform(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda k: F.slice("ws", i + 1, k)))))
    phrases = ordered.select("spelling", phrase.alias("p")).where(F.size("p") >= 3).select("spelling", "p", F.array_join(F.transform("p", lambda w: F.substring(w, 1, 1)), "").alias("acronym"))
    acronyms = words.where(F.regexp_like("word", F.lit("^[a-z]{3,5}$"))).select(F.col("word").alias("acronym")).distinct()
    meant = phrases.join(acronyms, "acronym").groupBy("acronym", "p").agg(F.countDistinct("spelling").alias("n")).where("n >= 2").groupBy("acronym").agg(F.max_by("p", F.struct("n", "p")).alias("p"))
    meant = meant.select("acronym", _organisation_words(F.array_join("p", " ")).alias("long"))
    spelled_out = keyed.select("spelling", "bag", F.explode("bag").alias("acronym")).join(meant, "acronym").select("spelling", F.array_sort(F.array_distinct(F.concat(F.array_remove("bag", F.col("acronym")), "long"))).alias("full"))
    entity = keyed.join(spelled_out.groupBy("spelling").agg(F.max("full").alias("full")), "spelling", "left")
    return entity.select("spelling", F.array_join(F.coalesce("full", "bag"), " ").alias("entity"))


READING = T.StructType([T.StructField("family", T.StringType()), T.StructField("given", T.ArrayType(T.StringType())), T.StructField("sure", T.BooleanType())])


def read_person(text: str) -> tuple[str, list[str], bool]:
    """(family, given names, whether the form shows which is which).  Where it does not, the last full word is taken for the family."""
    if "," in text:
        family, given = text.split(",", 1)
        return fold(family), fold(given.replace(".", " ")).split(), True
    words = re.sub(r"[.\s]+", " ", text).strip().split(" ")
    full = [i for i, w in enumerate(words) if len(w) > 1]
    capitals = [i for i in full if words[i].isupper()]
    sure = True
    if not full:
        at = len(words) - 1
    elif len(full) == 1:
        at = full[0]
    elif len(capitals) == 1:
        at = capitals[0]
    else:
        at, sure = full[-1], False
    return fold(words[at]), [fold(w) for i, w in enumerate(words) if i != at and fold(w)], sure


@F.pandas_udf(READING)
def _read_person(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for values in batches:
        yield pd.DataFrame([read_person(v) for v in values], columns=["family", "given", "sure"])


def link_people(df: DataFrame, name: str) -> DataFrame:
    """(spelling, entity) of every spelling in ``df[name]`` that names somebody."""
    spelled = df.select(squeeze(F.col(name)).alias("spelling")).where(names_somebody(F.col("spelling"))).groupBy("spelling").agg(F.count("*").alias("n"))
    read = spelled.withColumn("r", _read_person("spelling")).select("spelling", "n", "r.*")
    spark = df.sparkSession
    read = cut(read, spark)
    spelled = read.select("spelling", "n")
    # where a word stands in the forms that show it: evidence for the forms that do not
    shown = read.where("sure")
    place = (
        shown.select(F.col("family").alias("word"), F.lit(1).alias("fam"), F.lit(0).alias("giv"))
        .unionByName(shown.select(F.explode("given").alias("word"), F.lit(0).alias("fam"), F.lit(1).alias("giv")))
        .groupBy("word").agg(F.sum("fam").alias("fam"), F.sum("giv").alias("giv"))
    )
    first = F.element_at("given", 1)
    open_ = read.where(~F.col("sure") & (F.size("given") > 0)).select("*", first.alias("first"))
    lean = place.select("word", ((F.col("giv") + 0.5) / (F.col("fam") + 0.5)).alias("lean"))
    open_ = (
        open_.join(lean.withColumnsRenamed({"word": "first", "lean": "l1"}), "first", "left")
        .join(lean.withColumnsRenamed({"word": "family", "lean": "l2"}), "family", "left")
        .withColumn("turn", F.coalesce("l2", F.lit(1.0)) > F.coalesce("l1", F.lit(1.0)))
    )
    turned = F.concat(F.array("family"), F.slice("given", F.lit(2), F.size("given")))
    open_ = open_.select("spelling", "n", F.when(F.col("turn"), F.col("first")).otherwise(F.col("family")).alias("family"), F.when(F.col("turn"), turned).otherwise(F.col("given")).alias("given"))
    read = read.where(F.col("sure") | (F.size("given") == 0)).select("spelling", "n", "family", "given").unionByName(open_)
    read = read.where(F.length("family") > 0).withColumn("first", F.coalesce(first, F.lit("")))

    # the given names a spelling may mean: itself, or those a nickname stands for
    nick = F.create_map(*[x for k, v in _table(NICKNAMES).items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    meant = F.when(F.length("first") <= 1, F.array("first")).otherwise(F.concat(F.array("first"), F.coalesce(nick[F.col("first")], F.array().cast("array<string>"))))
    read = cut(read.select("*", F.explode(meant).alias("means")), spark)

    # families attributed to more widespread ones that have a compatible person
    stats = cut(read.groupBy("family").agg(F.countDistinct("spelling").alias("forms"), F.sum("n").alias("n")), spark)
    pairs = near_words(stats.withColumnRenamed("family", "word")).withColumnsRenamed({"word": "family", "other": "o_family"})
    pairs = pairs.join(stats, "family").join(stats.withColumnsRenamed({"family": "o_family", "forms": "o_forms", "n": "o_n"}), "o_family")
    pairs = pairs.where((F.col("o_forms") >= F.when(F.col("edits") == 1, 1).otherwise(6) * F.col("forms") * F.col("forms")) & (F.struct("o_forms", "o_n", "o_family") > F.struct("forms", "n", "family")))
    persons = read.where(F.length("means") > 0).groupBy("family", "means").agg(F.sum("n").alias("prior"))
    # the likeliest compatible person of a family: one of the same given name, else the most frequent one with
    # the initial where either is only an initial.  Both are equality joins on counted people, one row for each
    # family and name, so a common surname gathers no rows.
    asked = read.select("family", "means").distinct().join(pairs, "family").withColumn("i", F.substring("means", 1, 1))
    same = persons.select(F.col("family").alias("o_family"), "means", F.col("prior").alias("same"))
    letters = persons.groupBy(F.col("family").alias("o_family"), F.substring("means", 1, 1).alias("i")).agg(F.max("prior").alias("any"), F.max(F.when(F.length("means") == 1, F.col("prior"))).alias("letter"))
    fits = asked.join(same, ["o_family", "means"], "left").join(letters, ["o_family", "i"], "left")
    prior = F.coalesce("same", F.when(F.length("means") == 1, F.col("any")).otherwise(F.col("letter")))
    score = F.log(F.col("o_forms").cast("double")) - 3 * F.col("edits") + F.when(F.col("same").isNotNull(), 2).otherwise(0)
    best = fits.where(prior.isNotNull() & (F.length("means") > 0)).groupBy("family", "means").agg(F.max(F.struct(score.alias("s"), prior.alias("o_prior"), "o_family")).alias("best"))
    moved = read.select("spelling", "family", "means").join(best, ["family", "means"]).groupBy("spelling").agg(F.max("best").alias("best")).select("spelling", F.col("best.o_family").alias("moved"))
    read = read.join(moved, "spelling", "left").withColumn("family", F.coalesce("moved", "family")).drop("moved")
    read = cut(read, spark)

    # within a family: full given names are people, others go to the likeliest of them
    full = read.where(F.length("means") > 1).groupBy("family", "means").agg(F.sum("n").alias("prior"), F.max((F.col("means") == F.col("first")).cast("int")).alias("written"))
    full = full.where("written = 1").select("family", F.col("means").alias("person"), "prior")
    # a nickname never written out in the family is itself the person's name
    exact = read.where(F.length("means") > 1).join(full.withColumn("means", F.col("person")), ["family", "means"])
    formal = (F.col("person") != F.col("first")).cast("int")
    named = exact.groupBy("spelling").agg(F.max_by("person", F.struct(formal.alias("f"), "prior", "person")).alias("person"))
    byname = read.where(F.length("means") > 1).select("spelling", "family").distinct().join(named, "spelling")
    byname = cut(byname, spark)
    # priors of the people after nicknames are attributed
    people = byname.join(spelled, "spelling").groupBy("family", "person").agg(F.sum("n").alias("prior")).withColumn("i", F.substring("person", 1, 1))
    short = read.where(F.length("means") == 1).withColumn("i", F.col("means"))
    byletter = short.join(people, ["family", "i"], "left").groupBy("spelling", "family", "means").agg(F.max_by("person", F.struct("prior", "person")).alias("person"))
    byletter = byletter.select("spelling", "family", F.coalesce("person", "means").alias("person"))
    alone = read.where(F.length("means") == 0).select("spelling", "family", F.lit("").alias("person"))
    return byname.select("spelling", "family", "person").unionByName(byletter).unionByName(alone).select("spelling", F.concat_ws("|", "family", "person").alias("entity")).distinct()


def linked_pairs(links: DataFrame) -> DataFrame:
    """(name_a, name_b) of every unordered pair of different spellings of one entity."""
    links = cut(links, links.sparkSession)
    a, b = links.withColumnRenamed("spelling", "name_a"), links.withColumnRenamed("spelling", "name_b")
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
