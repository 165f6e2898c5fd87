"""Edge cases of the operators: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwood.llm import bpe, canonical, edits, mixing, pieces, reading, repeated, scans, variants
from tarnwood.sources.tables import table

WORDS = "the electrode pitch of the flexible stator was measured with a charge amplifier and the dielectric layer limits the thrust density under dry nitrogen".split()


def lexicon(extra=()):
    counts = {w: 5000 for w in WORDS} | {"multi-layer": 4000, "layer": 5000, "multi": 100, "percent": 3000, "per": 900, "cent": 5, "configuration-dependent": 3000} | dict(extra)
    return scans.Lexicon(counts)


# --- p1
@pytest.mark.parametrize("seen,meant", [("elecfrode", "electrode"), ("e1ectrode", "electrode"), ("f|exible", "flexible"), ("dielectrlc", "dielectric"), ("arnplifier", "amplifier"), ("measurecl", "measured"), ("€harge", "charge"), ("configuratiori-dependent", "configuration-dependent"), ("arnpllfier", "amplifier")])
def test_misread(seen, meant):
    assert lexicon().best(seen) == meant


@pytest.mark.parametrize("word", ["electrode", "electrodes", "zzzzz", "the", "x", "", "12", "9.5", "kV", "a" * 5000])
def test_not_misread(word):
    assert lexicon().best(word) is None


def test_trie_retrieves_every_word_within_the_bound():
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(150)]
    trie = scans.Trie()
    for w in words:
        trie.add(w, w)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for key in ["".join(rng.choices("abcd", k=rng.randint(0, 7))) for _ in range(60)]:
        for k in (0, 1, 2):
            assert {(e, w) for e, w in trie.within(key, k)} == {(plain(key, w), w) for w in words if plain(key, w) <= k}


def analyse(text, title="Flexible stator with long electrodes", page="3", offset=100, heads=()):
    facts = scans.Facts(title, "0001_x_.pdf", offset, list(heads))
    _, skip, breaks, wrong = scans.analyse(text, facts, page, lexicon())
    return skip, {i for i, b in breaks.items() if b[0]}, set(wrong)


def test_lines():
    text = "the flexible stator was mea-\n103\nFLEXIBLE STATOR WITH LONG ELECTRODES\nsured with a multi-\nlayer dielecfric\nRun\n103\n40\n50\n"
    skip, hyphen, char = analyse(text)
    assert skip == {1: "pageno", 2: "header"} and hyphen == {0} and char == {4}


@pytest.mark.parametrize("line", ["— 103 —", "p. 103", "[103]", "103 of 400", "Page 103", "103", "l03", "xiv", "- 103 -"])
def test_page_numbers(line):
    assert analyse(f"the pitch of\n{line}\nthe stator was measured")[0] == {1: "pageno"}


@pytest.mark.parametrize("line", ["Voltage [V]", "2. Flexible stator in oil", "the flexible stator", "104", "Sect. 7)."])
def test_no_furniture(line):
    assert analyse(f"the pitch of\n{line}\nthe stator was measured")[0] == {}


@pytest.mark.parametrize("line", ["Flexible stator with", "34   LEE AND MAY: FLEXIBLE STATOR WITH", "Flexible stator with  35", "JoDE 12 (1999) / Lee and May", "LEE AND MAY - Flexible sfator with long", "JoDE Vol. 12 (1999) Flexible stator with"])
def test_heads(line):
    assert analyse(f"the pitch of\n{line}\nthe stator was measured")[0] == {1: "header"}


@pytest.mark.parametrize("line", ["Seminar Notes, second series", "Seminar N0tes, second series 12", "Seminar Notes, sec0nd series", "Seminar Note5, second series", "3 Seminar Notes, second series", "Seminar Nofes, second series", "Seminar Notes, second serics l2", "Serninar Notes, sccond series"])
def test_misread_printings_of_a_repeated_head(line):
    facts = scans.Facts(None, None, None, [scans.head_key("Seminar Notes, second series"), scans.head_key("Seminar Notes, second series 14"), scans.head_key("7 Seminar Notes, second series")])
    assert facts.is_head(line)
    assert not any(facts.is_head(x) for x in ("Seminar Notes", "A second series of notes", "Seminar Papers, second series", "Seminar"))


def test_misread_heads_of_a_file_are_found(spark):
    heads = {7: "Seminar N0tes, second series", 13: "Seminar Notes, sec0nd series", 19: "Seminar Note5, second series"}
    text = lambda i: f"the measured voltage of sample {chr(97 + i)} was\n{heads.get(i, 'Seminar Notes, second series')}\nlower than the one before"
    df = spark.createDataFrame([(i, "f", str(i), text(i), "Quite another title") for i in range(26)], "rowid long, file string, page string, text string, title string")
    assert {r["rowid"] for r in scans.find_noise(df, "rowid", "text", "file", "page", "title").where("kind = 'header' and line_no = 2").collect()} == set(range(26))


def test_soft_signs_and_edges():
    assert analyse("the dielec¬\ntric layer\nthe elec\xad")[1] == {0, 2}
    assert analyse("the multi-")[1] == set() and analyse("the elec-")[1] == {0}
    assert analyse("- a -\n-\n --")[1] == set()


def test_repaired_text():
    facts = scans.Facts("Flexible stator with long electrodes", "x", 100, [])
    text = "the flexible stator was mea-\n103\nsured with a multi-\nlayer dielecfric. The\n\nFLEXIBLE STATOR WITH LONG ELECTRODES\n\nelectrode pitch.\n\nThe thrust"
    assert scans.repaired(text, facts, "3", lexicon()) == "the flexible stator was measured with a multi-layer dielectric. The electrode pitch.\n\nThe thrust"
    assert scans.repaired("", facts, None, lexicon()) == ""


def chunk_rows(spark):
    body = "the flexible stator was mea-\nsured with the charge amplifier and the\ndielectric layer limits the thrust density\n"
    rows = [(i, f"{i % 3}_A.pdf", str(i), body + f"{i + 100}\nthe elecfrode pitch" if i % 2 else body.replace("-\n", "") * 3, "A flexible stator", "extra") for i in range(40)]
    rows += [(100, None, None, None, None, None), (101, "z", "x", "", "t", ""), (102, "0_A.pdf", "2", body * 200, None, ""), (1, "1_A.pdf", "1", body, "A flexible stator", "")]
    return spark.createDataFrame(rows, "rowid long, file string, page string, text string, title string, offset string")


def test_context_ranks_candidates_that_look_alike():
    counts = {"if": 900, "it": 1000, "fits": 50}
    plain, informed = scans.Lexicon(counts), scans.Lexicon(counts, {("even", "if"): 40, ("if", "the"): 60, ("it", "follows"): 70})
    assert plain.best("lf", "even", "the") == "it" and informed.best("lf", "even", "the") == "if" and informed.best("lf", "", "follows") == "it"
    assert scans.Lexicon(counts | {"lf": 3}).tied("lf") == ["it", "if"]


@pytest.mark.parametrize("seen,meant", [("electrcde", "electrode"), ("fricton", "friction"), ("frictizon", "friction"), ("vqltage", "voltage"), ("tbe", "the")])
def test_misreadings_that_look_like_nothing(seen, meant):
    lex = scans.Lexicon({"electrode": 100, "thrust": 100, "friction": 100, "voltage": 100, "the": 5000})
    assert [w for _, w in lex.candidates(seen)] == [meant] and lex.misread({seen}) == {seen: meant}
    assert lex.candidates(seen, "alike") == [] and lex.best(seen) == meant


@pytest.mark.parametrize("word", ["frictions", "thrusts", "thrusted", "athrust", "voltaic", "friktione", "thx", "color", "modeling", "电极电极电极电", "a" * 300])
def test_other_words_are_no_misreadings(word):
    assert scans.Lexicon({"thrust": 100, "friction": 100, "voltage": 100, "colour": 100, "modelling": 100, "the": 900, "电极电极电极极": 100}).candidates(word) == []


def test_recall_of_random_misreadings(spark, data):
    """Any letter of any frequent word put in, left out or replaced, whether it looks alike or not."""
    counts = Counter(w for r in table(spark, data.replace("sf0.001", "sf0.01"), "chunks").where("text is not null").select("text").collect() for w in map(scans.core, r["text"].split()) if scans._PLAIN.fullmatch(w) and w.isascii())
    lex = scans.Lexicon({w: n for w, n in counts.items() if n >= scans.LEAST})
    rng = random.Random(3)
    frequent = sorted(w for w, n in counts.items() if n >= 64 and len(w) >= 5)
    asked = right = 0
    for _ in range(4000):
        w, c = rng.choice(frequent), rng.choice("abcdefghijklmnopqrstuvwxyz")
        i = rng.randrange(len(w))
        bad = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
        if bad not in counts:
            asked += 1
            right += lex.best(bad) == w
    assert asked > 3000 and right / asked > 0.9, right / asked


def test_neighbours_beyond_the_broadcast_answer_alike(spark, monkeypatch):
    """``lf`` is read between its neighbours, whether their counts are broadcast or joined to the texts."""
    plain = "even if the drive stops it follows the film and it follows the stator even if the gap closes " * 20
    df = spark.createDataFrame([(1, "f", "1", plain + "\neven lf the end", "t"), (2, "f", "2", plain + "\nso lf follows them", "t"), (3, "g", "1", None, None)], "rowid long, file string, page string, text string, title string")
    one = {r["rowid"]: r["clean"] for r in scans.repair(df, "rowid", "text", "file", "page", "title").collect()}
    assert "even if the end" in one[1] and "so it follows them" in one[2]
    monkeypatch.setattr(scans, "PAIRS", 0)
    assert {r["rowid"]: r["clean"] for r in scans.repair(df, "rowid", "text", "file", "page", "title").collect()} == one
    monkeypatch.setattr(scans, "MOST_WORDS", 0)
    assert {r["rowid"]: r["clean"] for r in scans.repair(df, "rowid", "text", "file", "page", "title").collect()} == one


def test_keys_of_near_words_meet():
    rng = random.Random(4)
    for n in [1, 2, 5, 63, 64, 65, 66, 67, 130]:
        w = "".join(rng.choices("abcde", k=n))
        i = rng.randrange(n)
        for other in (w[:i] + "z" + w[i:], w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :]):
            assert scans._near_keys(w) & scans._near_keys(other)


def test_scan_rows(spark):
    df = chunk_rows(spark)
    got = scans.find_noise(df, "rowid", "text", "file", "page", "title").distinct().collect()
    kinds = {(r["rowid"], r["kind"]) for r in got}
    assert (1, "hyphen") in kinds and (1, "pageno") in kinds and (102, "hyphen") in kinds and not any(r["rowid"] in (100, 101) for r in got)
    assert scans.find_noise(df.limit(0), "rowid", "text", "file", "page", "title").count() == 0
    clean = {r["rowid"]: r["clean"] for r in scans.repair(df, "rowid", "text", "file", "page", "title").collect()}
    assert clean[100] is None and clean[101] == "" and "measured" in clean[3]


def noisy(spark, n=60):
    """Segments in which common and rare words are misread, broken and hyphenated."""
    rng = random.Random(9)
    rare = ["dulerganuk", "nuwitoliva", "paneriel", "hexa-fluoro-propane", "fluoro", "propane", "configuration"]
    rows = []
    for i in range(n):
        lines = [[rng.choice(WORDS + rare) for _ in range(9)] for _ in range(12)]
        text = [" ".join(x) for x in lines]
        w = rng.choice(rare[:3])
        text[2] += " " + rng.choice([w.replace("n", "ri"), w.replace("i", "1"), w.replace("r", "3", 1), w.replace("l", "l8"), f"{w.replace('e', 'c')}-propane"])
        text[5] += f" {w[:4]}-"
        text[6] = f"{w[4:]} {text[6]}"
        text[8] += " hexa-fluoro-"
        text[9] = f"propane {text[9]}"
        text[10] += " electrode-" + ("xyz" if i % 2 else "")
        rows.append((i, f"f{i % 5}", str(i), "\n".join(text), "Some other title of the file"))
    rows += [(900, "f1", "1", None, "t"), (901, "f1", "1", "", None), rows[0]]
    return spark.createDataFrame(rows, "rowid long, file string, page string, text string, title string")


def test_rare_words_looked_up_by_joins_answer_alike(spark, monkeypatch):
    df = noisy(spark)

    def results():
        found = sorted(tuple(r) for r in scans.find_noise(df, "rowid", "text", "file", "page", "title").collect())
        return found, sorted((r["rowid"], r["clean"] or "") for r in scans.repair(df, "rowid", "text", "file", "page", "title").collect())

    whole = results()
    assert sum(kind == "char" for _, _, kind in whole[0]) >= 40 and sum(kind == "hyphen" for _, _, kind in whole[0]) >= 60
    for most in (0, 12, 25):
        monkeypatch.setattr(scans, "MOST_WORDS", most)
        assert scans.vocabulary(df, "text")[1] is not None
        assert results() == whole


def test_counts_are_the_same_in_a_corpus_of_any_size(spark):
    """Twenty million words beside it do not hide a word of 18 occurrences, nor its own count of 3."""
    text = "dulerganuk " * 18 + "\nand du1erganuk here\n" + "electrode " * 40 + "elecfrode " * 3
    few = spark.createDataFrame([(1, "f", "1", text, "t")], "rowid long, file string, page string, text string, title string")
    many = spark.range(2, 22).select(F.col("id").alias("rowid"), F.lit("g").alias("file"), F.lit("1").alias("page"), F.repeat(F.lit("a "), 1_000_000).alias("text"), F.lit("t").alias("title"))
    got = [{tuple(r) for r in scans.find_noise(df, "rowid", "text", "file", "page", "title").collect()} for df in (few, few.unionByName(many))]
    assert got[0] == got[1] == {(1, 2, "char")}


# --- p4
def test_repeated_lines(spark):
    note = "Reported by the editorial desk on day {}"
    rows = [(i, f"f{i % 8}", f"Own line number {chr(97 + i)} of this text\n{note.format(i)}\n\n" + ("  REPORTED by the  editorial desk on day 7" if i == 3 else "x")) for i in range(16)]
    rows += [(90, "f1", None), (91, "g", note.format(1)), (92, "h", ""), (3, "f3", rows[3][2])]
    docs = spark.createDataFrame(rows, "rowid long, file string, text string").withColumn("source", F.lit("clash"))
    src = spark.createDataFrame([(f"f{i}", "v") for i in range(8)] + [("g", None), ("h", "w")], "file string, source string")
    occ = repeated.excessive_occurrences(docs, src, "rowid", "text", "file")
    got = {(r["rowid"], r["line_no"]) for r in occ.collect()}
    assert got == {(i, 2) for i in range(16)} | {(3, 4)}
    clean = {r["rowid"]: r["clean"] for r in repeated.remove_lines(docs, occ, "rowid", "text").collect()}
    assert clean[90] is None and clean[91] == note.format(1) and clean[0] == "Own line number a of this text\n\nx" and clean[92] == ""
    assert repeated.excessive_occurrences(docs.limit(0), src, "rowid", "text", "file").count() == 0


def test_repeated_thresholds(spark):
    line = "This line is printed in just a few of them"
    many = lambda k: spark.createDataFrame([(i, f"f{i}", line if i < k else f"another long line of file {chr(97 + i)}") for i in range(16)], "rowid long, file string, text string")
    src = spark.createDataFrame([(f"f{i}", "v") for i in range(16)], "file string, source string")
    assert repeated.excessive_occurrences(many(4), src, "rowid", "text", "file").count() == 4
    assert repeated.excessive_occurrences(many(3), src, "rowid", "text", "file").count() == 0


def test_summaries_too_small_take_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(repeated, "MOST_COUNTERS", 8)
    docs = spark.createDataFrame([(i, f"f{i}", f"The same long line everywhere\nanother line of {chr(97 + i)} alone") for i in range(6)], "rowid long, file string, text string")
    src = spark.createDataFrame([(f"f{i}", "v") for i in range(6)], "file string, source string")
    assert {r["line_no"] for r in repeated.excessive_occurrences(docs, src, "rowid", "text", "file").collect()} == {1}


def test_files_longer_than_the_largest_summary(spark):
    docs = spark.range(3).select(F.col("id").alias("rowid"), F.concat(F.lit("f"), F.col("id")).alias("file"), F.concat(F.lit("The same long line everywhere\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9999)), lambda i: F.concat(F.lit("own line "), F.translate(F.md5(F.concat_ws("-", "id", i)), "0123456789", "ghijklmnop"))), "\n")).alias("text"))
    src = spark.createDataFrame([(f"f{i}", "v") for i in range(3)], "file string, source string")
    assert {(r["rowid"], r["line_no"]) for r in repeated.excessive_occurrences(docs, src, "rowid", "text", "file").collect()} == {(0, 1), (1, 1), (2, 1)}


# --- p5
@pytest.mark.parametrize("text", ["x" * 5000, "word " * 1500, "A sentence here. " * 400, "图给出了对比。" * 700, "\n" * 4000, "a\n\nb" * 1500, "😀" * 2500, ("para " * 100 + "\n\n") * 9, "x" * 1921])
def test_pieces_cover(text):
    cuts = pieces.cut_points(text, 1920, 160)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b), (c, d) in zip(cuts, cuts[1:], strict=False):
        assert a < c <= b < d and b - c <= 160
    assert all(0 < b - a <= 1920 for a, b in cuts)


def test_pieces_edges():
    assert pieces.cut_points("", 10, 2) == [] and pieces.cut_points("x" * 10, 10, 2) == [(0, 10)]
    assert [b - a for a, b in pieces.cut_points("x" * 25, 10, 0)] and pieces.cut_points("ab cd ef gh", 6, 2)[-1][1] == 11


def test_pieces_are_as_cheap_as_brute_force():
    """The dynamic programme against every set of cuts, over the same boundaries and prices."""
    from itertools import combinations

    text, limit, overlap = "Aa bb. Cc dd\nee ff gg. Hh ii jj kk ll. Mm nn", 20, 4
    at, price = pieces.boundaries(text, 1)

    def cost(ends):
        ideal = overlap + (len(text) - overlap) / max(2, -(-(len(text) - overlap) // (limit - overlap)))
        total, start = 0.0, (0, 0.0)
        for j in ends:
            if at[j] - start[0] > limit or at[j] <= start[0]:
                return float("inf")
            total += start[1] + price[j] + 12.0 * ((at[j] - start[0] - ideal) / ideal) ** 2 + 3.0
            lo = [i for i in range(j + 1) if at[i] >= at[j] - overlap]
            best = min(lo, key=lambda i: (price[i] * 0.5 + 10.0 * (overlap - (at[j] - at[i])) / overlap, i))
            start = at[best], price[best] * 0.5 + 10.0 * (overlap - (at[j] - at[best])) / overlap
        return total

    last = len(at) - 1
    best = min(cost((*c, last)) for k in range(5) for c in combinations(range(1, last), k))
    got = [at.index(b) for _, b in pieces.cut_points(text, limit, overlap, cell=1)]
    assert cost(got) == pytest.approx(best)


def test_pieces_overlap_as_far_as_natural_places_allow():
    rng = random.Random(5)
    for _ in range(20):
        text = "".join("x" * rng.randint(2, 9) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(700))
        natural = pieces.boundaries(text, forced=False)[0]
        assert len(natural) >= 700
        cuts = pieces.cut_points(text, 1920, 160)
        for (a, e), (s, f) in zip(cuts, cuts[1:], strict=False):
            assert s == min(x for x in natural if x > a and x >= e - 160 and f - x <= 1920)


@pytest.mark.parametrize("seed", range(12))
def test_pieces_starts_and_ends_are_chosen_together(seed):
    """The cost of the dynamic programme against every choice of ends and starts, on all places."""
    rng = random.Random(seed)
    text = "".join("x" * rng.randint(1, 4) + rng.choice([" ", ", ", ". ", "\n"]) for _ in range(11))
    at, price = pieces.boundaries(text, forced=False)
    limit, overlap, ideal, n = 14, 5, 12.0, len(text)

    def least(start, end):
        """Over all covers whose next piece starts at ``start`` after an end at ``end``."""
        best = float("inf")
        for j, e in enumerate(at):
            if end < e <= start + limit:
                cost = price[j] + 12.0 * ((e - start - ideal) / ideal) ** 2 + 3.0
                if e < n:
                    cost += min(price[i] * 0.5 + 10.0 * (overlap - e + s) / overlap + least(s, e) for i, s in enumerate(at) if e - overlap <= s <= e)
                best = min(best, cost)
        return best

    assert pieces._cover(at, price, limit, overlap, ideal)[0] == pytest.approx(least(0, 0))


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "x" * 2000, "p"), (2, None, "p"), (3, "", "p"), (4, "short", "p"), (1, "x" * 2000, "p")], "rowid long, text string, piece string")
    got = pieces.split_long(df, "rowid", "text").collect()
    assert {r["rowid"] for r in got} == {1} and len(got) == 4
    assert pieces.split_long(df.limit(0), "rowid", "text").count() == 0


# --- p6
def entities(links):
    out = {}
    for r in links.collect():
        out.setdefault(r["entity"], set()).add(r["spelling"])
    return sorted(map(sorted, out.values()))


def test_organisations(spark):
    names = ["University of Velmor", "Univ. of Velmor", "The University of Velmor", "Velmor, University of", "University of Velmmor", "School of Physics, University of Velmor", "Univeristy of Velmor", "Technical University of Velmor", "TU Velmor", "Velmor Institute of Technology", "Velmor Inst. Tech.", "Velmor Polytechnic", "Velmor Polytech.", "Velmor Film Devices", "Velmor Film Devices Co., Ltd."]
    df = spark.createDataFrame([(n, None if i % 2 else "Velmor") for i, n in enumerate(names * 3)] + [(None, "Velmor"), ("N/A", "Velmor"), ("", None), (" - ", None)], "institution string, city string")
    got = entities(variants.link_organisations(df, "institution", "city"))
    assert got == sorted(map(sorted, [names[:7], names[7:9], names[9:11], names[11:13], names[13:]]))
    assert variants.link_organisations(df.limit(0), "institution", "city").count() == 0


def test_people(spark):
    one = ["William Holerben", "Holerben, William", "W. Holerben", "Bill Holerben", "HOLERBEN William", "Holerben William", "William R. Holerben", "William Holreben"]
    two = ["Mei Holerben", "Holerben, Mei"]
    three = ["Ana Zubur", "A. Zubur", "Zubur, A."]
    rows = [(n,) for n in one[:2] * 5 + one + two * 3 + three * 2 + ["Zubur, Ana", None, "", "unknown", "Otto, William", "Pia, Mei"]]
    got = entities(variants.link_people(spark.createDataFrame(rows, "author string"), "author"))
    assert sorted(one) in got and sorted(two) in got and sorted([*three, "Zubur, Ana"]) in got
    pairs = variants.linked_pairs(spark.createDataFrame([("b", "e"), ("a", "e"), ("c", "f")], "spelling string, entity string")).collect()
    assert [tuple(p) for p in pairs] == [("a", "b")]


def test_near_words_by_index_and_by_joins(spark, monkeypatch):
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 11))) for _ in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    rows = lambda: sorted(tuple(r) for r in variants.near_words(df).collect())
    one = rows()
    allowed = variants._allowed
    assert one == sorted((a, b, edits.distance(a, b)) for a in words for b in words if a != b and edits.distance(a, b) <= min(allowed(len(a)), allowed(len(b))))
    monkeypatch.setattr(variants, "MOST_WORDS", 0)
    assert rows() == one


def test_abbreviations_are_read_by_what_else_is_written(spark):
    names = ["Velmor Film Devices", "Velmor Film Dev.", "Sulbrum Devices Corp", "Sulbrum Dev. Corp", "Ostmar Dev. Inc", "Ostmar Development Inc", "Lorlor Dev.", "Kral Mec. Works", "Development of Ostmar"]
    got = {r["spelling"]: r["entity"] for r in variants.link_organisations(spark.createDataFrame([(n,) for n in names * 2], "institution string"), "institution").collect()}
    assert got["Velmor Film Dev."] == got["Velmor Film Devices"] and got["Sulbrum Dev. Corp"] == got["Sulbrum Devices Corp"] and got["Ostmar Dev. Inc"] == got["Ostmar Development Inc"]
    assert got["Lorlor Dev."].split() == sorted(["devices", "lorlor"]) and "mec" in got["Kral Mec. Works"].split()


def test_edit_distance():
    for a, b, d in [("ab", "ba", 1), ("", "abc", 3), ("kitten", "sitting", 3), ("niger", "nigeria", 2), ("same", "same", 0), ("ca", "abc", 3)]:
        assert edits.distance(a, b) == edits.distance(b, a) == d
    assert edits.distance("aaaa", "bbbb", 1) == 2


# --- p7
def test_canonical(spark):
    ref = spark.createDataFrame([("JPN", "Japan", "JP", ["Nippon", "Nihon"]), ("NER", "Niger", "NE", []), ("NGA", "Nigeria", "NG", None), ("KOR", "South Korea", "KR", ["Republic of Korea", "Korea"]), ("ZAF", "South Africa", "ZA", ["RSA"]), ("USA", "United States", "US", ["U.S.A."]), ("GBR", "United Kingdom", "GB", ["UK"]), ("IRN", "Iran", "IR", []), ("IRQ", "Iraq", "IQ", [])], "iso3 string, name string, iso2 string, other_names array<string>")
    cases = [("Japan", None, "JPN"), ("jpan.", "UNK", "JPN"), ("Osaka, Japan", None, "JPN"), ("Japan (JP)", None, "JPN"), ("Ngier", None, "NER"), ("Nigria", None, "NGA"), ("Soth Koraa", None, "KOR"), ("Unmted Staates", "", "USA"), ("Unite dKingdom", None, "GBR"), ("United", None, "none"),
             ("Europe", "NUL", "none"), (None, "zaf ", "ZAF"), (" ", "KR", "KOR"), ("n/a", "N/A", "none"), ("Ira", "IRQ", "IRQ"), ("Nihon", None, "JPN"), ("UuS.A.", None, "USA"), ("x" * 3000, None, "none"), ("JP", None, "JPN")]
    df = spark.createDataFrame([(str(i), a, b, "clash") for i, (a, b, _) in enumerate(cases)] + [("n", None, None, ""), ("m", " ", "  ", "")], "file string, country string, iso3 string, code string")
    got = {r["key"]: r["ref_code"] for r in canonical.map_to_canonical(df, "file", "country", "iso3", ref).collect()}
    assert got == {str(i): c for i, (_, _, c) in enumerate(cases)}
    assert canonical.map_to_canonical(df.limit(0), "file", "country", "iso3", ref).count() == 0
    cities = spark.createDataFrame([("a", "Velmor"), ("b", "Port Sulbrum")], "id string, label string")
    typed = spark.createDataFrame([(1, "velmor", "x"), (2, "Prt Sulbrum", None), (3, None, "B"), (4, "elsewhere", None), (5, None, None)], "row int, city string, code string")
    assert {r["key"]: r["ref_code"] for r in canonical.map_to_canonical(typed, "row", "city", "code", cities, ("id",), "label", None).collect()} == {1: "a", 2: "b", 3: "b", 4: "none"}


def test_canonical_by_joins_answers_alike(spark, data, monkeypatch):
    geo, ref = table(spark, data, "paper_geo"), table(spark, data, "country_ref")
    rows = lambda: sorted(map(repr, canonical.map_to_canonical(geo, "file", "country", "iso3", ref).collect()))
    one = rows()
    monkeypatch.setattr(canonical, "MOST_NAMES", 0)
    assert rows() == one


# --- p8
@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder("byte_bpe_50k", bpe.FOLDER)


def reference(encoder):
    import public_tokenizers as p
    import tiktoken

    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_encoding_equals_the_library(encoder):
    rng = random.Random(5)
    alphabet = [*map(chr, range(32, 127)), *"äöüßéñ中文字ひらカ한😀‍́\n\t\r\xa0"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|> x", "  a  b \n\n", "a" * 20_000, "ab" * 3000, "don't WE'LL 'tis", ""]
    lib = reference(encoder)
    assert encoder.encode(texts) == [lib.encode_ordinary(t) for t in texts]
    assert encoder.encode([None, ""]) == [[], []]


def test_ids_decode_to_the_text(encoder):
    text = "Der Läufer: 12 µm – 静電フィルム 😀"
    assert b"".join(encoder.bytes_of[i] for i in encoder.encode([text])[0]).decode() == text


def test_ids_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["ids"], r["n"]) for r in df.select("doc_id", bpe.token_ids(F.col("text")).alias("ids"), bpe.token_count(F.col("text")).alias("n")).collect())
    assert [g[2] for g in got] == [2, 2, 0, 0] and got[2][1] == [] and got[3][1] == []


# --- p9
def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, s, rng.randint(1, 50)) for i, s in enumerate(["a"] * 3000 + ["b"] * 400 + ["c"] * 30 + ["out"] * 10)] + [(9000, None, 5), (9001, "a", 0), (9002, "b", None)]
    t = [("m", "a", 2.0, 1), ("m", "b", 1.0, 3), ("m", "c", 0.02, 8), ("m", "none", 1.0, 2), ("m", "out", 0.0, 1), ("n", "b", 5.0, 2), ("n", "c", None, 2)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long").withColumn("h", F.lit("clash"))
    chosen, report = mixing.mix(df, spark.createDataFrame(t, "mix_id string, source string, weight double, max_repeats int"), "doc_id", "source", "tokens")
    shares = {(r["mix_id"], r["source"]): r for r in report.collect()}
    assert len(shares) == len(t) and shares["m", "none"]["actual_share"] == 0 == shares["m", "out"]["tokens"]
    for k in ("a", "b", "c"):
        assert shares["m", k]["actual_share"] == pytest.approx(shares["m", k]["target_share"], abs=0.002)
    rows = chosen.collect()
    assert all(1 <= r["copies"] <= {"a": 1, "b": 3, "c": 8}[r["source"]] for r in rows if r["mix_id"] == "m")
    size = {k: sum(n for _, s, n in docs if s == k and n) for k in "abc"}
    assert sum(r["tokens"] * r["copies"] for r in rows if r["mix_id"] == "n") == 2 * size["b"]
    # every budget is met to within its boundary document
    whole = min(size[k] * m / shares["m", k]["target_share"] for k, m in (("a", 1), ("b", 3), ("c", 8)))
    for k in "abc":
        assert abs(shares["m", k]["tokens"] - shares["m", k]["target_share"] * whole) <= 50


def test_mixing_given_total_and_empty(spark):
    t = spark.createDataFrame([("m", "a", 1.0, 2), ("m", "b", 1.0, 1)], "mix_id string, source string, weight double, max_repeats int")
    df = spark.createDataFrame([(i, "a" if i < 5 else "b", 10) for i in range(50)], "doc_id long, source string, tokens long")
    got = {r["source"]: r["tokens"] for r in mixing.mix(df, t, "doc_id", "source", "tokens", total=600)[1].collect()}
    assert got == {"a": 100, "b": 450}  # a gives all its repeats, b fills up as far as it can
    got = {r["source"]: (r["tokens"], r["binding"], r["unused"]) for r in mixing.mix(df, t, "doc_id", "source", "tokens", total="available")[1].collect()}
    assert got == {"a": (100, True, 0), "b": (400, False, 50)}
    assert {r["source"]: (r["tokens"], r["binding"], r["unused"]) for r in mixing.mix(df, t, "doc_id", "source", "tokens")[1].collect()} == {"a": (100, True, 0), "b": (100, False, 350)}
    chosen, report = mixing.mix(df.limit(0), t, "doc_id", "source", "tokens")
    assert chosen.count() == 0 and report.count() == 2


# --- p10
def test_fit_where_the_texts_lie_is_the_fit_of_the_texts(spark, data):
    docs, rated = table(spark, data.replace("sf0.001", "sf0.01"), "documents"), table(spark, data.replace("sf0.001", "sf0.01"), "level_labels")
    rows = docs.join(rated, "doc_id").where("text is not null").orderBy(F.xxhash64("doc_id")).select("text", "level").collect()
    one, two = reading.fit([r[0] for r in rows], [r[1] for r in rows]), reading.fit_on(docs, rated, "doc_id", "text", "level")
    assert one.familiar == two.familiar and one.levels == two.levels and all((a[2].round(6) == b[2].round(6)).all() for a, b in zip(one.fits, two.fits, strict=True))
    assert reading.fit_on(docs, rated.limit(0), "doc_id", "text", "level").fits == []


def test_syllables():
    want = {"cat": 1, "table": 2, "make": 1, "making": 2, "electrode": 3, "idea": 3, "polarisation": 5, "measured": 2, "wanted": 2, "the": 1, "rhythm": 1, "area": 3, "simple": 2, "jumped": 1, "x": 1}
    wrong = {w: reading.syllables(w) for w, n in want.items() if abs(reading.syllables(w) - n) > (1 if w in ("idea", "area") else 0)}
    assert not wrong


def test_reading_rows(spark):
    easy, hard = "The cat sat. It ran. We see it. " * 20, "Notwithstanding thermodynamically inconsistent polarisation phenomena, electromechanical susceptibility predominates. " * 20
    df = spark.createDataFrame([(1, easy), (2, hard), (3, None), (4, ""), (5, " 12 !!"), (6, "静電フィルムの力。" * 30), (1, easy)], "doc_id long, text string").withColumn("words", F.lit("clash"))
    got = {r["doc_id"]: r["reading"] for r in reading.read_levels(df, "text", reading.Scale()).collect()}
    assert got[1]["level"] == 1 and got[2]["level"] == 4 and got[1]["grade"] < got[2]["grade"]
    assert all(got[i]["grade"] is None and got[i]["level"] is None for i in (3, 4, 5)) and got[6]["grade"] is not None
    assert reading.read_levels(df.limit(0), "text", reading.Scale()).count() == 0
    assert reading.fit([], []).fits == [] == reading.fit([easy], [1]).fits
    assert [r[0] for r in reading.read_levels(df.where("doc_id < 3"), "text", reading.fit([easy, hard] * 5, [1, 4] * 5)).select("reading.level").distinct().orderBy("level").collect()] == [1, 4]
