"""Operators against noise made here, where the truth is known."""

import random

from pyspark.sql import functions as F

from tarnwood.llm import canonical, scans, variants
from tarnwood.sources.tables import table

WORDS = "electrode pitch flexible stator measured charge amplifier dielectric layer limits thrust density nitrogen experiment voltage surface potential bonding humidity chamber relaxation actuator friction coefficient breakdown insulation wiring reference specimen".split()
SWAPS = [("n", "ri"), ("m", "rn"), ("d", "cl"), ("e", "c"), ("t", "f"), ("i", "l"), ("h", "li"), ("u", "ii"), ("l", "1"), ("o", "0"), ("s", "5"), ("a", "@")]


def test_scan_noise_put_in_is_found(spark):
    rng = random.Random(3)
    rows, truth = [], set()
    for i in range(400):
        file, page = f"{i // 20:07d}_Long stroke film drive number_.pdf", i % 20 + 1
        words = [rng.choice(WORDS) for _ in range(90)]
        lines, n = [], 0
        while n < len(words):
            line = words[n : n + 9]
            n += 9
            lines.append(line)
        text = [" ".join(x) for x in lines]
        if i >= 100:  # scanned files
            for k in rng.sample(range(len(text)), 3):
                w = lines[k][4]
                spots = [(a, b) for a, b in SWAPS if a in w]
                if len(w) > 5 and spots:
                    a, b = rng.choice(spots)
                    text[k] = " ".join([*lines[k][:4], w.replace(a, b, 1), *lines[k][5:]])
                    truth.add((i, k, "char"))
            k = rng.randrange(len(text) - 1)
            w = lines[k][-1]
            text[k], text[k + 1] = text[k][: -len(w)] + w[:3] + "-", w[3:] + " " + text[k + 1]
            truth.add((i, k, "hyphen"))
            at = rng.randrange(1, len(text))
            text[at:at] = [f"{page + 40}", "LONG STROKE FILM DRIVE"]
            moved = {(i, k + 2 * (k >= at), kind) for (j, k, kind) in truth if j == i}
            truth = {t for t in truth if t[0] != i} | moved | {(i, at, "pageno"), (i, at + 1, "header")}
        rows.append((i, file, str(page), "\n".join(text), "Long stroke film drive number"))
    df = spark.createDataFrame(rows, "rowid long, file string, page string, text string, title string")
    got = {(r["rowid"], r["line_no"] - 1, r["kind"]) for r in scans.find_noise(df, "rowid", "text", "file", "page", "title").collect()}
    assert len(got & truth) > 0.98 * len(truth) and len(got & truth) > 0.98 * len(got)


def typo(rng, w):
    i = rng.randrange(1, len(w) - 1)
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rng.choice("aeiou") + w[i + 1 :]])


def test_mistyped_countries_are_mapped(spark, data):
    rng = random.Random(4)
    ref = table(spark, data, "country_ref")
    names = [(r["iso3"], r["name"]) for r in ref.collect() if len(r["name"]) > 6]
    cases = []
    for i in range(300):
        code, name = rng.choice(names)
        words = name.split()
        k = max(range(len(words)), key=lambda j: len(words[j]))
        words[k] = typo(rng, words[k])
        cases.append((str(i), rng.choice(["{}", "{}.", "Sulbrum, {}", "{} / Ostmarum"]).format(" ".join(words)), rng.choice([None, "UNK", ""]), code))
    df = spark.createDataFrame([c[:3] for c in cases] + [(f"n{i}", v, None) for i, v in enumerate(["Atlantis", "at sea", "Northern hemisphere", "?"])], "file string, country string, iso3 string")
    got = {r["key"]: r["ref_code"] for r in canonical.map_to_canonical(df, "file", "country", "iso3", ref).collect()}
    assert sum(got[k] == code for k, _, _, code in cases) >= 0.98 * len(cases)
    assert all(got[f"n{i}"] == "none" for i in range(4))


def test_mistyped_people_are_linked(spark):
    rng = random.Random(6)
    syllables = "ba bra dal fer gan hes jor kel lum mar nov pel rik sul tor vin wol zan".split()
    given = "William Mei Theodore Noémie Katherine Jürgen Patricia Haruto".split()
    people = [(rng.choice(given), "".join(rng.choices(syllables, k=4)).capitalize()) for _ in range(150)]
    rows, owner = [], {}
    for p, (g, f) in enumerate(people):
        forms = [f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{f}, {g[0]}.", f"{g} {f.upper()}"]
        if rng.random() < 0.5:
            forms.append(f"{g} {typo(rng, f).capitalize()}")
        for n, s in enumerate(forms):
            owner.setdefault(s, p)
            rows += [(s,)] * (6 if n == 0 else rng.randint(1, 3))
    got = {r["spelling"]: r["entity"] for r in variants.link_people(spark.createDataFrame(rows, "author string"), "author").collect()}
    assert got.keys() == owner.keys()
    pairs = lambda of: {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    want, have = pairs(owner), pairs(got)
    assert len(want & have) >= 0.98 * len(want) and len(want & have) >= 0.98 * len(have)


def test_every_link_is_symmetric_in_words(spark):
    """The same spelling given twice, or with other white space, is one spelling."""
    df = spark.createDataFrame([("Univ. of  Velmor",), (" Univ. of Velmor ",), ("University of Velmor",)], "institution string")
    got = variants.link_organisations(df, "institution").collect()
    assert len(got) == 2 and len({r["entity"] for r in got}) == 1
    assert variants.linked_pairs(variants.link_organisations(df, "institution")).select(F.struct("name_a", "name_b")).count() == 1
