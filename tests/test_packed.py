import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwood.operators import packed

CASES = [
    ("Friedrich Hoku", ["Friedrich Hoku"]),
    ('"Doe, Jane", "Li, W."', ["Doe, Jane", "Li, W."]),
    ('["A B", "C, D"]', ["A B", "C, D"]),
    ("Luyor, J., Pan, R., & Tol, P.", ["Luyor, J.", "Pan, R.", "Tol, P."]),
    ("A. Bee, C. Dee and E. Eff", ["A. Bee", "C. Dee", "E. Eff"]),
    ("A. Bee, C. Dee, and E. Eff et al.", ["A. Bee", "C. Dee", "E. Eff"]),
    ("Dalmu, Noémie;; Kes, F.;", ["Dalmu, Noémie", "Kes, F."]),
    ("A Bee | C Dee", ["A Bee", "C Dee"]),
    ("A Bee、C Dee；E Eff", ["A Bee", "C Dee", "E Eff"]),
    ("A Bee\nC Dee", ["A Bee", "C Dee"]),
    ("  Amina   Nar ", ["Amina Nar"]),
    ("Doe, Jane; X. Y. Zed, Q Ray", ["Doe, Jane", "X. Y. Zed", "Q Ray"]),
    ("A Bee; and others", ["A Bee"]),
    ("et al.", []),
    ('a "b c', ['a "b c']),
    ("Foo [Bar; Baz] Qux; Z W", ["Foo [Bar; Baz] Qux", "Z W"]),
    (r"A\;B; C D", ["A;B", "C D"]),
    ('"say ""hi"" now"; B C', ['say "hi" now', "B C"]),
    ("Sandra Anders and Anderson, Andy", ["Sandra Anders", "Anderson, Andy"]),
    (";;;", []),
    ("", []),
    (None, []),
    (" \t\n", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_split(text, want):
    assert packed.split_values(text) == want


def test_plain_values_keep_every_comma():
    assert packed.split_values("a, b; 'c d', e and f", names=False) == ["a", "b", "'c d'", "e and f"]


def test_very_long_field():
    names = [f"A{i}x Bee" for i in range(20_000)]
    assert packed.split_values("; ".join(names)) == names


def test_unpack_rows(spark):
    df = spark.createDataFrame([("f", "A Bee; C Dee", 1), ("f", "A Bee; C Dee", 2), ("g", None, 1), ("h", "", 1)], "file string, authors string, pos int")
    got = [tuple(r) for r in packed.unpack(df, "authors", ["file"], out="author").collect()]
    assert sorted(got) == [("f", 1, "A Bee"), ("f", 2, "C Dee")]
    assert packed.unpack(df.limit(0), "authors", ["file"]).count() == 0


FAMILY = ["Doe", "Li", "Ångström", "O'Hara", "Kuroda", "Smith-Jones", "Žižek"]
GIVEN = ["Jane", "Wei", "J.", "J. R.", "Noémie", "K"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(GIVEN), st.sampled_from(FAMILY), st.booleans()), min_size=1, max_size=8), st.sampled_from(["; ", ";", " | ", "\n", "；", "json", "csv", " / ", "comma", "and"]), st.sampled_from(["", " et al.", ", et al.", "; and others"]))
def test_round_trip(people, style, tail):
    """Lists packed in every style come back as they were."""
    turned = [f"{f}, {g}" if t and style not in ("comma", "and") else f"{g} {f}" for g, f, t in people]
    if style == "json":
        assert packed.split_values("[" + ", ".join(f'"{n}"' for n in turned) + "]") == turned
    elif style == "csv":
        assert packed.split_values(",".join(f'"{n}"' for n in turned) + tail) == turned
    elif style == "comma":
        assert packed.split_values(", ".join(turned) + tail) == turned
    elif style == "and":
        assert packed.split_values((", ".join(turned[:-1]) + ", and " if turned[1:] else "") + turned[-1] + tail) == turned
    else:
        assert packed.split_values(style.join(turned) + tail) == turned
