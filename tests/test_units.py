import pytest
from hypothesis import given
from hypothesis import strategies as st

from tarnwood.operators import units

CASES = [
    ("thrust", 828.0, "mN", None, 0.828), ("thrust", 1.0, "kgf", None, 9.80665), ("thrust density", 15.0, "kN/m²", None, 1.5), ("thrust_density", 20.0, "kPa", None, 2.0),
    ("speed", 0.5, "m/s", None, 500.0), ("speed", 3.6, "km/h", None, 1000.0), ("Speed", 5.0, "µm/s", None, 0.005), ("speed", 5.0, "μm/s", None, 0.005), ("max. speed", 2.0, "mm s-1", None, 2.0),
    ("speed", 1.0, "in/s", None, 25.4), ("speed", 60.0, "m/min", None, 1000.0), ("thrust", 5.0, "10^-3 N", None, 0.005), ("thrust", 5.0, "×10⁻³ N", None, 0.005), ("thrust", 5.0, "x1e-3 N", None, 0.005),
    ("thrust", 5.0, "m N", None, 0.005), ("thrust", 5.0, "n", None, 5.0), ("thrust", 5.0, "milli-newton", None, 0.005), ("THRUST [mN]", 5.0, None, None, 0.005), ("thrust in kN", 5.0, "-", None, 5000.0),
    ("thrust, gf", 1000.0, "", None, 9.80665), ("holding force", 2.0, None, "values in mN", 0.002), ("thrust", 2.0, None, "two-phase drive, in mN", 0.002), ("thrust", 2.0, None, "reported 2 mN, gap 40 um", 0.002),
    ("thrust", 2.0, None, "[mN] gap 40 um", 0.002), ("thrust", 2.0, "N", "values in mN", 2.0), ("efficiency", 0.4, "ratio", None, 40.0), ("efficiency", 400.0, "‰", None, 40.0), ("Efficiency (%)", 40.0, None, None, 40.0), ("shear stress", 1.0, "psi", None, 6.894757293168361),
    ("normal pressure", 1.0, "bar", None, 100.0), ("thrust density", 1.0, "N per square cm", None, 1.0), ("thrust density", 1.0, "kilonewton per square metre", None, 0.1), ("normal pressure", 1.0, "10^3 Pa", None, 1.0),
]
NONE = [
    ("thrust", 5.0, None, "target was 3 N"), ("thrust", 5.0, None, "gap 40 um"), ("thrust", 5.0, None, "oil filled, 2.7 kV"), ("thrust", 5.0, "kPa", None), ("efficiency", 230.0, "%", None), ("efficiency", 40.0, None, None),
    ("thrust", 0.0, "N", None), ("thrust", -1.0, "N", None), ("thrust", None, "N", None), ("thrust", float("nan"), "N", None), ("mass", 5.0, "g", None), ("thrust", 5.0, "foo", "values in N"), ("thrust", 5.0, "a.u.", None),
    (None, 5.0, "N", None), ("thrust", 5.0, "g", None), ("speed", 5.0, "rpm", None),
]


@pytest.mark.parametrize("metric,value,unit,note,want", CASES)
def test_converted(metric, value, unit, note, want):
    assert units.to_common(metric, value, unit, note)[1] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("metric,value,unit,note", NONE)
def test_no_case(metric, value, unit, note):
    assert units.to_common(metric, value, unit, note) is None


def test_scale_with_offset():
    f, o, d = units.parse_unit("°C")
    assert d == units.TEMPERATURE and float((20 + o) * f) == 293.15


@given(st.text(max_size=40))
def test_any_text_parses_or_not(text):
    units.parse_unit(text)
    units.note_unit(text)
    units.parse_metric(text)


@given(st.sampled_from(["N", "mN", "kPa", "mm/s"]), st.floats(1e-6, 1e9))
def test_round_trip(unit, value):
    f, o, _ = units.parse_unit(unit)
    from fractions import Fraction as Q

    assert float((Q(value) + o) * f / f - o) == pytest.approx(value)


def test_rows(spark):
    df = spark.createDataFrame([(1, "thrust", 5.0, "mN", None, "x"), (2, None, None, None, None, None), (3, "thrust", 5.0, "mN", None, "x")], "id int, metric string, value double, unit string, note string, common string")
    got = {r["id"]: r["__common"] for r in units.normalise(df).collect()}
    assert got[1]["common"] == got[3]["common"] == 0.005 and got[2]["common"] is None
    assert units.normalise(df.limit(0)).count() == 0
