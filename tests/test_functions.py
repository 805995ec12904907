import math
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dapple.functions import normalize as N
from dapple.functions import stats as S


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()


def test_chi2_tail(spark):
    rows = [(3.841458821, 1), (11.07049769, 5), (5.991464547, 2), (0.0, 3), (1e6, 3000), (1.0, 0), (None, 2)]
    got = [r.p for r in one(spark, rows, "x double, k int", p=S.chi2_sf(F.col("x"), F.col("k")))]
    assert got[:5] == pytest.approx([0.05, 0.05, 0.05, 1.0, 0.0], abs=1e-8) and got[5:] == [None, None]


def bh(p):
    known = sorted((x for x in p if x is not None), reverse=True)
    n, best, out = len(known), 1.0, {}
    for i, x in enumerate(known):
        best = min(best, n / (n - i) * x)
        out[x] = best
    return [None if x is None else out[x] for x in p]


def test_bh(spark):
    p = [0.01, 0.04, None, 0.03, 0.005, 0.9, 0.04]
    df = spark.createDataFrame([(i, "g", x) for i, x in enumerate(p)], "i int, g string, p double")
    got = [r.p_adj for r in S.with_bh(df, "p", ["g"]).orderBy("i").collect()]
    assert [None if x is None else round(x, 12) for x in got] == [None if x is None else round(x, 12) for x in bh(p)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=1, max_size=12))
def test_concentration(spark, xs):
    got = spark.createDataFrame([(None if x is None else float(x),) for x in xs], "x double").agg(S.concentration("x").alias("b")).first().b
    v = np.array([x for x in xs if x is not None], float)
    if v.sum() <= 0:
        assert got is None
    else:
        q = v[v > 0] / v.sum()
        assert got == pytest.approx(0.0 if len(v) <= 1 else 1 + (q * np.log(q)).sum() / math.log(len(v)), abs=1e-9)


def test_parts_and_intervals(spark):
    rows = [(2.0, 1.0), (0.0, 0.0), (1.0, 0.0), (None, 1.0)]
    assert [r.c for r in one(spark, rows, "o double, e double", c=S.chi_part(F.col("o"), F.col("e")))] == [1.0, 0.0, None, None]
    low, high = S.wilson(F.col("k"), F.col("n"))
    got = one(spark, [(5, 10), (0, 0)], "k int, n int", low=low, high=high)
    assert (got[0].low, got[0].high) == pytest.approx((0.2366, 0.7634), abs=1e-4) and tuple(got[1]) == (0.0, 0.0)
    assert [r.x for r in one(spark, [(0.125,), (1.015,), (2.5,)], "x double", x=S.half_even(F.col("x"), 2))] == [np.round(x, 2) for x in (0.125, 1.015, 2.5)]


def test_arms(spark):
    cols = [F.col(c) for c in ("a", "n", "b", "m")]
    test = S.three_arms([(cols[0], cols[1]), (cols[2], cols[3])])
    got = one(spark, [(5, 10, 5, 10), (0, 10, 0, 10), (5, 10, 1, 0), (9, 10, 1, 10)], "a int, n int, b int, m int", s=test["chisq_stat"], d=test["df"])
    assert [(round(r.s, 6), r.d) for r in got] == [(0.0, 1), (0.0, 1), (0.0, 0), (12.8, 1)]


CASES = {
    "label_key": [("  Hair-Color  x ", "hair_color_x"), (None, ""), ("__a__b_", "a_b"), ("", "")], "title_case": [("hair_color", "Hair_Color"), ("a1b", "A1B")],
    "simple": [("Dark-Blue_x!", "dark blue x"), (None, "")], "slug": [("Ärger & Co.", "ärger-co"), ("--", "value"), (None, "value")], "gender": [("a female", "female"), ("male", "male"), ("x", "unknown")],
    "presence": [("with hat", "yes"), ("without", "no"), ("banana", "unknown"), ("off", "unknown")], "garment": [("work_shirt", "shirt"), ("t_shirt", "t-shirt"), ("coat or vest", "coat"), ("denim overalls", "overalls")],
    "object_type": [("mop group", "mop"), ("cleaning tools", "cleaning tool"), ("set items", "set")], "dimension_key": [("appearance.hair.color", "hair_color"), ("clothing.by_garment_type.coat", "clothing_garment"), (" ", "unknown"), ("New Thing", "new_thing")],
    "activities": [("Activity: run", ": run"), ("activities", "")], "activity_family": [("location_2", "Location substitution"), ("ALL_TYPES", "All activity types"), ("paraphrase", "Semantic rephrasing"), ("other", "other")],
    "family": [("hair_color", "People"), ("dominant_thing", "Dominant_Thing"), ("image_weather", "People")], "short_context": [("CA_Rel", "CA-R"), ("Else", "Else")], "file_name": [("a b/c", "a_b_c"), ("__", "role")],
    "structured": [("Size=Big,small|Color = Red", "size=big,small|color=red")],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_normalisers(spark, name):
    rows = CASES[name]
    got = one(spark, [(x,) for x, _ in rows], "x string", y=getattr(N, name)(F.col("x")))
    assert [r.y for r in got] == [y for _, y in rows]


def test_label_dispatch(spark):
    rows = [("objects", "object_counts_by_position", "item: x; left foreground", "foreground left"), ("people", "gender_presentation", "Female", "female"), ("scene", "palette", "dark grey sky", "gray"), ("scene", "mood", "calm mood", "calm"), ("scene", "mood", "", "unknown"), ("people", "activities", " activity ", "unknown"), ("camera", "framing", "n/a", "unknown"), ("x", "lamps", "natural", "unknown")]
    got = one(spark, rows, "c string, d string, l string, w string", y=N.label(F.col("c"), F.col("d"), F.col("l")), w=F.col("w"))
    assert [r.y for r in got] == [r.w for r in got]


def test_accents_and_lemmas(spark):
    texts = ["Éclair du Jour", "ﾊﾞｽ", "ÀÇñőŁß", "été", "The Boxes of glass, gas-lamps", "Ёлка", None, ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.strip_accents(F.col("t")).alias("s"), N.snake(F.col("t")).alias("k"), N.norm_text(F.col("t")).alias("n")).collect()
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert [r.s for r in got] == [None if t is None else plain(t) for t in texts]
    assert got[4].k == "the_boxes_of_glass_gas_lamps" and got[4].n == "boxe glass gas lamp" and got[6].k == got[6].n == ""


def test_cells_and_medians(spark):
    rows = [(93.25, 0.725), (93.35, 0.125), (None, None), (0.04, 1.0), (100.0, 0.0)]
    got = spark.createDataFrame(rows, "a double, p double").select(N.robustness_cell(F.col("a"), F.col("p")).alias("r"), N.prevalence_cell(F.col("a")).alias("b"), N.percent_p(F.col("p")).alias("p")).collect()
    text = lambda x, n: "nan" if x is None else f"{x:.{n}f}"
    assert [r.r for r in got] == [f"{text(a, 1)}/{text(p, 2).removeprefix('0')}" for a, p in rows]
    assert [r.b for r in got] == ["" if a is None else f"{a:.1f}" for a, _ in rows] and [r.p for r in got] == [".72", ".12", "", "1.00", ".00"]
    rng = np.random.default_rng(2)
    data = [("ab"[i % 2], "xy"[i % 3 > 0], float(v) if i % 7 else None) for i, v in enumerate(rng.choice([0.5, 1.25, 3.0, 3.1, 50.0, *rng.random(20)], 301))]
    found = {(r._set, r.g, r.h): r.median for r in S.medians(spark.createDataFrame(data, "g string, h string, v double"), "v", [["g", "h"], ["g"], []]).collect()}
    for key, pick in ((("a", "x"), lambda r: r[:2] == ("a", "x")), (("b", None), lambda r: r[0] == "b"), ((None, None), lambda r: True)):
        assert found[(2 - sum(k is not None for k in key), *key)] == pytest.approx(np.median([r[2] for r in data if pick(r) and r[2] is not None]))
