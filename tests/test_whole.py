"""The queries do the whole job: no replicates, rows or groups are left out."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dapple import plans
from dapple.operators import prompts as P
from dapple.operators import similar as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["b02_b03_x12_family_differences", "b04_headline", "b05_dimension_differences"])
def test_intervals_take_all_replicates(spark, name):
    rows = plans.queries()[name](spark, SF).collect()
    assert rows and {r.n_replicates for r in rows} == {1000}


def _pairs(spark):
    """Pairs of an activity and an item by role and bucket: as many as there are of the rarer."""
    seen = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/role_rollup.parquet").where("context IN ('CA-R', 'CA-U') AND label IS NOT NULL AND dimension IN ('activities', 'items')").collect():
        seen[(r.occupation and r.occupation.replace("_", " "), r.context, r.dimension)].add(r.label)
    return {(o, c): min(len(seen[(o, c, "activities")]), len(seen[(o, c, "items")])) for o, c, _ in list(seen)}


def test_banks_keep_every_pair(spark):
    pairs, queries = _pairs(spark), plans.queries()
    assert max(pairs.values()) > 4
    assert queries["e02_f07_x51_scored_items"](spark, SF).count() == sum(pairs.values())
    prompts = queries["e01_x52_prompts"](spark, SF)
    assert prompts.count() == sum(1 + 2 * n for n in pairs.values() if n)
    assert queries["u05_w05_first_prompts"](spark, SF).count() == prompts.select("prompt").distinct().count()


def test_image_plan_has_all_images_unless_told(spark):
    prompts = spark.range(300).select(F.concat(F.lit("a photo of "), "id").alias("prompt"))
    assert P.image_plan(prompts).count() == 300 * P.SEEDS and P.image_plan(prompts, 30).count() == 30
    queries = plans.queries()
    assert queries["e03_x66_image_plan"](spark, SF).count() == P.SEEDS * queries["u05_w05_first_prompts"](spark, SF).count()


def test_cleaning_takes_every_context(spark):
    out = plans.queries()["c01_c02_c03_z07_semantic_clean"](spark, SF).persist()
    assert {r.context for r in out.select("context").distinct().collect()} >= {"CF", "CA-R", "CA-U"}
    rows = spark.read.parquet(f"{SF}/role_rollup.parquet")
    alone = S.semantic_clean(rows.where("context = 'CF'"), ["cohort", "dimension"]).collect()
    assert Counter(map(tuple, out.where("context = 'CF'").drop("context").collect())) == Counter(map(tuple, alone))
    out.unpersist()


def test_dirty_dimension_names_have_rows(spark):
    got = {(r.cohort, r.dimension): r.key for r in plans.queries()["x35_x36_x46_dimension_names"](spark, SF).collect()}
    raw = spark.read.parquet(f"{SF}/rollup_raw.parquet").where("dimension IS NOT NULL AND cohort IS NOT NULL").select("cohort", "dimension").distinct().collect()
    assert set(got) == {(r.cohort, r.dimension) for r in raw}
    dirty = {d: k for (_, d), k in got.items() if re.search("[^A-Za-z_ ]", d)}
    assert dirty and all(re.fullmatch("[0-9a-z]+(_[0-9a-z]+)*", k) for k in dirty.values())


@pytest.mark.parametrize(("name", "key", "column", "condition"), [
    ("k03_nested_counts", "dimension", "dimension", "label IS NOT NULL"), ("k02_count_rows", "dimension", "dimension", "true"), ("f14_final_columns", "Label", "label", "label IS NOT NULL"),
    ("c12_collapse", "dimension", "dimension", "label IS NOT NULL AND count IS NOT NULL"), ("x08_wilson", "dimension", "dimension", "label IS NOT NULL"),
])
def test_no_dimension_is_left_out(spark, name, key, column, condition):
    got = {r[0] for r in plans.queries()[name](spark, SF).select(key).distinct().collect()}
    want = {r[0] for r in spark.read.parquet(f"{SF}/role_rollup.parquet").where(condition).select(column).distinct().collect()}
    assert got == want and len(want) > 3


def test_count_rows_of_every_role(spark):
    rows = spark.read.parquet(f"{SF}/role_rollup.parquet")
    assert plans.queries()["k02_count_rows"](spark, SF).count() == rows.select("source_file", "cohort", "dimension", "label").distinct().count()


def test_reports_count_groups_and_attributes(spark):
    rows = plans.queries()["a27_r03_f13_report_counts"](spark, SF).collect()
    assert {r.source for r in rows} == {"group", "attribute"}
