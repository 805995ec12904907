import json

import pytest
from pyspark.sql import functions as F

from dapple.operators import rollup as R
from dapple.runtime import clean, exists, fresh_folder
from dapple.sources import paths as P

FILES = [
    "m/Context-free_CF/baker/a_photo/1.PNG", "m/Context-free_CF/baker/a_photo/2.jpg", "m/Context-free_CF/baker/a_photo/manifest.json", "m/x/p/prompt/images.json", "m/x/p/prompt/manifest.json", "m/x/q/prompt/images.json", "m/x/r/b.json",
    "m/x/r/a.json", "m/x/s/note.txt", "CA R/top.png", "agg/aggregation_counting/a.csv", "agg/aggregation_counting/out/b.csv", "own/aggregation_counting/c.csv", "agg/frequencies.CSV", "agg/metadata.json",
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(f,) for f in FILES], "path string")


def test_manifests(spark, files):
    assert {r.folder for r in P.prompt_folders(files).collect()} == {"m/Context-free_CF/baker/a_photo", "m/x/p/prompt"}
    assert P.prompt_folders(files, chosen=["m/x/p/prompt"]).count() == 1
    folders = spark.createDataFrame([(f,) for f in ("m/Context-free_CF/baker/a_photo", "m/x/p", "m/x/q", "m/x/r", "m/x/s")], "folder string")
    lists = spark.createDataFrame([("m/x/r/b.json",), ("m/x/r/a.json",)], "path string")
    got = {r.folder: r.manifest for r in P.manifest_of(folders, files, lists).collect()}
    assert got == {"m/Context-free_CF/baker/a_photo": "m/Context-free_CF/baker/a_photo/manifest.json", "m/x/p": "m/x/p/prompt/manifest.json", "m/x/q": "m/x/q/prompt/images.json", "m/x/r": "m/x/r/a.json", "m/x/s": None}
    rows = {r.relpath: r for r in P.build_manifest(files).collect()}
    assert set(rows) == {FILES[0], FILES[1], "CA R/top.png"}
    assert (rows[FILES[0]].id, rows[FILES[0]].prompt_used, rows[FILES[0]].role, rows[FILES[0]].context) == ("1", "a photo", "baker", "CF") and rows["CA R/top.png"].context == ""


def test_image_paths(spark, files):
    rows = [(1, FILES[0], None, None, None), (2, "gone", "2.jpg", "m/Context-free_CF/baker/a_photo", None), (3, "", "elsewhere/2.jpg", "m/Context-free_CF/baker/a_photo", None), (4, None, None, "m/Context-free_CF/baker/a_photo", "1.PNG"), (5, None, "no.png", "", None)]
    records = spark.createDataFrame(rows, "id bigint, abspath string, relpath string, folder string, filename string")
    assert {r.id: r.path for r in P.resolved_images(records, files, "id").collect()} == {1: FILES[0], 2: FILES[1], 3: FILES[1], 4: FILES[0], 5: None}


def test_names_and_filters(spark, files):
    names = ["x/web_developer_SDXL.csv", "y\\nurse_3.5.csv", "z/plain_role.csv", "solo.csv"]
    got = [tuple(r.p) for r in spark.createDataFrame([(n,) for n in names], "n string").select(P.role_and_model(F.col("n")).alias("p")).collect()]
    assert got == [("web_developer_SDXL", "web developer", "SDXL"), ("nurse_3.5", "nurse", "3.5"), ("plain_role", "plain role", ""), ("solo", "solo", "")]
    assert {r.path for r in P.source_files(files, "aggregation_counting", ("own",)).collect()} == {"agg/aggregation_counting/a.csv"}
    assert {r.path for r in P.exported_files(files).collect()} == {f for f in FILES if f.lower().endswith((".json", ".csv")) and not f.endswith(("manifest.json", "metadata.json"))}


def test_required_fields_reports_and_scaffold(spark, files, tmp_path):
    assert P.required_fields(files, ["path"]) is files
    for bad in (files.limit(0), files.withColumnRenamed("path", "p")):
        with pytest.raises(ValueError):
            P.required_fields(bad, ["path"])
    texts = spark.createDataFrame([("{\"cohorts\": null}",), ("{\"a\": 1}",), ("[1]",), ("{",), (None,)], "t string")
    assert P.summary_reports(texts, "t").count() == 1
    path = P.scaffold(spark, f"file://{tmp_path}", "s1", "a text")
    made = json.loads((tmp_path / "s1" / "manifest.json").read_text())
    assert path.endswith("/s1/manifest.json") and made["scenario"] == "a text" and (tmp_path / "s1" / "images").is_dir() and P.scaffold(spark, f"file://{tmp_path}", "s1", "b") == path
    assert {r.path for r in P.listing(spark, f"file://{tmp_path}").collect()} == {"s1/manifest.json"}


def test_folders_are_cleaned(spark):
    keep, gone = fresh_folder(spark, "keep"), fresh_folder(spark, "gone")
    for p in (keep, gone):
        spark.range(1).write.parquet(p)
    assert clean(spark, (keep,)) >= 1 and exists(spark, keep) and not exists(spark, gone)


def test_every_general_attribute(spark):
    rows = [("other" if c == "*" else c, d, f"{c}-{d}", 1) for c, d in R.GENERAL] + [("x", "y", "z", 5)]
    got = {r.label: (r.cohort, r.dimension, r.ordinal) for r in R.general_attributes(spark.createDataFrame(rows, "cohort string, dimension string, label string, count bigint")).collect()}
    assert got == {f"{c}-{d}": ("people" if c == "*" else c, name, R.GENERAL_ORDER.index(name) + 1) for (c, d), name in R.GENERAL.items()}
    assert len(R.GENERAL) == 64 and len(R.GENERAL_ORDER) == 38 == len(set(R.GENERAL_ORDER)) and set(R.GENERAL.values()) == set(R.GENERAL_ORDER)


def test_count_documents_of_both_forms(spark):
    docs = [
        (1, {"camera": {"framing": {"tight": 2, "wide": 3.7}, "tilt": 4}, "odd": 5, "totals": {"images": {"images": 9}}}), (2, {"camera_framing": {"tight": 1}, "scene_mood": {"calm": 2, "x": "no"}, "other": {"a": {"b": 1}}, "totals": {"images": 7, "people_instances": {"p": 2}}}), (3, [1]),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs] + [(4, None), (5, "{")], "id bigint, t string")
    got = {tuple(r) for r in R.cohort_counts(df, "id", "t").collect()}
    assert got == {
        (1, "camera", "framing", "tight", 2), (1, "camera", "framing", "wide", 3), (1, "camera", "tilt", "tilt", 4), (1, "totals", "images", "images", 9), (2, "camera", "framing", "tight", 1), (2, "scene_appearance", "mood", "calm", 2),
        (2, "totals", "images", "images", 7), (2, "totals", "people_instances", "p", 2),
    }
