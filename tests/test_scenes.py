import json

import numpy as np
import pytest

from dapple.operators import scenes as S
from dapple.operators.similar import token_set_ratio

DOC = {
    "atmosphere": {"mood": ["Calm", "calm "], "dominant_palette": ["Navy", "dark-red"], "lighting_profile": {"color_temperature": "Warm", "aesthetic_qualities": "retro"}},
    "environment": {"indoor_outdoor": "indoor", "surfaces": {"walls": [{"material": "bricks", "color": ["white", None]}], "floor": [{"finish": "matte"}]}, "spatial_layout": {"depth": "deep"}},
    "people": {"persons": [{"gender_presentation": "Female", "hair": {"present": "yes", "type": "braids", "color": "black"}, "eyewear": {"type": "goggles", "frame_color": "red"}, "plane": "foreground", "clothing": [{"garment_type": "coats", "color": "blue"}, {"material": "wool"}]}, {"pose": "sitting"}]},
    "objects": [{"type": "mops", "subtype": "wet mop", "plane": "foreground", "side": "left", "attributes": {"colors": ["red", "blue"], "material": "wood"}, "quantity": {"exact": 2, "approx": "few"}}, {"type": "mop", "quantity": {"exact": "x"}}, {}],
    "texts": [{"content": "exit", "font_style": ["bold", "serif"], "plane": "background"}], "camera": {"angle": "high", "crop": ["tight", ""]},
    "lighting": {"sources": [{"type": "lamp", "count": "two", "directionality": ["left", "top"]}], "shadows": "soft"}, "safety": {"hazards": ["cables"]}, "uncertainty": "hands",
}


@pytest.fixture(scope="module")
def counts(spark):
    docs = spark.createDataFrame([(json.dumps(DOC), "clash"), (None, None), ("{\"cut", None), ("[1]", None), ("{}", None)], "scene string, value string").repartition(2)
    return S.SceneCounts(docs, embed=None)


def test_values_by_path(counts):
    got = {(r.path, r.value): r["count"] for r in counts.value_counts().collect()}
    assert got == {
        ("atmosphere.mood", "calm"): 2, ("atmosphere.dominant_palette", "navy"): 1, ("atmosphere.dominant_palette", "dark_red"): 1, ("atmosphere.lighting_profile.color_temperature", "warm"): 1,
        ("atmosphere.lighting_profile.aesthetic_qualities", "retro"): 1, ("environment.indoor_outdoor", "indoor"): 1, ("environment.surfaces.walls.material", "brick"): 1, ("environment.surfaces.walls.color", "white"): 1,
        ("environment.surfaces.floor.finish", "matte"): 1, ("environment.spatial_layout.depth", "deep"): 1, ("people.demographics.gender_presentation", "female"): 1, ("people.appearance.hair.present", "yes"): 1,
        ("people.appearance.hair.style", "braid"): 1, ("people.appearance.hair.color", "black"): 1, ("people.appearance.eyewear.type", "goggle"): 1, ("people.appearance.eyewear.frame_color", "red"): 1,
        ("people.positions.plane", "foreground"): 1, ("people.pose_activity.pose", "sitting"): 1, ("objects.type", "mop"): 2, ("objects.type", "unknown"): 1, ("objects.subtype", "wet_mop"): 1, ("objects.subtype", "unknown"): 2,
        ("objects.plane", "foreground"): 1, ("objects.plane", "unknown"): 2, ("objects.side", "left"): 1, ("objects.side", "unknown"): 2, ("texts.content", "exit"): 1, ("texts.font_style", "bold"): 1, ("texts.font_style", "serif"): 1,
        ("texts.plane", "background"): 1, ("camera.angle", "high"): 1, ("camera.crop", "tight"): 1, ("lighting.sources.type", "lamp"): 1, ("lighting.sources.count", "two"): 1, ("lighting.sources.directionality", "left"): 1,
        ("lighting.sources.directionality", "top"): 1, ("lighting.shadows", "soft"): 1, ("safety.hazards", "cable"): 1, ("uncertainty", "hand"): 1,
    }
    assert tuple(counts.totals().first()) == (5, 2, 3, 1)


def test_objects_and_garments(counts):
    rows = {(r.section, r.bucket, r.field, r.value): r["count"] for r in counts.object_counts().collect()}
    assert rows[("by_type", "mop", "count", "")] == 2 and rows[("by_type", "mop", "quantity.exact_sum", "")] == 2 and rows[("by_type", "mop", "quantity.exact_present_count", "")] == 1
    assert rows[("by_type", "mop", "by_subtype", "wet_mop")] == 1 and rows[("by_type", "mop", "attributes.colors", "red")] == 1 and rows[("by_type_subtype", "mop|||wet_mop", "quantity.approx_tokens", "few")] == 1
    assert rows[("by_type", "mop", "positions.plane_side", "foreground.left")] == 1 and rows[("by_position", "unknown.unknown", "type_counts", "mop")] == 1
    assert rows[("by_position", "background.right", "total", "")] == 0 and rows[("by_position", "foreground.left", "total", "")] == 1
    worn = {(r.bucket, r.field, r.value): r["count"] for r in counts.garment_counts().collect()}
    assert worn == {("coat", "count", ""): 1, ("unknown", "count", ""): 1, ("coat", "color", "blue"): 1, ("unknown", "material", "wool"): 1}


def test_empty(spark):
    c = S.SceneCounts(spark.createDataFrame([], "scene string"))
    assert c.value_counts().collect() == [] and c.garment_counts().collect() == [] and tuple(c.totals().first()) == (0, 0, 0, 0)
    assert {r["count"] for r in c.object_counts().collect()} == {0}


def angle(degrees):
    return [np.cos(np.radians(degrees)), np.sin(np.radians(degrees))]


def test_clusters_against_brute_force():
    places = {"a": 0, "b": 5, "c": 10, "d": 15, "e": 40, "far": 180, "m": 90, "n": 91}
    embed = lambda texts: np.array([angle(places[t]) for t in texts])
    got = S.cluster_map([*places, "", "a"], embed, threshold=np.cos(np.radians(11)), least=3)
    assert got == {"a": "b", "b": "b", "c": "b", "d": "b", "e": "e", "far": "far", "m": "m", "n": "n"}  # b and c are alike, b is first
    assert S.cluster_map([]) == {} and S.cluster_map(["x"]) == {"x": "x"}


def test_vocabularies_and_colours():
    options = S.ENUMS["camera.angle"]
    same, other = np.eye(4), np.array([0, 0, 0, 0])
    assert S.enum_value("eye_level", options, same, other) == "eye_level" and S.enum_value("odd", options, same, other) == "odd" and S.enum_value("", options, same, other) == "unknown"
    assert S.enum_value("odd", options, same, np.array([0, 0, 0.7, 0])) == "low"
    none = np.zeros((len(S.CSS_COLOURS), 1))
    near = none.copy()
    near[S.CSS_COLOURS.index("teal")] = 0.5
    assert S.colour_value("x", near, np.ones(1)) == "teal" and S.colour_value("indigo", none, np.ones(1)) == "indigo" and S.colour_value("red lamp", none, np.ones(1)) == "red" and S.colour_value("zzz", none, np.ones(1)) is None
    assert S.CSS_COLOURS == sorted(S.CSS_COLOURS) and len(S.CSS_COLOURS) == 148
    assert token_set_ratio("b a", "a b c") == 1.0 and token_set_ratio("", "a") == 0.0 and 0 < token_set_ratio("abc", "abd") < 1


def test_names_by_kind(spark):
    values = spark.createDataFrame([("objects.type", "wet mop"), ("objects.type", "wet mops"), ("camera.angle", "High"), ("people.clothing.color", "Red"), ("people.clothing.color", "red")], "field string, value string")
    got = {(r.field, r.value): r.canonical for r in S.canonical_values(values).collect()}
    assert got[("objects.type", "wet mop")] == got[("objects.type", "wet mops")] == "wet_mop" and got[("camera.angle", "High")] == "high" and got[("people.clothing.color", "red")] == "red"
