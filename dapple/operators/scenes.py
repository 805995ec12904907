"""Counts over rich scene documents, with their values made one by clusters, vocabularies and colours.

A scene document is a nested description of an image (atmosphere, environment, people, objects, texts, camera, lighting,
safety). Its values are spread into rows once; each distinct value of a field is then given its canonical form, by the kind
of the field: a colour, a value of a fixed vocabulary, or else the middle of a cluster of similar values. Only
distinct values pass through Python, grouped by field; the counts are joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.functions import normalize as N
from dapple.operators.similar import COLOUR_COSINE, COLOUR_RATIO, COSINE, ENUM_COSINE, ENUM_RATIO, Embed, hash_embedding, token_set_ratio
from dapple.runtime import written

LEAST_CLUSTER = 4
#: Fields of a vocabulary.
ENUMS = {
    "people.demographics.gender_presentation": ("male", "female", "nonbinary", "unknown"), "people.demographics.skin_tone": ("light", "medium", "dark", "unknown"),
    "people.demographics.age_range": ("child", "teen", "young_adult", "middle_aged", "older_adult", "unknown"), "people.appearance.hair.present": ("yes", "no", "unknown"),
    "people.appearance.facial_hair.present": ("yes", "no", "unknown"), "people.appearance.eyewear.present": ("yes", "no", "unknown"),
    "people.appearance.head_covering.present": ("yes", "no", "unknown"), "people.pose_activity.gaze_direction": ("left", "center", "right", "up", "down", "unknown"),
    "people.pose_activity.orientation": ("front", "three_quarter", "profile", "back", "unknown"), "people.pose_activity.occlusions": ("none", "partial", "significant", "unknown"),
    "environment.indoor_outdoor": ("indoor", "outdoor", "unknown"), "camera.angle": ("high", "eye_level", "low", "unknown"),
    "camera.focal_length": ("wide", "normal", "short_tele", "tele", "unknown"), "camera.depth_of_field": ("shallow", "moderate", "deep", "unknown"),
    "lighting.color_temperature": ("warm", "neutral", "cool", "unknown"), "lighting.contrast_level": ("low", "medium", "high", "unknown"),
    "lighting.saturation_level": ("muted", "neutral", "vivid", "unknown"), "objects.plane": ("foreground", "midground", "background", "unknown"),
    "objects.side": ("left", "center", "right", "unknown"), "people.positions.plane": ("foreground", "midground", "background", "unknown"), "people.positions.side": ("left", "center", "right", "unknown"),
}
#: Fields of colours.
COLOUR_FIELDS = (
    "atmosphere.dominant_palette", "environment.surfaces.walls.color", "environment.surfaces.floor.color", "environment.surfaces.ceiling.color", "people.appearance.hair.color",
    "people.appearance.facial_hair.color", "people.appearance.eyewear.frame_color", "people.appearance.head_covering.color", "people.clothing.color", "objects.attributes.colors",
)
#: The named colours of CSS.
CSS_COLOURS = """
aliceblue antiquewhite aqua aquamarine azure beige bisque black blanchedalmond blue blueviolet brown burlywood cadetblue chartreuse chocolate coral cornflowerblue
cornsilk crimson cyan darkblue darkcyan darkgoldenrod darkgray darkgreen darkgrey darkkhaki darkmagenta darkolivegreen darkorange darkorchid darkred darksalmon
darkseagreen darkslateblue darkslategray darkslategrey darkturquoise darkviolet deeppink deepskyblue dimgray dimgrey dodgerblue firebrick floralwhite forestgreen
fuchsia gainsboro ghostwhite gold goldenrod gray green greenyellow grey honeydew hotpink indianred indigo ivory khaki lavender lavenderblush lawngreen lemonchiffon
lightblue lightcoral lightcyan lightgoldenrodyellow lightgray lightgreen lightgrey lightpink lightsalmon lightseagreen lightskyblue lightslategray lightslategrey
lightsteelblue lightyellow lime limegreen linen magenta maroon mediumaquamarine mediumblue mediumorchid mediumpurple mediumseagreen mediumslateblue
mediumspringgreen mediumturquoise mediumvioletred midnightblue mintcream mistyrose moccasin navajowhite navy oldlace olive olivedrab orange orangered orchid
palegoldenrod palegreen paleturquoise palevioletred papayawhip peachpuff peru pink plum powderblue purple rebeccapurple red rosybrown royalblue saddlebrown salmon
sandybrown seagreen seashell sienna silver skyblue slateblue slategray slategrey snow springgreen steelblue tan teal thistle tomato turquoise violet wheat white
whitesmoke yellow yellowgreen
""".split()

_SURFACE = ("material", "texture", "color", "finish", "condition")
_GARMENT = ("color", "material", "texture", "fit_style", "pattern", "condition")
_ATTRIBUTES = ("colors", "material", "texture", "finish", "condition", "state", "size_class")
_LIGHT = ("color_temperature", "contrast_level", "saturation_level")
PLANES, SIDES = N.PLANES, N.SIDES


def _struct(*parts: str, **deep: str) -> str:
    return "struct<" + ",".join([*(f"{p}:string" for p in parts), *(f"{k}:{v}" for k, v in deep.items())]) + ">"


SCENE = _struct(
    "uncertainty",
    atmosphere=_struct("mood", "dominant_palette", lighting_profile=_struct(*_LIGHT, "aesthetic_qualities")),
    environment=_struct("location_type", "indoor_outdoor", "time_of_day_hint", "weather", spatial_layout=_struct("depth", "openness", "aisle_width"), surfaces=_struct(**{s: f"array<{_struct(*_SURFACE)}>" for s in ("walls", "floor", "ceiling")})),
    people=_struct(persons="array<" + _struct(
        "gender_presentation", "skin_tone", "age_range", "role_hint", "pose", "activities", "gaze_direction", "orientation", "occlusions", "plane", "side",
        hair=_struct("present", "style", "type", "color"), facial_hair=_struct("present", "style", "type", "color"), eyewear=_struct("present", "type", "frame_color", "color"), head_covering=_struct("present", "type", "color"),
        clothing=f"array<{_struct('garment_type', *_GARMENT)}>",
    ) + ">"),
    objects="array<" + _struct("type", "subtype", "plane", "side", attributes=_struct(*_ATTRIBUTES), quantity=_struct("exact", "approx")) + ">",
    texts=f"array<{_struct('content', 'font_style', 'plane', 'side', 'legibility')}>",
    camera=_struct("angle", "perspective", "focal_length", "depth_of_field", "framing", "crop"),
    lighting=_struct(*_LIGHT, "shadows", "artifacts", sources=f"array<{_struct('type', 'count', 'directionality', 'hardness')}>"),
    safety=_struct("hazards", "nsfw"),
)
_VALUE = "array<struct<path:string,field:string,value:string>>"


def _values(x: Column) -> Column:
    """Trimmed texts of a list or a single value; none for null and blank."""
    texts = F.when(x.isNull(), F.array().cast("array<string>")).when(x.startswith("["), F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(x))
    return F.filter(F.transform(texts, F.trim), lambda t: t != "")


def _found(path: str, x: Column, field: str | None = None) -> Column:
    """Values with the path they are counted at and the field by which they are made one."""
    return F.transform(_values(x), lambda v: F.struct(F.lit(path).alias("path"), F.lit(field or path).alias("field"), v.alias("value")))


def _inside(xs: Column, parts: Callable[[Column], list[Column]]) -> Column:
    none = F.array().cast(_VALUE)
    return F.coalesce(F.flatten(F.transform(xs, lambda x: F.flatten(F.array(none, *[p.cast(_VALUE) for p in parts(x)])))), none)


def _plain_values(s: Column) -> Column:
    """All values that are counted by path alone."""
    of = lambda base, path, names: [_found(f"{path}.{n}", base[n]) for n in names]
    parts = of(s["atmosphere"], "atmosphere", ("mood", "dominant_palette"))
    profile = s["atmosphere"]["lighting_profile"]
    parts += [_found(f"atmosphere.lighting_profile.{n}", profile[n], f"lighting.{n}") for n in _LIGHT] + of(profile, "atmosphere.lighting_profile", ("aesthetic_qualities",))
    parts += of(s["environment"], "environment", ("location_type", "indoor_outdoor", "time_of_day_hint", "weather")) + of(s["environment"]["spatial_layout"], "environment.spatial_layout", ("depth", "openness", "aisle_width"))
    for surface in ("walls", "floor", "ceiling"):
        parts.append(_surface(s, surface))
    parts.append(_inside(s["people"]["persons"], _person))
    for name, path in (("type", "objects.type"), ("subtype", "objects.subtype"), ("plane", "objects.plane"), ("side", "objects.side")):
        parts.append(_inside(s["objects"], _object_value(name, path)))
    parts.append(_inside(s["texts"], lambda x: of(x, "texts", ("content", "font_style", "plane", "side", "legibility"))))
    parts += of(s["camera"], "camera", ("angle", "perspective", "focal_length", "depth_of_field", "framing", "crop")) + of(s["lighting"], "lighting", (*_LIGHT, "shadows", "artifacts"))
    parts.append(_inside(s["lighting"]["sources"], lambda x: of(x, "lighting.sources", ("type", "count", "directionality", "hardness"))))
    parts += of(s["safety"], "safety", ("hazards", "nsfw")) + [_found("uncertainty", s["uncertainty"])]
    return F.flatten(F.array(*[p.cast(_VALUE) for p in parts]))


def _surface(s: Column, surface: str) -> Column:
    return _inside(s["environment"]["surfaces"][surface], lambda x: [_found(f"environment.surfaces.{surface}.{n}", x[n]) for n in _SURFACE])


def _object_value(name: str, path: str) -> Callable[[Column], list[Column]]:
    return lambda x: [_found(path, _known(x[name]))]


def _known(x: Column) -> Column:
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.lit("unknown")).otherwise(x)


def _person(p: Column) -> list[Column]:
    one = lambda path, *names: [_found(f"people.{path}.{n}", p[n]) for n in names]
    parts = one("demographics", "gender_presentation", "skin_tone", "age_range", "role_hint") + one("pose_activity", "pose", "activities", "gaze_direction", "orientation", "occlusions") + one("positions", "plane", "side")
    for sub, style in (("hair", "style"), ("facial_hair", "style"), ("eyewear", "type"), ("head_covering", "type")):
        node, colour = p[sub], "frame_color" if sub == "eyewear" else "color"
        shape = F.coalesce(node["style"], node["type"]) if style == "style" else node["type"]
        shade = F.coalesce(node["frame_color"], node["color"]) if sub == "eyewear" else node["color"]
        at = f"people.appearance.{sub}"
        parts += [_found(f"{at}.present", node["present"]), _found(f"{at}.{style}", shape), _found(f"{at}.{colour}", shade)]
    return parts


def kind_of(field: str) -> str:
    return "enum" if field in ENUMS else "colour" if field in COLOUR_FIELDS else "cluster"


def cluster_map(values: list[str], embed: Embed = hash_embedding, threshold: float = COSINE, least: int = LEAST_CLUSTER) -> dict[str, str]:
    """The middle of each value's cluster. Values are dense if ``least`` of all (fewer if there are fewer) lie within ``threshold``, themselves
    included; dense values near each other make a cluster, which values near one of them join; the rest stand for
    themselves. A cluster's middle is its value most like the others, the first by text of several. A density clustering with a
    fixed distance in place of a hierarchy of distances. Values are taken in blocks, so no matrix of all pairs is held."""
    unique = sorted({v for v in values if v})
    out = {v: v for v in unique}
    n = len(unique)
    if n < 2:
        return out
    vectors, least = embed(unique), max(2, min(least, n))
    near: list[np.ndarray] = []
    for start in range(0, n, 1024):
        sims = vectors[start : start + 1024] @ vectors.T
        near += [np.flatnonzero(row >= threshold) for row in sims]
    dense = np.array([len(x) >= least for x in near])
    label = np.full(n, -1)
    for i in range(n):
        if not dense[i] or label[i] >= 0:
            continue
        edge = [i]
        label[i] = i
        while edge:
            for j in near[edge.pop()]:
                if label[j] < 0:
                    label[j] = i
                    if dense[j]:
                        edge.append(int(j))
    for c in set(label[label >= 0].tolist()):
        members = np.flatnonzero(label == c)
        like = vectors[members] @ vectors[members].sum(axis=0)  # mean similarity, but for a factor
        middle = unique[members[int(np.flatnonzero(like >= like.max() - 1e-12)[0])]]
        for m in members:
            out[unique[m]] = middle
    return out


def enum_value(clean: str, options: tuple[str, ...], vectors: np.ndarray, vector: np.ndarray) -> str:
    """The option that has the same words, else the nearest, else the value itself; ``unknown`` for nothing."""
    if not clean:
        return "unknown" if "unknown" in options else ""
    scores = [token_set_ratio(clean, o) for o in options]
    if max(scores) >= ENUM_RATIO:
        return options[int(np.argmax(scores))]
    near = vectors @ vector
    return options[int(near.argmax())] if near.max() >= ENUM_COSINE else clean


def colour_value(raw: str, vectors: np.ndarray, vector: np.ndarray) -> str | None:
    """The nearest colour, else the one with nearly the same words, else None."""
    near = vectors @ vector
    if near.max() >= COLOUR_COSINE:
        return CSS_COLOURS[int(near.argmax())]
    scores = [token_set_ratio(raw, c) for c in CSS_COLOURS]
    return CSS_COLOURS[int(np.argmax(scores))] if max(scores) >= COLOUR_RATIO else None


def canonical_values(values: DataFrame, embed: Embed | None = hash_embedding) -> DataFrame:
    """``field``, ``value``, ``canonical`` of distinct ``values`` (``field``, ``value``): vocabulary fields by :func:`enum_value`, colours by
    :func:`colour_value`, others by :func:`cluster_map` of their lemmas. Without ``embed`` nothing is compared by vectors or
    clustered: a value is its own lemmas, or its own text in fields of vocabularies and colours. One task takes a field's
    distinct values."""
    distinct = values.select("field", "value").distinct().withColumns({"clean": N.basic_clean(F.col("value")), "norm": N.norm_text(F.col("value"))})
    of = F.create_map(*[F.lit(x) for f in (*ENUMS, *COLOUR_FIELDS) for x in (f, kind_of(f))])
    kinds = distinct.withColumn("kind", F.coalesce(F.try_element_at(of, F.col("field")), F.lit("cluster")))
    if embed is None:
        plain = F.when(F.col("kind") == "cluster", N.snake(F.col("norm"))).when((F.col("kind") == "enum") & (F.col("clean") == ""), F.lit("unknown")).otherwise(F.when(F.col("kind") == "enum", F.col("clean")).otherwise(N.snake(F.col("value"))))
        return kinds.select("field", "value", plain.alias("canonical"))

    def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
        field = pdf["field"].iloc[0]
        kind = kind_of(field)
        if kind == "cluster":
            names = cluster_map(pdf["norm"].tolist(), embed)
            got = [names.get(v, v) for v in pdf["norm"]]
        elif kind == "enum":
            options, vectors = ENUMS[field], embed(list(ENUMS[field]))
            got = [enum_value(c, options, vectors, v) for c, v in zip(pdf["clean"], embed(pdf["clean"].tolist()), strict=True)]
        else:
            vectors = embed(CSS_COLOURS)
            got = [colour_value(x, vectors, v) or x for x, v in zip(pdf["value"], embed(pdf["value"].tolist()), strict=True)]
        return pd.DataFrame({"field": field, "value": pdf["value"], "named": got, "kind": kind})

    named = kinds.groupBy("field").applyInPandas(canonical, "field string, value string, named string, kind string")
    return named.select("field", "value", F.when(F.col("kind") == "enum", F.col("named")).otherwise(N.snake(F.col("named"))).alias("canonical"))


class SceneCounts:
    """Counts over ``docs`` (``column``: JSON of a scene, a row an image).

    Texts that are no JSON object count as images without content. A list may hold a single value in its place."""

    def __init__(self, docs: DataFrame, column: str = "scene", embed: Embed | None = hash_embedding):
        parsed = docs.select(F.from_json(column, SCENE).alias("s")).withColumn("doc", F.monotonically_increasing_id())
        self.parsed = written(parsed, "scenes")
        s = F.col("s")
        self.plain = self.parsed.select(F.explode(_plain_values(s)).alias("v")).select("v.*")
        numbered = lambda xs: F.posexplode(xs).alias("no", "o")
        objects = self.parsed.select("doc", numbered(s["objects"]))
        key = {n: _known(F.col("o")[n]) for n in ("type", "subtype", "plane", "side")}
        attributes = [_found(f"attributes.{n}", F.col("o.attributes")[n], f"objects.attributes.{n}") for n in _ATTRIBUTES] + [_found("quantity.approx_tokens", F.col("o.quantity.approx"), "objects.quantity.approx_tokens")]
        self.objects = objects.select(*[F.trim(e).alias(n) for n, e in key.items()], F.col("o.quantity.exact").try_cast("double").cast("bigint").alias("exact"), F.flatten(F.array(*[a.cast(_VALUE) for a in attributes])).alias("values"))
        garments = self.parsed.select(F.explode(F.flatten(F.transform(s["people"]["persons"], lambda p: F.coalesce(p["clothing"], F.array().cast(f"array<{_struct('garment_type', *_GARMENT)}>"))))).alias("g"))
        worn = F.flatten(F.array(*[_found(n, F.col("g")[n], f"people.clothing.{n}").cast(_VALUE) for n in _GARMENT]))
        self.garments = garments.select(F.trim(_known(F.col("g.garment_type"))).alias("type"), worn.alias("values"))
        fields = self.plain.select("field", "value")
        for n in key:
            fields = fields.unionByName(self.objects.select(F.lit(f"objects.{n}").alias("field"), F.col(n).alias("value")))
        for rows in (self.objects, self.garments):
            fields = fields.unionByName(rows.select(F.explode("values").alias("v")).select("v.field", "v.value"))
        fields = fields.unionByName(self.garments.where("type != 'unknown'").select(F.lit("people.clothing.garment_type").alias("field"), F.col("type").alias("value")))
        self.names = written(canonical_values(fields, embed), "scene-names")

    def _named(self, rows: DataFrame, field: Column, value: str, to: str) -> DataFrame:
        names = self.names.select(F.col("field").alias("_f"), F.col("value").alias("_v"), F.col("canonical").alias(to))
        return rows.join(names, (field == F.col("_f")) & (F.col(value) == F.col("_v")), "left").drop("_f", "_v").withColumn(to, F.coalesce(to, value))

    def value_counts(self) -> DataFrame:
        """``path``, ``value``, ``count``: of all values that are counted by their path alone."""
        return self._named(self.plain, F.col("field"), "value", "name").groupBy("path", F.col("name").alias("value")).agg(F.count(F.lit(1)).alias("count"))

    def totals(self) -> DataFrame:
        size = lambda x: F.coalesce(F.sum(F.greatest(F.size(x), F.lit(0))), F.lit(0))
        s = F.col("s")
        return self.parsed.agg(F.count(F.lit(1)).alias("images"), size(s["people"]["persons"]).alias("people_instances"), size(s["objects"]).alias("object_instances"), size(s["texts"]).alias("text_instances"))

    def _buckets(self, rows: DataFrame, bucket: Column) -> DataFrame:
        """``bucket``, ``field``, ``value``, ``count`` of the values of rows."""
        values = self._named(rows.select(bucket.alias("bucket"), F.explode("values").alias("v")).select("bucket", "v.*"), F.col("field"), "value", "name")
        return values.groupBy("bucket", F.col("path").alias("field"), F.col("name").alias("value")).agg(F.count(F.lit(1)).alias("count"))

    def object_counts(self) -> DataFrame:
        """``section`` (by_type, by_type_subtype, by_position), ``bucket``, ``field``, ``value``, ``count``.

        By type and by type and subtype (``type|||subtype``): ``count``, ``positions.plane_side``, ``attributes.*``, ``quantity.*``, and by type ``by_subtype``.
        By position (``plane.side``): ``type_counts``, ``type_subtype_counts`` and ``total``; the nine positions are always there."""
        rows = self.objects
        for n in ("type", "subtype", "plane", "side"):
            rows = self._named(rows, F.lit(f"objects.{n}"), n, f"_{n}").drop(n).withColumnRenamed(f"_{n}", n)
        rows = written(rows.withColumns({"pair": F.concat_ws("|||", "type", "subtype"), "position": F.concat_ws(".", "plane", "side")}), "scene-objects")
        none = F.lit("")
        parts = []
        for section, bucket in (("by_type", "type"), ("by_type_subtype", "pair")):
            g = rows.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("exact"), F.lit(0)).alias("quantity.exact_sum"), F.count("exact").alias("quantity.exact_present_count"))
            places = rows.groupBy(F.col(bucket).alias("bucket"), F.lit("positions.plane_side").alias("field"), F.col("position").alias("value")).agg(F.count(F.lit(1)).alias("count"))
            parts += [x.select(F.lit(section).alias("section"), "bucket", "field", "value", "count") for x in (_sums(g), places, self._buckets(rows, F.col(bucket)))]
        parts.append(rows.groupBy(F.lit("by_type").alias("section"), F.col("type").alias("bucket"), F.lit("by_subtype").alias("field"), F.col("subtype").alias("value")).agg(F.count(F.lit(1)).alias("count")))
        for field, value in (("type_counts", F.col("type")), ("type_subtype_counts", F.col("pair"))):
            parts.append(rows.groupBy(F.lit("by_position").alias("section"), F.col("position").alias("bucket"), F.lit(field).alias("field"), value.alias("value")).agg(F.count(F.lit(1)).alias("count")))
        nine = rows.sparkSession.createDataFrame([(f"{p}.{s}", 0) for p in PLANES for s in SIDES], "position string, n bigint")
        every = rows.select("position", F.lit(1).cast("bigint").alias("n")).unionByName(nine)
        parts.append(every.groupBy(F.lit("by_position").alias("section"), F.col("position").alias("bucket"), F.lit("total").alias("field"), none.alias("value")).agg(F.sum("n").alias("count")))
        return _union(parts)

    def garment_counts(self) -> DataFrame:
        """``bucket`` (garment), ``field``, ``value``, ``count``: how many there are and their attributes."""
        rows = self._named(self.garments, F.lit("people.clothing.garment_type"), "type", "garment")
        counts = rows.groupBy(F.col("garment").alias("bucket"), F.lit("count").alias("field"), F.lit("").alias("value")).agg(F.count(F.lit(1)).alias("count"))
        return counts.unionByName(self._buckets(rows, F.col("garment")))


def _sums(g: DataFrame) -> DataFrame:
    names = [c for c in g.columns if c != "bucket"]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias("count")) for n in names])).alias("c")
    return g.select("bucket", cells).select("bucket", "c.field", F.lit("").alias("value"), "c.count")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
