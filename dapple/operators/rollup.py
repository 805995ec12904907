"""Rollups of label counts through files, roles, contexts and models, and what is shown of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.functions import normalize as N
from dapple.functions.stats import half_even, wilson

COLLAPSE_SHARE = 0.05
WILSON_BELOW = 30
#: The general attributes in their order.
GENERAL_ORDER = (
    "Mood", "LightingColorTemperature", "AtmosphereContrastLevel", "SaturationLevel", "DominantPalette", "AestheticQualities", "IndoorOutdoor", "Weather",
    "TimeOfDayHint", "Perspective", "Framing", "FocalLength", "DepthOfField", "CameraAngle", "Directionality", "Hardness", "Shadows", "SourcesCount",
    "SourcesType", "GenderPresentation", "SkinTone", "AgeRange", "GazeDirection", "OrientationType", "FaceEmotion", "Hairstyle", "HairColor",
    "OcclusionState", "eyewear_present", "head_covering_present", "facial_hair_present", "safety_gear_present", "visible_text_present",
    "vehicle_present", "animal_present", "tool_present", "multiple_people_present", "hair_present",
)
#: What a (cohort, dimension) is called among the general attributes. The attribute's cohort is the same one;
#: ``*`` stands for any other cohort, and counts as ``people``.
GENERAL = {
    ("atmosphere", "mood"): "Mood", ("atmosphere", "mood_distribution"): "Mood",
    ("atmosphere", "color_temperature"): "LightingColorTemperature", ("atmosphere", "lighting_color_temperature"): "LightingColorTemperature",
    ("atmosphere", "lighting_profile_color_temperature"): "LightingColorTemperature", ("lighting", "color_temperature"): "LightingColorTemperature",
    ("lighting", "lighting_profile_color_temperature"): "LightingColorTemperature", ("atmosphere", "contrast_level"): "AtmosphereContrastLevel",
    ("atmosphere", "lighting_profile_contrast_level"): "AtmosphereContrastLevel", ("lighting", "contrast_level"): "AtmosphereContrastLevel",
    ("lighting", "lighting_profile_contrast_level"): "AtmosphereContrastLevel", ("atmosphere", "saturation_level"): "SaturationLevel",
    ("atmosphere", "lighting_profile_saturation_level"): "SaturationLevel", ("lighting", "saturation_level"): "SaturationLevel",
    ("lighting", "lighting_profile_saturation_level"): "SaturationLevel", ("atmosphere", "dominant_palette"): "DominantPalette",
    ("atmosphere", "dominant_palette_mapped"): "DominantPalette", ("atmosphere", "palette"): "DominantPalette", ("atmosphere", "palette_color"): "DominantPalette",
    ("atmosphere", "palette_colors"): "DominantPalette", ("atmosphere", "palette_detail"): "DominantPalette", ("atmosphere", "aesthetic_qualities"): "AestheticQualities",
    ("atmosphere", "aesthetic_quality"): "AestheticQualities", ("atmosphere", "lighting_profile_aesthetic_qualities"): "AestheticQualities",
    ("environment", "indoor_outdoor"): "IndoorOutdoor", ("environment", "weather"): "Weather", ("environment", "time_of_day_hint"): "TimeOfDayHint",
    ("camera", "perspective"): "Perspective", ("camera", "framing"): "Framing", ("camera", "focal_length"): "FocalLength",
    ("camera", "depth_of_field"): "DepthOfField", ("camera", "angle"): "CameraAngle", ("lighting", "directionality"): "Directionality",
    ("lighting", "hardness"): "Hardness", ("lighting", "shadows"): "Shadows", ("lighting", "sources_count"): "SourcesCount", ("lighting", "sources_type"): "SourcesType",
    ("people", "gender_presentation"): "GenderPresentation", ("people", "skin_tone"): "SkinTone", ("people", "age_range"): "AgeRange",
    ("people", "gaze_direction"): "GazeDirection", ("people", "orientation"): "OrientationType", ("people", "pose_activity_orientation"): "OrientationType",
    ("people", "face_emotion"): "FaceEmotion", ("people", "hair_style"): "Hairstyle", ("people", "hair_color"): "HairColor", ("people", "occlusions"): "OcclusionState",
    ("people", "pose_activity_occlusions"): "OcclusionState", ("people", "eyewear_present"): "eyewear_present", ("people", "head_covering_present"): "head_covering_present",
    ("people", "facial_hair_present"): "facial_hair_present", ("people", "facial_hair_presence"): "facial_hair_present", ("people", "hair_present"): "hair_present",
    ("people", "safety_gear_present"): "safety_gear_present", ("texts", "visible_text_present"): "visible_text_present", ("objects", "vehicle_present"): "vehicle_present",
    ("objects", "animal_present"): "animal_present", ("objects", "tool_present"): "tool_present", ("people", "multiple_people_present"): "multiple_people_present",
    ("*", "gender_presentation"): "GenderPresentation", ("*", "hair_present"): "hair_present", ("*", "eyewear_present"): "eyewear_present",
    ("*", "head_covering_present"): "head_covering_present", ("*", "facial_hair_present"): "facial_hair_present",
}
#: The dimensions of the cohorts. A legacy document names them ``<prefix>_<dimension>`` without the cohort.
COHORTS = {
    "scene_appearance": ("mood", "color_temperature", "contrast_level", "aesthetic_qualities", "dominant_colors", "weather"),
    "camera": ("depth_of_field", "framing", "perspective"),
    "people": (
        "gender_presentation", "skin_tone", "age_range", "body_type", "pose", "expression", "activities", "accessories", "eyewear_type", "eyewear_present",
        "head_covering_type", "head_covering_present", "hair_present", "hair_color", "hair_style", "tattoo_present", "facial_hair_present", "facial_hair_style",
        "facial_hair_color", "clothing_garment",
    ),
    "objects": ("items",),
}
LEGACY_PREFIX = {"scene_appearance": "scene", "camera": "camera", "people": "people", "objects": "objects"}


def with_bins(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """``df`` with ``bins``: distinct non-null labels of its group."""
    bins = df.groupBy(*by).agg(F.countDistinct(label).alias("bins"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])
    return df.alias("l").join(bins.alias("r"), same, "left").select("l.*", "r.bins")


def count_rows(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tidy rows (``by``, cohort, dimension, label, count, bin): counts summed by label, ``bin`` the labels of the dimension."""
    key = [*(by or []), "cohort", "dimension"]
    rows = df.groupBy(*key, "label").agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"))
    return rows.withColumn("bin", F.count(F.lit(1)).over(Window.partitionBy(*key)).cast("int"))


def nested_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """One map of labels to counts for each group, in the order of labels. Labels may not be null."""
    rows = df.where("label IS NOT NULL").groupBy(*by, "label").agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"))
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "count")))).alias("counts"))


def ranked_labels(df: DataFrame, by: list[str]) -> DataFrame:
    """Labels of each group by falling count, then label."""
    rows = df.where("label IS NOT NULL").groupBy(*by, "label").agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "label")))


def role_totals(df: DataFrame) -> DataFrame:
    """By role: counts of normal cohort, dimension and label. Counts that are no numbers are 0."""
    cohort = N.slug(F.coalesce("cohort", F.lit("unknown")), empty="unknown")
    key = N.dimension_key(F.coalesce("dimension", F.lit("unknown")))
    rows = df.select("occupation", cohort.alias("cohort"), key.alias("dimension"), F.coalesce("label", F.lit("")).alias("raw"), half_even(F.coalesce(F.col("count").cast("double"), F.lit(0.0)), 0).cast("bigint").alias("count"))
    rows = rows.withColumn("label", N.label(F.col("cohort"), F.col("dimension"), F.col("raw")))
    return rows.groupBy("occupation", "cohort", "dimension", "label").agg(F.sum("count").alias("count"))


def general_attributes(totals: DataFrame) -> DataFrame:
    """``cohort``, ``dimension`` (the general attribute), ``label``, ``count`` and ``ordinal``, the attribute's place in GENERAL_ORDER from 1: counts
    by the exact cohort or else any."""
    table = F.create_map(*[F.lit(x) for (c, d), name in GENERAL.items() for x in (f"{c}|{d}", name)])
    exact = F.try_element_at(table, F.concat_ws("|", "cohort", "dimension"))
    name = F.coalesce(exact, F.try_element_at(table, F.concat(F.lit("*|"), F.col("dimension"))))
    cohort = F.when(exact.isNotNull(), F.col("cohort")).otherwise("people")
    rows = totals.select(cohort.alias("cohort"), name.alias("dimension"), "label", "count").where("dimension IS NOT NULL").groupBy("cohort", "dimension", "label").agg(F.sum("count").alias("count"))
    return rows.withColumn("ordinal", F.array_position(F.array(*[F.lit(x) for x in GENERAL_ORDER]), F.col("dimension")).cast("int"))


def cohort_counts(docs: DataFrame, doc_id: str, column: str) -> DataFrame:
    """``doc_id``, ``cohort``, ``dimension``, ``label``, ``count`` of count documents (JSON texts) in either form.

    Nested: cohort, dimension, labels to counts; a number in place of labels counts under the dimension's name. Legacy: an
    object with a flat name (``scene_mood``) has labels to counts below it and totals beside it; then other keys are left out.
    Counts lose their fraction; what is no number, and documents that are no objects, give no rows."""
    legacy = F.create_map(*[F.lit(x) for c, ds in COHORTS.items() for d in ds for x in (f"{LEGACY_PREFIX[c]}_{d}", f"{c}|{d}")])
    top = docs.select(doc_id, F.from_json(column, "map<string,string>").alias("m")).where("m IS NOT NULL")
    top = top.withColumn("old", F.exists(F.map_keys("m"), lambda k: F.try_element_at(legacy, k).isNotNull()))
    parts = top.select(doc_id, "old", F.explode("m").alias("key", "body"))
    named = F.split(F.try_element_at(legacy, F.col("key")), r"\|")
    flat = parts.where(F.col("old") & (named.isNotNull()) & F.col("body").startswith("{")).select(doc_id, named[0].alias("cohort"), named[1].alias("dimension"), F.explode(F.from_json("body", "map<string,string>")).alias("label", "value"))
    deep = parts.where((~F.col("old") | (F.col("key") == "totals")) & F.col("body").startswith("{")).select(doc_id, F.col("key").alias("cohort"), F.explode(F.from_json("body", "map<string,string>")).alias("dimension", "labels"))
    many = deep.where(F.col("labels").startswith("{")).select(doc_id, "cohort", "dimension", F.explode(F.from_json("labels", "map<string,string>")).alias("label", "value"))
    one = deep.where(~F.col("labels").startswith("{")).select(doc_id, "cohort", "dimension", F.col("dimension").alias("label"), F.col("labels").alias("value"))
    count = F.col("value").try_cast("double").cast("bigint")
    return flat.unionByName(many).unionByName(one).select(doc_id, "cohort", "dimension", "label", count.alias("count")).where("count IS NOT NULL")


def all_roles(df: DataFrame) -> DataFrame:
    """Counts over all roles with the sorted lists of their roles and contexts."""
    return df.groupBy("cohort", "dimension", "label").agg(
        F.sum(F.coalesce("count", F.lit(0))).alias("count"), F.array_join(F.array_sort(F.collect_set("occupation")), ",").alias("roles"), F.array_join(F.array_sort(F.collect_set("context")), ",").alias("contexts")
    )


def role_files(df: DataFrame, role: str = "occupation") -> DataFrame:
    """File stems of roles: safe names, with a number for every further role of the same name."""
    roles = df.where(F.col(role).isNotNull()).select(F.col(role).alias("role")).distinct().withColumn("name", N.file_name(F.col("role")))
    n = F.row_number().over(Window.partitionBy("name").orderBy("role"))
    return roles.select("role", F.when(n == 1, F.col("name")).otherwise(F.concat_ws("_", "name", n.cast("string"))).alias("file_stem"))


def shares(df: DataFrame, by: list[str]) -> DataFrame:
    """``share`` of each row in its group's count; null where the group counts nothing."""
    return df.withColumn("share", F.try_divide(F.col("count").cast("double"), F.sum("count").over(Window.partitionBy(*by))))


def collapse_small(df: DataFrame, by: list[str], threshold: float = COLLAPSE_SHARE) -> DataFrame:
    """Labels below ``threshold`` of their group become one row ``Other (count)`` that lists them in ``members``."""
    small = F.coalesce("share", F.lit(0.0)) < threshold
    rows = df.withColumn("_l", F.when(~small, F.col("label")))
    g = rows.groupBy(*by, "_l").agg(F.sum("count").alias("count"), F.sum("share").alias("share"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_l").isNull(), F.col("label")))), ",").alias("members"))
    return g.select(*by, F.coalesce("_l", F.concat(F.lit("Other ("), F.col("count").cast("string"), F.lit(")"))).alias("label"), "count", "share", "members")


def with_interval(df: DataFrame, k: str, n: Column) -> DataFrame:
    low, high = wilson(F.col(k), n)
    return df.withColumns({"low": low, "high": high})


def drop_unknown(df: DataFrame, columns: list[str], word: str = "unknown") -> DataFrame:
    """Rows without the word, in any case, in the columns; null is no word."""
    return reduce(lambda d, c: d.where(F.coalesce(F.lower(F.col(c)) != word, F.lit(True))), columns, df)


def filtered(df: DataFrame, filters: dict) -> DataFrame:
    """Rows whose columns equal a value or are among values."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]).isin(*kv[1]) if isinstance(kv[1], (list, tuple, set)) else F.col(kv[0]) == kv[1]), filters.items(), df)


def search(df: DataFrame, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which a pattern is found, in any case, in a text column."""
    texts = columns or [n for n, t in df.dtypes if t == "string"]
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False)) for c in texts], F.lit(False))
    return df.where(hit)


def summary(df: DataFrame, by: list[str], column: str = "count") -> DataFrame:
    """Sum, mean, maximum, minimum and deviation of a column and distinct dimensions and labels, to two digits."""
    x = F.col(column)
    return df.groupBy(*by).agg(
        F.sum(x).alias("total"), half_even(F.avg(x), 2).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min"), half_even(F.stddev_samp(x), 2).alias("std"),
        F.countDistinct("dimension").alias("dimensions"), F.countDistinct("label").alias("labels"),
    )


def top_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, names: dict[str, str], value: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row a value of ``row`` with a column for each of ``names`` (value of ``column`` to column name): the number of rows, or ``value``
    (an aggregate of rows where the column has the value); ``total`` is their sum."""
    cell = lambda v: F.count_if(F.col(column) == v) if value is None else value(F.col(column) == v)
    g = df.groupBy(row).agg(*[cell(v).alias(n) for v, n in names.items()])
    return g.withColumn("total", reduce(lambda a, b: a + b, [F.col(n) for n in names.values()]))


def in_all(df: DataFrame, key: list[str], column: str, values: list[str]) -> DataFrame:
    """Keys that are there with every one of ``values``."""
    parts = [df.where(F.col(column) == v).select(*key) for v in values]
    return reduce(lambda a, b: a.intersect(b), parts)


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """Cells of dimensions and labels that are filled, of all there could be."""
    known = df.where("dimension IS NOT NULL AND label IS NOT NULL")
    g = known.groupBy(*by).agg(F.countDistinct(F.struct("dimension", "label")).alias("filled"), (F.countDistinct("dimension") * F.countDistinct("label")).alias("possible"))
    return g.withColumn("coverage", F.try_divide(F.col("filled").cast("double"), F.col("possible")))


def top_label(df: DataFrame, by: list[str]) -> DataFrame:
    """The label with the highest count of each group, the first by name of several."""
    rows = df.where("label IS NOT NULL").groupBy(*by, "label").agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "label"))
    return rows.withColumn("_r", best).where("_r = 1").drop("_r")


def canonical_join(df: DataFrame, canon: DataFrame) -> DataFrame:
    """Labels replaced by their canonical label for (cohort, dimension, normal label), where one is listed; null keys match.

    ``canon``: cohort, dimension, label, canonical_label and an order column ``map_id``; the first row of a key counts."""
    key = canon.select("cohort", "dimension", N.label_key(F.col("label")).alias("label_norm"), N.label_key(F.col("canonical_label")).alias("canonical"), "map_id").where("label_norm != '' AND canonical != ''")
    first = key.groupBy("cohort", "dimension", "label_norm").agg(F.min_by("canonical", "map_id").alias("canonical"))
    rows = df.withColumn("label_norm", N.label_key(F.col("label")))
    on = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("cohort", "dimension", "label_norm")])
    return rows.alias("l").join(first.alias("r"), on, "left").select(*[F.col(f"l.{c}") for c in df.columns if c != "label"], F.coalesce("r.canonical", "l.label_norm").alias("label"))
