"""Label tokens of nested image records, in the JVM: parse, spread, count once an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.functions.normalize import is_token

#: Dimensions of the cohorts. Lists may hold a single value in their place.
SCENE = ("mood", "color_temperature", "weather")
SCENE_LISTS = ("aesthetic_qualities", "dominant_colors")
CAMERA = ("depth_of_field", "framing", "perspective")
PERSON = (
    "gender_presentation", "skin_tone", "age_range", "body_type", "pose", "expression", "eyewear_type", "eyewear_present", "head_covering_type", "head_covering_present",
    "hair_present", "hair_color", "hair_style", "tattoo_present", "facial_hair_present", "facial_hair_style", "facial_hair_color",
)
PERSON_LISTS = ("activities", "accessories")
MOST_ITEMS = 3
TOP_KEYS = ("schema_version", "image", "cohorts")


def _strings(names) -> str:
    return "struct<" + ",".join(f"{n}:string" for n in names) + ">"


RECORD = f"struct<image:struct<image_id:string>,cohorts:struct<scene_appearance:{_strings(SCENE + SCENE_LISTS)},camera:{_strings(CAMERA)},objects:string,people:string>>"
_PERSONS = "array<" + _strings((*PERSON, *PERSON_LISTS, "clothing")) + ">"


def as_list(x: Column) -> Column:
    """The texts of a JSON list or of a single value; null gives an empty list."""
    return F.when(x.isNull(), F.array().cast("array<string>")).when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))


def parsed(df: DataFrame, record_id: str = "record_id", record: str = "record") -> DataFrame:
    """``id``, ``json`` (a struct of texts), ``persons``, ``items``: records that are whole JSON objects.

    Persons stand in people.persons or in people, as a list or one object; items in objects.items, as a list or the keys of an
    object, or in objects as a list."""
    whole = df.select(F.col(record_id).alias("id"), F.col(record).alias("text"), F.from_json(record, RECORD, {"mode": "PERMISSIVE"}).alias("json"))
    whole = whole.where(F.try_parse_json("text").isNotNull() & F.col("text").rlike(r"^\s*\{"))
    people, objects = F.col("json.cohorts.people"), F.col("json.cohorts.objects")
    persons = F.when(people.startswith("["), people).otherwise(F.get_json_object(people, "$.persons"))
    raw = F.when(objects.startswith("["), objects).otherwise(F.get_json_object(objects, "$.items"))
    items = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.startswith("{"), F.json_object_keys(raw))
    return whole.select("id", "text", "json", F.filter(F.coalesce(F.from_json(persons, _PERSONS), F.array()), lambda p: p.isNotNull()).alias("persons"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))


def image_tokens(records: DataFrame) -> DataFrame:
    """``id``, ``cohort``, ``dimension``, ``label``: each token of an image once, whoever carries it."""
    one = lambda cohort, dim, x: F.array(F.struct(F.lit(cohort).alias("cohort"), F.lit(dim).alias("dimension"), x.alias("label")))
    many = lambda cohort, dim, xs: F.transform(xs, lambda x: F.struct(F.lit(cohort).alias("cohort"), F.lit(dim).alias("dimension"), x.alias("label")))
    of = lambda f: F.flatten(F.transform("persons", f))
    parts = [one("scene_appearance", d, F.col(f"json.cohorts.scene_appearance.{d}")) for d in SCENE]
    parts += [many("scene_appearance", d, as_list(F.col(f"json.cohorts.scene_appearance.{d}"))) for d in SCENE_LISTS]
    parts += [one("camera", d, F.col(f"json.cohorts.camera.{d}")) for d in CAMERA]
    field = lambda d: lambda p: p[d]
    listed = lambda d: lambda p: as_list(p[d])
    parts += [many("people", d, F.transform("persons", field(d))) for d in PERSON]
    parts += [many("people", d, of(listed(d))) for d in PERSON_LISTS]
    garments = of(lambda p: F.coalesce(F.from_json(p["clothing"], "array<struct<clothing_garment:string>>"), F.array()))
    parts += [many("people", "clothing_garment", F.transform(garments, lambda c: c["clothing_garment"])), many("objects", "items", F.col("items"))]
    rows = records.select("id", F.explode(F.flatten(F.array(*parts))).alias("t")).select("id", "t.*")
    return rows.where(is_token(F.col("label"))).distinct()


def token_counts(records: DataFrame) -> DataFrame:
    return image_tokens(records).groupBy("cohort", "dimension", "label").agg(F.count(F.lit(1)).alias("count"))


def totals(records: DataFrame) -> DataFrame:
    """Images, persons and objects, whether they give tokens or not."""
    return records.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum(F.size("persons")), F.lit(0)).alias("people_instances"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("object_instances"))


#: The keys of the parts of a record, and values that always hold.
KEYS = {
    "": TOP_KEYS, "image": ("image_id", "file_path", "source_model", "caption", "source_metadata"), "cohorts": ("scene_appearance", "camera", "objects", "people", "totals"),
    "cohorts.scene_appearance": SCENE + SCENE_LISTS, "cohorts.camera": CAMERA, "cohorts.objects": ("items",), "cohorts.people": ("persons",),
    "cohorts.totals": ("images", "object_instances", "people_instances"),
}
PERSON_KEYS = (*PERSON, *PERSON_LISTS, "person_id", "clothing", "gaze_direction")
CLOTHING_KEYS = ("clothing_garment", "clothing_color")
PRESENCE = ("yes", "no", "unknown")
#: Whose vocabulary the values of a dimension are from, if not its own.
VOCABULARY_OF = {"facial_hair_color": "dominant_colors", "clothing_color": "dominant_colors"}
_ERROR = "array<struct<error:string,place:string>>"


def _under(path: str, names: Column) -> Column:
    return F.transform(names, lambda k: F.concat(F.lit(f"{path}." if path else ""), k))


def _errors(kind: str, places: Column) -> Column:
    return F.transform(places, lambda p: F.struct(F.lit(kind).alias("error"), p.alias("place")))


def validate(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``id``, ``error``, ``place``: what is wrong with a record, each place once.

    ``extra_key``: a key that isn't in the schema, at any depth; persons and clothing have places ``people.persons.<key>`` and
    ``people.persons.clothing.<key>``. ``too_many_items``: more than MOST_ITEMS. ``literal``: a value outside the vocabulary
    (``dimension``, ``label``) of a dimension that has one, or outside PRESENCE; ``unknown`` always holds. Nulls hold too."""
    doc = F.col("text")
    extras = []
    for path, keys in KEYS.items():
        part = F.get_json_object(doc, f"$.{path}") if path else doc
        found = F.array_except(F.json_object_keys(F.when(part.startswith("{"), part)), F.array(*[F.lit(k) for k in keys]))
        extras.append(_under(path, F.coalesce(found, F.array().cast("array<string>"))))
    people = F.get_json_object(doc, "$.cohorts.people")
    persons = F.when(people.startswith("["), people).otherwise(F.get_json_object(people, "$.persons"))
    bodies = F.coalesce(F.from_json(persons, "array<string>"), F.array().cast("array<string>"))
    keys_of = lambda xs: F.flatten(F.transform(xs, lambda x: F.coalesce(F.json_object_keys(F.when(x.startswith("{"), x)), F.array().cast("array<string>"))))
    unknown_keys = lambda xs, keys, path: _under(path, F.array_except(keys_of(xs), F.array(*[F.lit(k) for k in keys])))
    garments = F.flatten(F.transform(bodies, lambda x: F.coalesce(F.from_json(F.get_json_object(x, "$.clothing"), "array<string>"), F.array().cast("array<string>"))))
    extras += [unknown_keys(bodies, PERSON_KEYS, "people.persons"), unknown_keys(garments, CLOTHING_KEYS, "people.persons.clothing")]
    many = F.when(F.size("items") > MOST_ITEMS, F.array(F.struct(F.lit("too_many_items").alias("error"), F.lit("items").alias("place")))).otherwise(F.array().cast(_ERROR))
    shape = records.select("id", F.explode(F.concat(_errors("extra_key", F.array_distinct(F.flatten(F.array(*extras)))), many)).alias("e")).select("id", "e.*")

    tokens = image_tokens(records).select("id", "dimension", "label")
    colours = records.select("id", F.explode(F.flatten(F.transform("persons", lambda p: F.flatten(F.transform(F.coalesce(F.from_json(p["clothing"], "array<struct<clothing_color:string>>"), F.array()), lambda c: as_list(c["clothing_color"])))))).alias("label"))
    colours = colours.where(is_token(F.col("label"))).select("id", F.lit("clothing_color").alias("dimension"), "label").distinct()
    of = F.create_map(*[F.lit(x) for pair in VOCABULARY_OF.items() for x in pair])
    values = tokens.unionByName(colours).withColumn("of", F.coalesce(F.try_element_at(of, F.col("dimension")), F.col("dimension")))
    known = vocabulary.select(F.col("dimension").alias("of"), "label").distinct()
    checked = values.join(known.select("of").distinct(), "of", "left_semi").join(known, ["of", "label"], "left_anti")
    presence = values.where(F.col("dimension").endswith("_present") & ~F.col("label").isin(*PRESENCE))
    wrong = checked.select("id", "dimension").unionByName(presence.select("id", "dimension")).distinct()
    return shape.unionByName(wrong.select("id", F.lit("literal").alias("error"), F.col("dimension").alias("place")))


def colour_errors(errors: DataFrame) -> DataFrame:
    """``id`` of the records that a colour outside the vocabulary makes invalid: these are described again."""
    return errors.where((F.col("error") == "literal") & F.lower("place").contains("color")).select("id").distinct()


def strip_fences(x: Column) -> Column:
    """A text without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def first_object(x: Column) -> Column:
    """The text from the first opening to the last closing brace, or null."""
    found = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def report_rows(lines: DataFrame) -> DataFrame:
    """Tidy rows of summary reports (``line``: JSON text): ``source`` (group or attribute), ``dimension``, ``label``, ``count``."""
    schema = "struct<groups:array<struct<key:string,sub_key:string,canonical_label:string,total_count:string>>,attributes:map<string,string>>"
    doc = lines.select(F.from_json("line", schema).alias("d"))
    g = doc.select(F.explode("d.groups").alias("g")).select(F.lit("group").alias("source"), F.coalesce("g.key", F.lit("unknown")).alias("dimension"), F.coalesce("g.canonical_label", "g.sub_key", F.lit("unknown")).alias("label"), F.coalesce(F.col("g.total_count").try_cast("bigint"), F.lit(0)).alias("count"))
    a = doc.select(F.explode("d.attributes").alias("name", "body")).where(F.col("body").startswith("{"))
    a = a.select("name", F.explode(F.from_json("body", "struct<value_counts:map<string,bigint>>")["value_counts"]).alias("label", "count"))
    return g.unionByName(a.select(F.lit("attribute").alias("source"), F.col("name").alias("dimension"), "label", F.coalesce("count", F.lit(0)).alias("count")))


def spatial_layout(rows: DataFrame) -> DataFrame:
    """Counts and shares of the 3 x 3 grid from labels like ``plane.side``."""
    from dapple.functions.normalize import plane_side

    plane, side = plane_side(F.col("label"))
    g = rows.select(plane.alias("plane"), side.alias("side"), "count").where("plane IS NOT NULL").groupBy("plane", "side").agg(F.sum("count").alias("count"))
    total = g.agg(F.sum("count")).scalar()
    return g.withColumn("share", F.try_divide(F.col("count").cast("double"), total))
