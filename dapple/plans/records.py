"""Nested records, reports, file paths, work lists and raters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dapple.operators import agreement as A
from dapple.operators import tokens as T
from dapple.operators.scenes import SceneCounts
from dapple.plans.common import OBS, observations, rounded
from dapple.runtime import read_table
from dapple.sources import paths as P
from dapple.sources.paths import path_columns, work_plan

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def records(spark, sf_dir):
    return T.parsed(read_table(spark, sf_dir, "audit_records"))


_WHOLE = """WITH whole AS (SELECT record_id AS id, CAST(record AS JSON) AS j FROM audit_records WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
parts AS (SELECT id, j, j->'$.cohorts.people' AS people, j->'$.cohorts.objects' AS objects FROM whole),
raw AS (SELECT id, j, CASE WHEN json_type(people) = 'ARRAY' THEN people ELSE people->'$.persons' END AS p, CASE WHEN json_type(objects) = 'ARRAY' THEN objects ELSE objects->'$.items' END AS i FROM parts),
lists AS (SELECT id, j, list_filter(CASE json_type(p) WHEN 'ARRAY' THEN json_extract(p, '$[*]') WHEN 'OBJECT' THEN [p] ELSE [] END, lambda x: json_type(x) = 'OBJECT') AS persons,
  CASE json_type(i) WHEN 'ARRAY' THEN list_transform(json_extract(i, '$[*]'), lambda x: x->>'$') WHEN 'OBJECT' THEN json_keys(i) ELSE [] END AS items FROM raw)
"""


def _sql_list(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN list_transform(json_extract({x}, '$[*]'), lambda v: v->>'$') WHEN 'NULL' THEN [] ELSE list_filter([{x}->>'$'], lambda v: v IS NOT NULL) END"


_TOKENS = _WHOLE + ", t AS (" + " UNION ALL ".join(
    [f"SELECT id, 'scene_appearance' AS cohort, '{d}' AS dimension, j->>'$.cohorts.scene_appearance.{d}' AS label FROM lists" for d in T.SCENE]
    + [f"SELECT id, 'scene_appearance', '{d}', unnest({_sql_list(f'''(j->'$.cohorts.scene_appearance.{d}')''')}) FROM lists" for d in T.SCENE_LISTS]
    + [f"SELECT id, 'camera', '{d}', j->>'$.cohorts.camera.{d}' FROM lists" for d in T.CAMERA]
    + [f"SELECT id, 'people', '{d}', unnest(persons)->>'$.{d}' FROM lists" for d in T.PERSON]
    + [f"SELECT id, 'people', '{d}', unnest({_sql_list(f'''(p->'$.{d}')''')}) FROM (SELECT id, unnest(persons) AS p FROM lists)" for d in T.PERSON_LISTS]
    + ["SELECT id, 'people', 'clothing_garment', unnest(CASE json_type(c) WHEN 'ARRAY' THEN json_extract(c, '$[*]') WHEN 'OBJECT' THEN [c] ELSE [] END)->>'$.clothing_garment' FROM (SELECT id, unnest(persons)->'$.clothing' AS c FROM lists)"]
    + ["SELECT id, 'objects', 'items', unnest(items) FROM lists"]
) + "), tokens AS (SELECT DISTINCT * FROM t WHERE label IS NOT NULL AND lower(trim(label)) NOT IN ('', 'unknown', 'none'))\n"


@query("a21_x60_x61_x62_token_counts", _TOKENS + "SELECT cohort, dimension, label, count(*) AS count FROM tokens GROUP BY ALL")
def a21(spark, sf_dir):
    return T.token_counts(records(spark, sf_dir))


@query("a22_totals", _WHOLE + "SELECT count(*) AS images, CAST(sum(len(persons)) AS BIGINT) AS people_instances, CAST(sum(len(items)) AS BIGINT) AS object_instances FROM lists")
def a22(spark, sf_dir):
    return T.totals(records(spark, sf_dir))


def _sql_keys(path: str, keys) -> str:
    part = f"(j->'$.{path}')" if path else "j"
    names = ", ".join(f"'{k}'" for k in keys)
    return f"SELECT id, 'extra_key' AS error, '{path + '.' if path else ''}' || k AS place FROM (SELECT id, unnest(json_keys({part})) AS k FROM lists WHERE json_type({part}) = 'OBJECT') WHERE k NOT IN ({names})"


_SQL_KEYS = {
    "": ("schema_version", "image", "cohorts"), "image": ("image_id", "file_path", "source_model", "caption", "source_metadata"), "cohorts": ("scene_appearance", "camera", "objects", "people", "totals"),
    "cohorts.scene_appearance": ("mood", "color_temperature", "weather", "aesthetic_qualities", "dominant_colors"), "cohorts.camera": ("depth_of_field", "framing", "perspective"), "cohorts.objects": ("items",),
    "cohorts.people": ("persons",), "cohorts.totals": ("images", "object_instances", "people_instances"),
}
_ERRORS = _TOKENS.rstrip() + f""", garments AS (SELECT id, unnest(CASE json_type(c) WHEN 'ARRAY' THEN json_extract(c, '$[*]') WHEN 'OBJECT' THEN [c] ELSE [] END) AS g FROM (SELECT id, unnest(persons)->'$.clothing' AS c FROM lists)),
colours AS (SELECT DISTINCT id, 'clothing_color' AS dimension, label FROM (SELECT id, unnest({_sql_list("(g->'$.clothing_color')")}) AS label FROM garments) WHERE label IS NOT NULL AND lower(trim(label)) NOT IN ('', 'unknown', 'none')),
vals AS (SELECT *, CASE WHEN dimension IN ('facial_hair_color', 'clothing_color') THEN 'dominant_colors' ELSE dimension END AS of FROM (SELECT id, dimension, label FROM tokens UNION ALL SELECT * FROM colours)),
errors AS ({" UNION ".join(_sql_keys(p, k) for p, k in _SQL_KEYS.items())}
  UNION SELECT id, 'extra_key', 'people.persons.' || k FROM (SELECT id, unnest(json_keys(p)) AS k FROM (SELECT id, unnest(persons) AS p FROM lists)) WHERE k NOT IN ({", ".join(f"'{k}'" for k in (*T.PERSON, *T.PERSON_LISTS, "person_id", "clothing", "gaze_direction"))})
  UNION SELECT id, 'extra_key', 'people.persons.clothing.' || k FROM (SELECT id, unnest(json_keys(g)) AS k FROM garments WHERE json_type(g) = 'OBJECT') WHERE k NOT IN ('clothing_garment', 'clothing_color')
  UNION SELECT id, 'too_many_items', 'items' FROM lists WHERE len(items) > 3
  UNION SELECT id, 'literal', dimension FROM vals WHERE of IN (SELECT dimension FROM canonical_map) AND (of, label) NOT IN (SELECT (dimension, label) FROM canonical_map WHERE dimension IS NOT NULL AND label IS NOT NULL)
  UNION SELECT id, 'literal', dimension FROM vals WHERE suffix(dimension, '_present') AND label NOT IN ('yes', 'no', 'unknown'))
"""


@query("v01_validation", _ERRORS + "SELECT * FROM errors")
def v01(spark, sf_dir):
    return T.validate(records(spark, sf_dir), read_table(spark, sf_dir, "canonical_map"))


@query("v02_colour_errors", _ERRORS + "SELECT DISTINCT id FROM errors WHERE error = 'literal' AND contains(lower(place), 'color')")
def v02(spark, sf_dir):
    return T.colour_errors(v01(spark, sf_dir))


@query("v03_fences", "SELECT record_id, json_valid(record) AS whole, length(trim(record)) AS n FROM audit_records WHERE record IS NOT NULL")
def v03(spark, sf_dir):
    r = read_table(spark, sf_dir, "audit_records").where("record IS NOT NULL")
    fenced = r.withColumn("x", T.strip_fences(F.concat(F.lit("```json\n"), F.trim("record"), F.lit("\n```"))))
    return fenced.select("record_id", F.try_parse_json("x").isNotNull().alias("whole"), F.length("x").cast("bigint").alias("n"))


@query("s14_image_ids", "SELECT record_id, coalesce(CASE WHEN json_valid(record) THEN record->>'$.image.image_id' END, image_id) AS image FROM audit_records")
def s14(spark, sf_dir):
    r = read_table(spark, sf_dir, "audit_records")
    return r.select("record_id", F.coalesce(F.when(F.try_parse_json("record").isNotNull(), F.get_json_object("record", "$.image.image_id")), F.col("image_id")).alias("image"))


_LINES = """WITH lines AS (SELECT unnest(string_split(body, chr(10))) AS line FROM drift_files WHERE kind = 'summary_report'), doc AS (SELECT CAST(line AS JSON) AS d FROM lines WHERE json_valid(line)),
g AS (SELECT unnest(json_extract(d, '$.groups[*]')) AS g FROM doc), a AS (SELECT unnest(json_keys(d->'$.attributes')) AS name, d->'$.attributes' AS attrs FROM doc),
vc AS (SELECT name, attrs->name->'value_counts' AS vc FROM a WHERE json_type(attrs->name) = 'OBJECT'), cells AS (SELECT name, unnest(json_keys(vc)) AS label, vc FROM vc WHERE json_type(vc) = 'OBJECT'),
tidy AS (SELECT 'group' AS source, coalesce(g->>'$.key', 'unknown') AS dimension, coalesce(g->>'$.canonical_label', g->>'$.sub_key', 'unknown') AS label, coalesce(TRY_CAST(CASE WHEN json_type(g->'$.total_count') IN ('UBIGINT', 'BIGINT') THEN g->>'$.total_count' END AS BIGINT), 0) AS count FROM g
  UNION ALL SELECT 'attribute', name, label, coalesce(TRY_CAST(vc->>label AS BIGINT), 0) FROM cells)
"""


def _lines(spark, sf_dir):
    files = read_table(spark, sf_dir, "drift_files").where("kind = 'summary_report'")
    return files.select(F.explode(F.split("body", "\n")).alias("line")).where(F.try_parse_json("line").isNotNull())


@query("a27_r03_f13_report_counts", _LINES + "SELECT source, dimension, count(*) AS n, CAST(sum(count) AS BIGINT) AS total FROM tidy WHERE lower(label) <> 'unknown' GROUP BY ALL")
def a27(spark, sf_dir):
    tidy = T.report_rows(_lines(spark, sf_dir)).where("lower(label) != 'unknown'")
    return tidy.groupBy("source", "dimension").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


@query("a28_x47_spatial", """WITH p AS (SELECT regexp_extract(lower(label), '(foreground|midground|background)', 1) AS plane, regexp_extract(lower(label), '(left|center|right)', 1) AS side, count FROM rollup_raw WHERE lower(dimension) = 'object_counts_by_position'),
g AS (SELECT plane, side, CAST(sum(count) AS BIGINT) AS count FROM p WHERE plane <> '' AND side <> '' GROUP BY ALL) SELECT plane, side, count, round(count::DOUBLE / sum(count) OVER (), 9) AS share FROM g""")  # fmt: skip
def a28(spark, sf_dir):
    r = read_table(spark, sf_dir, "rollup_raw").where("lower(dimension) = 'object_counts_by_position'")
    dotted = F.concat_ws(".", F.regexp_extract(F.lower("label"), "(foreground|midground|background)", 1), F.regexp_extract(F.lower("label"), "(left|center|right)", 1))
    return rounded(T.spatial_layout(r.select(dotted.alias("label"), "count")))


@query("s01_s02_s04_s06_s13_x53_paths", """WITH p AS (SELECT file_id, string_split(file_path, '/') AS s FROM tiny_files), i AS (SELECT *, list_position(s, 'frequency') AS pos FROM p WHERE list_contains(s, 'frequency'))
SELECT file_id, s[1] AS model, s[2] AS context, s[3] AS occupation, CASE WHEN pos >= 6 THEN s[4] ELSE 'no_type' END AS type, s[pos - 1] AS prompt, s[-1] AS file, starts_with(s[-1], '.') AS hidden FROM i""")  # fmt: skip
def s01(spark, sf_dir):
    files = read_table(spark, sf_dir, "tiny_files").where(F.col("file_path").contains("/frequency/"))
    return path_columns(files, "file_path").select("file_id", "model", "context", "occupation", "type", "prompt", "file", "hidden")


_FILES = "files AS (SELECT file_path AS path FROM tiny_files UNION SELECT j->>'$.image.file_path' FROM (SELECT CAST(record AS JSON) AS j FROM audit_records WHERE json_valid(record)) WHERE coalesce(j->>'$.image.file_path', '') <> '')"


def _files(spark, sf_dir):
    """Paths of the small files and of the images that records name."""
    images = read_table(spark, sf_dir, "audit_records").where(F.try_parse_json("record").isNotNull()).select(F.get_json_object("record", "$.image.file_path").alias("path"))
    return read_table(spark, sf_dir, "tiny_files").select(F.col("file_path").alias("path")).unionByName(images.where("path != ''")).distinct()


@query("s07_prompt_folders", f"WITH {_FILES} SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM files WHERE regexp_extract(path, '[^/]*$') = 'frequencies.csv'")
def s07(spark, sf_dir):
    return P.prompt_folders(_files(spark, sf_dir), "frequencies.csv")


@query("s08_manifests", f"""WITH {_FILES}, folder AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM files), json AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, min(path) AS path FROM files WHERE suffix(lower(path), '.json') GROUP BY ALL)
SELECT folder, path AS manifest FROM folder LEFT JOIN json USING (folder)""")  # fmt: skip
def s08(spark, sf_dir):
    files = _files(spark, sf_dir)
    return P.manifest_of(files.select(P.parent(F.col("path")).alias("folder")).distinct(), files, files)


@query("s09_image_paths", f"""WITH {_FILES}, r AS (SELECT record_id, image_id, CAST(record AS JSON)->>'$.image.file_path' AS rel FROM audit_records WHERE json_valid(record)), c AS (
  SELECT record_id, 1 AS rank, rel AS path FROM r UNION ALL SELECT record_id, 2, source_model || '/' || image_id || '.png' FROM audit_records JOIN r USING (record_id, image_id))
SELECT record_id, arg_min(f.path, rank) AS path FROM r LEFT JOIN c USING (record_id) LEFT JOIN files f ON f.path = c.path AND c.path <> '' GROUP BY ALL""")  # fmt: skip
def s09(spark, sf_dir):
    r = read_table(spark, sf_dir, "audit_records").where(F.try_parse_json("record").isNotNull())
    named = r.select("record_id", F.get_json_object("record", "$.image.file_path").alias("relpath"), F.col("source_model").alias("folder"), F.concat("image_id", F.lit(".png")).alias("filename"))
    return P.resolved_images(named, _files(spark, sf_dir), "record_id")


_LOW = "list_transform(string_split(folder, '/'), lambda p: replace(lower(trim(p)), ' ', '_'))"


@query("s20_manifest", f"""WITH {_FILES}, i AS (SELECT path, regexp_extract(path, '[^/]*$') AS filename, regexp_replace(path, '/?[^/]*$', '') AS folder FROM files WHERE regexp_matches(lower(path), '\\.(png|jpe?g)$')),
n AS (SELECT *, list_filter(list_transform(list_reverse({_LOW}), lambda p: CASE WHEN p IN ('context-aware_related_ca-r', 'context-aware_related', 'ca-r') THEN 'CA-R' WHEN p IN ('context-aware_unrelated_ca-u', 'context-aware_unrelated', 'ca-u') THEN 'CA-U' WHEN p IN ('context-free_cf', 'context-free', 'cf') THEN 'CF' END), lambda c: c IS NOT NULL) AS c FROM i)
SELECT folder, regexp_replace(filename, '\\.[^.]*$', '') AS id, replace(regexp_extract(folder, '[^/]*$'), '_', ' ') AS prompt_used, filename, path AS relpath, regexp_extract(regexp_replace(folder, '/?[^/]*$', ''), '[^/]*$') AS role, coalesce(c[1], '') AS context FROM n""")  # fmt: skip
def s20(spark, sf_dir):
    return P.build_manifest(_files(spark, sf_dir))


@query("s12_source_files", f"WITH {_FILES} SELECT path FROM files WHERE regexp_matches(path, '(^|/)frequency/[^/]*[.]csv$') AND NOT list_has_any(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), ['Lumen-XT', 'descriptions'])")
def s12(spark, sf_dir):
    return P.source_files(_files(spark, sf_dir), "frequency", ("Lumen-XT", "descriptions"))


@query("k09_exported_files", f"WITH {_FILES} SELECT path FROM files WHERE regexp_matches(lower(path), '\\.(json|csv)$') AND regexp_extract(path, '[^/]*$') NOT IN ('metadata.json', 'manifest.json', 'images_info.json')")
def k09(spark, sf_dir):
    return P.exported_files(_files(spark, sf_dir))


@query("s10_summary_reports", "SELECT record_id FROM audit_records WHERE json_valid(record) AND json_type(record) = 'OBJECT' AND list_contains(json_keys(record), 'cohorts')")
def s10(spark, sf_dir):
    r = read_table(spark, sf_dir, "audit_records").where(F.try_parse_json("record").isNotNull())
    return P.summary_reports(r, "record").select("record_id")


@query("z04_j13_x65_f17_work_plan", """WITH want AS (SELECT DISTINCT occupation AS prompt, image_id FROM documents WHERE image_id IS NOT NULL AND occupation IS NOT NULL), have AS (SELECT DISTINCT image_id FROM audit_records WHERE json_valid(record)),
m AS (SELECT w.prompt, w.image_id, h.image_id IS NOT NULL AS done FROM want w LEFT JOIN have h USING (image_id))
SELECT prompt, count(*) AS expected, count(*) FILTER (done) AS existing, CASE WHEN bool_and(done) THEN 'complete' WHEN bool_or(done) THEN 'resume' ELSE 'pending' END AS status, min(image_id) FILTER (NOT done) AS first_missing, max(image_id) FILTER (done) AS last_done FROM m GROUP BY ALL""")  # fmt: skip
def z04(spark, sf_dir):
    want = read_table(spark, sf_dir, "documents").select(F.col("occupation").alias("prompt"), "image_id")
    have = records(spark, sf_dir).select("id").join(read_table(spark, sf_dir, "audit_records").select(F.col("record_id").alias("id"), "image_id"), "id")
    return work_plan(want, have.select("image_id"))


@query("z06_first_gap", """WITH want AS (SELECT DISTINCT occupation AS prompt, image_id FROM documents WHERE image_id IS NOT NULL AND occupation IS NOT NULL), have AS (SELECT DISTINCT image_id FROM audit_records WHERE json_valid(record)),
m AS (SELECT w.prompt, w.image_id, (h.image_id IS NOT NULL)::INTEGER AS done FROM want w LEFT JOIN have h USING (image_id)),
g AS (SELECT *, min(CASE WHEN done = 0 THEN image_id END) OVER (PARTITION BY prompt) AS gap FROM m), e AS (SELECT *, min(CASE WHEN done = 1 AND image_id > gap THEN image_id END) OVER (PARTITION BY prompt) AS stop FROM g)
SELECT prompt, image_id FROM e WHERE done = 0 AND (stop IS NULL OR image_id < stop)""")  # fmt: skip
def z06(spark, sf_dir):
    from dapple.sources.paths import next_batch

    want = read_table(spark, sf_dir, "documents").select(F.col("occupation").alias("prompt"), "image_id")
    have = records(spark, sf_dir).select("id").join(read_table(spark, sf_dir, "audit_records").select(F.col("record_id").alias("id"), "image_id"), "id")
    return next_batch(want, have.select("image_id"))


@query("w05_u05_first_text", "SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def w05(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


# Raters: the models; a file is an occupation, an item a dimension in a type and prompt.
_RATED = OBS + """, r AS (SELECT model AS rater, occupation AS stem, type || '-' || prompt AS cohort, dimension, label, CAST(sum(count) AS BIGINT) AS c FROM obs GROUP BY ALL),
maj AS (SELECT rater, stem, cohort, dimension, label FROM r QUALIFY row_number() OVER (PARTITION BY rater, stem, cohort, dimension ORDER BY c DESC, label) = 1),
pairs AS (SELECT x.stem, x.cohort, x.dimension, x.rater AS rater_a, y.rater AS rater_b, x.label AS a, y.label AS b FROM maj x JOIN maj y ON x.stem = y.stem AND x.cohort = y.cohort AND x.dimension = y.dimension AND x.rater < y.rater)
"""


def _majority(spark, sf_dir):
    r = observations(spark, sf_dir).groupBy(F.col("model").alias("rater"), F.col("occupation").alias("stem"), F.concat_ws("-", "type", "prompt").alias("cohort"), "dimension", "label").agg(F.sum("count").alias("count"))
    numbered = r.withColumn("row_no", F.row_number().over(Window.partitionBy("rater", *A.ITEM).orderBy("label")))
    return A.majority_labels(numbered)


@query("a32_n13_majority", _RATED + "SELECT * FROM maj")
def a32(spark, sf_dir):
    return _majority(spark, sf_dir)


@query("j09_j11_j12_s17_pairs", _RATED + "SELECT * FROM pairs")
def j12(spark, sf_dir):
    return A.rater_pairs(_majority(spark, sf_dir))


def _sql_scores(by: str) -> str:
    return f"""SELECT {by}, g.n, round(po, 9) AS raw_agreement, round(macro_recall, 9) AS macro_recall, round(CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END, 9) + 0.0 AS kappa
FROM (SELECT {by}, count(*) AS n, avg((a = b)::INTEGER) AS po FROM pairs GROUP BY ALL) g JOIN (SELECT {by}, avg(r) AS macro_recall FROM (SELECT {by}, a, avg((a = b)::INTEGER) AS r FROM pairs GROUP BY ALL) GROUP BY ALL) m USING ({by})
JOIN (SELECT {by}, sum(na * nb) / (sum(DISTINCT n) * sum(DISTINCT n))::DOUBLE AS pe FROM (SELECT {by}, a AS c, count(*) AS na FROM pairs GROUP BY ALL) JOIN (SELECT {by}, b AS c, count(*) AS nb FROM pairs GROUP BY ALL) USING ({by}, c) JOIN (SELECT {by}, count(*) AS n FROM pairs GROUP BY ALL) USING ({by}) GROUP BY {by}) e USING ({by})"""


@query("a33_a34_pair_scores", _RATED + _sql_scores("stem, rater_a, rater_b"))
def a33(spark, sf_dir):
    return rounded(A.pair_scores(A.rater_pairs(_majority(spark, sf_dir)), ["stem", "rater_a", "rater_b"]))


@query("a36_pooled_scores", _RATED + _sql_scores("rater_a, rater_b"))
def a36(spark, sf_dir):
    return rounded(A.pair_scores(A.rater_pairs(_majority(spark, sf_dir)), ["rater_a", "rater_b"]))


@query("a35_j10_fleiss", _RATED + """, cnt AS (SELECT stem, cohort, dimension, label, count(*) AS n FROM maj GROUP BY ALL), full_items AS (SELECT stem, cohort, dimension FROM cnt GROUP BY ALL HAVING sum(n) = 4), c AS (SELECT cnt.* FROM cnt JOIN full_items USING (stem, cohort, dimension)),
bar AS (SELECT stem, count(*) AS items, avg(p) AS p_bar FROM (SELECT stem, cohort, dimension, (sum(n * n) - 4) / 12.0 AS p FROM c GROUP BY ALL) GROUP BY ALL), pe AS (SELECT stem, sum(m * m) / (sum(m) * sum(m))::DOUBLE AS p_e FROM (SELECT stem, label, sum(n) AS m FROM c GROUP BY ALL) GROUP BY ALL)
SELECT stem, items, round((p_bar - p_e) / (1 - p_e), 9) + 0.0 AS kappa FROM bar JOIN pe USING (stem)""")  # fmt: skip
def a35(spark, sf_dir):
    return rounded(A.fleiss(A.category_counts(_majority(spark, sf_dir), 4), 4, ["stem"]))


@query("b06_x12_fleiss_interval")
def b06(spark, sf_dir):
    return A.fleiss_interval(A.category_counts(_majority(spark, sf_dir), 4), 4, ["stem"])


def _scenes(spark, sf_dir):
    """Scene documents made from the audit records: an item is an object whose last word is its type and whose place follows its number."""
    r = records(spark, sf_dir)
    j = lambda path: F.col(f"json.cohorts.{path}")
    garments = lambda p: F.transform(F.coalesce(F.from_json(p["clothing"], "array<struct<clothing_garment:string,clothing_color:string>>"), F.array()), lambda c: F.struct(c["clothing_garment"].alias("garment_type"), T.as_list(c["clothing_color"]).alias("color")))
    node = lambda p, present, style, colour, name="style": F.struct(p[present].alias("present"), p[style].alias(name), *([p[colour].alias("color")] if colour else []))
    person = lambda p: F.struct(
        p["gender_presentation"].alias("gender_presentation"), p["skin_tone"].alias("skin_tone"), p["age_range"].alias("age_range"), p["pose"].alias("pose"), T.as_list(p["activities"]).alias("activities"),
        node(p, "hair_present", "hair_style", "hair_color").alias("hair"), node(p, "facial_hair_present", "facial_hair_style", "facial_hair_color").alias("facial_hair"),
        node(p, "eyewear_present", "eyewear_type", None, "type").alias("eyewear"), node(p, "head_covering_present", "head_covering_type", None, "type").alias("head_covering"), garments(p).alias("clothing"),
    )
    plane = lambda i: F.when(i == 0, "foreground").when(i == 1, "midground").otherwise("background")
    objects = F.transform("items", lambda x, i: F.struct(F.element_at(F.split(x, " "), -1).alias("type"), x.alias("subtype"), plane(i).alias("plane"), F.lit("left").alias("side"), F.struct(F.length(x).alias("exact")).alias("quantity")))
    scene = F.struct(
        F.struct(j("scene_appearance.mood").alias("mood"), T.as_list(j("scene_appearance.dominant_colors")).alias("dominant_palette"), F.struct(j("scene_appearance.color_temperature").alias("color_temperature"), T.as_list(j("scene_appearance.aesthetic_qualities")).alias("aesthetic_qualities")).alias("lighting_profile")).alias("atmosphere"),
        F.struct(j("scene_appearance.weather").alias("weather")).alias("environment"), F.struct(F.transform("persons", person).alias("persons")).alias("people"), objects.alias("objects"),
        F.struct(*[j(f"camera.{c}").alias(c) for c in ("perspective", "depth_of_field", "framing")]).alias("camera"),
    )
    return r.select(F.to_json(scene).alias("scene"))


_CLEAN = "trim(regexp_replace(lower(strip_accents(v)), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_STOP = "'a', 'an', 'and', 'the', 'of', 'for', 'to', 'in', 'on', 'at', 'from', 'with', 'this', 'that', 'is', 'are', 'was', 'were', 'be', 'been', 'as', 'it', 'its', 'their', 'his', 'her', 'your', 'our'"
_NORM = f"array_to_string(list_transform(list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '' AND w NOT IN ({_STOP})), lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN w[1:-2] ELSE w END), '_')"


def _sql_found(path: str, kind: str, source: str, x: str, many: bool = False) -> str:
    value = f"unnest({_sql_list(x)})" if many else f"({x})->>'$'"
    name = {"cluster": _NORM, "enum": f"coalesce(nullif({_CLEAN}, ''), 'unknown')", "colour": f"replace({_CLEAN}, ' ', '_')"}[kind]
    return f"SELECT '{path}' AS path, {name} AS value FROM (SELECT trim(v) AS v FROM (SELECT {value} AS v FROM {source})) WHERE v <> ''"


_PEOPLE = "(SELECT unnest(persons) AS p FROM lists)"
_SCENE = _WHOLE.rstrip() + ", v AS (" + " UNION ALL ".join([
    _sql_found("atmosphere.mood", "cluster", "lists", "j->'$.cohorts.scene_appearance.mood'"), _sql_found("atmosphere.dominant_palette", "colour", "lists", "(j->'$.cohorts.scene_appearance.dominant_colors')", True),
    _sql_found("atmosphere.lighting_profile.color_temperature", "enum", "lists", "j->'$.cohorts.scene_appearance.color_temperature'"), _sql_found("atmosphere.lighting_profile.aesthetic_qualities", "cluster", "lists", "(j->'$.cohorts.scene_appearance.aesthetic_qualities')", True),
    _sql_found("environment.weather", "cluster", "lists", "j->'$.cohorts.scene_appearance.weather'"),
    *[_sql_found(f"camera.{c}", k, "lists", f"j->'$.cohorts.camera.{c}'") for c, k in (("perspective", "cluster"), ("depth_of_field", "enum"), ("framing", "cluster"))],
    *[_sql_found(f"people.demographics.{c}", "enum", _PEOPLE, f"p->'$.{c}'") for c in ("gender_presentation", "skin_tone", "age_range")],
    _sql_found("people.pose_activity.pose", "cluster", _PEOPLE, "p->'$.pose'"), _sql_found("people.pose_activity.activities", "cluster", _PEOPLE, "(p->'$.activities')", True),
    *[_sql_found(f"people.appearance.{s}.present", "enum", _PEOPLE, f"p->'$.{s}_present'") for s in ("hair", "facial_hair", "eyewear", "head_covering")],
    *[_sql_found(f"people.appearance.{s}.{c}", k, _PEOPLE, f"p->'$.{s}_{c}'") for s, c, k in (("hair", "style", "cluster"), ("hair", "color", "colour"), ("facial_hair", "style", "cluster"), ("facial_hair", "color", "colour"), ("eyewear", "type", "cluster"), ("head_covering", "type", "cluster"))],
]) + f"""), o AS (SELECT string_split(x, ' ')[-1] AS type, x AS subtype, CASE no WHEN 1 THEN 'foreground' WHEN 2 THEN 'midground' ELSE 'background' END AS plane, 'left' AS side, length(x) AS exact FROM (SELECT unnest(items) AS x, generate_subscripts(items, 1) AS no FROM lists)),
known AS (SELECT coalesce(nullif(trim(type), ''), 'unknown') AS type, coalesce(nullif(trim(subtype), ''), 'unknown') AS subtype, plane, side, exact FROM o),
objects AS (SELECT {_NORM.replace("(v)", "(type)")} AS type, {_NORM.replace("(v)", "(subtype)")} AS subtype, plane, side, exact FROM known)
"""  # fmt: skip


@query("a30_x64_scene_values", _SCENE + " SELECT path, value, count(*) AS count FROM (SELECT * FROM v UNION ALL SELECT 'objects.type', type FROM objects UNION ALL SELECT 'objects.subtype', subtype FROM objects UNION ALL SELECT 'objects.plane', plane FROM objects UNION ALL SELECT 'objects.side', side FROM objects) GROUP BY ALL")
def a30_values(spark, sf_dir):
    return SceneCounts(_scenes(spark, sf_dir), embed=None).value_counts()


@query("a30_x64_scene_objects", _SCENE + """, pair AS (SELECT *, type || '|||' || subtype AS pair, plane || '.' || side AS position FROM objects), b AS (SELECT 'by_type' AS section, type AS bucket, * FROM pair UNION ALL SELECT 'by_type_subtype', pair, * FROM pair)
SELECT section, bucket, 'count' AS field, '' AS value, count(*) AS count FROM b GROUP BY ALL UNION ALL SELECT section, bucket, 'quantity.exact_sum', '', CAST(sum(exact) AS BIGINT) FROM b GROUP BY ALL UNION ALL SELECT section, bucket, 'quantity.exact_present_count', '', count(exact) FROM b GROUP BY ALL
UNION ALL SELECT section, bucket, 'positions.plane_side', position, count(*) FROM b GROUP BY ALL UNION ALL SELECT 'by_type', type, 'by_subtype', subtype, count(*) FROM pair GROUP BY ALL
UNION ALL SELECT 'by_position', position, 'type_counts', type, count(*) FROM pair GROUP BY ALL UNION ALL SELECT 'by_position', position, 'type_subtype_counts', pair, count(*) FROM pair GROUP BY ALL
UNION ALL SELECT 'by_position', position, 'total', '', CAST(sum(n) AS BIGINT) FROM (SELECT position, 1 AS n FROM pair UNION ALL SELECT p || '.' || s, 0 FROM (SELECT unnest(['foreground', 'midground', 'background']) AS p), (SELECT unnest(['left', 'center', 'right']) AS s)) GROUP BY ALL""")  # fmt: skip
def a30_objects(spark, sf_dir):
    return SceneCounts(_scenes(spark, sf_dir), embed=None).object_counts()


@query("a30_scene_garments", _SCENE + f""", g AS (SELECT unnest(CASE json_type(c) WHEN 'ARRAY' THEN json_extract(c, '$[*]') WHEN 'OBJECT' THEN [c] ELSE [] END) AS g FROM (SELECT p->'$.clothing' AS c FROM {_PEOPLE})),
n AS (SELECT g, {_NORM} AS bucket FROM (SELECT g, coalesce(nullif(trim(g->>'$.clothing_garment'), ''), 'unknown') AS v FROM g WHERE json_type(g) = 'OBJECT')),
c AS (SELECT bucket, trim(v) AS v FROM (SELECT bucket, unnest({_sql_list("(g->'$.clothing_color')")}) AS v FROM n))
SELECT bucket, 'count' AS field, '' AS value, count(*) AS count FROM n GROUP BY ALL UNION ALL SELECT bucket, 'color', replace({_CLEAN}, ' ', '_') AS value, count(*) FROM c WHERE v <> '' GROUP BY ALL""")  # fmt: skip
def a30_garments(spark, sf_dir):
    return SceneCounts(_scenes(spark, sf_dir), embed=None).garment_counts()


@query("c04_c05_c06_c07_c08_scene_names")
def c05(spark, sf_dir):
    return SceneCounts(_scenes(spark, sf_dir)).names
