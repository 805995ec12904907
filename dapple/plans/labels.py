"""Normalisers, rollups and exploration over role files and reviewers' labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from dapple.functions import normalize as N
from dapple.functions.stats import safe_div
from dapple.operators import rollup as R
from dapple.plans.common import rounded
from dapple.runtime import read_table
from dapple.sources.paths import role_and_model

QUERIES: dict = {}
SQL: dict[str, str] = {}
WS = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rows(spark, sf_dir):
    return read_table(spark, sf_dir, "role_rollup")


def labels(spark, sf_dir):
    return rows(spark, sf_dir).select("label").distinct()


LABEL_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(" + WS.format("coalesce({0}, '')") + r"), '[\s\-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
SIMPLE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '[_-]', ' ', 'g'), '[^\p{{L}}\p{{N}}_|=, ]', '', 'g'), '\s+', ' ', 'g'))"
SLUG = r"regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g')"
WORDS = "regexp_extract_all({0}, '[a-z0-9]+')"


@query("x20_label_key", f"SELECT DISTINCT label, {LABEL_KEY.format('label')} AS key FROM role_rollup")
def x20(spark, sf_dir):
    return labels(spark, sf_dir).select("label", N.label_key(F.col("label")).alias("key"))


@query("x21_x22_x23_simple", f"SELECT DISTINCT label, {SIMPLE.format('label')} AS simple, replace({SIMPLE.format('label')}, ' ', '_') AS key, regexp_matches(label, '[|=,]') AS structured FROM role_rollup")
def x21(spark, sf_dir):
    return labels(spark, sf_dir).select("label", N.simple(F.col("label")).alias("simple"), N.simple_key(F.col("label")).alias("key"), N.is_structured(F.col("label")).alias("structured"))


_KEY_OF = "replace(" + SIMPLE + ", ' ', '_')"


def _sql_values(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({x}, ','), lambda v: {_KEY_OF.format('v')}), lambda v: v <> ''))), ',')"


@query("x24_structured", f"""WITH l AS (SELECT DISTINCT label FROM role_rollup)
SELECT label, array_to_string(list_filter(list_transform(string_split(coalesce(label, ''), '|'), lambda s: CASE WHEN contains(s, '=') THEN {_KEY_OF.format("split_part(s, '=', 1)")} || '=' || {_sql_values("s[strpos(s, '=') + 1:]")} ELSE {_sql_values("s")} END), lambda s: s <> ''), '|') AS structured FROM l""")  # fmt: skip
def x24(spark, sf_dir):
    return labels(spark, sf_dir).select("label", N.structured(F.col("label")).alias("structured"))


@query("x25_best_token", f"""
WITH t AS (SELECT dimension, label, replace({SIMPLE.format('label')}, ' ', '_') AS key, sum(coalesce(count, 0)) AS c FROM role_rollup WHERE label IS NOT NULL AND dimension IS NOT NULL GROUP BY ALL)
SELECT dimension, key, label AS best FROM t QUALIFY row_number() OVER (PARTITION BY dimension, key ORDER BY len(string_split(label, ' ')), length(regexp_replace(label, '[^0-9]', '', 'g')), length(regexp_replace(label, '[^_]', '', 'g')), -c, length(label), label) = 1""")  # fmt: skip
def x25(spark, sf_dir):
    t = rows(spark, sf_dir).where("label IS NOT NULL AND dimension IS NOT NULL").groupBy("dimension", "label", N.simple_key(F.col("label")).alias("key")).agg(F.sum(F.coalesce("count", F.lit(0))).alias("c"))
    return t.groupBy("dimension", "key").agg(F.min_by("label", N.quality(F.col("label"), F.col("c"))).alias("best"))


@query("x27_x28_x29_x30_families", """
SELECT DISTINCT dimension, CASE WHEN regexp_matches(lower(dimension), 'scene|location|background|setting|environment|scene_appearance') THEN 'Scene' WHEN regexp_matches(lower(dimension), 'camera|angle|view|shot|framing|composition') THEN 'Camera'
  WHEN regexp_matches(lower(dimension), 'object|item|tool|accessor|accessories|clothing|prop') THEN 'Objects' WHEN regexp_matches(lower(dimension), 'people|person|gender|age|race|ethnic|body|hair|face|skin') THEN 'People'
  ELSE array_to_string(list_transform(string_split(lower(dimension), '_'), lambda w: upper(w[1]) || w[2:]), '_') END AS family,
  CASE WHEN regexp_matches(lower(cohort), 'people|person|gender|age|race|ethnic|body|hair|face|skin') THEN 'People' WHEN regexp_matches(lower(cohort), 'object|item|tool|accessor|accessories|clothing|prop') THEN 'Objects'
  WHEN regexp_matches(lower(cohort), 'camera|angle|view|shot|framing|composition') THEN 'Camera' WHEN regexp_matches(lower(cohort), 'scene|location|background|setting|environment|scene_appearance') THEN 'Scene' END AS cohort_family
FROM role_rollup WHERE dimension IS NOT NULL""")  # fmt: skip
def x27(spark, sf_dir):
    d = rows(spark, sf_dir).where("dimension IS NOT NULL").select("dimension", "cohort").distinct()
    return d.select("dimension", N.family(F.col("dimension")).alias("family"), N.family_of_cohort(F.col("cohort")).alias("cohort_family")).distinct()


_SLUGGED = f"coalesce(nullif({SLUG.format('label')}, ''), 'value')"


@query("x33_x34_slugs", f"SELECT DISTINCT label, {_SLUGGED} AS slug, regexp_replace(regexp_replace(label, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS spaced FROM role_rollup")
def x33(spark, sf_dir):
    return labels(spark, sf_dir).select("label", N.slug(F.col("label")).alias("slug"), N.spaces(F.col("label")).alias("spaced"))


@query("k11_limited_slug", f"WITH s AS (SELECT DISTINCT label, {_SLUGGED} AS s FROM role_rollup) SELECT label, CASE WHEN length(s) <= 16 THEN s ELSE s[1:7] || '-' || md5(s)[1:8] END AS slug FROM s")
def k11(spark, sf_dir):
    return labels(spark, sf_dir).select("label", N.limited_slug(F.col("label"), 16).alias("slug"))


# The word lists stand here as well, so that the SQL can tell a wrong one.
_PRESENT = "'present', 'yes', 'y', 'true', 'with', 'wearing', 'visible', 'on'"
_ABSENT = "'absent', 'no', 'n', 'false', 'without', 'none', 'not', 'missing'"
_UNKNOWN = ("unknown", "unk", "n/a", "na")


def _has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query("x37_presence", f"""WITH l AS (SELECT DISTINCT lower(label) AS label FROM role_rollup WHERE label IS NOT NULL)
SELECT label, CASE WHEN {_has('label', _UNKNOWN)} THEN 'unknown' WHEN list_has_any({WORDS.format('label')}, [{_PRESENT}]) THEN 'yes' WHEN list_has_any({WORDS.format('label')}, [{_ABSENT}]) THEN 'no'
  WHEN {_has('label', ('without', 'absent'))} THEN 'no' WHEN {_has('label', ('with', 'present'))} THEN 'yes' ELSE 'unknown' END AS presence FROM l""")  # fmt: skip
def x37(spark, sf_dir):
    return rows(spark, sf_dir).where("label IS NOT NULL").select(F.lower("label").alias("label")).distinct().withColumn("presence", N.presence(F.col("label")))


@query("x38_x39_groups", """WITH l AS (SELECT DISTINCT lower(label) AS label FROM role_rollup WHERE label IS NOT NULL)
SELECT label, CASE WHEN contains(label, 'female') THEN 'female' WHEN contains(label, 'male') THEN 'male' ELSE 'unknown' END AS gender,
  CASE WHEN contains(label, 'cool') THEN 'cool' WHEN contains(label, 'warm') THEN 'warm' WHEN contains(label, 'neutral') THEN 'neutral' WHEN contains(label, 'unknown') THEN 'unknown' ELSE label END AS temperature,
  CASE WHEN contains(label, 'high') THEN 'high' WHEN contains(label, 'low') THEN 'low' WHEN contains(label, 'medium') OR contains(label, 'moderate') THEN 'medium' WHEN contains(label, 'unknown') THEN 'unknown' ELSE label END AS contrast FROM l""")  # fmt: skip
def x38(spark, sf_dir):
    low = rows(spark, sf_dir).where("label IS NOT NULL").select(F.lower("label").alias("label")).distinct()
    return low.select("label", N.gender(F.col("label")).alias("gender"), N.temperature(F.col("label")).alias("temperature"), N.contrast(F.col("label")).alias("contrast"))


_COLOURS = "'black', 'white', 'brown', 'blue', 'red', 'green', 'orange', 'yellow', 'purple', 'pink', 'cyan', 'magenta', 'grey', 'gray', 'beige', 'silver', 'gold', 'ghostwhite'"


@query("x40_palette", f"""WITH l AS (SELECT DISTINCT label, {WORDS.format('lower(label)')} AS w FROM role_rollup WHERE label IS NOT NULL)
SELECT label, CASE WHEN len(list_filter(w, lambda t: t IN ({_COLOURS}))) > 0 THEN CASE list_filter(w, lambda t: t IN ({_COLOURS}))[1] WHEN 'grey' THEN 'gray' ELSE list_filter(w, lambda t: t IN ({_COLOURS}))[1] END ELSE coalesce(w[1], 'unknown') END AS colour FROM l""")  # fmt: skip
def x40(spark, sf_dir):
    return labels(spark, sf_dir).where("label IS NOT NULL").select("label", N.palette(N.words_of(F.lower("label"))).alias("colour"))


@query("x41_x44_types", """WITH l AS (SELECT DISTINCT lower(label) AS label FROM role_rollup WHERE label IS NOT NULL)
SELECT label, regexp_replace(regexp_replace(regexp_replace(label, ' (group|cluster|set|objects|object|total|items|item)$', ''), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS object_type,
  regexp_replace(regexp_replace(regexp_replace(label, '(?i)\\bactivit(y|ies)\\b', '', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS activity FROM l""")  # fmt: skip
def x41(spark, sf_dir):
    low = rows(spark, sf_dir).where("label IS NOT NULL").select(F.lower("label").alias("label")).distinct()
    return low.select("label", N.object_type(F.col("label")).alias("object_type"), N.activities(F.col("label")).alias("activity"))


_MAPPED = "replace(CASE s WHEN 'neck accessory' THEN 'necklace' WHEN 'neck chain' THEN 'necklace' WHEN 'vest or suspenders' THEN 'vest' WHEN 't shirt' THEN 't-shirt' WHEN 'tshirt' THEN 't-shirt' WHEN 'tee shirt' THEN 't-shirt' ELSE s END, 'short-sleeved', 'short sleeved')"


@query("x42_garment", f"""WITH l AS (SELECT DISTINCT lower(label) AS label, string_split(replace(lower(label), '_', ' '), ' or ')[1] AS s FROM role_rollup WHERE dimension = 'clothing_garment' AND label IS NOT NULL)
SELECT label, CASE WHEN contains(s, 'overalls') OR suffix(s, ' overall') OR s = 'overall' THEN 'overalls' WHEN suffix({_MAPPED}, ' shirt') OR regexp_matches({_MAPPED}, '(work\\s+shirt|short\\s*sleeve(d)?\\s*(work\\s*)?shirt|polo\\s*shirt)$') THEN 'shirt' ELSE {_MAPPED} END AS garment FROM l""")  # fmt: skip
def x42(spark, sf_dir):
    low = rows(spark, sf_dir).where("dimension = 'clothing_garment' AND label IS NOT NULL").select(F.lower("label").alias("label")).distinct()
    return low.withColumn("garment", N.garment(F.col("label")))


@query("x43_generic_tokens", f"""WITH l AS (SELECT DISTINCT dimension, label, list_filter({WORDS.format('lower(label)')}, lambda t: NOT list_contains(string_split(dimension, '_'), t)) AS w FROM role_rollup WHERE label IS NOT NULL AND dimension IS NOT NULL)
SELECT dimension, label, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE 'unknown' END AS tokens FROM l""")  # fmt: skip
def x43(spark, sf_dir):
    d = rows(spark, sf_dir).where("label IS NOT NULL AND dimension IS NOT NULL").select("dimension", "label").distinct()
    return d.select("dimension", "label", F.array_join(N.generic_tokens(F.col("dimension"), F.col("label")), " ").alias("tokens"))


@query("x35_x36_x46_dimension_names", """WITH d AS (SELECT DISTINCT cohort, dimension FROM rollup_raw WHERE dimension IS NOT NULL AND cohort IS NOT NULL),
 k AS (SELECT *, regexp_replace(regexp_replace(lower(trim(dimension)), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM d)
SELECT cohort, dimension, key, regexp_replace(regexp_replace(lower(cohort), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g') || '.' || key AS name FROM k""")  # fmt: skip
def x35(spark, sf_dir):
    d = read_table(spark, sf_dir, "rollup_raw").where("dimension IS NOT NULL AND cohort IS NOT NULL").select("cohort", "dimension").distinct()
    return d.select("cohort", "dimension", N.dimension_key(F.col("dimension")).alias("key"), N.dimension_name(F.col("cohort"), F.col("dimension")).alias("name"))


@query("x50_plain", r"SELECT DISTINCT label, regexp_replace(replace(lower(coalesce(label, '')), '_', ' '), '[^a-z0-9\s]', '', 'g') AS plain FROM role_rollup")
def x50(spark, sf_dir):
    return labels(spark, sf_dir).select("label", N.plain_ascii(F.col("label")).alias("plain"))


_STOP = "'a', 'an', 'and', 'the', 'of', 'for', 'to', 'in', 'on', 'at', 'from', 'with', 'this', 'that', 'is', 'are', 'was', 'were', 'be', 'been', 'as', 'it', 'its', 'their', 'his', 'her', 'your', 'our'"


@query("x48_x49_clean_text", f"""WITH l AS (SELECT DISTINCT label, trim(regexp_replace(lower(strip_accents(coalesce(label, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS clean FROM role_rollup)
SELECT label, clean, replace(clean, ' ', '_') AS snake, array_to_string(list_transform(list_filter(string_split(clean, ' '), lambda w: w <> '' AND w NOT IN ({_STOP})), lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN w[1:-2] ELSE w END), ' ') AS lemmas FROM l""")  # fmt: skip
def x48(spark, sf_dir):
    x = F.col("label")
    return labels(spark, sf_dir).select("label", N.basic_clean(x).alias("clean"), N.snake(x).alias("snake"), N.norm_text(x).alias("lemmas"))


@query("f05_is_token", "SELECT dimension, count(*) AS n, count(*) FILTER (label IS NOT NULL AND lower(trim(label)) NOT IN ('', 'unknown', 'none')) AS tokens FROM role_rollup GROUP BY ALL")
def f05(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count_if(N.is_token(F.col("label"))).alias("tokens"))


@query("f01_f02_f04_f13_known", "SELECT cohort, dimension, count(*) AS n, CAST(sum(count) AS BIGINT) AS total FROM role_rollup WHERE label <> 'unknown' AND cohort NOT IN ('totals', 'safety') AND dimension <> 'role_hint' GROUP BY ALL")
def f01(spark, sf_dir):
    r = rows(spark, sf_dir).where("label != 'unknown' AND cohort NOT IN ('totals', 'safety') AND dimension != 'role_hint'")
    return r.groupBy("cohort", "dimension").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


@query("f03_pipes_of_model", "SELECT model, count(*) AS n FROM role_rollup WHERE NOT (suffix(model, 'XT') AND coalesce(contains(label, '|'), false)) GROUP BY ALL")
def f03(spark, sf_dir):
    return rows(spark, sf_dir).where(~(F.col("model").endswith("XT") & F.coalesce(F.col("label").contains("|"), F.lit(False)))).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("f06_drop_unknown", "SELECT source_file, count(*) AS n FROM role_rollup WHERE coalesce(lower(label) <> 'unknown', true) AND coalesce(lower(dimension) <> 'unknown', true) GROUP BY ALL")
def f06(spark, sf_dir):
    return R.drop_unknown(rows(spark, sf_dir), ["label", "dimension"]).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@query("f08_filter", "SELECT row_id, label, count FROM role_rollup WHERE context = 'CF' AND dimension IN ('mood', 'weather')")
def f08(spark, sf_dir):
    return R.filtered(rows(spark, sf_dir), {"context": "CF", "dimension": ["mood", "weather"]}).select("row_id", "label", "count")


@query("f09_f10_search", "SELECT row_id FROM role_rollup WHERE regexp_matches(lower(label), 'lantern') OR regexp_matches(lower(dimension), 'lantern') OR regexp_matches(lower(occupation), 'lantern')")
def f09(spark, sf_dir):
    return R.search(rows(spark, sf_dir), "lantern", ["label", "dimension", "occupation"]).select("row_id")


@query("f14_final_columns", "SELECT occupation AS \"Occupation\", label AS \"Label\", count AS \"n.count\" FROM role_rollup WHERE label IS NOT NULL")
def f14(spark, sf_dir):
    return rows(spark, sf_dir).where("label IS NOT NULL").select(F.col("occupation").alias("Occupation"), F.col("label").alias("Label"), F.col("count").alias("n.count"))


@query("f16_describe", "SELECT dimension, count(*) AS n, count(label) AS labels, count(count) AS counts, min(count) AS low, max(count) AS high, round(avg(count), 6) AS mean FROM role_rollup GROUP BY ALL")
def f16(spark, sf_dir):
    return rounded(rows(spark, sf_dir).groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labels"), F.count("count").alias("counts"), F.min("count").alias("low"), F.max("count").alias("high"), F.avg("count").alias("mean")), 6)


@query("j01_canonical_labels", f"""WITH m AS (SELECT cohort, dimension, {LABEL_KEY.format('label')} AS k, arg_min({LABEL_KEY.format('canonical_label')}, map_id) AS c FROM canonical_map GROUP BY ALL)
SELECT r.row_id, coalesce(m.c, {LABEL_KEY.format('r.label')}) AS label FROM role_rollup r LEFT JOIN m ON r.cohort IS NOT DISTINCT FROM m.cohort AND r.dimension IS NOT DISTINCT FROM m.dimension AND {LABEL_KEY.format('r.label')} = m.k""")  # fmt: skip
def j01(spark, sf_dir):
    return R.canonical_join(rows(spark, sf_dir), read_table(spark, sf_dir, "canonical_map")).select("row_id", "label")


@query("s15_s19_files", "SELECT source_file, regexp_extract(source_file, '^Context-(free|aware_Related|aware_Unrelated)_(CF|CA-R|CA-U)', 2) AS context_short, regexp_replace(source_file, '^Context-(free|aware_Related|aware_Unrelated)_(CF|CA-R|CA-U)_', '') AS role, count(*) AS n FROM role_rollup GROUP BY ALL")
def s15(spark, sf_dir):
    head = "^Context-(free|aware_Related|aware_Unrelated)_(CF|CA-R|CA-U)"
    r = rows(spark, sf_dir).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    return r.select("source_file", F.regexp_extract("source_file", head, 2).alias("context_short"), F.regexp_replace("source_file", head + "_", "").alias("role"), "n")


@query("s18_role_and_model", """WITH f AS (SELECT DISTINCT source_file || '_' || model || '.csv' AS path FROM role_rollup UNION SELECT DISTINCT 'reviews/' || occupation || m || '.csv' FROM role_rollup, (SELECT unnest(['_SDXL', '_3.5', '_Flux', '_qwen', '']) AS m) WHERE occupation IS NOT NULL),
s AS (SELECT path, regexp_replace(regexp_extract(path, '[^/\\\\]*$'), '\\.csv$', '') AS stem FROM f), t AS (SELECT *, lower(regexp_extract(stem, '_([^_]*)$', 1)) IN ('sdxl', '3.5', 'flux', 'qwen') AS known FROM s)
SELECT path, stem, replace(CASE WHEN known THEN regexp_replace(stem, '_[^_]*$', '') ELSE stem END, '_', ' ') AS role, CASE WHEN known THEN regexp_extract(stem, '_([^_]*)$', 1) ELSE '' END AS model FROM t""")  # fmt: skip
def s18(spark, sf_dir):
    r = rows(spark, sf_dir)
    suffixes = F.explode(F.array(*[F.lit(m) for m in ("_SDXL", "_3.5", "_Flux", "_qwen", "")])).alias("m")
    reviews = r.where("occupation IS NOT NULL").select("occupation", suffixes).select(F.concat(F.lit("reviews/"), "occupation", "m", F.lit(".csv")).alias("path"))
    paths = r.select(F.concat("source_file", F.lit("_"), "model", F.lit(".csv")).alias("path")).unionByName(reviews).distinct()
    return paths.select("path", role_and_model(F.col("path")).alias("p")).select("path", "p.*")


@query("x63_cohort_counts", """SELECT source_file || form AS doc, cohort, dimension, label, CAST(sum(coalesce(count, 0)) AS BIGINT) AS count FROM role_rollup, (SELECT unnest(['', '-legacy']) AS form)
WHERE source_file IS NOT NULL AND label IS NOT NULL AND cohort IS NOT NULL AND dimension IS NOT NULL GROUP BY ALL""")  # fmt: skip
def x63(spark, sf_dir):
    """Count documents of both forms, made from the role files, read back."""
    known = rows(spark, sf_dir).where("source_file IS NOT NULL AND cohort IS NOT NULL AND dimension IS NOT NULL")
    dims = R.nested_counts(known, ["source_file", "cohort", "dimension"])
    prefix = F.create_map(*[F.lit(x) for c, p in R.LEGACY_PREFIX.items() for x in (c, p)])
    by = lambda *k: F.map_from_entries(F.collect_list(F.struct(*k)))
    nested = dims.groupBy("source_file", "cohort").agg(by("dimension", "counts").alias("d")).groupBy("source_file").agg(F.to_json(by("cohort", "d")).alias("doc_text"))
    legacy = dims.groupBy("source_file").agg(F.to_json(by(F.concat_ws("_", prefix[F.col("cohort")], "dimension"), "counts")).alias("doc_text"))
    docs = nested.select(F.col("source_file").alias("doc"), "doc_text").unionByName(legacy.select(F.concat("source_file", F.lit("-legacy")).alias("doc"), "doc_text"))
    return R.cohort_counts(docs, "doc", "doc_text")


@query("k02_count_rows", """SELECT source_file, cohort, dimension, label, count, CAST(count(*) OVER (PARTITION BY source_file, cohort, dimension) AS INTEGER) AS bin FROM (
  SELECT source_file, cohort, dimension, label, CAST(sum(coalesce(count, 0)) AS BIGINT) AS count FROM role_rollup GROUP BY ALL)""")  # fmt: skip
def k02(spark, sf_dir):
    return R.count_rows(rows(spark, sf_dir), ["source_file"])


@query("k03_nested_counts", """SELECT source_file, dimension, string_agg(label || '=' || c, ';' ORDER BY label) AS counts FROM (SELECT source_file, dimension, label, sum(coalesce(count, 0)) AS c FROM role_rollup WHERE label IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
def k03(spark, sf_dir):
    nested = R.nested_counts(rows(spark, sf_dir), ["source_file", "dimension"])
    return nested.select("source_file", "dimension", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ";").alias("counts"))


@query("k04_k05_x54_role_files", """WITH r AS (SELECT occupation AS role, count(DISTINCT prompt_no) AS prompt_count FROM role_rollup WHERE occupation IS NOT NULL GROUP BY ALL)
SELECT role, role AS file_stem, prompt_count FROM r""")  # fmt: skip
def k04(spark, sf_dir):
    r = rows(spark, sf_dir)
    n = r.groupBy(F.col("occupation").alias("role")).agg(F.countDistinct("prompt_no").alias("prompt_count"))
    return R.role_files(r).join(n, "role")


@query("k06_k07_ranked_labels", """SELECT context, dimension, label, count, CAST(row_number() OVER (PARTITION BY context, dimension ORDER BY count DESC, label) AS INTEGER) AS pos FROM (
  SELECT context, dimension, label, CAST(sum(coalesce(count, 0)) AS BIGINT) AS count FROM role_rollup WHERE label IS NOT NULL GROUP BY ALL)""")  # fmt: skip
def k06(spark, sf_dir):
    return R.ranked_labels(rows(spark, sf_dir), ["context", "dimension"])


@query("a23_role_totals", "SELECT occupation, cohort, dimension, label, CAST(sum(coalesce(count, 0)) AS BIGINT) AS count, count(DISTINCT context) AS contexts, count(DISTINCT prompt_no) AS prompts FROM role_rollup GROUP BY ALL")
def a23(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("occupation", "cohort", "dimension", "label").agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"), F.countDistinct("context").alias("contexts"), F.countDistinct("prompt_no").alias("prompts"))


@query("a24_all_roles", "SELECT cohort, dimension, label, CAST(sum(coalesce(count, 0)) AS BIGINT) AS count, array_to_string(list_sort(list(DISTINCT occupation)), ',') AS roles, array_to_string(list_sort(list(DISTINCT context)), ',') AS contexts FROM role_rollup GROUP BY ALL")
def a24(spark, sf_dir):
    return R.all_roles(rows(spark, sf_dir))


_LOW = WS.format("lower(coalesce(label, ''))")
_TOTALS = f"""WITH raw AS (SELECT occupation, coalesce(cohort, 'unknown') AS c, coalesce(dimension, 'unknown') AS dimension, {_LOW} AS low, coalesce(count, 0) AS n FROM role_rollup),
s AS (SELECT *, {SLUG.format('c')} AS cohort, CASE WHEN low = '' OR {_has('low', _UNKNOWN)} THEN 'unknown' ELSE low END AS s FROM raw),
w AS (SELECT *, list_transform(list_filter({WORDS.format('s')}, lambda t: NOT list_contains(string_split(dimension, '_'), t)), lambda t: CASE t WHEN 'tshirt' THEN 't-shirt' ELSE t END) AS w, replace(s, '_', ' ') AS g FROM s),
normal AS (SELECT occupation, cohort, dimension, n, CASE
  WHEN cohort = 'people' AND dimension = 'clothing_garment' THEN CASE WHEN contains(split_part(g, ' or ', 1), 'overalls') THEN 'overalls' WHEN suffix(split_part(g, ' or ', 1), ' shirt') THEN 'shirt' ELSE split_part(g, ' or ', 1) END
  WHEN suffix(dimension, 'activities') THEN regexp_replace(regexp_replace(regexp_replace(s, '(?i)\\bactivit(y|ies)\\b', '', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')
  WHEN suffix(dimension, 'present') THEN CASE WHEN {_has('s', _UNKNOWN)} THEN 'unknown' WHEN list_has_any({WORDS.format('s')}, [{_PRESENT}]) THEN 'yes' WHEN list_has_any({WORDS.format('s')}, [{_ABSENT}]) THEN 'no' WHEN {_has('s', ('without', 'absent'))} THEN 'no' WHEN {_has('s', ('with', 'present'))} THEN 'yes' ELSE 'unknown' END
  WHEN dimension = 'gender_presentation' THEN CASE WHEN contains(s, 'female') THEN 'female' WHEN contains(s, 'male') THEN 'male' ELSE 'unknown' END
  WHEN contains(dimension, 'color_temperature') THEN CASE WHEN contains(s, 'cool') THEN 'cool' WHEN contains(s, 'warm') THEN 'warm' WHEN contains(s, 'neutral') THEN 'neutral' WHEN contains(s, 'unknown') THEN 'unknown' ELSE s END
  ELSE CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE 'unknown' END END AS label FROM w),
totals AS (SELECT occupation, cohort, dimension, label, CAST(sum(n) AS BIGINT) AS count FROM normal GROUP BY ALL)
"""


@query("a25_a46_x45_role_rollup", _TOTALS + "SELECT * FROM totals")
def a25(spark, sf_dir):
    return R.role_totals(rows(spark, sf_dir))


_GENERAL = """
atmosphere mood Mood 1; atmosphere mood_distribution Mood 1; atmosphere color_temperature LightingColorTemperature 2; atmosphere lighting_color_temperature LightingColorTemperature 2;
atmosphere lighting_profile_color_temperature LightingColorTemperature 2; lighting color_temperature LightingColorTemperature 2; lighting lighting_profile_color_temperature LightingColorTemperature 2;
atmosphere contrast_level AtmosphereContrastLevel 3; atmosphere lighting_profile_contrast_level AtmosphereContrastLevel 3; lighting contrast_level AtmosphereContrastLevel 3; lighting lighting_profile_contrast_level AtmosphereContrastLevel 3;
atmosphere saturation_level SaturationLevel 4; atmosphere lighting_profile_saturation_level SaturationLevel 4; lighting saturation_level SaturationLevel 4; lighting lighting_profile_saturation_level SaturationLevel 4;
atmosphere dominant_palette DominantPalette 5; atmosphere dominant_palette_mapped DominantPalette 5; atmosphere palette DominantPalette 5; atmosphere palette_color DominantPalette 5; atmosphere palette_colors DominantPalette 5; atmosphere palette_detail DominantPalette 5;
atmosphere aesthetic_qualities AestheticQualities 6; atmosphere aesthetic_quality AestheticQualities 6; atmosphere lighting_profile_aesthetic_qualities AestheticQualities 6; environment indoor_outdoor IndoorOutdoor 7; environment weather Weather 8; environment time_of_day_hint TimeOfDayHint 9;
camera perspective Perspective 10; camera framing Framing 11; camera focal_length FocalLength 12; camera depth_of_field DepthOfField 13; camera angle CameraAngle 14; lighting directionality Directionality 15; lighting hardness Hardness 16; lighting shadows Shadows 17; lighting sources_count SourcesCount 18; lighting sources_type SourcesType 19;
people gender_presentation GenderPresentation 20; people skin_tone SkinTone 21; people age_range AgeRange 22; people gaze_direction GazeDirection 23; people orientation OrientationType 24; people pose_activity_orientation OrientationType 24; people face_emotion FaceEmotion 25; people hair_style Hairstyle 26; people hair_color HairColor 27;
people occlusions OcclusionState 28; people pose_activity_occlusions OcclusionState 28; people eyewear_present eyewear_present 29; people head_covering_present head_covering_present 30; people facial_hair_present facial_hair_present 31; people facial_hair_presence facial_hair_present 31; people hair_present hair_present 38; people safety_gear_present safety_gear_present 32;
texts visible_text_present visible_text_present 33; objects vehicle_present vehicle_present 34; objects animal_present animal_present 35; objects tool_present tool_present 36; people multiple_people_present multiple_people_present 37;
* gender_presentation GenderPresentation 20; * hair_present hair_present 38; * eyewear_present eyewear_present 29; * head_covering_present head_covering_present 30; * facial_hair_present facial_hair_present 31
"""
_GENERAL_ROWS = ", ".join("('{}', '{}', '{}', {})".format(*x.split()) for x in _GENERAL.split(";"))


@query("a26_j14_general_attributes", _TOTALS + f""", g(c, d, a, o) AS (VALUES {_GENERAL_ROWS}),
named AS (SELECT coalesce(e.c, 'people') AS cohort, coalesce(e.a, w.a) AS dimension, label, count, coalesce(e.o, w.o) AS ordinal FROM totals t LEFT JOIN g e ON t.cohort = e.c AND t.dimension = e.d LEFT JOIN g w ON w.c = '*' AND t.dimension = w.d)
SELECT cohort, dimension, label, CAST(sum(count) AS BIGINT) AS count, CAST(ordinal AS INTEGER) AS ordinal FROM named WHERE dimension IS NOT NULL GROUP BY ALL""")  # fmt: skip
def a26(spark, sf_dir):
    return R.general_attributes(R.role_totals(rows(spark, sf_dir)))


@query("a29_by_context_role", "SELECT context, occupation, dimension, count(DISTINCT prompt_no) AS prompts, CAST(sum(count) AS BIGINT) AS total FROM role_rollup GROUP BY ALL")
def a29(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("context", "occupation", "dimension").agg(F.countDistinct("prompt_no").alias("prompts"), F.sum("count").alias("total"))


@query("a37_a38_bins", """WITH b AS (SELECT source_file, dimension, count(DISTINCT label) AS bins FROM role_rollup GROUP BY ALL)
SELECT r.row_id, b.bins FROM role_rollup r JOIN b ON r.source_file IS NOT DISTINCT FROM b.source_file AND r.dimension IS NOT DISTINCT FROM b.dimension""")  # fmt: skip
def a38(spark, sf_dir):
    return R.with_bins(rows(spark, sf_dir), ["source_file", "dimension"]).select("row_id", "bins")


@query("a39_summary", "SELECT context, CAST(sum(count) AS BIGINT) AS total, round_even(avg(count), 2) AS mean, max(count) AS max, min(count) AS min, round_even(stddev_samp(count), 2) AS std, count(DISTINCT dimension) AS dimensions, count(DISTINCT label) AS labels FROM role_rollup GROUP BY ALL")
def a39(spark, sf_dir):
    return R.summary(rows(spark, sf_dir), ["context"])


@query("a40_o03_value_counts", "SELECT label, count(*) AS n FROM role_rollup WHERE label IS NOT NULL GROUP BY ALL ORDER BY n DESC, label LIMIT 20")
def a40(spark, sf_dir):
    return R.top_values(rows(spark, sf_dir), "label").orderBy(F.desc("n"), "label").limit(20)


@query("a41_coverage", "SELECT context, count(DISTINCT (dimension, label)) AS filled, count(DISTINCT dimension) * count(DISTINCT label) AS possible, round(count(DISTINCT (dimension, label)) / (count(DISTINCT dimension) * count(DISTINCT label))::DOUBLE, 9) AS coverage FROM role_rollup WHERE dimension IS NOT NULL AND label IS NOT NULL GROUP BY ALL")
def a41(spark, sf_dir):
    return rounded(R.coverage(rows(spark, sf_dir), ["context"]))


_CONTEXTS = {"CF": "cf", "CA-U": "ca_u", "CA-R": "ca_r"}


@query("a42_roles_by_context", """SELECT occupation, count(*) FILTER (context = 'CF') AS cf, count(*) FILTER (context = 'CA-U') AS ca_u, count(*) FILTER (context = 'CA-R') AS ca_r, count(*) FILTER (context IN ('CF', 'CA-U', 'CA-R')) AS total,
  bool_or(context = 'CF') AND bool_or(context = 'CA-U') AND bool_or(context = 'CA-R') AS in_all FROM role_rollup GROUP BY ALL""")  # fmt: skip
def a42(spark, sf_dir):
    g = R.crosstab(rows(spark, sf_dir), "occupation", "context", _CONTEXTS)
    return g.withColumn("in_all", (F.col("cf") > 0) & (F.col("ca_u") > 0) & (F.col("ca_r") > 0))


@query("u04_labels_of_all_contexts", "SELECT dimension, label FROM role_rollup WHERE context = 'CF' INTERSECT SELECT dimension, label FROM role_rollup WHERE context = 'CA-U' INTERSECT SELECT dimension, label FROM role_rollup WHERE context = 'CA-R'")
def u04(spark, sf_dir):
    return R.in_all(rows(spark, sf_dir), ["dimension", "label"], "context", ["CF", "CA-U", "CA-R"])


@query("a45_bank_counts", """SELECT occupation, count(DISTINCT prompt_no) FILTER (context = 'CF') AS cf, count(DISTINCT prompt_no) FILTER (context = 'CA-R') AS ca_r, count(DISTINCT prompt_no) FILTER (context = 'CA-U') AS ca_u,
  count(DISTINCT prompt_no) FILTER (context = 'CF') + count(DISTINCT prompt_no) FILTER (context = 'CA-R') + count(DISTINCT prompt_no) FILTER (context = 'CA-U') AS total FROM role_rollup GROUP BY ALL""")  # fmt: skip
def a45(spark, sf_dir):
    prompts = rows(spark, sf_dir).select("occupation", "context", "prompt_no").where("prompt_no IS NOT NULL").distinct()
    every = rows(spark, sf_dir).select("occupation").distinct()
    counts = R.crosstab(prompts, "occupation", "context", {"CF": "cf", "CA-R": "ca_r", "CA-U": "ca_u"})
    return every.alias("e").join(counts.alias("c"), F.col("e.occupation").eqNullSafe(F.col("c.occupation")), "left").select("e.occupation", "cf", "ca_r", "ca_u", "total").fillna(0, ["cf", "ca_r", "ca_u", "total"])


@query("a43_w05_top_label", """SELECT context, dimension, label, c AS count FROM (SELECT context, dimension, label, CAST(sum(coalesce(count, 0)) AS BIGINT) AS c FROM role_rollup WHERE label IS NOT NULL GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY context, dimension ORDER BY c DESC, label) = 1""")  # fmt: skip
def a43(spark, sf_dir):
    return R.top_label(rows(spark, sf_dir), ["context", "dimension"])


@query("a44_w04_shares", """WITH t AS (SELECT context, dimension, label, CAST(sum(count) AS BIGINT) AS count FROM role_rollup WHERE label IS NOT NULL GROUP BY ALL)
SELECT context, dimension, label, count, round(count::DOUBLE / nullif(sum(count) OVER (PARTITION BY context, dimension), 0), 9) AS share FROM t""")  # fmt: skip
def a44(spark, sf_dir):
    t = rows(spark, sf_dir).where("label IS NOT NULL").groupBy("context", "dimension", "label").agg(F.sum("count").alias("count"))
    return rounded(R.shares(t, ["context", "dimension"]))


@query("u02_u03_role_gaps", """SELECT DISTINCT occupation FROM role_rollup WHERE context = 'CF' AND occupation NOT IN (SELECT occupation FROM role_rollup WHERE context = 'CA-R' AND occupation IS NOT NULL)
UNION SELECT DISTINCT occupation FROM role_rollup WHERE context = 'CA-U' AND prompt_no = 1""")  # fmt: skip
def u02(spark, sf_dir):
    r = rows(spark, sf_dir)
    only = r.where("context = 'CF'").select("occupation").join(r.where("context = 'CA-R'").select("occupation").distinct(), "occupation", "left_anti")
    return only.union(r.where("context = 'CA-U' AND prompt_no = 1").select("occupation")).distinct()


@query("c12_collapse", """WITH t AS (SELECT dimension, label, CAST(sum(count) AS BIGINT) AS count FROM role_rollup WHERE label IS NOT NULL AND count IS NOT NULL GROUP BY ALL),
s AS (SELECT *, count::DOUBLE / sum(count) OVER (PARTITION BY dimension) AS share FROM t)
SELECT dimension, label, count, round(share, 9) AS share, '' AS members FROM s WHERE share >= 0.05
UNION ALL SELECT dimension, 'Other (' || CAST(sum(count) AS BIGINT) || ')', CAST(sum(count) AS BIGINT), round(sum(share), 9), string_agg(label, ',' ORDER BY label) FROM s WHERE share < 0.05 GROUP BY dimension""")  # fmt: skip
def c12(spark, sf_dir):
    t = rows(spark, sf_dir).where("label IS NOT NULL AND count IS NOT NULL").groupBy("dimension", "label").agg(F.sum("count").alias("count"))
    return rounded(R.collapse_small(R.shares(t, ["dimension"]), ["dimension"]))


@query("x08_wilson", """WITH t AS (SELECT dimension, label, count(*) AS k FROM role_rollup WHERE label IS NOT NULL GROUP BY ALL), n AS (SELECT *, CAST(sum(k) OVER (PARTITION BY dimension) AS DOUBLE) AS n FROM t)
SELECT dimension, label, k, round(greatest(0, ((k / n + 3.8416 / (2 * n)) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 9) AS low, round(least(1, ((k / n + 3.8416 / (2 * n)) + 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 9) AS high FROM n""")  # fmt: skip
def x08(spark, sf_dir):
    from pyspark.sql import Window

    t = rows(spark, sf_dir).where("label IS NOT NULL").groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("k"))
    n = F.sum("k").over(Window.partitionBy("dimension"))
    return rounded(R.with_interval(t, "k", n))


@query("x01_safe_ratio", """WITH t AS (SELECT label, count(*) AS n, count(DISTINCT dimension) AS d FROM role_rollup WHERE label IS NOT NULL GROUP BY ALL)
SELECT label, round(CASE WHEN d > 1 THEN n / (d - 1)::DOUBLE END, 9) AS ratio FROM t""")  # fmt: skip
def x01(spark, sf_dir):
    t = rows(spark, sf_dir).where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dimension").alias("d"))
    return rounded(t.select("label", safe_div(F.col("n"), F.col("d") - 1).alias("ratio")))
