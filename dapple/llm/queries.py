"""Queries of the operators for training data, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.collapse import FormattingCopies
from dapple.llm.language import document_languages, fit_language_model, label_errors
from dapple.llm.mixing import Mixture
from dapple.llm.packing import container_fill, pack_items, tightness
from dapple.llm.terms import marked_terms
from dapple.llm.tokens import token_count
from dapple.llm.topn import top_n_per_group
from dapple.llm.vocabulary import map_entries
from dapple.runtime import read_table

CAPACITY = 512


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "role_rollup").where("dimension IS NOT NULL AND label IS NOT NULL AND count IS NOT NULL")
    content = [c for c in rows.columns if c not in ("row_id", "loaded_at")]
    order = [F.col("count").desc(), F.col("label").asc(), F.col("row_id").asc()]
    top = top_n_per_group(rows, ["sweep_id", "source_file", "dimension"], order, ["count", "label", "row_id"], 5, content)
    return top.select("sweep_id", "source_file", "dimension", "row_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(read_table(spark, sf_dir, "role_rollup"), "label", "count").where("mark != 'useful'").select("term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(read_table(spark, sf_dir, "role_rollup"), "label", "count").select("term", "rows", "occurrences", "mark")


def _copies(spark: SparkSession, sf_dir: str) -> FormattingCopies:
    return FormattingCopies(read_table(spark, sf_dir, "rollup_raw"), "raw_id", ["sweep_id", "source_file", "cohort", "count"], ["dimension", "label"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).links()


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).records()


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_entries(read_table(spark, sf_dir, "label_entries"), read_table(spark, sf_dir, "canonical_map"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).where("trim(label) != '' AND NOT listed").select("entry_id", "canonical_id")


def p5_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(read_table(spark, sf_dir, "documents"), "doc_id", token_count(F.col("text")), CAPACITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).where("pieces > 1").select("doc_id", "piece_no")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_fill(_packed(spark, sf_dir), CAPACITY)


def p8_tightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tightness(_packed(spark, sf_dir), CAPACITY)


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return Mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), "doc_id", "source", token_count(F.col("text")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report().where("repeats").select("source", "passes", "reach")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report().select("source", "target_share", "passes", "tokens", "share", "reach")


def p9_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source has to supply, and whether the mix supplies it and at most one record more."""
    mix = _mixture(spark, sf_dir)
    got = mix.placed().groupBy("source").agg(F.sum("tokens").alias("got"), F.max("tokens").alias("most"), F.max("pass_no").alias("passes"))
    rows = mix.plan_df.select("source", "quota").join(got, "source", "left").fillna(0, ["got", "most", "passes"])
    return rows.select("source", "quota", "passes", ((F.col("got") >= F.col("quota")) & (F.col("got") <= F.col("quota") + F.col("most"))).alias("covered"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).placed()


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return document_languages(docs, fit_language_model(docs, "doc_id", "text", "lang"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _languages(spark, sf_dir)
    return label_errors(read_table(spark, sf_dir, "documents"), found, "doc_id", "lang").select("doc_id", "seg_no", "lang")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_terms, p3_found, p3_records, p5_found, p5_mapped, p8_found, p8_fill, p8_tightness, p9_found, p9_shares, p9_quotas, p9_mix, p10_found, p10_segments)}

_TERMS = """
WITH hit AS (SELECT row_id, coalesce(count, 0) AS c, unnest(regexp_extract_all(lower(label), '[\\p{L}\\p{N}]+')) AS term FROM role_rollup),
     term AS (SELECT term, count(DISTINCT row_id) AS rows, CAST(sum(c) AS BIGINT) AS occurrences FROM hit GROUP BY term),
     marked AS (SELECT *, CASE WHEN rows >= 0.02 * (SELECT count(label) FROM role_rollup) THEN 'common'
                               WHEN rows <= 2 OR occurrences < 10 THEN 'rare' ELSE 'useful' END AS mark FROM term)
"""
_KEYED = r"""
WITH part AS (SELECT raw_id, sweep_id, source_file, cohort, count, unnest([dimension, label]) AS v, dimension, label FROM rollup_raw
              WHERE dimension IS NOT NULL AND label IS NOT NULL),
     canon AS (SELECT *, CASE WHEN v LIKE '%:%' OR v LIKE '%=%'
        THEN array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower(v), '[;|,/\r\n]'), lambda x: regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '')), chr(31))
        ELSE regexp_replace(lower(v), '[^\p{L}\p{N}]+', '', 'g') END AS k FROM part),
     keyed AS (SELECT raw_id, any_value(dimension) AS dimension, any_value(label) AS label, any_value(sweep_id) AS sweep_id, any_value(source_file) AS source_file, any_value(cohort) AS cohort, any_value(count) AS count,
                      array_to_string(list_sort(list(k)), chr(30)) AS key FROM canon GROUP BY raw_id),
     kept AS (SELECT *, min(raw_id) OVER w AS kept_id, count(*) OVER w AS copies FROM keyed WINDOW w AS (PARTITION BY sweep_id, source_file, cohort, count, key))
"""
_TOKENS = r"""
WITH doc AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')), 0) AS BIGINT) AS tokens FROM documents)
"""
# p5 by brute force: every string of a value is compared with every reference string, without segments.
_NOTHING = ("", "other", "misc", "tbd", "na", "none", "null", "nan", "unknown", "unsure", "notsure", "canttell", "cantell", "unclear", "various", "todo", "notvisible", "nothing", "test", "dontknow", "noidea", "seenotes", "same", "sameasabove")


def _sql_words(x: str) -> str:
    return f"""replace(replace(trim(regexp_replace(regexp_replace({x}, '[''’`]', '', 'g'), '[^\\pL\\pN@$]+', ' ', 'g')), 'grey', 'gray'), 'colour', 'color')"""


def _sql_compact(x: str) -> str:
    return f"translate(replace({x}, ' ', ''), '013457@$', 'oieastas')"


def _sql_stripped(x: str) -> str:
    x = f"replace({x}, '_', ' ')"
    for pattern in (r"\([^)]*\)?\s*$", r"[\s,;-]+(probably|maybe|perhaps|possibly|i think|likely|left side|right side|partly hidden|partially hidden|in part)\W*$", r"[\s,-]+x\s*\d+\W*$", r"^\W*\d+\s*x[\s-]+", r"^\W*(a|an|the|some|one|any)[\s-]+"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return x


def _sql_matches(p: str, wanted: str, refs: str, loose: bool) -> str:
    """CTEs that end in ``{p}match`` (value, scope, id)."""
    k, low = "least(4, greatest(1, length(ref) // 3), length(ref) - 1)", "lower(value)"
    first = "QUALIFY row_number() OVER (PARTITION BY w.value, w.scope ORDER BY cost, id) = 1"
    letters = lambda x: f"list_sort(string_split({x}, ''))"
    word = f"UNION ALL SELECT value, id, scope, 60 + rank FROM {p}open JOIN {p}ref ON NOT contains({p}open.words, ' ') AND list_contains(string_split({p}ref.words, ' '), {p}open.words)" if loose else ""
    return f"""{p}ref AS (SELECT DISTINCT id, scope, words, {_sql_compact("words")} AS ref FROM {refs} WHERE words <> ''),
{p}wanted AS (SELECT DISTINCT value, scope FROM {wanted} WHERE value IS NOT NULL),
{p}form AS (SELECT value, words, min(rank) AS rank FROM (SELECT DISTINCT value, {_sql_words(low)} AS words, 0 AS rank FROM {p}wanted UNION ALL SELECT DISTINCT value, {_sql_words(_sql_stripped(low))}, 1 FROM {p}wanted) WHERE words <> '' GROUP BY ALL),
{p}rotated AS (SELECT value, min(rank) AS rank, form FROM (SELECT value, rank + CASE WHEN shift = 0 THEN 0 ELSE 2 END AS rank, {_sql_compact("array_to_string(CASE WHEN shift < 0 THEN list_reverse(w) ELSE w[shift + 1:] || w[1:shift] END, '')")} AS form
  FROM (SELECT *, unnest(CASE WHEN len(w) >= 2 THEN range(-1, len(w)) ELSE [0] END) AS shift FROM (SELECT *, string_split(words, ' ') AS w FROM {p}form))) WHERE form <> '' GROUP BY value, form),
{p}equal AS (SELECT value, id, scope, rank FROM {p}rotated JOIN {p}ref ON form = ref),
{p}done AS (SELECT w.value, w.scope, id, rank AS cost FROM {p}equal e JOIN {p}wanted w ON w.value = e.value AND (w.scope IS NULL OR w.scope = e.scope) {first}),
{p}rest AS (SELECT * FROM {p}wanted w WHERE NOT EXISTS (SELECT 1 FROM {p}done d WHERE d.value = w.value AND d.scope IS NOT DISTINCT FROM w.scope) AND value NOT IN (SELECT value FROM {p}equal WHERE rank < 2) AND value NOT IN (SELECT value FROM {p}rotated WHERE form IN {_NOTHING})),
{p}open AS (SELECT * FROM {p}form WHERE value IN (SELECT value FROM {p}rest)),
{p}close AS (SELECT value, id, scope, 10 * levenshtein(form, ref) + rank AS cost FROM {p}rotated JOIN {p}ref ON abs(length(form) - length(ref)) <= 4 WHERE value IN (SELECT value FROM {p}rest) AND levenshtein(form, ref) <= {k} + CASE WHEN {letters("form")} = {letters("ref")} THEN 1 ELSE 0 END
  UNION ALL SELECT value, id, scope, CASE WHEN rtrim(value, ' ') LIKE '%.' THEN 5 ELSE 35 END + rank FROM {p}open JOIN {p}ref ON starts_with(ref, {_sql_compact(f"{p}open.words")}) AND length({_sql_compact(f"{p}open.words")}) BETWEEN 3 AND length(ref) - 1
  UNION ALL SELECT value, id, scope, 50 + 10.0 / length(replace({p}ref.words, ' ', '')) + rank FROM {p}open JOIN {p}ref ON contains(' ' || {p}open.words || ' ', ' ' || {p}ref.words || ' ') AND {p}open.words <> {p}ref.words
  {word}),
{p}match AS (SELECT value, scope, id FROM {p}done UNION ALL SELECT value, scope, id FROM (SELECT w.value, w.scope, e.id, e.cost FROM {p}close e JOIN {p}rest w ON w.value = e.value AND (w.scope IS NULL OR w.scope = e.scope) {first}))"""


_MAPPED = f"""
WITH known AS (SELECT DISTINCT canonical_id, dimension, label, canonical_label FROM canonical_map WHERE canonical_id IS NOT NULL AND label IS NOT NULL AND dimension IS NOT NULL),
pairs AS (SELECT DISTINCT dimension, label FROM label_entries WHERE trim(label) <> ''),
dims AS (SELECT dimension AS id, NULL::VARCHAR AS scope, {_sql_words("lower(dimension)")} AS words FROM known GROUP BY dimension),
typed_dims AS (SELECT dimension AS value, NULL::VARCHAR AS scope FROM pairs), {_sql_matches("d_", "typed_dims", "dims", True)},
scoped AS (SELECT p.dimension, p.label, d.id AS scope FROM pairs p LEFT JOIN d_match d ON p.dimension = d.value WHERE p.dimension IS NULL OR d.id IS NOT NULL),
labels AS (SELECT canonical_id AS id, dimension AS scope, {_sql_words("lower(label)")} AS words FROM known),
typed_labels AS (SELECT label AS value, scope FROM scoped), {_sql_matches("l_", "typed_labels", "labels", False)},
meant AS (SELECT s.dimension, s.label, m.id FROM scoped s JOIN l_match m ON s.label = m.value AND s.scope IS NOT DISTINCT FROM m.scope),
listed AS (SELECT dimension, label, min(canonical_id) AS id FROM known GROUP BY ALL), named AS (SELECT canonical_id, min(canonical_label) AS canonical_label FROM known GROUP BY ALL),
mapped AS (SELECT e.entry_id, e.dimension, e.label, coalesce(l.id, m.id, 0) AS canonical_id, l.id IS NOT NULL AS listed FROM label_entries e LEFT JOIN meant m ON e.label = m.label AND e.dimension IS NOT DISTINCT FROM m.dimension LEFT JOIN listed l ON e.label = l.label AND e.dimension = l.dimension)
"""
SQL = {
    "p5_found": _MAPPED + "SELECT entry_id, canonical_id FROM mapped WHERE trim(label) <> '' AND NOT listed",
    "p5_mapped": _MAPPED + "SELECT entry_id, dimension, label, canonical_id, canonical_label, listed FROM mapped LEFT JOIN named USING (canonical_id)",
    "p1_found": """
WITH once AS (SELECT sweep_id, source_file, dimension, count, label, min(row_id) AS row_id FROM role_rollup
              WHERE dimension IS NOT NULL AND label IS NOT NULL AND count IS NOT NULL
              GROUP BY sweep_id, source_file, model, context, occupation, prompt_no, cohort, dimension, label, count)
SELECT sweep_id, source_file, dimension, row_id FROM once
QUALIFY row_number() OVER (PARTITION BY sweep_id, source_file, dimension ORDER BY count DESC, label, row_id) <= 5
""",
    "p2_found": _TERMS + "SELECT term, mark FROM marked WHERE mark <> 'useful'",
    "p2_terms": _TERMS + "SELECT term, rows, occurrences, mark FROM marked",
    "p3_found": _KEYED + "SELECT kept_id, raw_id AS copy_id FROM kept WHERE raw_id <> kept_id",
    "p3_records": _KEYED + """SELECT kept_id, dimension, label, copies FROM kept WHERE raw_id = kept_id
UNION ALL SELECT raw_id, dimension, label, 1 FROM rollup_raw WHERE dimension IS NULL OR label IS NULL""",
    "p8_found": _TOKENS + "SELECT doc_id, CAST(unnest(range(1, CAST(ceil(tokens / 512) AS BIGINT) + 1)) AS INTEGER) AS piece_no FROM doc WHERE tokens > 512",
    "p8_tightness": _TOKENS + "SELECT CAST(sum(tokens) AS BIGINT) AS tokens, CAST((sum(tokens) + 511) // 512 AS BIGINT) AS least, true AS whole, true AS tight FROM doc",
    "p9_quotas": _TOKENS + """, own AS (SELECT m.source, CAST(target_share AS DECIMAL(18, 12)) AS share, max_passes, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS own FROM mix_targets m LEFT JOIN doc d ON m.source = d.source GROUP BY ALL),
     quota AS (SELECT source, own, CAST(ceil(least(share * (SELECT sum(own) FROM own), CAST(max_passes * own AS DECIMAL(38, 12)))) AS BIGINT) AS quota FROM own)
SELECT source, quota, CAST(CASE WHEN own > 0 THEN (quota + own - 1) // own ELSE 0 END AS INTEGER) AS passes, true AS covered FROM quota""",
    "p9_found": _TOKENS + """, own AS (SELECT m.source, target_share, max_passes, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS own FROM mix_targets m LEFT JOIN doc d ON m.source = d.source GROUP BY ALL),
     need AS (SELECT *, CASE WHEN own > 0 THEN target_share * (SELECT sum(own) FROM own) / own END AS need FROM own)
SELECT source, CASE WHEN own = 0 THEN 0 ELSE least(CAST(ceil(need) AS INTEGER), max_passes) END AS passes, CASE WHEN need <= max_passes THEN 'met' ELSE 'short' END AS reach
FROM need WHERE need IS NULL OR need > 1""",
}
