"""Similar strings, vocabularies, prompts and the stream of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from dapple.functions import normalize as N
from dapple.operators import prompts as P
from dapple.operators import similar as S
from dapple.plans.common import rounded
from dapple.plans.records import _TOKENS
from dapple.runtime import fresh_folder, read_table, written
from dapple.streaming.incremental import dead_letters, follow, resend, running_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _names(spark, sf_dir):
    """Distinct plain dimension names as they were read."""
    return read_table(spark, sf_dir, "rollup_raw").where("dimension IS NOT NULL").select(F.trim(N.plain_ascii(F.col("dimension"))).alias("plain")).where("plain != ''").distinct().withColumn("column", F.lit("dimension"))


_VECTORS = r"""WITH v AS (SELECT DISTINCT trim(regexp_replace(replace(lower(dimension), '_', ' '), '[^a-z0-9\s]', '', 'g')) AS plain FROM rollup_raw WHERE dimension IS NOT NULL), w AS (SELECT * FROM v WHERE plain <> ''),
g AS (SELECT plain, unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, greatest(length(plain) - n + 2, 1)), lambda i: substring(plain, i, n))))) AS gram FROM w),
tf AS (SELECT plain, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT plain, gram, tf * (ln((1 + (SELECT count(*) FROM w)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (gram)), vec AS (SELECT plain, gram, w / sqrt(sum(w * w) OVER (PARTITION BY plain)) AS w FROM raw)
"""


@query("x15_tfidf", _VECTORS + "SELECT plain, count(*) AS grams, round(max(w), 9) AS top, round(sum(w), 9) AS total FROM vec GROUP BY ALL")
def x15(spark, sf_dir):
    v = S.tfidf(_names(spark, sf_dir), ["column"], "plain")
    return rounded(v.groupBy("plain").agg(F.count(F.lit(1)).alias("grams"), F.max("w").alias("top"), F.sum("w").alias("total")))


@query("x15_j16_similar_pairs", _VECTORS + "SELECT a.plain AS a, b.plain AS b, round(sum(a.w * b.w), 7) AS cosine FROM vec a JOIN vec b ON a.gram = b.gram AND a.plain < b.plain GROUP BY ALL HAVING sum(a.w * b.w) >= 0.6")
def j16(spark, sf_dir):
    return rounded(S.text_pairs(_names(spark, sf_dir), ["column"], "plain", 0.6).select("a", "b", "cosine"), 7)


@query("x14_x16_combined_pairs")
def x16(spark, sf_dir):
    return S.combined_pairs(_names(spark, sf_dir), ["column"], "plain").drop("column")


@query("c09_c10_a37_standard_dimensions")
def c09(spark, sf_dir):
    """Dimensions and labels of each file are standardised, then counts are summed anew."""
    raw = read_table(spark, sf_dir, "rollup_raw").where("dimension IS NOT NULL AND label IS NOT NULL")
    for column in ("dimension", "label"):
        names = S.standardise(raw, ["source_file"], column).withColumnRenamed("standard", f"standardized_{column}")
        raw = written(raw.join(names, ["source_file", column]), "standard")
    return raw.groupBy("source_file", "cohort", "standardized_dimension", "standardized_label").agg(F.sum("count").alias("count"), F.countDistinct("dimension", "label").alias("spellings"))


@query("c01_c02_c03_z07_semantic_clean")
def c01(spark, sf_dir):
    return S.semantic_clean(read_table(spark, sf_dir, "role_rollup"), ["context", "cohort", "dimension"])


@query("c11_w07_unlike_items")
def c11(spark, sf_dir):
    items = read_table(spark, sf_dir, "role_rollup").where("dimension = 'activities' AND label IS NOT NULL").groupBy("occupation", "context", "label").agg(F.min("row_id").alias("row_id"))
    return S.keep_unlike(items, ["occupation", "context"], "label", "row_id")


@query("x10_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6) AS dot FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 1")
def x10(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("embedding").alias("other"))
    return rounded(e.join(nxt, ["vec_id", "label"]).select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), S.cosine("embedding", "other").alias("dot")), 6)


def _bank(spark, sf_dir):
    """A context bank: the activities and items of each role's related and unrelated contexts, paired in the order of their names."""
    r = read_table(spark, sf_dir, "role_rollup").where("context IN ('CA-R', 'CA-U') AND label IS NOT NULL AND dimension IN ('activities', 'items')")
    kind = r.select(F.replace("occupation", F.lit("_"), F.lit(" ")).alias("role"), F.when(F.col("context") == "CA-R", "related").otherwise("unrelated").alias("bucket"), "dimension", "label").distinct()
    from pyspark.sql import Window

    ranked = kind.withColumn("pos", F.row_number().over(Window.partitionBy("role", "bucket", "dimension").orderBy("label")))
    return ranked.groupBy("role", "bucket", "pos").agg(F.max(F.when(F.col("dimension") == "activities", F.col("label"))).alias("action"), F.max(F.when(F.col("dimension") == "items", F.col("label"))).alias("location"))


_BANK = """WITH k AS (SELECT DISTINCT replace(occupation, '_', ' ') AS role, CASE context WHEN 'CA-R' THEN 'related' ELSE 'unrelated' END AS bucket, dimension, label FROM role_rollup WHERE context IN ('CA-R', 'CA-U') AND label IS NOT NULL AND dimension IN ('activities', 'items')),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY role, bucket, dimension ORDER BY label) AS INTEGER) AS pos FROM k),
bank AS (SELECT role, bucket, pos, max(CASE WHEN dimension = 'activities' THEN label END) AS action, max(CASE WHEN dimension = 'items' THEN label END) AS location FROM r GROUP BY ALL),
full_bank AS (SELECT * FROM bank WHERE action IS NOT NULL AND location IS NOT NULL),
prompts AS (SELECT DISTINCT role, bucket, 0 AS template, 0 AS pos, 'a photo of a ' || role AS prompt FROM full_bank UNION ALL SELECT role, bucket, 1, pos, 'a photo of a ' || role || ' in a ' || location FROM full_bank
  UNION ALL SELECT role, bucket, 2, pos, 'a photo of a ' || role || ' ' || action || ' in a ' || location FROM full_bank)
"""


@query("e01_x52_prompts", _BANK + "SELECT * FROM prompts")
def e01(spark, sf_dir):
    return P.expand(_bank(spark, sf_dir))


@query("u05_w05_first_prompts", _BANK + "SELECT * FROM prompts QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY role, bucket, template, pos) = 1")
def u05(spark, sf_dir):
    return P.first_by_text(P.expand(_bank(spark, sf_dir)))


@query("e03_x66_image_plan", _BANK + ", f AS (SELECT DISTINCT prompt FROM prompts) SELECT prompt, CAST(unnest(range(0, 20)) AS INTEGER) AS seed_no FROM f")
def e03(spark, sf_dir):
    """Seeds are pseudo-random; the plan without them is checked, and that they are numbers from 1 to MOST_SEED by tests."""
    return P.image_plan(P.first_by_text(P.expand(_bank(spark, sf_dir)))).select("prompt", "seed_no")


@query("e02_f07_x51_scored_items", _BANK + "SELECT role, bucket, pos, text, 1 + length(text) % 5 >= 4 AND 1 + length(text) % 7 % 5 >= 4 AND length(text) % 4 <= 2 AS accept FROM (SELECT role, bucket, pos, action || ' in ' || location AS text FROM full_bank)")
def e02(spark, sf_dir):
    bank = _bank(spark, sf_dir).where("action IS NOT NULL AND location IS NOT NULL")
    items = bank.select("role", "bucket", "pos", P.item_text(F.lit(None).cast("string"), F.col("action"), F.col("location")).alias("text"))
    rows = P.retried(items, lambda df: P.scored(df, "text", P.length_client))
    return rows.select("role", "bucket", "pos", "text", P.passes("score").alias("accept"))


@query("z01_z02_z03_stream_counts", _TOKENS + "SELECT cohort, dimension, label, count(*) AS count FROM tokens GROUP BY ALL")
def z01(spark, sf_dir):
    out = fresh_folder(spark, "stream")
    follow(spark, f"{sf_dir}/audit_records.parquet*", "record_id bigint, record string", out)
    return running_counts(spark, out)


@query("z02_dead_letters", "SELECT record_id FROM audit_records WHERE record IS NULL OR NOT json_valid(record)")
def z02(spark, sf_dir):
    out = fresh_folder(spark, "stream")
    follow(spark, f"{sf_dir}/audit_records.parquet*", "record_id bigint, record string", out)
    return dead_letters(spark, out).select("record_id")


@query("z02_resent", """SELECT (SELECT count(*) FROM audit_records WHERE record IS NULL OR NOT json_valid(record)) AS dead_before, (SELECT count(*) FROM audit_records WHERE record IS NULL OR NOT json_valid(record)) AS resent, CAST(0 AS BIGINT) AS dead_after""")
def z02_resent(spark, sf_dir):
    """All dead letters come again as empty records and are counted as read."""
    out = fresh_folder(spark, "stream")
    follow(spark, f"{sf_dir}/audit_records.parquet*", "record_id bigint, record string", out)
    before = dead_letters(spark, out).count()
    again = dead_letters(spark, out).select("record_id", F.lit('{"cohorts": {}}').alias("record"))
    resent = resend(spark, out, again, "1").count()
    return spark.createDataFrame([(before, resent, dead_letters(spark, out).count())], "dead_before bigint, resent bigint, dead_after bigint")
