"""The observation fact over the star-schema tables, and pieces of SQL that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.runtime import read_table, spread

MODELS = {"1-URGENT": "gen_SDXL", "2-HIGH": "gen_3.5", "3-MEDIUM": "gen_Flux"}
CONTEXT = {"F": "Context-free_CF", "O": "Context-aware_Related_CA-R"}


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded for comparison, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def sql_rounded(select: str, columns: list[str], doubles: list[str], digits: int = 9) -> str:
    return "SELECT " + ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" if c in doubles else c for c in columns) + f" FROM ({select})"


def chosen(values: dict[str, str], key: Column, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: model, context, occupation, type, prompt, cohort, dimension, label, count."""
    line = spread(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(
        chosen(MODELS, F.col("o_orderpriority"), "gen_Qwen").alias("model"), chosen(CONTEXT, F.col("o_orderstatus"), "Context-aware_Unrelated_CA-U").alias("context"), F.col("c_mktsegment").alias("occupation"),
        F.year("o_orderdate").cast("string").alias("type"), F.concat(F.lit("m"), F.month("o_orderdate")).alias("prompt"), "l_returnflag", "l_linestatus", "p_brand", "p_type",
    )
    four = "stack(4, 'people', 'return_flag', l_returnflag, 'camera', 'line_status', l_linestatus, 'objects', 'brand', p_brand, 'scene_appearance', 'part_type', p_type) AS (cohort, dimension, label)"
    key = ["model", "context", "occupation", "type", "prompt", "cohort", "dimension", "label"]
    return rows.selectExpr("model", "context", "occupation", "type", "prompt", four).groupBy(*key).agg(F.count(F.lit(1)).alias("count"))


OBS = """WITH base AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'gen_SDXL' WHEN '2-HIGH' THEN 'gen_3.5' WHEN '3-MEDIUM' THEN 'gen_Flux' ELSE 'gen_Qwen' END AS model,
         CASE o_orderstatus WHEN 'F' THEN 'Context-free_CF' WHEN 'O' THEN 'Context-aware_Related_CA-R' ELSE 'Context-aware_Unrelated_CA-U' END AS context,
         c_mktsegment AS occupation, CAST(year(o_orderdate) AS VARCHAR) AS type, concat('m', month(o_orderdate)) AS prompt, l_returnflag, l_linestatus, p_brand, p_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
stacked AS (
  SELECT model, context, occupation, type, prompt, 'people' AS cohort, 'return_flag' AS dimension, l_returnflag AS label FROM base
  UNION ALL SELECT model, context, occupation, type, prompt, 'camera', 'line_status', l_linestatus FROM base
  UNION ALL SELECT model, context, occupation, type, prompt, 'objects', 'brand', p_brand FROM base
  UNION ALL SELECT model, context, occupation, type, prompt, 'scene_appearance', 'part_type', p_type FROM base),
obs AS (SELECT model, context, occupation, type, prompt, cohort, dimension, label, count(*) AS count FROM stacked GROUP BY ALL)
"""


def sql_label_key(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


COUNTS = OBS + f""", grouped AS (
  SELECT model, dimension, cohort, unnest([type, 'ALL_TYPES']) AS prompt_group, context, occupation, type || '||' || prompt AS prompt_id, {sql_label_key("label")} AS label, count FROM obs),
counts AS (SELECT model, dimension, cohort, prompt_group, context, occupation, prompt_id, label, CAST(least(sum(count), 10) AS BIGINT) AS count FROM grouped WHERE label <> 'unknown' GROUP BY ALL)
"""
DENSE = COUNTS + """, occ AS (SELECT model, dimension, cohort, prompt_group, context, occupation, 10 * count(DISTINCT prompt_id) AS n_occ FROM counts GROUP BY ALL),
grid AS (SELECT *, CAST(sum(n_occ) OVER (PARTITION BY model, dimension, cohort, prompt_group, context) AS BIGINT) AS n_context,
                   CAST(sum(n_occ) OVER (PARTITION BY model, dimension, cohort, prompt_group) AS BIGINT) AS n_all FROM occ),
labels AS (SELECT model, dimension, cohort, prompt_group, label, CAST(sum(count) AS BIGINT) AS obs_whole FROM counts GROUP BY ALL),
bins AS (SELECT model, dimension, cohort, prompt_group, count(DISTINCT label) AS bins FROM counts GROUP BY ALL),
seen AS (SELECT model, dimension, cohort, prompt_group, context, occupation, label, CAST(sum(count) AS BIGINT) AS c FROM counts GROUP BY ALL),
full_grid AS (SELECT g.*, l.label, l.obs_whole, b.bins, coalesce(s.c, 0) AS count
  FROM grid g JOIN labels l USING (model, dimension, cohort, prompt_group) JOIN bins b USING (model, dimension, cohort, prompt_group)
  LEFT JOIN seen s USING (model, dimension, cohort, prompt_group, context, occupation, label)),
ctx AS (SELECT *, CAST(sum(count) OVER (PARTITION BY model, dimension, cohort, prompt_group, context, label) AS BIGINT) AS obs_context FROM full_grid),
loo AS (SELECT *, CASE WHEN n_all > n_occ THEN (obs_whole - count) / (n_all - n_occ)::DOUBLE END AS loo_occ,
                  CASE WHEN n_all > n_context THEN (obs_whole - obs_context) / (n_all - n_context)::DOUBLE END AS loo_context FROM ctx),
ex AS (SELECT *, n_occ * loo_occ AS exp_occ, n_context * loo_context AS exp_context FROM loo),
dense AS (SELECT *, greatest(bins - 1, 0) AS df, 1.0::DOUBLE / bins AS uniform_prop, n_all * (1.0::DOUBLE / bins) AS exp_whole,
   obs_whole / n_all::DOUBLE AS prop_overall, obs_context / n_context::DOUBLE AS prop_context, count / n_occ::DOUBLE AS prop_occ,
   CASE WHEN exp_occ > 0 THEN (count - exp_occ) * (count - exp_occ) / exp_occ WHEN exp_occ = 0 AND count = 0 THEN 0.0 END AS chi_occ,
   CASE WHEN exp_context > 0 THEN (obs_context - exp_context) * (obs_context - exp_context) / exp_context WHEN exp_context = 0 AND obs_context = 0 THEN 0.0 END AS chi_context FROM ex)
"""


def sql_tail(x: str, df: str) -> str:
    """Upper chi-square tail in DuckDB SQL by its series; null without degrees of freedom."""
    series = f"list_sum(list_transform(range(0, 400), lambda n: exp(({df} / 2.0 + n) * ln(greatest({x}, 1e-300) / 2.0) - {x} / 2.0 - lgamma({df} / 2.0 + n + 1))))"
    return f"CASE WHEN {df} <= 0 OR {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0::DOUBLE WHEN ({x} - {df}) / 2.0 + 10 * sqrt({x} / 2.0) > 390 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - {series}) END"


def sql_short(x: str) -> str:
    return f"CASE {x} WHEN 'Context-free_CF' THEN 'CF' WHEN 'Context-aware_Related_CA-R' THEN 'CA-R' WHEN 'Context-aware_Unrelated_CA-U' THEN 'CA-U' ELSE {x} END"


def sql_key(x: str) -> str:
    return f"CASE split_part({x}, '_', -1) WHEN 'SDXL' THEN 'XL' WHEN '3.5' THEN 'M35' WHEN 'Flux' THEN 'Flx' WHEN 'Qwen' THEN 'Qwen' ELSE {x} END"


def sql_concentration(x: str) -> str:
    return (
        f"CASE WHEN sum({x}) > 0 THEN CASE WHEN count({x}) <= 1 THEN 0.0::DOUBLE ELSE "
        f"1 + (sum(CASE WHEN {x} > 0 THEN {x} * ln({x}) ELSE 0 END) / sum({x}) - ln(sum({x}))) / ln(count({x})::DOUBLE) END END"
    )


def sql_bh(source: str, p: str, by: str) -> str:
    """All columns of a source with ``p_adj``."""
    return f"""SELECT * EXCLUDE (_n, _r), CASE WHEN {p} IS NOT NULL THEN least(1.0, min(_n / (_n - _r + 1)::DOUBLE * {p}) OVER (PARTITION BY {by} ORDER BY {p} DESC NULLS LAST, _r ROWS UNBOUNDED PRECEDING)) END AS p_adj
FROM (SELECT *, count({p}) OVER (PARTITION BY {by}) AS _n, row_number() OVER (PARTITION BY {by} ORDER BY {p} DESC NULLS LAST) AS _r FROM {source})"""
