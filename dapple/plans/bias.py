"""Concentration, leave-one-out tests and tables over the observation fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dapple.functions.normalize import percent_p, short_context
from dapple.functions.stats import with_bh
from dapple.operators import bootstrap as B
from dapple.operators import dense as D
from dapple.operators import tables as T
from dapple.operators import uniformity as U
from dapple.plans.common import COUNTS, DENSE, OBS, observations, rounded, sql_bh, sql_concentration, sql_key, sql_rounded, sql_short, sql_tail

GROUP = "model, dimension, cohort, prompt_group"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dense_fact(observations(spark, sf_dir))


@query("s02_observations", OBS + "SELECT * FROM obs")
def s02_observations(spark, sf_dir):
    return observations(spark, sf_dir)


@query("a01_a02_a03_prompt_counts", COUNTS + "SELECT * FROM counts")
def a01_prompt_counts(spark, sf_dir):
    return D.prompt_counts(observations(spark, sf_dir))


@query("a04_label_grid", COUNTS + f"SELECT DISTINCT {GROUP}, label FROM counts")
def a04_label_grid(spark, sf_dir):
    return D.prompt_counts(observations(spark, sf_dir)).select(*D.GROUP, "label").distinct()


@query("a05_denominators", COUNTS + f"""SELECT *, CAST(sum(n_occ) OVER (PARTITION BY {GROUP}, context) AS BIGINT) AS n_context, CAST(sum(n_occ) OVER (PARTITION BY {GROUP}) AS BIGINT) AS n_all
FROM (SELECT {GROUP}, context, occupation, 10 * count(DISTINCT prompt_id) AS n_occ FROM counts GROUP BY ALL)""")  # fmt: skip
def a05_denominators(spark, sf_dir):
    return D.denominators(D.prompt_counts(observations(spark, sf_dir)))


@query("a06_rollup", COUNTS + """SELECT model, dimension, context, occupation, label, CAST(sum(count) AS BIGINT) AS obs FROM counts WHERE prompt_group = 'ALL_TYPES'
GROUP BY GROUPING SETS ((model, dimension, context, occupation, label), (model, dimension, context, label), (model, dimension, label))""")  # fmt: skip
def a06_rollup(spark, sf_dir):
    rows = D.prompt_counts(observations(spark, sf_dir)).where("prompt_group = 'ALL_TYPES'")
    whole = ["model", "dimension", "label"]
    return rows.groupingSets([["model", "dimension", "context", "occupation", "label"], ["model", "dimension", "context", "label"], whole], "model", "dimension", "context", "occupation", "label").agg(F.sum("count").alias("obs"))


@query("a07_bins", COUNTS + f"SELECT {GROUP}, count(DISTINCT label) AS bins, round(1.0::DOUBLE / count(DISTINCT label), 9) AS uniform_prop, greatest(count(DISTINCT label) - 1, 0) AS df FROM counts GROUP BY ALL")
def a07_bins(spark, sf_dir):
    rows = D.prompt_counts(observations(spark, sf_dir)).groupBy(*D.GROUP).agg(F.countDistinct("label").alias("bins"))
    return rows.withColumns({"uniform_prop": F.round(1.0 / F.col("bins"), 9), "df": F.greatest(F.col("bins") - 1, F.lit(0))})


FACT = [*D.GROUP, "context", "occupation", "label", "count", "bins", "uniform_prop", "n_all", "prop_overall", "n_context", "prop_context", "n_occ", "prop_occ", "exp_occ", "chi_occ", "df", "exp_whole", "obs_whole", "exp_context", "obs_context", "chi_context", "loo_context", "loo_occ"]
_DOUBLES = ["uniform_prop", "prop_overall", "prop_context", "prop_occ", "exp_occ", "chi_occ", "exp_whole", "exp_context", "chi_context", "loo_context", "loo_occ"]


@query("a08_x02_x03_j02_j03_dense", DENSE + sql_rounded("SELECT * FROM dense", FACT, _DOUBLES, 7))
def a08_dense(spark, sf_dir):
    return rounded(_dense(spark, sf_dir).select(*FACT), 7)


_BIAS = DENSE + f""", sums AS (SELECT model, prompt_group, dimension, cohort, context, occupation, coalesce(sum(chi_occ), 0.0) AS chi_value, max(df) AS df FROM dense GROUP BY ALL),
tested AS (SELECT *, {sql_tail("chi_value", "df")} AS p_value FROM sums), adjusted AS ({sql_bh("tested", "p_value", "model, prompt_group")})
"""


@query("a09_w01_x05_bias_occ", _BIAS + sql_rounded("SELECT * FROM adjusted", ["model", "prompt_group", "dimension", "cohort", "context", "occupation", "chi_value", "df", "p_value", "p_adj"], ["chi_value", "p_value", "p_adj"], 7))
def a09_bias_occ(spark, sf_dir):
    return rounded(T.bias_by_occupation(_dense(spark, sf_dir)), 7)


def _sql_arms(source: str) -> str:
    arms = ("CF", "CA_Unrel", "CA_Rel")
    ok = {a: f"(n_{a} > 0 AND x_{a} BETWEEN 0 AND n_{a})" for a in arms}
    n = " + ".join(f"CASE WHEN {ok[a]} THEN n_{a} ELSE 0 END" for a in arms)
    x = " + ".join(f"CASE WHEN {ok[a]} THEN x_{a} ELSE 0 END" for a in arms)
    k = " + ".join(f"CASE WHEN {ok[a]} THEN 1 ELSE 0 END" for a in arms)
    stat = " + ".join(f"CASE WHEN {ok[a]} THEN (x_{a} - n_{a} * _p) * (x_{a} - n_{a} * _p) / (n_{a} * _p * (1 - _p)) ELSE 0 END" for a in arms)
    pct = ", ".join(f"CASE WHEN n_{a} > 0 THEN 100 * (x_{a} / n_{a}::DOUBLE) END AS pct_{a}" for a in (*arms, "all"))
    return f"""SELECT * EXCLUDE (_k, _p, _stat), CASE WHEN _k >= 2 AND _p > 0 AND _p < 1 THEN _stat ELSE 0.0::DOUBLE END AS chisq_stat, CAST(greatest(_k - 1, 0) AS INTEGER) AS df,
      CASE WHEN _k >= 2 AND _p > 0 AND _p < 1 THEN {sql_tail("_stat", "(_k - 1)")} ELSE 1.0::DOUBLE END AS p_value
    FROM (SELECT *, CASE WHEN _k >= 2 AND _p > 0 AND _p < 1 THEN {stat} END AS _stat FROM (
      SELECT *, {pct}, {k} AS _k, CASE WHEN ({n}) > 0 THEN ({x}) / ({n})::DOUBLE END AS _p FROM (SELECT *, x_CF + x_CA_Unrel + x_CA_Rel AS x_all, n_CF + n_CA_Unrel + n_CA_Rel AS n_all FROM {source})))"""


_ARMS = {"CF": "CF", "CA-U": "CA_Unrel", "CA-R": "CA_Rel"}
_OCC = DENSE + f""", short AS (SELECT *, {sql_short("context")} AS arm FROM dense),
one AS (SELECT {GROUP}, occupation, label, {", ".join(f"CAST(coalesce(sum(CASE WHEN arm = '{c}' THEN count END), 0) AS BIGINT) AS x_{a}, coalesce(max(CASE WHEN arm = '{c}' THEN n_occ END), 0) AS n_{a}" for c, a in _ARMS.items())} FROM short GROUP BY ALL),
every AS (SELECT 'ALL' AS model, dimension, cohort, prompt_group, occupation, label, {", ".join(f"CAST(sum({v}_{a}) AS BIGINT) AS {v}_{a}" for a in _ARMS.values() for v in "xn")} FROM one GROUP BY ALL),
tested AS ({_sql_arms("one")}), adjusted AS ({sql_bh("tested", "p_value", "model, prompt_group")}), pooled AS ({_sql_arms("every")}),
occ_table AS (SELECT *, NULL::DOUBLE AS p_adj FROM pooled UNION ALL BY NAME SELECT * FROM adjusted)
"""
OCC = ["model", "dimension", "cohort", "prompt_group", "occupation", "label", *[f"{v}_{a}" for a in ("CF", "CA_Unrel", "CA_Rel", "all") for v in ("x", "n", "pct")], "chisq_stat", "df", "p_value", "p_adj"]
_OCC_D = ["pct_CF", "pct_CA_Unrel", "pct_CA_Rel", "pct_all", "chisq_stat", "p_value", "p_adj"]


@query("a10_x04_u01_occ_table", _OCC + sql_rounded("SELECT * FROM occ_table", OCC, _OCC_D, 7))
def a10_occ_table(spark, sf_dir):
    return rounded(T.occupation_table(_dense(spark, sf_dir)).select(*OCC), 7)


_KEYS = ["ALL", "XL", "M35", "Flx", "Qwen"]
_WIDE = [f"{k}_{v}" for k in _KEYS for v in ("pct_all", "chisq_stat", "p_value", "p_adj")]


@query("r01_r04_occ_wide", _OCC + sql_rounded("SELECT dimension, cohort, prompt_group, occupation, label, " + ", ".join(f"max(CASE WHEN k = '{k}' THEN {v} END) AS {k}_{v}" for k in _KEYS for v in ("pct_all", "chisq_stat", "p_value", "p_adj")) + f" FROM (SELECT *, CASE WHEN model = 'ALL' THEN 'ALL' ELSE {sql_key('model')} END AS k FROM occ_table) GROUP BY ALL", ["dimension", "cohort", "prompt_group", "occupation", "label", *_WIDE], _WIDE, 7))
def r01_occ_wide(spark, sf_dir):
    return rounded(T.occupation_wide(T.occupation_table(_dense(spark, sf_dir)), _KEYS), 7)


def _sql_persist(source: str, key: str, ctx: str) -> str:
    return f"""SELECT *, coalesce({sql_tail("chi_sq_loo", "df_loo")}, 1.0) AS p_value_loo FROM (
  SELECT *, CASE WHEN total_n > 0 THEN 100 * (label_n / total_n::DOUBLE) END AS pct, greatest(n_contexts - 1, 0) AS df_loo FROM (
  SELECT {key}, CAST(sum(count) AS BIGINT) AS label_n, CAST(sum(n_occ) AS BIGINT) AS total_n, coalesce(sum(chi_occ), 0.0) AS chi_sq_loo, count(DISTINCT CASE WHEN chi_occ IS NOT NULL THEN {ctx} END) AS n_contexts FROM {source} GROUP BY ALL))"""


_PKEY = "model, model_key, prompt_group, activity_family, dimension, dimension_family, cohort, occupation, label"
_PERSIST = DENSE + f""", named AS (SELECT *, {sql_key("model")} AS model_key, CASE prompt_group WHEN 'ALL_TYPES' THEN 'All activity types' ELSE prompt_group END AS activity_family,
  CASE dimension WHEN 'brand' THEN 'Brand' WHEN 'line_status' THEN 'Line_Status' WHEN 'part_type' THEN 'Part_Type' WHEN 'return_flag' THEN 'Return_Flag' END AS dimension_family FROM dense),
persist AS (SELECT *, p_value_loo > 0.05 AS invariant FROM ({_sql_persist("named", _PKEY, "context")}))
"""
_PCOLS = [*_PKEY.split(", "), "label_n", "total_n", "chi_sq_loo", "n_contexts", "pct", "df_loo", "p_value_loo", "invariant"]


@query("a11_j04_x27_x29_persistence", _PERSIST + sql_rounded("SELECT * FROM persist", _PCOLS, ["chi_sq_loo", "pct", "p_value_loo"], 7))
def a11_persistence(spark, sf_dir):
    return rounded(T.label_persistence(_dense(spark, sf_dir)), 7)


_T2KEY = "model_pretty, model_key, prompt_type_category, dimension, dimension_family, cohort, occupation, label"
_T2 = DENSE + f""", named AS (SELECT *, CASE model_key WHEN 'M35' THEN '3.5' WHEN 'Flx' THEN 'Flux' ELSE model_key END AS model_pretty, CASE WHEN arm = 'CF' THEN 'No type' ELSE 'Other type' END AS prompt_type_category FROM (
  SELECT *, {sql_key("model")} AS model_key, {sql_short("context")} AS arm, CASE cohort WHEN 'people' THEN 'People' WHEN 'objects' THEN 'Objects' WHEN 'camera' THEN 'Camera' END AS dimension_family FROM dense)
  WHERE dimension_family IS NOT NULL AND prompt_group <> 'ALL_TYPES'),
source AS (SELECT *, p_value_loo > 0.05 AS invariant FROM ({_sql_persist("named", _T2KEY, "arm")})),
bare AS (SELECT 'No type' AS prompt_type_category, 'mean baseline prevalence' AS table_metric, coalesce(model_pretty, 'Total') AS model, coalesce(dimension_family, 'All') AS dimension_family, count(*) AS n_labels_tested, avg(pct) AS mean_pct, median(pct) AS median_pct FROM source WHERE prompt_type_category = 'No type' GROUP BY CUBE (model_pretty, dimension_family)),
typed AS (SELECT 'Other type' AS prompt_type_category, '% invariant / mean p-value' AS table_metric, coalesce(model_pretty, 'Total') AS model, coalesce(dimension_family, 'All') AS dimension_family, count(*) AS n_labels_tested, 100 * avg(invariant::INTEGER) AS pct_invariant, avg(p_value_loo) AS mean_p, median(p_value_loo) AS median_p FROM source WHERE prompt_type_category = 'Other type' GROUP BY CUBE (model_pretty, dimension_family)),
table2 AS (SELECT * FROM bare UNION ALL BY NAME SELECT * FROM typed)
"""
_T2COLS = [*_T2KEY.split(", "), "label_n", "total_n", "chi_sq_loo", "n_contexts", "pct", "df_loo", "p_value_loo", "invariant"]


@query("a12_f11_f12_x28_table2_source", _T2 + sql_rounded("SELECT * FROM source", _T2COLS, ["chi_sq_loo", "pct", "p_value_loo"], 7))
def a12_table2_source(spark, sf_dir):
    return rounded(T.table2_source(_dense(spark, sf_dir)), 7)


_T2M = ["mean_pct", "median_pct", "pct_invariant", "mean_p", "median_p"]


@query("a13_a14_table2", _T2 + sql_rounded("SELECT * FROM table2", ["prompt_type_category", "table_metric", "model", "dimension_family", "n_labels_tested", *_T2M], _T2M, 7))
def a13_table2(spark, sf_dir):
    return rounded(T.table2(T.table2_source(_dense(spark, sf_dir))), 7)


_T3M = ["mean_pct", "min_pct", "mean_p", "max_chi"]
_T3 = _PERSIST + f""", t3 AS (SELECT *, CASE WHEN total_n > 0 THEN 100 * (label_n / total_n::DOUBLE) END AS pct, coalesce({sql_tail("chi_sq_loo", "df_loo")}, 1.0) AS p FROM (
  SELECT model_key, occupation, label, sum(label_n) AS label_n, sum(total_n) AS total_n, sum(chi_sq_loo) AS chi_sq_loo, CAST(sum(df_loo) AS BIGINT) AS df_loo FROM persist WHERE prompt_group = 'ALL_TYPES' GROUP BY ALL)),
ranked AS (SELECT occupation, label, count(DISTINCT model_key) AS n_models, avg(pct) AS mean_pct, min(pct) AS min_pct, avg(p) AS mean_p, max(chi_sq_loo) AS max_chi, {", ".join(f"max(CASE WHEN model_key = '{k}' THEN round_even(pct, 0) END) AS {k}_pct, max(CASE WHEN model_key = '{k}' THEN p END) AS {k}_p" for k in ("XL", "M35", "Flx", "Qwen"))}
  FROM t3 GROUP BY ALL HAVING count(DISTINCT model_key) = 4)
"""
_T3C = ["occupation", "label", "n_models", *_T3M, *[f"{k}_{v}" for k in ("XL", "M35", "Flx", "Qwen") for v in ("pct", "p")]]


@query("a15_j05_j06_w06_o02_table3", _T3 + sql_rounded("SELECT * FROM ranked", _T3C, [c for c in _T3C if c not in ("occupation", "label", "n_models")], 7))
def a15_table3(spark, sf_dir):
    return rounded(T.table3(T.table3_base(T.label_persistence(_dense(spark, sf_dir)), D.POOLED)).select(*_T3C), 7)


@query("a16_x07_fig2", DENSE + f""", inten AS (SELECT model, {sql_short("context")} AS context_short, CASE cohort WHEN 'people' THEN 'People' WHEN 'objects' THEN 'Objects' WHEN 'camera' THEN 'Camera' ELSE 'Scene' END AS dimension_family, dimension, cohort, {sql_concentration("prop_context")} AS i
  FROM (SELECT DISTINCT model, context, dimension, cohort, label, prop_context FROM dense WHERE prompt_group = 'ALL_TYPES') GROUP BY ALL)
SELECT model, context_short, dimension_family, round(avg(i), 9) + 0.0 AS mean_intensity FROM inten GROUP BY ALL""")  # fmt: skip
def a16_fig2(spark, sf_dir):
    return rounded(T.intensity_by_context(_dense(spark, sf_dir), D.POOLED))


@query("a17_x07_fig3", DENSE + f"""SELECT model, dimension, round(avg(i), 9) + 0.0 AS avg_intensity FROM (SELECT model, dimension, cohort, {sql_concentration("c")} AS i FROM (
  SELECT model, dimension, cohort, label, sum(count)::DOUBLE AS c FROM dense WHERE prompt_group = 'ALL_TYPES' GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""")  # fmt: skip
def a17_fig3(spark, sf_dir):
    return rounded(T.intensity_by_dimension(_dense(spark, sf_dir), D.POOLED))


_TB3 = _OCC + f""", sums AS (SELECT {sql_key("model")} AS model_key, occupation, label, {", ".join(f"CAST(sum({v}_{a}) AS BIGINT) AS {v}_{a}" for a in _ARMS.values() for v in "xn")} FROM occ_table WHERE model <> 'ALL' AND prompt_group = 'ALL_TYPES' GROUP BY ALL),
b0 AS (SELECT *, greatest(pct_CF, pct_CA_Unrel, pct_CA_Rel) - least(pct_CF, pct_CA_Unrel, pct_CA_Rel) AS pct_range, x_CF > 0 AND x_CA_Unrel > 0 AND x_CA_Rel > 0 AS present_all, x_all >= 5 AS enough FROM ({_sql_arms("sums")})),
b1 AS (SELECT *, enough AND coalesce(p_value > 0.05 AND pct_range <= 5, false) AS consistent FROM b0),
tb3 AS (SELECT *, CASE WHEN consistent AND present_all THEN 'Consistent and present in all 3 contexts' WHEN consistent THEN 'Consistent proportions but not present in all 3 contexts' ELSE 'Context-sensitive / inconsistent' END AS consistency_label,
  CASE WHEN present_all AND enough THEN pct_all / (1 + pct_range) END AS consistency_score FROM b1)
"""
_TB3C = ["model_key", "occupation", "label", "x_all", "n_all", "pct_all", "pct_range", "present_all", "enough", "chisq_stat", "df", "p_value", "consistent", "consistency_label", "consistency_score"]


def _base(spark, sf_dir):
    return T.context_consistency(T.occupation_table(_dense(spark, sf_dir)), D.POOLED)


@query("a18_x11_consistency", _TB3 + sql_rounded("SELECT * FROM tb3", _TB3C, ["pct_all", "pct_range", "chisq_stat", "p_value", "consistency_score"], 7))
def a18_consistency(spark, sf_dir):
    return rounded(_base(spark, sf_dir).select(*_TB3C), 7)


@query("a19_model_summary", _TB3 + "SELECT model_key, count(*) AS n_labels_tested, count(*) FILTER (consistent) AS n_consistent, round(100 * (count(*) FILTER (consistent) / count(*)::DOUBLE), 7) AS pct_consistent, round(avg(pct_range), 7) AS mean_pct_range, round(median(pct_range), 7) AS median_pct_range FROM tb3 GROUP BY ALL")
def a19_model_summary(spark, sf_dir):
    return rounded(T.consistency_summary(_base(spark, sf_dir)), 7)


_RANK = ["occupation", "label", "n_models", "mean_pct", "min_pct", "mean_range", "max_range", "mean_p", "min_p", "n_consistent_models", "all_models_consistent", "mean_consistency_score"]


@query("a20_rank", _TB3 + sql_rounded("SELECT occupation, label, count(DISTINCT model_key) AS n_models, avg(pct_all) AS mean_pct, min(pct_all) AS min_pct, avg(pct_range) AS mean_range, max(pct_range) AS max_range, avg(p_value) AS mean_p, min(p_value) AS min_p, count(*) FILTER (consistent) AS n_consistent_models, bool_and(consistent) AS all_models_consistent, avg(consistency_score) AS mean_consistency_score FROM tb3 GROUP BY ALL HAVING count(DISTINCT model_key) = 4", _RANK, [c for c in _RANK if c[:4] in ("mean", "min_", "max_")], 7))
def a20_rank(spark, sf_dir):
    return rounded(T.consistency_rank(_base(spark, sf_dir)).select(*_RANK), 7)


@query("f12_preferred_group", COUNTS + """SELECT 'all' AS rows, CASE WHEN count(*) FILTER (prompt_group = 'ALL_TYPES') > 0 THEN 'ALL_TYPES' ELSE min(prompt_group) END AS prompt_group FROM counts
UNION ALL SELECT 'typed', CASE WHEN count(*) FILTER (prompt_group = 'ALL_TYPES') > 0 THEN 'ALL_TYPES' ELSE min(prompt_group) END FROM counts WHERE prompt_group <> 'ALL_TYPES'""")  # fmt: skip
def f12_preferred_group(spark, sf_dir):
    every = D.prompt_counts(observations(spark, sf_dir))
    typed = D.prompt_counts(observations(spark, sf_dir), pooled=False)
    one = lambda name, rows: spark.range(1).select(F.lit(name).alias("rows"), T.preferred_group(rows).alias("prompt_group"))
    return one("all", every).unionByName(one("typed", typed))


def _sql_text(x: str) -> str:
    return f"regexp_replace(format('{{:.2f}}', {x}), '^0', '')"


@query("x31_p_texts", _BIAS + f"SELECT model, prompt_group, dimension, context, occupation, CASE WHEN p_value IS NULL THEN '' WHEN p_value < 0.005 THEN '.00' ELSE {_sql_text('p_value')} END AS p FROM adjusted")
def x31_p_texts(spark, sf_dir):
    return T.bias_by_occupation(_dense(spark, sf_dir)).select("model", "prompt_group", "dimension", "context", "occupation", percent_p(F.col("p_value")).alias("p"))


@query("x32_o01_o04_table2_cells", _T2 + f"""SELECT prompt_type_category, model, dimension_family, n_labels_tested,
  CASE WHEN prompt_type_category = 'No type' THEN coalesce(format('{{:.1f}}', mean_pct), '') ELSE coalesce(format('{{:.1f}}', pct_invariant), 'nan') || '/' || coalesce({_sql_text('mean_p')}, 'nan') END AS cell,
  CAST(row_number() OVER (PARTITION BY prompt_type_category ORDER BY list_position(['XL', '3.5', 'Flux', 'Qwen', 'Total'], model), list_position(['People', 'Objects', 'Camera', 'Sence', 'All'], dimension_family)) AS INTEGER) AS pos FROM table2""")  # fmt: skip
def x32_table2_cells(spark, sf_dir):
    return T.sorted_table2(T.table2(T.table2_source(_dense(spark, sf_dir))))


@query("o01_ranked_labels", _T3 + "SELECT occupation, label, CAST(row_number() OVER (PARTITION BY occupation ORDER BY round(mean_pct, 7) DESC NULLS LAST, round(min_pct, 7) DESC NULLS LAST, round(mean_p, 7) NULLS LAST, label) AS INTEGER) AS pos FROM ranked")
def o01_ranked(spark, sf_dir):
    rows = rounded(T.table3(T.table3_base(T.label_persistence(_dense(spark, sf_dir)), D.POOLED)), 7)
    w = Window.partitionBy("occupation").orderBy(F.desc_nulls_last("mean_pct"), F.desc_nulls_last("min_pct"), F.asc_nulls_last("mean_p"), "label")
    return rows.select("occupation", "label", F.row_number().over(w).alias("pos"))


_FULL = OBS + """, summed AS (SELECT dimension, cohort, context, occupation, label, sum(count)::DOUBLE AS count FROM obs WHERE label <> 'unknown' GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT dimension, cohort FROM summed) JOIN (SELECT DISTINCT dimension, cohort, context FROM summed) USING (dimension, cohort)
  JOIN (SELECT DISTINCT dimension, cohort, occupation FROM summed) USING (dimension, cohort) JOIN (SELECT DISTINCT dimension, cohort, label FROM summed) USING (dimension, cohort)),
filled AS (SELECT g.*, coalesce(s.count, 0) AS count FROM grid g LEFT JOIN summed s USING (dimension, cohort, context, occupation, label)),
bins AS (SELECT dimension, cohort, count(DISTINCT label) AS bins FROM filled GROUP BY ALL),
totals AS (SELECT *, sum(count) OVER (PARTITION BY dimension, cohort) AS n_all, sum(count) OVER (PARTITION BY dimension, cohort, context) AS n_context, sum(count) OVER (PARTITION BY dimension, cohort, context, occupation) AS n_occ,
  sum(count) OVER (PARTITION BY dimension, cohort, label) AS obs_whole, sum(count) OVER (PARTITION BY dimension, cohort, context, label) AS obs_context FROM filled JOIN bins USING (dimension, cohort)),
full_fact AS (SELECT *, 1.0::DOUBLE / bins AS uniform_prop, obs_whole / n_all AS prop_overall, n_all / bins AS exp_whole, n_context * (obs_whole / n_all) AS exp_context, n_occ * (obs_whole / n_all) AS exp_occ FROM totals)
"""
_FULLC = ["dimension", "cohort", "context", "occupation", "label", "count", "n_all", "n_context", "n_occ", "obs_whole", "obs_context", "bins", "uniform_prop", "prop_overall", "exp_whole", "exp_context", "exp_occ"]


def _full(spark, sf_dir):
    return U.completed(observations(spark, sf_dir))


@query("j07_j08_w02_w03_completed", _FULL + sql_rounded("SELECT *  REPLACE (CAST(bins AS INTEGER) AS bins) FROM full_fact", _FULLC, ["count", "n_all", "n_context", "n_occ", "obs_whole", "obs_context", "uniform_prop", "prop_overall", "exp_whole", "exp_context", "exp_occ"], 7))
def j07_completed(spark, sf_dir):
    return rounded(_full(spark, sf_dir).select(*_FULLC), 7)


def _sql_fit(key: str, o: str, e: str, digits: int = 7) -> str:
    inner = f"SELECT {key}, sum(CASE WHEN e = 0 THEN 0 ELSE (e - o) * (e - o) / e END) AS chi_value, count(DISTINCT label) - 1 AS df FROM (SELECT DISTINCT {key}, label, {o} AS o, {e} AS e FROM full_fact) GROUP BY ALL"
    return sql_rounded(f"SELECT *, {sql_tail('chi_value', 'df')} AS p_value FROM ({inner})", [*key.split(", "), "chi_value", "df", "p_value"], ["chi_value", "p_value"], digits)


@query("a31_x06_uniform", _FULL + _sql_fit("dimension, cohort", "obs_whole", "exp_whole"))
def a31_uniform(spark, sf_dir):
    return rounded(U.against_uniform(_full(spark, sf_dir)), 7)


@query("a31_x06_context", _FULL + _sql_fit("dimension, cohort, context", "obs_context", "exp_context"))
def a31_context(spark, sf_dir):
    return rounded(U.by_context(_full(spark, sf_dir)), 7)


@query("a31_x06_occupation", _FULL + _sql_fit("dimension, cohort, context, occupation", "count", "exp_occ"))
def a31_occupation(spark, sf_dir):
    return rounded(U.by_occupation(_full(spark, sf_dir)), 7)


@query("r02_f15_j17_p_matrix", _FULL + f", fit AS ({_sql_fit('dimension, cohort, context, occupation', 'count', 'exp_occ', 14)}) SELECT occupation, " + ", ".join(f"round(avg(CASE WHEN dimension = '{d}' THEN least(greatest(p_value, 0), 1) END), 6) AS {d}" for d in ("brand", "line_status", "part_type", "return_flag")) + " FROM fit GROUP BY ALL")
def r02_p_matrix(spark, sf_dir):
    tests = U.by_occupation(_full(spark, sf_dir))
    return rounded(U.p_matrix(tests, "occupation", "dimension", ["brand", "line_status", "part_type", "return_flag"]), 6)


@query("w01_bh_by_dimension", OBS + ", t AS (SELECT dimension, label, context, count(*) / 1e6::DOUBLE AS p FROM obs GROUP BY ALL), " + f"a AS ({sql_bh('t', 'p', 'dimension')}) SELECT dimension, label, context, round(p, 9) AS p, round(p_adj, 9) AS p_adj FROM a")
def w01_bh(spark, sf_dir):
    rows = observations(spark, sf_dir).groupBy("dimension", "label", "context").agg((F.count(F.lit(1)) / 1e6).alias("p"))
    return rounded(with_bh(rows, "p", ["dimension"]))


@query("x26_context_counts", OBS + f"SELECT {sql_short('context')} AS context_short, dimension, CAST(sum(count) AS BIGINT) AS n, count(DISTINCT label) AS labels FROM obs GROUP BY ALL")
def x26_context_counts(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("context_short", short_context(F.col("context")))
    return rows.groupBy("context_short", "dimension").agg(F.sum("count").alias("n"), F.countDistinct("label").alias("labels"))


@query("w08_ordinals", OBS + "SELECT occupation, dimension, CAST(dense_rank() OVER (ORDER BY occupation) AS INTEGER) AS occ_no, CAST(dense_rank() OVER (PARTITION BY occupation ORDER BY dimension) AS INTEGER) AS dim_no FROM (SELECT DISTINCT occupation, dimension FROM obs)")
def w08_ordinals(spark, sf_dir):
    rows = observations(spark, sf_dir).select("occupation", "dimension").distinct()
    names = rows.select("occupation").distinct()
    order = names.withColumn("occ_no", F.dense_rank().over(Window.orderBy("occupation")).cast("int"))
    return rows.join(order, "occupation").withColumn("dim_no", F.dense_rank().over(Window.partitionBy("occupation").orderBy("dimension")).cast("int"))


def _trajectories(spark, sf_dir, replicates: int = B.REPLICATES):
    return B.trajectories(_dense(spark, sf_dir), D.POOLED, replicates=replicates, seed=0)


@query("b01_point_concentration", DENSE + f"""SELECT model, {sql_short("context")} AS context_short, dimension, round({sql_concentration("c")}, 9) + 0.0 AS bi FROM (
  SELECT model, context, dimension, label, sum(count)::DOUBLE AS c FROM dense WHERE prompt_group = 'ALL_TYPES' AND count > 0 GROUP BY ALL) GROUP BY ALL""")  # fmt: skip
def b01_point(spark, sf_dir):
    rows = _trajectories(spark, sf_dir, replicates=0)
    return rounded(rows.select("model", "context_short", "dimension", "bi"))


_FAMILY = "CASE cohort WHEN 'people' THEN 'People' WHEN 'objects' THEN 'Objects' WHEN 'camera' THEN 'Camera' ELSE 'Scene' END"
_POINTS = DENSE + f""", bi AS (SELECT model, {sql_short("context")} AS ctx, dimension, {_FAMILY} AS family, {sql_concentration("c")} AS bi FROM (
  SELECT model, context, dimension, min(cohort) AS cohort, label, sum(count)::DOUBLE AS c FROM dense WHERE prompt_group = 'ALL_TYPES' AND count > 0 GROUP BY model, context, dimension, label) GROUP BY model, context, dimension, cohort),
fam AS (SELECT model, ctx, family, avg(bi) AS bi FROM bi GROUP BY ALL), avgs AS (SELECT ctx, family, avg(bi) AS bi FROM fam GROUP BY ALL HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM fam)),
pairs AS (SELECT * FROM (VALUES ('CA-U', 'CF'), ('CA-R', 'CF'), ('CA-U', 'CA-R')) t(hi, lo))
"""


@query("b02_b03_family_points", _POINTS + "SELECT a.family AS dimension_family, hi || ' - ' || lo AS comparison, round(a.bi - b.bi, 9) + 0.0 AS point_estimate FROM pairs JOIN avgs a ON a.ctx = hi JOIN avgs b ON b.ctx = lo AND a.family = b.family")
def b02_points(spark, sf_dir):
    return rounded(B.points(B.family_means(_trajectories(spark, sf_dir, replicates=0))))


@query("b04_headline_point", _POINTS + ", mean AS (SELECT ctx, avg(bi) AS bi FROM avgs GROUP BY ALL) SELECT 'All' AS dimension_family, hi || ' - ' || lo AS comparison, round(a.bi - b.bi, 9) + 0.0 AS point_estimate FROM pairs JOIN mean a ON a.ctx = hi JOIN mean b ON b.ctx = lo WHERE hi = 'CA-U' AND lo = 'CF'")
def b04_point(spark, sf_dir):
    mean = B.family_means(_trajectories(spark, sf_dir, replicates=0)).groupBy("context_short", "replicate").agg(F.avg("bi").alias("bi")).withColumn("dimension_family", F.lit("All"))
    return rounded(B.points(mean, (B.PAIRS[0],)))


@query("b02_b03_x12_family_differences")
def b02_family(spark, sf_dir):
    return B.differences(B.family_means(_trajectories(spark, sf_dir)))


@query("b04_headline")
def b04_headline(spark, sf_dir):
    return B.headline(B.family_means(_trajectories(spark, sf_dir)))


@query("b05_dimension_differences")
def b05_dimensions(spark, sf_dir):
    rows = B.over_models(_trajectories(spark, sf_dir).where("dimension_family = 'Camera'"), "dimension")
    return B.differences(rows.withColumnRenamed("dimension", "dimension_family"))
