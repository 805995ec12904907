"""The dense fact of label counts with leave-one-out expectations.

A group g is (model, dimension, cohort, prompt_group). Every label of a group gets a row at each (context, occupation)
of the group, 0 where it wasn't seen. Denominators need one distinct count, of prompts at (group, context, occupation):
prompts of different occupations and contexts are different, so the higher levels are sums of it.

The dense rows are never shuffled. Counts are partitioned by group and label once and become a map of contexts to their
total and a map of occupations to counts. Each (group, label) then meets its group's places, the list of contexts and
occupations with their denominators, and spreads to them. Lists of places come in blocks of about OCCUPATIONS
occupations, so that none grows with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.functions.normalize import label_key
from dapple.functions.stats import chi_part, safe_div
from dapple.runtime import written

CAP = 10
POOLED = "ALL_TYPES"
OCCUPATIONS = 512
GROUP = ["model", "dimension", "cohort", "prompt_group"]


def known(obs: DataFrame) -> DataFrame:
    """Rows with a known label outside the totals, the label normalised, a missing type as ``no_type``. Keys may not be null."""
    rows = obs.withColumn("label", label_key(F.col("label"))).withColumn("type", F.when(F.coalesce("type", F.lit("")) == "", F.lit("no_type")).otherwise(F.col("type")))
    keys = ["model", "dimension", "cohort", "context", "occupation", "prompt"]
    wanted = (F.col("label") != "unknown") & (F.col("cohort") != "totals")
    for k in keys:
        wanted = wanted & F.col(k).isNotNull()
    return rows.where(wanted)


def prompt_counts(obs: DataFrame, cap: int | None = CAP, pooled: bool = True) -> DataFrame:
    """Counts by group, context, occupation, prompt and label, each at most ``cap``; with all types pooled as one more
    prompt group."""
    groups = F.array(F.col("type"), F.lit(POOLED)) if pooled else F.array(F.col("type"))
    rows = known(obs).withColumn("prompt_id", F.concat_ws("||", "type", "prompt")).withColumn("prompt_group", F.explode(groups))
    total = F.sum("count")
    return rows.groupBy(*GROUP, "context", "occupation", "prompt_id", "label").agg((F.least(total, F.lit(cap)) if cap else total).alias("count"))


def denominators(counts: DataFrame, cap: int = CAP) -> DataFrame:
    """``n_occ``, ``n_context``, ``n_all`` by group, context and occupation: prompts times the cap."""
    occ = counts.groupBy(*GROUP, "context", "occupation").agg((F.countDistinct("prompt_id") * cap).alias("n_occ"))
    return occ.withColumns({"n_context": F.sum("n_occ").over(Window.partitionBy(*GROUP, "context")), "n_all": F.sum("n_occ").over(Window.partitionBy(*GROUP))})


def dense_fact(obs: DataFrame, cap: int = CAP, capped: bool = True, pooled: bool = True) -> DataFrame:
    """The dense fact: counts, shares, leave-one-out baselines, expectations and chi-square parts by occupation.

    An expectation is null where the rest of the group is empty. No rows in, no rows out. The counts by prompt, from
    which everything follows, are written once, so that the observations are read once."""
    counts = written(prompt_counts(obs, cap if capped else None, pooled), "prompt-counts")
    blocks = max(1, -(-counts.agg(F.approx_count_distinct("occupation")).first()[0] // OCCUPATIONS))
    block = F.pmod(F.xxhash64("occupation"), F.lit(blocks)).cast("int")
    by, part = [*GROUP, "label"], ["_b"] if blocks > 1 else []
    of_map = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    placed = counts.withColumn("_b", block) if part else counts
    seen = placed.repartition(*by, *part).groupBy(*by, *part, "context", "occupation").agg(F.sum("count").alias("count"))
    there = seen.groupBy(*by, *part, "context").agg(of_map("occupation", "count").alias("m"), F.sum("count").alias("n"))
    cells = there.groupBy(*by, *part).agg(of_map("context", F.struct("n", "m")).alias("_cells"), F.sum("n").alias("obs_whole"))
    bins = counts.groupBy(*GROUP).agg(F.countDistinct("label").alias("bins"))
    places = denominators(counts, cap).withColumn("_b", block).groupBy(*GROUP, "n_all", *part).agg(F.collect_list(F.struct("context", "n_context", "occupation", "n_occ")).alias("_places"))
    groups = places.join(bins, GROUP)
    if part:  # a label is at every block of its group, with totals over all of them
        in_context = counts.groupBy(*by, "context").agg(F.sum("count").alias("n"))
        totals = in_context.groupBy(*by).agg(of_map("context", "n").alias("_in"), F.sum("n").alias("obs_whole"))
        rows = totals.join(groups, GROUP).join(cells.drop("obs_whole"), [*by, "_b"], "left")
    else:
        rows = cells.join(groups, GROUP)
    rows = rows.withColumn("_p", F.explode("_places")).select(*by, "obs_whole", "n_all", "bins", "_p.*", "_cells", *(["_in"] if part else []))
    cell = F.try_element_at("_cells", F.col("context"))
    in_all = F.try_element_at("_in", F.col("context")) if part else cell["n"]
    rows = rows.withColumns({"count": F.coalesce(F.try_element_at(cell["m"], F.col("occupation")), F.lit(0)), "obs_context": F.coalesce(in_all, F.lit(0))}).drop("_cells", "_in")
    return expectations(rows)


def _loo(part: Column, n: Column) -> tuple[Column, Column]:
    base = safe_div(F.col("obs_whole") - part, F.col("n_all") - n)
    return base, n * base


def expectations(rows: DataFrame) -> DataFrame:
    occ_base, occ_exp = _loo(F.col("count"), F.col("n_occ"))
    ctx_base, ctx_exp = _loo(F.col("obs_context"), F.col("n_context"))
    uniform = F.lit(1.0) / F.col("bins")
    return rows.withColumns({
        "uniform_prop": uniform, "df": F.greatest(F.col("bins") - 1, F.lit(0)), "exp_whole": F.col("n_all") * uniform,
        "prop_overall": safe_div(F.col("obs_whole"), F.col("n_all")), "prop_context": safe_div(F.col("obs_context"), F.col("n_context")), "prop_occ": safe_div(F.col("count"), F.col("n_occ")),
        "loo_context": ctx_base, "exp_context": ctx_exp, "loo_occ": occ_base, "exp_occ": occ_exp,
    }).withColumns({"chi_occ": chi_part(F.col("count"), F.col("exp_occ")), "chi_context": chi_part(F.col("obs_context"), F.col("exp_context"))})
