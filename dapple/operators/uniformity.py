"""Goodness of fit of label counts: against uniform, against the overall shares by context and by context and occupation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dapple.operators.tables import tail
from dapple.runtime import written


def completed(obs: DataFrame) -> DataFrame:
    """Counts at every context, occupation and label of a (dimension, cohort), 0 where there are none, with totals,
    shares and expectations. Rows with label ``unknown`` take no part; null counts are 0.

    Totals are sums of the counts there are, as zeros add nothing. A (dimension, cohort, label) carries its counts by context
    and occupation as a map, meets one row of its (dimension, cohort) with the contexts, occupations and totals, and
    spreads to all of them, so that the completed rows aren't shuffled."""
    dc, co = ["dimension", "cohort"], F.struct("context", "occupation")
    rows = obs.where(F.col("label") != "unknown").groupBy(*dc, "context", "occupation", "label").agg(F.sum(F.coalesce(F.col("count").cast("double"), F.lit(0.0))).alias("count"))
    rows = written(rows, "counts")
    by = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    contexts = rows.groupBy(*dc, "context").agg(F.sum("count").alias("n")).groupBy(*dc).agg(by("context", "n").alias("_contexts"), F.sum("n").alias("n_all"))
    places = rows.groupBy(*dc, "context", "occupation").agg(F.sum("count").alias("n")).groupBy(*dc).agg(by(co, "n").alias("_places"), F.collect_set("occupation").alias("_occupations"))
    bins = rows.groupBy(*dc).agg(F.countDistinct("label").cast("int").alias("bins"))
    groups = contexts.join(places, dc).join(bins, dc)
    in_context = rows.groupBy(*dc, "label", "context").agg(F.sum("count").alias("n"))
    labels = rows.groupBy(*dc, "label").agg(by(co, "count").alias("_cells"), F.sum("count").alias("obs_whole")).join(in_context.groupBy(*dc, "label").agg(by("context", "n").alias("_in")), [*dc, "label"])
    full = labels.join(groups, dc).select("*", F.explode("_contexts").alias("context", "n_context")).withColumn("occupation", F.explode("_occupations"))
    zero = F.lit(0.0)
    full = full.select(
        *dc, "context", "occupation", "label", F.coalesce(F.try_element_at("_cells", co), zero).alias("count"), "n_all", "n_context",
        F.coalesce(F.try_element_at("_places", co), zero).alias("n_occ"), "obs_whole", F.coalesce(F.try_element_at("_in", F.col("context")), zero).alias("obs_context"), "bins",
    )
    share = F.try_divide("obs_whole", "n_all")
    return full.withColumns({"uniform_prop": 1.0 / F.col("bins"), "prop_overall": share, "exp_whole": F.col("n_all") / F.col("bins"), "exp_context": F.col("n_context") * share, "exp_occ": F.col("n_occ") * share})


def _fit(rows: DataFrame, key: list[str], observed: str, expected: str) -> DataFrame:
    distinct = rows.select(*key, "label", F.col(observed).alias("o"), F.col(expected).alias("e")).distinct()
    part = F.when(F.col("e") == 0, F.lit(0.0)).otherwise((F.col("e") - F.col("o")) * (F.col("e") - F.col("o")) / F.col("e"))
    return tail(distinct.groupBy(*key).agg(F.sum(part).alias("chi_value"), (F.countDistinct("label") - 1).alias("df")), "chi_value", "df")


def against_uniform(full: DataFrame) -> DataFrame:
    return _fit(full, ["dimension", "cohort"], "obs_whole", "exp_whole")


def by_context(full: DataFrame) -> DataFrame:
    return _fit(full, ["dimension", "cohort", "context"], "obs_context", "exp_context")


def by_occupation(full: DataFrame) -> DataFrame:
    return _fit(full, ["dimension", "cohort", "context", "occupation"], "count", "exp_occ")


def p_matrix(tests: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Mean p-values, clipped to [0, 1], as a matrix with the given columns."""
    p = F.least(F.greatest(F.col("p_value"), F.lit(0.0)), F.lit(1.0))
    return tests.groupBy(row).agg(*[F.avg(F.when(F.col(column) == c, p)).alias(c) for c in columns])
