"""Cluster bootstrap of concentration over roles, and of Fleiss' kappa over items.

Replicates are data, not jobs: counts by label and role times the roles' multiplicities are one matrix product that
gives the pooled counts of all replicates. Concentration is made of sums over labels, so labels are worked on in
salted parts, and the parts' sums are added up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.functions.normalize import family, short_context
from dapple.operators.tables import counted
from dapple.runtime import written

REPLICATES = 1000
LABEL_SALTS, LABEL_BLOCK = 16, 2000
MOST_WEIGHTS = 100_000_000  # of 2 bytes each
PAIRS = (("CA-U", "CF"), ("CA-R", "CF"), ("CA-U", "CA-R"))
CONDITIONS = ("CF", "CA-R", "CA-U")


def role_weights(models: list[str], roles: list[str], replicates: int, seed: int) -> dict[tuple[str, str], np.ndarray]:
    """Multiplicities of roles (rows) by replicate, for each model and context: column 0 is 1 (the point), the others are draws with
    replacement, made model by model, context by context, replicate by replicate from one generator."""
    rng, out, n = np.random.default_rng(seed), {}, len(roles)
    for model in models:
        for context in CONDITIONS:
            drawn = np.stack([np.bincount(rng.integers(0, n, size=n), minlength=n) for _ in range(replicates)]) if replicates else np.zeros((0, n), int)
            out[(model, context)] = np.vstack([np.ones((1, n), int), drawn]).T.astype(np.uint16)
    return out


def trajectories(dense: DataFrame, group: Column | str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """``model``, ``context_short``, ``dimension_family``, ``dimension``, ``replicate`` (0 is the point), ``bi``. Labels without weight
    in a replicate are no classes of it. A label that two cohorts of a dimension have counts once, in the first by name.
    Models and roles come to the driver, for the draws; more than MOST_WEIGHTS weights are refused."""
    rows = counted(dense).where((F.col("prompt_group") == group) & (F.col("count") > 0)).withColumn("context_short", short_context(F.col("context"))).where(F.col("context_short").isin(*CONDITIONS))
    rows = rows.groupBy("model", "context_short", "cohort", "dimension", "occupation", "label").agg(F.sum("count").alias("c"))
    rows = rows.groupBy("model", "context_short", "dimension", "occupation", "label").agg(F.min_by("c", "cohort").alias("c"), F.min("cohort").alias("cohort"))
    rows = written(rows, "role-counts")
    models = [r[0] for r in rows.select("model").distinct().orderBy("model").collect()]
    roles = [r[0] for r in rows.select("occupation").distinct().orderBy("occupation").collect()]
    if len(models) * len(CONDITIONS) * len(roles) * (replicates + 1) > MOST_WEIGHTS:
        raise ValueError(f"{len(models)} models, {len(roles)} roles and {replicates} replicates make more than {MOST_WEIGHTS} weights")
    weights = role_weights(models, roles, replicates, seed)
    at = {role: i for i, role in enumerate(roles)}
    shared = dense.sparkSession.sparkContext.broadcast(weights)  # at most MOST_WEIGHTS

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        """The parts of the concentration that add up over labels, for every replicate."""
        w = shared.value[(pdf["model"].iloc[0], pdf["context_short"].iloc[0])].astype(float)
        label, names = pd.factorize(pdf["label"])
        role, count = pdf["occupation"].map(at).to_numpy(), pdf["c"].to_numpy(float)
        s, xlogx, n = np.zeros(w.shape[1]), np.zeros(w.shape[1]), np.zeros(w.shape[1], np.int64)
        for start in range(0, len(names), LABEL_BLOCK):
            part = (label >= start) & (label < start + LABEL_BLOCK)
            counts = np.zeros((min(LABEL_BLOCK, len(names) - start), len(at)))
            np.add.at(counts, (label[part] - start, role[part]), count[part])
            x = counts @ w
            s += x.sum(axis=0)
            xlogx += (x * np.log(np.where(x > 0, x, 1))).sum(axis=0)
            n += (x > 0).sum(axis=0)
        head = pdf[["model", "context_short", "dimension"]].head(1).reset_index(drop=True)
        return head.assign(cohort=pdf["cohort"].min(), s=[s], xlogx=[xlogx], n=[n])

    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("label"), F.lit(LABEL_SALTS)))
    parts = salted.groupBy("model", "context_short", "dimension", "_salt").applyInPandas(sums, "model string, context_short string, dimension string, cohort string, s array<double>, xlogx array<double>, n array<bigint>")
    cells = parts.select("model", "context_short", "cohort", "dimension", F.posexplode(F.arrays_zip("s", "xlogx", "n")).alias("replicate", "z"))
    g = cells.groupBy("model", "context_short", "dimension", "replicate").agg(F.min("cohort").alias("cohort"), *[F.sum(f"z.{c}").alias(c) for c in ("s", "xlogx", "n")]).where("s > 0")
    bi = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(1 + (F.col("xlogx") / F.col("s") - F.ln("s")) / F.ln(F.col("n").cast("double")))
    return g.select("model", "context_short", "cohort", "dimension", "replicate", bi.alias("bi"), family(F.col("cohort")).alias("dimension_family"))


def over_models(rows: DataFrame, key: str) -> DataFrame:
    """Means over models, replicate by replicate, of keys that every model has."""
    models = rows.agg(F.countDistinct("model")).scalar()
    g = rows.groupBy("context_short", key, "replicate").agg(F.avg("bi").alias("bi"))
    whole = rows.groupBy("context_short", key).agg(F.countDistinct("model").alias("_m")).where(F.col("_m") == models).drop("_m")
    return g.join(whole, ["context_short", key])


def family_means(rows: DataFrame) -> DataFrame:
    """Means of dimensions by family and model, then over models."""
    by_model = rows.groupBy("model", "context_short", "dimension_family", "replicate").agg(F.avg("bi").alias("bi"))
    return over_models(by_model, "dimension_family")


def _differences(rows: DataFrame, pairs: tuple) -> DataFrame:
    names = F.explode(F.array(*[F.struct(F.lit(a).alias("hi"), F.lit(b).alias("lo")) for a, b in pairs])).alias("pair")
    hi = rows.select("dimension_family", "replicate", F.col("context_short").alias("hi"), F.col("bi").alias("a"))
    lo = rows.select("dimension_family", "replicate", F.col("context_short").alias("lo"), F.col("bi").alias("b"))
    both = rows.select("dimension_family", "replicate").distinct().select("*", names).select("dimension_family", "replicate", "pair.hi", "pair.lo").join(hi, ["dimension_family", "replicate", "hi"]).join(lo, ["dimension_family", "replicate", "lo"])
    return both.select("dimension_family", F.concat_ws(" - ", "hi", "lo").alias("comparison"), "replicate", (F.col("a") - F.col("b")).alias("d"))


def points(rows: DataFrame, pairs: tuple = PAIRS) -> DataFrame:
    """``point_estimate`` of the differences between contexts by family, without replicates."""
    return _differences(rows, pairs).where("replicate = 0").select("dimension_family", "comparison", F.col("d").alias("point_estimate"))


def differences(rows: DataFrame, pairs: tuple = PAIRS, ci: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Differences between contexts by family: the point, the mean over replicates and their percentile interval."""
    boot = F.when(F.col("replicate") > 0, F.col("d"))
    g = _differences(rows, pairs).groupBy("dimension_family", "comparison").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("d"))).alias("point_estimate"), F.avg(boot).alias("bootstrap_mean"),
        F.percentile(boot, F.lit(ci[0])).alias("ci_low"), F.percentile(boot, F.lit(ci[1])).alias("ci_high"), F.count(boot).alias("n_replicates"),
    )
    return g.where("n_replicates > 0")


def headline(rows: DataFrame) -> DataFrame:
    """CA-U less CF of the equal-weight mean over families."""
    mean = rows.groupBy("context_short", "replicate").agg(F.avg("bi").alias("bi")).withColumn("dimension_family", F.lit("All"))
    return differences(mean, (PAIRS[0],))
