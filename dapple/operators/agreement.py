"""Agreement of raters: majority labels, Cohen's and Fleiss' kappa, for each file and over all."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dapple.functions.stats import safe_div

ITEM = ["stem", "cohort", "dimension"]


def majority_labels(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """The label with the highest count of each rater and item; of several the first by ``order``."""
    best = F.max_by("label", F.struct(F.col("count"), -F.col(order)))
    return rows.where("label IS NOT NULL AND count IS NOT NULL").groupBy("rater", *ITEM).agg(best.alias("label"))


def rater_pairs(labels: DataFrame) -> DataFrame:
    """Items that both of a pair of raters labelled: ``rater_a`` < ``rater_b``, ``a``, ``b``."""
    left = labels.select(*ITEM, F.col("rater").alias("rater_a"), F.col("label").alias("a"))
    right = labels.select(*ITEM, F.col("rater").alias("rater_b"), F.col("label").alias("b"))
    return left.join(right, ITEM).where("rater_a < rater_b")


def pair_scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``n``, ``raw_agreement``, ``macro_recall`` (over the classes of a) and ``kappa`` of each group. Chance agreement of 1 gives
    kappa 1 or 0."""
    same = F.avg((F.col("a") == F.col("b")).cast("int"))
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), same.alias("po"))
    recall = pairs.groupBy(*by, "a").agg(same.alias("r")).groupBy(*by).agg(F.avg("r").alias("macro_recall"))
    rows, cols = pairs.groupBy(*by, F.col("a").alias("c")).agg(F.count(F.lit(1)).alias("na")), pairs.groupBy(*by, F.col("b").alias("c")).agg(F.count(F.lit(1)).alias("nb"))
    chance = rows.join(cols, [*by, "c"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("s"))
    out = g.join(recall, by).join(chance, by, "left").withColumn("pe", F.coalesce(F.col("s") / (F.col("n") * F.col("n")), F.lit(0.0)))
    kappa = F.when(F.col("pe") >= 1, F.when(F.col("po") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return out.select(*by, "n", F.col("po").alias("raw_agreement"), "macro_recall", kappa.alias("kappa"))


def category_counts(labels: DataFrame, raters: int, item: list[str] = ITEM) -> DataFrame:
    """``item``, ``label``, ``n``: ratings by category, of items that all raters labelled."""
    full = Window.partitionBy(*item)
    return labels.groupBy(*item, "label").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.sum("n").over(full)).where(F.col("_all") == raters).drop("_all")


def fleiss(counts: DataFrame, raters: int, by: list[str], item: list[str] = ITEM) -> DataFrame:
    """``items`` and ``kappa`` of each group of items."""
    keys = list(dict.fromkeys([*by, *item]))
    per_item = counts.groupBy(*keys).agg(((F.sum(F.col("n") * F.col("n")) - raters) / (raters * (raters - 1))).alias("p"))
    bar = per_item.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.avg("p").alias("p_bar"))
    shares = counts.groupBy(*by, "label").agg(F.sum("n").alias("m")).groupBy(*by).agg((F.sum(F.col("m") * F.col("m")) / (F.sum("m") * F.sum("m"))).alias("p_e"))
    out = bar.join(shares, by) if by else bar.withColumn("_k", F.lit(1)).join(shares.withColumn("_k", F.lit(1)), "_k")
    kappa = F.when(F.col("p_e") >= 1, F.when(F.col("p_bar") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e")))
    return out.select(*by, "items", kappa.alias("kappa"))


def fleiss_interval(counts: DataFrame, raters: int, by: list[str], replicates: int = 1000, seed: int = 0, item: list[str] = ITEM) -> DataFrame:
    """Percentile interval of kappa over items drawn with replacement. An item's part in kappa depends only on its counts
    by label, so items with equal counts are drawn together: each group of files draws from its distinct patterns."""
    keys = list(dict.fromkeys([*by, *item]))
    pattern = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n"))))
    patterns = counts.groupBy(*keys).agg(F.to_json(pattern).alias("pattern")).groupBy(*by, "pattern").agg(F.count(F.lit(1)).alias("items"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pattern")
        parsed = [pd.Series(json.loads(p)) for p in pdf["pattern"]]
        table = pd.DataFrame(parsed).fillna(0).to_numpy(float)
        n = int(pdf["items"].sum())
        p = (np.square(table).sum(axis=1) - raters) / (raters * (raters - 1))
        times = np.random.default_rng(seed).multinomial(n, pdf["items"].to_numpy() / n, size=replicates)
        bar, share = times @ p / n, times @ table / (n * raters)
        chance = np.square(share).sum(axis=1)
        kappa = np.where(chance >= 1, (bar >= 1).astype(float), (bar - chance) / np.where(chance >= 1, 1, 1 - chance))
        out = pdf[by].head(1).reset_index(drop=True)
        out["ci_low"], out["ci_high"] = np.percentile(kappa, 2.5), np.percentile(kappa, 97.5)
        return out

    schema = ", ".join([*[f"{c} {dict(counts.dtypes)[c]}" for c in by], "ci_low double", "ci_high double"])
    return patterns.groupBy(*by).applyInPandas(draw, schema)


def matching_score(pairs: DataFrame) -> DataFrame:
    g = pairs.agg(F.count_if(F.col("a") == F.col("b")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("score", safe_div(F.col("hits"), F.col("n")))
