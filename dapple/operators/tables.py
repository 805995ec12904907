"""Tables derived from the dense fact: tests by occupation and over contexts, label persistence, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.functions.normalize import activity_family, family, family_of_cohort, lookup, prevalence_cell, robustness_cell, short_context
from dapple.functions.stats import ALPHA, chi2_sf, concentration, half_even, medians, safe_div, three_arms, with_bh
from dapple.operators.dense import POOLED
from dapple.runtime import written

#: Short names of models, and the contexts' columns.
MODEL_KEYS = {"SDXL": "XL", "3.5": "M35", "Flux": "Flx", "Qwen": "Qwen"}
PRETTY = {"M35": "3.5", "Flx": "Flux"}
TABLE3_MODELS = ["XL", "M35", "Flx", "Qwen"]
ARMS = (("CF", "CF"), ("CA-U", "CA_Unrel"), ("CA-R", "CA_Rel"))
TABLE2_FAMILIES = ("People", "Objects", "Camera")  # the family of scenes takes no part in table 2
#: The order of table 2.
MODEL_LEVELS = ("XL", "3.5", "Flux", "Qwen", "Total")
FAMILY_LEVELS = ("People", "Objects", "Camera", "Sence", "All")
MIN_LABEL_COUNT, MAX_RANGE = 5, 5


def counted(dense: DataFrame) -> DataFrame:
    return dense.where(~F.col("cohort").isin("totals", "safety") & F.col("prompt_group").isNotNull())


def model_key(model: Column) -> Column:
    return lookup(MODEL_KEYS, F.element_at(F.split(model, "_"), -1), model)


def tail(df: DataFrame, x: str, dof: str, to: str = "p_value", default: float | None = None) -> DataFrame:
    """``df`` with the chi-square tail of ``x``; ``default`` (or null) where there are no degrees of freedom."""
    p = chi2_sf(F.col(x), F.col(dof))
    return df.withColumn(to, p if default is None else F.coalesce(p, F.lit(default)))


def preferred_group(dense: DataFrame) -> Column:
    """ALL_TYPES if the fact has it, otherwise its least prompt group, as a scalar subquery."""
    return dense.agg(F.coalesce(F.max(F.when(F.col("prompt_group") == POOLED, F.lit(POOLED))), F.min("prompt_group"))).scalar()


def bias_by_occupation(dense: DataFrame) -> DataFrame:
    """Leave-one-out chi-square of each occupation, with p adjusted within model and prompt group."""
    g = counted(dense).groupBy("model", "prompt_group", "dimension", "cohort", "context", "occupation").agg(F.coalesce(F.sum("chi_occ"), F.lit(0.0)).alias("chi_value"), F.max("df").alias("df"))
    return with_bh(tail(g, "chi_value", "df"), "p_value", ["model", "prompt_group"])


def with_arms_test(rows: DataFrame) -> DataFrame:
    test = three_arms([(F.col(f"x_{a}"), F.col(f"n_{a}")) for _, a in ARMS])
    rows = rows.withColumns(test)
    return rows.withColumn("p_value", F.when(F.col("_usable"), F.coalesce(chi2_sf(F.col("chisq_stat"), F.col("df")), F.lit(1.0))).otherwise(F.lit(1.0))).drop("_usable")


def with_shares(rows: DataFrame) -> DataFrame:
    total = lambda c: sum((F.col(f"{c}_{a}") for _, a in ARMS[1:]), F.col(f"{c}_{ARMS[0][1]}"))
    rows = rows.withColumns({"x_all": total("x"), "n_all": total("n")})
    return rows.withColumns({f"pct_{a}": 100 * safe_div(F.col(f"x_{a}"), F.col(f"n_{a}")) for a in [*[a for _, a in ARMS], "all"]})


def occupation_table(dense: DataFrame) -> DataFrame:
    """Labels by occupation over the three contexts: counts, denominators, shares and their homogeneity, by model (with
    adjusted p) and for all models together (``ALL``, without). Contexts with other names are left out."""
    d = counted(dense).withColumn("arm", short_context(F.col("context"))).where(F.col("arm").isin(*[c for c, _ in ARMS]))
    key = ["model", "dimension", "cohort", "prompt_group", "occupation", "label"]
    sums = {f"x_{a}": F.coalesce(F.sum(F.when(F.col("arm") == c, F.col("count"))), F.lit(0)) for c, a in ARMS}
    tops = {f"n_{a}": F.coalesce(F.max(F.when(F.col("arm") == c, F.col("n_occ"))), F.lit(0)) for c, a in ARMS}
    one = d.groupBy(*key).agg(*[e.alias(n) for n, e in {**sums, **tops}.items()])
    every = one.groupBy(*key[1:]).agg(*[F.sum(c).alias(c) for c in [*sums, *tops]]).withColumn("model", F.lit("ALL"))
    tested = with_bh(with_arms_test(with_shares(one)), "p_value", ["model", "prompt_group"])
    pooled = with_arms_test(with_shares(every)).withColumn("p_adj", F.lit(None).cast("double"))
    return pooled.unionByName(tested)


def occupation_wide(table: DataFrame, keys: list[str], values: tuple[str, ...] = ("pct_all", "chisq_stat", "p_value", "p_adj")) -> DataFrame:
    """One row a label with ``<key>_<value>`` columns; ``keys`` are the model keys, named so that no extra job finds them."""
    rows = table.withColumn("k", F.when(F.col("model") == "ALL", F.lit("ALL")).otherwise(model_key(F.col("model"))))
    cells = [F.max(F.when(F.col("k") == k, F.col(v))).alias(f"{k}_{v}") for k in keys for v in values]
    return rows.groupBy("dimension", "cohort", "prompt_group", "occupation", "label").agg(*cells)


def persistence(dense: DataFrame, key: list[str], context: str) -> DataFrame:
    """Over the contexts of each key: count, denominator, chi-square, ``df_loo`` (contexts with a part, less 1), p (1 without df), invariance."""
    g = dense.groupBy(*key).agg(
        F.sum("count").alias("label_n"), F.sum("n_occ").alias("total_n"), F.coalesce(F.sum("chi_occ"), F.lit(0.0)).alias("chi_sq_loo"),
        F.countDistinct(F.when(F.col("chi_occ").isNotNull(), F.col(context))).alias("n_contexts"),
    )
    g = g.withColumns({"pct": 100 * safe_div(F.col("label_n"), F.col("total_n")), "df_loo": F.greatest(F.col("n_contexts") - 1, F.lit(0))})
    return tail(g, "chi_sq_loo", "df_loo", "p_value_loo", 1.0).withColumn("invariant", F.col("p_value_loo") > ALPHA)


def label_persistence(dense: DataFrame) -> DataFrame:
    d = counted(dense).withColumns({"model_key": model_key(F.col("model")), "dimension_family": family(F.col("dimension")), "activity_family": activity_family(F.col("prompt_group"))})
    return persistence(d, ["model", "model_key", "prompt_group", "activity_family", "dimension", "dimension_family", "cohort", "occupation", "label"], "context")


def table2_source(dense: DataFrame) -> DataFrame:
    """Persistence of labels without type (context CF) and with one (CA-R, CA-U); pooled groups only if there are no others."""
    d = counted(dense).withColumn("arm", short_context(F.col("context"))).where(F.col("arm").isin("CF", "CA-R", "CA-U"))
    key = model_key(F.col("model"))
    d = d.withColumns({
        "prompt_type_category": F.when(F.col("arm") == "CF", "No type").otherwise("Other type"), "dimension_family": family_of_cohort(F.col("cohort")),
        "model_key": key, "model_pretty": lookup(PRETTY, key),
    }).where(F.col("dimension_family").isin(*TABLE2_FAMILIES))
    others = d.agg(F.coalesce(F.max((F.col("prompt_group") != POOLED).cast("int")), F.lit(0))).scalar()
    d = d.where((F.col("prompt_group") != POOLED) | (others == 0))
    return persistence(d, ["model_pretty", "model_key", "prompt_type_category", "dimension", "dimension_family", "cohort", "occupation", "label"], "arm")


def table2(source: DataFrame) -> DataFrame:
    """Both halves of table 2 as a cube over model and family (``Total``, ``All``), metrics of the other half null."""
    source = written(source, "table2-source")
    keys = ["model_pretty", "dimension_family"]

    def half(category: str, metric: str, value: str, median: str, **metrics: Column) -> DataFrame:
        rows = source.where(F.col("prompt_type_category") == category)
        cells = rows.cube(*keys).agg(F.count(F.lit(1)).alias("n_labels_tested"), F.grouping_id().alias("_set"), *[e.alias(n) for n, e in metrics.items()])
        middle = medians(rows, value, [keys, keys[:1], keys[1:], []], to=median)  # sets by their number as grouping_id has it
        on = F.col("l._set") == F.col("r._set")
        for k in keys:
            on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        cells = cells.alias("l").join(middle.alias("r"), on, "left").select("l.*", f"r.{median}")
        return cells.select(
            F.lit(category).alias("prompt_type_category"), F.lit(metric).alias("table_metric"), F.coalesce("model_pretty", F.lit("Total")).alias("model"),
            F.coalesce("dimension_family", F.lit("All")).alias("dimension_family"), "n_labels_tested", *metrics, median,
        )

    bare = half("No type", "mean baseline prevalence", "pct", "median_pct", mean_pct=F.avg("pct"))
    typed = half("Other type", "% invariant / mean p-value", "p_value_loo", "median_p", pct_invariant=100 * F.avg(F.col("invariant").cast("int")), mean_p=F.avg("p_value_loo"))
    return bare.unionByName(typed, allowMissingColumns=True)


def ordinal(x: Column, levels: tuple[str, ...]) -> Column:
    """The place of a value among levels, from 1; null for others, which sort last."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), x)
    return F.when(place > 0, place)


def sorted_table2(table: DataFrame) -> DataFrame:
    """Table 2 with its cells' texts and ``pos``, the place in the order of models and families of each half."""
    order = [F.asc_nulls_last(ordinal(F.col("model"), MODEL_LEVELS)), F.asc_nulls_last(ordinal(F.col("dimension_family"), FAMILY_LEVELS))]
    cell = F.when(F.col("prompt_type_category") == "No type", prevalence_cell(F.col("mean_pct"))).otherwise(robustness_cell(F.col("pct_invariant"), F.col("mean_p")))
    pos = F.row_number().over(Window.partitionBy("prompt_type_category").orderBy(*order))
    return table.select("prompt_type_category", "model", "dimension_family", "n_labels_tested", cell.alias("cell"), pos.alias("pos"))


def table3_base(persistent: DataFrame, group: Column | str) -> DataFrame:
    rows = persistent.where((F.col("prompt_group") == group) & F.col("model_key").isin(*TABLE3_MODELS))
    g = rows.groupBy("model_key", "occupation", "label").agg(*[F.sum(c).alias(c) for c in ("label_n", "total_n", "chi_sq_loo", "df_loo")])
    return tail(g.withColumn("pct", 100 * safe_div(F.col("label_n"), F.col("total_n"))), "chi_sq_loo", "df_loo", "p_value_loo", 1.0)


def table3(base: DataFrame, rows: int = 100_000) -> DataFrame:
    """Labels that all four models have, with a column a model for each figure: the first ``rows`` by mean and least share and mean p."""
    cells = [F.max(F.when(F.col("model_key") == m, e)).alias(f"{m}_{n}") for m in TABLE3_MODELS for n, e in (("pct", half_even(F.col("pct"), 0)), ("chi2", half_even(F.col("chi_sq_loo"), 2)), ("p", F.col("p_value_loo")))]
    g = base.groupBy("occupation", "label").agg(F.countDistinct("model_key").alias("n_models"), F.avg("pct").alias("mean_pct"), F.min("pct").alias("min_pct"), F.avg("p_value_loo").alias("mean_p"), F.max("chi_sq_loo").alias("max_chi"), *cells)
    order = [F.desc_nulls_last("mean_pct"), F.desc_nulls_last("min_pct"), F.asc_nulls_last("mean_p"), "occupation", "label"]
    return g.where(F.col("n_models") == len(TABLE3_MODELS)).orderBy(*order).limit(rows)


def context_consistency(table: DataFrame, group: Column | str) -> DataFrame:
    """By model, occupation and label: shares by context, their range, the test and how consistent the label is."""
    rows = table.where((F.col("model") != "ALL") & (F.col("prompt_group") == group)).withColumn("model_key", model_key(F.col("model"))).where(F.col("model_key").isin(*TABLE3_MODELS))
    g = rows.groupBy("model_key", "occupation", "label").agg(*[F.sum(f"{v}_{a}").alias(f"{v}_{a}") for v in "xn" for _, a in ARMS])
    g = with_arms_test(with_shares(g))
    shares = [F.col(f"pct_{a}") for _, a in ARMS]
    present = (F.col("x_CF") > 0) & (F.col("x_CA_Unrel") > 0) & (F.col("x_CA_Rel") > 0)
    enough = F.col("x_all") >= MIN_LABEL_COUNT
    g = g.withColumn("pct_range", F.greatest(*shares) - F.least(*shares)).withColumns({"present_all": present, "enough": enough})
    consistent = enough & F.coalesce((F.col("p_value") > ALPHA) & (F.col("pct_range") <= MAX_RANGE), F.lit(False))
    g = g.withColumn("consistent", consistent)
    named = F.when(F.col("consistent") & present, "Consistent and present in all 3 contexts").when(F.col("consistent"), "Consistent proportions but not present in all 3 contexts").otherwise("Context-sensitive / inconsistent")
    return g.withColumns({"consistency_label": named, "consistency_score": F.when(present & enough, F.col("pct_all") / (1 + F.col("pct_range")))})


def consistency_summary(rows: DataFrame) -> DataFrame:
    rows = written(rows, "consistency")
    g = rows.groupBy("model_key").agg(F.count(F.lit(1)).alias("n_labels_tested"), F.count_if("consistent").alias("n_consistent"), F.avg("pct_range").alias("mean_pct_range"))
    g = g.join(medians(rows, "pct_range", [["model_key"]], to="median_pct_range").drop("_set"), "model_key", "left")
    return g.withColumn("pct_consistent", 100 * safe_div(F.col("n_consistent"), F.col("n_labels_tested")))


def consistency_rank(rows: DataFrame, most: int = 20_000) -> DataFrame:
    g = rows.groupBy("occupation", "label").agg(
        F.countDistinct("model_key").alias("n_models"), F.avg("pct_all").alias("mean_pct"), F.min("pct_all").alias("min_pct"), F.avg("pct_range").alias("mean_range"), F.max("pct_range").alias("max_range"),
        F.avg("p_value").alias("mean_p"), F.min("p_value").alias("min_p"), F.count_if("consistent").alias("n_consistent_models"), F.bool_and("consistent").alias("all_models_consistent"), F.avg("consistency_score").alias("mean_consistency_score"),
    )
    order = [F.desc("all_models_consistent"), F.desc("n_consistent_models"), F.asc_nulls_last("mean_range"), F.asc_nulls_last("max_range"), F.desc_nulls_last("mean_pct"), F.desc_nulls_last("min_pct"), F.desc_nulls_last("mean_p"), "occupation", "label"]
    return g.where(F.col("n_models") == len(TABLE3_MODELS)).orderBy(*order).limit(most)


def intensity_by_context(dense: DataFrame, group: Column | str) -> DataFrame:
    """Mean concentration over dimensions by model, context and family: of the distinct context shares of labels, zeros included."""
    rows = counted(dense).where(F.col("prompt_group") == group).select("model", short_context(F.col("context")).alias("context_short"), family(F.col("cohort")).alias("dimension_family"), "dimension", "cohort", "label", "prop_context").distinct()
    g = rows.groupBy("model", "context_short", "dimension_family", "dimension", "cohort").agg(concentration("prop_context").alias("i"))
    return g.groupBy("model", "context_short", "dimension_family").agg(F.avg("i").alias("mean_intensity"))


def intensity_by_dimension(dense: DataFrame, group: Column | str) -> DataFrame:
    g = counted(dense).where(F.col("prompt_group") == group).groupBy("model", "dimension", "cohort", "label").agg(F.sum("count").cast("double").alias("c"))
    g = g.groupBy("model", "dimension", "cohort").agg(concentration("c").alias("i"))
    return g.groupBy("model", "dimension").agg(F.avg("i").alias("avg_intensity"))
