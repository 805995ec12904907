"""Statistics as column expressions. NULL is the missing value; NaN never comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.runtime import written

ALPHA = 0.05
Z95 = 1.96


def safe_div(num: Column, den: Column) -> Column:
    """num / den where den is above 0, otherwise null."""
    return F.when(den > 0, num / den)


def chi_part(observed: Column, expected: Column) -> Column:
    """(o - e)^2 / e; 0 where both are 0; null where only e is 0 or one is null."""
    return F.when(expected > 0, (observed - expected) * (observed - expected) / expected).when((expected == 0) & (observed == 0), F.lit(0.0))


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution; null where df is 0 or less or x is null.

    The call is a reflection and counts as non-deterministic: project it, then aggregate."""
    tail = F.java_method(F.lit("org.apache.commons.math3.special.Gamma"), F.lit("regularizedGammaQ"), F.coalesce(F.greatest(df.cast("double"), F.lit(1.0)), F.lit(1.0)) / 2, F.coalesce(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(0.0)) / 2)
    return F.when((df > 0) & x.isNotNull(), tail.cast("double"))


def three_arms(arms: list[tuple[Column, Column]]) -> dict[str, Column]:
    """Homogeneity of proportions x/n over arms: ``chisq_stat`` and ``df``. An arm counts if n > 0 and 0 <= x <= n; with fewer
    than two, or a pooled share of 0 or 1, the statistic is 0 (its p is 1, see :func:`arms_p`)."""
    kept = [((n > 0) & (x >= 0) & (x <= n), x.cast("double"), n.cast("double")) for x, n in arms]
    total = lambda f: sum((F.when(ok, f(x, n)).otherwise(F.lit(0.0)) for ok, x, n in kept), F.lit(0.0))
    k, p = total(lambda x, n: F.lit(1.0)), safe_div(total(lambda x, n: x), total(lambda x, n: n))
    stat = total(lambda x, n: (x - n * p) * (x - n * p) / (n * p * (1 - p)))
    usable = (k >= 2) & (p > 0) & (p < 1)
    return {"chisq_stat": F.when(usable, stat).otherwise(F.lit(0.0)), "df": F.greatest(k - 1, F.lit(0.0)).cast("int"), "_usable": F.coalesce(usable, F.lit(False))}


def with_bh(df: DataFrame, p: str, by: list[str], to: str = "p_adj", buckets: int = 1024) -> DataFrame:
    """``df`` with Benjamini-Hochberg adjusted p-values of column ``p`` within groups; null stays null and doesn't count.

    A p of 0 stays 0 and the highest, 1, stays 1, so the many rows that have these aren't joined.
    Equal p-values are adjusted alike, so the work is on distinct values, in buckets of their range: ranks come from
    the buckets' counts, the running minimum from the buckets' minima. A group of any size is spread over its buckets.
    ``df`` is written once, as several steps read it and its p-values may come from a reflection call."""
    df = written(df, "p-values")
    known = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    known = known.withColumn("_b", F.least(F.floor(F.col("_p") * buckets), F.lit(buckets - 1)))
    inner, outer = Window.partitionBy(*by, "_b"), Window.partitionBy(*by)
    upto = lambda w, c: w.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = known.groupBy(*by, "_b").agg(F.sum("_c").alias("_s"))
    before = counts.select(*by, "_b", (F.sum("_s").over(upto(outer, "_b")) - F.col("_s")).alias("_o"), F.sum("_s").over(outer).alias("_n"))
    ranked = known.join(before, [*by, "_b"]).withColumn("_raw", F.col("_n") / (F.col("_o") + F.sum("_c").over(upto(inner, "_p"))) * F.col("_p"))
    least = ranked.groupBy(*by, "_b").agg(F.min("_raw").alias("_m"))
    above = least.select(*by, "_b", F.min("_m").over(outer.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))
    best = F.min("_raw").over(upto(inner, F.desc("_p")))
    adjusted = ranked.withColumn("_best", best).join(above, [*by, "_b"]).select(*by, "_p", F.least(F.lit(1.0), "_best", "_above").alias(to))
    same = F.col(f"l.{p}") == F.col("r._p")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    ends = F.col(p).isNull() | (F.col(p) <= 0) | (F.col(p) >= 1)
    inner_rows = df.where(~ends).alias("l").join(adjusted.alias("r"), same, "left").select("l.*", f"r.{to}")
    return inner_rows.unionByName(df.where(ends).withColumn(to, F.when(F.col(p) <= 0, F.lit(0.0)).when(F.col(p) >= 1, F.lit(1.0))))


def medians(df: DataFrame, value: str, sets: list[list[str]], scale: float = 1000.0, to: str = "median") -> DataFrame:
    """Exact medians of ``value`` (finite, null left out) for grouping sets of columns, which are null where a set hasn't got them, with
    ``_set``, the set's number.

    Values are counted, and their counts added up in buckets of 1 / ``scale``: only the one or two buckets that hold a group's
    middle are looked at value by value, so no group is sorted in one task."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    finest = written(df.where(F.col(value).isNotNull()).groupBy(*names, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "values")
    parts = [finest.groupBy(*s, "_v").agg(F.sum("_c").alias("_c")).select(F.lit(i).alias("_set"), *[(F.col(n) if n in s else F.lit(None).cast(dict(df.dtypes)[n])).alias(n) for n in names], "_v", "_c") for i, s in enumerate(sets)]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    counts = written(counts.withColumn("_b", F.floor(F.col("_v") * scale)), "value-counts")
    key = ["_set", *names]
    w = Window.partitionBy(*key)
    upto = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = counts.groupBy(*key, "_b").agg(F.sum("_c").alias("_s")).withColumns({"_before": F.sum("_s").over(upto) - F.col("_s"), "_n": F.sum("_s").over(w)})
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = buckets.where((F.col("_before") <= high) & (F.col("_before") + F.col("_s") > low))
    on = F.col("l._b") == F.col("r._b")
    for c in key:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    near = counts.alias("l").join(middle.alias("r"), on).select("l.*", "r._before", "r._n")
    inner = Window.partitionBy(*key, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_end", F.col("_before") + F.sum("_c").over(inner)).withColumn("_start", F.col("_end") - F.col("_c"))
    at = lambda k: F.max(F.when((F.col("_start") <= k) & (F.col("_end") > k), F.col("_v")))
    return near.groupBy(*key).agg(((at(low) + at(high)) / 2).alias(to))


def concentration(x: str | Column) -> Column:
    """1 - normalised entropy of the values of a group, an aggregate in one pass: 0 spread evenly, 1 in one value.

    Null values are left out, zeros count as classes. No positive sum gives null, a single class 0."""
    x = F.col(x) if isinstance(x, str) else x
    n, total = F.count(x), F.sum(x)
    xlogx = F.sum(F.when(x > 0, x * F.ln(x)).when(x.isNotNull(), F.lit(0.0)))
    return F.when(total > 0, F.when(n <= 1, F.lit(0.0)).otherwise(1 + (xlogx / total - F.ln(total)) / F.ln(n.cast("double"))))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k of n; (0, 0) where n is 0 or less."""
    p, zz = k / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    low = F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / (1 + zz / n))).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), (mid + half) / (1 + zz / n))).otherwise(F.lit(0.0))
    return low, high


def half_even(x: Column, digits: int) -> Column:
    """Round the binary value half to even, as numpy does."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale
