"""Exact copies under a key: one kept row a key, and the links from kept rows to their copies.

A key may hold a third of all rows. Kept rows come from an aggregate that combines before its shuffle; the rows of
such keys are then spread over salts for the join that links them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.runtime import written

HOT_KEYS = 1000
SALTS = 64


def kept_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: ``kept`` (struct of the least ``order`` columns) and ``copies``. Null keys are equal."""
    return rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("kept"), F.count(F.lit(1)).alias("copies"))


def link_copies(rows: DataFrame, key: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """For every row that isn't the first of its key by ``order``: its ``order`` (and ``keep``) columns and ``kept``.

    ``rows`` must be cheap to read twice (written or cut). Keys may not be null. A key with more than 1/HOT_KEYS of
    all rows is hot; there are fewer than HOT_KEYS of them, so their list is broadcast. An empty table gives no rows.
    """
    n = rows.count()
    limit = max(n // HOT_KEYS, 10_000)
    groups = written(kept_rows(rows, key, order).where(F.col("copies") > 1), "copied-keys")
    hot = groups.where(F.col("copies") > limit).select(*key, F.lit(True).alias("_hot"))
    spread: Column = F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0)))
    right = groups.withColumn("_salt", F.explode(F.when(F.col("copies") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).select(*key, "_salt", "kept")
    return left.join(right, [*key, "_salt"]).where(F.struct(*order) != F.col("kept")).select(*order, *(keep or []), "kept")
