"""Prompts from roles, places and actions: candidates, filters, expansion and the plan of images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.runtime import written

#: The prompts' words, and the bounds of scores.
PHOTO, PLACE = "a photo of a ", " in a "
SEEDS, MOST_SEED = 20, 1_000_000
RELEVANCE, NEUTRALITY, CONFOUND = 4, 4, 2
BUCKETS = ("related", "unrelated")


def passes(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (s["relevance"] >= RELEVANCE) & (s["neutrality"] >= NEUTRALITY) & (s["confound"] <= CONFOUND)


def item_text(item: Column, action: Column, location: Column) -> Column:
    return F.coalesce(item, F.concat(action, F.lit(" in "), location))


def seeds(prompt: Column, n: int = SEEDS) -> Column:
    """Pseudo-random numbers from 1 to MOST_SEED that follow from the prompt."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.pmod(F.xxhash64(prompt, i), F.lit(MOST_SEED)) + 1).cast("int"))


def expand(bank: DataFrame) -> DataFrame:
    """Prompts of a bank (``role``, ``bucket``, ``pos``, ``action``, ``location``): for each bucket one of the role alone, one for each pair
    with its place, one for each with place and action, in this order; an empty bucket has none."""
    pairs = bank.where(F.col("bucket").isin(*BUCKETS) & F.col("location").isNotNull() & F.col("action").isNotNull())
    photo = F.concat(F.lit(PHOTO), F.col("role"))
    alone = pairs.select("role", "bucket").distinct().select("role", "bucket", F.lit(0).alias("template"), F.lit(0).alias("pos"), photo.alias("prompt"))
    place = pairs.select("role", "bucket", F.lit(1).alias("template"), "pos", F.concat(photo, F.lit(PLACE), "location").alias("prompt"))
    both = pairs.select("role", "bucket", F.lit(2).alias("template"), "pos", F.concat(photo, F.lit(" "), "action", F.lit(PLACE), "location").alias("prompt"))
    return alone.unionByName(place).unionByName(both)


def first_by_text(prompts: DataFrame) -> DataFrame:
    """One row for each prompt text, the first in the order of role, bucket, template and position."""
    return prompts.groupBy("prompt").agg(F.min(F.struct("role", "bucket", "template", "pos")).alias("f")).select("prompt", "f.*")


def image_plan(prompts: DataFrame, most: int | None = None) -> DataFrame:
    """The images over prompts and their seeds, in the order of prompt and seed number; the first ``most``, or all."""
    rows = prompts.select("prompt", F.posexplode(seeds(F.col("prompt"))).alias("seed_no", "seed"))
    ordered = rows.orderBy("prompt", "seed_no")
    return ordered if most is None else ordered.limit(most)


Client = Callable[[list[str]], list[dict]]
FALLBACK = {"relevance": 3, "neutrality": 3, "confound": 3}


def mock_client(texts: list[str]) -> list[dict]:
    return [{"relevance": 4, "neutrality": 4, "confound": 2} for _ in texts]


def length_client(texts: list[str]) -> list[dict]:
    """Scores that follow from the number of characters: for dry runs in which not everything passes."""
    return [{"relevance": 1 + len(t) % 5, "neutrality": 1 + len(t) % 7 % 5, "confound": len(t) % 4} for t in texts]


def scored(items: DataFrame, text: str, client: Client = mock_client) -> DataFrame:
    """``items`` with a ``score`` from a client, a batch of texts a call, and an ``error``: a call that fails, or gives no answer or fewer
    than asked for, scores 3 in everything and says why; null where the client answered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            error = None
            try:
                got = client(pdf[text].tolist())
                if not got or len(got) != len(pdf):
                    raise ValueError(f"{len(got or [])} answers to {len(pdf)} texts")
            except Exception as failed:  # noqa: BLE001
                got, error = [FALLBACK] * len(pdf), f"{type(failed).__name__}: {failed}"
            yield pdf.assign(relevance=[g["relevance"] for g in got], neutrality=[g["neutrality"] for g in got], confound=[g["confound"] for g in got], error=error)

    types = ", ".join(f"{c} {t}" for c, t in items.dtypes)
    rows = items.mapInPandas(run, f"{types}, relevance int, neutrality int, confound int, error string")
    return rows.select(*items.columns, F.struct("relevance", "neutrality", "confound").alias("score"), "error")


def retried(items: DataFrame, run: Callable[[DataFrame], DataFrame], passes: int = 3) -> DataFrame:
    """``run(items)``, whose rows with an ``error`` are run again, at most ``passes`` times in all; each pass is written once, so
    that no call is made twice. Rows that still fail keep the last error. ``pass_no`` tells the pass of each row."""
    done, todo = None, items
    for no in range(1, passes + 1):
        got = written(run(todo).withColumn("pass_no", F.lit(no)), "pass")
        last = no == passes or got.where("error IS NOT NULL").isEmpty()
        keep = got if last else got.where("error IS NULL")
        done = keep if done is None else done.unionByName(keep)
        if last:
            break
        todo = got.where("error IS NOT NULL").select(*items.columns)
    return done
