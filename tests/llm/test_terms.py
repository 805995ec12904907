import random
import re
from collections import Counter

import pytest

from dapple.llm.terms import marked_terms, term_frequencies

SCHEMA = "row_id bigint, label string, count bigint, term string, record string"


def brute(rows, record=None):
    records, total = {}, Counter()
    for r in rows:
        for t in re.findall(r"[^\W_]+", (r[1] or "").lower()):
            records.setdefault(t, set()).add(r[0] if record is None else r[record])
            total[t] += r[2] or 0
    return {(t, len(s), total[t]) for t, s in records.items()}


@pytest.mark.parametrize("batch", [4, 10_000])
def test_matches_brute_force(spark, batch):
    rng = random.Random(3)
    words = ["Red", "red", "ÉTÉ", "été", "x1", "the the", "the", "", "--", "a_b"]
    rows = [(i, None if rng.random() < 0.1 else " ".join(rng.choices(words, k=3)), rng.choice([None, 0, 2, 5]), "clash", rng.choice(["r1", "r2", "r3"])) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        assert {tuple(r) for r in term_frequencies(df, "label", "count").collect()} == brute(rows)
        assert {tuple(r) for r in term_frequencies(df, "label", "count", record="record").collect()} == brute(rows, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_marks_and_empty(spark):
    rows = [(i, "common word" if i < 50 else "rare", 20, None, None) for i in range(52)]
    rows += [(99, "many rows few counts", 1, None, None)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    marks = {r.term: r.mark for r in marked_terms(df, "label", "count", common_share=0.5).collect()}
    assert marks["common"] == "common" and marks["rare"] == "rare" and marks["few"] == "rare"
    assert marked_terms(df.limit(0), "label").collect() == []


def test_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 200_000, 1, None, None)], SCHEMA)
    assert [tuple(r) for r in term_frequencies(df, "label", "count").collect()] == [("word", 1, 200_000)]


def test_partitions_and_repeated_runs_change_nothing(spark):
    """Long texts that are all different, in any number of partitions: the counts stay, run after run."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices([f"w{n}" for n in range(60)], k=300)) + f" only{i}", i % 7, None, f"r{i % 50}") for i in range(150)]
    want, of_records = brute(rows), brute(rows, 4)
    for parts in (1, 3, 16):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        for _ in range(2):
            assert {tuple(r) for r in term_frequencies(df, "label", "count").collect()} == want
            assert {tuple(r) for r in term_frequencies(df, "label", "count", record="record").collect()} == of_records


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a b", 1, None, None)], SCHEMA)
    plan = term_frequencies(df, "label", "count")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(term" in plan
