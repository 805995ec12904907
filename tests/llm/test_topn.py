import random

import pytest
from pyspark.sql import functions as F

from dapple.llm.topn import top_n_per_group

SCHEMA = "id bigint, g string, h int, score bigint, label string, extra string, _k1 string"


def brute(rows, n):
    best = {}
    for r in rows:
        best.setdefault((r[1], r[2]), []).append(r)
    out = set()
    for key, rs in best.items():
        once = {}
        for r in sorted(rs, key=lambda r: r[0]):
            once.setdefault(r[1:6], r)
        for r in sorted(once.values(), key=lambda r: (-r[3], r[4], r[0]))[:n]:
            out.add((*key, r[0]))
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, batch, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([1, 2, None]), rng.randrange(4), rng.choice("xyz"), rng.choice(["p", None]), "clash") for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        order = [F.col("score").desc(), F.col("label").asc(), F.col("id").asc()]
        got = top_n_per_group(df, ["g", "h"], order, ["score", "label", "id"], 4, ["g", "h", "score", "label", "extra"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({(r.g, r.h, r.id) for r in got})
    assert {(r.g, r.h, r.id) for r in got} == brute(rows, 4)


def test_without_distinct_and_empty(spark):
    df = spark.createDataFrame([(i, "a", 1, 5, "x", None, None) for i in range(10)], SCHEMA)
    order = [F.col("score").desc(), F.col("id").asc()]
    assert sorted(r.id for r in top_n_per_group(df, ["g"], order, ["score", "id"], 3).collect()) == [0, 1, 2]
    assert top_n_per_group(df.limit(0), ["g"], order, ["score", "id"], 3).collect() == []
    with pytest.raises(ValueError):
        top_n_per_group(df, ["g"], order, ["score", "id"], 0)
