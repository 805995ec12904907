import random
import re
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dapple.llm import packing
from dapple.llm.packing import Windows, container_fill, pack_items
from dapple.llm.tokens import token_count

SCHEMA = "doc_id bigint, n bigint, id string, tokens string"


def check(rows, got, capacity):
    sizes, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        if r.container is not None:
            sizes[r.container] += r.tokens
        pieces[r.doc_id].append(r)
    assert all(0 < s <= capacity for s in sizes.values())
    for doc, n, *_ in rows:
        own = sorted(pieces[doc], key=lambda r: r.piece_no)
        want = max(1, -(-(n or 0) // capacity))
        assert [r.piece_no for r in own] == list(range(1, want + 1)) and sum(r.tokens for r in own) == (n or 0)
        assert all(r.pieces == want for r in own)
        assert n or own[0].container is None
    return sizes


@pytest.mark.parametrize("rounds", [100_000, 10])
def test_packs_all_within_capacity(spark, monkeypatch, rounds):
    monkeypatch.setattr(packing, "ROUND_ROWS", rounds)
    rng = random.Random(5)
    rows = [(i, rng.choice([0, None, rng.randrange(1, 40), rng.randrange(40, 400)]), "clash", "clash") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    packed = pack_items(df, "doc_id", F.col("n"), 100, open_windows=4)
    sizes = check(rows, packed.collect(), 100)
    fill = container_fill(packed, 100).first()
    assert fill.containers == len(sizes) and fill.tokens == sum(n or 0 for _, n, *_ in rows)
    assert fill.fill > 0.9
    bound = packing.tightness(packed, 100, 0.1).first()
    assert bound.least == -(-sum(n or 0 for _, n, *_ in rows) // 100) <= fill.containers and bound.whole and bound.tight


def test_empty_and_bad_arguments(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pack_items(df, "doc_id", F.col("n"), 10).collect() == []
    assert container_fill(pack_items(df, "doc_id", F.col("n"), 10), 10).first().containers == 0
    with pytest.raises(ValueError):
        pack_items(df, "doc_id", F.col("n"), 0)


@given(st.lists(st.integers(1, 20), max_size=200), st.integers(1, 5))
def test_windows(items, most):
    w, fill, open_now = Windows(20, most), defaultdict(int), set()
    for i, size in enumerate(items):
        at = w.place(size, i)
        fill[at] += size
        open_now.add(at)
        assert w.open <= most and fill[at] <= 20
    assert all(fill[name] == f for name, f in w.left())


def test_token_count(spark):
    texts = ["", None, "a b", "don't stop!!", "x_1 — ½ äé z", "日本語 テスト", "a b\x1cc", "...---", "é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t")).alias("n"))
    assert [r.n for r in got.collect()] == [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts]
