from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dapple.llm import mixing
from dapple.llm.mixing import Mixture, edf

DOCS, TARGETS = "doc_id bigint, source string, n bigint, tokens bigint, place string", "source string, target_share double, max_passes int"


@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 40), min_size=1))
def test_deviation_is_below_one_block(blocks):
    total, got = sum(blocks.values()), Counter()
    slots = list(edf(blocks))
    assert len(slots) == total
    for t, (s, j) in enumerate(slots, 1):
        assert j == got[s]
        got[s] += 1
        for k, n in blocks.items():
            assert abs(got[k] - Fraction(n * t, total)) < 1
    assert got == Counter({k: n for k, n in blocks.items() if n})


def mix(spark, docs, targets, **kw):
    return Mixture(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(targets, TARGETS), "doc_id", "source", F.col("n"), min_block=50, **kw)


def test_shares_passes_and_reach(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    docs = [(i, "big", 10, 0, "") for i in range(300)] + [(1000 + i, "small", 10, 0, "") for i in range(40)] + [(2000 + i, "tiny", 10, 0, "") for i in range(4)] + [(3000, None, 10, 0, ""), (3001, "other", 10, 0, ""), (3002, "big", 0, 0, "")]
    m = mix(spark, docs, [("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 3), ("none", 0.0, 2)])
    rep = {r.source: r for r in m.report().collect()}
    assert m.budget == 3440
    assert (rep["small"].passes, rep["small"].reach, rep["tiny"].passes, rep["tiny"].reach) == (3, "met", 3, "short")
    assert (rep["none"].passes, rep["none"].tokens, rep["none"].reach) == (0, 0, "short")
    assert rep["tiny"].tokens == 120 and abs(rep["small"].tokens - 1032) <= 10 and abs(rep["big"].tokens - 1720) <= 10
    assert abs(sum(r.share for r in rep.values()) - 1) < 1e-9
    rows = m.placed().orderBy("slot", "start").collect()
    uses = Counter((r.id, r.pass_no) for r in rows)
    assert max(uses.values()) == 1 and {r.source for r in rows} == {"big", "small", "tiny"}
    total, got = sum(r.tokens for r in rows), Counter()
    want = {s: rep[s].tokens / total for s in rep}
    for r in rows:
        got[r.source] += r.tokens
        done = sum(got.values())
        assert all(abs(got[s] - want[s] * done) <= 3 * 50 for s in want)


def test_empty_and_repeated_names(spark):
    assert mix(spark, [], [("a", 1.0, 2)]).placed().collect() == []
    with pytest.raises(ValueError):
        mix(spark, [], [("a", 0.5, 2), ("a", 0.5, 2)])
