from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations, product
from math import log

import duckdb
import numpy as np
import pytest

from dapple.operators import pairs as P
from dapple.operators import similar as S
from dapple.plans.texts import QUERIES, SQL


def shuffled(spark, run):
    """What ``run`` gives, and the bytes it shuffled."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        every = sc.statusStore().executorList(False)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = written()
    return run(), written() - before


def vectors(texts):
    tf = {t: Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)) for t in texts}
    df = Counter(g for c in tf.values() for g in c)
    raw = {t: {g: f * (log((1 + len(texts)) / (1 + df[g])) + 1) for g, f in c.items()} for t, c in tf.items()}
    return {t: {g: w / sum(x * x for x in v.values()) ** 0.5 for g, w in v.items()} for t, v in raw.items()}


def brute(texts, threshold):
    v = vectors(texts)
    scores = {(a, b): sum(w * v[b].get(g, 0) for g, w in v[a].items()) for a, b in combinations(sorted(texts), 2)}
    return {k: s for k, s in scores.items() if s >= threshold}


ITEMS = [f"item {a} {b} plane {c} side {d}" for a, b, c, d in product(("oak", "tin", "slate", "amber", "rusty"), ("drum", "rail", "chart", "bench", "spool", "jug"), ("foreground", "midground"), ("left", "right", "center"))]


def test_standards_shuffle_no_candidates(spark):
    """labels that share most n-grams. The join of candidates with their vectors shuffled 602 kB for them."""
    df = spark.createDataFrame([(f, t) for f in ("f", "g") for t in ITEMS], "file string, label string")
    got, moved = shuffled(spark, lambda: S.standardise(df, ["file"], "label").collect())
    v, standard = brute(ITEMS, 0.6), {}
    near = lambda a, b: (v.get((min(a, b), max(a, b)), 0) + SequenceMatcher(None, min(a, b), max(a, b)).ratio()) / 2 >= 0.8
    for t in sorted(ITEMS):
        if t not in standard:
            standard.update({u: t for u in ITEMS if u == t or u not in standard and near(t, u)})
    assert {(r.file, r.label): r.standard for r in got} == {(f, t): standard[t] for f in ("f", "g") for t in ITEMS}
    assert moved < 300_000


def table(spark, tmp_path, dimensions):
    spark.createDataFrame([(d,) for d in dimensions], "dimension string").write.parquet(f"{tmp_path}/rollup_raw.parquet")
    return str(tmp_path)


def test_combined_pairs_shuffle_no_candidates(spark, tmp_path):
    """every pair by its definition, for a fraction of what the join of candidates shuffled."""
    got, moved = shuffled(spark, lambda: QUERIES["x14_x16_combined_pairs"](spark, table(spark, tmp_path, ITEMS)).collect())
    scores = {k: (c + SequenceMatcher(None, *k).ratio()) / 2 for k, c in brute(ITEMS, 0.6).items()}
    want = {k: s for k, s in scores.items() if s >= 0.8}
    assert {(r.a, r.b): r.score for r in got} == pytest.approx(want, abs=1e-9) and len(got) == len(want) > 100
    assert moved < 100_000


def test_similar_pairs_shuffle_no_candidates(spark, tmp_path):
    """the rows of the SQL, for a fraction of what the join of candidates shuffled."""
    folder = table(spark, tmp_path, [*ITEMS, "a", "", None, "Zoë x", "ITEM_oak"])
    got, moved = shuffled(spark, lambda: QUERIES["x15_j16_similar_pairs"](spark, folder).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW rollup_raw AS SELECT * FROM '{folder}/rollup_raw.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL["x15_j16_similar_pairs"]).fetchall()) and len(got) > 100
    assert moved < 100_000


def test_pairs_of_blocks_lose_none(spark, monkeypatch):
    """two groups, one of several blocks, texts without n-grams, and vectors that are given."""
    monkeypatch.setattr(P, "LEAST_BLOCK", 50)
    monkeypatch.setattr(P, "MOST_BLOCK", 50)
    few = ["a rather long text", "a rather long texts", "a", "ä😀b", "ä😀 b"]
    df = spark.createDataFrame([("f", t) for t in ITEMS] + [("g", t) for t in few] + [("g", None)], "file string, t string")
    want = {(f, *k): c for f, texts in (("f", ITEMS), ("g", few)) for k, c in brute(texts, 0.6).items()}
    for got in (P.text_pairs(df, ["file"], "t", 0.6), S.similar_pairs(S.tfidf(df.where("t IS NOT NULL"), ["file"], "t"), ["file"], "t", 0.6)):
        rows = {(r.file, r.a, r.b): r.cosine for r in got.collect()}
        assert rows == pytest.approx(want, abs=1e-9) and ("g", "a rather long text", "a rather long texts") in rows


def test_cosines_of_tiles_are_products(monkeypatch):
    """tiles, postings in parts and a limit on dense columns give what one product gives."""
    for name, value in (("TILE", 7), ("POSTINGS", 11), ("MOST_COMMON", 3)):
        monkeypatch.setattr(P, name, value)
    row, gram, tf, names = P.gram_counts(ITEMS[:40] + ["", "x"], 2, 4)
    assert {(i, names[g]): n for i, g, n in zip(row, gram, tf, strict=True)} == {(i, g): n for i, t in enumerate(ITEMS[:40]) for g, n in Counter(t[k : k + s] for s in (2, 3, 4) for k in range(len(t) - s + 1)).items()}
    full = np.zeros((42, len(names)))
    full[row, gram] = tf / 100
    for left in (42, 15):
        got = {(i, j): s for p, q, score in P.cosines(row, gram, tf / 100, 42, left, 0.003) for i, j, s in zip(p, q, score, strict=True)}
        want = {(i, j): s for (i, j), s in np.ndenumerate(full @ full.T) if s >= 0.003 and i < j and (left == 42 or i < left <= j)}
        assert got == pytest.approx(want, abs=1e-9) and want


def test_frequencies_are_dealt_to_few_pairs_of_blocks(spark, tmp_path, monkeypatch):
    """a group of many blocks' worth of texts. With 64 shares the document frequencies went to 1035 pairs of blocks."""
    monkeypatch.setattr(P, "LEAST_BLOCK", 4)
    got, moved = shuffled(spark, lambda: QUERIES["x14_x16_combined_pairs"](spark, table(spark, tmp_path, ITEMS)).collect())
    scores = {k: (c + SequenceMatcher(None, *k).ratio()) / 2 for k, c in brute(ITEMS, 0.6).items()}
    want = {k: s for k, s in scores.items() if s >= 0.8}
    assert {(r.a, r.b): r.score for r in got} == pytest.approx(want, abs=1e-9) and len(got) == len(want) > 100
    assert moved < 1_500_000


def test_empty_blocks_give_no_pairs(spark, monkeypatch):
    """with about a text a block some blocks are empty."""
    monkeypatch.setattr(P, "LEAST_BLOCK", 1)
    monkeypatch.setattr(P, "SHARES", 30)
    few = ITEMS[::6]
    got = P.text_pairs(spark.createDataFrame([(t,) for t in few], "t string"), [], "t", 0.6).collect()
    assert {(r.a, r.b): r.cosine for r in got} == pytest.approx(want := brute(few, 0.6), abs=1e-9) and len(got) == len(want) > 0


@pytest.mark.parametrize("few", [-1, 1])
def test_bounded_cosines_are_products(monkeypatch, few):
    """all pairs of a tile at once or one by one, n-grams that share columns, weights below 0, a vector without entries."""
    for name, value in (("TILE", 9), ("STRIP", 4), ("POSTINGS", 50), ("BOUND", 24), ("ALONE", 5), ("FEW", few)):
        monkeypatch.setattr(P, name, value)
    rng = np.random.default_rng(3)
    row, gram, w = np.repeat(np.arange(1, 40), 6), np.concatenate([rng.choice(30, 6, False) for _ in range(39)]), rng.normal(size=234)
    full = np.zeros((40, 30))
    np.add.at(full, (row, gram), w)
    for left, threshold in ((40, 1.5), (13, 1.5), (40, -0.5)):
        got = {(i, j): s for p, q, score in P.cosines(row, gram, w, 40, left, threshold) for i, j, s in zip(p, q, score, strict=True)}
        want = {(i, j): s for (i, j), s in np.ndenumerate(full @ full.T) if s >= threshold and i < j and (left == 40 or i < left <= j)}
        assert got == pytest.approx(want, abs=1e-9) and want
