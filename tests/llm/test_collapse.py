import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dapple.llm import collapse
from dapple.llm.collapse import FormattingCopies
from dapple.operators import copies

SCHEMA = "raw_id bigint, s string, dimension string, label string, key string, hash bigint"


def canon(v):
    strip = lambda x: re.sub(r"[\W_]+", "", x.lower())
    if re.search("[:=]", v):
        return "\x1f".join(sorted(x for x in map(strip, re.split(r"[;|,/\r\n]", v)) if x))
    return strip(v)


def brute(rows):
    first, links = {}, set()
    for r in sorted(rows):
        if r[2] is None or r[3] is None:
            continue
        key = (r[1], tuple(sorted((canon(r[2]), canon(r[3])))))
        if key in first:
            links.add((first[key], r[0]))
        else:
            first[key] = r[0]
    return links


ROWS = [
    (1, "a", "Mood", "Calm", "x", 1), (2, "a", " mood!", "CALM", "x", 1), (3, "a", "calm", "mood", None, None), (4, "b", "mood", "calm", None, None), (5, "a", "mood", None, None, None),
    (6, "a", "pos", "item: Red lamp; side: left", None, None), (7, "a", "POS", "side=left\nitem= red_lamp", None, None), (8, "a", "pos", "item: lamp red; side: left", None, None),
    (9, None, "x", "é", None, None), (10, None, "x", "e", None, None), (11, None, "X", "É", None, None), (12, "a", "", "", None, None), (13, "a", "-", "??", None, None), (14, "a", "m", "2 lamps", None, None), (15, "a", "m", "3 lamps", None, None),
]


@pytest.mark.parametrize("bits", [None, 1 << 6])
def test_links_and_records(spark, bits):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    c = FormattingCopies(df, "raw_id", ["s"], ["dimension", "label"], bits)
    assert {tuple(r) for r in c.links().collect()} == brute(ROWS)
    records = c.records().collect()
    assert sum(r.copies for r in records) == len(ROWS)
    assert {r.kept_id: r.copies for r in records}[1] == 3


def test_hot_record_and_bounded_filter(spark, monkeypatch):
    monkeypatch.setattr(copies, "HOT_KEYS", 10)
    rows = [(i, "a", "D" if i % 2 else "d ", "hot" if i % 3 == 0 else f"l{i % 700}", None, None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {tuple(r) for r in FormattingCopies(df, "raw_id", ["s"], ["dimension", "label"], 1 << 10).links().collect()} == brute(rows)


def test_empty(spark):
    c = FormattingCopies(spark.createDataFrame([], SCHEMA), "raw_id", ["s"], ["dimension", "label"])
    assert c.links().collect() == [] and c.records().collect() == []


def test_more_repeats_than_the_filter_holds(spark):
    rows = [(i, "a", "d", f"l{i // 2}", None, None) for i in range(400)]
    c = FormattingCopies(spark.createDataFrame(rows, SCHEMA).repartition(4), "raw_id", ["s"], ["dimension", "label"], most_bits=1 << 6)
    assert {tuple(r) for r in c.links().collect()} == brute(rows)
    assert sum(r.copies for r in c.records().collect()) == 400


def test_filter_never_misses():
    rng = np.random.default_rng(0)
    parts = [rng.integers(-(2**62), 2**62, 300) for _ in range(3)]
    parts[1][:50], parts[2][:20] = parts[0][:50], parts[2][20:40]
    for shards in (1, 4):
        sent = pa.Table.from_batches([b for p in parts for b in collapse._sent(iter([pa.RecordBatch.from_pydict({"h": p})]), shards)]).sort_by("shard")
        found = np.concatenate([b.column("hash").to_numpy() for b in collapse._repeats(iter(sent.to_batches(max_chunksize=97)), 1 << 12)])
        assert set(np.r_[parts[0][:50], parts[2][:20]]) <= set(found) and len(found) == len(set(found)) < 300


def test_few_unique_rows_are_moved(spark, monkeypatch):
    """With 16 bits a row in shards the rows that are shuffled stay few however many rows there are."""
    monkeypatch.setattr(collapse, "SHARD_ROWS", 1 << 12)
    rows = spark.range(200_000).select(F.xxhash64("id").alias("hash"))
    repeats = collapse.possible_repeats(rows, "hash", 200_000)
    tested = collapse.with_possible_repeat(rows, "hash", repeats, "maybe", 1 << 19)
    assert tested.where("maybe").count() < 0.05 * 200_000
