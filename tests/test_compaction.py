import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from dapple.operators import copies
from dapple.operators.compaction import FirstFit, compact, csv_records, file_records, first_fit_decreasing, json_records, read_committed

SCHEMA = "file_id bigint, file_path string, kind string, n_bytes bigint, body string, key string, bin string"
F = "m/C/job/p1/frequency/"
REC = {"image": {"image_id": "i1", "n": 1}, "cohorts": {"a": ["é", None]}}
FILES = [
    (1, F + "a.csv", "frequencies", 90, "cohort,dimension,label,count,bin\no,items,\"pipe, tall\",2,1\no,items,x,1,1\no,items,x,1,9\n"),
    (2, F + "b.csv", "frequencies", None, "count,label,cohort,dimension\r\n2,\"pipe, tall\",o,items\r\n\r\n5,x,o,items\r\n1,x,o"),
    (3, "m/C/job/p2/frequency/a.csv", "frequencies", 40, "cohort,dimension,label,count\no,items,x,1"),
    (4, F + "empty.csv", "frequencies", 10, "cohort,dimension,label,count\n"), (5, F + "none.csv", "frequencies", 0, None), (6, F + "blank.csv", "frequencies", 0, ""),
    (7, "m/C/job/descriptions/1.json", "audit", 50, json.dumps(REC)), (8, "m/C/job/descriptions/2.json", "audit", 60, "[" + json.dumps(dict(reversed(REC.items())), indent=1, ensure_ascii=False) + ", {\"b\": 1.0}, {\"b\": 1}]"),
    (9, "m/C/job/descriptions/3.json", "audit", 30, "{\"b\": 1}\n{\"c\": 2}\n{\"d\": "), (10, "m/C/job/descriptions/4.json", "audit", 30, "[{\"c\": 2}, {\"e\": 3}, {\"f\""), (11, "x", "other", 5, "?"), (12, None, "audit", 5, "퟿ not json"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_records_and_copies(spark, tmp_path):
    df = frame(spark, FILES).repartition(3)
    got = compact(df, f"file://{tmp_path}/out", target_bytes=100)
    assert {tuple(r) for r in got.dropped.collect()} == {(1, 3), (2, 1), (8, 1), (9, 1), (10, 1)}
    out = spark.read.parquet(got.path)
    records = file_records(df).count()
    assert out.count() == records - 5 and read_committed(spark, f"file://{tmp_path}/out").count() == records - 5
    assert {(r.file_id, r.record_no) for r in out.collect()} == {(1, 1), (1, 2), (2, 2), (3, 1), (7, 1), (8, 2), (8, 3), (9, 2), (10, 2)}
    bins = got.bins.collect()
    assert sum(b.records for b in bins) == out.count() and sum(b.files for b in bins) == len(FILES)
    assert sum(b.broken for b in bins) == 5  # a short row, cut lines and lists, another kind, no JSON
    with pytest.raises(RuntimeError):
        compact(df, f"file://{tmp_path}/out", target_bytes=100)
    assert spark.read.parquet(got.path).count() == records - 5


def test_hot_record_and_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(copies, "HOT_KEYS", 4)
    rows = [(i, F + f"{i}.csv", "frequencies", 10, f"cohort,dimension,label,count\no,i,{'hot' if i % 3 == 0 else i},1") for i in range(90)]
    assert compact(frame(spark, rows), f"file://{tmp_path}/a").dropped.count() == 29
    none = compact(frame(spark, []), f"file://{tmp_path}/b")
    assert none.dropped.count() == 0 and none.bins.count() == 0


def test_readers():
    assert [r and r["label"] for r in csv_records('"label","count"\n"a","1"\n"count","label"\n"2","b"\n"c"\n')] == ["a", "b", None]
    assert list(json_records("[1, {}, null]")) == [None, {}, None] and list(json_records("[{}")) == [{}, None]
    assert list(csv_records('a,b\n"two\nlines",2\n')) == [{"a": "two\nlines", "b": "2"}]


def test_only_newlines_part_records(spark, tmp_path):
    odd = "".join(map(chr, (0x2028, 0x85, 0x2029, 0x1C, 0x1D, 0x1E)))
    body = json.dumps({"a": odd + "x"}, ensure_ascii=False).replace("\\u001c", chr(0x2028)) + "\n" + json.dumps({"b": 1})
    rows = [(1, "p", "audit", None, body), (2, F + "q.csv", "frequencies", None, f'cohort,dimension,label,count\no,i,"two\nlines{odd}",1\r\no,i,y,2')]
    got = compact(frame(spark, rows), f"file://{tmp_path}/out")
    out = spark.read.parquet(got.path).collect()
    assert sum(b.records for b in got.bins.collect()) == 4 and sum(b.broken for b in got.bins.collect()) == 0
    assert {r.label for r in out if r.kind == "frequencies"} == {f"two\nlines{odd}", "y"}


def test_files_listed_twice_count_once(spark, tmp_path):
    assert spark.read.parquet(compact(frame(spark, [FILES[0], FILES[0], FILES[2]]), f"file://{tmp_path}/out").path).count() == 3


@given(st.lists(st.integers(0, 120), min_size=1, max_size=80))
def test_first_fit_matches_plain_first_fit(sizes):
    fit, free = FirstFit(100, len(sizes)), []
    for size in map(lambda s: min(s, 100), sizes):
        at = next((i for i, f in enumerate(free) if f >= size), len(free))
        if at == len(free):
            free.append(100)
        free[at] -= size
        assert fit.place(size) == at


def test_bins_keep_to_target(spark):
    rows = [(i, "p", "audit", (i * 37) % 60, None) for i in range(200)]
    got = first_fit_decreasing(frame(spark, rows), 100, shard_files=60).collect()
    size = {r[0]: r[3] for r in rows}
    fill = {}
    for r in got:
        fill[r.bin] = fill.get(r.bin, 0) + size[r.file_id]
    assert len(got) == 200 and max(fill.values()) <= 100 and len(fill) < 1.3 * sum(size.values()) / 100 + 4
