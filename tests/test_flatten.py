import json

import pytest

from dapple.operators.flatten import FlatTables, Table

P = {"person_id": "p1", "accessories": ["hat", None, " ", "bag"], "activities": "run", "pose": "sit", "clothing": [{"clothing_garment": "tunic", "clothing_color": ["red", "blue"]}, None, {"clothing_color": "tan"}]}
ROWS = [
    (1, json.dumps({"cohorts": {"objects": {"items": ["a", None, "b"]}, "people": {"persons": [None, P]}}})), (2, json.dumps({"cohorts": {"objects": ["c"], "people": [{}]}})), (3, json.dumps({"cohorts": {"objects": "d", "people": {"persons": {"person_id": None}}}})),
    (4, json.dumps({"cohorts": {"objects": {"items": {"z": 1, "y": 2}}}})), (5, json.dumps({"cohorts": None})), (12, json.dumps({"cohorts": "x"})), (6, "{\"cohorts\": {"), (7, None), (8, "[1]"), (9, json.dumps({"cohorts": {"people": {"persons": 3}, "objects": {"items": "e"}}})), (None, "{}"), (10, "x" * 100_000), (11, "[" * 100_000),
]
WANT = {
    (1, "item", 0, 0, 1, "a"), (1, "item", 0, 0, 3, "b"), (1, "person", 2, 0, 2, "p1"), (1, "accessory", 2, 0, 1, "hat"), (1, "accessory", 2, 0, 4, "bag"), (1, "activity", 2, 0, 1, "run"),
    (1, "clothing", 2, 1, 1, "tunic"), (1, "clothing_color", 2, 1, 1, "red"), (1, "clothing_color", 2, 1, 2, "blue"), (1, "clothing", 2, 3, 3, ""), (1, "clothing_color", 2, 3, 1, "tan"),
    (2, "item", 0, 0, 1, "c"), (2, "person", 1, 0, 1, ""), (3, "item", 0, 0, 1, "d"), (3, "person", 1, 0, 1, ""), (4, "item", 0, 0, 1, "y"), (4, "item", 0, 0, 2, "z"), (9, "item", 0, 0, 1, "e"),
}


def test_rows_links_and_tables(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "record_id bigint, record string, child string, pos int").repartition(3)
    flat = FlatTables(df)
    rows = flat.rows().collect()
    assert {(r.record_id, r.child, r.person_no, r.clothing_no, r.pos, r.value) for r in rows} == WANT and len(rows) == len(WANT)
    pks = {r.pk for r in rows}
    assert len(pks) == len(rows) and all(r.parent_pk in pks or r.parent_pk == str(r.record_id) for r in rows)
    assert flat.table("person", "pose string, age_range string").where("record_id = 1").first().pose == "sit"
    assert "payload" not in flat.table("item").columns
    assert {r.record_id for r in flat.broken().collect()} == {6, 8, 10, 11}
    with pytest.raises(ValueError):
        flat.table("nothing")


def test_other_shapes(spark):
    shape = (Table("order", ("orders",), "no", (Table("line", ("lines",), "sku", (Table("tag", ("meta", "tags")),)),)), Table("note", ("notes",)))
    record = {"notes": "n", "orders": [{"no": 7, "lines": {"sku": "a", "meta": {"tags": ["x", "y"]}}}, {"no": 8, "paid": True}]}
    flat = FlatTables(spark.createDataFrame([(1, json.dumps(record))], "record_id bigint, record string"), shape=shape)
    got = {(r.child, r.order_no, r.line_no, r.pos, r.value, r.parent_pk) for r in flat.rows().collect()}
    assert got == {("note", 0, 0, 1, "n", "1"), ("order", 1, 0, 1, "7", "1"), ("order", 2, 0, 2, "8", "1"), ("line", 1, 1, 1, "a", "1/order:1"), ("tag", 1, 1, 1, "x", "1/order:1/line:1"), ("tag", 1, 1, 2, "y", "1/order:1/line:1")}
    assert [r.paid for r in flat.table("order", "paid string").orderBy("pos").collect()] == [None, "true"]


def test_empty(spark):
    assert FlatTables(spark.createDataFrame([], "record_id bigint, record string")).rows().collect() == []
