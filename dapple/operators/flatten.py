"""Flat tables from nested records, in one pass.

A depth-first visitor walks a record once and emits tagged rows: table tag, primary key, key of the parent row,
positions, value and a JSON payload of the row's single-valued attributes. The rows are written partitioned by tag;
each table is then read from its own partition with its own schema. What the tables are is data: a shape of
:class:`Table` for any nesting, of which AUDIT is the one of image records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dapple.runtime import fresh_folder, spread

BATCH = 8192
BROKEN = "broken"


@dataclass(frozen=True)
class Table:
    """A child table. ``path``: keys from the parent's object to the value; a last step into what is no object stays where it is.

    A table of objects has a row for each object, with the text at ``value`` and the positions of its own as ``<tag>_no`` in the
    rows below it, and ``children``. A table of texts has a row for each text."""

    tag: str
    path: tuple[str, ...]
    value: str | None = None  # of an object; None for a table of texts
    children: tuple[Table, ...] = field(default=())

    def objects(self) -> bool:
        return self.value is not None


AUDIT = (
    Table("item", ("cohorts", "objects", "items")),
    Table("person", ("cohorts", "people", "persons"), "person_id", (
        Table("accessory", ("accessories",)), Table("activity", ("activities",)),
        Table("clothing", ("clothing",), "clothing_garment", (Table("clothing_color", ("clothing_color",)),)),
    )),
)


def tables_of(shape: tuple[Table, ...]) -> list[Table]:
    return [x for t in shape for x in (t, *tables_of(t.children))]


def columns_of(shape: tuple[Table, ...]) -> list[str]:
    """The position columns of a shape: one for each table of objects."""
    return [f"{t.tag}_no" for t in tables_of(shape) if t.objects()]


def row_schema(shape: tuple[Table, ...]) -> str:
    return "record_id bigint, child string, pk string, parent_pk string, " + "".join(f"{c} int, " for c in columns_of(shape)) + "pos int, value string, payload string"


def _utf8(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def _text(value: Any) -> str:
    return _utf8(value) if isinstance(value, str) else json.dumps(value)


def _texts(value: Any) -> Iterator[tuple[int, str]]:
    """Positions and texts of a list, of one value in its place or of the keys of an object in its place."""
    many = sorted(value) if isinstance(value, dict) else value if isinstance(value, list) else [value]
    for pos, x in enumerate(many, 1):
        if x is not None and not isinstance(x, (dict, list)) and (text := _text(x)).strip():
            yield pos, text


def _objects(value: Any) -> Iterator[tuple[int, dict]]:
    for pos, x in enumerate(value if isinstance(value, list) else [value], 1):
        if isinstance(x, dict):
            yield pos, x


def _at(value: Any, path: tuple[str, ...]) -> Any:
    for i, step in enumerate(path):
        if isinstance(value, dict):
            value = value.get(step)
        elif i == 0 or i + 1 < len(path):
            return None
    return value


def visit(record_id: int, record: dict, shape: tuple[Table, ...] = AUDIT) -> Iterator[tuple]:
    """Tagged rows of one record, each parent before its children."""
    place = {c: i for i, c in enumerate(columns_of(shape))}

    def walk(tables: tuple[Table, ...], x: dict, above: str, numbers: list[int]) -> Iterator[tuple]:
        for t in tables:
            got = _at(x, t.path)
            if not t.objects():
                for pos, text in _texts(got):
                    yield record_id, t.tag, f"{above}/{t.tag}:{pos}", above, *numbers, pos, text, None
                continue
            for pos, y in _objects(got):
                own = list(numbers)
                own[place[f"{t.tag}_no"]] = pos
                pk, name = f"{above}/{t.tag}:{pos}", y.get(t.value)
                attributes = json.dumps({k: _text(v) for k, v in y.items() if v is not None and not isinstance(v, (dict, list))})
                yield record_id, t.tag, pk, above, *own, pos, "" if name is None else _text(name), attributes
                yield from walk(t.children, y, pk, own)

    yield from walk(shape, record, str(record_id), [0] * len(place))


def _emit(batches: Iterator[pa.RecordBatch], shape: tuple[Table, ...]) -> Iterator[pa.RecordBatch]:
    numbers = columns_of(shape)
    schema = pa.schema([("record_id", pa.int64()), *[(c, pa.string()) for c in ("child", "pk", "parent_pk")], *[(c, pa.int32()) for c in numbers], ("pos", pa.int32()), ("value", pa.string()), ("payload", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    out: list[tuple] = []
    for batch in batches:
        for record_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None or record_id is None:
                continue
            try:
                record, error = json.loads(text), None
                if not isinstance(record, dict):
                    error = "no object"
            except (ValueError, RecursionError) as failed:
                error = type(failed).__name__
            if error:
                out.append((record_id, BROKEN, str(record_id), None, *[0] * len(numbers), 0, error, None))
            else:
                out.extend(visit(record_id, record, shape))
            if len(out) >= BATCH:
                yield batch_of(out)
                out = []
    if out:
        yield batch_of(out)


class FlatTables:
    """The child tables of the nested records in ``df``.

    Texts that are no whole JSON object, or nested too deeply to be read, give no rows but are listed by :meth:`broken`;
    null texts and identifiers give none. A single value in place of a list is a list of one, an object in place of a list of
    texts stands for its sorted keys; nulls, blank texts and elements of another kind keep their position and give no
    row. Repeated records give repeated rows.
    """

    def __init__(self, df: DataFrame, record_id: str = "record_id", record: str = "record", path: str | None = None, shape: tuple[Table, ...] = AUDIT):
        self.spark, self.shape = df.sparkSession, shape
        self.path = path or fresh_folder(self.spark, "flat")
        tagged = spread(df.select(F.col(record_id).cast("bigint"), F.col(record))).mapInArrow(lambda it: _emit(it, shape), row_schema(shape))
        tagged.write.partitionBy("child").parquet(self.path)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(row_schema(self.shape)).parquet(self.path)

    def rows(self) -> DataFrame:
        """All tables' rows, with their tag in ``child``."""
        return self._read().where(F.col("child") != BROKEN)

    def broken(self) -> DataFrame:
        """``record_id``, ``error``: records that couldn't be read."""
        return self._read().where(F.col("child") == BROKEN).select("record_id", F.col("value").alias("error"))

    def table(self, tag: str, attributes: str | None = None) -> DataFrame:
        """One table: keys, positions and value; ``attributes`` is a DDL schema for the payload of a table of objects."""
        if tag not in [t.tag for t in tables_of(self.shape)]:
            raise ValueError(f"no table {tag}")
        rows = self.rows().where(F.col("child") == tag).drop("child")
        if attributes:
            plain = [c for c in rows.columns if c != "payload"]
            rows = rows.withColumn("payload", F.from_json("payload", attributes)).select(*plain, "payload.*")
        else:
            rows = rows.drop("payload")
        return rows
