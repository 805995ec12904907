"""Consolidate very many small files into few well-sized ones, each distinct record once.

One scan freezes the files: it writes the manifest (a row a file, with the records and the broken pieces counted in its
body) and the records. Files are packed into bins of a target size by first-fit decreasing, in shards of a bounded
number of files; each bin is rewritten as one file, leaving out copies of records. Record counts and checksums of what
was written are compared with the manifest's less the copies'. The commit is one small file that names the folder of
the data, so all of it becomes visible at once on object stores too.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.operators.copies import link_copies
from dapple.runtime import exists, fresh_folder, put_text, read_text, remove, spread, written

TARGET_BYTES = 128 << 20
SHARD_FILES = 200_000
COLUMNS = ("cohort", "dimension", "label", "count")
FIELDS = ("kind", "origin", *COLUMNS, "record")
RECORD = "file_id bigint, record_no int, kind string, origin string, cohort string, dimension string, label string, count string, record string"
MANIFEST = "file_id bigint, file_path string, kind string, n_bytes bigint, records int, broken int"
STAGED = f"part string, {RECORD}, file_path string, n_bytes bigint, records int, broken int"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in STAGED.split(", "))])
BATCH = 4096
COMMITTED = "COMMITTED"


def csv_records(body: str) -> Iterator[dict[str, str] | None]:
    """Rows of a CSV text whose header names the columns in any order; a later header row changes the order. Quoted
    fields may hold line breaks. A row of fewer fields than the header gives None, as does what can't be read."""
    header: list[str] | None = None
    rows = csv.reader(io.StringIO(body.lstrip("\ufeff"), newline=""))
    while True:
        try:
            row = next(rows)
        except StopIteration:
            return
        except csv.Error:
            yield None
            continue
        if not row or not any(x.strip() for x in row):
            continue
        names = [x.strip() for x in row]
        if header is None or sorted(names) == sorted(header):
            header = names
        else:
            yield dict(zip(header, row, strict=False)) if len(row) >= len(header) else None


def json_records(body: str) -> Iterator[dict | None]:
    """Objects of a JSON text: one object, a list of objects or one a line (lines end at ``\\n`` only). Of a text that
    was cut off, the whole ones. Every other value, and every piece that can't be read, gives None."""
    text = body.lstrip("\ufeff").strip()
    whole = lambda x: x if isinstance(x, dict) else None
    try:
        value = json.loads(text)
        yield from map(whole, value if isinstance(value, list) else [value])
        return
    except (ValueError, RecursionError):
        pass
    if text.startswith("["):
        decoder, at = json.JSONDecoder(), 1
        while True:
            while at < len(text) and text[at] in " \t\r\n,":
                at += 1
            try:
                value, at = decoder.raw_decode(text, at)
            except (ValueError, RecursionError):
                yield None
                return
            yield whole(value)
    for line in text.split("\n"):
        if not line.strip():
            continue
        try:
            yield whole(json.loads(line))
        except (ValueError, RecursionError):
            yield None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    out: list[tuple] = []
    rest, none = (None,) * 4, (None,) * 7
    for batch in batches:
        for file_id, path, kind, size, body in zip(*(batch.column(c).to_pylist() for c in ("file_id", "file_path", "kind", "n_bytes", "body")), strict=True):
            no, broken = 0, 0
            if kind == "audit":
                for r in json_records(body or "") if (body or "").strip() else ():
                    if r is None:
                        broken += 1
                    else:
                        no += 1
                        text = json.dumps(r, sort_keys=True, separators=(",", ":"))
                        out.append(("records", file_id, no, kind, None, None, None, None, None, text, *rest))
            elif kind == "frequencies":
                origin = (path or "").split("/frequency/")[0]
                for r in csv_records(body or ""):
                    if r is None:
                        broken += 1
                    else:
                        no += 1
                        out.append(("records", file_id, no, kind, origin, *(r.get(c) for c in COLUMNS), None, *rest))
            elif (body or "").strip():
                broken = 1
            out.append(("files", file_id, 0, kind, *none[:6], path, size, no, broken))
            if len(out) >= BATCH:
                yield batch_of(out)
                out = []
    if out:
        yield batch_of(out)


def _staged(files: DataFrame) -> DataFrame:
    size = F.coalesce(F.col("n_bytes"), F.octet_length("body"), F.lit(0)).cast("bigint")
    rows = files.where(F.col("file_id").isNotNull() & F.col("kind").isNotNull()).select("file_id", "file_path", "kind", size.alias("n_bytes"), "body")
    return spread(rows).mapInArrow(_records, STAGED)


def file_records(files: DataFrame) -> DataFrame:
    """The records of files (``file_id``, ``file_path``, ``kind``, ``n_bytes``, ``body``): number within the file from 1 and fields or
    canonical JSON. A file without a body, of another kind or without whole records gives none; headers, empty and
    short lines are no records."""
    return _staged(files).where("part = 'records'").select(*[c.split()[0] for c in RECORD.split(", ")])


def fingerprint(*names: str, seed: int = 0) -> Column:
    """64 bits of the columns' values; null is a value of its own."""
    return F.xxhash64(F.lit(seed), *[x for n in names for x in (F.col(n), F.col(n).isNull())])


class FirstFit:
    """First-fit with a tree of the largest free space, in logarithmic time an item."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.leaves = capacity, 1 << max(most - 1, 0).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        size, at = min(max(size, 0), self.capacity), 1
        while at < self.leaves:
            at *= 2
            if self.free[at] < size:
                at += 1
        self.free[at] -= size
        bin_no, at = at - self.leaves, at // 2
        while at:
            self.free[at] = max(self.free[2 * at], self.free[2 * at + 1])
            at //= 2
        return bin_no


def first_fit_decreasing(manifest: DataFrame, target_bytes: int = TARGET_BYTES, shard_files: int = SHARD_FILES) -> DataFrame:
    """``file_id``, ``kind``, ``bin`` (text: shard and number): bins of at most ``target_bytes`` bytes of one kind, by
    first-fit decreasing over shards of about ``shard_files`` files. A larger file has a bin of its own."""
    shards = max(1, -(-manifest.count() // shard_files))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_bytes", "file_id"], ascending=[False, True])
        fit = FirstFit(target_bytes, len(pdf))
        bins = [f"{shard}-{fit.place(size)}" for shard, size in zip(pdf["shard"], pdf["n_bytes"], strict=True)]
        return pd.DataFrame({"file_id": pdf["file_id"], "kind": pdf["kind"], "bin": bins})

    rows = manifest.select("file_id", "kind", F.col("n_bytes").cast("bigint").alias("n_bytes"), F.pmod(F.xxhash64("file_id"), F.lit(shards)).alias("shard"))
    return rows.groupBy("kind", "shard").applyInPandas(pack, "file_id bigint, kind string, bin string")


@dataclass
class Compaction:
    path: str  # the folder of the data: kind=.../bin=.../ files and _bins
    dropped: DataFrame  # file_id, record_no: copies that were not carried over
    bins: DataFrame  # kind, bin, files, bytes, records, broken (pieces that are no whole record), check of the written files


def read_committed(spark: SparkSession, out: str) -> DataFrame:
    """The records that were committed to ``out``."""
    return spark.read.parquet(f"{out}/{read_text(spark, f'{out}/{COMMITTED}')}")


def compact(files: DataFrame, out: str | None = None, target_bytes: int = TARGET_BYTES) -> Compaction:
    """Rewrite small files (``file_id``, ``file_path``, ``kind``, ``n_bytes``, ``body``) into bins of ``target_bytes``.

    Of equal records the one in the file with the least ``file_id``, first in the file, is carried over; records are
    equal if two 64-bit hashes of all their fields are. A null ``n_bytes`` counts as the length of the body, a file
    that is listed twice counts once. Pieces that are no whole record are counted in ``broken``. No files give an empty,
    committed folder. Raises, leaving ``out`` alone, if counts or checksums differ or if ``out`` was committed before.
    """
    spark = files.sparkSession
    final = out or fresh_folder(spark, "compacted")
    if exists(spark, f"{final}/{COMMITTED}"):
        raise RuntimeError(f"{final} was committed before; nothing was changed")
    parsed = fresh_folder(spark, "records")
    _staged(files).write.partitionBy("part").parquet(parsed)
    manifest = spark.read.schema(MANIFEST).parquet(f"{parsed}/part=files") if exists(spark, f"{parsed}/part=files") else spark.createDataFrame([], MANIFEST)
    if not manifest.groupBy("file_id").count().where("count > 1").isEmpty():
        remove(spark, parsed)
        return compact(files.dropDuplicates(["file_id"]), final, target_bytes)
    records = spark.read.schema(RECORD).parquet(f"{parsed}/part=records") if exists(spark, f"{parsed}/part=records") else spark.createDataFrame([], RECORD)
    content = fingerprint("file_id", "record_no", *FIELDS)
    keyed = records.select(fingerprint(*FIELDS).alias("k1"), fingerprint(*FIELDS, seed=7).alias("k2"), "file_id", "record_no", content.alias("content"))
    dropped = written(link_copies(keyed, ["k1", "k2"], ["file_id", "record_no"], ["content"]).select("file_id", "record_no", "content"), "dropped")
    bins = written(first_fit_decreasing(manifest, target_bytes), "bins")

    gone = dropped.groupBy("file_id").agg(F.collect_list("record_no").alias("gone"))
    plan = bins.drop("kind").join(gone, "file_id", "left")  # one row a file, so records move once to meet it and once to their bin
    kept = records.join(plan, "file_id").where(F.coalesce(~F.array_contains("gone", F.col("record_no")), F.lit(True))).drop("gone")
    name = f"data-{fresh_folder(spark, '').rsplit('-', 1)[1]}"
    path = f"{final}/{name}"
    count = bins.select("kind", "bin").distinct().count()
    kept.repartition(max(1, min(count, 100_000)), "kind", "bin").write.partitionBy("kind", "bin").parquet(path)

    # what each bin must hold follows from the manifest and the copies, not from the rows that were written
    check = lambda x: [F.count(F.lit(1)).alias("n"), F.bit_xor(x).alias("x")]
    by_file = manifest.join(records.groupBy("file_id").agg(*check(content)), "file_id", "left").join(bins.select("file_id", "bin"), "file_id")
    all_of = by_file.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("files"), F.sum("n_bytes").alias("bytes"), F.sum("records").alias("read"), F.sum("broken").alias("broken"), F.coalesce(F.bit_xor("x"), F.lit(0)).alias("all_x"))
    lost = dropped.join(bins, "file_id").groupBy("kind", "bin").agg(*check(F.col("content"))).withColumnsRenamed({"n": "lost_n", "x": "lost_x"})
    there = spark.read.schema(kept.schema).parquet(path) if count else kept.limit(0)
    found = there.groupBy("kind", "bin").agg(*check(content))
    want_n, want_x = F.col("read") - F.coalesce("lost_n", F.lit(0)), F.col("all_x").bitwiseXOR(F.coalesce("lost_x", F.lit(0)))
    both = all_of.join(lost, ["kind", "bin"], "left").join(found, ["kind", "bin"], "full").select(
        "kind", "bin", "files", "bytes", F.coalesce("n", F.lit(0)).alias("records"), "broken", F.coalesce("x", F.lit(0)).alias("check"),
        (want_n.eqNullSafe(F.coalesce("n", F.lit(0))) & want_x.eqNullSafe(F.coalesce("x", F.lit(0)))).alias("right"),
    )
    both.coalesce(1).write.parquet(f"{path}/_bins")
    checked = spark.read.parquet(f"{path}/_bins")
    if not checked.where("NOT right").isEmpty():
        remove(spark, path)
        raise RuntimeError("the rewritten files differ from the manifest; nothing was committed")
    if not put_text(spark, f"{final}/{COMMITTED}", name):
        remove(spark, path)
        raise RuntimeError(f"{final} was committed meanwhile; nothing was changed")
    remove(spark, parsed)
    return Compaction(path, dropped.drop("content"), checked.drop("right"))
