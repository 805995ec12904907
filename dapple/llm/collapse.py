"""Collapse records that differ in outward form only.

Every record gets a canonical key: letters and digits in lower case, name/value fields in order, the value columns in
order. Only rows whose key may occur again are shuffled and grouped by the exact key; all others are singletons and
don't move. Which these are is found with Bloom filters of the keys' hashes:

1. Each partition sends its distinct hashes (8 bytes each, marked if it saw them twice) to shards by hash prefix. A
   shard merges the partitions' parts into two filters, bits seen and bits seen again, of BITS_A_ROW bits a row whatever
   the number of rows, and keeps the hashes whose bits were all seen again.
2. These possible repeats make one filter, merged by segment and broadcast, that each row is tested with in its place. It
   has at most MAX_BITS; where there are more repeats than it holds at BITS_A_ROW / 2 bits each, rows meet the
   repeats by a join on the hash.

Both steps only ever let too many rows through, never too few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.operators.copies import kept_rows, link_copies
from dapple.runtime import cut, written

PROBES = 3
BITS_A_ROW = 16
SHARD_ROWS = 1 << 20
SEGMENT_BITS = 1 << 19
MIN_BITS, MAX_BITS = 1 << 19, 1 << 28
FLUSH_ROWS = 1_000_000


def canonical_value(value: Column) -> Column:
    """Letters and digits of a text in lower case; a text with ``:`` or ``=`` keeps its fields apart and in order."""
    fields = F.transform(F.split(F.lower(value), r"[;|,/\r\n]"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""))
    plain = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")
    return F.when(value.rlike("[:=]"), F.array_join(F.array_sort(F.filter(fields, lambda x: x != "")), "\x1f")).otherwise(plain)


def _bits(hashes: np.ndarray, m: int) -> np.ndarray:
    """The bit positions of each hash, as rows."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(m - 1) for i in range(PROBES)])


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n).astype(bool)


def _power(n: int) -> int:
    return 1 << (max(n, 1) - 1).bit_length()


def _sent(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of a partition with their shard, and whether they were seen again in it."""
    shift = np.uint64(64 - (shards.bit_length() - 1))

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        h, times = np.unique(np.concatenate(held), return_counts=True)
        shard = (h.view(np.uint64) >> shift).astype(np.int32) if shards > 1 else np.zeros(len(h), np.int32)
        return pa.RecordBatch.from_pydict({"shard": shard, "hash": h, "again": times > 1})

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += batch.num_rows
        if n >= FLUSH_ROWS:
            yield emit(held)
            held, n = [], 0
    if held:
        yield emit(held)


def repeated_in(hashes: np.ndarray, again: np.ndarray, bits: int) -> np.ndarray:
    """The distinct hashes of a shard whose bits were all seen again; ``again`` marks items seen again before."""
    positions = _bits(hashes, bits)
    once = np.sort(positions, axis=0)
    fresh = np.ones(once.shape, dtype=bool)  # an item may probe a position twice: it counts once
    fresh[1:] = once[1:] != once[:-1]
    every = np.sort(once[fresh])
    twice = np.zeros(bits, dtype=bool)
    twice[every[1:][every[1:] == every[:-1]].astype(np.int64)] = True
    twice[positions[:, again].astype(np.int64).ravel()] = True
    return np.unique(hashes[twice[positions.astype(np.int64)].all(axis=0)])


def _repeats(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Possible repeats of each shard. Batches are sorted by shard; one shard is held at a time."""
    at, held = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"hash": repeated_in(np.concatenate([h for h, _ in held]), np.concatenate([a for _, a in held]), bits)})

    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        h, a = batch.column("hash").to_numpy(zero_copy_only=False), batch.column("again").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        for i, j in zip([0, *cuts], [*cuts, len(shard)], strict=True):
            if i == j:
                continue
            if at is not None and shard[i] != at:
                yield out()
                held = []
            at = shard[i]
            held.append((h[i:j], a[i:j].astype(bool)))
    if held:
        yield out()


def possible_repeats(rows: DataFrame, hash_column: str, expected: int, bits: int | None = None) -> DataFrame:
    """``hash``: distinct hashes of ``rows`` that may occur more than once; all that do are among them. Written once."""
    shards = _power(-(-expected // SHARD_ROWS))
    bits = bits or max(_power(BITS_A_ROW * -(-max(expected, 1) // shards)), 64)
    if bits & (bits - 1):
        raise ValueError("bits must be a power of two")
    sent = rows.select(hash_column).mapInArrow(lambda it: _sent(it, shards), "shard int, hash bigint, again boolean")
    spread = sent.repartition("shard") if shards > 1 else sent.coalesce(1)
    return written(spread.sortWithinPartitions("shard").mapInArrow(lambda it: _repeats(it, bits), "hash bigint"), "repeats")


def _build(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """The filter of one partition by segment: positions as uint32, or bits where they are smaller."""
    size = min(SEGMENT_BITS, m)
    for batch in batches:
        if not batch.num_rows:
            continue
        positions = np.unique(_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), m))
        segment = (positions // np.uint64(size)).astype(np.int32)
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        seen = []
        for a, b in zip(starts, np.r_[starts[1:], len(positions)], strict=True):
            at = (positions[a:b] % np.uint64(size)).astype(np.uint32)
            if len(at) * 4 < size // 8:
                seen.append(b"p" + at.tobytes())
            else:
                bits = np.zeros(size, dtype=bool)
                bits[at] = True
                seen.append(b"b" + _pack(bits))
        yield pa.RecordBatch.from_pydict({"segment": pa.array(segment[starts], pa.int32()), "seen": pa.array(seen, pa.binary())})


def _merge(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """Merged bits by segment. Batches are sorted by segment."""
    size = min(SEGMENT_BITS, m)
    at, seen = None, np.zeros(size, bool)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"segment": pa.array([at], pa.int32()), "seen": pa.array([_pack(seen)], pa.binary())})

    for batch in batches:
        for segment, data in zip(batch.column("segment").to_pylist(), batch.column("seen").to_pylist(), strict=True):
            if segment != at:
                if at is not None:
                    yield out()
                at, seen = segment, np.zeros(size, bool)
            if data[:1] == b"b":
                seen |= _unpack(data[1:], size)
            else:
                seen[np.frombuffer(data, np.uint32, offset=1)] = True
    if at is not None:
        yield out()


def with_possible_repeat(rows: DataFrame, hash_column: str, repeats: DataFrame, to: str, most_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with the boolean ``to``: whether the hash may be among ``repeats``; never false for one that is."""
    n = repeats.count()
    if n * BITS_A_ROW > 2 * most_bits:
        known = repeats.select(F.col("hash").alias("_h"), F.lit(True).alias("_r"))
        return rows.join(known, F.col(hash_column) == F.col("_h"), "left").withColumn(to, F.coalesce("_r", F.lit(False))).drop("_h", "_r")
    m = min(max(_power(BITS_A_ROW * n), MIN_BITS), most_bits)
    built = repeats.mapInArrow(lambda it: _build(it, m), "segment int, seen binary")
    merged = built.repartition("segment").sortWithinPartitions("segment").mapInArrow(lambda it: _merge(it, m), "segment int, seen binary")
    size = min(SEGMENT_BITS, m)
    table = np.zeros(m // 8, dtype=np.uint8)  # bits, of which at most MAX_BITS / 8 bytes come to the driver
    for row in merged.toLocalIterator():
        table[row.segment * size // 8 : (row.segment + 1) * size // 8] = np.frombuffer(row.seen, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        at = _bits(h.to_numpy(np.int64), m)
        return pd.Series(np.all((shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1, axis=0))

    return rows.withColumn(to, maybe(F.col(hash_column)))


class FormattingCopies:
    """Rows of ``df`` that are one record each apart from outward form.

    ``values``: text columns that are compared by :func:`canonical_value`, each of which may hold another's value;
    ``same``: columns that must be equal, nulls being equal; ``row_id``: the unique identifier. A row with a null in
    a value column is a record of its own. Equality is exact; equal rows, hot records and empty tables need no care,
    and further columns of ``df`` are not read. A text without letters and digits has the empty canonical value.
    """

    def __init__(self, df: DataFrame, row_id: str, same: list[str], values: list[str], bits: int | None = None, most_bits: int = MAX_BITS):
        self.row_id, self.values = row_id, values
        whole = F.lit(True)
        for v in values:
            whole = whole & F.col(v).isNotNull()
        texts = F.array_join(F.array_sort(F.array(*[canonical_value(F.col(v)) for v in values])), "\x1e")
        fixed = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in same]
        rows = df.select(F.col(row_id).alias("id"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)], F.concat_ws("\x1d", *fixed, texts).alias("key"), whole.alias("whole"))
        self.rows = rows.withColumn("hash", F.xxhash64("key"))
        repeats = possible_repeats(self.rows.where("whole"), "hash", self.rows.where("whole").count(), bits)
        self.tested = with_possible_repeat(self.rows, "hash", repeats, "maybe", most_bits).withColumn("maybe", F.col("whole") & F.col("maybe"))
        self.candidates = cut(self.tested.where("maybe").drop("whole", "maybe", "hash"))

    def links(self) -> DataFrame:
        """``kept_id``, ``copy_id``: every row that is a copy, with the smallest identifier of its record."""
        return link_copies(self.candidates, ["key"], ["id"]).select(F.col("kept.id").alias("kept_id"), F.col("id").alias("copy_id"))

    def records(self) -> DataFrame:
        """``kept_id``, the value columns of the kept row, ``copies`` (1 for a record without a copy)."""
        v = [f"v{i}" for i in range(len(self.values))]
        single = self.tested.where(~F.col("maybe")).select(F.col("id").alias("kept_id"), *[F.col(c).alias(n) for c, n in zip(v, self.values, strict=True)], F.lit(1).cast("bigint").alias("copies"))
        grouped = kept_rows(self.candidates, ["key"], ["id", *v]).select(F.col("kept.id").alias("kept_id"), *[F.col(f"kept.{c}").alias(n) for c, n in zip(v, self.values, strict=True)], "copies")
        return single.unionByName(grouped)
