"""Fill containers of a fixed capacity by bounded-space online packing.

Each partition keeps a fixed number of open windows. An item goes into the window it fits best; if none fits and all
windows are open, the fullest is sent off. The windows that are open at the end are merged, as items of their fill,
over few rounds, until one partition is left. Only sizes and identifiers pass through Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.runtime import written

OPEN_WINDOWS = 256
ROUND_ROWS = 100_000
_ITEM = "id bigint, piece_no int, pieces int, tokens bigint, container bigint, fill bigint"
_NAMES = ("id", "piece_no", "pieces", "tokens", "container", "fill")
_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


class Windows:
    """At most ``most`` open windows of ``capacity``; a window is known by the name it was opened with."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]  # names by free space
        self.mask = 0  # bit f: a window with f free is open
        self.open = 0

    def place(self, size: int, name: int) -> int:
        """The window of an item of 1 to ``capacity``; ``name`` is used if one is opened."""
        fitting = self.mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            window = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            space, window = self.capacity, name
        left = space - size
        if left:
            self.free[left].append(window)
            self.mask |= 1 << left
            self.open += 1
        return window

    def _take(self, space: int) -> int:
        window = self.free[space].pop()
        if not self.free[space]:
            self.mask ^= 1 << space
        self.open -= 1
        return window

    def left(self) -> Iterator[tuple[int, int]]:
        for space, names in enumerate(self.free):
            for name in names:
                yield name, self.capacity - space


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=list(_NAMES))


def _pack(batches: Iterable[pa.RecordBatch], capacity: int, most: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 40
    windows, made = Windows(capacity, most), 0
    for batch in batches:
        out: list[tuple] = []
        for item, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            whole, rest = divmod(tokens, capacity)
            pieces = whole + (rest > 0)
            for no in range(1, whole + 1):
                out.append((item, no, pieces, capacity, base + made, None))
                made += 1
            if rest:
                window = windows.place(rest, base + made)
                made += window == base + made
                out.append((item, pieces, pieces, rest, window, None))
            elif not whole:
                out.append((item, 1, 1, 0, None, None))
        if out:
            yield _batch(out)
    left = [(None, None, None, None, name, fill) for name, fill in windows.left()]
    if left:
        yield _batch(left)


def _merge(batches: Iterable[pa.RecordBatch], capacity: int, most: int) -> Iterator[pa.RecordBatch]:
    """Windows (container, fill), fullest first, into windows; open: whether it was still open at the end."""
    windows, got, to = Windows(capacity, most), [], []
    for batch in batches:
        for name, fill in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got.append(name)
            to.append(windows.place(fill, name))
    fills = dict(windows.left())
    if got:
        end = np.array([fills.get(t, 0) for t in to], dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"container": pa.array(got, pa.int64()), "into": pa.array(to, pa.int64()), "fill": end})


def pack_items(df: DataFrame, item_id: str, tokens: Column, capacity: int, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of items (``item_id``, ``piece_no``, ``pieces``, ``tokens``) with their ``container``, of which none
    holds more than ``capacity``.

    Only an item above the capacity is split, into full pieces and a rest; its full pieces are containers of their
    own. An item of no tokens (null and blank texts) takes no space and gets the container null. Repeated rows are
    items each; identifiers may be null. An empty table gives no rows. The result is a written table.
    """
    if capacity < 1 or open_windows < 1:
        raise ValueError("capacity and open_windows must be at least 1")
    sizes = df.select(F.col(item_id).cast("bigint").alias("id"), F.coalesce(tokens.cast("bigint"), F.lit(0)).alias("tokens"))
    packed = written(sizes.mapInArrow(partial(_pack, capacity=capacity, most=open_windows), _ITEM), "packed")
    left = packed.where("fill IS NOT NULL").select("container", "fill")
    moved, n = None, left.count()
    while n > 1:
        parts = -(-n // ROUND_ROWS)
        spread = left.repartition(parts, "container") if parts > 1 else left.coalesce(1)
        step = written(spread.sortWithinPartitions(F.desc("fill"), "container").mapInArrow(partial(_merge, capacity=capacity, most=ROUND_ROWS if parts == 1 else open_windows), "container bigint, into bigint, fill bigint"), "merged")
        if moved is None:
            moved = step.select("container", "into")
        else:
            nxt = step.select(F.col("container").alias("into"), F.col("into").alias("_into"))
            moved = written(moved.join(nxt, "into", "left").select("container", F.coalesce("_into", "into").alias("into")), "moved")
        if parts == 1:
            break
        left = step.where((F.col("into") == F.col("container")) & (F.col("fill") > 0)).select("container", "fill")
        n = left.count()
    items = packed.where("fill IS NULL")
    if moved is None:
        placed = items.withColumn("into", F.col("container"))
    else:
        placed = items.join(moved.where("container != into"), "container", "left")
    return placed.select(F.col("id").alias(item_id), "piece_no", "pieces", "tokens", F.coalesce("into", "container").alias("container"))


def container_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """``containers``, ``tokens``, ``fill`` (share of the space used) of a packing."""
    rows = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("t"))
    return rows.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.max("t").alias("fullest")).withColumn("fill", F.try_divide("tokens", F.col("containers") * capacity))


def tightness(packed: DataFrame, capacity: int, slack: float = 0.02) -> DataFrame:
    """``tokens``, ``least`` (containers that their sum needs), ``whole`` (no container is over its capacity) and ``tight`` (at most ``slack``
    above ``least``, and one more)."""
    fill = container_fill(packed, capacity)
    least = F.expr(f"(tokens + {capacity} - 1) DIV {capacity}")
    return fill.select("tokens", least.alias("least"), (F.coalesce("fullest", F.lit(0)) <= capacity).alias("whole"), (F.col("containers") <= least * (1 + slack) + 1).alias("tight"))
