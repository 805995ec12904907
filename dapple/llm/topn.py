"""Top N rows of every group by a secondary sort.

Rows are sorted by group, score and identifier within their partition and streamed as Arrow batches; a group's first
N rows go out and nothing of a group is buffered but the keys of the rows it has sent. This runs twice: over the
partitions as they are read, so that a group of any size sends at most N rows a partition into the shuffle, and over
the groups after hash partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.operators.arrow import changes, int64, values


def _first_rows(batches: Iterator[pa.RecordBatch], group: list[str], n: int, keyed: bool) -> Iterator[pa.RecordBatch]:
    at: tuple | None = None  # the group that the last batch ended in
    sent: set[tuple[int, int]] = set()  # contents sent of it, at most n
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = changes(batch, group)
        new[0] = at is None or values(batch, group, 0) != at
        part = np.cumsum(new) - (1 if new[0] else 0)
        goes_on = not new[0]
        if keyed:
            a, b = int64(batch, "_k1"), int64(batch, "_k2")
            order = np.lexsort((b, a, part))
            same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]) & (part[order][1:] == part[order][:-1])
            first = np.ones(len(a), dtype=bool)
            first[order[1:][same]] = False
            if goes_on and sent:
                stop = int(np.searchsorted(part, 1))
                first[:stop] &= ~np.fromiter(((x, y) in sent for x, y in zip(a[:stop].tolist(), b[:stop].tolist(), strict=True)), bool, stop)
        else:
            first = np.ones(batch.num_rows, dtype=bool)
        total = np.cumsum(first)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        before = (total - first)[starts]
        rank = total - before[part - part[0]]
        if goes_on:
            rank[part == part[0]] += count
        keep = first & (rank <= n)
        tail = part == part[-1]
        if new[0] or part[-1] != part[0]:
            sent, count = set(), 0
        at = values(batch, group, batch.num_rows - 1)
        mine = keep & tail
        count += int(mine.sum())
        if keyed:
            sent |= set(zip(a[mine].tolist(), b[mine].tolist(), strict=True))
        if keep.any():
            yield batch.filter(pa.array(keep))


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], columns: list[str], n: int, distinct_on: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows of each ``group`` by ``order``, as ``group`` and ``columns``.

    ``order`` names sort columns (``F.col("count").desc()``) and must end in a unique identifier, so that ties always
    fall the same way. Of rows that agree in all ``distinct_on`` columns (nulls equal; compared within a group by a
    128-bit hash) only the first counts; they must agree in the group, and in the order but for the identifier.
    Null groups are groups of their own; nulls in order columns sort as the sort expression says. Groups of fewer
    than n rows come out whole, an empty table gives no rows, and other columns of ``df`` are never read.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = list(dict.fromkeys([*group, *columns]))
    rows = df
    keyed = distinct_on is not None
    if keyed:
        content = [F.col(c) for c in distinct_on] + [F.col(c).isNull() for c in distinct_on]
        rows = rows.withColumns({"_k1": F.xxhash64(*content), "_k2": F.xxhash64(F.lit(7), *content)})
        names += ["_k1", "_k2"]
    rows = rows.select(*names)
    sort = [F.col(c) for c in group] + order

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _first_rows(batches, group, n, keyed)

    local = rows.sortWithinPartitions(*sort).mapInArrow(stream, rows.schema)
    whole = local.repartition(*group).sortWithinPartitions(*sort).mapInArrow(stream, rows.schema)
    return whole.drop("_k1", "_k2")
