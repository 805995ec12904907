"""How often every term occurs and in how many records, by last-seen counters.

A term's state is its occurrences, its records and the last record it was seen in; no set of records is kept. Where
each row is a record, a partition's tokens are sorted by term and row and counted in their place; only counters are
hash-partitioned by term and added up, so a term that a third of all rows hold sends one counter a partition, and no
text is shuffled. Where records are told by a column, their rows may lie anywhere: tokens are hash-partitioned by term
and a salt that follows from the record, sorted by term and record, and counted there. Nothing depends on where or how
often a task runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dapple.operators.arrow import changes, int64

SALTS = 64
WORDS = r"[\p{L}\p{N}]+"
_PART = "term string, rows bigint, occurrences bigint"


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    term, last, rows, occurrences = None, None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        record, w, o = int64(batch, "record"), int64(batch, "w"), int64(batch, "o")
        new = changes(batch, ["term"])
        head = batch.column("term")[0].as_py()
        new[0] = term is not None and head != term
        unseen = np.r_[term is None or head != term or record[0] != last, record[1:] != record[:-1]] | new
        start = np.flatnonzero(np.r_[True, new[1:]])
        r, c = np.add.reduceat(np.where(unseen, w, 0), start), np.add.reduceat(o, start)
        names = batch.column("term").take(pa.array(start)).to_pylist()
        if term is None or not new[0]:
            r[0] += rows
            c[0] += occurrences
        else:
            names, r, c = [term, *names], np.r_[rows, r], np.r_[occurrences, c]
        term, rows, occurrences, last = names[-1], int(r[-1]), int(c[-1]), int(record[-1])
        if len(names) > 1:
            yield pa.RecordBatch.from_pydict({"term": names[:-1], "rows": r[:-1], "occurrences": c[:-1]})
    if term is not None:
        yield pa.RecordBatch.from_pydict({"term": [term], "rows": [rows], "occurrences": [occurrences]})


def term_frequencies(df: DataFrame, text: str, weight: str | None = None, record: str | None = None, pattern: str = WORDS) -> DataFrame:
    """``term``, ``rows`` (records that hold it) and ``occurrences`` over all of ``df``.

    Terms are the matches of ``pattern`` in the lower-cased text. Each occurrence weighs ``weight`` of its row (null
    as 0), or 1 without one. A row is a record, unless ``record`` names the column that tells records: then rows
    with the same value, wherever they stand, are one record, and null is a record too. Null and blank texts hold
    no terms; an empty table gives no rows; further columns are never read.
    """
    w = F.coalesce(F.col(weight).cast("bigint"), F.lit(0)) if weight else F.lit(1).cast("bigint")
    rows = df.where(F.col(text).isNotNull())
    terms = F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))
    if record is None:  # a row lies in one partition, where its number tells it from others
        texts = rows.select(F.col(text).alias("text"), w.alias("o"), F.monotonically_increasing_id().alias("record"))
        tokens = texts.select("record", F.lit(1).cast("bigint").alias("w"), "o", F.explode(terms).alias("term"))
    else:
        texts = rows.select(F.col(text).alias("text"), w.alias("o"), F.xxhash64(F.col(record), F.col(record).isNull()).alias("record"))
        tokens = texts.select("record", F.lit(1).cast("bigint").alias("w"), "o", F.explode(terms).alias("term"))
        tokens = tokens.repartition("term", F.pmod("record", F.lit(SALTS)))
    parts = tokens.sortWithinPartitions("term", "record").select("term", "record", "w", "o").mapInArrow(_last_seen, _PART)
    return parts.groupBy("term").agg(F.sum("rows").alias("rows"), F.sum("occurrences").alias("occurrences"))


def marked_terms(df: DataFrame, text: str, weight: str | None = None, common_share: float = 0.02, rare_rows: int = 2, rare_occurrences: int = 10, record: str | None = None) -> DataFrame:
    """:func:`term_frequencies` with ``share`` of the non-null rows and ``mark``: ``common`` from ``common_share`` on,
    otherwise ``rare`` up to ``rare_rows`` rows or below ``rare_occurrences`` occurrences, otherwise ``useful``."""
    named = F.count(text) if record is None else F.countDistinct(F.when(F.col(text).isNotNull(), F.struct(record)))
    total = df.agg(named.alias("n")).scalar()
    share = F.col("rows") / total
    mark = F.when(share >= common_share, "common").when((F.col("rows") <= rare_rows) | (F.col("occurrences") < rare_occurrences), "rare").otherwise("useful")
    return term_frequencies(df, text, weight, record).withColumn("share", share).withColumn("mark", mark)
