"""Pairs of texts whose vectors over character n-grams are similar, compared in blocks.

The texts of a group are dealt to blocks by their hash and a task compares two blocks, so a group of any size is
spread. What is shuffled are texts, once for each block of their group, and document frequencies, once for each two
blocks; the vectors are made in the task. A tile's cosines are bounded at once by a product of small matrices (n-grams
share columns, by Cauchy-Schwarz no cosine is above the product of the columns' norms) and only pairs whose bound
reaches the threshold are computed. No candidates are stored. Blocks are a fixed share of all texts up to MOST_BLOCK,
so up to SHARES x MOST_BLOCK texts what is shuffled grows with the texts and the pairs found, not with the pairs compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.runtime import written

#: Texts of a block, and the share of all texts that it is between the two: with many groups each gives work enough, and
#: one group gives 78 pairs of blocks. Every pair of blocks gets the document frequencies, so there must not be many more.
LEAST_BLOCK, MOST_BLOCK, SHARES = 2048, 16_384, 12
TILE, POSTINGS, ROWS = 2048, 4_000_000, 65_536
#: Columns of the bound, how many of them hold one n-gram alone, the share of a tile's pairs up to which those that the bound
#: leaves are computed one by one, and the rows that are taken at once for it.
BOUND, ALONE, FEW, STRIP = 320, 64, 0.03, 64
#: An n-gram is common from this share of the texts on; at most so many are held as dense columns.
COMMON, MOST_COMMON = 0.08, 1024


def grams_of(text: str | Column, low: int, high: int) -> Column:
    """All n-grams of a text in an array."""
    return F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))))


def gram_counts(texts: list[str], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Rows (a text's place, an n-gram's number, how often it is there) in order, and the n-grams by number."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
    width, code = int(chars.max(initial=0)) + 1, np.zeros(len(chars), np.int64)
    rows, numbers, names = [], [], []
    for n in range(1, high + 1):
        at = np.flatnonzero(left >= n)
        _, first, code[at] = np.unique(code[at] * width + chars[at + n - 1], return_index=True, return_inverse=True)
        if n >= low:
            rows.append(owner[at])
            numbers.append(code[at] + len(names))
            names += [joined[p : p + n] for p in at[first]]
    size = max(len(names), 1)
    key, tf = np.unique(np.concatenate(rows) * size + np.concatenate(numbers), return_counts=True)
    return key // size, key % size, tf, names


def _entries(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of ``rows``, and which of the rows each is of."""
    many = start[rows + 1] - start[rows]
    own = np.repeat(np.arange(len(rows)), many)
    return np.arange(len(own)) + np.repeat(start[rows] - (np.cumsum(many) - many), many), own


def _products(start: np.ndarray, gram: np.ndarray, w: np.ndarray, p: np.ndarray, q: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Products of the vectors of rows ``p``, which are in order, with those of rows ``q``. ``number`` is -1 for each n-gram."""
    score = np.zeros(len(p))
    ends = np.cumsum(start[q + 1] - start[q])
    s = 0
    while s < len(p):
        e = min(int(np.searchsorted(p, p[s] + STRIP)), int(np.searchsorted(ends, (ends[s - 1] if s else 0) + POSTINGS, "right")))
        e = max(e, s + 1)
        rows, place = np.unique(p[s:e], return_inverse=True)
        at, own = _entries(start, rows)
        used, code = np.unique(gram[at], return_inverse=True)
        table = np.bincount(own * len(used) + code, w[at], len(rows) * len(used))
        number[used] = np.arange(len(used))
        at, own = _entries(start, q[s:e])
        code = number[gram[at]]
        both = code >= 0
        at, own, code = at[both], own[both], code[both]
        score[s:e] = np.bincount(own, table[place[own] * len(used) + code] * w[at], e - s)
        number[used] = -1
        s = e
    return score


def cosines(row: np.ndarray, gram: np.ndarray, w: np.ndarray, n: int, left: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places p, q and cosines of ``threshold`` or more of the ``n`` vectors whose entries come in the order of their rows:
    of the first ``left`` with the others, or p < q of all if these are all."""
    df = np.bincount(gram)
    start = np.searchsorted(row, np.arange(n + 1))
    number = np.full(len(df), -1)
    by_df = np.argsort(-df, kind="stable")
    rank = np.empty(len(df), np.int64)
    rank[by_df] = np.arange(len(df))
    shared = np.where(rank < ALONE, rank, ALONE + rank % (BOUND - ALONE))
    norms = np.empty((n, BOUND), np.float32)
    for x in range(0, n, TILE):
        x_end = min(x + TILE, n)
        of = slice(start[x], start[x_end])
        norms[x:x_end] = np.sqrt(np.bincount((row[of] - x) * BOUND + shared[gram[of]], w[of] * w[of], (x_end - x) * BOUND)).reshape(-1, BOUND)
    least = threshold - 1e-4 * max(1.0, float(np.square(norms).sum(1).max(initial=0)))  # for what single precision loses
    common = by_df[: np.count_nonzero(df > max(COMMON * n, 1))][:MOST_COMMON]
    for x in range(0, left, TILE):
        x_end = min(x + TILE, left)
        for y in range(x if left == n else left, n, TILE):
            y_end = min(y + TILE, n)
            p, q = np.divmod(np.flatnonzero(norms[x:x_end] @ norms[y:y_end].T >= least), y_end - y)
            p, q = p + x, q + y
            if left == n:
                once = p < q
                p, q = p[once], q[once]
            if len(p) > FEW * (x_end - x) * (y_end - y):
                score = _tile(row, gram, w, start, (x, x_end), (y, y_end), common, number)[p - x, q - y]
            else:
                score = _products(start, gram, w, p, q, number)
            found = score >= threshold
            yield p[found], q[found], score[found]


def _tile(row: np.ndarray, gram: np.ndarray, w: np.ndarray, start: np.ndarray, xs: tuple[int, int], ys: tuple[int, int], common: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Products of the vectors of all rows ``xs`` with all ``ys``: ``common`` n-grams as a product of dense matrices, others by
    their postings. ``number`` is -1 for each n-gram."""
    number[common] = np.arange(len(common))
    dense, rare = [], []
    for a, b in (xs, ys):
        r, g, v = (c[start[a] : start[b]] for c in (row, gram, w))
        k = number[g]
        part = np.zeros((b - a, len(common)))
        part[r[k >= 0] - a, k[k >= 0]] = v[k >= 0]
        dense.append(part)
        rare.append((r[k < 0] - a, g[k < 0], v[k < 0]))
    number[common] = -1
    scores = dense[0] @ dense[1].T
    flat = scores.reshape(-1)
    (i, g, wi), (j, order, wj) = rare
    by_gram = np.argsort(order, kind="stable")
    j, order, wj = j[by_gram], order[by_gram], wj[by_gram]
    first = np.searchsorted(order, g, "left")
    many = np.searchsorted(order, g, "right") - first
    ends = np.cumsum(many)
    s = 0
    while s < len(g):
        base = ends[s - 1] if s else 0
        e = max(s + 1, int(np.searchsorted(ends, base + POSTINGS, "right")))
        own = np.repeat(np.arange(s, e), many[s:e])
        at = np.arange(len(own)) + np.repeat(first[s:e] - (ends[s:e] - many[s:e] - base), many[s:e])
        np.add.at(flat, i[own] * scores.shape[1] + j[at], wi[own] * wj[at])
        s = e
    return scores


def _parts(rows: DataFrame) -> int:
    session = rows.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, 4 * session.sparkContext.defaultParallelism) if hasattr(rows, "_jdf") else parts


def _dealt(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``by``, ``_text``, ...) for each two blocks ``_i`` <= ``_j`` that they are compared in, and the groups with their
    number of texts ``_n`` and of blocks ``_m``."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    block = F.least(F.greatest(F.sum("_n") / SHARES, F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
    groups = sizes.crossJoin(sizes.agg(block.alias("_size"))).withColumn("_m", F.ceil(F.col("_n") / F.col("_size")).cast("int")).drop("_size")
    own = F.pmod(F.xxhash64("_text"), F.col("_m")).cast("int")
    # with a number, as the one partition of a large group isn't to write all its copies
    placed = (rows.join(groups, by) if by else rows.crossJoin(groups)).withColumn("_block", own).repartition(_parts(rows), "_text")
    both = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return both.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_other", "_m"), groups


def _compared(rows: DataFrame, by: list[str], threshold: float, entries) -> DataFrame:
    """Pairs of each two blocks. ``entries`` gives the texts of a table in order, the entries of their vectors, and how many
    texts are in the first block."""
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "a string", "b string", "cosine double"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pdf = pa.Table.from_batches(batches).to_pandas()
        own = pdf.loc[pdf["_block"] >= 0, "_block"].nunique()
        if own < (1 if key[-2].as_py() == key[-1].as_py() else 2):  # a block may be empty
            return
        texts, row, gram, w, left = entries(pdf)
        for p, q, score in cosines(row, gram, w, len(texts), left, threshold):
            for z in range(0, len(p), ROWS):
                pairs = [(texts[s], texts[t]) if texts[s] < texts[t] else (texts[t], texts[s]) for s, t in zip(p[z : z + ROWS], q[z : z + ROWS], strict=True)]
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(v, len(a)) for v in key[: len(by)]), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(score[z : z + ROWS])], names=[*by, "a", "b", "cosine"])

    # with a number, as small partitions of much work aren't to be put together
    return rows.repartition(_parts(rows), *by, "_i", "_j").groupBy(*by, "_i", "_j").applyInArrow(run, schema)


def _ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int]:
    """Rows by block and text, and the number of those in the first block."""
    pdf = pdf.sort_values(["_block", "_text"], ignore_index=True)
    return pdf, int((pdf["_block"] == pdf["_block"].iloc[0]).sum())


def text_pairs(values: DataFrame, by: list[str], text: str, threshold: float, low: int = 2, high: int = 4) -> DataFrame:
    """``by``, ``a``, ``b``, ``cosine``: pairs a < b of texts, distinct within a group, whose unit TF-IDF vectors over character
    n-grams (smooth idf within the group) have a cosine of ``threshold`` or more."""
    rows = written(values.select(*by, F.col(text).alias("_text")).where(F.col(text).isNotNull()), "texts")
    dealt, groups = _dealt(rows, by)
    parted = groups.where("_m > 1").drop("_n")  # a group of one block is counted in its task
    many = (rows.join(parted, by) if by else rows.crossJoin(parted)).repartition(_parts(rows), "_text")
    grams = many.select(*by, "_m", F.explode(F.array_distinct(grams_of("_text", low, high))).alias("_text"))
    df = grams.groupBy(*by, "_m", "_text").agg(F.count(F.lit(1)).alias("_n")).repartition(_parts(rows), "_text")
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).withColumn("_j", F.explode(F.sequence(F.col("_i"), F.col("_m") - 1)))
    every = dealt.unionByName(df.drop("_m").withColumn("_block", F.lit(-1)))

    def entries(pdf: pd.DataFrame):
        counted = pdf["_block"] < 0
        found = dict(zip(pdf["_text"][counted], pdf["_n"][counted], strict=True))
        pdf, left = _ordered(pdf[~counted])
        texts = pdf["_text"].tolist()
        row, gram, tf, names = gram_counts(texts, low, high)
        df = np.fromiter((found[g] for g in names), np.int64, len(names)) if found else np.bincount(gram, minlength=len(names))
        w = tf * (np.log((1 + pdf["_n"].iloc[0]) / (1 + df[gram])) + 1)
        return texts, row, gram, w / np.sqrt(np.bincount(row, w * w, len(texts)))[row], left

    return _compared(every, by, threshold, entries)


def vector_pairs(vectors: DataFrame, by: list[str], text: str, threshold: float) -> DataFrame:
    """:func:`text_pairs` of vectors that are given (``by``, ``text``, ``gram``, ``w``)."""
    rows = vectors.groupBy(*by, F.col(text).alias("_text")).agg(F.collect_list(F.struct("gram", "w")).alias("_v"))
    rows = rows.where("_text IS NOT NULL").select(*by, "_text", F.col("_v.gram").alias("_gram"), F.col("_v.w").alias("_w"))
    dealt, _ = _dealt(written(rows, "vectors"), by)

    def entries(pdf: pd.DataFrame):
        pdf, left = _ordered(pdf)
        row = np.repeat(np.arange(len(pdf)), pdf["_gram"].map(len))
        return pdf["_text"].tolist(), row, pd.factorize(np.concatenate(pdf["_gram"].to_list()))[0], np.concatenate(pdf["_w"].to_list()), left

    return _compared(dealt, by, threshold, entries)
