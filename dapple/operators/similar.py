"""Similar strings: Ratcliff ratio, TF-IDF over character n-grams, greedy vocabularies and clusters.

Pairs come from ``operators/pairs``, which compares all values of a group in blocks and stores no candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dapple.functions import normalize as N
from dapple.operators.pairs import grams_of, text_pairs, vector_pairs
from dapple.runtime import written

COMBINED, GATE, DEDUPE, COSINE = 0.80, 0.65, 0.88, 0.80
ENUM_COSINE, COLOUR_COSINE, ENUM_RATIO, COLOUR_RATIO = 0.62, 0.48, 0.96, 0.92
BUCKET_ITEMS = 12
DIMENSIONS = 64


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; null if one is null. There is no builtin for it."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """:func:`ratio` where it is ``least`` or more; otherwise an upper bound below ``least``, which is cheaper to have."""

    def one(x: str, y: str, bound: float) -> float:
        m = SequenceMatcher(None, x, y)
        quick = m.quick_ratio()
        return m.ratio() if quick >= bound else quick

    return pd.Series([one(x, y, z) for x, y, z in zip(a, b, least, strict=True)], dtype="float64")


def gate(a: str, b: str) -> bool:
    """Whether two strings may mean the same: ratio, a shared word or one being the start of the other."""
    if SequenceMatcher(None, a, b).ratio() >= GATE or set(a.split()) & set(b.split()):
        return True
    x, y = a.replace(" ", ""), b.replace(" ", "")
    return x.startswith(y) or y.startswith(x)


def tfidf(values: DataFrame, by: list[str], text: str, low: int = 2, high: int = 4) -> DataFrame:
    """``by``, ``text``, ``gram``, ``w``, ``df``: unit TF-IDF vectors over character n-grams, smooth idf, within each group of values.

    Values must be distinct within a group; those shorter than ``low`` have no vector."""
    tf = values.select(*by, text, F.explode(grams_of(text, low, high)).alias("gram")).groupBy(*by, text, "gram").agg(F.count(F.lit(1)).alias("tf"))
    n = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    df = tf.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, [*by, "gram"]).join(n, by).withColumn("_w", F.col("tf") * (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*by, text)))
    return raw.select(*by, text, "gram", (F.col("_w") / norm).alias("w"), "df")


def similar_pairs(vectors: DataFrame, by: list[str], text: str, threshold: float) -> DataFrame:
    """``by``, ``a``, ``b``, ``cosine``: pairs a < b of values whose vectors have a cosine of ``threshold`` or more."""
    return vector_pairs(vectors, by, text, threshold)


def combined_pairs(values: DataFrame, by: list[str], text: str, threshold: float = COMBINED) -> DataFrame:
    """Pairs with (cosine + ratio) / 2 of ``threshold`` or more. As a ratio is at most 1, the cosine must reach 2 x threshold - 1."""
    pairs = text_pairs(values, by, text, 2 * threshold - 1)
    need = 2 * threshold - F.col("cosine") - 1e-9
    longest = 2 * F.least(F.length("a"), F.length("b")) / (F.length("a") + F.length("b"))  # no ratio is above it
    scored = pairs.where(longest >= need).withColumn("ratio", ratio_from("a", "b", need))
    return scored.withColumn("score", (F.col("cosine") + F.col("ratio")) / 2).where(F.col("score") >= threshold)


def standardise(df: DataFrame, by: list[str], column: str, threshold: float = COMBINED) -> DataFrame:
    """``by``, ``column``, ``standard``: each distinct value's standard. Values claim similar ones in the order of their number of
    rows, then text; a value that was claimed claims none. Values whose plain text is empty stand for themselves."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("plain", F.trim(N.plain_ascii(F.col("value"))))
    counts = written(counts, "values")
    plain = counts.where("plain != ''").select(*by, "plain").distinct()
    pairs = combined_pairs(plain, by, "plain", threshold)
    both = pairs.select(*by, "a", "b").unionByName(pairs.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(*by, "a").agg(F.collect_set("b").alias("near")).withColumnRenamed("a", "plain")
    rows = counts.join(near, [*by, "plain"], "left")
    keys = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "value"], ascending=[False, True])
        of: dict[str, list[str]] = {}
        for v, p in zip(pdf["value"], pdf["plain"], strict=True):
            of.setdefault(p, []).append(v)
        standard: dict[str, str] = {}
        for v, p, near_ in zip(pdf["value"], pdf["plain"], pdf["near"], strict=True):
            if v in standard or not p:
                continue
            for q in [p, *(near_ if near_ is not None else [])]:
                for x in of.get(q, []):
                    standard.setdefault(x, v)
        out = pdf[[*keys, "value"]].copy()
        out["standard"] = [standard.get(v, v) for v in pdf["value"]]
        return out

    types = dict(rows.dtypes)
    done = rows.groupBy(*keys).applyInPandas(claim, ", ".join(f"{k} {types[k]}" for k in keys) + ", value string, standard string")
    return done.select(*by, F.col("value").alias(column), "standard")


def keep_unlike(df: DataFrame, by: list[str], text: str, order: str, threshold: float = DEDUPE, most: int = BUCKET_ITEMS) -> DataFrame:
    """The first ``most`` items of each bucket that aren't like one kept before them, in the order of ``order``. Buckets are
    streamed in this order; only the texts kept, at most ``most``, are held."""
    cols = [*by, text, order]
    rows = df.select(*cols)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, kept = None, []
        for batch in batches:
            keep = []
            for row, (*key, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in [*by, text]), strict=True)):
                if key != bucket:
                    bucket, kept = key, []
                if t is not None and len(kept) < most and not any(SequenceMatcher(None, t, s).ratio() >= threshold for s in kept):
                    kept.append(t)
                    keep.append(row)
            if keep:
                yield batch.take(pa.array(keep))

    return rows.repartition(*by).sortWithinPartitions(*by, order, text).mapInArrow(pick, rows.schema)


def hash_embedding(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors from hashed character 3-grams: stands in for a sentence encoder, which may be given instead."""
    padded = [f"  {t} " for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner, mask, factor = np.repeat(np.arange(len(padded)), lengths), np.uint64(0xFFFFFFFF), np.uint64(1_000_003)
    out = np.zeros((len(texts), dimensions))
    if len(chars) >= 3:
        h = ((chars[:-2] * factor + chars[1:-1] & mask) * factor + chars[2:]) & mask
        whole = owner[:-2] == owner[2:]
        np.add.at(out, (owner[:-2][whole], (h[whole] % np.uint64(dimensions)).astype(np.int64)), 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


Embed = Callable[[list[str]], np.ndarray]


def _rank(token: str, count: int) -> tuple:
    t = token.replace(" ", "_")
    return len(t.split()), sum(c.isdigit() for c in t), t.count("_"), -count, len(t), t


def online_clusters(tokens: list[str], counts: list[int], embed: Embed = hash_embedding, threshold: float = COSINE) -> list[str]:
    """The canonical name of each token: one pass that joins a token to the nearest cluster within ``threshold`` that passes the
    string gate, moves its centre by weight and keeps its best name; underscores stand for spaces in names."""
    vectors = embed(tokens)
    weights, best, of = [], [], []
    centres = np.zeros((16, vectors.shape[1] if len(tokens) else 1))  # grows by doubling
    for token, count, v in zip(tokens, counts, vectors, strict=True):
        count, n = max(count, 1), len(best)
        found = -1
        if n:
            scores = centres[:n] @ v
            near = np.flatnonzero(scores >= threshold)
            for i in near[np.argsort(-scores[near], kind="stable")]:
                if gate(token, best[i][1]):
                    found = int(i)
                    break
        if found < 0:
            if n == len(centres):
                centres = np.concatenate([centres, np.zeros_like(centres)])
            centres[n] = v
            weights.append(count)
            best.append((_rank(token, count), token))
            found = len(best) - 1
        else:
            c = centres[found] * weights[found] + v * count
            centres[found] = c / (np.linalg.norm(c) or 1)
            weights[found] += count
            best[found] = min(best[found], (_rank(token, count), token))
        of.append(found)
    return [best[i][1].replace(" ", "_") for i in of]


#: What isn't cleaned.
SKIPPED = (("people", "clothing_garment_color"), ("people", "role_hint"))


def semantic_clean(df: DataFrame, by: list[str], embed: Embed = hash_embedding, threshold: float = COSINE) -> DataFrame:
    """Counts (``by``, ``label``, ``count``) with labels replaced by their cluster's name and summed. Labels are taken in the order of
    their text. Cohorts and dimensions in SKIPPED are left out, cohort ``totals`` is left alone, labels that normalise to nothing go."""
    sums = df.where("label IS NOT NULL").groupBy(*by, "label").agg(F.sum(F.coalesce("count", F.lit(0))).cast("bigint").alias("count"))
    for cohort, dimension in SKIPPED:
        sums = sums.where(~F.coalesce((F.col("cohort") == cohort) & (F.col("dimension") == dimension), F.lit(False)))
    same = F.coalesce(F.col("cohort") == "totals", F.lit(False))
    simple = sums.where(~same).withColumn("label", F.when(N.is_structured(F.col("label")), N.structured(F.col("label"))).otherwise(N.simple(F.col("label")))).where("label != ''")
    merged = simple.groupBy(*by, "label").agg(F.sum("count").alias("count"))
    types = dict(merged.dtypes)

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label")
        pdf["label"] = online_clusters(pdf["label"].tolist(), pdf["count"].tolist(), embed, threshold)
        return pdf.groupby([*by, "label"], as_index=False, dropna=False)["count"].sum()

    out = merged.groupBy(*by).applyInPandas(clean, ", ".join(f"{c} {types[c]}" for c in [*by, "label", "count"]))
    return out.unionByName(sums.where(same))


def token_set_ratio(a: str, b: str) -> float:
    """The highest ratio among the words both have, these and the rest of a, and these and the rest of b; 1 if one's words are all in the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, other = f"{both} {left}".strip(), f"{both} {right}".strip()
    pairs = [(one, other)] + ([(both, one), (both, other)] if both else [])
    return max(SequenceMatcher(None, p, q).ratio() for p, q in pairs)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Dot product of two arrays: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
