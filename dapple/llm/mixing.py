"""Mix sources to target shares by Pfair scheduling.

Each source supplies its target share of the budget in blocks of equal size. Block j of a source with weight w is
released at floor((j - 1) / w) and due at ceil(j / w); slots are given to the released block that is due first. At
every slot each source is then less than one block away from its share. Records take their place from a prefix sum
over their source in a pseudo-random order; prefix sums are made in buckets, so a source of any size is spread.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.runtime import written

MAX_SOURCES = 10_000
MAX_BLOCKS = 100_000
MIN_BLOCK = 4096
BUCKET_ROWS = 20_000


def edf(blocks: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block number from 0) for each slot. Weights are the shares of all blocks, so no slot stays empty."""
    total = sum(blocks.values())
    waiting = [(0, s, 0) for s, n in sorted(blocks.items()) if n]  # by release time
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # by deadline
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // blocks[s]), s, j))
        _, s, j = heapq.heappop(ready)
        yield s, j
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * total // blocks[s], s, j + 1))


class Mixture:
    """A mix of ``df`` by ``targets`` (``source``, ``target_share``, ``max_passes``; at most MAX_SOURCES rows).

    The budget is the size of all records whose source has a target, each once. A source supplies target_share x
    budget, repeating its records in whole and one last partial pass, at most ``max_passes`` times. Records without
    source, or of a source without target, aren't used. A source without tokens supplies nothing. Null shares and
    passes count as 0; a source named twice is an error; empty tables give an empty mix.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, record_id: str, source: str, tokens: Column, seed: int = 0, min_block: int = MIN_BLOCK):
        spark = df.sparkSession
        self.targets = {r[0]: (Fraction(str(r[1] or 0)), r[2] or 0) for r in targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_passes").limit(MAX_SOURCES + 1).collect()}
        if len(self.targets) > MAX_SOURCES or targets.groupBy("source").count().where("count > 1").head(1):
            raise ValueError(f"targets must name at most {MAX_SOURCES} sources, each once")
        named = targets.select(F.col("source").alias("_s"))
        sizes = df.select(F.col(record_id).alias("id"), F.col(source).alias("source"), tokens.alias("tokens"))
        self.sizes = written(sizes.join(F.broadcast(named), F.col("source") == F.col("_s"), "left_semi").withColumn("place", F.xxhash64(F.lit(seed), "id")), "mix-sizes")
        own = {r.source: (r.tokens, r.rows) for r in self.sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()}
        self.budget = sum(t for t, _ in own.values())
        self.plan = []
        for s, (share, most) in sorted(self.targets.items()):
            tokens_own = own.get(s, (0, 0))[0]
            need = share * self.budget / tokens_own if tokens_own else None
            quota = min(share * self.budget, Fraction(most) * tokens_own)
            reach = "short" if need is None or need > most else "met"
            self.plan.append((s, float(share), tokens_own, None if need is None else float(need), need is None or need > 1, int(-(-quota // 1)), reach, most))
        total = sum(p[5] for p in self.plan)
        self.block = max(min_block, -(-total // MAX_BLOCKS))
        slots = [(s, j, i) for i, (s, j) in enumerate(edf({p[0]: -(-p[5] // self.block) for p in self.plan}))]
        self.schedule = spark.createDataFrame(slots, "source string, block bigint, slot bigint")  # below MAX_BLOCKS + MAX_SOURCES rows
        self.plan_df = spark.createDataFrame(self.plan, "source string, target_share double, own_tokens bigint, need double, repeats boolean, quota bigint, reach string, max_passes int")
        self.rows = sum(r for _, r in own.values())

    def placed(self) -> DataFrame:
        """``id``, ``source``, ``pass_no`` (from 1), ``slot``, ``start`` (tokens of the source before it), ``tokens``:
        every use of a record. Ordered by slot and start this is the mix."""
        bits = max(1, (self.rows // BUCKET_ROWS).bit_length())
        rows = self.sizes.withColumn("_b", F.shiftrightunsigned("place", 64 - bits))
        sums = rows.groupBy("source", "_b").agg(F.sum("tokens").alias("_t"))
        offsets = sums.select("source", "_b", (F.sum("_t").over(Window.partitionBy("source").orderBy("_b")) - F.col("_t")).alias("_o"))
        w = Window.partitionBy("source", "_b").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = rows.withColumn("_c", F.sum("tokens").over(w) - F.col("tokens")).join(offsets, ["source", "_b"])
        plan = self.plan_df.select("source", "own_tokens", "quota", "max_passes")
        run = run.join(F.broadcast(plan), "source").withColumn("_at", F.col("_o") + F.col("_c"))
        last = F.least(F.col("max_passes").cast("bigint"), F.expr("(quota - _at + greatest(own_tokens, 1L) - 1) DIV greatest(own_tokens, 1L)"))
        used = run.where((F.col("_at") < F.col("quota")) & (F.col("max_passes") > 0)).withColumn("pass_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(last, F.lit(1)))))
        used = used.withColumn("start", F.col("_at") + (F.col("pass_no") - 1) * F.col("own_tokens")).where("start < quota")
        used = used.withColumn("block", F.expr(f"start DIV {self.block}L"))
        return used.join(F.broadcast(self.schedule), ["source", "block"]).select("id", "source", F.col("pass_no").cast("int").alias("pass_no"), "slot", "start", "tokens")

    def report(self) -> DataFrame:
        """By source: ``target_share``, ``need`` and ``passes`` of its records, ``tokens`` and ``share`` supplied,
        ``reach`` (short if ``max_passes`` don't suffice) and ``repeats`` (it needs more than one pass)."""
        got = self.placed().groupBy("source").agg(F.max("pass_no").alias("passes"), F.sum("tokens").alias("tokens"), F.count_if(F.col("pass_no") == 1).alias("records"))
        rows = self.plan_df.join(got, "source", "left").fillna(0, ["passes", "tokens", "records"])
        total = got.agg(F.sum("tokens")).scalar()
        return rows.withColumn("share", F.coalesce(F.try_divide("tokens", total), F.lit(0.0)))
