"""Label counts that follow a folder: new files are folded in, broken records go to a dead-letter table.

The file source remembers what it has read in its checkpoint; a record that doesn't parse is written aside with its
batch and can be sent again. Counts are kept as one row for each batch and label, so that a batch that is run again
replaces its own rows; their sum is the running state. Records that come again whole are counted by :func:`resend`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.operators import tokens as T
from dapple.runtime import exists


def follow(spark: SparkSession, source: str, schema: str, out: str, files_per_batch: int = 1000, **options: str):
    """Read what is new in ``source`` (parquet with record_id and record), once, and return the finished query.

    ``out`` takes ``counts``, ``dead`` and ``checkpoint`` folders and must be shared by all executors."""
    stream = spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_batch, **options).parquet(source)

    def fold(batch: DataFrame, number: int) -> None:
        batch.persist()
        whole = T.parsed(batch)
        T.token_counts(whole).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        batch.where(F.col("record").isNull() | F.try_parse_json("record").isNull()).select("record_id", "record").write.mode("overwrite").parquet(f"{out}/dead/batch={number}")
        batch.unpersist()

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def resend(spark: SparkSession, out: str, again: DataFrame, attempt: str) -> DataFrame:
    """Take dead letters up again: ``again`` (``record_id``, ``record``) are new texts of records, or the same read anew. Those
    that are dead and whole now are counted once, under the name of the ``attempt``; the rest stay dead. Returns the
    identifiers counted. An attempt that is run again replaces its own rows."""
    earlier = again.join(dead_letters(spark, out, without=attempt).select("record_id").distinct(), "record_id", "left_semi")
    whole = T.parsed(earlier.dropDuplicates(["record_id"]))
    whole.select(F.col("id").alias("record_id")).write.mode("overwrite").parquet(f"{out}/resent/attempt={attempt}")
    T.token_counts(whole).write.mode("overwrite").parquet(f"{out}/counts/attempt={attempt}")
    return spark.read.parquet(f"{out}/resent/attempt={attempt}")


def running_counts(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.schema("cohort string, dimension string, label string, count bigint").option("recursiveFileLookup", True).parquet(f"{out}/counts")
    return rows.groupBy("cohort", "dimension", "label").agg(F.sum("count").alias("count"))


def dead_letters(spark: SparkSession, out: str, without: str | None = None) -> DataFrame:
    """Records that never parsed; ``without`` ignores what an attempt resent."""
    dead = spark.read.schema("record_id bigint, record string").option("recursiveFileLookup", True).parquet(f"{out}/dead")
    if not exists(spark, f"{out}/resent"):
        return dead
    resent = spark.read.schema("record_id bigint, attempt string").parquet(f"{out}/resent")
    if without is not None:
        resent = resent.where(F.col("attempt") != without)
    return dead.join(resent.select("record_id").distinct(), "record_id", "left_anti")
