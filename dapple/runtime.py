"""What operators need from the session: the shared folder, cut lineage, parallelism and the Hadoop file system."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A temporary folder is taken only where the
    setting is missing and the master is local; on a cluster without the setting this raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="dapple-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir("file://" + folder)
    return sc.getCheckpointDir().rstrip("/")


_GIVEN: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, unused folder name in the shared folder; see :func:`clean`."""
    _GIVEN.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def clean(spark: SparkSession, keep: tuple[str, ...] = ()) -> int:
    """Remove all folders given out so far but for those in ``keep``, and return their number. DataFrames that operators
    returned before can't be read afterwards, so write what is wanted first."""
    gone = [p for p in _GIVEN if p not in keep]
    for path in gone:
        remove(spark, path)
        _GIVEN.remove(path)
    return len(gone)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are written to the shared folder once, so that later steps see one state of them even
    if an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder once and read from there: a cut that keeps columns apart."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if there is none of its name; whether it was written."""
    fs, p = filesystem(spark, path)
    if fs.exists(p):
        return False
    stream = fs.create(p, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores if a plain scan has fewer partitions than there are cores (a few small files); otherwise as
    they are. A plan with exchanges is left alone: asking for its partitions would run it."""
    if not hasattr(df, "_jdf"):  # a remote session plans its own scans
        return df
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df
