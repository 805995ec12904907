"""Columns that files take from their paths, work lists, and readers of trees of small files."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dapple.runtime import filesystem, put_text

FREQUENCY = "frequency"
MANIFEST = "manifest.json"
MODEL_SUFFIXES = ("sdxl", "3.5", "flux", "qwen")
IMAGE_TYPES = (".png", ".jpg", ".jpeg")
#: Folder names of the contexts.
CONTEXT_FOLDERS = {
    "CA-R": ("context-aware_related_ca-r", "context-aware_related", "ca-r"), "CA-U": ("context-aware_unrelated_ca-u", "context-aware_unrelated", "ca-u"),
    "CF": ("context-free_cf", "context-free", "cf"),
}
#: What an export leaves out.
EXPORT_TYPES, NOT_EXPORTED = (".json", ".csv"), ("metadata.json", "manifest.json", "images_info.json")
#: Texts that a count file uses for a missing value.
MISSING = ("", "None", "NA", "N/A", "NaN", "nan", "null", "NULL", "n/a", "<NA>", "#N/A")


def path_columns(df: DataFrame, path: str, folder: str = FREQUENCY) -> DataFrame:
    """``model``, ``context``, ``occupation``, ``type`` (no_type without that level), ``prompt``, ``file`` and ``hidden`` of paths
    like ``model/context/occupation/[type/]prompt/<folder>/file``, relative to the root."""
    parts = F.split(F.col(path), "/")
    at = F.array_position(parts, folder).cast("int")
    return df.withColumns({
        "model": F.get(parts, F.lit(0)), "context": F.get(parts, F.lit(1)), "occupation": F.get(parts, F.lit(2)),
        "type": F.when(at >= 6, F.get(parts, F.lit(3))).otherwise(F.lit("no_type")), "prompt": F.get(parts, at - 2),
        "file": F.element_at(parts, -1), "hidden": F.exists(parts, lambda p: p.startswith(".")),
    })


def read_counts(spark: SparkSession, roots: list[str], folder: str = FREQUENCY, name: str = "frequencies.csv") -> DataFrame:
    """Label counts of all count files below the roots, with the columns of their paths. Hidden files and folders are left
    out, a missing count column counts 1, a count that is no number 0; texts for missing values are null."""
    out = None
    for root in roots:
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("header", True).option("enforceSchema", False).csv(root.rstrip("/"))
        rel = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + root.rstrip("/").replace("file://", "") + "/", "")
        have = raw.columns
        cell = lambda c: F.when(F.col(c).isin(*MISSING), F.lit(None)).otherwise(F.col(c)) if c in have else F.lit(None).cast("string")  # noqa: E731, B023
        count = F.coalesce(F.col("count").try_cast("double"), F.lit(0.0)) if "count" in have else F.lit(1.0)
        rows = raw.select(rel.alias("path"), *[cell(c).alias(c) for c in ("cohort", "dimension", "label")], count.alias("count"))
        rows = path_columns(rows, "path", folder).where(~F.col("hidden") & F.col("path").contains(f"/{folder}/"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_json_objects(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One row for each JSON file, with its path; files that aren't whole are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", glob).schema(f"{schema}, _corrupt_record string").json(path)
    return rows.withColumn("path", F.col("_metadata.file_path")).where("_corrupt_record IS NULL").drop("_corrupt_record")


def data_urls(spark: SparkSession, path: str, glob: str = "*.png", mime: str = "image/png") -> DataFrame:
    """Binary files as data URLs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.concat(F.lit(f"data:{mime};base64,"), F.base64("content")).alias("url"))


def _progress(want: DataFrame, have: DataFrame) -> DataFrame:
    wanted = want.where("prompt IS NOT NULL AND image_id IS NOT NULL").select("prompt", "image_id").distinct()
    done = have.where("image_id IS NOT NULL").select("image_id", F.lit(True).alias("done")).distinct()
    return wanted.join(done, "image_id", "left").select("prompt", "image_id", F.coalesce("done", F.lit(False)).alias("done"))


def work_plan(want: DataFrame, have: DataFrame) -> DataFrame:
    """By prompt: expected and existing images, ``status`` (complete, pending, resume), the first missing and last done image."""
    g = _progress(want, have).groupBy("prompt").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("done").alias("existing"),
        F.when(F.bool_and("done"), "complete").when(F.bool_or("done"), "resume").otherwise("pending").alias("status"),
        F.min(F.when(~F.col("done"), F.col("image_id"))).alias("first_missing"), F.max(F.when(F.col("done"), F.col("image_id"))).alias("last_done"),
    )
    return g


def next_batch(want: DataFrame, have: DataFrame) -> DataFrame:
    """``prompt``, ``image_id``: the run of missing images from the first missing one to the next done one."""
    w = Window.partitionBy("prompt")
    gap = F.min(F.when(~F.col("done"), F.col("image_id"))).over(w)
    rows = _progress(want, have).withColumn("gap", gap)
    stop = F.min(F.when(F.col("done") & (F.col("image_id") > F.col("gap")), F.col("image_id"))).over(w)
    return rows.withColumn("stop", stop).where(~F.col("done") & (F.col("stop").isNull() | (F.col("image_id") < F.col("stop")))).select("prompt", "image_id")


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path`` of every file below a root, relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace("file://", "") + "/", "").alias("path"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def prompt_folders(files: DataFrame, name: str = MANIFEST, chosen: list[str] | None = None) -> DataFrame:
    """``folder`` of each manifest of a listing (``path``), in the order of names by sorting; ``chosen`` limits it to some."""
    rows = files.where(file_name(F.col("path")) == name).select(parent(F.col("path")).alias("folder")).distinct()
    return rows.where(F.col("folder").isin(*chosen)) if chosen else rows


def manifest_of(folders: DataFrame, files: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """``folder``, ``manifest``: the first that is there of manifest.json, prompt/manifest.json and prompt/images.json; else the first by name
    of the folder's own JSON files that ``lists`` (``path``) knows to hold a list. A folder without one has null."""
    wanted = [(1, "manifest.json"), (2, "prompt/manifest.json"), (3, "prompt/images.json")]
    tries = folders.select("folder", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), F.lit(n)).alias("path")) for i, n in wanted])).alias("t")).select("folder", "t.*")
    found = tries.join(files.select("path").distinct(), "path")
    if lists is not None:
        own = lists.where(F.lower("path").endswith(".json")).select(parent(F.col("path")).alias("folder"), F.lit(4).alias("rank"), "path").join(folders, "folder", "left_semi")
        found = found.unionByName(own)
    best = found.groupBy("folder").agg(F.min(F.struct("rank", "path")).alias("b"))
    return folders.join(best, "folder", "left").select("folder", F.col("b.path").alias("manifest"))


def resolved_images(records: DataFrame, files: DataFrame, record_id: str) -> DataFrame:
    """``record_id``, ``path``: the file of a manifest record, the first that is listed of its ``abspath``, ``absolute_path`` and ``image_path``, its ``relpath`` and
    ``relative_path`` (each below the root, below its ``folder`` and by name in its folder), and its ``filename`` in its folder; null if none
    is. Missing columns count as null."""
    cell = lambda c: F.when(F.col(c) != "", F.col(c)) if c in records.columns else F.lit(None).cast("string")
    under = lambda x: F.when(x.isNotNull(), F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), x))
    tries = [cell(c) for c in ("abspath", "absolute_path", "image_path")]
    for rel in (cell("relpath"), cell("relative_path")):
        tries += [rel, under(rel), under(file_name(rel))]
    tries.append(under(cell("filename")))
    named = records.select(record_id, F.posexplode(F.array(*tries)).alias("rank", "path")).where("path IS NOT NULL")
    best = named.join(files.select("path").distinct(), "path").groupBy(record_id).agg(F.min(F.struct("rank", "path")).alias("b"))
    return records.select(record_id).join(best, record_id, "left").select(record_id, F.col("b.path").alias("path"))


def context_of_folder(folder: Column) -> Column:
    """CF, CA-R or CA-U by the nearest folder upwards that has a context's name; '' without one."""
    parts = F.reverse(F.transform(F.split(folder, "/"), lambda p: F.replace(F.lower(F.trim(p)), F.lit(" "), F.lit("_"))))
    short = F.create_map(*[F.lit(x) for c, names in CONTEXT_FOLDERS.items() for n in names for x in (n, c)])
    return F.coalesce(F.get(F.filter(F.transform(parts, lambda p: F.try_element_at(short, p)), lambda c: c.isNotNull()), F.lit(0)), F.lit(""))


def build_manifest(files: DataFrame) -> DataFrame:
    """``folder``, ``id``, ``prompt_used``, ``filename``, ``relpath``, ``role``, ``context`` of every image of a listing: its folder is the prompt's, the folder
    above it the role's."""
    name, folder = file_name(F.col("path")), parent(F.col("path"))
    kind = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    rows = files.where(kind.isin(*IMAGE_TYPES)).select("path", name.alias("filename"), folder.alias("folder"))
    return rows.select("folder", F.regexp_replace("filename", r"\.[^.]*$", "").alias("id"), F.replace(file_name(F.col("folder")), F.lit("_"), F.lit(" ")).alias("prompt_used"), "filename", F.col("path").alias("relpath"), file_name(parent(F.col("folder"))).alias("role"), context_of_folder(F.col("folder")).alias("context"))


def role_and_model(path: Column) -> Column:
    """Struct of ``stem``, ``role`` and ``model`` of a reviewer's file: the part after the last underscore is the model if it is a known one."""
    stem = F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"\.csv$", "")
    last = F.regexp_extract(stem, "_([^_]*)$", 1)
    known = F.lower(last).isin(*MODEL_SUFFIXES)
    role = F.when(known, F.regexp_replace(stem, "_[^_]*$", "")).otherwise(stem)
    return F.struct(stem.alias("stem"), F.replace(role, F.lit("_"), F.lit(" ")).alias("role"), F.when(known, last).otherwise("").alias("model"))


def source_files(files: DataFrame, folder: str, outputs: tuple[str, ...], suffix: str = ".csv") -> DataFrame:
    """The files of a listing that stand directly in a ``folder`` of this name, but for those below an operator's own output folders."""
    parts = F.split("path", "/")
    own = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(o) for o in outputs]))
    return files.where((F.element_at(F.concat(F.array(F.lit("")), parts), -2) == folder) & F.col("path").endswith(suffix) & ~own)


def exported_files(files: DataFrame) -> DataFrame:
    """The files of a listing that an export takes: count and description files, no manifests."""
    name = file_name(F.col("path"))
    return files.where(F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).isin(*EXPORT_TYPES) & ~name.isin(*NOT_EXPORTED))


def scaffold(spark: SparkSession, root: str, scenario: str, text: str) -> str:
    """A scenario's folders ``images`` and ``descriptions`` and its manifest, whose path is returned. One that is there stays."""
    folders = {n: f"{root.rstrip('/')}/{scenario}/{n}" for n in ("images", "descriptions")}
    for path in folders.values():
        fs, p = filesystem(spark, path)
        fs.mkdirs(p)
    now = datetime.now(timezone.utc).replace(microsecond=0).isoformat().replace("+00:00", "Z")
    put_text(spark, f"{root.rstrip('/')}/{scenario}/{MANIFEST}", json.dumps({"id": scenario, "scenario": text, "created_at": now, "paths": folders}, indent=2))
    return f"{root.rstrip('/')}/{scenario}/{MANIFEST}"


def required_fields(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` if they have all columns and at least one row, otherwise a ValueError that names what is missing."""
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"required fields are missing: {missing}")
    if rows.isEmpty():
        raise ValueError("there are no rows")
    return rows


def summary_reports(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose JSON text is a summary report: an object that has ``cohorts``."""
    return rows.where(F.coalesce(F.array_contains(F.json_object_keys(column), "cohorts"), F.lit(False)))
