"""Parquet tables: publish under version numbers, run summaries, exports."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, published_at timestamp"


class PublishConflict(RuntimeError):
    """The table has a newer version than the one the rows were made from."""


def publish(df: DataFrame, root: str, based_on: int | None = None) -> str:
    """Replace a table without touching what readers hold open: write a new folder, then claim the next version number.

    The number is a small file that exactly one writer can create, so of two writers at once one takes the next number,
    the other tries the one after it: both versions stay, the higher one is current. A failed write leaves the old
    version current. With ``based_on`` (a version of :func:`current_version`, 0 for none) the writer has read that
    version, so any newer one raises :class:`PublishConflict` instead of losing the other writer's rows.
    """
    spark = df.sparkSession
    if based_on is not None and current_version(spark, root) != based_on:
        raise PublishConflict(f"{root} has moved on from version {based_on}")
    path = f"{root}/data-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    entry = json.dumps({"path": path, "published_at": datetime.now(timezone.utc).isoformat()})
    version = (current_version(spark, root) if based_on is None else based_on) + 1
    while not _claim(spark, f"{root}/_versions", f"{version:012d}.json", entry):
        if based_on is not None:
            raise PublishConflict(f"{root} has moved on from version {based_on}; rows are left at {path}")
        version += 1
    return path


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the latest published version, 0 before the first publish."""
    fs, folder = _file_system(spark, f"{root}/_versions")
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The published version with the highest number or the one asked for; None before the first publish."""
    number = current_version(spark, root) if version is None else version
    if not number:
        return None
    entry = spark.read.schema(ENTRY).json(f"{root}/_versions/{number:012d}.json").first()
    return spark.read.parquet(entry["path"])


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``(version, path, published_at)`` of every published version."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).cast("bigint")
    if not current_version(spark, root):
        return spark.createDataFrame([], f"version bigint, {ENTRY}")
    return spark.read.schema(ENTRY).json(f"{root}/_versions/*.json").select(number.alias("version"), "path", "published_at")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _claim(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Create a file with its content in one step, or return False because it is there already.

    The content is written aside first. A local folder links it to its name; elsewhere the file system renames it
    without overwriting, which is one step on HDFS. Object stores without such a rename need a catalogue instead.
    """
    fs, parent = _file_system(spark, folder)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(parent)
    aside = jvm.org.apache.hadoop.fs.Path(parent, f".{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text + "\n", "utf-8"))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(parent, name)
    if fs.getScheme() == "file":
        try:
            os.link(aside.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(aside, False)
    # FileContext.rename without options refuses an existing target; FileSystem.rename may not
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(aside, target, none)
        return True
    except Py4JJavaError as error:
        if not fs.exists(target):
            raise
        fs.delete(aside, False)
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        return False


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: str | None = None) -> None:
    """Append by default; ``overwrite`` drops prior output, only the touched partitions if partitioned."""
    writer = df.write.mode("overwrite" if overwrite else "append")
    if partition_by:
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """Count while writing: the counters are filled by the one job that consumes the frame."""
    watch = Observation(name)
    return df.observe(watch, *[c.alias(k) for k, c in counters.items()]), watch


def run_summary(spark: SparkSession, step: str, params: dict, counters: dict,
                started: datetime, finished: datetime) -> DataFrame:
    """One row per run for an append-only run table."""
    return spark.createDataFrame(
        [(step, json.dumps(params, sort_keys=True, default=str),
          {k: int(v) for k, v in counters.items()}, started, finished)],
        "step string, params string, counters map<string,bigint>, started_at timestamp, finished_at timestamp",
    )


def export_json(df: DataFrame, path: str, compact_key: str | None = None) -> None:
    """JSON rows for a front end; with ``compact_key``, one ``(key, json)`` row per record."""
    out = df
    if compact_key:
        body = [c for c in df.columns if c != compact_key]
        out = df.select(compact_key, F.to_json(F.struct(*body)).alias("json"))
    out.write.mode("overwrite").json(path)
