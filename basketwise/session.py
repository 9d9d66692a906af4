"""Session helpers: local sessions for tests and benches, shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "basketwise", cores: str = "8", shuffle_partitions: int = 8,
                  memory: str = "12g", checkpoint_dir: str | None = None) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # the wide feature aggregate has more than the default 100 columns
        .config("spark.sql.codegen.maxFields", "300")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a cluster an unset value is an
    error, because a machine-local path would lose data with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basketwise-"))
    return spark.sparkContext.getCheckpointDir()


_made: list[str] = []
_tables: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder; :func:`release` removes what this process has named."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Delete the stored intermediates of this process, once no result that reads them is needed any more."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` once as a table hashed and sorted by ``keys``; joins of such tables on all of these keys move no rows.

    The files lie in the shared folder, one a bucket; the entry in the session's catalogue goes with :func:`release`.
    Both sides of a join need the same number of buckets (default: the session's shuffle partitions).
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", scratch_path(spark, label)) \
        .format("parquet").saveAsTable(name)
    _tables.append(name)
    return spark.table(name)
