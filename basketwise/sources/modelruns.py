"""Scans over saved model runs: fold metrics and out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketwise.sources.schemas import FOLD_METRICS_FILE


def read_fold_metrics(spark: SparkSession, root: str, file_name: str = "metrics_per_fold.json") -> DataFrame:
    """One row per (model, fold) from ``root/<model_id>/metrics_per_fold.json`` files."""
    raw = (
        spark.read.schema(FOLD_METRICS_FILE).option("multiLine", True).json(f"{root}/*/{file_name}")
        .withColumn("model_id", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))
    )
    return raw.select("model_id", F.explode("folds").alias("fold")).select("model_id", "fold.*")


def read_predictions(spark: SparkSession, path: str, models: Sequence[str] = ()) -> DataFrame:
    """Prediction table partitioned by ``model_id``; a model filter prunes folders, not rows."""
    df = spark.read.parquet(path)
    return df.filter(F.col("model_id").isin(list(models))) if models else df


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("model_id").parquet(path)
