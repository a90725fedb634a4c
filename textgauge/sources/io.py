"""Readers with fixed schemas, exports, and fitted models on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordered import rank_in_key

EXPORTS = ("json", "csv")


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """Problem rows from JSON lines, with the short field names and a stable problem_id.

    The id is a digest of the row, so it does not depend on how the files are read; rows that are
    equal in every field get the same id and are told apart by their copy number.
    """
    raw = spark.read.schema(schemas.PROBLEM).json(path)
    named = raw.withColumnsRenamed({"input_description": "input_desc",
                                    "output_description": "output_desc"})
    row = F.to_json(F.struct(*named.columns), {"ignoreNullFields": "false"})
    marked = named.withColumns({"_d": F.md5(row), "_chunk": F.spark_partition_id()})
    # Copies are numbered per input partition first: one text may make up much of the input.
    numbered = rank_in_key(marked, ["_d"], "_chunk", [F.lit(0)], "_copy")
    return numbered.withColumn("problem_id", F.xxhash64("_d", "_copy")).drop(
        "_d", "_chunk", "_copy").withColumn("problem_score_scaled", F.col("problem_score"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REQUEST).json(path)


def stream_requests(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.REQUEST).option(
        "maxFilesPerTrigger", files_per_batch).json(path)


def export_telemetry(tables: dict[str, DataFrame], path: str, model: str | None = None) -> None:
    """Metrics, snapshots and alerts as JSON, one folder per table and model."""
    for name, df in tables.items():
        part = df if model is None else df.where(F.col("model_name") == model)
        part.write.mode("overwrite").partitionBy("model_name").json(f"{path}/{name}")


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Any set of tables (alerts, rules, health, recovery, …) as JSON, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def export_logs(logs: DataFrame, path: str, fmt: str = "json") -> None:
    """Log rows as JSON, or as CSV with the metadata as JSON text."""
    if fmt not in EXPORTS:
        raise ValueError(f"unknown export format: {fmt}")
    if fmt == "json":
        logs.write.mode("overwrite").json(path)
        return
    flat = logs.withColumn("metadata", F.to_json("metadata")) if "metadata" in logs.columns else logs
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_backup(df: DataFrame, path: str) -> None:
    """Training snapshots (data_type, content, created_at): append only, by data type."""
    df.write.mode("append").partitionBy("data_type").parquet(path)


def save_weights(weights: DataFrame, path: str, version: int) -> None:
    weights.withColumn("version", F.lit(version)).write.mode("append").partitionBy(
        "version").parquet(path)


def load_weights(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Weights of a version, the newest by default."""
    df = spark.read.parquet(path)
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    return df.where(F.col("version") == version).select("model_name", "weight")
