"""Several tables exported as one state: a reader sees all of an export, or the one before.

Each export writes its tables to a folder of its own and then, as the last step, one manifest file that names them. What no
manifest names is not there, so an export that stops half way changes nothing, and readers never mix two exports.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number bigint, folder string, tables string, settings string, saved_at timestamp"


def save_state(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict | None = None,
               saved_at: str | None = None) -> int:
    """Write the tables and then the manifest that makes them visible; the result is the export's number.

    settings is any small dict (limits, counts, rates); saved_at is the time to be noted, now if not given.
    """
    folder = f"{path}/export-{uuid.uuid4().hex}"
    write_tables(folder, tables)
    return publish(spark, path, folder, {n: df.schema.json() for n, df in tables.items()}, settings, saved_at)


def write_tables(folder: str, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")


def publish(spark: SparkSession, path: str, folder: str, schemas: dict[str, str], settings: dict | None,
            saved_at: str | None) -> int:
    """Write the manifest of the tables in folder."""
    number = (_newest(spark, path) or {"number": 0})["number"] + 1
    at = F.lit(saved_at).cast("timestamp") if saved_at else F.current_timestamp()
    row = spark.createDataFrame([(number, folder, json.dumps(schemas), json.dumps(settings or {}))],
                                "number bigint, folder string, tables string, settings string")
    row.withColumn("saved_at", at).coalesce(1).write.mode("append").json(f"{path}/manifests")
    return number


def _newest(spark: SparkSession, path: str) -> dict | None:
    """The last manifest; one row per export."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifests")
    except Exception as err:  # noqa: BLE001 - the first export finds no folder
        if "PATH_NOT_FOUND" in str(err):
            return None
        raise
    row = rows.orderBy(F.col("number").desc(), F.col("saved_at").desc()).first()
    return row.asDict() if row else None


def load_state(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and settings of the newest whole export; an error if there is none."""
    from pyspark.sql.types import StructType

    last = _newest(spark, path)
    if last is None:
        raise ValueError(f"no export in {path}")
    schemas = {n: StructType.fromJson(json.loads(s)) for n, s in json.loads(last["tables"]).items()}
    return ({n: spark.read.schema(s).parquet(f"{last['folder']}/{n}") for n, s in schemas.items()},
            json.loads(last["settings"]))
