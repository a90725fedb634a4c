"""Log search, traces and operation durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import top_per_key
from .telemetry import at_time


def search(logs: DataFrame, tie: Sequence[str], correlation_id: str | None = None,
           event_type: str | None = None, level: str | None = None, as_of: str | None = None,
           minutes: int | None = None, limit: int = 100, metadata: dict[str, object] | None = None) -> DataFrame:
    """Newest entries matching all given filters.

    metadata gives values by path into the entries' metadata, a VARIANT column: {"$.request.user": 7}. An entry whose
    path is missing or has a value of another kind does not match.
    """
    out = logs
    for path, value in (metadata or {}).items():
        kind = {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")
        out = out.where(F.try_variant_get("metadata", path, kind) == F.lit(value))
    for name, value in (("correlation_id", correlation_id), ("event_type", event_type),
                        ("level", level)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if minutes is not None:
        out = out.where(F.col("ts") >= at_time(as_of) - F.make_dt_interval(mins=F.lit(minutes)))
    return out.orderBy(F.col("ts").desc(), *[F.col(c).desc() for c in tie]).limit(limit)


def with_metadata(logs: DataFrame, text: str, out: str = "metadata") -> DataFrame:
    """The entries with their metadata, JSON text of any shape, as VARIANT; NULL where it is no JSON."""
    return logs.withColumn(out, F.try_parse_json(F.col(text)))


def trace(logs: DataFrame, correlation_id: str, tie: Sequence[str], limit: int = 1000) -> DataFrame:
    """The entries of one request."""
    return search(logs, tie, correlation_id=correlation_id, limit=limit)


def traces(logs: DataFrame, tie: str, limit: int = 1000) -> DataFrame:
    """Every request's newest entries, numbered from the newest, at most `limit` each.

    Rows stay rows: no request's entries are gathered into one array.
    """
    from pyspark.sql import Window

    top = top_per_key(logs.where("correlation_id IS NOT NULL"), ["correlation_id"],
                      [F.col("ts").desc(), F.col(tie).desc()], limit)
    w = Window.partitionBy("correlation_id").orderBy(F.col("ts").desc(), F.col(tie).desc())
    return top.withColumn("entry", F.row_number().over(w))


def operation_durations(events: DataFrame, operation: str, duration: str, tie: str,
                        recent: int = 50) -> DataFrame:
    """Per operation: count, mean, least, greatest and total duration, and the mean of the newest."""
    d = F.col(duration)
    every = events.groupBy(operation).agg(
        F.count("*").alias("count"), F.round(F.avg(d), 2).alias("avg_duration_ms"),
        F.round(F.min(d), 2).alias("min_duration_ms"),
        F.round(F.max(d), 2).alias("max_duration_ms"),
        F.round(F.sum(d), 2).alias("total_duration_ms"))
    newest = top_per_key(events.select(operation, "ts", tie, duration), [operation],
                         [F.col("ts").desc(), F.col(tie).desc()], recent)
    late = newest.groupBy(operation).agg(F.round(F.avg(d), 2).alias("recent_avg_duration_ms"))
    return every.join(late, operation)
