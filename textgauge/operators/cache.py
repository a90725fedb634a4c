"""Prediction cache as a table: lookups, upserts, expiry, statistics, training backups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import newest
from .telemetry import at_time
from .validate import FALLBACK


def age_seconds(as_of: str, ts: str = "ts") -> Column:
    return (F.unix_micros(at_time(as_of)) - F.unix_micros(F.col(ts))) / 1_000_000


def is_valid(as_of: str) -> Column:
    """Younger than its time to live; at exactly that age an entry has expired."""
    return age_seconds(as_of) < F.col("ttl_seconds")


def upsert(cache: DataFrame, new: DataFrame, tie: str = "ts") -> DataFrame:
    """One row per input hash, the newest replacing older ones."""
    return newest(cache.unionByName(new), ["input_hash"], list(dict.fromkeys(["ts", tie])))


def lookup(requests: DataFrame, cache: DataFrame, as_of: str, tie: str = "ts",
           allow_stale: bool = False) -> DataFrame:
    """Requests with their newest valid entry (`cached`, `cache_source`, `cache_timestamp`).

    The cache is reduced to one row per hash first; many requests of one hash are a skewed left
    side, which adaptive execution splits.
    """
    latest = newest(cache, ["input_hash"], list(dict.fromkeys(["ts", tie])))
    if not allow_stale:
        latest = latest.where(is_valid(as_of))
    hit = latest.withColumnRenamed("ts", "cache_timestamp").withColumn("cached", F.lit(True))
    keep = [c for c in hit.columns if c == "input_hash" or c not in requests.columns]
    return requests.join(hit.select(*keep), "input_hash", "left").withColumns({
        "cached": F.coalesce("cached", F.lit(False)),
        "cache_source": F.when(F.col("cached"), F.lit(
            "network_fallback" if allow_stale else "local_store"))})


def stale_or_default(requests: DataFrame, cache: DataFrame, as_of: str, reason: str,
                     tie: str = "ts", allow_stale: bool = True) -> DataFrame:
    """An answer for every request without scoring: newest entry of any age, else the default.

    `cls`, `score` and `confidence` are read from the cache row.
    """
    found = lookup(requests, cache, as_of, tie, allow_stale)
    return found.withColumns({
        "fallback_reason": F.when(F.col("cached"), F.lit(reason)).otherwise(
            F.lit(f"{reason}_no_cache")),
        "cls": F.coalesce("cls", F.lit(FALLBACK["class"])),
        "score": F.when(F.col("cached"), F.col("score")).otherwise(F.lit(FALLBACK["score"])),
        "confidence": F.when(F.col("cached"), F.col("confidence")).otherwise(
            F.lit(FALLBACK["confidence"]))})


def serve(requests: DataFrame, cache: DataFrame, as_of: str,
          score_fn: Callable[[DataFrame], DataFrame], answer: list[str], ttl_seconds: int = 3600,
          model: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """(answers, new cache entries): hits come from the cache, each distinct miss is scored once.

    The look-up and the scores are written to the shared folder once, as both results need them.

    score_fn maps rows (input_hash, …) to the same rows with the `answer` columns.
    """
    found = cut(lookup(requests, cache, as_of))
    hits = found.where("cached")
    todo = found.where("NOT cached").select(*requests.columns).dropDuplicates(["input_hash"])
    scored = cut(score_fn(todo).select("input_hash", *answer))
    misses = found.where("NOT cached").drop(*answer).join(scored, "input_hash")
    columns = [*requests.columns, *answer, "cached", "cache_source"]
    fresh = scored.withColumns({
        "model_name": F.lit(model), "ts": at_time(as_of),
        "ttl_seconds": F.lit(ttl_seconds)})
    return hits.select(*columns).unionByName(misses.select(*columns)), fresh


def purge(cache: DataFrame, as_of: str, max_age_hours: int | None = None) -> DataFrame:
    """Entries that stay: unexpired ones, or those not older than the given hours."""
    if max_age_hours is None:
        return cache.where(age_seconds(as_of) <= F.col("ttl_seconds"))
    return cache.where(age_seconds(as_of) <= max_age_hours * 3600)


def cache_statistics(cache: DataFrame, as_of: str) -> DataFrame:
    ok = F.count_if(age_seconds(as_of) <= F.col("ttl_seconds"))
    return cache.agg(F.count("*").alias("total"), ok.alias("valid"),
                     (F.count("*") - ok).alias("expired"))


def hit_statistics(found: DataFrame) -> DataFrame:
    n, hits = F.count("*"), F.count_if("cached")
    return found.agg(
        n.alias("requests"), hits.alias("hits"), (n - hits).alias("misses"),
        F.round(F.coalesce(F.try_divide(hits * 100, n), F.lit(0.0)), 2).alias("hit_percent"))


def fallback_counts(answered: DataFrame) -> DataFrame:
    return answered.groupBy("fallback_reason").agg(F.count("*").alias("n"))


def newest_backup(backups: DataFrame, kind: str = "data_type") -> DataFrame:
    """Restore: the newest backup per data type with its time and size in bytes."""
    return newest(backups, [kind], ["created_at"]).withColumn(
        "size_bytes", F.octet_length("content").cast("bigint"))
