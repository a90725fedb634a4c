"""The telemetry, alert and scoring jobs on streams.

Late rows: windowed jobs drop what comes behind their watermark; the foreachBatch jobs take rows in
order of time inside a micro-batch, and micro-batches in order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shaping
from ..functions.text import cache_key, combine
from ..operators import alerts, cache, circuit, ensemble, health, telemetry
from ..operators.ordered import newest
from ..operators.validate import check_requests, split_valid
from ..session import cut
from .state import StateTable, run_each, write_batch


def windowed_metrics(events: DataFrame, window: str = "1 hour", slide: str = "5 minutes",
                     late: str = "10 minutes") -> DataFrame:
    """Trailing window statistics per model, refreshed every slide; late rows are dropped."""
    p, c = "prediction_time", "confidence"
    return events.withWatermark("ts", late).groupBy(
        F.window("ts", window, slide), "model_name").agg(
        F.count("*").alias("prediction_count"), F.avg(p).alias("avg_response_time"),
        F.max(p).alias("max_response_time"), F.min(p).alias("min_response_time"),
        F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("response_time_std"),
        F.avg(c).alias("avg_confidence"))


def event_alerts(events: DataFrame) -> DataFrame:
    """Alerts of single predictions: the batch projection, stateless."""
    return telemetry.event_alerts(events)


def once_within(events: DataFrame, key: str = "event_id", keep: str = "2 hours") -> DataFrame:
    """Events without repeats; what is known of an event expires after `keep`."""
    return events.withWatermark("ts", keep).dropDuplicatesWithinWatermark([key])


def running_durations(events: DataFrame, operation: str, duration: str) -> DataFrame:
    """Running count, mean, least, greatest and total per operation (update mode)."""
    d = F.col(duration)
    return events.groupBy(operation).agg(
        F.count("*").alias("count"), F.avg(d).alias("avg_duration_ms"),
        F.min(d).alias("min_duration_ms"), F.max(d).alias("max_duration_ms"),
        F.sum(d).alias("total_duration_ms"))


def rule_alerts(samples: DataFrame, rules: DataFrame, tie: str, checkpoint: str, state: str,
                out: str):
    """Rule evaluation with cooldown; the state is each rule's last alert time."""
    table = StateTable(state, "rule_id string, last_ts timestamp")

    def step(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        before = cut(table.before(spark, i))
        emitted = cut(alerts.cooldown(cut(alerts.rule_hits(batch, rules)), tie, before))
        write_batch(alerts.make_alerts(emitted), out, i)
        now = emitted.select("rule_id", F.col("ts").alias("last_ts")).unionByName(before)
        table.after(now.groupBy("rule_id").agg(F.max("last_ts").alias("last_ts")), i)

    return run_each(samples, step, checkpoint)


def raised_alerts(events: DataFrame, keys: Sequence[str], checkpoint: str, state: str, out: str):
    """Alerts (kind 'alert') that are not open already; kind 'resolve' closes a key.

    The state is the set of open keys.
    """
    table = StateTable(state, ", ".join(f"{k} string" for k in keys))

    def step(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch)
        before = cut(table.before(spark, i))
        asked = rows.where("kind = 'alert'").drop("kind")
        done = rows.where("kind = 'resolve'").select(*keys, "ts")
        write_batch(health.suppress_repeats(asked, done, keys, open_keys=before), out, i)
        table.after(health.open_after(asked, done, keys, before), i)

    return run_each(events, step, checkpoint)


def circuits(calls: DataFrame, checkpoint: str, state: str, out: str, **settings):
    """Circuit breakers over a stream of calls: the batch replay, continued from batch to batch.

    A column `action`, where the stream has one, marks rows that are no calls but controls of their
    circuit: 'reset' or 'force_open'.
    """
    table = StateTable(state, circuit.CARRY)

    def step(batch: DataFrame, i: int) -> None:
        before = cut(table.before(batch.sparkSession, i))
        rows, controls = batch, None
        if "action" in batch.columns:
            both = cut(batch)
            rows = both.where("action IS NULL").drop("action")
            controls = both.where("action IS NOT NULL").select("circuit", "ts", "action")
        told = cut(circuit.replay(rows, carry=before, controls=controls, **settings))
        write_batch(told, out, i)
        table.after(circuit.end_states(told, before, controls), i)

    return run_each(calls, step, checkpoint)


def degradations(snapshots: DataFrame, checkpoint: str, state: str, out: str):
    """Verdicts as snapshots arrive; the state is each model's first five and latest snapshot."""
    table = StateTable(state, "model_name string, ts timestamp, " + ", ".join(
        f"{m} double" for m in telemetry.WATCHED) + ", ordinal int, seen bigint")

    def step(batch: DataFrame, i: int) -> None:
        before = cut(table.before(batch.sparkSession, i))
        now = cut(telemetry.first_and_latest(batch, before))
        write_batch(telemetry.judge_degradation(now), out, i)
        table.after(now, i)

    return run_each(snapshots, step, checkpoint)


def adaptive_weights(reports: DataFrame, start: DataFrame, checkpoint: str, state: str, out: str):
    """Weights after each report (seq, model_name, metric, value), applied in order of seq.

    A micro-batch's reports are folded by slices, see fold_reports.
    """
    table = StateTable(state, "model_name string, weight double")

    def step(batch: DataFrame, i: int) -> None:
        rows = cut(batch)
        before = start if i == 0 else table.before(batch.sparkSession, i)
        told = cut(ensemble.fold_reports(before, rows))
        write_batch(told, out, i)
        last = told.groupBy("model_name").agg(F.max_by("weight", "seq").alias("weight"))
        kept = before.withColumnRenamed("weight", "_old").join(last, "model_name", "left")
        table.after(cut(kept.select("model_name", F.coalesce("weight", "_old").alias("weight"))), i)

    return run_each(reports, step, checkpoint)


def scored_requests(requests: DataFrame, model, cache_path: str, checkpoint: str, out: str,
                    as_of: Callable[[DataFrame], str] | str | None = None, ttl_seconds: int = 3600,
                    mode: str = "legacy", compact_every: int = 32):
    """Answer requests from the cache or by scoring; new answers join the cache.

    as_of is the time of a batch: by default the clock's when the batch starts, or what the given
    function takes from the batch (such as its latest event time). Entries expire by it.

    The cache is an append-only log with one folder per micro-batch, read newest-first per hash, so
    a batch adds files and rewrites none. Every compact_every batches a new generation begins with
    the newest unexpired entries of the one before in one place: a batch reads no more than one
    generation, and older ones may be deleted. Invalid requests go to `out`/rejected.
    """
    answer = ["cls", "score", "confidence"]
    schema = ("input_hash string, cls string, score double, confidence double, model_name string, "
              "ts timestamp, ttl_seconds int")

    def score(rows: DataFrame) -> DataFrame:
        done = model.score(rows, "combined_text")
        return done.select("input_hash", "cls",
                           shaping.served_score(F.col("raw_score")).alias("score"),
                           shaping.served_confidence(F.col("confidence_raw")).alias("confidence"))

    def step(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        now = as_of(batch) if callable(as_of) else as_of or datetime.now(timezone.utc).strftime(
            "%Y-%m-%d %H:%M:%S")
        valid, bad = split_valid(check_requests(batch, mode))
        text = combine(F.col("description"), F.col("input_desc"), F.col("output_desc"))
        asked = cut(valid.select("request_id", text.alias("combined_text")).withColumn(
            "input_hash", cache_key(F.col("combined_text"))))
        first = i - i % compact_every
        home = f"{cache_path}/from={first}"
        # Older entries have expired, so their files are skipped by their statistics.
        oldest = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds))

        def log(generation: int) -> DataFrame:
            return spark.read.schema(schema + ", batch int").parquet(
                f"{cache_path}/from={generation}").where(F.col("ts") >= oldest)

        if i == first and i:
            left = newest(log(first - compact_every).drop("batch"), ["input_hash"], ["ts"])
            write_batch(left, home, -1)
        known = spark.createDataFrame([], schema) if i == 0 else log(first).where(F.col("batch") < i).drop("batch")
        answers, fresh = cache.serve(asked, known, now, score, answer, ttl_seconds, "voting")
        fresh = cut(fresh)
        write_batch(answers.drop("combined_text"), f"{out}/answers", i)
        write_batch(bad, f"{out}/rejected", i)
        write_batch(fresh, home, i)

    return run_each(requests, step, checkpoint)
