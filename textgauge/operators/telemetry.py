"""Model telemetry: window statistics, snapshots, tiered alerts, degradation, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import first_n, micros, top_per_key

# Alert tiers of model and host metrics as (direction, warning, critical).
MODEL_TIERS = {
    "accuracy": ("below", 0.7, 0.6), "f1_score": ("below", 0.7, 0.6),
    "mae": ("above", 2.0, 3.0), "rmse": ("above", 2.5, 3.5),
    "response_time": ("above", 1000.0, 2000.0), "confidence": ("below", 0.6, 0.5),
}
HOST_TIERS = {
    "cpu_percent": ("above", 80.0, 95.0), "memory_percent": ("above", 80.0, 95.0),
    "disk_usage_percent": ("above", 85.0, 95.0), "response_time_ms": ("above", 1000.0, 5000.0),
}
# Relative change that calls for retraining, per watched metric.
DEGRADATION = 0.1
WATCHED = {"accuracy": -1, "f1_score": -1, "mae": 1, "avg_confidence": -1}
BASELINE_SNAPSHOTS = 5
# How many of the newest rows each table keeps per key.
RETAINED = {"metrics": 10_000, "snapshots": 100, "hosts": 1_000, "health": 100, "calls": 1_000, "actions": 1_000, "logs": 10_000}
#: A time behind all others, in microseconds: 2^61.
NEVER_US = 1 << 61


def at_time(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def since(df: DataFrame, as_of: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Rows of the last `seconds` before `as_of`, the boundary included."""
    return df.where(F.col(ts) >= at_time(as_of) - F.make_dt_interval(secs=F.lit(seconds)))


def window_stats(events: DataFrame, as_of: str, seconds: int = 3600) -> DataFrame:
    """Per model, over the trailing window: count and spread of latency and confidence."""
    p, c = "prediction_time", "confidence"
    return since(events, as_of, seconds).groupBy("model_name").agg(
        F.count("*").alias("prediction_count"), F.avg(p).alias("avg_response_time"),
        F.max(p).alias("max_response_time"), F.min(p).alias("min_response_time"),
        F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("response_time_std"),
        F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"),
        F.max(c).alias("max_confidence"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("confidence_std"),
        F.max("ts").alias("latest_prediction"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    rest = [c for c in snapshots.columns if c != "model_name"]
    return snapshots.groupBy("model_name").agg(
        F.max_by(F.struct(*rest), "ts").alias("_s")).select("model_name", "_s.*")


def model_metrics(events: DataFrame, snapshots: DataFrame, as_of: str, seconds: int = 3600,
                  ) -> DataFrame:
    """Window statistics with the quality of the model's latest snapshot."""
    quality = latest_snapshot(snapshots).drop("ts", "avg_confidence")
    return window_stats(events, as_of, seconds).join(quality, "model_name", "left")


def create_snapshots(quality: DataFrame, events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Attach to each quality row (model_name, ts, …) its trailing window's telemetry.

    A window of s seconds touches two time slices of s seconds. The few quality rows are repeated
    for both, events keep their one slice, and the match is an equi-join on (model, slice): no
    model's history meets in one task. error_rate is 0 where not reported.
    """
    width = seconds * 1_000_000
    at = micros("ts")
    sliced = events.select("model_name", "prediction_time", "confidence",
                           at.alias("_e"), F.floor(at / width).alias("_slice"))
    asked = quality.withColumn("_q", at).withColumn("_slice", F.explode(F.array(
        F.floor(F.col("_q") / width), F.floor(F.col("_q") / width) - 1)))
    within = asked.select("model_name", "_q", "_slice").join(sliced, ["model_name", "_slice"]).where(
        (F.col("_e") <= F.col("_q")) & (F.col("_e") >= F.col("_q") - width))
    stats = within.groupBy("model_name", "_q").agg(
        F.avg("prediction_time").alias("avg_response_time"),
        F.avg("confidence").alias("avg_confidence"), F.count("*").alias("prediction_count"))
    out = quality.drop("avg_confidence").withColumn("_q", at).join(
        stats, ["model_name", "_q"], "left").drop("_q")
    if "error_rate" not in out.columns:
        out = out.withColumn("error_rate", F.lit(0.0))
    return out.withColumns({"error_rate": F.coalesce("error_rate", F.lit(0.0)),
                            "prediction_count": F.coalesce("prediction_count", F.lit(0))})


def tiers_table(spark: SparkSession, tiers: dict) -> DataFrame:
    return spark.createDataFrame(
        [(m, d, float(w), float(c)) for m, (d, w, c) in tiers.items()],
        "metric_name string, direction string, warning double, critical double")


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: dict[str, str]) -> DataFrame:
    """(keys, metric_name, value) from wide rows; `metrics` maps names to columns."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric_name"), F.col(c).cast("double").alias("value"))
        for m, c in metrics.items()])).alias("_m")
    return df.select(*keys, pairs).select(*keys, "_m.*").where("value IS NOT NULL")


def tiered_alerts(metrics: DataFrame, tiers: DataFrame) -> DataFrame:
    """Metric rows past their warning or critical limit (both strict), critical first."""
    above = F.col("direction") == "above"
    v = F.col("value")
    critical = F.when(above, v > F.col("critical")).otherwise(v < F.col("critical"))
    warning = F.when(above, v > F.col("warning")).otherwise(v < F.col("warning"))
    severity = F.when(critical, "critical").when(warning, "warning")
    return metrics.join(tiers, "metric_name").withColumn("severity", severity).where(
        "severity IS NOT NULL").withColumn(
        "threshold", F.when(F.col("severity") == "critical", F.col("critical"))
        .otherwise(F.col("warning"))).drop("direction", "warning", "critical")


def event_alerts(events: DataFrame) -> DataFrame:
    """Latency and confidence alerts of single predictions: a stateless projection."""
    p, c = F.col("prediction_time"), F.col("confidence")
    slow, doubt = MODEL_TIERS["response_time"], MODEL_TIERS["confidence"]

    def alert(metric: str, value: Column, severity: Column, threshold: Column, message: Column):
        return F.when(severity.isNotNull(), F.struct(
            F.lit(metric).alias("metric_name"), value.alias("value"), severity.alias("severity"),
            threshold.alias("threshold"), message.alias("message")))

    s1 = F.when(p > slow[2], "critical").when(p > slow[1], "warning")
    s2 = F.when(c < doubt[2], "critical").when(c < doubt[1], "warning")
    found = F.array_compact(F.array(
        alert("response_time", p, s1, F.when(p > slow[2], slow[2]).otherwise(slow[1]),
              F.concat(F.lit("Response time "), F.format_string("%.1f", p),
                       F.lit("ms exceeds "), s1, F.lit(" threshold"))),
        alert("confidence", c, s2, F.when(c < doubt[2], doubt[2]).otherwise(doubt[1]),
              F.concat(F.lit("Confidence "), F.format_string("%.3f", c),
                       F.lit(" below "), s2, F.lit(" threshold")))))
    keep = [x for x in ("event_id", "model_name", "ts") if x in events.columns]
    return events.select(*keep, F.explode(found).alias("_a")).select(*keep, "_a.*")


def first_and_latest(snapshots: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """What the degradation check needs per model: its first five snapshots and its latest one.

    Rows are (model_name, ts, metrics…, ordinal, seen): ordinal 1-5 for the first ones, 0 for the
    latest, seen = snapshots so far. `prior` is an earlier result that `snapshots` follows.
    """
    metrics = list(WATCHED)
    rows = snapshots.select("model_name", "ts", *metrics)
    counts = rows.groupBy("model_name").agg(F.count("*").alias("_n"))
    old = None
    if prior is not None:
        old = prior.where("ordinal > 0").select("model_name", "ts", *metrics)
        seen = prior.groupBy("model_name").agg(F.max("seen").alias("_old"))
        counts = counts.join(seen, "model_name", "full").select(
            "model_name", (F.coalesce("_n", F.lit(0)) + F.coalesce("_old", F.lit(0))).alias("_n"))
    early = top_per_key(rows if old is None else rows.unionByName(old), ["model_name"],
                        [F.col("ts")], BASELINE_SNAPSHOTS)
    w = Window.partitionBy("model_name").orderBy("ts")
    early = early.withColumn("ordinal", F.row_number().over(w))
    ends = rows if prior is None else rows.unionByName(
        prior.where("ordinal = 0").select("model_name", "ts", *metrics))
    last = latest_snapshot(ends).withColumn("ordinal", F.lit(0))
    return early.unionByName(last).join(
        counts.withColumnRenamed("_n", "seen"), "model_name")


def degradation(snapshots: DataFrame, threshold: float = DEGRADATION) -> DataFrame:
    """Per model: relative change of its latest snapshot against its baseline, and the verdict.

    The baseline is the mean of the first five snapshots, or of all but the latest where there are
    fewer than five. With exactly five it holds the latest one too. Fewer than two: no verdict.
    """
    return judge_degradation(first_and_latest(snapshots), threshold)


def judge_degradation(kept: DataFrame, threshold: float = DEGRADATION) -> DataFrame:
    """The degradation check on rows of first_and_latest: one small groupBy per model."""
    n, o = F.col("seen"), F.col("ordinal")
    baseline = (o > 0) & ((n >= BASELINE_SNAPSHOTS) | (o < n))
    sums = kept.groupBy("model_name").agg(
        F.max("seen").alias("snapshots"),
        *[F.avg(F.when(baseline, F.col(m))).alias(f"base_{m}") for m in WATCHED],
        *[F.max(F.when(o == 0, F.col(m))).alias(f"last_{m}") for m in WATCHED])
    worse, names = F.lit(False), []
    for m, sign in WATCHED.items():
        b, v = F.col(f"base_{m}"), F.col(f"last_{m}")
        change = F.when(b > 0, F.lit(float(sign)) * (v - b) / b)
        names.append(f"{m}_drop" if sign < 0 else f"{m}_rise")
        sums = sums.withColumn(names[-1], change)
        worse = worse | F.coalesce(change > threshold, F.lit(False))
    return sums.withColumn("retrain", worse & (F.col("snapshots") >= 2)).select(
        "model_name", "snapshots", *names, "retrain")


def monitor_summary(events: DataFrame, snapshots: DataFrame, alerts: DataFrame, as_of: str,
                    seconds: int = 3600) -> DataFrame:
    """Per model: window count, open alerts by severity, and whether to retrain."""
    open_ = alerts.where(~F.col("resolved")).groupBy("model_name").agg(
        F.count("*").alias("active_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"))
    models = events.select("model_name").distinct()
    stats = window_stats(events, as_of, seconds).select("model_name", "prediction_count")
    verdict = degradation(snapshots).select("model_name", "retrain")
    return (models.join(stats, "model_name", "left").join(open_, "model_name", "left")
            .join(verdict, "model_name", "left")
            .na.fill(0, ["prediction_count", "active_alerts", "critical", "warning"])
            .withColumn("retrain", F.coalesce("retrain", F.lit(False))))


def alert_totals(alerts: DataFrame) -> DataFrame:
    active = ~F.col("resolved")
    return alerts.agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"),
        F.count_if(active & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(active & (F.col("severity") == "warning")).alias("warning"))


def retain_newest(df: DataFrame, keys: Sequence[str], n: int, tie: str, as_of: str | None = None,
                  seconds: int | None = None) -> DataFrame:
    """The newest n rows per key, optionally only those of the last `seconds`."""
    if as_of is not None and seconds is not None:
        df = since(df, as_of, seconds)
    # Newest first: positions count down from a time that lies beyond all.
    return first_n(df, keys, F.lit(NEVER_US) - micros("ts"), [F.col(tie).desc()], n)


def retain_all(tables: dict[str, tuple[DataFrame, Sequence[str], str]], as_of: str, window_seconds: int = 3600,
               limits: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """What each of the named tables (rows, keys, tie) keeps: the newest rows per key, and metrics those of two windows."""
    limits = limits or RETAINED
    return {name: retain_newest(df, keys, limits[name], tie, *((as_of, 2 * window_seconds) if name == "metrics" else ()))
            for name, (df, keys, tie) in tables.items()}


def retain_alerts(alerts: DataFrame, tie: str, limit: int = 1000, resolved: int = 500) -> DataFrame:
    """All alerts up to `limit`; beyond it all unresolved ones and the newest resolved ones."""
    if alerts.limit(limit + 1).count() <= limit:
        return alerts
    done = alerts.where("resolved").orderBy(F.col("ts").desc(), F.col(tie).desc()).limit(resolved)
    return alerts.where("NOT resolved").unionByName(done)
