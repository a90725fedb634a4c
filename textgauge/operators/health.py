"""Host and component health: summaries, trends, roll-ups, suppression of repeated alerts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import asof, micros, rank_in_key, slice_of, slice_width
from .telemetry import since

# Statuses from best to worst, severities of handled errors.
STATUSES = ["healthy", "degraded", "unhealthy", "critical"]
SEVERITIES = ["low", "medium", "high", "critical"]


def health_summary(samples: DataFrame, keys: Sequence[str], as_of: str, seconds: int = 3600,
                   tie: str = "event_id") -> DataFrame:
    """Per key: mean CPU, memory and disk over the window, sample count and the current sample."""
    names = ["cpu_percent", "memory_percent", "disk_usage_percent"]
    now = F.max_by(F.struct(*names), F.struct("ts", tie))
    out = since(samples, as_of, seconds).groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        *[F.round(F.avg(c), 2).alias(f"avg_{c}") for c in names], now.alias("_now"))
    return out.select(*keys, "sample_count", *[f"avg_{c}" for c in names],
                      *[F.col(f"_now.{c}").alias(f"current_{c}") for c in names])


def trends(samples: DataFrame, keys: Sequence[str], metrics: Sequence[str],
           width: int | None = None, tie: str = "event_id") -> DataFrame:
    """Mean of each key's first half of samples against the rest: stable, increasing, decreasing.

    An odd sample goes to the second half; under 5 % is stable; a first half at or below zero is
    stable; keys with one sample have no trend. `width` is the time slice of the ranking in µs; by
    default the widest that holds a bounded number of a key's samples.
    """
    timed = samples.withColumn("_at", micros("ts"))
    timed = timed.withColumn("_chunk", slice_of("_at", width or slice_width(timed, keys, "_at")))
    ranked = rank_in_key(timed, keys, "_chunk", [F.col("_at"), F.col(tie)], "_rank", "_total")
    first = F.col("_rank") <= F.floor(F.col("_total") / 2)
    halves = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.avg(F.when(first, F.col(m))).alias(f"_a_{m}") for m in metrics],
        *[F.avg(F.when(~first, F.col(m))).alias(f"_b_{m}") for m in metrics]).where("n >= 2")

    def label(m: str) -> Column:
        a, b = F.col(f"_a_{m}"), F.col(f"_b_{m}")
        change = F.when(a > 0, (b - a) / a * 100).otherwise(0.0)
        return F.when(F.abs(change) < 5, "stable").when(change > 0, "increasing").otherwise(
            "decreasing")

    return halves.select(*keys, "n", *[label(m).alias(f"{m}_trend") for m in metrics])


def worst_status(components: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """The worst status per key (over all rows, if no keys)."""
    order = F.array(*[F.lit(s) for s in STATUSES])
    rank = F.array_position(order, F.col(status))
    return components.groupBy(*keys).agg(F.element_at(
        order, F.greatest(F.max(rank), F.lit(1)).cast("int")).alias("overall_status"))


def run_checks(df: DataFrame, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rows (component, status, message) of all given checks; a failing check reports critical."""
    out = None
    for name, check in checks.items():
        try:
            rows = check(df).select(F.lit(name).alias("component"), "status", "message")
        except Exception as err:  # noqa: BLE001 - a broken check is itself a finding
            rows = df.sparkSession.createDataFrame(
                [(name, "critical", f"Health check failed: {str(err).splitlines()[0]}")],
                "component string, status string, message string")
        out = rows if out is None else out.unionByName(rows)
    return out


def fleet_status(circuits: DataFrame) -> DataFrame:
    """Roll-up of circuit states: none open healthy, some degraded, all critical."""
    open_ = F.count_if(F.col("state") == "open")
    half = F.count_if(F.col("state") == "half_open")
    n = F.count("*")
    return circuits.agg(
        n.alias("total"), (n - open_ - half).alias("closed"), half.alias("half_open"),
        open_.alias("open"),
        F.when(open_ == 0, "healthy").when(open_ < n, "degraded").otherwise("critical")
        .alias("health_status"))


def system_health(memory: Column, cpu: Column, open_circuits: Column, circuits: Column) -> Column:
    """Health of a host sample; the first rule that matches decides."""
    return (F.when(memory >= 95, "emergency").when(memory >= 90, "critical")
            .when(memory >= 80, "degraded").when(cpu >= 95, "critical").when(cpu >= 85, "degraded")
            .when((open_circuits > 0) & (open_circuits >= circuits * 0.5), "critical")
            .when(open_circuits > 0, "degraded").otherwise("healthy"))


def component_alerts(health: DataFrame) -> DataFrame:
    """Alerts of component rows (component, status, response_time_ms, message, …)."""
    r = F.col("response_time_ms")
    tier = F.when(r > 5000, "critical").when(r > 1000, "warning")
    slow = F.when(tier.isNotNull(), F.struct(tier.alias("severity"), F.concat(
        F.lit("Response time "), F.format_string("%.1f", r), F.lit("ms exceeds "), tier,
        F.lit(" threshold")).alias("text")))
    bad = F.when(F.col("status") == "critical", F.struct(
        F.lit("critical").alias("severity"),
        F.concat(F.lit("Component is in critical state: "), F.col("message")).alias("text"))
    ).when(F.col("status") == "unhealthy", F.struct(
        F.lit("warning").alias("severity"),
        F.concat(F.lit("Component is unhealthy: "), F.col("message")).alias("text")))
    keep = [c for c in health.columns if c not in ("status", "message", "response_time_ms")]
    return health.select(*keep, F.explode(F.array_compact(F.array(slow, bad))).alias("_a")).select(
        *keep, "_a.severity", F.col("_a.text").alias("alert_message"))


def suppress_repeats(alerts: DataFrame, resolutions: DataFrame, keys: Sequence[str],
                     width: int | None = None, open_keys: DataFrame | None = None,
                     resolved_by: Sequence[str] | None = None) -> DataFrame:
    """Alerts that are raised: per key, the first one since the key was last resolved.

    Both tables have (keys, ts); resolutions may name some of the keys only (resolved_by) and then
    resolve all that agree in these. The last resolution is found by a sliced as-of match; the first
    alert of each span between resolutions is a plain aggregate, combined map-side. Keys in
    `open_keys` are already open when the tables begin, so their first span raises nothing.
    """
    by = list(resolved_by or keys)
    res = resolutions.select(*by, "ts").distinct().withColumn("_resolved", F.col("ts"))
    spans = asof(alerts, res, by, "ts", "_resolved", width)
    rest = [c for c in alerts.columns if c not in keys]
    order = [F.col("ts"), *[F.col(c) for c in rest if c != "ts"]]
    firsts = spans.groupBy(*keys, "_resolved").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    if open_keys is not None:
        held = open_keys.select(*keys).withColumn("_held", F.lit(True))
        firsts = firsts.join(held, list(keys), "left").where(
            F.col("_resolved").isNotNull() | F.col("_held").isNull())
    return firsts.select(*keys, "_r.*").select(*alerts.columns)


def open_after(alerts: DataFrame, resolutions: DataFrame, keys: Sequence[str],
               open_keys: DataFrame) -> DataFrame:
    """Keys with an unresolved alert after the given rows; a resolution precedes an equal time."""
    a = alerts.groupBy(*keys).agg(F.max("ts").alias("_a"))
    r = resolutions.groupBy(*keys).agg(F.max("ts").alias("_r"))
    both = a.join(r, list(keys), "full").join(
        open_keys.select(*keys).withColumn("_held", F.lit(True)), list(keys), "full")
    since_resolved = F.col("_a").isNotNull() & (F.col("_r").isNull() | (F.col("_a") >= F.col("_r")))
    return both.where(since_resolved | (F.col("_held") & F.col("_r").isNull())).select(*keys)


def error_report(errors: DataFrame, as_of: str) -> DataFrame:
    """Errors of the last hour per severity, zeros kept."""
    recent = since(errors, as_of, 3600).groupBy("severity").agg(F.count("*").alias("n"))
    every = errors.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(recent, "severity", "left").select(
        "severity", F.coalesce("n", F.lit(0)).alias("n"))


def component_status(events: DataFrame) -> DataFrame:
    """Status per component from its latest event (component, ts, kind, severity)."""
    status = F.when(F.col("kind") == "reset", "healthy").when(
        F.col("severity").isin("high", "critical"), "degraded").otherwise("warning")
    return events.withColumn("_status", status).groupBy("component").agg(
        F.max_by("_status", F.struct("ts", "event_id")).alias("status"))


def recommendations(alerts: DataFrame, as_of: str) -> DataFrame:
    """Distinct advice of the last hour's alerts."""
    return since(alerts, as_of, 3600).select("recommendation").distinct()
