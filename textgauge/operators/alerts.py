"""Rule-based alerts: evaluation, cooldown, delivery table, lifecycle, statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shaping import alert_id, rule_message
from ..session import cut, small
from .ordered import SLICES, mark_chain, micros, next_at_or_after, slice_width
from .telemetry import at_time, since

# The rules a fresh monitor starts with.
DEFAULT_RULES = [
    ("cpu_high", "High CPU Usage", "CPU usage exceeds threshold", "cpu_percent", 85.0, ">",
     "warning", ["log", "email"], 5, True),
    ("cpu_critical", "Critical CPU Usage", "CPU usage critically high", "cpu_percent", 95.0, ">",
     "critical", ["log", "email", "webhook"], 2, True),
    ("memory_high", "High Memory Usage", "Memory usage exceeds threshold", "memory_percent", 85.0,
     ">", "warning", ["log", "email"], 5, True),
    ("memory_critical", "Critical Memory Usage", "Memory usage critically high", "memory_percent",
     95.0, ">", "critical", ["log", "email", "webhook"], 2, True),
    ("response_time_high", "High Response Time", "Response time exceeds acceptable threshold",
     "response_time_ms", 2000.0, ">", "warning", ["log"], 10, True),
]


def rules_table(spark: SparkSession, rules: Sequence[tuple] = DEFAULT_RULES) -> DataFrame:
    from ..schemas import ALERT_RULE

    return spark.createDataFrame(list(rules), ALERT_RULE)


def rule_hits(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Samples (metric_name, ts, value, …) that break an enabled rule; an unknown op never does."""
    v, t, op = F.col("value"), F.col("threshold"), F.col("op")
    broken = (F.when(op == ">", v > t).when(op == "<", v < t).when(op == ">=", v >= t)
              .when(op == "<=", v <= t).when(op == "==", v == t).when(op == "!=", v != t)
              .otherwise(False))
    return samples.join(rules.where("enabled"), "metric_name").where(broken)


def cooldown(hits: DataFrame, tie: str, last_emitted: DataFrame | None = None,
             max_rows: int = 500_000) -> DataFrame:
    """Hits that become alerts: per rule, none within its cooldown of the last *emitted* one.

    Each hit points to the first hit of its rule at least one cooldown later; the alerts are the
    path from the rule's first hit. Pointers come from a sliced look-ahead and the path from
    mark_chain, so a rule with most of the hits is spread over its time slices. last_emitted
    (rule_id, last_ts) continues from earlier alerts. The slices are the widest that hold at most
    max_rows instants of a rule.
    """
    pos = micros("ts")
    gap = F.col("cooldown_minutes").cast("bigint") * 60_000_000
    free = hits.where("cooldown_minutes <= 0")
    held = hits.where("cooldown_minutes > 0")
    points = cut(held.groupBy("rule_id", pos.alias("pos")).agg(F.first(gap).alias("gap")))
    width = slice_width(points, ["rule_id"], "pos", max_rows, SLICES)
    probes = points.select("rule_id", (F.col("pos") + F.col("gap")).alias("at"),
                           F.col("pos").alias("src"))
    targets = points.select("rule_id", F.col("pos").alias("at"), F.col("pos").alias("to"))
    nodes = next_at_or_after(targets, probes, ["rule_id"], "at", "to", width).select(
        "rule_id", F.col("src").alias("pos"), F.col("_next").alias("nxt"))
    open_ = points
    if last_emitted is not None:
        carry = last_emitted.select("rule_id", micros("last_ts").alias("_last"))
        open_ = points.join(small(carry), "rule_id", "left").where(
            F.col("_last").isNull() | (F.col("pos") - F.col("_last") >= F.col("gap")))
    starts = open_.groupBy("rule_id").agg(F.min("pos").alias("pos"))
    emitted = mark_chain(nodes, starts, "rule_id", width).withColumnRenamed("pos", "_pos")
    kept = held.withColumn("_pos", pos).join(emitted, ["rule_id", "_pos"], "left_semi")
    # Of several hits at one instant the first wins; (rule, instant) groups are tiny.
    rest = [c for c in held.columns if c != "rule_id"]
    one = kept.groupBy("rule_id", "_pos").agg(
        F.min_by(F.struct(*rest), tie).alias("_r")).select("rule_id", "_r.*")
    return one.select(*hits.columns).unionByName(free)


def make_alerts(emitted: DataFrame) -> DataFrame:
    """Alert rows with id, title and message."""
    return emitted.withColumns({
        "alert_id": alert_id("rule_id"), "title": F.col("name"), "message": rule_message(),
        "status": F.lit("active")})


def deliveries(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per alert and wanted channel; a missing or disabled channel fails."""
    wanted = alerts.select("alert_id", "rule_id", F.explode("channels").alias("channel"))
    return wanted.join(channels, "channel", "left").select(
        "alert_id", "rule_id", "channel", F.coalesce("enabled", F.lit(False)).alias("delivered"))


def lifecycle(events: DataFrame) -> DataFrame:
    """State per alert from its events (alert_id, ts, action, actor): active, acknowledged,
    resolved, with who acknowledged and when."""
    ack, res = F.col("action") == "acknowledged", F.col("action") == "resolved"
    first_ack = F.min(F.when(ack, F.struct("ts", "actor")))
    return events.groupBy("alert_id").agg(
        F.min(F.when(F.col("action") == "created", F.col("ts"))).alias("created_at"),
        first_ack.alias("_a"), F.min(F.when(res, F.col("ts"))).alias("resolved_at")).select(
        "alert_id", "created_at", F.col("_a.ts").alias("acknowledged_at"),
        F.col("_a.actor").alias("acknowledged_by"), "resolved_at",
        F.when(F.col("resolved_at").isNotNull(), "resolved")
        .when(F.col("_a").isNotNull(), "acknowledged").otherwise("active").alias("status"))


def active_alerts(alerts: DataFrame, model: str | None = None, severity: str | None = None,
                  limit: int | None = None, tie: str = "event_id") -> DataFrame:
    """Unresolved alerts, newest first."""
    out = alerts.where("NOT resolved")
    if model is not None:
        out = out.where(F.col("model_name") == model)
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    out = out.orderBy(F.col("ts").desc(), F.col(tie).desc())
    return out.limit(limit) if limit is not None else out


def alert_statistics(alerts: DataFrame, as_of: str) -> DataFrame:
    """Totals per severity: active, last 24 hours, all."""
    day = F.col("ts") >= at_time(as_of) - F.expr("INTERVAL 24 HOURS")
    return alerts.rollup("severity").agg(
        F.count_if(~F.col("resolved")).alias("active"), F.count_if(day).alias("recent_24h"),
        F.count("*").alias("history"))


def frequent_rules(alerts: DataFrame, as_of: str, n: int = 10) -> DataFrame:
    """The rules with most alerts in the last 24 hours."""
    return since(alerts, as_of, 86_400).groupBy("rule_id").agg(F.count("*").alias("alerts")).orderBy(
        F.desc("alerts"), "rule_id").limit(n)


def remediate(alerts: DataFrame, actions: dict[str, Callable[[DataFrame], None]]) -> list[str]:
    """Hand each rule's alerts to its remediation function; returns the rules that were run.

    For use in foreachBatch: the functions get the rule's alerts as a DataFrame. The alerts are
    computed once, and one look says which of the given rules have any.
    """
    mine = cut(alerts.where(F.col("rule_id").isin(list(actions))))
    found = {r[0] for r in mine.select("rule_id").distinct().collect()}  # the given rules at most
    for rule in (r for r in actions if r in found):
        actions[rule](mine.where(F.col("rule_id") == rule))
    return [r for r in actions if r in found]
