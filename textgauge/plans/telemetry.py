"""Model and host telemetry over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shaping
from ..operators import health, ordered
from ..operators import telemetry as tm
from .fixtures import (AS_OF, HOSTS_SQL, SNAPSHOTS_SQL, TELEMETRY_SQL, hosts, rounded, snapshots,
                       telemetry)

DAY = 86_400
NOW = f"TIMESTAMP '{AS_OF}'"


def us(df, *names):
    return df.withColumns({n: F.unix_micros(n) for n in names})


def window(spark, sf):
    out = tm.window_stats(telemetry(spark, sf), AS_OF, 2 * DAY)
    return us(rounded(out, "avg_response_time", "max_response_time", "min_response_time",
                      "response_time_std", "avg_confidence", "min_confidence", "max_confidence",
                      "confidence_std"), "latest_prediction")


WINDOW_SQL = f"""
  SELECT model_name, count(*) AS prediction_count,
    round(avg(prediction_time), 6) AS avg_response_time,
    round(max(prediction_time), 6) AS max_response_time,
    round(min(prediction_time), 6) AS min_response_time,
    round(coalesce(stddev_samp(prediction_time), 0), 6) AS response_time_std,
    round(avg(confidence), 6) AS avg_confidence,
    round(CAST(min(confidence) AS DOUBLE), 6) AS min_confidence,
    round(CAST(max(confidence) AS DOUBLE), 6) AS max_confidence,
    round(coalesce(stddev_samp(confidence), 0), 6) AS confidence_std,
    epoch_us(max(ts)) AS latest_prediction
  FROM ({TELEMETRY_SQL}) e WHERE ts >= {NOW} - INTERVAL 2 DAY GROUP BY 1"""


def metrics(spark, sf):
    out = tm.model_metrics(telemetry(spark, sf), snapshots(spark, sf), AS_OF, 2 * DAY)
    return rounded(out.select("model_name", "prediction_count", "avg_response_time", "accuracy",
                              "f1_score", "mae", "rmse", "error_rate"),
                   "avg_response_time", "accuracy", "f1_score", "mae", "rmse", "error_rate")


METRICS_SQL = f"""
  WITH s AS (SELECT * FROM ({SNAPSHOTS_SQL}) q QUALIFY row_number() OVER (PARTITION BY model_name
               ORDER BY ts DESC) = 1),
  w AS (SELECT model_name, count(*) AS prediction_count, avg(prediction_time) AS a
        FROM ({TELEMETRY_SQL}) e WHERE ts >= {NOW} - INTERVAL 2 DAY GROUP BY 1)
  SELECT model_name, prediction_count, round(a, 6) AS avg_response_time,
    round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score, round(mae, 6) AS mae,
    round(rmse, 6) AS rmse, round(error_rate, 6) AS error_rate FROM w LEFT JOIN s USING (model_name)"""


def created(spark, sf):
    quality = snapshots(spark, sf).withColumn(
        "error_rate", F.when(F.col("error_rate") > 0.04, F.col("error_rate")))
    out = tm.create_snapshots(quality, telemetry(spark, sf), 6 * 3600)
    return us(rounded(out.select("model_name", "ts", "accuracy", "avg_response_time",
                                 "avg_confidence", "error_rate", "prediction_count"),
                      "accuracy", "avg_response_time", "avg_confidence", "error_rate"), "ts")


CREATED_SQL = f"""
  SELECT q.model_name, epoch_us(q.ts) AS ts, round(any_value(accuracy), 6) AS accuracy,
    round(avg(e.prediction_time), 6) AS avg_response_time,
    round(avg(e.confidence), 6) AS avg_confidence,
    round(CAST(any_value(CASE WHEN error_rate > 0.04 THEN error_rate ELSE 0 END) AS DOUBLE), 6)
      AS error_rate,
    count(e.event_id) AS prediction_count
  FROM ({SNAPSHOTS_SQL}) q LEFT JOIN ({TELEMETRY_SQL}) e ON e.model_name = q.model_name
    AND e.ts <= q.ts AND e.ts >= q.ts - INTERVAL 6 HOUR GROUP BY q.model_name, q.ts"""


def asof_quality(spark, sf):
    """Every event with the accuracy of its model's latest snapshot at that time."""
    quality = snapshots(spark, sf).where("accuracy IS NOT NULL").select(
        "model_name", "ts", "accuracy")
    out = ordered.asof(telemetry(spark, sf).select("model_name", "ts", "event_id"), quality,
                       ["model_name"], "ts", "accuracy")
    return rounded(out.select("event_id", "model_name", "accuracy"), "accuracy")


ASOF_SQL = f"""
  SELECT event_id, e.model_name, round(accuracy, 6) AS accuracy
  FROM ({TELEMETRY_SQL}) e ASOF LEFT JOIN (SELECT * FROM ({SNAPSHOTS_SQL}) q
    WHERE accuracy IS NOT NULL) s ON e.model_name = s.model_name AND e.ts >= s.ts"""


def tier_sql(source: str, tiers: dict) -> str:
    rows = ", ".join(f"('{m}', '{d}', CAST({w} AS DOUBLE), CAST({c} AS DOUBLE))"
                     for m, (d, w, c) in tiers.items())
    past = "CASE WHEN direction = 'above' THEN value > {0} ELSE value < {0} END"
    return f"""SELECT *, CASE WHEN {past.format('critical')} THEN critical ELSE warning END
      AS threshold FROM (SELECT *, CASE WHEN {past.format('critical')} THEN 'critical'
      WHEN {past.format('warning')} THEN 'warning' END AS severity
      FROM ({source}) x JOIN (VALUES {rows}) AS t(metric_name, direction, warning, critical)
      USING (metric_name)) y WHERE severity IS NOT NULL"""


def snapshot_alerts(spark, sf):
    long = tm.long_metrics(snapshots(spark, sf), ["model_name", "ts"], {
        "accuracy": "accuracy", "f1_score": "f1_score", "mae": "mae", "rmse": "rmse"})
    alerts = tm.tiered_alerts(long, tm.tiers_table(spark, tm.MODEL_TIERS))
    out = alerts.select(shaping.alert_id("model_name", "metric_name").alias("alert_id"),
                        "model_name", "metric_name", "value", "severity", "threshold")
    return rounded(out, "value")


SNAPSHOT_ALERTS_SQL = f"""
  SELECT model_name || '_' || metric_name || '_' || CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)
    AS alert_id, model_name, metric_name, round(value, 6) AS value, severity, threshold FROM (
  {tier_sql(f'''SELECT model_name, ts, metric_name, value FROM (SELECT model_name, ts, accuracy,
    f1_score, mae, rmse FROM ({SNAPSHOTS_SQL}) s) w UNPIVOT (value FOR metric_name IN
    (accuracy, f1_score, mae, rmse))''', tm.MODEL_TIERS)}) z"""


def host_alerts(spark, sf):
    long = tm.long_metrics(hosts(spark, sf), ["event_id", "host"], {
        "cpu_percent": "cpu_percent", "memory_percent": "memory_percent",
        "disk_usage_percent": "disk_usage_percent"})
    return rounded(tm.tiered_alerts(long, tm.tiers_table(spark, tm.HOST_TIERS)), "value")


def prediction_alerts(spark, sf):
    return rounded(tm.event_alerts(telemetry(spark, sf)).drop("ts"), "value")


PREDICTION_ALERTS_SQL = f"""
  WITH e AS ({TELEMETRY_SQL}),
  a AS (SELECT event_id, model_name, 'response_time' AS metric_name, prediction_time AS value,
      CASE WHEN prediction_time > 2000 THEN 'critical' ELSE 'warning' END AS severity
    FROM e WHERE prediction_time > 1000
    UNION ALL SELECT event_id, model_name, 'confidence', CAST(confidence AS DOUBLE),
      CASE WHEN confidence < 0.5 THEN 'critical' ELSE 'warning' END
    FROM e WHERE confidence < 0.6)
  SELECT event_id, model_name, metric_name, round(value, 6) AS value, severity,
    CAST(CASE WHEN metric_name = 'confidence' THEN CASE severity WHEN 'critical' THEN 0.5 ELSE 0.6
      END ELSE CASE severity WHEN 'critical' THEN 2000 ELSE 1000 END END AS DOUBLE) AS threshold,
    CASE WHEN metric_name = 'confidence' THEN 'Confidence ' || printf('%.3f', value) || ' below '
      ELSE 'Response time ' || printf('%.1f', value) || 'ms exceeds ' END || severity || ' threshold'
      AS message FROM a"""


def degraded(spark, sf):
    out = tm.degradation(snapshots(spark, sf))
    return rounded(out, "accuracy_drop", "f1_score_drop", "mae_rise", "avg_confidence_drop")


def degraded_early(spark, sf):
    """The same check on every model's first days: fewer than five snapshots, then exactly five."""
    out = None
    for days in (1, 2, 4, 5, 6):
        part = tm.degradation(snapshots(spark, sf).where(
            F.col("ts") <= F.lit("2024-01-01").cast("timestamp")
            + F.make_dt_interval(days=F.lit(days)))).withColumn("days", F.lit(days))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "accuracy_drop", "f1_score_drop", "mae_rise", "avg_confidence_drop")


def degraded_sql(where: str = "true") -> str:
    return f"""
  WITH s AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY ts) AS r,
      count(*) OVER (PARTITION BY model_name) AS n FROM ({SNAPSHOTS_SQL}) q WHERE {where}),
  b AS (SELECT model_name, any_value(n) AS snapshots,
      {', '.join(f'avg({m}) FILTER (WHERE CASE WHEN n >= 5 THEN r <= 5 ELSE r < n END) AS b_{m}, '
                 f'max({m}) FILTER (WHERE r = n) AS l_{m}' for m in tm.WATCHED)}
    FROM s GROUP BY 1),
  d AS (SELECT model_name, snapshots,
      {', '.join(f'CASE WHEN b_{m} > 0 THEN {sign}.0 * (l_{m} - b_{m}) / b_{m} END AS d_{m}'
                 for m, sign in tm.WATCHED.items())} FROM b)
  SELECT model_name, snapshots, round(d_accuracy, 6) AS accuracy_drop,
    round(d_f1_score, 6) AS f1_score_drop, round(d_mae, 6) AS mae_rise,
    round(d_avg_confidence, 6) AS avg_confidence_drop,
    snapshots >= 2 AND ({' OR '.join(f'coalesce(d_{m} > 0.1, false)' for m in tm.WATCHED)})
      AS retrain FROM d"""


DEGRADED_EARLY_SQL = " UNION ALL ".join(
    f"SELECT *, {d} AS days FROM (" + degraded_sql(
        f"ts <= TIMESTAMP '2024-01-01' + INTERVAL {d} DAY") + f") z{d}" for d in (1, 2, 4, 5, 6))


def alert_table(spark, sf):
    """Prediction alerts as a table, some of them resolved."""
    return tm.event_alerts(telemetry(spark, sf)).withColumn("resolved", F.col("event_id") % 3 == 0)


ALERT_TABLE_SQL = f"""SELECT p.*, e.ts, p.event_id % 3 = 0 AS resolved
  FROM ({PREDICTION_ALERTS_SQL}) p JOIN ({TELEMETRY_SQL}) e USING (event_id)"""


def summary(spark, sf):
    return tm.monitor_summary(telemetry(spark, sf), snapshots(spark, sf), alert_table(spark, sf),
                              AS_OF, 2 * DAY)


SUMMARY_SQL = f"""
  WITH a AS (SELECT model_name, count(*) AS active_alerts,
      count_if(severity = 'critical') AS critical, count_if(severity = 'warning') AS warning
    FROM ({ALERT_TABLE_SQL}) t WHERE NOT resolved GROUP BY 1),
  m AS (SELECT model_name, count_if(ts >= {NOW} - INTERVAL 2 DAY) AS prediction_count
        FROM ({TELEMETRY_SQL}) e GROUP BY 1),
  d AS (SELECT model_name, retrain FROM ({degraded_sql()}) x)
  SELECT model_name, prediction_count, coalesce(active_alerts, 0) AS active_alerts,
    coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning,
    coalesce(retrain, false) AS retrain
  FROM m LEFT JOIN a USING (model_name) LEFT JOIN d USING (model_name)"""


def retained(n, seconds):
    def run(spark, sf):
        out = tm.retain_newest(telemetry(spark, sf).select("event_id", "model_name", "ts"),
                               ["model_name"], n, "event_id", AS_OF, seconds)
        return out.select("event_id", "model_name")
    return run


def retained_tables(spark, sf):
    """What each table of the service keeps at the published limits, all in one: table, key, entry."""
    from .fixtures import calls, logs
    e = telemetry(spark, sf)
    entry = lambda df, key, name, tie: df.select(F.col(key).cast("string").alias("key"), "ts", F.lit(name).alias("part"),
                                                 F.col(tie).alias("entry"))
    tables = {
        "metrics": entry(e, "model_name", "metrics", "event_id"),
        "snapshots": entry(snapshots(spark, sf).withColumn("day", F.dayofyear("ts").cast("bigint")), "model_name", "snapshots", "day"),
        "hosts": entry(hosts(spark, sf).withColumn("all", F.lit("host")), "all", "hosts", "event_id"),
        "health": entry(component_rows(spark, sf), "component", "health", "event_id"),
        "calls": entry(calls(spark, sf), "circuit", "calls", "call_id"),
        "actions": entry(e.withColumn("all", F.lit("actions")), "all", "actions", "event_id"),
        "logs": entry(logs(spark, sf).withColumn("all", F.lit("logs")).withColumn(
            "entry", F.col("conv_id") * 1000 + F.col("turn")), "all", "logs", "entry")}
    out = None
    for df in tm.retain_all({n: (df, ["key"], "entry") for n, df in tables.items()}, AS_OF, 10 * DAY).values():
        part = df.select("part", "key", F.col("entry").cast("bigint").alias("entry"))
        out = part if out is None else out.unionByName(part)
    return out


def retained_sql() -> str:
    from .fixtures import CALLS_SQL, LOGS_SQL
    parts = {
        "metrics": (f"SELECT model_name AS key, ts, event_id AS entry FROM ({TELEMETRY_SQL}) e WHERE ts >= {NOW} - INTERVAL 20 DAY"),
        "snapshots": f"SELECT model_name AS key, ts, dayofyear(ts) AS entry FROM ({SNAPSHOTS_SQL}) e",
        "hosts": f"SELECT 'host' AS key, ts, event_id AS entry FROM ({HOSTS_SQL}) e",
        "health": f"SELECT component AS key, ts, event_id AS entry FROM ({COMPONENTS_SQL}) e",
        "calls": f"SELECT circuit AS key, ts, call_id AS entry FROM ({CALLS_SQL}) e",
        "actions": f"SELECT 'actions' AS key, ts, event_id AS entry FROM ({TELEMETRY_SQL}) e",
        "logs": f"SELECT 'logs' AS key, ts, conv_id * 1000 + turn AS entry FROM ({LOGS_SQL}) e"}
    return " UNION ALL ".join(f"""
  SELECT * FROM (SELECT '{n}' AS part, CAST(key AS VARCHAR) AS key, CAST(entry AS BIGINT) AS entry FROM ({sql}) x
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, entry DESC) <= {tm.RETAINED[n]}) r""" for n, sql in parts.items())


def retained_alerts(spark, sf):
    out = tm.retain_alerts(alert_table(spark, sf).withColumn(
        "tie", F.concat_ws("/", F.lpad(F.col("event_id").cast("string"), 9, "0"), "metric_name")),
        "tie")
    return out.select("event_id", "metric_name", "resolved")


RETAINED_ALERTS_SQL = f"""
  WITH t AS ({ALERT_TABLE_SQL})
  SELECT event_id, metric_name, resolved FROM t WHERE NOT resolved
  UNION ALL SELECT * FROM (SELECT event_id, metric_name, resolved FROM t WHERE resolved
    ORDER BY ts DESC, lpad(CAST(event_id AS VARCHAR), 9, '0') || '/' || metric_name DESC
    LIMIT 500) r"""


def host_summary(spark, sf):
    return rounded(health.health_summary(hosts(spark, sf), ["host"], AS_OF, DAY),
                   "current_cpu_percent", "current_memory_percent", "current_disk_usage_percent")


HOST_SUMMARY_SQL = f"""
  SELECT host, count(*) AS sample_count,
    {', '.join(f'round(avg({c}), 2) AS avg_{c}, round(CAST(arg_max({c}, (ts, event_id)) AS DOUBLE), 6)'
               f' AS current_{c}' for c in ('cpu_percent', 'memory_percent', 'disk_usage_percent'))}
  FROM ({HOSTS_SQL}) h WHERE ts >= {NOW} - INTERVAL 1 DAY GROUP BY 1"""


def host_trends(spark, sf):
    # Many small series: each user is a host here.
    df = hosts(spark, sf).withColumn("host", F.concat_ws("/", "host", F.col(
        "memory_percent").cast("int").cast("string")))
    return health.trends(df, ["host"], ["cpu_percent", "disk_usage_percent"])


HOST_TRENDS_SQL = f"""
  WITH h AS (SELECT host || '/' || CAST(memory_percent AS INTEGER) AS host, ts, event_id,
      cpu_percent, disk_usage_percent FROM ({HOSTS_SQL}) x),
  r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS rn,
      count(*) OVER (PARTITION BY host) AS n FROM h),
  g AS (SELECT host, any_value(n) AS n,
      {', '.join(f'avg({c}) FILTER (WHERE rn <= n // 2) AS a{i}, '
                 f'avg({c}) FILTER (WHERE rn > n // 2) AS b{i}'
                 for i, c in enumerate(('cpu_percent', 'disk_usage_percent')))}
    FROM r WHERE n >= 2 GROUP BY 1),
  c AS (SELECT host, n, {', '.join(f'CASE WHEN a{i} > 0 THEN (b{i} - a{i}) / a{i} * 100 ELSE 0 END AS c{i}'
                                   for i in (0, 1))} FROM g)
  SELECT host, n, {', '.join(f"CASE WHEN abs(c{i}) < 5 THEN 'stable' WHEN c{i} > 0 THEN 'increasing' ELSE 'decreasing' END AS {m}_trend"
                             for i, m in enumerate(('cpu_percent', 'disk_usage_percent')))} FROM c"""


def component_rows(spark, sf):
    """Host samples as component checks."""
    v = F.col("cpu_percent")
    return hosts(spark, sf).select(
        F.col("host").alias("component"), "ts", "event_id",
        F.when(v >= 97, "critical").when(v >= 90, "unhealthy").when(v >= 80, "degraded")
        .otherwise("healthy").alias("status"),
        (F.col("disk_usage_percent") * 100).alias("response_time_ms"),
        F.concat(F.lit("cpu "), F.round(v).cast("int").cast("string")).alias("message"))


COMPONENTS_SQL = f"""SELECT host AS component, ts, event_id,
  CASE WHEN cpu_percent >= 97 THEN 'critical' WHEN cpu_percent >= 90 THEN 'unhealthy'
    WHEN cpu_percent >= 80 THEN 'degraded' ELSE 'healthy' END AS status,
  disk_usage_percent * 100 AS response_time_ms,
  'cpu ' || CAST(round(cpu_percent) AS INTEGER) AS message FROM ({HOSTS_SQL}) h"""
COMPONENT_ALERTS_SQL = f"""
  SELECT component, ts, event_id,
    CASE WHEN response_time_ms > 5000 THEN 'critical' ELSE 'warning' END AS severity,
    'Response time ' || printf('%.1f', response_time_ms) || 'ms exceeds '
      || CASE WHEN response_time_ms > 5000 THEN 'critical' ELSE 'warning' END || ' threshold'
      AS alert_message FROM ({COMPONENTS_SQL}) c WHERE response_time_ms > 1000
  UNION ALL SELECT component, ts, event_id,
    CASE status WHEN 'critical' THEN 'critical' ELSE 'warning' END,
    CASE status WHEN 'critical' THEN 'Component is in critical state: '
      ELSE 'Component is unhealthy: ' END || message
  FROM ({COMPONENTS_SQL}) c WHERE status IN ('critical', 'unhealthy')"""


def day_status(spark, sf):
    rows = component_rows(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return health.worst_status(rows.withColumn(
        "status", F.when(F.col("status") == "critical", F.when(
            F.col("event_id") % 3 == 0, "critical").otherwise("degraded")).otherwise(
            F.col("status"))), ["component", "day"])


DAY_STATUS_SQL = f"""
  SELECT component, day, list_extract(['healthy', 'degraded', 'unhealthy', 'critical'],
    max(list_position(['healthy', 'degraded', 'unhealthy', 'critical'], s))) AS overall_status
  FROM (SELECT component, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN status = 'critical' THEN
      CASE WHEN event_id % 3 = 0 THEN 'critical' ELSE 'degraded' END ELSE status END AS s
    FROM ({COMPONENTS_SQL}) c) x GROUP BY 1, 2"""


def alert_rows(spark, sf):
    return health.component_alerts(component_rows(spark, sf))


def raised(spark, sf, whole=False):
    """Alerts that are raised when a healthy sample resolves its component's open ones."""
    alerts = alert_rows(spark, sf)
    if not whole:
        alerts = alerts.withColumn("alert_message", F.regexp_replace("alert_message", "[0-9.]+", "N"))
    keys = ["component", "severity", "alert_message"]
    resolved = component_rows(spark, sf).where(
        (F.col("status") == "healthy") & (F.col("event_id") % 6 == 0)).select("component", "ts")
    out = health.suppress_repeats(alerts, resolved, keys, resolved_by=["component"])
    return out.select("event_id", *keys)


RAISED_SQL = f"""
  WITH a AS (SELECT component, ts, event_id, severity,
      regexp_replace(alert_message, '[0-9.]+', 'N', 'g') AS alert_message
    FROM ({COMPONENT_ALERTS_SQL}) x),
  r AS (SELECT component, ts FROM ({COMPONENTS_SQL}) c WHERE status = 'healthy'
        AND event_id % 6 = 0),
  s AS (SELECT a.*, r.ts AS last FROM a ASOF LEFT JOIN r ON a.component = r.component
        AND a.ts >= r.ts)
  SELECT event_id, component, severity, alert_message FROM s
  QUALIFY row_number() OVER (PARTITION BY component, severity, alert_message, last
    ORDER BY ts, event_id) = 1"""


#: By the whole message, numbers and all.
RAISED_WHOLE_SQL = RAISED_SQL.replace("regexp_replace(alert_message, '[0-9.]+', 'N', 'g') AS alert_message", "alert_message")


def system_status(spark, sf):
    out = hosts(spark, sf).withColumn("open", (F.col("event_id") % 5).cast("int"))
    return out.select("event_id", health.system_health(
        F.col("memory_percent"), F.col("cpu_percent"), F.col("open"), F.lit(6)).alias("health"))


SYSTEM_SQL = f"""SELECT event_id, CASE WHEN memory_percent >= 95 THEN 'emergency'
    WHEN memory_percent >= 90 THEN 'critical' WHEN memory_percent >= 80 THEN 'degraded'
    WHEN cpu_percent >= 95 THEN 'critical' WHEN cpu_percent >= 85 THEN 'degraded'
    WHEN event_id % 5 > 0 AND event_id % 5 >= 3 THEN 'critical'
    WHEN event_id % 5 > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM ({HOSTS_SQL}) h"""


def handled(spark, sf):
    """Events as handled errors, some of them resets."""
    i = F.col("event_id")
    return telemetry(spark, sf).select(
        "event_id", "ts", F.col("model_name").alias("component"),
        F.element_at(F.array(*[F.lit(s) for s in health.SEVERITIES]),
                     (i % 4 + 1).cast("int")).alias("severity"),
        F.when(i % 10 == 0, "reset").otherwise("error").alias("kind"))


HANDLED_SQL = f"""SELECT event_id, ts, model_name AS component,
  list_extract(['low', 'medium', 'high', 'critical'], event_id % 4 + 1) AS severity,
  CASE WHEN event_id % 10 = 0 THEN 'reset' ELSE 'error' END AS kind FROM ({TELEMETRY_SQL}) e"""


def advice(spark, sf):
    from ..operators.evaluate import ADVICE, OTHER_ADVICE
    alerts = tm.event_alerts(telemetry(spark, sf)).withColumn(
        "recommendation", F.when(F.col("metric_name") == "confidence", ADVICE["accuracy"])
        .otherwise(OTHER_ADVICE))
    return health.recommendations(alerts, "2024-01-30 12:00:00")


RETAINED_SQL = retained_sql()


QUERIES = {
    "agg_window_statistics": (window, WINDOW_SQL),
    "join_metrics_with_snapshot": (metrics, METRICS_SQL),
    "ml_create_snapshots": (created, CREATED_SQL),
    "join_asof_snapshot": (asof_quality, ASOF_SQL),
    "join_snapshot_tiers": (snapshot_alerts, SNAPSHOT_ALERTS_SQL),
    "join_host_tiers": (host_alerts, f"""SELECT metric_name, event_id, host,
      round(value, 6) AS value, severity, threshold FROM (""" + tier_sql(
        f"""SELECT event_id, host, metric_name, CAST(value AS DOUBLE) AS value FROM (
          SELECT event_id, host, CAST(cpu_percent AS DOUBLE) AS cpu_percent, memory_percent,
          disk_usage_percent FROM ({HOSTS_SQL}) h) w
          UNPIVOT (value FOR metric_name IN (cpu_percent, memory_percent, disk_usage_percent))""",
        tm.HOST_TIERS) + ") z"),
    "str_event_alerts_batch": (prediction_alerts, PREDICTION_ALERTS_SQL),
    "win_degradation": (degraded, degraded_sql()),
    "win_degradation_early": (degraded_early, DEGRADED_EARLY_SQL),
    "agg_monitor_summary": (summary, SUMMARY_SQL),
    "agg_alert_totals": (
        lambda spark, sf: tm.alert_totals(alert_table(spark, sf)),
        f"""SELECT count(*) AS total, count_if(NOT resolved) AS active,
          count_if(NOT resolved AND severity = 'critical') AS critical,
          count_if(NOT resolved AND severity = 'warning') AS warning
        FROM ({ALERT_TABLE_SQL}) t"""),
    "win_retain_metrics": (retained(1000, 20 * DAY), f"""
      SELECT event_id, model_name FROM ({TELEMETRY_SQL}) e WHERE ts >= {NOW} - INTERVAL 20 DAY
      QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY ts DESC, event_id DESC) <= 1000"""),
    "win_retain_alerts": (retained_alerts, RETAINED_ALERTS_SQL),
    "fil_time_window": (
        lambda spark, sf: tm.since(telemetry(spark, sf), AS_OF, 3 * DAY).select("event_id"),
        f"SELECT event_id FROM events WHERE ts >= {NOW} - INTERVAL 3 DAY"),
    "agg_host_summary": (host_summary, HOST_SUMMARY_SQL),
    "win_host_trends": (host_trends, HOST_TRENDS_SQL),
    "agg_worst_status": (day_status, DAY_STATUS_SQL),
    "join_component_alerts": (
        lambda spark, sf: alert_rows(spark, sf).drop("ts"),
        f"SELECT component, event_id, severity, alert_message FROM ({COMPONENT_ALERTS_SQL}) x"),
    "win_suppress_repeats": (raised, RAISED_SQL),
    "win_suppress_whole_message": (lambda spark, sf: raised(spark, sf, whole=True), RAISED_WHOLE_SQL),
    "win_retain_published": (retained_tables, RETAINED_SQL),
    "agg_system_health": (system_status, SYSTEM_SQL),
    "agg_error_report": (
        lambda spark, sf: health.error_report(
            handled(spark, sf), "2024-01-30 12:00:00"),
        f"""SELECT s.severity, count(h.event_id) AS n FROM (SELECT unnest(['low', 'medium', 'high',
          'critical']) AS severity) s LEFT JOIN ({HANDLED_SQL}) h ON h.severity = s.severity
          AND h.ts >= TIMESTAMP '2024-01-30 11:00:00' GROUP BY 1"""),
    "agg_component_status": (
        lambda spark, sf: health.component_status(handled(spark, sf)),
        f"""SELECT component, CASE WHEN kind = 'reset' THEN 'healthy' WHEN severity IN ('high',
          'critical') THEN 'degraded' ELSE 'warning' END AS status FROM ({HANDLED_SQL}) h
        QUALIFY row_number() OVER (PARTITION BY component ORDER BY ts DESC, event_id DESC) = 1"""),
    "agg_recommendations": (advice, f"""
      SELECT DISTINCT CASE WHEN metric_name = 'confidence'
        THEN 'Consider retraining with more data or different features'
        ELSE 'Review system performance and consider optimization' END AS recommendation
      FROM ({ALERT_TABLE_SQL}) t WHERE ts >= TIMESTAMP '2024-01-30 11:00:00'"""),
}
