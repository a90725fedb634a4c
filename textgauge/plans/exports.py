"""Exports and stores: the tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache
from ..operators import ensemble as en
from ..operators import logs
from ..session import scratch
from ..sources import io, snapshot
from .ensembles import REPORTS_SQL, START_SQL, reports, start_weights
from .fixtures import AS_OF, HOSTS_SQL, LOGS_SQL, PROBLEMS_SQL, SNAPSHOTS_SQL, TELEMETRY_SQL
from .fixtures import hosts, problems, rounded, snapshots, table, telemetry
from .fixtures import logs as log_table
from .service import HITS_SQL, marked_hits
from .telemetry import us


def problem_rows(spark, sf):
    """The labelled documents written as JSON lines and read as problems."""
    path = scratch(spark, "problems")
    problems(spark, sf).select(
        F.col("problem_id").cast("string").alias("title"), "description",
        F.col("input_desc").alias("input_description"),
        F.col("output_desc").alias("output_description"), "problem_class", "problem_score",
    ).write.json(path)
    return io.read_problems(spark, path).select(
        "title", F.md5("description").alias("digest"), "input_desc", "output_desc",
        "problem_class", "problem_score_scaled")


def request_rows(spark, sf):
    """The benchmark texts as a request file."""
    path = scratch(spark, "requests")
    table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("request_id"), F.col("text").alias("description"),
        F.lit("").alias("input_desc")).write.json(path)
    return io.read_requests(spark, path).select(
        "request_id", F.md5("description").alias("digest"), "input_desc", "output_desc")


def metric_export(model):
    def run(spark, sf):
        path = scratch(spark, "export")
        io.export_telemetry({
            "metrics": telemetry(spark, sf).select("model_name", "event_id", "ts"),
            "snapshots": snapshots(spark, sf)}, path, model)
        m = spark.read.json(f"{path}/metrics").select(
            F.lit("metrics").alias("part"), "model_name")
        s = spark.read.json(f"{path}/snapshots").select(
            F.lit("snapshots").alias("part"), "model_name")
        return m.unionByName(s).groupBy("part", "model_name").agg(F.count("*").alias("n"))
    return run


def metric_export_sql(where: str) -> str:
    return f"""
  SELECT 'metrics' AS part, model_name, count(*) AS n FROM ({TELEMETRY_SQL}) e WHERE {where}
    GROUP BY 2
  UNION ALL SELECT 'snapshots', model_name, count(*) FROM ({SNAPSHOTS_SQL}) s WHERE {where}
    GROUP BY 2"""


def log_export(fmt):
    def run(spark, sf):
        path = scratch(spark, "logs")
        rows = log_table(spark, sf).select(
            F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string")
            .alias("turn"), "level", "message",
            F.create_map(F.lit("role"), F.col("event_type")).alias("metadata"))
        io.export_logs(rows, path, fmt)
        if fmt == "json":
            back = spark.read.schema(rows.schema).json(path).withColumn(
                "metadata", F.to_json("metadata"))
        else:
            back = spark.read.option("header", True).option("escape", '"').option(
                "multiLine", True).csv(path)
        return back.select("conv_id", "turn", "level", "metadata",
                           F.md5("message").alias("digest"))
    return run


LOG_EXPORT_SQL = f"""SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
  level, '{{"role":"' || event_type || '"}}' AS metadata, md5(message) AS digest
  FROM ({LOGS_SQL}) l"""


def alert_export(spark, sf):
    path = scratch(spark, "alerts")
    hits = marked_hits(spark, sf)
    io.export_tables({"active": hits.where("NOT resolved"), "history": hits}, path)
    parts = [spark.read.json(f"{path}/{p}").select(F.lit(p).alias("part"), "rule_id")
             for p in ("active", "history")]
    return parts[0].unionByName(parts[1]).groupBy("part", "rule_id").agg(F.count("*").alias("n"))


def health_export(spark, sf):
    path = scratch(spark, "health")
    io.export_tables({"hosts": hosts(spark, sf)}, path)
    back = spark.read.schema(hosts(spark, sf).schema).json(f"{path}/hosts")
    return rounded(back.groupBy("host").agg(
        F.count("*").alias("n"), F.avg("cpu_percent").alias("cpu")), "cpu")


def stored_weights(spark, sf):
    """Two versions of the weights appended; the newest one is read."""
    path = scratch(spark, "weights")
    first = start_weights(spark, sf)
    io.save_weights(first, path, 1)
    io.save_weights(en.reset_weights(first), path, 2)
    old = io.load_weights(spark, path, 1).withColumn("version", F.lit("1"))
    return rounded(io.load_weights(spark, path).withColumn(
        "version", F.lit("newest")).unionByName(old), "weight")


def restored(spark, sf):
    """Training snapshots appended in two steps; the newest per type is restored."""
    path = scratch(spark, "backups")
    rows = reports(spark, sf).select(
        F.col("model_name").alias("data_type"),
        F.format_string("%.6f", "value").alias("content"), F.col("ts").alias("created_at"))
    half = F.lit("2024-01-16").cast("timestamp")
    io.append_backup(rows.where(F.col("created_at") < half), path)
    io.append_backup(rows.where(F.col("created_at") >= half), path)
    out = cache.newest_backup(spark.read.parquet(path))
    return us(out.select("data_type", "content", "created_at", "size_bytes"), "created_at")


def recovery_export(spark, sf):
    """The recovery actions written with the other tables, and read back."""
    path = scratch(spark, "recovery")
    actions = recovery_actions(spark, sf)
    io.export_tables({"actions": actions}, path)
    back = spark.read.schema(actions.schema).json(f"{path}/actions")
    return back.groupBy("action", "success").agg(F.count("*").alias("n"), F.min(F.unix_micros("ts")).alias("first"))


def recovery_actions(spark, sf):
    i = F.col("event_id")
    return telemetry(spark, sf).select(
        "event_id", "ts", F.when(i % 3 == 0, "retry").when(i % 3 == 1, "fallback").otherwise("cache").alias("action"),
        (F.col("confidence") > 0.4).alias("success"))


def state_tables(spark, sf):
    """All that the service exports: ensemble, telemetry, alerts, health and recovery, with their histories and statistics."""
    from ..operators import alerts as al
    from ..operators import health, recovery, telemetry as tm
    from .service import RULES
    from .telemetry import alert_rows, alert_table, component_rows
    hits, actions = marked_hits(spark, sf), recovery_actions(spark, sf)
    return {
        "ensemble_weights": start_weights(spark, sf), "ensemble_history": reports(spark, sf),
        "metrics": telemetry(spark, sf), "snapshots": snapshots(spark, sf), "metric_alerts": alert_table(spark, sf),
        "alerts_active": hits.where("NOT resolved"), "alerts_history": hits, "alert_rules": al.rules_table(spark, RULES),
        "alert_statistics": tm.alert_totals(alert_table(spark, sf)),
        "health_hosts": hosts(spark, sf), "health_components": component_rows(spark, sf), "health_alerts": alert_rows(spark, sf),
        "recovery_actions": actions,
        "recovery_statistics": actions.groupBy("action").agg(F.count("*").alias("total"), F.count_if("success").alias("successes")),
        "recovery_metrics": hosts(spark, sf).drop("host")}


def state_export(spark, sf):
    """The state exported whole, a second export that stops before its manifest, and what a reader then finds."""
    path = scratch(spark, "state")
    tables = state_tables(spark, sf)
    n = tables["metrics"].count()
    snapshot.save_state(spark, path, tables, {"min_weight": en.MIN_WEIGHT, "weight_decay": en.DECAY, "weight_boost": en.BOOST,
                                              "prediction_count": n}, AS_OF)
    snapshot.write_tables(f"{path}/export-stopped", {"metrics": tables["metrics"].limit(0), "snapshots": tables["snapshots"]})
    found, settings = snapshot.load_state(spark, path)
    out = spark.createDataFrame([(f"settings.{k}", float(v)) for k, v in settings.items()], "part string, n double")
    for name, df in found.items():
        out = out.unionByName(df.agg(F.count("*").cast("double").alias("n")).select(F.lit(name).alias("part"), "n"))
    sums = found["recovery_statistics"].select(F.concat_ws(".", F.lit("recovered"), "action").alias("part"),
                                               F.col("successes").cast("double").alias("n"))
    return rounded(out.unionByName(sums), "n")


def state_export_sql() -> str:
    from .service import RULES
    from .telemetry import ALERT_TABLE_SQL, COMPONENT_ALERTS_SQL, COMPONENTS_SQL
    counts = {"ensemble_weights": START_SQL, "ensemble_history": REPORTS_SQL, "metrics": TELEMETRY_SQL, "snapshots": SNAPSHOTS_SQL,
              "metric_alerts": ALERT_TABLE_SQL, "alerts_active": f"SELECT * FROM ({HITS_SQL}) h WHERE event_id % 3 <> 0",
              "alerts_history": HITS_SQL, "alert_rules": f"SELECT unnest(range({len(RULES)}))", "alert_statistics": "SELECT 1",
              "health_hosts": HOSTS_SQL, "health_components": COMPONENTS_SQL, "health_alerts": COMPONENT_ALERTS_SQL,
              "recovery_actions": TELEMETRY_SQL, "recovery_statistics": "SELECT unnest(range(3))", "recovery_metrics": HOSTS_SQL}
    fixed = {"min_weight": en.MIN_WEIGHT, "weight_decay": en.DECAY, "weight_boost": en.BOOST}
    return " UNION ALL ".join(
        [f"SELECT '{n}' AS part, CAST(count(*) AS DOUBLE) AS n FROM ({sql}) x" for n, sql in counts.items()]
        + [f"SELECT 'settings.{k}', CAST({v} AS DOUBLE)" for k, v in fixed.items()]
        + [f"SELECT 'settings.prediction_count', CAST(count(*) AS DOUBLE) FROM ({TELEMETRY_SQL}) x",
           f"""SELECT 'recovered.' || CASE WHEN event_id % 3 = 0 THEN 'retry' WHEN event_id % 3 = 1 THEN 'fallback' ELSE 'cache' END,
             CAST(count_if(confidence > 0.4) AS DOUBLE) FROM ({TELEMETRY_SQL}) x GROUP BY 1"""])


def found_by_metadata(spark, sf):
    """Log entries whose metadata, JSON text of several shapes, name one role and an even turn below a nested path."""
    i = F.col("turn")
    text = (F.when(i % 5 == 4, F.lit("no json")).when(i % 5 == 3, F.to_json(F.struct(F.col("event_type").alias("request"))))
            .otherwise(F.to_json(F.struct(F.struct(F.struct(F.col("event_type").alias("role"), (i % 2 == 0).alias("even"),
                                                            F.array(i).alias("turns")).alias("user")).alias("request")))))
    rows = logs.with_metadata(log_table(spark, sf).withColumn("text", text), "text")
    out = logs.search(rows, ["conv_id", "turn"], limit=200, metadata={"$.request.user.role": "user", "$.request.user.even": True})
    return out.select("conv_id", "turn", F.try_variant_get("metadata", "$.request.user.turns[0]", "bigint").alias("first"),
                      F.md5("message").alias("digest"))


QUERIES = {
    "src_export_state": (state_export, state_export_sql()),
    "fil_log_metadata": (found_by_metadata, f"""
      SELECT conv_id, turn, turn AS first, md5(message) AS digest FROM ({LOGS_SQL}) l
      WHERE event_type = 'user' AND turn % 2 = 0 AND turn % 5 < 3 ORDER BY ts DESC, conv_id DESC, turn DESC LIMIT 200"""),
    "src_export_recovery": (recovery_export, f"""
      SELECT CASE WHEN event_id % 3 = 0 THEN 'retry' WHEN event_id % 3 = 1 THEN 'fallback' ELSE 'cache' END AS action,
        confidence > 0.4 AS success, count(*) AS n, epoch_us(date_trunc('millisecond', min(ts))) AS first
      FROM ({TELEMETRY_SQL}) e GROUP BY 1, 2"""),
    "src_read_problems": (problem_rows, f"""
      SELECT CAST(problem_id AS VARCHAR) AS title, md5(description) AS digest, input_desc,
        output_desc, problem_class, problem_score AS problem_score_scaled
      FROM ({PROBLEMS_SQL}) p"""),
    "src_read_requests": (request_rows, """
      SELECT CAST(item_id AS VARCHAR) AS request_id, md5(text) AS digest, '' AS input_desc,
        CAST(NULL AS VARCHAR) AS output_desc FROM benchmark"""),
    "src_export_metrics": (metric_export(None), metric_export_sql("true")),
    "src_export_one_model": (metric_export("click"), metric_export_sql("model_name = 'click'")),
    "src_export_logs_json": (log_export("json"), LOG_EXPORT_SQL),
    "src_export_logs_csv": (log_export("csv"), LOG_EXPORT_SQL),
    "src_export_alerts": (alert_export, f"""
      SELECT 'active' AS part, rule_id, count(*) AS n FROM ({HITS_SQL}) h WHERE event_id % 3 <> 0
        GROUP BY 2
      UNION ALL SELECT 'history', rule_id, count(*) FROM ({HITS_SQL}) h GROUP BY 2"""),
    "src_export_health": (health_export, f"""
      SELECT host, count(*) AS n, round(avg(cpu_percent), 6) AS cpu FROM ({HOSTS_SQL}) h GROUP BY 1"""),
    "src_stored_weights": (stored_weights, f"""
      SELECT model_name, round(weight, 6) AS weight, '1' AS version FROM ({START_SQL}) w
      UNION ALL SELECT model_name, round(1.0 / count(*) OVER (), 6), 'newest' FROM ({START_SQL}) w"""),
    "src_restore_backup": (restored, f"""
      SELECT model_name AS data_type, printf('%.6f', value) AS content, epoch_us(ts) AS created_at,
        strlen(printf('%.6f', value)) AS size_bytes FROM ({REPORTS_SQL}) r
      QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY ts DESC) = 1"""),
}
