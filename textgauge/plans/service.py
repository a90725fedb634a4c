"""Rules and alerts, circuits, logs and the prediction cache over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shaping
from ..operators import alerts as al
from ..operators import cache, circuit, health, logs, ordered
from .fixtures import (AS_OF, CACHE_SQL, CALLS_SQL, LOGS_SQL, TELEMETRY_SQL, cache_log, calls,
                       rounded, table, telemetry)
from .fixtures import logs as log_table
from .telemetry import DAY, us

NOW = f"TIMESTAMP '{AS_OF}'"

# One rule per comparison, plus an unknown operator and a disabled rule.
RULES = [
    ("slow_signup", "Slow signup", "Signup is slow", "signup", 1000.0, ">", "warning",
     ["log", "email"], 360, True),
    ("slow_click", "Slow click", "Click is slow", "click", 700.0, ">=", "critical",
     ["log", "slack"], 30, True),
    ("fast_view", "Fast view", "View is fast", "view", 50.0, "<", "info", ["log"], 1440, True),
    ("tiny_error", "Tiny error", "Error is tiny", "error", 9.1, "<=", "warning", ["sms"], 120, True),
    ("exact_buy", "Exact purchase", "Purchase time hit", "purchase", 100.0, "==", "info", ["log"],
     5, True),
    ("other_buy", "Other purchase", "Purchase time missed", "purchase", 100.0, "!=", "warning",
     ["email", "webhook"], 90, True),
    ("odd_rule", "Odd rule", "Unknown comparison", "click", 1.0, "~", "info", ["log"], 5, True),
    ("off_rule", "Off rule", "Disabled", "view", 0.0, ">", "critical", ["log"], 5, False),
]
RULES_SQL = "(VALUES " + ", ".join(
    f"('{r}', '{n}', '{d}', '{m}', CAST({t} AS DOUBLE), '{o}', '{s}', {c}, {w}, {e})"
    for r, n, d, m, t, o, s, c, w, e in RULES
) + (") AS r(rule_id, name, description, metric_name, threshold, op, severity, channels, "
     "cooldown_minutes, enabled)")


def samples(spark, sf):
    return telemetry(spark, sf).select(
        "event_id", "ts", F.col("model_name").alias("metric_name"),
        F.round("prediction_time", 2).alias("value"))


HITS_SQL = f"""
  SELECT event_id, ts, metric_name, value, r.* EXCLUDE (metric_name) FROM
    (SELECT event_id, ts, model_name AS metric_name, round(prediction_time, 2) AS value
     FROM ({TELEMETRY_SQL}) e) s JOIN {RULES_SQL} USING (metric_name)
  WHERE enabled AND CASE op WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold
    WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold
    WHEN '==' THEN value = threshold WHEN '!=' THEN value <> threshold ELSE false END"""


def hits(spark, sf):
    return al.rule_hits(samples(spark, sf), al.rules_table(spark, RULES))


def emitted(spark, sf):
    return al.make_alerts(al.cooldown(hits(spark, sf), "event_id"))


EMITTED_SQL = f"""
  WITH RECURSIVE h AS MATERIALIZED (SELECT *, epoch_us(ts) AS us_ FROM ({HITS_SQL}) x),
  chain AS (
    SELECT rule_id, min(us_) AS us_, any_value(cooldown_minutes) AS cd FROM h GROUP BY 1
    UNION ALL
    SELECT c.rule_id, (SELECT min(h.us_) FROM h WHERE h.rule_id = c.rule_id
                       AND h.us_ >= c.us_ + CAST(c.cd AS BIGINT) * 60000000) AS us_, c.cd
    FROM chain c WHERE c.us_ IS NOT NULL),
  alerts AS (SELECT h.*, h.rule_id || '_' || CAST(floor(h.us_ / 1000000) AS BIGINT) AS alert_id,
      name AS title, description || '. Current value: ' || printf('%.2f', value) || ', Threshold: '
        || printf('%.2f', threshold) AS message, 'active' AS status
    FROM h JOIN chain USING (rule_id, us_)
    QUALIFY row_number() OVER (PARTITION BY rule_id, us_ ORDER BY event_id) = 1)"""


def alert_rows(spark, sf):
    return emitted(spark, sf).select("alert_id", "rule_id", "event_id", "severity", "title",
                                     "message", "status", F.round("value", 4).alias("value"))


CHANNELS = [("log", True), ("email", True), ("slack", False)]


def delivered(spark, sf):
    channels = spark.createDataFrame(CHANNELS, "channel string, enabled boolean")
    return al.deliveries(emitted(spark, sf), channels)


def alert_events(spark, sf):
    """Events as steps in the life of one alert per user."""
    kind = F.col("event_type")
    action = F.when(kind == "click", "created").when(
        (kind == "view") & (F.col("event_id") % 9 == 0), "acknowledged").when(
        (kind == "purchase") & (F.col("event_id") % 25 == 0), "resolved")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("alert_id"), F.col("ts").cast("timestamp").alias("ts"),
        action.alias("action"), F.concat(F.lit("op"), F.col("event_id") % 4).alias("actor")).where(
        "action IS NOT NULL")


def life(spark, sf):
    return us(al.lifecycle(alert_events(spark, sf)), "created_at", "acknowledged_at", "resolved_at")


LIFE_SQL = """
  WITH e AS (SELECT user_id AS alert_id, ts, CASE WHEN event_type = 'click' THEN 'created'
      WHEN event_type = 'view' AND event_id % 9 = 0 THEN 'acknowledged'
      WHEN event_type = 'purchase' AND event_id % 25 = 0 THEN 'resolved' END AS action,
      'op' || event_id % 4 AS actor FROM events)
  SELECT alert_id, epoch_us(min(ts) FILTER (WHERE action = 'created')) AS created_at,
    epoch_us(min(ts) FILTER (WHERE action = 'acknowledged')) AS acknowledged_at,
    arg_min(actor, ts) FILTER (WHERE action = 'acknowledged') AS acknowledged_by,
    epoch_us(min(ts) FILTER (WHERE action = 'resolved')) AS resolved_at,
    CASE WHEN count_if(action = 'resolved') > 0 THEN 'resolved'
      WHEN count_if(action = 'acknowledged') > 0 THEN 'acknowledged' ELSE 'active' END AS status
  FROM e WHERE action IS NOT NULL GROUP BY 1"""


def marked_hits(spark, sf):
    return hits(spark, sf).withColumns({
        "resolved": F.col("event_id") % 3 == 0, "model_name": F.col("metric_name")})


def replayed(consecutive=False, seconds=5400):
    def run(spark, sf):
        out = circuit.replay(calls(spark, sf), recovery_timeout=seconds, consecutive=consecutive)
        return out.select("call_id", "circuit", "state", "outcome", "opened", "state_after",
                          "failure_count", "success_count")
    return run


CONTROLS_SQL = f"""
  SELECT model_name AS circuit, ts, max(CASE WHEN event_id % 277 = 0 THEN 'force_open' ELSE 'reset' END)
    AS action FROM ({TELEMETRY_SQL}) e WHERE event_id % 277 = 0 OR event_id % 401 = 0 GROUP BY 1, 2"""


def controls(spark, sf):
    """Some events as an operator's resets and forced openings of their circuit."""
    i = F.col("event_id")
    return telemetry(spark, sf).where((i % 277 == 0) | (i % 401 == 0)).select(
        F.col("model_name").alias("circuit"), "ts",
        F.when(i % 277 == 0, "force_open").otherwise("reset").alias("action"))


def controlled(spark, sf):
    out = circuit.replay(calls(spark, sf), recovery_timeout=5400, controls=controls(spark, sf))
    return out.select("call_id", "circuit", "state", "outcome", "opened", "state_after",
                      "failure_count", "success_count")


def replay_sql(seconds=5400, consecutive=False, controlled=False) -> str:
    """Call by call: the automaton as a recursive query."""
    keep = "CASE WHEN nx.success THEN 0 ELSE r.fc END" if consecutive else "r.fc"
    marks = CONTROLS_SQL if controlled else (
        "SELECT NULL::VARCHAR AS circuit, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS action WHERE false")
    # A control between two calls restarts the circuit before the later one.
    before = f"""(SELECT r0.circuit, r0.pos, nx.ctl, nx.new_, CASE WHEN nx.new_ THEN
        CASE WHEN nx.action = 'force_open' THEN 'open' ELSE 'closed' END ELSE r0.st END AS st,
      CASE WHEN nx.new_ THEN 0 ELSE r0.fc END AS fc, CASE WHEN nx.new_ THEN 0 ELSE r0.sc END AS sc,
      CASE WHEN nx.new_ THEN epoch_us(nx.ctl) ELSE r0.lf END AS lf
      FROM r r0 JOIN c nx ON nx.circuit = r0.circuit AND nx.pos = r0.pos + 1)"""
    return f"""
  WITH RECURSIVE k AS MATERIALIZED ({marks}),
  c0 AS (SELECT circuit, call_id, ts, success, execution_time,
      row_number() OVER (PARTITION BY circuit ORDER BY ts, call_id) AS pos FROM ({CALLS_SQL}) x),
  c1 AS (SELECT c0.*, k.ts AS ctl, k.action FROM c0 ASOF LEFT JOIN k
      ON c0.circuit = k.circuit AND c0.ts >= k.ts),
  c AS MATERIALIZED (SELECT *, epoch_us(ts) AS us_, ctl IS DISTINCT FROM
      lag(ctl) OVER (PARTITION BY circuit ORDER BY pos) AS new_ FROM c1),
  r AS (
    SELECT circuit, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS call_id, 'closed' AS met,
      'closed' AS st, 0 AS fc, 0 AS sc, CAST(NULL AS BIGINT) AS lf, '' AS outcome,
      false AS opened FROM (SELECT DISTINCT circuit FROM c) k
    UNION ALL
    SELECT circuit, pos, call_id, met,
      CASE WHEN met = 'open' THEN 'open'
           WHEN met = 'half_open' THEN CASE WHEN NOT success THEN 'open' WHEN sc + 1 >= 3
             THEN 'closed' ELSE 'half_open' END
           ELSE CASE WHEN NOT success AND fc + 1 >= 5 THEN 'open' ELSE 'closed' END END AS st,
      CASE WHEN met = 'open' THEN fc
           WHEN met = 'half_open' THEN CASE WHEN NOT success THEN fc + 1 WHEN sc + 1 >= 3 THEN 0
             ELSE fc END
           WHEN success THEN fc ELSE fc + 1 END AS fc,
      CASE WHEN met = 'open' THEN sc WHEN NOT success THEN 0
           WHEN met = 'half_open' THEN CASE WHEN sc + 1 >= 3 THEN 0 ELSE sc + 1 END
           ELSE 0 END AS sc,
      CASE WHEN met <> 'open' AND NOT success THEN us_ ELSE lf END AS lf,
      CASE WHEN met = 'open' THEN 'rejected' WHEN success THEN 'success' ELSE 'failure' END,
      CASE WHEN met = 'half_open' THEN NOT success WHEN met = 'closed'
           THEN NOT success AND fc + 1 >= 5 ELSE false END
    FROM (SELECT nx.circuit, nx.pos, nx.call_id, nx.us_, nx.success, {keep} AS fc, r.lf,
            CASE WHEN r.st = 'open' AND nx.us_ - r.lf >= {seconds * 1_000_000} THEN 0 ELSE r.sc END
              AS sc,
            CASE WHEN r.st = 'open' AND nx.us_ - r.lf >= {seconds * 1_000_000} THEN 'half_open'
                 ELSE r.st END AS met
          FROM {before} r JOIN c nx ON nx.circuit = r.circuit AND nx.pos = r.pos + 1) n),
  told AS (SELECT call_id, circuit, met AS state, outcome, opened, st AS state_after,
      CAST(CASE WHEN st = 'closed' THEN fc ELSE 0 END AS BIGINT) AS failure_count,
      CAST(CASE WHEN st = 'half_open' THEN sc ELSE 0 END AS BIGINT) AS success_count, pos
    FROM r WHERE pos > 0)"""


def call_stats(spark, sf):
    return circuit.call_statistics(circuit.replay(calls(spark, sf), recovery_timeout=5400))


CALL_STATS_SQL = replay_sql() + """,
  t AS (SELECT told.*, c.execution_time, c.success FROM told JOIN c USING (circuit, pos)),
  late AS (SELECT * FROM t WHERE outcome <> 'rejected'
           QUALIFY row_number() OVER (PARTITION BY circuit ORDER BY pos DESC) <= 100),
  l AS (SELECT circuit, round(count_if(success) / count(*) * 100, 2) AS recent_success_rate_percent,
          round(coalesce(avg(CASE WHEN execution_time > 0 THEN execution_time END), 0) * 1000, 2)
            AS avg_execution_time_ms FROM late GROUP BY 1)
  SELECT circuit, count(*) AS total_calls, count_if(outcome = 'success') AS total_successes,
    count_if(outcome = 'failure') AS total_failures, count_if(outcome = 'rejected') AS rejected_calls,
    round(count_if(outcome = 'success') / count(*) * 100, 2) AS success_rate_percent,
    round(count_if(outcome = 'failure') / count(*) * 100, 2) AS failure_rate_percent,
    any_value(recent_success_rate_percent) AS recent_success_rate_percent,
    any_value(avg_execution_time_ms) AS avg_execution_time_ms
  FROM t JOIN l USING (circuit) GROUP BY 1"""


def fleet(spark, sf):
    return health.fleet_status(circuit.end_states(
        circuit.replay(calls(spark, sf), recovery_timeout=5400)))


def recent(spark, sf):
    """The newest ten calls of every user, whatever their circuit."""
    df = telemetry(spark, sf).select("event_id", "user_id", "ts", "prediction_time")
    out = ordered.top_per_key(df, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 10)
    return out.groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.avg("prediction_time"), 4).alias("mean"))


def found(spark, sf):
    out = logs.search(log_table(spark, sf), ["turn"], level="WARNING", event_type="user",
                      as_of="2024-01-01 06:00:00", minutes=330, limit=50)
    return out.select("correlation_id", "conv_id", "turn", "level", F.md5("message").alias("digest"))


def one_trace(spark, sf):
    return logs.trace(log_table(spark, sf), "10", ["turn"]).select("correlation_id", "turn")


def exported(spark, sf):
    """Log rows in their export form: metadata as JSON text."""
    df = log_table(spark, sf).select(
        "conv_id", "turn", "level",
        F.to_json(F.create_map(F.lit("role"), F.col("event_type"), F.lit("turn"),
                               F.col("turn").cast("string"))).alias("metadata"))
    return df


def shaped(spark, sf):
    kinds = ["request", "response", "prediction", "error", "performance", "security", "system",
             "model"]
    i = F.col("event_id")
    raw = telemetry(spark, sf).select(
        "event_id", "ts", F.element_at(F.array(*[F.lit(k) for k in kinds]),
                                       (i % 8 + 1).cast("int")).alias("kind"),
        F.when(i % 3 != 0, F.concat(F.lit("c"), i.cast("string"))).alias("correlation_id"),
        F.col("model_name").alias("subject"), F.concat(F.lit("/e/"), i.cast("string"))
        .alias("detail"), F.when(i % 2 == 0, "critical").otherwise("low").alias("severity"),
        F.round("prediction_time", 2).alias("duration_ms"), F.lit("api").alias("component"))
    return shaping.shape_log_events(raw).select(
        F.unix_micros("ts").alias("ts"), "event_type", "level", "correlation_id", "message")


SHAPED_SQL = f"""
  WITH e AS (SELECT event_id, ts, list_extract(['request', 'response', 'prediction', 'error',
      'performance', 'security', 'system', 'model'], event_id % 8 + 1) AS kind,
      CASE WHEN event_id % 3 <> 0 THEN 'c' || event_id ELSE 'no-correlation-id' END AS cid,
      model_name AS subject, '/e/' || event_id AS detail,
      CASE WHEN event_id % 2 = 0 THEN 'critical' ELSE 'low' END AS severity,
      round(prediction_time, 2) AS d FROM ({TELEMETRY_SQL}) t),
  m AS (SELECT *, CASE kind WHEN 'request' THEN 'Incoming request: ' || subject || ' ' || detail
      WHEN 'response' THEN 'Response sent: ' || detail || ' in ' || printf('%.2f', d) || 'ms'
      WHEN 'prediction' THEN 'Prediction made by ' || subject || ' in ' || printf('%.2f', d) || 'ms'
      WHEN 'error' THEN 'Error occurred: ' || subject || ': ' || detail
      WHEN 'performance' THEN 'Performance: ' || subject || ' completed in ' || printf('%.2f', d)
        || 'ms'
      WHEN 'security' THEN 'Security event: ' || detail WHEN 'system' THEN 'System event: ' || detail
      ELSE 'Model event [' || subject || ']: ' || detail END AS message,
    CASE WHEN kind = 'error' THEN 'ERROR' WHEN kind = 'security' THEN CASE severity
      WHEN 'critical' THEN 'CRITICAL' ELSE 'WARNING' END ELSE 'INFO' END AS level FROM e)
  SELECT epoch_us(ts) AS ts, kind AS event_type, level, cid AS correlation_id, message FROM m"""


def error_entries(spark, sf):
    i = F.col("event_id")
    raw = telemetry(spark, sf).select(
        "event_id", F.col("model_name").alias("component"),
        F.element_at(F.array(*[F.lit(s) for s in health.SEVERITIES]),
                     (i % 4 + 1).cast("int")).alias("severity"),
        F.lit("ValueError").alias("error_type"), F.concat(F.lit("bad row "), i.cast("string"))
        .alias("message"), F.when(i % 5 == 0, "retry").alias("recovery_action"))
    return shaping.shape_error_events(raw).select("event_id", "level", "log_message")


def requests_by_hash(spark, sf):
    """Every event's input as a new request, asked at the fixed time."""
    return telemetry(spark, sf).select("event_id", "input_hash")


def cached_answers(spark, sf):
    return cache_log(spark, sf).select(
        "input_hash", "ts", "event_id", "ttl_seconds", "model_name",
        F.when(F.col("confidence") > 0.7, "hard").otherwise("easy").alias("cls"),
        (F.col("prediction_time") / 100).alias("score"), "confidence").withColumnRenamed(
        "event_id", "entry_id")


LATEST_CACHE_SQL = f"""SELECT input_hash, ts, event_id AS entry_id, ttl_seconds, model_name,
  CASE WHEN confidence > 0.7 THEN 'hard' ELSE 'easy' END AS cls, prediction_time / 100 AS score,
  confidence FROM ({CACHE_SQL}) c QUALIFY row_number() OVER (PARTITION BY input_hash
  ORDER BY ts DESC, event_id DESC) = 1"""
VALID = f"(epoch_us({NOW}) - epoch_us(ts)) / 1000000 < ttl_seconds"


def looked_up(spark, sf):
    out = cache.lookup(requests_by_hash(spark, sf), cached_answers(spark, sf), AS_OF, "entry_id")
    return us(rounded(out.select("event_id", "cached", "cache_source", "cache_timestamp", "cls",
                                 "score"), "score"), "cache_timestamp")


def served(spark, sf):
    """Hits from the cache, misses scored by a function of the request."""
    def score(df):
        n = F.conv(F.substring("input_hash", 1, 2), 16, 10).cast("int")
        return df.withColumns({"cls": F.lit("medium"), "score": n / 10, "confidence": F.lit(0.5)})
    answers, _ = cache.serve(requests_by_hash(spark, sf), cached_answers(spark, sf).drop("entry_id"),
                             AS_OF, score, ["cls", "score", "confidence"])
    return rounded(answers.select("event_id", "cls", "score", "confidence", "cached"), "score",
                   "confidence")


SERVED_SQL = f"""
  SELECT e.event_id, coalesce(cls, 'medium') AS cls,
    round(coalesce(score, CAST(('0x' || substr(e.input_hash, 1, 2)) AS INTEGER) / 10), 6) AS score,
    round(CAST(coalesce(k.confidence, 0.5) AS DOUBLE), 6) AS confidence, k.ts IS NOT NULL AS cached
  FROM ({TELEMETRY_SQL}) e LEFT JOIN (SELECT * FROM ({LATEST_CACHE_SQL}) l WHERE {VALID}) k
    ON k.input_hash = e.input_hash"""


def stale(allow):
    def run(spark, sf):
        out = cache.stale_or_default(requests_by_hash(spark, sf), cached_answers(spark, sf), AS_OF,
                                     "network_connectivity_lost", "entry_id", allow)
        return rounded(out.select("event_id", "cached", "fallback_reason", "cls", "score",
                                  "confidence"), "score", "confidence")
    return run


def stale_sql(allow: bool) -> str:
    return f"""
  SELECT e.event_id, k.ts IS NOT NULL AS cached, CASE WHEN k.ts IS NOT NULL
      THEN 'network_connectivity_lost' ELSE 'network_connectivity_lost_no_cache' END
      AS fallback_reason,
    coalesce(cls, 'medium') AS cls, round(coalesce(score, 5.0), 6) AS score,
    round(CAST(coalesce(k.confidence, 0.0) AS DOUBLE), 6) AS confidence
  FROM ({TELEMETRY_SQL}) e LEFT JOIN (SELECT * FROM ({LATEST_CACHE_SQL}) l
    WHERE {'true' if allow else VALID}) k ON k.input_hash = e.input_hash"""


def upserted(spark, sf):
    log = cached_answers(spark, sf)
    cut_at = F.lit("2024-01-15").cast("timestamp")
    out = cache.upsert(log.where(F.col("ts") < cut_at), log.where(F.col("ts") >= cut_at), "entry_id")
    return us(out.select("input_hash", "entry_id", "ts"), "ts")


def purged(hours):
    def run(spark, sf):
        return cache.purge(cached_answers(spark, sf), AS_OF, hours).select("entry_id")
    return run


def backups(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("data_type"), F.col("text").alias("content"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(
            secs=F.col("doc_id"))).alias("created_at"))
    out = cache.newest_backup(docs)
    return us(out.select("data_type", F.md5("content").alias("digest"), "created_at", "size_bytes"),
              "created_at")


def remediated(spark, sf):
    """The rules whose remediation ran, with the alerts that it was handed."""
    rows = emitted(spark, sf)
    handed = {}

    def act(rule):
        return lambda mine: handed.update({rule: mine.count()})

    ran = al.remediate(rows, {r: act(r) for r in ("slow_signup", "slow_click", "off_rule", "other_buy")})
    return spark.createDataFrame([(r, handed[r]) for r in ran], "rule_id string, alerts bigint")


def health_checks(spark, sf):
    """Given checks over the calls; one of them fails and says so."""
    def slow(df):
        worst = F.max("prediction_time")
        return df.agg(F.when(worst > 1000, "degraded").otherwise("healthy").alias("status"),
                      F.format_string("slowest %.2f ms", worst).alias("message"))

    def broken(df):
        raise RuntimeError("no answer")

    return health.run_checks(telemetry(spark, sf), {"latency": slow, "model": broken})


QUERIES = {
    "agg_health_checks": (health_checks, f"""
      SELECT 'latency' AS component, CASE WHEN max(prediction_time) > 1000 THEN 'degraded' ELSE 'healthy' END AS status,
        'slowest ' || printf('%.2f', max(prediction_time)) || ' ms' AS message FROM ({TELEMETRY_SQL}) e
      UNION ALL SELECT 'model', 'critical', 'Health check failed: no answer'"""),
    "str_remediation": (remediated, EMITTED_SQL + """
      SELECT rule_id, count(*) AS alerts FROM alerts
      WHERE rule_id IN ('slow_signup', 'slow_click', 'off_rule', 'other_buy') GROUP BY 1"""),
    "win_circuit_controls": (controlled, replay_sql(controlled=True) + """
      SELECT call_id, circuit, state, outcome, opened, state_after, failure_count, success_count
      FROM told"""),
    "join_rule_hits": (
        lambda spark, sf: hits(spark, sf).select("event_id", "rule_id", "severity"),
        f"SELECT event_id, rule_id, severity FROM ({HITS_SQL}) h"),
    "win_rule_cooldown": (alert_rows, EMITTED_SQL + """
      SELECT alert_id, rule_id, event_id, severity, title, message, status,
        round(value, 4) AS value FROM alerts"""),
    "join_alert_deliveries": (delivered, EMITTED_SQL + """,
      w AS (SELECT alert_id, rule_id, unnest(channels) AS channel FROM alerts)
      SELECT alert_id, rule_id, channel, channel IN ('log', 'email') AS delivered FROM w"""),
    "win_alert_lifecycle": (life, LIFE_SQL),
    "fil_active_alerts": (
        lambda spark, sf: al.active_alerts(marked_hits(spark, sf), severity="warning",
                                           limit=200).select("event_id", "rule_id"),
        f"""SELECT event_id, rule_id FROM ({HITS_SQL}) h WHERE event_id % 3 <> 0
          AND severity = 'warning' ORDER BY ts DESC, event_id DESC LIMIT 200"""),
    "agg_alert_statistics": (
        lambda spark, sf: al.alert_statistics(marked_hits(spark, sf), AS_OF),
        f"""SELECT severity, count_if(event_id % 3 <> 0) AS active,
          count_if(ts >= {NOW} - INTERVAL 24 HOUR) AS recent_24h, count(*) AS history
        FROM ({HITS_SQL}) h GROUP BY ROLLUP (severity)"""),
    "top_frequent_rules": (
        lambda spark, sf: al.frequent_rules(hits(spark, sf), AS_OF),
        f"""SELECT rule_id, count(*) AS alerts FROM ({HITS_SQL}) h
        WHERE ts >= {NOW} - INTERVAL 24 HOUR GROUP BY 1 ORDER BY alerts DESC, rule_id LIMIT 10"""),
    "win_circuit_replay": (replayed(), replay_sql() + " SELECT * EXCLUDE (pos) FROM told"),
    "win_circuit_replay_consecutive": (
        replayed(True, 3600), replay_sql(3600, True) + " SELECT * EXCLUDE (pos) FROM told"),
    "agg_circuit_statistics": (call_stats, CALL_STATS_SQL),
    "agg_circuit_fleet": (fleet, replay_sql() + """,
      s AS (SELECT arg_max(state_after, pos) AS st FROM told GROUP BY circuit)
      SELECT count(*) AS total, count_if(st = 'closed') AS closed,
        count_if(st = 'half_open') AS half_open, count_if(st = 'open') AS open,
        CASE WHEN count_if(st = 'open') = 0 THEN 'healthy'
          WHEN count_if(st = 'open') < count(*) THEN 'degraded' ELSE 'critical' END
          AS health_status FROM s"""),
    "win_recent_calls": (recent, f"""
      SELECT user_id, count(*) AS n, round(avg(prediction_time), 4) AS mean FROM (
        SELECT * FROM ({TELEMETRY_SQL}) e QUALIFY row_number() OVER (PARTITION BY user_id
          ORDER BY ts DESC, event_id DESC) <= 10) r GROUP BY 1"""),
    "top_log_search": (found, f"""
      SELECT correlation_id, conv_id, turn, level, md5(message) AS digest FROM ({LOGS_SQL}) l
      WHERE level = 'WARNING' AND event_type = 'user'
        AND ts >= TIMESTAMP '2024-01-01 06:00:00' - INTERVAL 330 MINUTE
      ORDER BY ts DESC, turn DESC LIMIT 50"""),
    "fil_log_trace": (one_trace, f"""SELECT correlation_id, turn FROM ({LOGS_SQL}) l
      WHERE correlation_id = '10'"""),
    "fil_all_traces": (
        lambda spark, sf: logs.traces(log_table(spark, sf), "turn").select(
            "correlation_id", "turn", "entry"),
        f"""SELECT correlation_id, turn, row_number() OVER (PARTITION BY correlation_id
          ORDER BY ts DESC, turn DESC) AS entry FROM ({LOGS_SQL}) l
        WHERE correlation_id IS NOT NULL QUALIFY entry <= 1000"""),
    "src_log_export_rows": (exported, f"""
      SELECT conv_id, turn, level, '{{"role":"' || event_type || '","turn":"' || turn || '"}}'
        AS metadata FROM ({LOGS_SQL}) l"""),
    "prj_log_events": (shaped, SHAPED_SQL),
    "prj_error_events": (error_entries, f"""
      SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'ERROR'
          WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS level,
        '[' || model_name || '] ValueError: bad row ' || event_id || CASE WHEN event_id % 5 = 0
          THEN ' | Recovery: retry' ELSE '' END AS log_message FROM ({TELEMETRY_SQL}) e"""),
    "agg_operation_durations": (
        lambda spark, sf: logs.operation_durations(
            telemetry(spark, sf), "model_name", "prediction_time", "event_id"),
        f"""WITH e AS ({TELEMETRY_SQL}),
        l AS (SELECT model_name, round(avg(prediction_time), 2) AS recent_avg_duration_ms FROM (
          SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY model_name
            ORDER BY ts DESC, event_id DESC) <= 50) r GROUP BY 1)
        SELECT model_name, count(*) AS count, round(avg(prediction_time), 2) AS avg_duration_ms,
          round(min(prediction_time), 2) AS min_duration_ms,
          round(max(prediction_time), 2) AS max_duration_ms,
          round(sum(prediction_time), 2) AS total_duration_ms,
          any_value(recent_avg_duration_ms) AS recent_avg_duration_ms
        FROM e JOIN l USING (model_name) GROUP BY 1"""),
    "join_cache_lookup": (looked_up, f"""
      SELECT e.event_id, k.ts IS NOT NULL AS cached,
        CASE WHEN k.ts IS NOT NULL THEN 'local_store' END AS cache_source,
        epoch_us(k.ts) AS cache_timestamp, cls, round(score, 6) AS score
      FROM ({TELEMETRY_SQL}) e LEFT JOIN (SELECT * FROM ({LATEST_CACHE_SQL}) l WHERE {VALID}) k
        ON k.input_hash = e.input_hash"""),
    "join_cache_serve": (served, SERVED_SQL),
    "join_cache_stale": (stale(True), stale_sql(True)),
    "join_cache_fresh_only": (stale(False), stale_sql(False)),
    "src_cache_upsert": (upserted, f"""
      SELECT input_hash, entry_id, epoch_us(ts) AS ts FROM ({LATEST_CACHE_SQL}) l"""),
    "fil_cache_purge_expired": (purged(None), f"""SELECT event_id AS entry_id FROM ({CACHE_SQL}) c
      WHERE (epoch_us({NOW}) - epoch_us(ts)) / 1000000 <= ttl_seconds"""),
    "fil_cache_purge_old": (purged(72), f"""SELECT event_id AS entry_id FROM ({CACHE_SQL}) c
      WHERE ts >= {NOW} - INTERVAL 72 HOUR"""),
    "agg_cache_statistics": (
        lambda spark, sf: cache.cache_statistics(cached_answers(spark, sf), AS_OF),
        f"""SELECT count(*) AS total, count_if(ok) AS valid, count_if(NOT ok) AS expired FROM (
          SELECT (epoch_us({NOW}) - epoch_us(ts)) / 1000000 <= ttl_seconds AS ok
          FROM ({CACHE_SQL}) c) x"""),
    "agg_cache_hits": (
        lambda spark, sf: cache.hit_statistics(cache.lookup(
            requests_by_hash(spark, sf), cached_answers(spark, sf), AS_OF, "entry_id")),
        f"""SELECT count(*) AS requests, count_if(cached) AS hits, count_if(NOT cached) AS misses,
          round(count_if(cached) * 100 / count(*), 2) AS hit_percent FROM ({SERVED_SQL}) s"""),
    "agg_fallback_counts": (
        lambda spark, sf: cache.fallback_counts(stale(True)(spark, sf)),
        f"SELECT fallback_reason, count(*) AS n FROM ({stale_sql(True)}) s GROUP BY 1"),
    "src_newest_backup": (backups, """
      SELECT source AS data_type, md5(text) AS digest,
        epoch_us(TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * doc_id) AS created_at,
        strlen(text) AS size_bytes FROM documents
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1"""),
}
