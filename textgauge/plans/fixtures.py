"""The given tables read as the tables the operators expect, each in Spark and in SQL.

Problems are labelled documents, requests are all documents, telemetry is the event table, logs are
the conversations. Nothing is made up: every row comes from a row of the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The newest event is on 2024-01-30; "now" is always given, never read from a clock.
AS_OF = "2024-01-31 00:00:00"
MODELS = ["forest_classifier", "linear_classifier", "boosted_classifier"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A text table. Its tasks are its file splits; spark.sql.files.maxPartitionBytes sets their size."""
    return table(spark, sf, name)


PROBLEM_CLASS_SQL = (
    "CASE WHEN l.toxic = 1 THEN 'hard' WHEN l.quality = 1 THEN 'easy' ELSE 'medium' END"
)
PROBLEM_SCORE_SQL = (
    "(CASE WHEN l.toxic = 1 THEN 70 WHEN l.quality = 1 THEN 11 ELSE 40 END + d.n_chars % 28) / 10.0"
)
PROBLEMS_SQL = f"""
  SELECT d.doc_id AS problem_id, d.text AS description, d.lang AS input_desc,
         CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.source END AS output_desc,
         {PROBLEM_CLASS_SQL} AS problem_class,
         CAST({PROBLEM_SCORE_SQL} AS DOUBLE) AS problem_score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def problems(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = texts(spark, sf), table(spark, sf, "labels")
    rank = F.when(F.col("toxic") == 1, 70).when(F.col("quality") == 1, 11).otherwise(40)
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("problem_id"), F.col("text").alias("description"),
        F.col("lang").alias("input_desc"),
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("output_desc"),
        F.when(F.col("toxic") == 1, "hard").when(F.col("quality") == 1, "easy")
        .otherwise("medium").alias("problem_class"),
        ((rank + F.col("n_chars") % 28) / 10.0).cast("double").alias("problem_score"),
    )


REQUESTS_SQL = """
  SELECT doc_id AS request_id,
         CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN ' ' ELSE text END AS description,
         CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS input_desc,
         CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 14 = 0 THEN chr(160) ELSE source END
           AS output_desc
  FROM documents"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as requests, with missing and blank fields among them."""
    i = F.col("doc_id")
    return texts(spark, sf).select(
        i.alias("request_id"),
        F.when(i % 11 == 0, None).when(i % 7 == 0, " ").otherwise(F.col("text")).alias("description"),
        F.when(i % 13 == 0, None).when(i % 7 == 0, "").otherwise(F.col("lang")).alias("input_desc"),
        F.when(i % 5 == 0, None).when(i % 14 == 0, "\u00a0").otherwise(F.col("source"))
        .alias("output_desc"),
    )


TELEMETRY_SQL = """
  SELECT event_id, event_type AS model_name, CAST(ts AS TIMESTAMP) AS ts,
         value * 10 AS prediction_time,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 100.0 AS confidence,
         md5(CAST(user_id AS VARCHAR)) AS input_hash, user_id
  FROM events"""


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Events as served predictions: type = model, value = latency / 10, props.k = confidence."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("model_name"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("value") * 10).alias("prediction_time"), (k / F.lit(100.0)).alias("confidence"),
        F.md5(F.col("user_id").cast("string")).alias("input_hash"), "user_id",
    )


SNAPSHOTS_SQL = f"""
  SELECT model_name, date_trunc('day', ts) + INTERVAL 1 DAY AS ts,
         CASE WHEN count(*) % 7 = 0 THEN NULL
              ELSE avg(CASE WHEN confidence >= 0.4 THEN 1.0 ELSE 0.0 END) END AS accuracy,
         avg(CASE WHEN confidence >= 0.45 THEN 1.0 ELSE 0.0 END) AS f1_score,
         avg(prediction_time) / 300 AS mae, avg(prediction_time) / 250 AS rmse,
         avg(confidence) AS avg_confidence,
         avg(CASE WHEN confidence < 0.05 THEN 1.0 ELSE 0.0 END) AS error_rate
  FROM ({TELEMETRY_SQL}) e GROUP BY 1, 2"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """One quality snapshot per model and day, taken at the day's end."""
    def share(cond):
        return F.avg(F.when(cond, 1.0).otherwise(0.0))

    c, p = F.col("confidence"), F.col("prediction_time")
    day = (F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 1 DAY")).alias("ts")
    return telemetry(spark, sf).groupBy("model_name", day).agg(
        F.when(F.count("*") % 7 != 0, share(c >= 0.4)).alias("accuracy"),
        share(c >= 0.45).alias("f1_score"), (F.avg(p) / 300).alias("mae"),
        (F.avg(p) / 250).alias("rmse"), F.avg(c).alias("avg_confidence"),
        share(c < 0.05).alias("error_rate"),
    )


LOGS_SQL = """
  SELECT CASE WHEN conv_id % 9 = 0 THEN NULL ELSE CAST(conv_id AS VARCHAR) END AS correlation_id,
         conv_id, turn, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * conv_id
           + INTERVAL 1 SECOND * turn AS ts,
         CASE role WHEN 'system' THEN 'ERROR' WHEN 'user' THEN 'WARNING' ELSE 'INFO' END AS level,
         role AS event_type, text AS message
  FROM conversations"""


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as log entries."""
    at = F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")
    return table(spark, sf, "conversations").select(
        F.when(F.col("conv_id") % 9 != 0, F.col("conv_id").cast("string")).alias("correlation_id"),
        "conv_id", "turn", F.timestamp_seconds(at).alias("ts"),
        F.when(F.col("role") == "system", "ERROR").when(F.col("role") == "user", "WARNING")
        .otherwise("INFO").alias("level"),
        F.col("role").alias("event_type"), F.col("text").alias("message"),
    )


CALLS_SQL = f"""
  SELECT model_name AS circuit, ts, event_id AS call_id, confidence >= 0.35 AS success,
         CASE WHEN user_id % 10 = 0 THEN 0.0 ELSE prediction_time / 1000 END AS execution_time
  FROM ({TELEMETRY_SQL}) e"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).select(
        F.col("model_name").alias("circuit"), "ts", F.col("event_id").alias("call_id"),
        (F.col("confidence") >= 0.35).alias("success"),
        F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(F.col("prediction_time") / 1000)
        .alias("execution_time"),
    )


HOSTS_SQL = f"""
  SELECT event_id, ts, confidence * 100 AS cpu_percent,
         CAST(user_id % 100 AS DOUBLE) AS memory_percent,
         least(prediction_time / 10, 100.0) AS disk_usage_percent, model_name AS host
  FROM ({TELEMETRY_SQL}) e"""


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as host samples: confidence = CPU, user = memory, value = disk."""
    return telemetry(spark, sf).select(
        "event_id", "ts", (F.col("confidence") * 100).alias("cpu_percent"),
        (F.col("user_id") % 100).cast("double").alias("memory_percent"),
        F.least(F.col("prediction_time") / 10, F.lit(100.0)).alias("disk_usage_percent"),
        F.col("model_name").alias("host"),
    )


CACHE_SQL = f"""
  SELECT input_hash, ts, event_id, model_name, prediction_time, confidence,
         CAST(86400 * (1 + user_id % 3) AS INTEGER) AS ttl_seconds
  FROM ({TELEMETRY_SQL}) e WHERE user_id % 4 <> 0"""


def cache_log(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).where(F.col("user_id") % 4 != 0).select(
        "input_hash", "ts", "event_id", "model_name", "prediction_time", "confidence",
        (F.lit(86400) * (1 + F.col("user_id") % 3)).cast("int").alias("ttl_seconds"),
    )


def predictions_sql() -> str:
    parts = []
    for i, name in enumerate(MODELS):
        h = f"(p.problem_id * {2 * i + 3} + {i})"
        parts.append(f"""
  SELECT p.problem_id AS id, '{name}' AS model_name, {i} AS model_pos, p.problem_class AS actual,
         p.problem_score AS actual_score,
         CASE WHEN {h} % 10 < {5 + i} THEN p.problem_class
              WHEN {h} % 3 = 0 THEN 'easy' WHEN {h} % 3 = 1 THEN 'medium' ELSE 'hard' END
           AS predicted,
         p.problem_score + ({h} % 21 - 10) / 10.0 AS predicted_score,
         0.34 + ({h} % 66) / 100.0 AS confidence
  FROM problems p""")
    return " UNION ALL ".join(parts)


PREDICTIONS_SQL = (
    "WITH problems AS (" + PROBLEMS_SQL + "), predictions AS (" + predictions_sql() + ")"
)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three models' predictions of every problem, in long form."""
    base = problems(spark, sf).select("problem_id", "problem_class", "problem_score")
    models = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model_name"), F.lit(i).alias("model_pos"))
        for i, n in enumerate(MODELS)]))
    h = F.col("h")
    return base.withColumn("m", models).select("*", "m.*").withColumn(
        "h", F.col("problem_id") * (2 * F.col("model_pos") + 3) + F.col("model_pos")
    ).select(
        F.col("problem_id").alias("id"), "model_name", "model_pos",
        F.col("problem_class").alias("actual"), F.col("problem_score").alias("actual_score"),
        F.when(h % 10 < 5 + F.col("model_pos"), F.col("problem_class")).when(h % 3 == 0, "easy")
        .when(h % 3 == 1, "medium").otherwise("hard").alias("predicted"),
        (F.col("problem_score") + (h % 21 - 10) / 10.0).alias("predicted_score"),
        (0.34 + (h % 66) / 100.0).alias("confidence"),
    )


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})
