"""Validation, split, evaluation and ranking over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profiles
from ..operators import evaluate as ev
from ..operators import ordered, split, validate
from ..schemas import CLASSES
from .fixtures import (MODELS, PREDICTIONS_SQL, PROBLEMS_SQL, REQUESTS_SQL, predictions, problems,
                       requests, rounded, table, texts)
from .text import PROSE_WORDS, SPACE_SQL, core_sql

BLANK = f"NOT regexp_matches(coalesce(%s, ''), '[^{SPACE_SQL[1:-1]}]')"
COMBINED = ("concat(coalesce(description,''),' ',coalesce(input_desc,''),' ',"
            "coalesce(output_desc,''))")


def checked(mode):
    def run(spark, sf):
        df = validate.check_requests(requests(spark, sf), mode)
        return df.select("request_id", F.col("error").isNull().alias("valid"),
                         "error.error", "error.message",
                         F.col("error.status_code").cast("bigint").alias("status_code"))
    return run


def checked_sql(cases) -> str:
    def pick(i):
        parts = " ".join(f"WHEN {cond} THEN {vals[i]}" for cond, *vals in cases)
        return f"CASE {parts} END"
    return f"""
  SELECT request_id, error IS NULL AS valid, error, message,
         CASE WHEN error IS NULL THEN NULL ELSE 400 END AS status_code
  FROM (SELECT request_id, {pick(0)} AS error, {pick(1)} AS message FROM (
    SELECT *, concat_ws(', ', CASE WHEN description IS NULL THEN 'description' END,
       CASE WHEN input_desc IS NULL THEN 'input_desc' END,
       CASE WHEN output_desc IS NULL THEN 'output_desc' END) AS missing
    FROM ({REQUESTS_SQL}) r) s) q"""


def quarantine(spark, sf):
    valid, bad = validate.split_valid(validate.check_requests(requests(spark, sf), "structured"))
    count = F.count("*").alias("n")
    return valid.agg(count).withColumn("error", F.lit("none")).select("error", "n").unionByName(
        bad.groupBy("error").agg(count))


def fallback_rows(spark, sf):
    p = predictions(spark, sf).where("model_pos = 0")
    failed = F.col("id") % 4 == 0
    df = p.select("id", F.when(~failed, F.col("predicted")).alias("cls"),
                  F.when(~failed, F.col("predicted_score")).alias("score"),
                  F.when(~failed, F.col("confidence")).alias("confidence"))
    return rounded(validate.with_fallback(df, "cls", "score", "confidence"), "score", "confidence")


def quality(spark, sf):
    v = F.col("value")
    score = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).when(
        F.col("event_id") % 50 == 1, F.lit(float("inf"))).when(
        F.col("event_id") % 50 == 2, F.lit(None)).otherwise(v)
    return validate.prediction_quality(
        table(spark, sf, "events").select(score.alias("s")), "s")


def bounds(spark, sf):
    m = ev.evaluate_models(predictions(spark, sf))
    m = m.withColumn("value", F.when(F.col("metric") == "confidence", F.col("value") * 3)
                     .otherwise(F.col("value") - 0.3))
    return rounded(validate.metric_bounds(m), "value")


METRICS_SQL = PREDICTIONS_SQL + """,
  cell AS (SELECT model_name, actual, predicted, count(*) AS n FROM predictions GROUP BY ALL),
  cls AS (SELECT model_name, label, sum(hit) AS hit, sum(support) AS support, sum(given) AS given
    FROM (SELECT model_name, actual AS label, n AS support, 0 AS given,
                 CASE WHEN actual = predicted THEN n ELSE 0 END AS hit FROM cell
          UNION ALL SELECT model_name, predicted, 0, n, 0 FROM cell) u GROUP BY ALL),
  w AS (SELECT model_name,
          sum(support * coalesce(hit / nullif(given, 0), 0)) / sum(support) AS precision,
          sum(support * coalesce(hit / nullif(support, 0), 0)) / sum(support) AS recall,
          sum(support * coalesce(2 * hit / nullif(given + support, 0), 0)) / sum(support)
            AS f1_score,
          sum(hit) / sum(support) AS accuracy FROM cls GROUP BY 1),
  r AS (SELECT model_name, avg(abs(predicted_score - actual_score)) AS mae,
          sqrt(avg(pow(predicted_score - actual_score, 2))) AS rmse,
          1 - sum(pow(predicted_score - actual_score, 2)) / (var_pop(actual_score) * count(*)) AS r2,
          avg(confidence) AS confidence FROM predictions GROUP BY 1),
  wide AS (SELECT * FROM w JOIN r USING (model_name)),
  metrics AS (UNPIVOT wide ON accuracy, precision, recall, f1_score, confidence, mae, rmse, r2
              INTO NAME metric VALUE value)"""


def limits_sql(limits) -> str:
    rows = ", ".join(f"('{m}', '{k}', CAST({v} AS DOUBLE))" for m, (k, v) in limits.items())
    return f"(VALUES {rows}) AS l(metric, kind, threshold)"


def alert_metrics(spark, sf):
    """The models' metrics and, as execution time, a tenth of the mean event value."""
    m = ev.evaluate_models(predictions(spark, sf))
    slow = table(spark, sf, "events").groupBy(F.col("event_type").alias("model_name")).agg(
        (F.avg("value") / 10).alias("value")).withColumn("metric", F.lit("execution_time"))
    return m.unionByName(slow)


ALERT_METRICS_SQL = METRICS_SQL + """,
  more AS (SELECT model_name, metric, value FROM metrics UNION ALL
           SELECT event_type, 'execution_time', avg(value) / 10 FROM events GROUP BY 1)"""
ADVICE_SQL = "CASE " + " ".join(
    f"WHEN metric = '{m}' THEN '{a}'" for m, a in ev.ADVICE.items()
) + f" ELSE '{ev.OTHER_ADVICE}' END"
GRADED_SQL = ALERT_METRICS_SQL + f""",
  graded AS (SELECT model_name, metric, value, threshold,
    CASE WHEN abs(value - threshold) / abs(threshold) > 0.5 THEN 'high'
         WHEN abs(value - threshold) / abs(threshold) > 0.2 THEN 'medium' ELSE 'low' END AS severity,
    metric || ' ' || printf('%.3f', value) || CASE WHEN kind = 'min' THEN ' below' ELSE ' above' END
      || ' threshold ' || printf('%.3f', threshold) AS message, {ADVICE_SQL} AS recommendation
    FROM more JOIN {limits_sql(ev.ALERT_LIMITS)} USING (metric)
    WHERE CASE WHEN kind = 'min' THEN value < threshold ELSE value > threshold END)"""

QUOTA_SQL = f"""
  problems AS ({PROBLEMS_SQL}),
  c AS (SELECT problem_class, count(*) AS n, sum(count(*)) OVER () AS total
        FROM problems GROUP BY 1),
  t AS (SELECT *, ceil(total / 5) AS t, floor(ceil(total / 5) * n / total) AS fl,
               (ceil(total / 5) * n) % total AS rest FROM c),
  quota AS (SELECT problem_class, n, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC,
              problem_class) <= t - sum(fl) OVER () THEN 1 ELSE 0 END AS test_rows FROM t),
  split AS (SELECT problem_id, problem_class, CASE WHEN row_number() OVER (PARTITION BY problem_class
              ORDER BY md5('42:' || CAST(problem_id AS VARCHAR)), problem_id) <= test_rows
              THEN 'test' ELSE 'train' END AS split FROM problems JOIN quota USING (problem_class))"""


def split_rows(spark, sf):
    return split.stratified_split(
        problems(spark, sf).select("problem_id", "problem_class"), "problem_id", "problem_class")


def report(spark, sf):
    p = predictions(spark, sf)
    return ev.report_rows(split_rows(spark, sf), ev.evaluate_models(p),
                          ev.limits_table(spark), "problem_class")


INFO = {"classification_model": "voting", "regression_model": "forest", "feature_count": 3015, "test_size": 0.2, "random_state": 42}


def full_report(spark, sf):
    """The report with the rows on the data set's shares, the models and their quality."""
    return ev.report_rows(split_rows(spark, sf), ev.evaluate_models(predictions(spark, sf)), ev.limits_table(spark),
                          "problem_class", INFO)


def profile(spark, sf):
    df = profiles.core_profile(problems(spark, sf), "description", PROSE_WORDS)
    out = ordered.column_profile(df, ["problem_score", *profiles.CORE_FEATURES])
    return rounded(out.withColumn("count", F.col("count").cast("bigint")),
                   "mean", "std", "min", "q25", "q50", "q75", "max", places=4)


PROFILE_COLUMNS = ["problem_score", *profiles.CORE_FEATURES]
PROFILE_SQL = f"""
  WITH p AS ({PROBLEMS_SQL}), f AS (
    {core_sql("SELECT problem_id, description FROM p0", "problem_id", "description", PROSE_WORDS)}),
  x AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in PROFILE_COLUMNS)}
        FROM f JOIN p USING (problem_id)),
  u AS (UNPIVOT x ON {', '.join(PROFILE_COLUMNS)} INTO NAME name VALUE v)
  SELECT name, count(*) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
    round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS q25,
    round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75,
    round(max(v), 4) AS max FROM u GROUP BY 1""".replace("p0", f"({PROBLEMS_SQL}) p0")


def class_scores(spark, sf):
    return problems(spark, sf).groupBy("problem_class").agg(
        F.min("problem_score").alias("low"), F.max("problem_score").alias("high"),
        F.round(F.avg("problem_score"), 6).alias("mean"))


def order_profile(spark, sf):
    df = table(spark, sf, "orders")
    return rounded(ordered.column_profile(df, ["o_totalprice", "o_custkey"]),
                   "mean", "std", "min", "q25", "q50", "q75", "max", places=3)


ORDER_PROFILE_SQL = " UNION ALL ".join(f"""
  SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 3) AS mean,
    round(stddev_samp({c}), 3) AS std, round(min(CAST({c} AS DOUBLE)), 3) AS min,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 3) AS q25,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 3) AS q50,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 3) AS q75,
    round(max(CAST({c} AS DOUBLE)), 3) AS max FROM orders""" for c in ("o_totalprice", "o_custkey"))

CHAIN_SQL = METRICS_SQL + """,
  chain AS (SELECT task, model_name, value, row_number() OVER (PARTITION BY task
              ORDER BY value DESC, model_name) AS position FROM (
    SELECT CASE metric WHEN 'accuracy' THEN 'classification' ELSE 'regression' END AS task,
           model_name, value FROM metrics WHERE metric IN ('accuracy', 'r2')) x),
  best AS (SELECT task, c.model_name, c.value, task = 'classification' AND m.value < 0.8
             AS low_confidence FROM chain c JOIN metrics m ON m.model_name = c.model_name
             AND m.metric = 'confidence' WHERE position = 1)"""

def split_checks(spark, sf):
    """What the check of a split says for several shares of test rows."""
    rows = problems(spark, sf)
    told = []
    for share in (0.2, 0.01, 0.001):
        try:
            validate.check_split(rows, "problem_class", share)
            told.append((share, "ok"))
        except ValueError as err:
            told.append((share, str(err)))
    return spark.createDataFrame(told, "share double, verdict string")


SPLIT_CHECKS_SQL = f"""
  WITH p AS (SELECT count(*) AS n, count(DISTINCT problem_class) AS k FROM ({PROBLEMS_SQL}) x),
  s AS (SELECT * FROM (VALUES (0.2, 6), (0.01, 101), (0.001, 1001)) AS v(share, per))
  SELECT CAST(share AS DOUBLE) AS share, CASE WHEN n < per * k THEN 'need at least ' || per * k || ' rows for ' || k
    || ' classes, got ' || n ELSE 'ok' END AS verdict FROM p, s"""


def stand_in_metrics(spark, sf):
    """An evaluation that fails for one model, and one that does not."""
    preds = predictions(spark, sf)
    return rounded(ev.evaluate_or_fallback(preds, "absent_model").unionByName(
        ev.evaluate_or_fallback(preds, MODELS[0])), "value")


REPORT_SQL = (
        METRICS_SQL + "," + QUOTA_SQL.replace(f"problems AS ({PROBLEMS_SQL}),", "") + f"""
      SELECT 'dataset' AS section, split || '_samples' AS item, CAST(count(*) AS VARCHAR) AS value
        FROM split GROUP BY split
      UNION ALL SELECT 'class_distribution', problem_class, CAST(count(*) AS VARCHAR) FROM split
        WHERE split = 'train' GROUP BY problem_class
      UNION ALL SELECT 'metrics', model_name || '.' || metric, printf('%.3f', value) FROM metrics
      UNION ALL SELECT 'compliance', model_name || '.' || metric, CASE WHEN
        CASE WHEN kind = 'min' THEN value >= threshold ELSE value <= threshold END THEN 'PASS'
        ELSE 'WARN' END FROM metrics JOIN {limits_sql(ev.LIMITS)} USING (metric)""")


QUERIES = {
    "fil_split_checks": (split_checks, SPLIT_CHECKS_SQL),
    "ml_stand_in_metrics": (stand_in_metrics, METRICS_SQL + f"""
      SELECT model_name, metric, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS fallback_reason
      FROM metrics WHERE model_name = '{MODELS[0]}'
      UNION ALL SELECT 'absent_model', metric, value, 'no predictions' FROM (VALUES
        {', '.join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in ev.FALLBACK_METRICS.items())}) AS f(metric, value)"""),
    "fil_legacy_requests": (checked("legacy"), checked_sql([
        (BLANK % "description", "'Missing required field'",
         "'The description field is required and cannot be empty'")])),
    "fil_structured_requests": (checked("structured"), checked_sql([
        ("missing <> ''", "'Missing required fields'",
         "'Structured format requires all fields: description, input_desc, output_desc. "
         "Missing: ' || missing"),
        (BLANK % COMBINED, "'Empty content'",
         "'At least one of the three fields (description, input_desc, output_desc) "
         "must contain text'")])),
    "fil_strict_requests": (checked("strict"), checked_sql([
        (" OR ".join(BLANK % c for c in validate.FIELDS), "'Empty content'",
         "'All three fields must contain text'")])),
    "fil_quarantine_counts": (quarantine, f"""
      SELECT CASE WHEN description IS NULL OR input_desc IS NULL OR output_desc IS NULL
               THEN 'Missing required fields' WHEN {BLANK % COMBINED} THEN 'Empty content'
               ELSE 'none' END AS error, count(*) AS n FROM ({REQUESTS_SQL}) r GROUP BY 1"""),
    "fil_prediction_fallback": (fallback_rows, PREDICTIONS_SQL + """
      SELECT id, id % 4 = 0 AS fallback_used,
        CASE WHEN id % 4 = 0 THEN 'medium' ELSE predicted END AS cls,
        round(CASE WHEN id % 4 = 0 THEN 5.0 ELSE predicted_score END, 6) AS score,
        round(CAST(CASE WHEN id % 4 = 0 THEN 0.0 ELSE confidence END AS DOUBLE), 6) AS confidence
      FROM predictions WHERE model_pos = 0"""),
    "fil_prediction_quality": (quality, """
      SELECT count(*) AS rows, count_if(event_id % 50 = 2) AS missing,
        count_if(event_id % 50 = 0) AS nan, count_if(event_id % 50 = 1) AS infinite,
        count_if(event_id % 50 < 3) = 0 AS usable FROM events"""),
    "fil_metric_bounds": (bounds, METRICS_SQL + """,
      m AS (SELECT model_name, metric, CASE WHEN metric = 'confidence' THEN value * 3
              ELSE value - 0.3 END AS value FROM metrics)
      SELECT model_name, metric, round(value, 6) AS value,
        CASE WHEN metric = 'accuracy' THEN value BETWEEN 0 AND 1
             WHEN metric IN ('mae', 'rmse') THEN value >= 0 ELSE true END AS in_bounds FROM m"""),
    "agg_column_profile": (profile, PROFILE_SQL),
    "agg_order_profile": (order_profile, ORDER_PROFILE_SQL),
    "agg_class_scores": (class_scores, f"""
      SELECT problem_class, min(problem_score) AS low, max(problem_score) AS high,
        round(avg(problem_score), 6) AS mean FROM ({PROBLEMS_SQL}) p GROUP BY 1"""),
    "ml_stratified_split": (split_rows, f"WITH {QUOTA_SQL} SELECT * FROM split"),
    "agg_split_info": (
        lambda spark, sf: split.split_info(split_rows(spark, sf), "problem_class"),
        f"""WITH {QUOTA_SQL} SELECT split, problem_class, count(*) AS n FROM split
        GROUP BY ROLLUP (split, problem_class)"""),
    "agg_class_weights": (
        lambda spark, sf: rounded(split.class_weights(
            problems(spark, sf).select("problem_class"), "problem_class"), "weight"),
        f"""SELECT problem_class, count(*) AS n,
          round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
        FROM ({PROBLEMS_SQL}) p GROUP BY 1"""),
    "agg_segment_weights": (
        lambda spark, sf: rounded(split.class_weights(
            table(spark, sf, "customer"), "c_mktsegment"), "weight"),
        """SELECT c_mktsegment, count(*) AS n,
          round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
        FROM customer GROUP BY 1"""),
    "agg_confusion_matrix": (
        lambda spark, sf: ev.confusion(predictions(spark, sf), "model_name"),
        METRICS_SQL + f""" SELECT m.model_name, a.x AS actual, b.x AS predicted,
          coalesce(n, 0) AS n FROM (SELECT DISTINCT model_name FROM predictions) m
          CROSS JOIN (SELECT unnest({CLASSES}) AS x) a CROSS JOIN (SELECT unnest({CLASSES}) AS x) b
          LEFT JOIN cell c ON c.model_name = m.model_name AND c.actual = a.x
            AND c.predicted = b.x"""),
    "agg_class_report": (
        lambda spark, sf: rounded(ev.class_report(
            ev.confusion(predictions(spark, sf), "model_name"), "model_name"),
            "precision", "recall", "f1"),
        METRICS_SQL + """,
      per AS (SELECT model_name, label, coalesce(hit / nullif(given, 0), 0) AS precision,
          coalesce(hit / nullif(support, 0), 0) AS recall,
          coalesce(2 * hit / nullif(given + support, 0), 0) AS f1, support, hit FROM cls),
      rows AS (SELECT model_name, label, precision, recall, f1, support FROM per
        UNION ALL SELECT model_name, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)
          FROM per GROUP BY 1
        UNION ALL SELECT model_name, 'weighted avg', sum(precision * support) / sum(support),
          sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
          FROM per GROUP BY 1
        UNION ALL SELECT model_name, 'accuracy', NULL, NULL, sum(hit) / sum(support), sum(support)
          FROM per GROUP BY 1)
      SELECT model_name, label, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rows"""),
    "agg_regression_metrics": (
        lambda spark, sf: rounded(ev.regression_metrics(predictions(spark, sf), ["model_name"]),
                                  "mae", "rmse", "r2"),
        METRICS_SQL + """ SELECT model_name, round(mae, 6) AS mae, round(rmse, 6) AS rmse,
          round(r2, 6) AS r2 FROM r"""),
    "agg_score_error_by_class": (
        lambda spark, sf: rounded(
            ev.score_error_by_class(predictions(spark, sf), ["model_name"]), "mae", "actual_mean",
            "actual_std", "predicted_mean", "predicted_std"),
        PREDICTIONS_SQL + """ SELECT model_name, actual,
          round(avg(abs(predicted_score - actual_score)), 6) AS mae,
          round(avg(actual_score), 6) AS actual_mean,
          round(stddev_pop(actual_score), 6) AS actual_std,
          round(avg(predicted_score), 6) AS predicted_mean,
          round(stddev_pop(predicted_score), 6) AS predicted_std, count(*) AS n
          FROM predictions GROUP BY 1, 2"""),
    "agg_mean_top_probability": (
        lambda spark, sf: rounded(ev.mean_top_probability(
            predictions(spark, sf).withColumn("p", F.array(
                F.col("confidence"), (1 - F.col("confidence")) / 2,
                (1 - F.col("confidence")) / 2)), "model_name", "p"), "confidence"),
        PREDICTIONS_SQL + """ SELECT model_name,
          round(avg(greatest(confidence, (1 - confidence) / 2)), 6) AS confidence
          FROM predictions GROUP BY 1"""),
    "join_truth": (
        lambda spark, sf: rounded(ev.with_truth(
            predictions(spark, sf).select("id", "model_name", "predicted", "predicted_score"),
            problems(spark, sf).select(F.col("problem_id").alias("id"), "problem_class",
                                       "problem_score")), "predicted_score"),
        PREDICTIONS_SQL + """ SELECT id, model_name, predicted,
          round(predicted_score, 6) AS predicted_score, problem_class, problem_score
          FROM predictions JOIN problems ON id = problem_id"""),
    "ml_evaluate_models": (
        lambda spark, sf: rounded(ev.evaluate_models(predictions(spark, sf)), "value"),
        METRICS_SQL + " SELECT model_name, metric, round(value, 6) AS value FROM metrics"),
    "ml_threshold_verdicts": (
        lambda spark, sf: rounded(ev.verdicts(
            ev.evaluate_models(predictions(spark, sf)), ev.limits_table(spark)), "value"),
        METRICS_SQL + f""", v AS (SELECT *, CASE WHEN kind = 'min' THEN value >= threshold
            ELSE value <= threshold END AS acceptable FROM metrics JOIN {limits_sql(ev.LIMITS)}
            USING (metric))
          SELECT metric, model_name, round(value, 6) AS value, kind, threshold, acceptable,
            bool_and(acceptable) OVER (PARTITION BY model_name) AS overall_acceptable,
            CASE WHEN acceptable THEN 'PASS' ELSE 'WARN' END AS label FROM v"""),
    "ml_graded_alerts": (
        lambda spark, sf: rounded(ev.graded_alerts(
            alert_metrics(spark, sf), ev.limits_table(spark, ev.ALERT_LIMITS)), "value"),
        GRADED_SQL + """ SELECT model_name, metric, round(value, 6) AS value, threshold, severity,
          message, recommendation FROM graded"""),
    "ml_validation_status": (
        lambda spark, sf: ev.validation_status(
            alert_metrics(spark, sf), ev.limits_table(spark, ev.ALERT_LIMITS)),
        GRADED_SQL + """ SELECT m.model_name, count(g.metric) AS alerts,
          CASE WHEN bool_or(severity = 'high') THEN 'degraded' WHEN count(g.metric) > 0
            THEN 'warning' ELSE 'healthy' END AS status
          FROM (SELECT DISTINCT model_name FROM more) m LEFT JOIN graded g USING (model_name)
          GROUP BY 1"""),
    "ml_evaluation_report": (report, REPORT_SQL),
    "ml_evaluation_report_full": (full_report, REPORT_SQL + f"""
      UNION ALL SELECT 'dataset', 'total_samples', CAST(count(*) AS VARCHAR) FROM split
      UNION ALL SELECT 'dataset', s || '_share', CAST(round(count_if(split = s) * 100.0 / count(*), 1) AS VARCHAR) || '%'
        FROM split, (VALUES ('test'), ('train')) AS v(s) GROUP BY s
      UNION ALL SELECT 'model', k, v FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in INFO.items())}) AS i(k, v)
      UNION ALL SELECT 'quality', model_name, CASE WHEN bool_and(CASE WHEN kind = 'min' THEN value >= threshold
        ELSE value <= threshold END) THEN 'acceptable' ELSE 'mixed' END
        FROM metrics JOIN {limits_sql(ev.LIMITS)} USING (metric) GROUP BY 2"""),
    "top_fallback_chain": (
        lambda spark, sf: rounded(ev.fallback_chain(
            ev.evaluate_models(predictions(spark, sf))), "value"),
        CHAIN_SQL + " SELECT task, model_name, round(value, 6) AS value, position FROM chain"),
    "top_best_models": (
        lambda spark, sf: rounded(ev.best_models(
            ev.evaluate_models(predictions(spark, sf))), "value"),
        CHAIN_SQL + " SELECT task, model_name, round(value, 6) AS value, low_confidence FROM best"),
    "top_sample_rows": (
        lambda spark, sf: rounded(ev.sample_rows(
            predictions(spark, sf).where("model_pos = 0").select(
                "id", "actual", "predicted", "predicted_score"), "id"), "predicted_score"),
        PREDICTIONS_SQL + """ SELECT id, actual, predicted,
          round(predicted_score, 6) AS predicted_score FROM predictions WHERE model_pos = 0
          ORDER BY id LIMIT 3"""),
    "ml_single_best": (
        lambda spark, sf: rounded(ev.single_best(
            predictions(spark, sf), ev.evaluate_models(predictions(spark, sf))),
            "predicted_score", "confidence"),
        CHAIN_SQL + """ SELECT c.id, c.predicted, round(r.predicted_score, 6) AS predicted_score,
          round(CAST(c.confidence AS DOUBLE), 6) AS confidence,
          c.model_name || '+' || r.model_name AS model_used
          FROM predictions c JOIN best bc ON bc.task = 'classification'
            AND bc.model_name = c.model_name
          JOIN predictions r ON r.id = c.id JOIN best br ON br.task = 'regression'
            AND br.model_name = r.model_name"""),
}
