"""Ensembles, weights, model usage and recovery over the long predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as en
from ..operators import evaluate as ev
from ..operators import recovery
from ..schemas import CLASSES
from .fixtures import (AS_OF, MODELS, PREDICTIONS_SQL, SNAPSHOTS_SQL, TELEMETRY_SQL, predictions,
                       rounded, snapshots, telemetry)
from .evaluation import CHAIN_SQL

WEIGHTS = {MODELS[0]: 0.25, MODELS[1]: 0.25, MODELS[2]: 0.5}


def partial(spark, sf):
    """Predictions with gaps: some models did not answer for some rows."""
    gap = (F.col("id") + F.col("model_pos")) % 6 == 0
    df = predictions(spark, sf)
    return df.withColumns({c: F.when(~gap, F.col(c))
                           for c in ("predicted", "predicted_score", "confidence")})


PARTIAL_SQL = PREDICTIONS_SQL + """,
  partial AS (SELECT id, model_name, model_pos,
    CASE WHEN (id + model_pos) % 6 <> 0 THEN predicted END AS predicted,
    CASE WHEN (id + model_pos) % 6 <> 0 THEN predicted_score END AS predicted_score,
    CASE WHEN (id + model_pos) % 6 <> 0 THEN confidence END AS confidence FROM predictions)"""


def weights(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "model_name string, weight double")


WEIGHTS_SQL = "(VALUES " + ", ".join(
    f"('{m}', CAST({w} AS DOUBLE))" for m, w in WEIGHTS.items()) + ") AS w(model_name, weight)"


def vote_sql(weight: str, source: str = "partial", conf: float = 0.5) -> str:
    return f"""
  v AS (SELECT id, predicted, round(sum({weight}), 9) AS votes, min(model_pos) AS first
        FROM {source} p LEFT JOIN {WEIGHTS_SQL} USING (model_name)
        WHERE predicted IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT id, predicted FROM (SELECT *, row_number() OVER (PARTITION BY id
          ORDER BY votes DESC, first) AS rn FROM v) WHERE rn = 1),
  s AS (SELECT id, sum(predicted_score * {weight}) / nullif(sum(CASE WHEN predicted_score IS NOT NULL
            THEN {weight} END), 0) AS score,
          sum(confidence * {weight}) / nullif(sum(CASE WHEN confidence IS NOT NULL
            THEN {weight} END), 0) AS conf
        FROM {source} p LEFT JOIN {WEIGHTS_SQL} USING (model_name) GROUP BY 1),
  voted AS (SELECT s.id, coalesce(predicted, 'medium') AS predicted,
          round(coalesce(score, 5.0), 6) AS predicted_score,
          round(coalesce(conf, {conf}), 6) AS confidence FROM s LEFT JOIN c USING (id))"""


def vote_rows(method, **options):
    def run(spark, sf):
        out = en.ensemble(partial(spark, sf), method, weights(spark), **options)
        return rounded(out, "predicted_score", "confidence")
    return run


def details(spark, sf):
    out = en.ensemble(partial(spark, sf), "majority_vote", details=True)
    return out.select("id", F.explode("individual_predictions").alias("model_name", "d")).select(
        "id", "model_name", "d.predicted", F.round("d.predicted_score", 6).alias("score"))


def probabilities(spark, sf):
    p = predictions(spark, sf)
    c = F.col("confidence")
    probs = F.array(*[F.when(F.col("predicted") == x, c).otherwise((1 - c) / 2) for x in CLASSES])
    return p.select("id", "model_name", probs.alias("probs"))


def soft(spark, sf):
    out = en.soft_vote(probabilities(spark, sf))
    return out.select("id", "predicted", F.round("confidence", 6).alias("confidence"))


PROBS_SQL = PREDICTIONS_SQL + ", m AS (SELECT id, " + ", ".join(
    f"avg(CASE WHEN predicted = '{x}' THEN confidence ELSE (1 - confidence) / 2 END) AS p{i}"
    for i, x in enumerate(CLASSES)) + " FROM predictions GROUP BY 1)"


def reports(spark, sf):
    """Each model's daily share of confident answers as a performance history."""
    return snapshots(spark, sf).where("accuracy IS NOT NULL").select(
        "model_name", "ts", F.col("accuracy").alias("value"))


REPORTS_SQL = f"SELECT model_name, ts, accuracy AS value FROM ({SNAPSHOTS_SQL}) s WHERE accuracy IS NOT NULL"


def start_weights(spark, sf):
    """Weights in proportion to each model's share of events."""
    return en.normalise_weights(telemetry(spark, sf).groupBy("model_name").agg(
        F.count("*").cast("double").alias("weight")))


START_SQL = f"""SELECT model_name, count(*) / sum(count(*)) OVER () AS weight
  FROM ({TELEMETRY_SQL}) e GROUP BY 1"""


def step_sql(report: str, good: str, poor: str) -> str:
    return f"""
  WITH w AS ({START_SQL}), r AS ({report}),
  x AS (SELECT model_name, CASE WHEN value IS NULL THEN weight ELSE greatest(weight *
      CASE WHEN {good} THEN 1.05 WHEN {poor} THEN 0.95 ELSE 1.0 END, 0.01) END AS weight
    FROM w LEFT JOIN r USING (model_name))
  SELECT model_name, round(weight / sum(weight) OVER (), 6) AS weight FROM x"""


LATEST_SQL = f"SELECT model_name, arg_max(value, ts) AS value FROM ({REPORTS_SQL}) h GROUP BY 1"


def accuracy_step(spark, sf):
    latest = reports(spark, sf).groupBy("model_name").agg(F.max_by("value", "ts").alias("value"))
    return rounded(en.update_weights(start_weights(spark, sf), latest, "accuracy"), "weight")


def error_step(spark, sf):
    err = telemetry(spark, sf).groupBy("model_name").agg(
        (F.avg("prediction_time") / 250).alias("value"))
    return rounded(en.update_weights(start_weights(spark, sf), err, "mae"), "weight")


def failures(spark, sf):
    """Rows whose first model failed, with what went wrong."""
    return predictions(spark, sf).where((F.col("model_pos") == F.col("id") % 3)).select(
        "id", F.col("model_name").alias("failed_model"),
        F.concat(F.lit("no answer for "), F.col("id").cast("string")).alias("error"))


def recovered(ladder):
    def run(spark, sf):
        gone = (F.col("id") + F.col("model_pos")) % 3 == 0
        preds = predictions(spark, sf).withColumn(
            "predicted", F.when(~(gone & (F.col("id") % 4 == 0)), F.col("predicted"))).where(
            F.col("id") % 9 != 0)
        cached = predictions(spark, sf).where((F.col("model_pos") == 0) & (F.col("id") % 5 == 0))
        out = recovery.recover(failures(spark, sf), cached, preds, ladder)
        return rounded(out, "predicted_score", "confidence")
    return run


def recovered_sql(use_fallback: bool) -> str:
    steps = ["cached"] + (["fallback"] if use_fallback else []) + ["vote"]
    strategy = {"cached": "cached_response", "fallback": "fallback_model",
                "vote": "ensemble_voting"}
    alias = {"cached": "k", "fallback": "f", "vote": "vv"}

    def pick(column, default):
        parts = " ".join(f"WHEN {alias[s]}.id IS NOT NULL THEN {alias[s]}.{column}" for s in steps)
        return f"CASE {parts} ELSE {default} END"
    names = " ".join(f"WHEN {alias[s]}.id IS NOT NULL THEN '{strategy[s]}'" for s in steps)
    return PREDICTIONS_SQL + f""",
  failed AS (SELECT id, model_name AS failed_model, 'no answer for ' || id AS error
             FROM predictions WHERE model_pos = id % 3),
  others AS (SELECT p.* FROM predictions p JOIN failed x ON p.id = x.id
             AND p.model_name <> x.failed_model
             WHERE p.id % 9 <> 0 AND NOT ((p.id + p.model_pos) % 3 = 0 AND p.id % 4 = 0)),
  k AS (SELECT * FROM predictions WHERE model_pos = 0 AND id % 5 = 0),
  f AS (SELECT * FROM others QUALIFY row_number() OVER (PARTITION BY id ORDER BY model_pos) = 1),
  {vote_sql('1.0', 'others').replace('voted AS', 'voted0 AS')},
  vv AS (SELECT voted0.* FROM voted0 JOIN (SELECT id FROM others GROUP BY 1 HAVING count(*) >= 2)
         USING (id))
  SELECT failed.id, failed_model, error AS original_error, true AS recovery_used,
    CASE {names} ELSE 'default_response' END AS strategy,
    {pick('predicted', "'medium'")} AS predicted,
    round(CAST({pick('predicted_score', '5.0')} AS DOUBLE), 6) AS predicted_score,
    round(CAST({pick('confidence', '0.0')} AS DOUBLE), 6) AS confidence
  FROM failed LEFT JOIN k ON k.id = failed.id LEFT JOIN f ON f.id = failed.id
  LEFT JOIN vv ON vv.id = failed.id"""


def recovery_stats(spark, sf):
    i = F.col("event_id")
    actions = telemetry(spark, sf).select(
        F.when(i % 7 == 0, "default_response").when(i % 3 == 0, "fallback_model")
        .otherwise("cached_response").alias("strategy"), "ts",
        (F.col("confidence") >= 0.2).alias("success"))
    out = recovery.recovery_statistics(actions, AS_OF)
    return out.withColumn("last_action", F.unix_micros("last_action"))


def usage(spark, sf):
    p = predictions(spark, sf)
    return en.model_usage(ev.single_best(p, ev.evaluate_models(p)).select("model_used").unionByName(
        p.select(F.concat_ws("+", "model_name", F.lit(MODELS[0])).alias("model_used"))))


def best_usage_sql() -> str:
    return CHAIN_SQL + f""",
  used AS (SELECT model_name FROM predictions UNION ALL SELECT '{MODELS[0]}' FROM predictions
           UNION ALL SELECT b.model_name FROM best b, problems)
  SELECT model_name, count(*) AS uses FROM used GROUP BY 1"""


QUERIES = {
    "ml_soft_vote": (soft, PROBS_SQL + """ SELECT id,
      CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'easy' WHEN p1 >= p2 THEN 'medium' ELSE 'hard' END
        AS predicted, round(greatest(p0, p1, p2), 6) AS confidence FROM m"""),
    "ml_majority_vote": (
        vote_rows("majority_vote"),
        PARTIAL_SQL + "," + vote_sql("1.0") +
        " SELECT *, 'majority_vote' AS ensemble_method FROM voted"),
    "ml_majority_vote_manager": (
        vote_rows("average", default_confidence=0.0),
        PARTIAL_SQL + "," + vote_sql("1.0", conf=0.0) +
        " SELECT *, 'average' AS ensemble_method FROM voted"),
    "ml_weighted_vote": (
        vote_rows("weighted_voting"),
        PARTIAL_SQL + "," + vote_sql("coalesce(weight, 0)") +
        " SELECT *, 'weighted_voting' AS ensemble_method FROM voted"),
    "ml_vote_details": (details, PARTIAL_SQL + """ SELECT id, model_name, predicted,
      round(predicted_score, 6) AS score FROM partial"""),
    "win_weight_step_accuracy": (accuracy_step, step_sql(LATEST_SQL, "value > 0.7", "value < 0.5")),
    "win_weight_step_error": (error_step, step_sql(
        f"SELECT model_name, avg(prediction_time) / 250 AS value FROM ({TELEMETRY_SQL}) e GROUP BY 1",
        "value < 1.0", "value > 2.0")),
    "win_reset_weights": (
        lambda spark, sf: rounded(en.reset_weights(start_weights(spark, sf)), "weight"),
        f"SELECT model_name, round(1.0 / count(*) OVER (), 6) AS weight FROM ({START_SQL}) w"),
    "win_reset_weights_by_history": (
        lambda spark, sf: rounded(en.reset_weights(start_weights(spark, sf), reports(spark, sf)),
                                  "weight"),
        step_sql(LATEST_SQL, "value > 0.7", "value < 0.5")),
    "win_add_model": (
        lambda spark, sf: rounded(en.add_model(start_weights(spark, sf), "extra_model"), "weight"),
        f"""WITH w AS ({START_SQL}), u AS (SELECT model_name, weight FROM w
          UNION ALL SELECT 'extra_model', 1.0 / (count(*) + 1) FROM w)
        SELECT model_name, round(weight / sum(weight) OVER (), 6) AS weight FROM u"""),
    "win_remove_model": (
        lambda spark, sf: rounded(en.remove_model(start_weights(spark, sf), "error"), "weight"),
        f"""SELECT model_name, round(weight / sum(weight) OVER (), 6) AS weight
        FROM ({START_SQL}) w WHERE model_name <> 'error'"""),
    "agg_history_statistics": (
        lambda spark, sf: rounded(en.history_statistics(reports(spark, sf)), "average", "std",
                                  "latest"),
        f"""SELECT model_name, round(avg(value), 6) AS average, round(stddev_pop(value), 6) AS std,
          count(*) AS count, round(arg_max(value, ts), 6) AS latest
        FROM ({REPORTS_SQL}) h GROUP BY 1"""),
    "agg_weight_statistics": (
        lambda spark, sf: rounded(en.weight_statistics(start_weights(spark, sf)), "min_weight",
                                  "max_weight", "weight_std"),
        f"""SELECT count(*) AS models, round(min(weight), 6) AS min_weight,
          round(max(weight), 6) AS max_weight, round(stddev_pop(weight), 6) AS weight_std
        FROM ({START_SQL}) w"""),
    "agg_model_usage": (usage, best_usage_sql()),
    "ml_recovery_ladder": (recovered(recovery.LADDER), recovered_sql(True)),
    "ml_recovery_by_vote": (
        recovered(("cached_response", "ensemble_voting", "default_response")),
        recovered_sql(False)),
    "join_other_models": (
        lambda spark, sf: rounded(recovery.other_models(
            predictions(spark, sf), failures(spark, sf)).select(
            "id", "model_name", "predicted", "predicted_score"), "predicted_score"),
        PREDICTIONS_SQL + """ SELECT id, model_name, predicted,
          round(predicted_score, 6) AS predicted_score FROM predictions WHERE model_pos <> id % 3"""),
    "agg_recovery_statistics": (recovery_stats, f"""
      SELECT strategy, count(*) AS total, count_if(success) AS successful,
        round(count_if(success) / count(*) * 100, 2) AS success_rate,
        count_if(ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS recent_24h,
        epoch_us(max(ts)) AS last_action
      FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'default_response' WHEN event_id % 3 = 0
              THEN 'fallback_model' ELSE 'cached_response' END AS strategy, ts,
              confidence >= 0.2 AS success FROM ({TELEMETRY_SQL}) e) a GROUP BY ROLLUP (strategy)"""),
}
