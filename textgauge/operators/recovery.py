"""Answers for rows whose model failed, and the statistics of such recoveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ensemble import majority_vote
from .validate import FALLBACK

# The ladder, best answer first. No lighter model exists, so that step never answers.
LADDER = ("cached_response", "fallback_model", "ensemble_voting", "default_response")


def other_models(predictions: DataFrame, failures: DataFrame) -> DataFrame:
    """Predictions for the failed rows without those of the model that failed."""
    mine = predictions.join(failures.select("id"), "id", "left_semi")
    return mine.join(failures.select("id", F.col("failed_model").alias("model_name")),
                     ["id", "model_name"], "left_anti")


def recover(failures: DataFrame, cached: DataFrame, predictions: DataFrame,
            ladder: Sequence[str] = LADDER) -> DataFrame:
    """An answer for every failed row (id, failed_model, error) from the first step that has one.

    cached: valid cache entries per id (predicted, predicted_score, confidence); predictions: long
    form with model_pos. The fallback model is the earliest other model with an answer; a vote
    needs two. Each step is one aggregate by id, attached by a left join.
    """
    answer = ["predicted", "predicted_score", "confidence"]
    others = other_models(predictions.where(F.col("predicted").isNotNull()), failures)
    first = others.groupBy("id").agg(
        F.min_by(F.struct(*answer), "model_pos").alias("_fallback_model"),
        F.count("*").alias("_models"))
    votes = majority_vote(others).select("id", F.struct(*answer).alias("_vote"))
    steps = {
        "cached_response": F.col("_cached"),
        "fallback_model": F.col("_fallback_model"),
        "ensemble_voting": F.when(F.col("_models") >= 2, F.col("_vote")),
        "default_response": F.struct(
            F.lit(FALLBACK["class"]).alias("predicted"),
            F.lit(FALLBACK["score"]).alias("predicted_score"),
            F.lit(FALLBACK["confidence"]).alias("confidence")),
    }
    tagged = [F.when(steps[s].isNotNull(), F.struct(F.lit(s).alias("strategy"),
                                                    *[steps[s][c].alias(c) for c in answer]))
              for s in ladder]
    return (failures
            .join(cached.select("id", F.struct(*answer).alias("_cached")), "id", "left")
            .join(first, "id", "left").join(votes, "id", "left")
            .withColumn("_a", F.coalesce(*tagged))
            .select("id", "failed_model", F.col("error").alias("original_error"),
                    F.lit(True).alias("recovery_used"),
                    F.coalesce("_a.strategy", F.lit("emergency_fallback")).alias("strategy"),
                    F.coalesce("_a.predicted", F.lit(FALLBACK["class"])).alias("predicted"),
                    F.coalesce("_a.predicted_score", F.lit(FALLBACK["score"]))
                    .alias("predicted_score"),
                    F.coalesce("_a.confidence", F.lit(FALLBACK["confidence"]))
                    .alias("confidence")))


def recovery_statistics(actions: DataFrame, as_of: str) -> DataFrame:
    """Per strategy and in total: actions, successes, success %, last 24 h, time of the last."""
    day = F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    ok = F.count_if("success")
    return actions.rollup("strategy").agg(
        F.count("*").alias("total"), ok.alias("successful"),
        F.round(ok / F.count("*") * 100, 2).alias("success_rate"),
        F.count_if(day).alias("recent_24h"), F.max("ts").alias("last_action"))
