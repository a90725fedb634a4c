"""Ensembles over long predictions, and the weight table that drives them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CLASSES
from ..session import cut, small

# Answers when nothing was predicted, and the rules of weight adaptation.
DEFAULT_CLASS, DEFAULT_SCORE = "medium", 5.0
BOOST, DECAY, MIN_WEIGHT = 1.05, 0.95, 0.01
HIGHER_IS_BETTER = ["accuracy", "f1_score", "r2_score", "precision", "recall"]
METHODS = ("weighted_voting", "majority_vote", "average")


def _vote(predicted: str, position: str, weight: Column, labels: Sequence[str]) -> Column:
    """The label with the most weight; of equals, the one predicted by the earliest model.

    Weights are summed per label as conditional aggregates, so one shuffle by row id is enough.
    Rounding keeps the order of summation from deciding ties.
    """
    entries = []
    for label in labels:
        hit = F.col(predicted) == label
        entries.append(F.struct(
            F.round(F.sum(F.when(hit, weight)), 9).alias("votes"),
            (-F.min(F.when(hit, F.col(position)))).alias("first"), F.lit(label).alias("label")))
    given = F.filter(F.array(*entries), lambda e: e["first"].isNotNull())
    return F.coalesce(F.array_max(given)["label"], F.lit(DEFAULT_CLASS))


def _weighted_mean(value: str, weight: Column, default: float) -> Column:
    has = F.col(value).isNotNull()
    return F.coalesce(F.try_divide(F.sum(F.col(value) * weight), F.sum(F.when(has, weight))),
                      F.lit(default))


def _details() -> Column:
    """Per-model answers of a row; as many entries as there are models."""
    return F.map_from_entries(F.collect_list(F.struct("model_name", F.struct(
        "predicted", "predicted_score", "confidence"))))


def majority_vote(predictions: DataFrame, labels: Sequence[str] = CLASSES,
                  default_confidence: float = 0.5, details: bool = False) -> DataFrame:
    """Most frequent class, mean score and mean confidence per id."""
    extra = [_details().alias("individual_predictions")] if details else []
    return predictions.groupBy("id").agg(
        _vote("predicted", "model_pos", F.lit(1.0), labels).alias("predicted"),
        F.coalesce(F.avg("predicted_score"), F.lit(DEFAULT_SCORE)).alias("predicted_score"),
        F.coalesce(F.avg("confidence"), F.lit(default_confidence)).alias("confidence"), *extra)


def weighted_vote(predictions: DataFrame, weights: DataFrame, labels: Sequence[str] = CLASSES,
                  default_confidence: float = 0.5, details: bool = False) -> DataFrame:
    """Class with the greatest weight, weight-averaged score and confidence per id.

    A model without a weight counts with none.
    """
    joined = predictions.join(small(weights.select("model_name", "weight")), "model_name", "left")
    w = F.coalesce(F.col("weight"), F.lit(0.0))
    extra = [_details().alias("individual_predictions")] if details else []
    return joined.groupBy("id").agg(
        _vote("predicted", "model_pos", w, labels).alias("predicted"),
        _weighted_mean("predicted_score", w, DEFAULT_SCORE).alias("predicted_score"),
        _weighted_mean("confidence", w, default_confidence).alias("confidence"), *extra)


def ensemble(predictions: DataFrame, method: str, weights: DataFrame | None = None,
             **options) -> DataFrame:
    """Predict by the named method; "average" is the majority vote."""
    if method not in METHODS:
        raise ValueError(f"unknown ensemble method: {method}")
    if method == "weighted_voting":
        if weights is None:
            raise ValueError("weighted voting needs weights")
        out = weighted_vote(predictions, weights, **options)
    else:
        out = majority_vote(predictions, **options)
    return out.withColumn("ensemble_method", F.lit(method))


def soft_vote(probabilities: DataFrame, labels: Sequence[str] = CLASSES) -> DataFrame:
    """Argmax of the models' mean class probabilities; (id, model_name, probs array by label)."""
    means = F.array(*[F.avg(F.col("probs")[i]) for i in range(len(labels))])
    names = F.array(*[F.lit(x) for x in labels])
    return probabilities.groupBy("id").agg(means.alias("probs")).withColumn(
        "confidence", F.array_max("probs")).withColumn(
        "predicted", F.element_at(names, F.array_position("probs", F.col("confidence")).cast("int")))


def equal_weights(spark: SparkSession, models: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(m, 1.0 / len(models)) for m in models],
                                 "model_name string, weight double")


def normalise_weights(weights: DataFrame) -> DataFrame:
    """Weights to a sum of one; all zero becomes equal. One row per model, so one task is right."""
    every = Window.partitionBy()
    total, n = F.sum("weight").over(every), F.count("*").over(every)
    return weights.withColumn(
        "weight", F.when(total > 0, F.col("weight") / total).otherwise(F.lit(1.0) / n))


def adapted(weight: Column, value: Column, metric: str | Column) -> Column:
    """A model's weight after one report of `metric`, before normalising."""
    up = (F.lit(metric) if isinstance(metric, str) else metric).isin(HIGHER_IS_BETTER)
    good = F.when(up, value > 0.7).otherwise(value < 1.0)
    poor = F.when(up, value < 0.5).otherwise(value > 2.0)
    factor = F.when(good, BOOST).when(poor, DECAY).otherwise(1.0)
    return F.when(value.isNull(), weight).otherwise(
        F.greatest(weight * factor, F.lit(MIN_WEIGHT)))


#: Reports that one task folds.
SLICE_REPORTS = 50_000


def fold_reports(weights: DataFrame, reports: DataFrame, slice_reports: int = SLICE_REPORTS) -> DataFrame:
    """Weights after each report: (seq, metric, model_name, weight).

    reports: (seq, model_name, metric, value), applied in order of seq and metric; a model that a
    report leaves out keeps its weight before normalising.

    Normalising scales all weights alike, so as long as no weight falls to the floor, weights are the
    start times a product of factors. Reports are cut into slices by seq. Each slice tells, per model,
    the product of its factors and the least and greatest product on the way; a scan over the slices
    carries the start weights on by these, and only a slice in which some weight may reach the floor is
    folded at once, from its start, to know where it ends. With all starts known, the slices are folded
    side by side. The driver holds one row per slice and model.
    """
    start = {r["model_name"]: float(r["weight"]) for r in weights.select("model_name", "weight").collect()}
    models = sorted(start)
    values = reports.groupBy("seq", "metric", "model_name").agg(F.max("value").alias("value"))
    per = cut(values.groupBy("seq", "metric").agg(F.map_from_entries(
        F.collect_list(F.struct("model_name", "value"))).alias("values")))
    parts = max(1, -(-per.count() // slice_reports))
    shares = [i / parts for i in range(1, parts)]
    bounds = per.agg(F.percentile_approx("seq", shares, 100 * parts)).first()[0] if shares else []
    number = F.size(F.filter(F.lit(sorted(set(bounds or []))).cast("array<bigint>"), lambda b: b < F.col("seq")))
    known = F.array(*[F.try_element_at("values", F.lit(m)) for m in models])
    sliced = cut(per.select("seq", "metric", number.alias("slice"), known.alias("values"),
                            F.col("metric").isin(HIGHER_IS_BETTER).alias("up")))
    starts = _slice_starts(sliced, [start[m] for m in models])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        told = _folded(pdf, starts[int(pdf["slice"].iloc[0])])
        pdf = pdf.sort_values(["seq", "metric"])
        return pd.DataFrame({"seq": np.repeat(pdf["seq"].to_numpy(), len(models)), "metric": np.repeat(pdf["metric"].to_numpy(), len(models)),
                             "model_name": np.tile(np.array(models, dtype=object), len(pdf)), "weight": told.ravel()})

    return sliced.groupBy("slice").applyInPandas(fold, "seq bigint, metric string, model_name string, weight double")


def _factors(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per report of a slice, in order, and per model: its factor, and whether the report names it."""
    pdf = pdf.sort_values(["seq", "metric"])
    x = np.array([[np.nan if v is None else v for v in row] for row in pdf["values"]], dtype=float)
    up = pdf["up"].to_numpy(dtype=bool)[:, None]
    with np.errstate(invalid="ignore"):
        good, poor = np.where(up, x > 0.7, x < 1.0), np.where(up, x < 0.5, x > 2.0)
    return np.where(good, BOOST, np.where(poor, DECAY, 1.0)), ~np.isnan(x)


def _folded(pdf: pd.DataFrame, start: Sequence[float]) -> np.ndarray:
    """The weights after each report of a slice, one report after the other."""
    factors, named = _factors(pdf)
    out, now = np.empty(factors.shape), np.array(start, dtype=float)
    for i, (f, has) in enumerate(zip(factors, named, strict=True)):
        now = np.where(has, np.maximum(now * f, MIN_WEIGHT), now)
        total = now.sum()
        now = now / total if total > 0 else np.full(len(now), 1.0 / len(now))
        out[i] = now
    return out


def _slice_starts(sliced: DataFrame, start: list[float]) -> dict[int, list[float]]:
    """The weights at the start of each slice."""
    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        factors, _ = _factors(pdf)
        way = np.cumsum(np.log(factors), axis=0)
        n = factors.shape[1]
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]] * n, "model": range(n), "last": way[-1], "least": way.min(axis=0),
                             "most": way.max(axis=0)})

    rows: dict[int, list] = {}
    summary = sliced.groupBy("slice").applyInPandas(summarise, "slice int, model int, last double, least double, most double")
    for r in summary.collect():  # one row per slice and model
        rows.setdefault(r["slice"], []).append(r)
    now, out, order = np.array(start), {}, sorted(rows)
    for i, s in enumerate(order):
        out[s] = now.tolist()
        if i + 1 == len(order):
            break
        last, least, most = (np.array([r[c] for r in sorted(rows[s], key=lambda r: r["model"])]) for c in ("last", "least", "most"))
        # The least that a weight can be on the way, with all others at their greatest.
        high = now * np.exp(np.maximum(most, 0))
        low = now * np.exp(np.minimum(least, 0)) * DECAY / max(high.sum(), 1e-300)
        if (low > MIN_WEIGHT).all() and (now * DECAY > MIN_WEIGHT).all():
            now = now * np.exp(last)
            now = now / now.sum()
        else:
            now = _slice_end(sliced.where(F.col("slice") == s), out[s])
    return out


def _slice_end(rows: DataFrame, start: Sequence[float]) -> np.ndarray:
    """The weights behind one slice, folded in a task."""
    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"end": [_folded(pdf, start)[-1].tolist()]})

    return np.array(rows.groupBy("slice").applyInPandas(end, "end array<double>").first()["end"])


def update_weights(weights: DataFrame, report: DataFrame, metric: str) -> DataFrame:
    """One adaptation step from a report (model_name, value)."""
    joined = weights.join(report.select("model_name", "value"), "model_name", "left")
    return normalise_weights(joined.select(
        "model_name", adapted(F.col("weight"), F.col("value"), metric).alias("weight")))


def reset_weights(weights: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Equal weights, or one step from each model's newest value (model_name, ts, value)."""
    if history is None:
        every = Window.partitionBy()
        return weights.withColumn("weight", F.lit(1.0) / F.count("*").over(every))
    latest = history.groupBy("model_name").agg(F.max_by("value", "ts").alias("value"))
    return update_weights(weights, latest, "accuracy")


def add_model(weights: DataFrame, name: str, weight: float | None = None) -> DataFrame:
    """Add a model with the given weight (default one over the new number of models)."""
    n = weights.agg(F.count("*").alias("n"))
    given = F.lit(float(weight)) if weight is not None else F.lit(1.0) / (F.col("n") + 1)
    row = n.select(F.lit(name).alias("model_name"), given.alias("weight"))
    return normalise_weights(weights.select("model_name", "weight").unionByName(row))


def remove_model(weights: DataFrame, name: str) -> DataFrame:
    return normalise_weights(weights.where(F.col("model_name") != name))


def history_statistics(history: DataFrame) -> DataFrame:
    """Per model: mean, population std, count and newest of its reported values."""
    return history.groupBy("model_name").agg(
        F.avg("value").alias("average"), F.stddev_pop("value").alias("std"),
        F.count("*").alias("count"), F.max_by("value", "ts").alias("latest"))


def weight_statistics(weights: DataFrame) -> DataFrame:
    return weights.agg(F.count("*").alias("models"), F.min("weight").alias("min_weight"),
                       F.max("weight").alias("max_weight"),
                       F.stddev_pop("weight").alias("weight_std"))


def model_usage(served: DataFrame, model_used: str = "model_used") -> DataFrame:
    """How often each model took part: a "clf+reg" answer counts once for both."""
    return served.select(F.explode(F.split(model_used, r"\+")).alias("model_name")).groupBy(
        "model_name").agg(F.count("*").alias("uses"))


def long_predictions(df: DataFrame, models: Mapping[str, object], key: str = "id") -> DataFrame:
    """Apply each transformer to df and stack (id, model_name, model_pos, prediction[, probability]).

    `models` maps names to anything with transform(); one that cannot run is left out.
    """
    out = None
    for pos, (name, model) in enumerate(models.items()):
        try:
            scored = model.transform(df)
            cols = [F.col(key).alias("id"), F.lit(name).alias("model_name"),
                    F.lit(pos).alias("model_pos"), F.col("prediction").cast("double")]
            has = "probability" in scored.columns
            prob = F.col("probability") if has else F.lit(None)
            if has and scored.schema["probability"].dataType.typeName() not in ("array",):
                from pyspark.ml.functions import vector_to_array
                prob = vector_to_array("probability")
            part = scored.select(*cols, prob.cast("array<double>").alias("probs"))
        except Exception as err:  # noqa: BLE001 - a broken model must not stop the others
            print(f"model {name} left out: {str(err).splitlines()[0]}")
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise RuntimeError("no model could predict")
    return out
