"""Model evaluation: confusion matrix, class report, error metrics, verdicts, model ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CLASSES

# Acceptance limits of a training run.
LIMITS = {"accuracy": ("min", 0.6), "mae": ("max", 2.0), "rmse": ("max", 2.5)}
# Limits that raise graded alerts.
ALERT_LIMITS = {**LIMITS, "r2": ("min", -1.0), "execution_time": ("max", 5.0)}
# Advice per metric.
ADVICE = {
    "accuracy": "Consider retraining with more data or different features",
    "mae": "Review feature engineering and model hyperparameters",
    "rmse": "Review feature engineering and model hyperparameters",
    "r2": "Model may be worse than baseline - investigate data quality",
}
OTHER_ADVICE = "Review system performance and consider optimization"
# Metrics reported when an evaluation fails.
FALLBACK_METRICS = {"accuracy": 0.33, "mae": 5.0, "rmse": 6.0, "r2": -1.0}


def with_truth(predictions: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """Predictions next to the true class and score, by row key."""
    return predictions.join(truth, key)


def confusion(df: DataFrame, by: str, labels: Sequence[str] = CLASSES) -> DataFrame:
    """(by, actual, predicted, n) for every pair of labels, zeros kept."""
    counts = df.groupBy(by, "actual", "predicted").agg(F.count("*").alias("n"))
    every = F.array(*[F.lit(x) for x in sorted(labels)])
    grid = (counts.select(by).distinct().withColumn("actual", F.explode(every))
            .withColumn("predicted", F.explode(every)))
    return grid.join(counts, [by, "actual", "predicted"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))


def class_report(matrix: DataFrame, by: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages and accuracy.

    Each cell counts for its actual and for its predicted class, so one groupBy of the small matrix
    gives all sums.
    """
    same = F.col("actual") == F.col("predicted")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), zero.alias("given"),
                 F.when(same, F.col("n")).otherwise(zero).alias("hit")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"),
                 F.col("n").alias("given"), zero.alias("hit")))
    sums = matrix.select(by, F.explode(sides).alias("s")).groupBy(by, "s.label").agg(
        F.sum("s.support").alias("support"), F.sum("s.given").alias("given"),
        F.sum("s.hit").alias("hit"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    per = sums.select(
        by, "label", ratio(F.col("hit"), F.col("given")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("given") + F.col("support")).alias("f1"), "support", "hit")
    names = ["precision", "recall", "f1"]
    total = F.sum("support").alias("support")
    macro = per.groupBy(by).agg(*[F.avg(c).alias(c) for c in names], total).withColumn(
        "label", F.lit("macro avg"))
    weighted = per.groupBy(by).agg(
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names],
        total).withColumn("label", F.lit("weighted avg"))
    accuracy = per.groupBy(by).agg(
        ratio(F.sum("hit"), F.sum("support")).alias("f1"), total).withColumns({
            "label": F.lit("accuracy"), "precision": F.lit(None).cast("double"),
            "recall": F.lit(None).cast("double")})
    out = per.drop("hit")
    for extra in (macro, weighted, accuracy):
        out = out.unionByName(extra)
    return out


def _error_aggregates(actual: str, predicted: str) -> list[Column]:
    e = F.col(predicted) - F.col(actual)
    sse, n = F.sum(e * e), F.count(e)
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            (1 - F.try_divide(sse, F.var_pop(actual) * n)).alias("r2")]


def regression_metrics(df: DataFrame, by: Sequence[str], actual: str = "actual_score",
                       predicted: str = "predicted_score") -> DataFrame:
    return df.groupBy(*by).agg(*_error_aggregates(actual, predicted))


def score_error_by_class(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """MAE and mean ± population std of true and predicted score, per actual class."""
    e = F.abs(F.col("predicted_score") - F.col("actual_score"))
    return df.groupBy(*by, "actual").agg(
        F.avg(e).alias("mae"), F.avg("actual_score").alias("actual_mean"),
        F.stddev_pop("actual_score").alias("actual_std"),
        F.avg("predicted_score").alias("predicted_mean"),
        F.stddev_pop("predicted_score").alias("predicted_std"), F.count("*").alias("n"))


def evaluate_models(df: DataFrame, labels: Sequence[str] = CLASSES) -> DataFrame:
    """(model_name, metric, value) of every model from one groupBy over the long predictions.

    The confusion counts are one conditional count per pair of labels, so classification and
    regression metrics and the mean confidence come out of the same map-side combined pass.
    """
    cells = {(a, p): f"n_{i}_{j}" for i, a in enumerate(labels) for j, p in enumerate(labels)}
    sums = df.groupBy("model_name").agg(
        *[F.count_if((F.col("actual") == a) & (F.col("predicted") == p)).alias(c)
          for (a, p), c in cells.items()],
        *_error_aggregates("actual_score", "predicted_score"),
        F.avg("confidence").alias("confidence"), F.count("predicted").alias("_rows"))

    def total(pairs) -> Column:
        c = F.lit(0)
        for pair in pairs:
            c = c + F.col(cells[pair])
        return c

    weighted = {"precision": F.lit(0.0), "recall": F.lit(0.0), "f1_score": F.lit(0.0)}
    for x in labels:
        hit = F.col(cells[(x, x)])
        support = total([(x, p) for p in labels])
        given = total([(a, x) for a in labels])
        parts = {"precision": F.try_divide(hit, given), "recall": F.try_divide(hit, support),
                 "f1_score": F.try_divide(2 * hit, given + support)}
        for name, part in parts.items():
            weighted[name] = weighted[name] + F.coalesce(part, F.lit(0.0)) * support
    out = {"accuracy": F.try_divide(total([(x, x) for x in labels]), F.col("_rows")),
           **{k: F.try_divide(v, F.col("_rows")) for k, v in weighted.items()},
           "confidence": F.col("confidence"), "mae": F.col("mae"), "rmse": F.col("rmse"),
           "r2": F.col("r2")}
    wide = sums.select("model_name", *[c.cast("double").alias(k) for k, c in out.items()])
    # A model without classes (or scores) has no classification (or error) metrics.
    return wide.unpivot("model_name", list(out), "metric", "value").where("value IS NOT NULL")


def mean_top_probability(df: DataFrame, by: str, probabilities: str) -> DataFrame:
    """Mean of the greatest class probability per model, from an array column."""
    return df.groupBy(by).agg(F.avg(F.array_max(probabilities)).alias("confidence"))


def limits_table(spark: SparkSession, limits: dict = LIMITS) -> DataFrame:
    return spark.createDataFrame(
        [(m, kind, float(v)) for m, (kind, v) in limits.items()],
        "metric string, kind string, threshold double")


def verdicts(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Per model and limit: acceptable or not, PASS / WARN, and the verdict over all limits."""
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("threshold")).otherwise(
        F.col("value") <= F.col("threshold"))
    per = metrics.join(limits, "metric").withColumn("acceptable", ok)
    overall = per.groupBy("model_name").agg(F.bool_and("acceptable").alias("overall_acceptable"))
    return per.join(overall, "model_name").withColumn(
        "label", F.when(F.col("acceptable"), "PASS").otherwise("WARN"))


def graded_alerts(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Alerts for values past their limit, graded by relative distance, with text and advice."""
    v, t = F.col("value"), F.col("threshold")
    low = F.col("kind") == "min"
    deviation = F.when(t != 0, F.abs(v - t) / F.abs(t)).otherwise(1.0)
    advice = F.lit(OTHER_ADVICE)
    for metric, line in ADVICE.items():
        advice = F.when(F.col("metric") == metric, line).otherwise(advice)
    return metrics.join(limits, "metric").where(
        F.when(low, v < t).otherwise(v > t)).select(
            "model_name", "metric", "value", "threshold",
            F.when(deviation > 0.5, "high").when(deviation > 0.2, "medium").otherwise("low")
            .alias("severity"),
            F.concat(F.col("metric"), F.lit(" "), F.format_string("%.3f", v),
                     F.when(low, " below").otherwise(" above"), F.lit(" threshold "),
                     F.format_string("%.3f", t)).alias("message"),
            advice.alias("recommendation"))


def validation_status(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Per model: any high alert degraded, any alert warning, none healthy."""
    alerts = graded_alerts(metrics, limits)
    worst = alerts.groupBy("model_name").agg(
        F.count("*").alias("alerts"), F.bool_or(F.col("severity") == "high").alias("_high"))
    return metrics.select("model_name").distinct().join(worst, "model_name", "left").select(
        "model_name", F.coalesce("alerts", F.lit(0)).alias("alerts"),
        F.when(F.col("_high"), "degraded").when(F.col("alerts") > 0, "warning")
        .otherwise("healthy").alias("status"))


def fallback_metrics(spark: SparkSession, model: str, reason: str) -> DataFrame:
    """The metric rows that stand in for a failed evaluation."""
    return spark.createDataFrame(
        [(model, m, v, reason) for m, v in FALLBACK_METRICS.items()],
        "model_name string, metric string, value double, fallback_reason string")


def fallback_confusion(spark: SparkSession, model: str, reason: str,
                       labels: Sequence[str] = CLASSES) -> DataFrame:
    return spark.createDataFrame(
        [(model, a, p, 1, reason) for a in sorted(labels) for p in sorted(labels)],
        "model_name string, actual string, predicted string, n bigint, fallback_reason string")


def evaluate_or_fallback(df: DataFrame, model: str) -> DataFrame:
    """Metrics of one model's predictions; if they cannot be computed, the fallback rows."""
    try:
        out = evaluate_models(df).where(F.col("model_name") == model)
        rows = out.collect()  # eight rows; they are the result, so that nothing runs twice
        if not rows:
            raise ValueError("no predictions")
        return df.sparkSession.createDataFrame(rows, out.schema).withColumn(
            "fallback_reason", F.lit(None).cast("string"))
    except Exception as err:  # noqa: BLE001 - any failure of the job leads to the fallback
        return fallback_metrics(df.sparkSession, model, str(err).splitlines()[0])


def fallback_chain(metrics: DataFrame) -> DataFrame:
    """Models ranked per task: classifiers by accuracy, regressors by R²; ties by name."""
    a = F.max(F.when(F.col("metric") == "accuracy", F.col("value")))
    r = F.max(F.when(F.col("metric") == "r2", F.col("value")))
    per = metrics.groupBy("model_name").agg(
        F.coalesce(a, F.lit(0.0)).alias("_a"), F.coalesce(r, F.lit(-1.0)).alias("_r"))
    long = per.select("model_name", F.explode(F.array(
        F.struct(F.lit("classification").alias("task"), F.col("_a").alias("value")),
        F.struct(F.lit("regression").alias("task"), F.col("_r").alias("value")))).alias("t"))
    order = Window.partitionBy("task").orderBy(F.desc("value"), "model_name")
    return long.select("model_name", "t.*").withColumn("position", F.row_number().over(order))


def best_models(metrics: DataFrame, confidence_threshold: float = 0.8) -> DataFrame:
    """The first of each chain; classifiers below the confidence threshold are flagged only."""
    conf = metrics.where(F.col("metric") == "confidence").select(
        "model_name", F.col("value").alias("confidence"))
    return fallback_chain(metrics).where("position = 1").join(conf, "model_name", "left").select(
        "task", "model_name", "value",
        ((F.col("task") == "classification")
         & (F.coalesce("confidence", F.lit(0.0)) < confidence_threshold)).alias("low_confidence"))


def single_best(predictions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Class and confidence of the best classifier with the score of the best regressor."""
    best = best_models(metrics).select("task", "model_name")
    # One row per task.
    hit = predictions.join(F.broadcast(best), "model_name")
    cls, reg = F.col("task") == "classification", F.col("task") == "regression"
    return hit.groupBy("id").agg(
        F.max(F.when(cls, F.col("predicted"))).alias("predicted"),
        F.max(F.when(reg, F.col("predicted_score"))).alias("predicted_score"),
        F.max(F.when(cls, F.col("confidence"))).alias("confidence"),
        F.concat_ws("+", F.max(F.when(cls, F.col("model_name"))),
                    F.max(F.when(reg, F.col("model_name")))).alias("model_used"))


def sample_rows(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """A few rows, predicted next to actual, for a look."""
    return df.orderBy(key).limit(n)


def model_info_rows(spark: SparkSession, info: dict[str, object]) -> DataFrame:
    """The report's rows on the models: their kinds, number of features, test share and seed, as given."""
    return spark.createDataFrame([("model", k, str(v)) for k, v in info.items()], "section string, item string, value string")


def quality_row(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Per model whether all of its limited metrics keep their limits: acceptable, else mixed."""
    passed = F.bool_and(F.col("label") == "PASS")
    return verdicts(metrics, limits).groupBy("model_name").agg(passed.alias("p")).select(
        F.lit("quality").alias("section"), F.col("model_name").alias("item"),
        F.when(F.col("p"), "acceptable").otherwise("mixed").alias("value"))


def report_rows(split: DataFrame, metrics: DataFrame, limits: DataFrame, label: str,
                info: dict[str, object] | None = None) -> DataFrame:
    """Evaluation report as (section, item, value): data set, metrics, compliance, and what is told of the models.

    With info, rows on the data set's total and shares, the models and their overall quality are added.
    """
    if info is not None:
        plain = report_rows(split, metrics, limits, label)
        sizes = split.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
        share = lambda x: F.concat(F.round(x / F.col("n") * 100, 1).cast("string"), F.lit("%"))
        told = {"total_samples": F.col("n").cast("string"), "test_share": share(F.col("t")), "train_share": share(F.col("n") - F.col("t"))}
        sums = sizes.select(F.lit("dataset").alias("section"), F.explode(F.create_map(
            *[x for i, v in told.items() for x in (F.lit(i), v)])).alias("item", "value"))
        return plain.unionByName(sums).unionByName(model_info_rows(split.sparkSession, info)).unionByName(quality_row(metrics, limits))
    data = split.groupBy("split").agg(F.count("*").alias("n")).select(
        F.lit("dataset").alias("section"), F.concat("split", F.lit("_samples")).alias("item"),
        F.col("n").cast("string").alias("value"))
    classes = split.where("split = 'train'").groupBy(label).agg(F.count("*").alias("n")).select(
        F.lit("class_distribution").alias("section"), F.col(label).alias("item"),
        F.col("n").cast("string").alias("value"))
    rows = metrics.select(
        F.lit("metrics").alias("section"),
        F.concat_ws(".", "model_name", "metric").alias("item"),
        F.format_string("%.3f", "value").alias("value"))
    checks = verdicts(metrics, limits).select(
        F.lit("compliance").alias("section"),
        F.concat_ws(".", "model_name", "metric").alias("item"), F.col("label").alias("value"))
    return data.unionByName(classes).unionByName(rows).unionByName(checks)
