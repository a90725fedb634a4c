"""Request validation, data-quality checks and row-level fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import combine, is_blank

FIELDS = ["description", "input_desc", "output_desc"]
# What a row gets when its prediction failed.
FALLBACK = {"class": "medium", "score": 5.0, "confidence": 0.0}


def missing_fields(required: Sequence[str] = FIELDS) -> Column:
    """Names of the required fields that are absent, in the required order."""
    present = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.lit(c)) for c in required]))
    return F.array_except(F.array(*[F.lit(c) for c in required]), present)


def _error(kind: str, message: Column | str, code: int = 400) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(kind).alias("error"), message.alias("message"),
                    F.lit(code).alias("status_code"))


def check_requests(df: DataFrame, mode: str = "legacy") -> DataFrame:
    """Append `error` (NULL for a valid row).

    legacy: the description must hold text. structured: all fields given and any of them with
    text. strict: every field must hold text (what the web form asks for).
    """
    names = ", ".join(FIELDS)
    if mode == "legacy":
        error = F.when(is_blank(F.col("description")), _error(
            "Missing required field", "The description field is required and cannot be empty"))
    elif mode == "structured":
        missing = missing_fields()
        blank = is_blank(combine(*[F.col(c) for c in FIELDS]))
        error = F.when(F.size(missing) > 0, _error(
            "Missing required fields",
            F.concat(F.lit(f"Structured format requires all fields: {names}. Missing: "),
                     F.array_join(missing, ", ")))).when(blank, _error(
                         "Empty content",
                         f"At least one of the three fields ({names}) must contain text"))
    elif mode == "strict":
        blank = F.lit(False)
        for c in FIELDS:
            blank = blank | is_blank(F.col(c))
        error = F.when(blank, _error("Empty content", "All three fields must contain text"))
    else:
        raise ValueError(f"unknown request format: {mode}")
    return df.withColumn("error", error)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with the error record flattened)."""
    valid = checked.where("error IS NULL").drop("error")
    return valid, checked.where("error IS NOT NULL").select(
        *[c for c in checked.columns if c != "error"], "error.*")


def check_split(df: DataFrame, label: str, test_share: float = 0.2) -> None:
    """Refuse a split with fewer rows than (floor(1 / share) + 1) per class."""
    sizes = df.agg(F.count(label).alias("n"), F.count("*").alias("rows"),
                   F.count_distinct(label).alias("k")).first()
    if sizes["n"] == 0:
        raise ValueError("no rows to split")
    if sizes["n"] != sizes["rows"]:
        raise ValueError("some rows have no class")
    need = (int(1 / test_share) + 1) * sizes["k"]
    if sizes["n"] < need:
        raise ValueError(f"need at least {need} rows for {sizes['k']} classes, got {sizes['n']}")


def prediction_quality(df: DataFrame, score: str) -> DataFrame:
    """One row: how many predicted scores are missing, NaN or infinite."""
    c = F.col(score)
    infinite = F.abs(c) == F.lit(float("inf"))
    return df.agg(
        F.count("*").alias("rows"), F.count_if(c.isNull()).alias("missing"),
        F.count_if(F.isnan(c)).alias("nan"), F.count_if(infinite).alias("infinite"),
        (F.count_if(c.isNull() | F.isnan(c) | infinite) == 0).alias("usable"))


def metric_bounds(metrics: DataFrame) -> DataFrame:
    """Long metrics (…, metric, value) with `in_bounds`: accuracy in [0, 1], MAE and RMSE >= 0."""
    v, m = F.col("value"), F.col("metric")
    return metrics.withColumn(
        "in_bounds",
        F.when(v.isNull() | F.isnan(v), False).when(m == "accuracy", v.between(0, 1))
        .when(m.isin("mae", "rmse"), v >= 0).otherwise(True))


def with_fallback(df: DataFrame, cls: str, score: str, confidence: str) -> DataFrame:
    """Fill rows whose prediction failed (no class) with the fallback answer and say so."""
    failed = F.col(cls).isNull()
    return df.withColumns({
        "fallback_used": failed,
        cls: F.coalesce(F.col(cls), F.lit(FALLBACK["class"])),
        score: F.when(failed, F.lit(FALLBACK["score"])).otherwise(F.col(score)),
        confidence: F.when(failed, F.lit(FALLBACK["confidence"])).otherwise(F.col(confidence)),
    })
