"""Row shaping: response fields, log entries, alert texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of a served prediction.
SCORE_LOW, SCORE_HIGH = 1.0, 10.0
RELIABLE_ABOVE = 0.55


def clamp_score(c: Column) -> Column:
    return F.greatest(F.lit(SCORE_LOW), F.least(F.lit(SCORE_HIGH), c))


def served_score(c: Column) -> Column:
    return F.round(clamp_score(c), 1)


def served_confidence(c: Column) -> Column:
    return F.round(c, 3)


def is_reliable(confidence: Column) -> Column:
    """Judged on the confidence before rounding."""
    return confidence > F.lit(RELIABLE_ABOVE)


def feature_struct() -> Column:
    """The ten features shown with a prediction."""
    # Field names of the response.
    names = {
        "text_len": "textLength", "word_count": "wordCount",
        "graph_algorithms": "graphAlgorithms", "dynamic_programming": "dynamicProgramming",
        "data_structures": "dataStructures", "sorting_searching": "sortingSearching",
        "string_processing": "stringProcessing", "basic_math": "basicMath",
        "advanced_math": "advancedMath", "complexity_notation": "complexityNotation",
    }
    whole = {"text_len", "word_count"}
    return F.struct(*[
        F.col(src).cast("int" if src in whole else "double").alias(dst)
        for src, dst in names.items()
    ])


def input_extras(description: Column, input_desc: Column, output_desc: Column) -> Column:
    """What a structured response adds: the format tag and the three input lengths."""
    return F.struct(
        F.lit("structured").alias("format"),
        F.length(description).alias("description_length"),
        F.length(input_desc).alias("input_desc_length"),
        F.length(output_desc).alias("output_desc_length"),
    )


def score_band(score: Column) -> Column:
    return F.when(score < 4, "easy").when(score < 7, "medium").otherwise("hard")


def log_entry(level: Column, event_type: str, message: Column, metadata: Column) -> Column:
    return F.struct(
        level.alias("level"), F.lit(event_type).alias("event_type"),
        message.alias("message"), metadata.alias("metadata"),
    )


def _meta(**fields: Column) -> Column:
    parts = []
    for name, value in fields.items():
        parts += [F.lit(name), value.cast("string")]
    return F.create_map(*parts)


def shape_log_events(df: DataFrame) -> DataFrame:
    """Raw events (ts, kind, correlation_id, subject, detail, severity, duration_ms, component) to
    log rows: each kind has its level, message text and metadata."""
    c = F.col
    info = F.lit("INFO")
    kinds = {
        "request": (info, F.concat(F.lit("Incoming request: "),
                                   F.coalesce(c("subject"), F.lit("unknown")), F.lit(" "),
                                   F.coalesce(c("detail"), F.lit("unknown"))),
                    _meta(request_method=c("subject"), request_path=c("detail"))),
        "response": (info, F.format_string("Response sent: %s in %.2fms", c("detail"),
                                           c("duration_ms")),
                     _meta(response_status=c("detail"), duration_ms=c("duration_ms"))),
        "prediction": (info, F.format_string("Prediction made by %s in %.2fms", c("subject"),
                                             c("duration_ms")),
                       _meta(model_name=c("subject"), duration_ms=c("duration_ms"))),
        "error": (F.lit("ERROR"), F.concat(F.lit("Error occurred: "), c("subject"), F.lit(": "),
                                           c("detail")),
                  _meta(error_type=c("subject"), error_message=c("detail"))),
        "performance": (info, F.format_string("Performance: %s completed in %.2fms", c("subject"),
                                              c("duration_ms")),
                        _meta(operation=c("subject"), duration_ms=c("duration_ms"))),
        "security": (F.when(c("severity") == "critical", "CRITICAL").otherwise("WARNING"),
                     F.concat(F.lit("Security event: "), c("detail")),
                     _meta(severity=c("severity"), event_description=c("detail"))),
        "system": (info, F.concat(F.lit("System event: "), c("detail")),
                   _meta(event_description=c("detail"))),
        "model": (info, F.concat(F.lit("Model event ["), c("subject"), F.lit("]: "), c("detail")),
                  _meta(model_name=c("subject"))),
    }
    entry = None
    for kind, (level, message, metadata) in kinds.items():
        built = log_entry(level, kind, message, metadata)
        cond = c("kind") == kind
        entry = F.when(cond, built) if entry is None else entry.when(cond, built)
    return df.withColumn("_e", entry).where(c("_e").isNotNull()).select(
        "ts", "_e.level", "_e.event_type",
        F.coalesce(c("correlation_id"), F.lit("no-correlation-id")).alias("correlation_id"),
        "_e.message", "component", "_e.metadata",
    )


def shape_error_events(df: DataFrame) -> DataFrame:
    """Handler errors (ts, component, severity, error_type, message, recovery_action) to log rows."""
    text = F.concat(F.lit("["), F.col("component"), F.lit("] "), F.col("error_type"), F.lit(": "),
                    F.col("message"))
    tail = F.when(
        F.coalesce(F.col("recovery_action"), F.lit("")) != "",
        F.concat(F.lit(" | Recovery: "), F.col("recovery_action")),
    ).otherwise("")
    level = (
        F.when(F.col("severity") == "critical", "CRITICAL").when(F.col("severity") == "high", "ERROR")
        .when(F.col("severity") == "medium", "WARNING").otherwise("INFO")
    )
    return df.withColumns({"level": level, "log_message": F.concat(text, tail)})


def alert_id(*parts: Column | str, ts: str = "ts") -> Column:
    """Parts joined by underscores, then the whole seconds of the event time."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("_", *cols, F.floor(F.unix_micros(F.col(ts)) / 1_000_000).cast("string"))


def rule_message(value: str = "value") -> Column:
    """A rule alert's text; numbers keep two decimals so every engine prints them alike."""
    return F.concat(
        F.col("description"), F.lit(". Current value: "), F.format_string("%.2f", F.col(value)),
        F.lit(", Threshold: "), F.format_string("%.2f", F.col("threshold")),
    )
