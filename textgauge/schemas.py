"""Schemas of the tables the jobs read and write; files are never read with inference."""

PROBLEM = (
    "title string, description string, input_description string, output_description string, "
    "problem_class string, problem_score double"
)
REQUEST = "request_id string, description string, input_desc string, output_desc string"
PREDICTION_EVENT = (
    "model_name string, ts timestamp, prediction_time double, confidence double, "
    "input_hash string, prediction_result string"
)
SNAPSHOT = (
    "model_name string, ts timestamp, accuracy double, precision double, recall double, "
    "f1_score double, mae double, rmse double, r2_score double, avg_response_time double, "
    "avg_confidence double, error_rate double, prediction_count bigint"
)
ALERT_RULE = (
    "rule_id string, name string, description string, metric_name string, threshold double, "
    "op string, severity string, channels array<string>, cooldown_minutes int, enabled boolean"
)
CALL = "circuit string, ts timestamp, call_id bigint, success boolean, execution_time double"
CACHE_ENTRY = (
    "input_hash string, result string, model_name string, ts timestamp, ttl_seconds int"
)
LOG = (
    "ts timestamp, level string, event_type string, correlation_id string, message string, "
    "component string, metadata map<string,string>"
)
REPORT = "seq bigint, model_name string, metric string, value double"
WEIGHT = "model_name string, weight double"

CLASSES = ["easy", "medium", "hard"]
