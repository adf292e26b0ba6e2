"""Fixed names, label vocabularies and table schemas shared by all operators."""

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------
FEATURES = [
    "auth_fail_count",
    "auth_success_count",
    "auth_fail_ratio",
    "distinct_username",
    "fail_interarrival_mean",
    "fail_interarrival_std",
    "http_req_rate",
    "http_4xx_ratio",
    "http_5xx_ratio",
    "http_post_ratio",
    "distinct_user_agent",
    "bytes_sent_mean",
    "global_active_ips",
    "burst_rate",
]

FEATURE_GROUPS = {
    "auth_volume": ["auth_fail_count", "auth_success_count", "auth_fail_ratio"],
    "auth_spraying": ["distinct_username"],
    "auth_timing": ["fail_interarrival_mean", "fail_interarrival_std"],
    "http_volume": ["http_req_rate"],
    "http_status": ["http_4xx_ratio", "http_5xx_ratio"],
    "http_shape": ["http_post_ratio", "distinct_user_agent", "bytes_sent_mean"],
    "context": ["global_active_ips", "burst_rate"],
}

# Older column names and the feature each one stands for.
LEGACY_FEATURE_NAMES = {
    "login_fail_count": "auth_fail_count",
    "fail_success_ratio": "auth_fail_ratio",
    "unique_failed_ip_count": "distinct_username",
    "request_rate": "http_req_rate",
    "status_4xx_rate": "http_4xx_ratio",
    "user_agent_entropy": "distinct_user_agent",
    "ip_entropy": "global_active_ips",
    "http_req_count": "http_req_rate",
    "distinct_src_ip": "global_active_ips",
    "max_fail_per_ip": "burst_rate",
    "req_count": "http_req_rate",
    "unique_ua_count": "distinct_user_agent",
    "post_ratio": "http_post_ratio",
    "status_4xx_ratio": "http_4xx_ratio",
    "status_5xx_ratio": "http_5xx_ratio",
    "bytes_per_request": "bytes_sent_mean",
    "failed_auth_count": "auth_fail_count",
    "accepted_count": "auth_success_count",
    "failed_auth_ratio": "auth_fail_ratio",
    "unique_user_count": "distinct_username",
}

NORMAL, ANOMALY, SUSPICIOUS, UNCERTAIN, UNKNOWN = "Normal", "Anomaly", "Suspicious", "Uncertain", "Unknown"

NORMAL_ALIASES = ["benign", "normal", "clean", "0", "0.0", "inlier"]
ANOMALY_ALIASES = ["attack", "anomaly", "1", "1.0", "-1", "-1.0", "outlier"]
SUSPICIOUS_ALIASES = ["suspicious"]
UNKNOWN_ALIASES = ["unknown", "uncertain", "none", "nan", "null", "undefined", ""]

RISK_CLASSES = ["Low", "Medium", "High", "Critical"]
ATTACK_TYPES = ["ssh_bruteforce", "web_bruteforce", "ddos", "dos", "portscan", "other"]
MODEL_CONFIGS = ["wazuh_rule_only", "iforest_only", "ocsvm_only", "cascade_iforest_ocsvm", "cascade-v1.0"]
MODEL_CONFIG_ALIASES = {
    "rule_only": "wazuh_rule_only",
    "rule_based": "wazuh_rule_only",
    "cascade": "cascade_iforest_ocsvm",
    "cascade_model": "cascade_iforest_ocsvm",
    "iforest": "iforest_only",
    "ocsvm": "ocsvm_only",
}
TABLES = [
    "log_event",
    "feature_vectors",
    "anomaly_result",
    "risk_score",
    "attack_scenarios",
    "evaluation_metrics",
]
DEFAULT_MODEL_VERSION = "cascade-v1.0"
DEFAULT_FEATURE_VERSION = "v2"
# ----------------------------------------------------------------------------------------


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _D, _I, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()

LOG_EVENT = _struct(
    ("event_id", _S), ("timestamp", _TS), ("source_ip", _S), ("source_host", _S), ("username", _S),
    ("event_type", _S), ("severity", _I), ("rule_id", _I), ("raw_log", _S), ("parsed_json", _S),
    ("agent_id", _S),
)

FEATURE_VECTORS = _struct(
    ("id", _S), ("window_start", _TS), ("src_ip", _S),
    *[(name, _D) for name in FEATURES],
    ("feature_version", _S), ("computed_at", _TS),
)

ANOMALY_RESULT = _struct(
    ("id", _S), ("window_start", _TS), ("src_ip", _S), ("event_id", _S), ("feature_vector_id", _S),
    ("feature_snapshot", _S), ("anomaly_score", _D), ("model_version", _S), ("predicted_label", _S),
    ("ground_truth_label", _S), ("label_source", _S),
)

RISK_SCORE = _struct(
    ("id", _S), ("src_ip", _S), ("asset_id", _S), ("anomaly_result_id", _S), ("ai_component", _D),
    ("rule_component", _D), ("score", _D), ("risk_class", _S), ("timestamp", _TS),
)

ATTACK_SCENARIOS = _struct(
    ("id", _S), ("scenario_name", _S), ("attack_type", _S), ("start_time", _TS), ("end_time", _TS),
    ("attacker_ip", _S),
)

EVALUATION_METRICS = _struct(
    ("id", _S), ("run_id", _S), ("model_config", _S), ("model_version", _S), ("dataset_split", _S),
    ("precision_score", _D), ("recall_score", _D), ("f1_score", _D), ("false_positive_rate", _D),
    ("roc_auc", _D), ("latency_ms_avg", _D), ("latency_ms_p95", _D), ("throughput_events_per_sec", _D),
    ("cpu_usage_percent", _D), ("ram_usage_mb", _D), ("hyperparameters", _S), ("evaluated_at", _TS),
)

TABLE_SCHEMAS = {
    "log_event": LOG_EVENT,
    "feature_vectors": FEATURE_VECTORS,
    "anomaly_result": ANOMALY_RESULT,
    "risk_score": RISK_SCORE,
    "attack_scenarios": ATTACK_SCENARIOS,
    "evaluation_metrics": EVALUATION_METRICS,
}

# Columns of a labelled training table.
LABELLED_COLUMNS = [
    "timestamp", "window_start", "entity_id", "timestamp_source", "source_file", "label_source",
    "dataset_source", *FEATURES, "label", "attack_category",
]
