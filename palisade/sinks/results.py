"""Predictions, metrics and scenarios in the shape of the result tables."""

import json

from pyspark.sql import Column, DataFrame, functions as F

from palisade import schema as S
from palisade.functions.labels import prediction_label, truth_label
from palisade.functions.numbers import clip, finite, row_hash
from palisade.functions.risk import ai_component, rule_component

REVIEW_REASON = "Anomaly score in decision boundary uncertainty band; deferred to SOC review."


def _column(df: DataFrame, *names, kind: str = "string") -> Column:
    found = [F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def feature_snapshot(df: DataFrame, features=S.FEATURES, review: Column | None = None, reason: Column | None = None) -> Column:
    """The known features as a JSON object; review keys only where a review is asked for."""
    fields = [F.col(f).cast("double").alias(f) for f in features if f in df.columns]
    if review is not None:
        fields.append(F.when(review, True).alias("_review_required"))
        fields.append(F.when(review, F.lit(REVIEW_REASON) if reason is None else reason).alias("_uncertainty_reason"))
    return F.to_json(F.struct(*fields)) if fields else F.lit("{}")


def prediction_rows(df: DataFrame, features=S.FEATURES, default_time=None) -> tuple[DataFrame, DataFrame]:
    """Rows for ``anomaly_result`` and ``risk_score``; uncertain rows get no risk row."""
    return tuple(rows.select(*[c.alias(n) for n, c in columns.items()])
                 for rows, columns in prediction_columns(df, features, default_time))


def prediction_columns(df: DataFrame, features=S.FEATURES, default_time=None) -> list[tuple[DataFrame, dict]]:
    """The two kinds of rows as what they are made from, and name -> expression of each column; ids and JSON are long."""
    label = prediction_label(_column(df, "predicted_label"))
    review = (label == S.UNCERTAIN) | F.coalesce(_column(df, "review_required", kind="boolean"), F.lit(False))
    reason = F.coalesce(_column(df, "uncertainty_reason"), F.lit("Score in uncertainty band"))
    when = _column(df, "window_start", kind="timestamp")
    start = when if default_time is None else F.coalesce(when, F.lit(default_time).cast("timestamp"))
    base = df.withColumns({
        "_label": label,
        "_start": start, "_ip": F.coalesce(F.nullif(_column(df, "src_ip"), F.lit("")), F.lit("0.0.0.0")),
        "_score": F.coalesce(clip(_column(df, "anomaly_score", kind="double"), 0.0, 1.0), F.lit(0.0)),
        "_version": F.coalesce(_column(df, "model_version"), F.lit(S.DEFAULT_MODEL_VERSION)),
    })
    made_id = row_hash("_start", "_ip", "_version")
    results = {
        "id": made_id, "window_start": F.col("_start"), "src_ip": F.col("_ip"), "event_id": _column(df, "event_id"),
        "feature_vector_id": _column(df, "feature_vector_id", "fv_id", "id"),
        "feature_snapshot": feature_snapshot(df, features, review, reason), "anomaly_score": F.col("_score"),
        "model_version": F.col("_version"), "predicted_label": F.col("_label"),
        "ground_truth_label": truth_label(_column(df, "ground_truth_label", "label")), "label_source": _column(df, "label_source"),
    }
    risk = finite(_column(df, "risk_score", kind="double"))
    name = F.initcap(F.trim(F.coalesce(_column(df, "risk_class"), F.lit("Low"))))
    confident = base.where((F.col("_label") != S.UNCERTAIN) & risk.isNotNull())
    severity = F.coalesce(_column(df, "severity_weight", kind="double"), F.lit(0.0))
    risks = {
        "id": row_hash(made_id), "src_ip": F.col("_ip"), "asset_id": _column(df, "agent_id", "asset_id"),
        "anomaly_result_id": made_id, "ai_component": ai_component(F.col("_score")),
        "rule_component": rule_component(severity), "score": clip(risk, 0.0, 100.0),
        "risk_class": F.when(name.isin(S.RISK_CLASSES), name).otherwise("Low"),
        "timestamp": F.coalesce(_column(df, "timestamp", kind="timestamp"), F.col("_start")),
    }
    return [(base, results), (confident, risks)]


def review_gated(df: DataFrame) -> DataFrame:
    """Flag uncertain predictions and take back their risk columns."""
    uncertain = F.col("predicted_label") == S.UNCERTAIN
    columns = {
        "review_required": uncertain,
        "uncertainty_reason": F.when(uncertain, REVIEW_REASON),
    }
    for name in ("risk_score", "score", "risk_class", "ai_component", "rule_component"):
        if name in df.columns:
            columns[name] = F.when(~uncertain, F.col(name))
    return df.withColumns(columns)


def model_config(name: Column) -> Column:
    """Aliases to known configuration names; anything else is the cascade."""
    text = name.cast("string")
    alias = F
    for old, new in S.MODEL_CONFIG_ALIASES.items():
        alias = alias.when(F.lower(text) == old, new)
    mapped = alias.otherwise(text)
    return F.when(mapped.isin(S.MODEL_CONFIGS), mapped).otherwise("cascade_iforest_ocsvm")


def config_from_model_name(name: Column) -> Column:
    low = F.lower(name)
    forest, boundary = low.contains("iforest"), low.contains("ocsvm")
    return (
        F.when(forest & ~boundary, "iforest_only").when(boundary & ~forest, "ocsvm_only")
        .when(low.contains("rule") | low.contains("wazuh"), "wazuh_rule_only").otherwise("cascade_iforest_ocsvm")
    )


def probability(value: Column) -> Column:
    return clip(finite(value), 0.0, 1.0)


def evaluation_rows(df: DataFrame, evaluated_at=None) -> DataFrame:
    """Rows for ``evaluation_metrics``: names mapped, probabilities clipped, NaN and infinities NULL."""
    pick = lambda *names: _column(df, *names, kind="double")
    made = F.current_timestamp() if evaluated_at is None else F.lit(evaluated_at).cast("timestamp")
    base = df.withColumns({
        "run_id": F.substring(F.col("run_id").cast("string"), 1, 100),
        "model_config": model_config(F.col("model_config")),
        "dataset_split": F.substring(F.col("dataset_split").cast("string"), 1, 50),
    })
    return base.select(
        row_hash("run_id", "model_config", "dataset_split").alias("id"), "run_id", "model_config",
        F.substring(F.coalesce(_column(df, "model_version"), F.lit(S.DEFAULT_MODEL_VERSION)), 1, 50).alias("model_version"),
        "dataset_split",
        probability(pick("precision_score", "precision")).alias("precision_score"),
        probability(pick("recall_score", "recall")).alias("recall_score"),
        probability(pick("f1_score", "f1")).alias("f1_score"),
        probability(pick("false_positive_rate", "fpr")).alias("false_positive_rate"),
        probability(pick("roc_auc", "roc_auc_score")).alias("roc_auc"),
        finite(pick("latency_ms_avg", "latency_mean_ms")).alias("latency_ms_avg"),
        finite(pick("latency_ms_p95", "latency_p99_ms")).alias("latency_ms_p95"),
        finite(pick("throughput_events_per_sec", "throughput", "throughput_rows_per_sec", "throughput_rows_sec"))
        .alias("throughput_events_per_sec"),
        finite(pick("cpu_usage_percent", "cpu_percent", "cpu_usage")).alias("cpu_usage_percent"),
        finite(pick("ram_usage_mb", "ram_mb", "memory_usage_mb")).alias("ram_usage_mb"),
        F.coalesce(_column(df, "hyperparameters"), F.lit("{}")).alias("hyperparameters"), made.alias("evaluated_at"),
    )


def comparison_rows(df: DataFrame, dataset: str = "CICIDS2017", evaluated_at=None) -> DataFrame:
    """Benchmark rows named by model to evaluation rows; the remaining numbers go to the parameters."""
    extra = [c for c in ("accuracy", "pr_auc", "fnr", "training_time_sec") if c in df.columns]
    named = df.withColumns({
        "model_config": config_from_model_name(F.col("model_name")), "model_version": F.substring("model_name", 1, 50),
        "dataset_split": F.lit(dataset), "hyperparameters": F.to_json(F.struct(*extra)) if extra else F.lit("{}"),
    })
    return evaluation_rows(named, evaluated_at)


def category_rows(detection: DataFrame, run_id: str, category: str = "attack_category", evaluated_at=None) -> DataFrame:
    """Per-category detection to evaluation rows: the category is the split, the rate is the recall."""
    named = detection.withColumns({
        "run_id": F.concat(F.lit(f"{run_id}_"), F.substring(category, 1, 20)), "dataset_split": F.col(category),
        "model_config": F.lit("cascade_iforest_ocsvm"), "precision": F.lit(0.0), "f1": F.lit(0.0),
        "recall": F.col("detection_rate"),
        "hyperparameters": F.to_json(F.struct(
            F.col(category).alias("attack_category"), "total_samples", "detected_count", "missed_count")),
    })
    return evaluation_rows(named, evaluated_at)


def catalog_rows(catalog: DataFrame, evaluated_at=None) -> DataFrame:
    """Registered model versions (version, metrics JSON, hyperparameters JSON) to evaluation rows."""
    value = lambda name: F.get_json_object("metrics", f"$.{name}").try_cast("double")
    named = catalog.select(
        F.concat(F.lit("export_"), F.col("version")).alias("run_id"), F.lit("cascade_iforest_ocsvm").alias("model_config"),
        F.col("version").alias("model_version"),
        F.coalesce(F.get_json_object("metrics", "$.dataset_source"), F.lit("cicids2017")).alias("dataset_split"),
        F.coalesce(value("precision"), F.lit(0.0)).alias("precision"), F.coalesce(value("recall"), F.lit(0.0)).alias("recall"),
        F.coalesce(value("f1_score"), F.lit(0.0)).alias("f1_score"),
        F.coalesce(value("false_positive_rate"), F.lit(0.0)).alias("fpr"),
        F.coalesce(value("roc_auc"), F.lit(0.5)).alias("roc_auc"),
        F.coalesce(value("latency_ms_avg"), F.lit(0.0)).alias("latency_ms_avg"),
        F.coalesce(value("throughput_events_per_sec"), F.lit(0.0)).alias("throughput_events_per_sec"),
        F.coalesce(value("ram_usage_mb"), F.lit(0.0)).alias("ram_usage_mb"), "hyperparameters",
    )
    return evaluation_rows(named, evaluated_at)


def attack_type(name: Column) -> Column:
    """Free attack names to the six known types; the first matching word counts."""
    low = F.lower(F.coalesce(F.nullif(name, F.lit("")), F.lit("other")))
    return (
        F.when(low.isin(S.ATTACK_TYPES), low)
        .when(low.contains("brute") | low.contains("ssh"), "ssh_bruteforce").when(low.contains("web"), "web_bruteforce")
        .when(low.contains("ddos"), "ddos").when(low.contains("dos"), "dos").when(low.contains("scan"), "portscan")
        .otherwise("other")
    )


def scenario_rows(df: DataFrame) -> DataFrame:
    base = df.withColumns({
        "scenario_name": F.substring("scenario_name", 1, 100), "attack_type": attack_type(F.col("attack_type")),
        "attacker_ip": F.substring("attacker_ip", 1, 45),
    })
    return base.select(
        row_hash("scenario_name", "start_time", "attacker_ip").alias("id"), "scenario_name", "attack_type", "start_time",
        "end_time", "attacker_ip",
    )


def to_document(row: dict) -> str:
    return json.dumps(row, default=str)
