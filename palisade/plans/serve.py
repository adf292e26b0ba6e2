"""Scoring job: events of a time range to features, predictions and risk rows."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from palisade import schema as S
from palisade.functions.numbers import row_hash
from palisade.functions.risk import ai_component, decayed_score, risk_class, risk_score, rule_component
from palisade.operators.cleaning import require_features
from palisade.operators.features import extract_features, window_column
from palisade.operators.joins import with_event_context
from palisade.operators.ordering import first_per_key
from palisade.sinks.results import prediction_rows, review_gated
from palisade.session import checkpointed

MAX_BACKFILL = timedelta(hours=168)
# Used when no risk row exists yet.
DEFAULT_RISK_ROW = ("192.168.1.100", "agent-001", 9.0, 6.0, 15.0, "Low")


def infer_on_features(features: DataFrame, model, scaler, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """Scale, score and add risk; uncertain rows are flagged for review and get no risk."""
    require_features(features, model.features)
    raw = features.withColumns({f"_raw_{f}": F.col(f) for f in model.features})
    detailed = model.predict_detailed(scaler.transform(raw))
    detailed = detailed.withColumns({f: F.col(f"_raw_{f}") for f in model.features}).drop(
        *[f"_raw_{f}" for f in model.features])
    severity = F.col("severity_weight") if "severity_weight" in features.columns else F.lit(0.0)
    if "id" in features.columns and "feature_vector_id" not in features.columns:
        detailed = detailed.withColumn("feature_vector_id", F.col("id"))
    risk = detailed.withColumn("risk_score", risk_score(F.col("anomaly_score"), severity, alpha, beta))
    return review_gated(risk.withColumns({
        "score": F.col("risk_score"), "risk_class": risk_class(F.col("risk_score")),
        "ai_component": ai_component(F.col("anomaly_score"), alpha, beta),
        "rule_component": rule_component(severity, alpha, beta),
    }))


def score_events(events: DataFrame, model, scaler, window_seconds: float = 60.0, computed_at=None) -> dict:
    """Frames for the three result tables from raw events."""
    features = extract_features(events, window_seconds=window_seconds, computed_at=computed_at)
    return score_features(features, events, model, scaler, window_seconds)


def score_features(features: DataFrame, events: DataFrame, model, scaler, window_seconds: float = 60.0) -> dict:
    """Features with severity and first event of their window from the event table, scored."""
    keyed = events.withColumn("window_start", window_column(F.col("timestamp").cast("timestamp"), window_seconds))
    return score_ready(with_event_context(checkpointed(features), keyed, ("window_start", "src_ip")), model, scaler)


def score_ready(context: DataFrame, model, scaler) -> dict:
    """Frames for the three result tables from features that carry max_severity, event_id and agent_id."""
    context = checkpointed(context.withColumn("id", row_hash("window_start", "src_ip", "feature_version")))
    ready = context.withColumn("severity_weight", F.col("max_severity").cast("double")).drop("max_severity")
    scored = checkpointed(
        infer_on_features(ready, model, scaler).withColumn("model_version", F.lit(model.model_version)).drop("id"))
    results, risks = prediction_rows(scored)
    features = context.drop("max_severity", "event_id", "agent_id")
    return {"feature_vectors": features, "anomaly_result": results, "risk_score": risks, "scored": scored}


def checked_range(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """A backfill range: in order and at most a week long."""
    if start > end:
        raise ValueError("start_time must not be after end_time")
    if end - start > MAX_BACKFILL:
        raise ValueError("a backfill may span at most 168 hours")
    return start, end


def backfill(events: DataFrame, start: datetime, end: datetime, model, scaler, window_seconds: float = 60.0) -> dict:
    start, end = checked_range(start, end)
    inside = events.where((F.col("timestamp") > F.lit(start)) & (F.col("timestamp") <= F.lit(end)))
    return score_events(inside, model, scaler, window_seconds)


def decayed_risk(risk: DataFrame, end, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """One idle step per address from its newest risk row; one default Low row when there is none."""
    newest = first_per_key(risk.select("src_ip", "asset_id", "score", "timestamp", "id"), ["src_ip"],
                           ["timestamp", "id"], newest=True)
    lowered = newest.withColumn("_score", decayed_score(F.coalesce("score", F.lit(15.0))))
    score = F.col("_score")
    return lowered.select(
        "src_ip", F.coalesce("asset_id", F.lit("agent-001")).alias("asset_id"),
        F.lit(None).cast("string").alias("anomaly_result_id"), (score * alpha).alias("ai_component"),
        (score / 100.0 * 15.0 * beta).alias("rule_component"), F.round(score, 1).alias("score"),
        risk_class(score).alias("risk_class"), F.lit(end).alias("timestamp"),
    )


def default_risk(spark, end) -> DataFrame:
    """The single Low row of a system that has no risk rows yet."""
    ip, asset, ai, rule, score, name = DEFAULT_RISK_ROW
    return spark.createDataFrame(
        [(ip, asset, None, ai, rule, score, name)],
        "src_ip string, asset_id string, anomaly_result_id string, ai_component double, rule_component double, "
        "score double, risk_class string",
    ).withColumn("timestamp", F.lit(end))


def decay_to_store(decayed: DataFrame) -> DataFrame:
    """All decayed rows when any is still above the baseline, else none."""
    active = decayed.agg(F.max(F.col("score") > 15.0)).scalar()
    return decayed.where(F.coalesce(active, F.lit(False)))


def rescore_newest(vectors: DataFrame, model, scaler, limit: int = 100) -> DataFrame:
    """Predictions for the newest feature vectors."""
    newest = vectors.orderBy(F.col("window_start").desc(), "src_ip").limit(limit)
    return infer_on_features(newest, model, scaler).withColumn("model_version", F.lit(model.model_version or S.DEFAULT_MODEL_VERSION))
