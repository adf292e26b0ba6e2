"""Rule-only baselines that detectors are compared with."""

from pyspark.sql import DataFrame, functions as F

from palisade.operators.ordering import exact_quantiles, quantile_table


def network_rule_score(df: DataFrame) -> DataFrame:
    """Add ``rule_score``: five threshold rules, scaled by the largest sum."""
    quantiles = None
    volume = [c for c in ("auth_fail_count", "http_req_rate") if c in df.columns]
    if volume:
        quantiles = exact_quantiles(df, volume, [0.95])
    points = F.lit(0.0)
    for name in volume:
        edge = quantiles.where(F.col("name") == name).select("value").scalar()
        points = points + F.when(F.col(name) > F.greatest(edge, F.lit(0.0)), 0.35).otherwise(0.0)
    for name, edge in (("http_4xx_ratio", 0.5), ("http_5xx_ratio", 0.3), ("burst_rate", 5.0)):
        if name in df.columns:
            points = points + F.when(F.col(name) > edge, 0.15).otherwise(0.0)
    scored = df.withColumn("_points", points)
    top = scored.agg(F.max("_points")).scalar()
    return scored.withColumn(
        "rule_score", F.when(top > 0, F.col("_points") / top).otherwise(F.col("_points"))
    ).drop("_points")


def rule_only_score(df: DataFrame, features=None) -> DataFrame:
    """Add ``rule_score``: a real severity if there is one, else the level over 15, else the rules above."""
    if "wazuh_severity" in df.columns:
        return df.withColumn("rule_score", F.col("wazuh_severity").cast("double"))
    if "rule_level" in df.columns:
        return df.withColumn("rule_score", F.col("rule_level").cast("double") / 15.0)
    if list(features or df.columns) == ["auth_fail_count"]:
        return df.withColumn("rule_score", F.col("auth_fail_count").cast("double"))
    return network_rule_score(df)


def rule_threshold(validation: DataFrame | None, score: str = "rule_score") -> float:
    """95 % quantile of the validation scores; 0.5 without validation rows."""
    if validation is None:
        return 0.5
    value = quantile_table(validation, [score], [0.95])[score][0]
    return 0.5 if value is None else float(value)


def rule_decision(df: DataFrame, threshold: float, score: str = "rule_score") -> DataFrame:
    return df.withColumn("rule_prediction", F.when(F.col(score) >= threshold, "Anomaly").otherwise("Normal"))
