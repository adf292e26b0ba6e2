"""Risk scoring as column expressions."""

from pyspark.sql import Column, functions as F

ALPHA, BETA = 0.6, 0.4
LOW, MEDIUM, HIGH = 25.0, 50.0, 80.0
BASELINE_SCORE = 15.0


def _number(value) -> Column:
    column = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0))


def weights(alpha: float = ALPHA, beta: float = BETA):
    total = alpha + beta
    return (alpha / total, beta / total) if total > 0 else (alpha, beta)


def calibrated_severity(severity) -> Column:
    """Rule level 0..15 on a 0..1 curve; informational levels up to 3 give nothing."""
    level = _number(severity)
    return (
        F.when(level <= 3, 0.0)
        .when(level <= 6, (level - 3) * F.lit(0.3 / 3.0))
        .when(level <= 9, (level - 6) * F.lit(0.35 / 3.0) + 0.3)
        .otherwise(F.least(F.lit(1.0), F.least(level - 9, F.lit(6.0)) * F.lit(0.35 / 6.0) + 0.65))
    )


def risk_score(score, severity=0.0, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """0..100; a very low anomaly score cannot be lifted above 45 by the rule part."""
    a, b = weights(alpha, beta)
    anomaly = _number(score)
    raw = (anomaly * a + calibrated_severity(severity) * b) * 100.0
    held = F.when(anomaly < 0.25, F.least(raw, F.lit(45.0))).otherwise(raw)
    return F.greatest(F.least(held, F.lit(100.0)), F.lit(0.0))


def risk_class(score, low: float = LOW, medium: float = MEDIUM, high: float = HIGH) -> Column:
    """Upper bounds belong to the lower class; a missing score is Low."""
    value = _number(score)
    return F.when(value <= low, "Low").when(value <= medium, "Medium").when(value <= high, "High").otherwise("Critical")


def ai_component(score, alpha: float = ALPHA, beta: float = BETA) -> Column:
    return _number(score) * weights(alpha, beta)[0]


def rule_component(severity, alpha: float = ALPHA, beta: float = BETA) -> Column:
    return calibrated_severity(severity) * weights(alpha, beta)[1]


def decayed_score(score: Column) -> Column:
    """One idle step: halve, but not below the baseline."""
    return F.greatest(F.lit(BASELINE_SCORE), score * 0.5)


def decision_label(score: Column, tau_low, tau_high) -> Column:
    """Normal below the band, Anomaly from its top on, Uncertain inside."""
    low = tau_low if isinstance(tau_low, Column) else F.lit(tau_low)
    high = tau_high if isinstance(tau_high, Column) else F.lit(tau_high)
    return (
        F.when(score >= high, "Anomaly")
        .when((score < low) | (low >= high), "Normal")
        .otherwise("Uncertain")
    )


def decision_status(label: Column) -> Column:
    return F.when(label == "Uncertain", "UNCERTAIN").otherwise("CONFIDENT")


def risk_ordinal(risk_class_column: Column) -> Column:
    return (
        F.when(risk_class_column == "Critical", 3)
        .when(risk_class_column == "High", 2)
        .when(risk_class_column == "Medium", 1)
        .otherwise(0)
    )
