"""Detectors side by side: metrics, tables, significance and alert reduction."""

from pyspark.sql import DataFrame, functions as F

from palisade import schema as S
from palisade.detectors.cascade import fit_cascade
from palisade.operators import metrics as M
from palisade.operators.cleaning import benign_rows
from palisade.operators.ordering import quantile_table
from palisade.operators.rules import rule_only_score, rule_threshold
from palisade.operators.significance import compare_detectors
from palisade.session import checkpointed

SCORES = {"iforest_only": "iforest_anomaly", "ocsvm_only": "ocsvm_anomaly", "cascade": "anomaly_score"}


def all_scores(df: DataFrame, model) -> DataFrame:
    """Scores and labels of the cascade and of both of its stages on their own; every row is scored once."""
    scored = model.detailed(model.stage_scores(df, everything=True))
    first, outside = F.col("stage1_score"), F.lit(model.boundary.offset) - F.col("_stages.margin")
    return scored.withColumns({
        "iforest_score": model.forest.offset - first, "iforest_decision": -first, "iforest_anomaly": first,
        "iforest_label": F.when(first > 0, -1).otherwise(1),
        "ocsvm_score": -outside, "ocsvm_anomaly": outside, "ocsvm_label": F.when(outside > 0, -1).otherwise(1),
    }).drop("_stages")


def detector_metrics(long: DataFrame, label: str, align_polarity: bool = True) -> DataFrame:
    """Classic metrics for each ``detector`` of (detector, label, score, prediction) rows."""
    rates = M.basic_metrics(long, label, "prediction", ["detector"])
    ranked = M.ranking_metrics(long, label, "score", align_polarity=align_polarity, by=["detector"]).select(
        "detector", "roc_auc", "pr_auc")
    missed = F.col("fn").cast("double") / F.greatest(F.col("fn") + F.col("tp"), F.lit(1))
    joined = rates.join(ranked, "detector").withColumn("fnr", missed)
    return joined.withColumns(M.base_rate_columns(F.col("recall"), F.col("fpr")))


def _long(scored: DataFrame, label: str, parts: dict) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(name).alias("detector"), F.col(score).cast("double").alias("score"),
                 prediction.cast("string").alias("prediction"))
        for name, (score, prediction) in parts.items()
    ])
    return scored.select(label, F.inline(entries))


def ablation_study(train: DataFrame, test: DataFrame, features=None, label: str = "label", **settings) -> DataFrame:
    """Forest, boundary and cascade with their own default decisions."""
    model = fit_cascade(train, features, label, **settings)
    scored = checkpointed(all_scores(test, model))
    named = lambda column: F.when(F.col(column) == -1, S.ANOMALY).otherwise(S.NORMAL)
    return detector_metrics(_long(scored, label, {
        "iForest Only": ("iforest_anomaly", named("iforest_label")),
        "OCSVM Only": ("ocsvm_anomaly", named("ocsvm_label")),
        "Cascade iForest-OCSVM": ("anomaly_score", F.col("predicted_label")),
    }), label)


def compare_models(train: DataFrame, test: DataFrame, validation: DataFrame | None = None, features=None,
                   label: str = "label", criterion: str = "fpr_budget", max_fpr: float = 0.02,
                   threshold_percentile: float = 80, include_rules: bool = False, rule_test: DataFrame | None = None,
                   rule_validation: DataFrame | None = None, ties=()) -> dict:
    """Reports per detector, the three report tables, paired tests and the alert reduction.

    Detectors learn from benign rows only; thresholds come from the validation part when there is one.
    ``rule_test`` holds the test rows with unscaled features for the rules.
    """
    features = list(features or S.FEATURES)
    benign = benign_rows(train, label)
    model = fit_cascade(benign, features, label, validation, criterion=criterion, max_fpr=max_fpr,
                        threshold_percentile=threshold_percentile)
    scored = checkpointed(all_scores(test, model))
    columns = list(SCORES.values())
    if validation is not None:
        judged = checkpointed(all_scores(validation, model).select(label, *columns))
        thresholds = M.pick_thresholds(judged, label, columns, criterion, max_fpr)
    else:
        own = quantile_table(checkpointed(all_scores(benign, model).select(*columns)), columns, [0.95])
        thresholds = {c: own[c][0] for c in columns}
        thresholds["anomaly_score"] = model.threshold
    reports, predictions = {}, {}
    for name, column in SCORES.items():
        decision = F.when(F.col(column) >= thresholds[column], S.ANOMALY).otherwise(S.NORMAL)
        predictions[name] = (column, F.col("predicted_label") if name == "cascade" else decision)
        framed = scored.withColumn("_p", predictions[name][1])
        reports[name] = M.full_report(framed, label, column, thresholds[column], "_p", ties=ties)
    result = {"model": model, "thresholds": thresholds, "metrics": detector_metrics(_long(scored, label, predictions), label)}
    if include_rules:
        ruled = checkpointed(rule_only_score(rule_test if rule_test is not None else test))
        edge = rule_threshold(rule_only_score(rule_validation) if rule_validation is not None else None)
        reports["rule_only"] = M.full_report(ruled, label, "rule_score", edge, ties=ties)
        result["alert_reduction"] = M.alert_reduction(reports["rule_only"], reports["cascade"])
    result["reports"] = reports
    result["tables"] = M.comparison_tables(reports)
    result["significance"] = compare_detectors(scored, columns)
    return result
