"""Training and evaluation jobs."""

from pyspark.sql import DataFrame, functions as F

from palisade import schema as S
from palisade.detectors.cascade import fit_cascade
from palisade.detectors.comparison import ablation_study, compare_models
from palisade.detectors.preprocess import fit_scaler
from palisade.detectors.sweeps import feature_group_ablation, gate_rate_sweep, hyperparameter_search, \
    hyperparameter_sensitivity
from palisade.operators.cleaning import benign_rows, labelled_rows, sanitized, with_canonical_labels, with_current_names
from palisade.operators.metrics import classification_metrics
from palisade.operators.splits import TEST, TRAIN, VALIDATION, one_class_split, part, random_split, temporal_split
from palisade.session import checkpointed
from palisade.sinks.datasets import quarantine, write_report_tables


def training_rows(df: DataFrame, quarantine_folder: str | None = None) -> DataFrame:
    """Known labels in canonical form; unknown ones are set aside. Without labels all rows are benign."""
    named = with_current_names(df)
    if "label" not in named.columns:
        named = named.withColumn("label", F.lit(S.NORMAL))
    if quarantine_folder:
        quarantine(named, quarantine_folder)
    return sanitized(with_canonical_labels(labelled_rows(named)), fill_missing=False)


def split_for_training(rows: DataFrame, frac=(0.6, 0.2, 0.2), keys=("window_start", "src_ip")) -> DataFrame:
    """Temporal parts; without a validation share, benign rows are drawn for training and the rest tests."""
    if frac[1] > 0:
        return temporal_split(rows, frac)
    benign = random_split(rows.where(F.col("label") == S.NORMAL), keys, 1.0 - frac[0])
    return benign.unionByName(rows.where(F.col("label") != S.NORMAL).withColumn("split", F.lit(TEST)))


def run_training(rows: DataFrame, registry=None, frac=(0.6, 0.2, 0.2), search: bool = False, criterion: str = "fpr_budget",
                 max_fpr: float = 0.02, model_version: str = S.DEFAULT_MODEL_VERSION, features=None,
                 quarantine_folder: str | None = None, **settings) -> dict:
    """Split, scale on benign rows, optional search, fit, evaluate, register."""
    features = list(features or S.FEATURES)
    split = checkpointed(split_for_training(training_rows(rows, quarantine_folder), frac))
    train = benign_rows(part(split, TRAIN))
    scaler = fit_scaler(train, features)
    scaled = {name: scaler.transform(part(split, name)) for name in (VALIDATION, TEST)}
    train_scaled = scaler.transform(train)
    validation = scaled[VALIDATION] if frac[1] > 0 else None
    if search:
        found = hyperparameter_search(train_scaled, validation if validation is not None else scaled[TEST], features)
        settings = {"iforest": found["iforest_params"], "ocsvm": found["ocsvm_params"], "gate_rate": found["gate_rate"],
                    "w_stage1": found["w_stage1"], **settings}
    model = fit_cascade(train_scaled, features, "label", validation, criterion=criterion, max_fpr=max_fpr,
                        model_version=model_version, **settings)
    predicted = checkpointed(model.predict_detailed(scaled[TEST]).select("label", "predicted_label", "anomaly_score"))
    metrics = classification_metrics(predicted, "label", "predicted_label", "anomaly_score")
    values = metrics.first().asDict()
    if registry is not None:
        registry.register(model, scaler, values)
    return {"model": model, "scaler": scaler, "metrics": metrics, "split": split, "values": values}


def one_class_evaluation(rows: DataFrame, order, features=None, train_ratio: float = 0.6, **settings) -> DataFrame:
    """Train on the first benign share, test on the rest and all anomalies; forest, boundary and cascade."""
    features = list(features or S.FEATURES)
    split = checkpointed(one_class_split(sanitized(rows, fill_missing=False), order, train_ratio))
    scaler = fit_scaler(part(split, TRAIN), features)
    return ablation_study(scaler.transform(part(split, TRAIN)), scaler.transform(part(split, TEST)), features, **settings)


def run_evaluation(rows: DataFrame, features=None, frac=(0.6, 0.2, 0.2), include_rules: bool = True,
                   include_ablations: bool = False, folder: str | None = None, ties=("src_ip", "window_start"),
                   criterion: str = "fpr_budget", max_fpr: float = 0.02) -> dict:
    """Temporal split, scaling on benign training rows, comparison of all detectors, report tables."""
    features = list(features or S.FEATURES)
    split = checkpointed(temporal_split(training_rows(rows), frac))
    scaler = fit_scaler(benign_rows(part(split, TRAIN)), features)
    parts = {name: part(split, name) for name in (TRAIN, VALIDATION, TEST)}
    scaled = {name: scaler.transform(p) for name, p in parts.items()}
    result = compare_models(
        scaled[TRAIN], scaled[TEST], scaled[VALIDATION], features, criterion=criterion, max_fpr=max_fpr,
        include_rules=include_rules, rule_test=parts[TEST], rule_validation=parts[VALIDATION], ties=ties,
    )
    if include_ablations:
        three = (scaled[TRAIN], scaled[VALIDATION], scaled[TEST], features)
        result["tables"].update({
            "ablation": feature_group_ablation(*three), "sensitivity": hyperparameter_sensitivity(*three),
            "gate": gate_rate_sweep(*three),
        })
    if folder:
        write_report_tables(result["tables"], folder)
    return result
