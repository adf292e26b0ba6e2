"""Feature-table hygiene: names, missing values, labels, quarantine and duplicates."""

from pyspark.sql import DataFrame, functions as F

from palisade import schema as S
from palisade.functions.labels import canonical_label, folded, is_unknown
from palisade.functions.numbers import count_if, finite
from palisade.operators.ordering import first_per_key


def with_current_names(df: DataFrame, names: dict | None = None) -> DataFrame:
    """Copy an older column to its current name where the current one is missing; the first match counts."""
    added = {}
    for old, new in (names or S.LEGACY_FEATURE_NAMES).items():
        if old in df.columns and new not in df.columns and new not in added:
            added[new] = F.col(old)
    return df.withColumns(added) if added else df


def missing_features(df: DataFrame, features=S.FEATURES) -> list:
    return [name for name in features if name not in df.columns]


def require_features(df: DataFrame, features=S.FEATURES) -> DataFrame:
    missing = missing_features(df, features)
    if missing:
        raise ValueError(f"Missing feature columns: {missing}")
    return df


def feature_matrix(df: DataFrame, features=S.FEATURES, keep=()) -> DataFrame:
    """The features in their fixed order: missing ones are 0, infinities and NaN are NULL."""
    named = with_current_names(df)
    columns = [finite(F.col(f)).alias(f) if f in named.columns else F.lit(0.0).alias(f) for f in features]
    return named.select(*keep, *columns)


def sanitized(df: DataFrame, fill_missing: bool = True) -> DataFrame:
    """All features present and numeric; default label and category. Learns nothing from the data."""
    columns = {}
    for name in S.FEATURES:
        value = finite(F.col(name)) if name in df.columns else F.lit(0.0)
        columns[name] = F.coalesce(value, F.lit(0.0)) if fill_missing else value
    if "label" not in df.columns:
        columns["label"] = F.lit(S.NORMAL)
    out = df.withColumns(columns)
    if "attack_category" not in df.columns:
        out = out.withColumn("attack_category", F.when(F.col("label") == S.NORMAL, "BENIGN").otherwise("Anomaly"))
    return out


def narrow_types(df: DataFrame, features=S.FEATURES) -> DataFrame:
    """64-bit feature columns as 32-bit ones, for storage."""
    return df.withColumns({f: F.col(f).cast("float") for f in features if f in df.columns})


def features_and_target(df: DataFrame, features=S.FEATURES, label: str = "label") -> DataFrame:
    """Projection for model input; raises when a feature is missing after old names are mapped."""
    named = require_features(with_current_names(df), features)
    columns = [finite(F.col(f)).alias(f) for f in features]
    return named.select(*columns, F.col(label)) if label in named.columns else named.select(*columns)


def with_canonical_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, canonical_label(F.col(label)))


def labelled_rows(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(~is_unknown(F.col(label)))


def unknown_rows(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(is_unknown(F.col(label)))


def benign_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows a novelty detector may learn from; raises when there are none."""
    benign = df.where(folded(F.col(label)).isin(S.NORMAL_ALIASES))
    if benign.isEmpty():
        raise ValueError("No benign samples are available for training.")
    return benign


def unknown_audit(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: totals, share of unknown labels in percent, and where they come from."""
    unknown = count_if(is_unknown(F.col(label)))
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total_input_samples"),
        (total - unknown).alias("labeled_samples_count"),
        unknown.alias("unknown_samples_count"),
        F.round(unknown.cast("double") / F.greatest(total, F.lit(1)) * 100.0, 4).alias("unknown_ratio_percent"),
        count_if(F.col(label).isNull()).alias("missing_or_nan_count"),
        count_if(folded(F.col(label)).isin(S.UNKNOWN_ALIASES)).alias("explicit_unknown_alias_count"),
    )


def distinct_vectors(df: DataFrame, order, keys=("source_file", "timestamp")) -> DataFrame:
    """One row per (keys, features): the first in the given order."""
    return first_per_key(df, [*keys, *S.FEATURES], order)


def duplicate_audit(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """One row: totals and attacks before and after duplicates were dropped."""
    attacks = count_if(F.col(label) == S.ANOMALY)
    counts = lambda df, name: df.agg(
        F.count(F.lit(1)).alias(f"total_{name}"), attacks.alias(f"attacks_{name}"))
    first, second = counts(before, "before"), counts(after, "after")
    late = second.select(F.struct(*second.columns)).scalar()
    both = first.withColumn("_after", late).select("*", "_after.*")
    return both.select(
        "total_before", "total_after", (F.col("total_before") - F.col("total_after")).alias("duplicates_removed"),
        "attacks_before", "attacks_after", (F.col("attacks_before") - F.col("attacks_after")).alias("attacks_lost"),
    )
