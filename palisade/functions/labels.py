"""Label vocabularies as column expressions."""

from pyspark.sql import Column, functions as F

from palisade import schema as S


def folded(label: Column) -> Column:
    return F.lower(F.trim(label.cast("string")))


def canonical_label(label: Column) -> Column:
    """Known aliases become Normal / Anomaly, everything else stays as it is."""
    text = folded(label)
    return (
        F.when(text.isin(S.NORMAL_ALIASES), S.NORMAL)
        .when(text.isin(S.ANOMALY_ALIASES), S.ANOMALY)
        .otherwise(label.cast("string"))
    )


def prediction_label(label: Column) -> Column:
    """Normal, Anomaly or Uncertain; a missing prediction counts as Normal."""
    text = folded(F.coalesce(label.cast("string"), F.lit(S.NORMAL)))
    return (
        F.when(text.isin(S.NORMAL_ALIASES), S.NORMAL)
        .when(text.isin(S.ANOMALY_ALIASES), S.ANOMALY)
        .otherwise(S.UNCERTAIN)
    )


def truth_label(label: Column) -> Column:
    """Normal or Anomaly; anything unresolved is NULL."""
    text = folded(label)
    return F.when(text.isin(S.NORMAL_ALIASES), S.NORMAL).when(text.isin(S.ANOMALY_ALIASES), S.ANOMALY)


def binary_label(label: Column, convention: str = "text") -> Column:
    """0 = normal, 1 = anomaly, -1 = left out.

    ``text`` reads the alias lists, ``binary`` reads the numbers 0 and 1, and ``outlier`` reads a
    column where -1 marks an anomaly and any other number a normal row.
    """
    if convention == "text":
        text = folded(label)
        return F.when(text.isin(S.NORMAL_ALIASES), 0).when(text.isin(S.ANOMALY_ALIASES), 1).otherwise(-1)
    if convention == "binary":
        return F.when(label == 1, 1).when(label == 0, 0).otherwise(-1)
    if convention == "outlier":
        return F.when(label == -1, 1).otherwise(0)
    raise ValueError(f"unknown label convention: {convention}")


def is_unknown(label: Column) -> Column:
    """True for NULL and the unknown aliases; Suspicious stays labelled."""
    return label.isNull() | folded(label).isin(S.UNKNOWN_ALIASES)


def inlier_label(label: Column, convention: str = "text") -> Column:
    """1.0 = normal, -1.0 = anomaly, NULL = unknown."""
    binary = binary_label(label, convention)
    return F.when(binary == 0, 1.0).when(binary == 1, -1.0)


def flow_category(label: Column) -> Column:
    return F.trim(F.coalesce(label.cast("string"), F.lit("BENIGN")))


def flow_label(label: Column) -> Column:
    """BENIGN / NORMAL flows are Normal, all other categories Anomaly."""
    return F.when(F.upper(flow_category(label)).isin("BENIGN", "NORMAL"), S.NORMAL).otherwise(S.ANOMALY)
