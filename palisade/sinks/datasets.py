"""Dataset writers: split folders with a manifest, quarantine, report tables."""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade import schema as S
from palisade.operators.cleaning import unknown_audit, unknown_rows
from palisade.operators.splits import TEST, TRAIN, VALIDATION, entity_column, entity_overlap, part, split_label_counts, \
    split_sources, split_summary, time_column


def split_manifest(split: DataFrame, metadata: dict | None = None) -> dict:
    """Counts, label counts, time range, sources and entity overlap of every part.

    The collected frames have one row per part, per part and label, and per part and source name.
    """
    time = time_column(split)
    benign = split.where((F.col("split") == TRAIN) & (F.col("label") == S.NORMAL)).withColumn("split", F.lit("train_benign"))
    everything = split.unionByName(benign)
    summary = {r["split"]: r for r in split_summary(everything).collect()}
    labels, sources = {}, {}
    for r in split_label_counts(everything).collect():
        labels.setdefault(r["split"], {})[r["label"]] = r["rows"]
    names = [c for c in ("timestamp_source", "label_source") if c in split.columns]
    for r in split_sources(everything).orderBy("source").collect() if names else []:
        sources.setdefault((r["split"], r["kind"]), []).append(r["source"])
    overlap = entity_overlap(split).first().asDict() if entity_column(split) else {}
    parts = {}
    for name in (TRAIN, VALIDATION, TEST, "train_benign"):
        row = summary.get(name)
        parts[name] = {
            "rows": int(row["rows"]) if row else 0, "label_counts": labels.get(name, {}), "time_column": time,
            "time_min": str(row["time_min"]) if row and row["time_min"] else None,
            "time_max": str(row["time_max"]) if row and row["time_max"] else None,
            "timestamp_sources": sources.get((name, "timestamp_source"), []),
            "label_sources": sources.get((name, "label_source"), []),
        }
    manifest = {
        "protocol": "temporal_train_validation_test",
        "saved_counts": {name: value["rows"] for name, value in parts.items()},
        "entity_disjoint": bool(overlap) and not any(overlap.values()),
        "entity_overlap": overlap,
        "splits": parts,
        "training_allowed": parts["train_benign"]["rows"] > 0,
    }
    if metadata:
        manifest["provenance"] = metadata
    return manifest


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """One small JSON document as a text folder."""
    spark.createDataFrame([(json.dumps(document, default=str),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def save_splits(split: DataFrame, folder: str, metadata: dict | None = None) -> dict:
    """Write the parts (and the benign training rows) as one table partitioned by part, plus the manifest."""
    manifest = split_manifest(split, metadata)
    benign = split.where((F.col("split") == TRAIN) & (F.col("label") == S.NORMAL)).withColumn("split", F.lit("train_benign"))
    split.unionByName(benign).hint("rebalance", "split").write.mode("overwrite").partitionBy("split").parquet(f"{folder}/parts")
    write_json(split.sparkSession, manifest, f"{folder}/split_manifest")
    return manifest


def load_splits(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/parts")


def quarantine(df: DataFrame, folder: str, label: str = "label") -> None:
    """Write rows without a usable label, and the audit numbers."""
    unknown_rows(df, label).write.mode("overwrite").parquet(f"{folder}/unlabeled_samples")
    unknown_audit(df, label).write.mode("overwrite").json(f"{folder}/audit_metadata")


def write_report_tables(tables: dict, folder: str) -> None:
    """Small result frames as CSV folders."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/table_{name}")


def split_rejected(df: DataFrame, accepted) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the table constraints, and the others for a dead-letter table."""
    ok = F.coalesce(accepted, F.lit(False))
    return df.where(ok), df.where(~ok)
