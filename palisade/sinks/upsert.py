"""Upserts on plain Parquet: merge rows by key, rewrite only the partitions that change."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.functions.numbers import row_hash
from palisade.session import checkpointed, path_exists, remove_path


def merged_rows(existing: DataFrame | None, incoming: DataFrame, keys, updated=None, order=(), null_keys: str = "keep") -> DataFrame:
    """One row per key. Incoming rows win; with ``updated`` they replace only those columns.

    Several incoming rows of a key apply in the given order. Rows with a missing key never match and are
    all kept, as in a unique index.
    """
    columns = incoming.columns
    rank = F.struct(F.lit(1).alias("side"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    old_rank = F.struct(F.lit(0).alias("side"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    both = incoming.withColumn("_rank", rank)
    if existing is not None:
        both = both.unionByName(existing.select(*columns).withColumn("_rank", old_rank))
    return one_row_per_key(both, keys, updated, null_keys).select(*columns)


def one_row_per_key(versions: DataFrame, keys, updated=None, null_keys: str = "keep") -> DataFrame:
    """One row per key from rows with a ``_rank``: updated columns of the highest one, the others of the lowest.

    Without ``updated`` all columns are. Rows with a missing key are kept as they are, or dropped.
    """
    keyless = F.lit(False)
    for key in keys:
        keyless = keyless | F.col(key).isNull()
    columns = [c for c in versions.columns if c != "_rank"]
    rest = [c for c in columns if c not in keys]
    newest = rest if updated is None else [c for c in rest if c in updated]
    first = [c for c in rest if c not in newest]
    picks = []
    if newest:
        picks.append(F.max_by(F.struct(*newest), F.col("_rank")).alias("_new"))
    if first:
        picks.append(F.min_by(F.struct(*first), F.col("_rank")).alias("_old"))
    merged = versions.where(~keyless).groupBy(*keys).agg(*picks) if picks else versions.where(~keyless).select(*keys).distinct()
    merged = merged.select(*keys, *(["_new.*"] if newest else []), *(["_old.*"] if first else [])).select(*columns)
    if null_keys == "keep":
        merged = merged.unionByName(versions.where(keyless).select(*columns))
    return merged


def upsert(spark: SparkSession, path: str, incoming: DataFrame, keys, updated=None, order=(),
           partition: str | None = None, time: str | None = None) -> None:
    """Merge into a Parquet table. With ``partition`` (a date of ``time``) only touched days are rewritten.

    Where the time is no part of the key a row may move to another day: the days that hold a key of the batch
    are touched, too, and a day that loses its last row is removed.
    """
    rows = checkpointed(incoming.withColumn(partition, F.to_date(time)) if partition else incoming)  # read several times
    existing = spark.read.schema(rows.schema).parquet(path) if path_exists(spark, path) else None
    days = set()
    if existing is not None and partition:
        touched = rows.select(partition)
        if time not in keys:
            touched = touched.unionByName(existing.join(rows.select(*keys).distinct(), list(keys), "left_semi").select(partition))
        days = {r[0] for r in touched.distinct().collect()}  # days of one batch and of its keys
        known = [d for d in days if d is not None]
        existing = existing.where(F.col(partition).isin(known) | (F.col(partition).isNull() if None in days else F.lit(False)))
    merged = merged_rows(existing, rows, keys, updated, order)
    if partition:
        merged = merged.withColumn(partition, F.to_date(time))
    merged = checkpointed(merged)  # the target is also an input
    # rebalanced: few files per day, and a large day is still written by several tasks
    writer = (merged.hint("rebalance", partition) if partition else merged).write.mode("overwrite")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.parquet(path)
    if days:
        left = {r[0] for r in merged.select(partition).distinct().collect()}
        for day in days - left - {None}:
            remove_path(spark, f"{path}/{partition}={day}")


# --- fixed values: upsert contracts of the result tables --------------------------------
VECTOR_KEYS = ["window_start", "src_ip", "feature_version"]
RESULT_KEYS = ["window_start", "src_ip", "model_version"]
RESULT_UPDATED = ["anomaly_score", "predicted_label", "feature_snapshot", "feature_vector_id"]
RISK_KEYS = ["anomaly_result_id"]
RISK_UPDATED = ["score", "risk_class", "ai_component", "rule_component", "timestamp"]
METRIC_KEYS = ["run_id", "model_config", "dataset_split"]
# ----------------------------------------------------------------------------------------


def merge_feature_vectors(existing, incoming: DataFrame) -> DataFrame:
    """Newest features win; the id of a known vector stays."""
    rows = incoming if "id" in incoming.columns else incoming.withColumn("id", row_hash(*VECTOR_KEYS))
    updated = [c for c in rows.columns if c not in ("id", *VECTOR_KEYS)]
    order = ["computed_at"] if "computed_at" in rows.columns else []
    return merged_rows(existing, rows, VECTOR_KEYS, updated, order)


def merge_results(existing, incoming: DataFrame) -> DataFrame:
    return merged_rows(existing, incoming, RESULT_KEYS, RESULT_UPDATED)


def merge_risk(existing, incoming: DataFrame) -> DataFrame:
    return merged_rows(existing, incoming, RISK_KEYS, RISK_UPDATED)


def merge_metrics(existing, incoming: DataFrame) -> DataFrame:
    return merged_rows(existing, incoming, METRIC_KEYS, [c for c in incoming.columns if c not in ("id", *METRIC_KEYS)])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
