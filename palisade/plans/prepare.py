"""Dataset preparation: flow files, login logs, and both together."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade import schema as S
from palisade.operators.cleaning import distinct_vectors, duplicate_audit, sanitized
from palisade.operators.flows import ORIGINAL_TIME, PROXY_TIME, checked_times, clean_flows, flow_features, numeric_flow_columns, \
    repaired_time, row_order_time
from palisade.operators.splits import day_split, spaced_rows, temporal_split
from palisade.operators.syslog import event_flags, infer_years, label_by_rules, parse_syslog, syslog_features
from palisade.session import checkpointed, packed
from palisade.sinks.datasets import save_splits
from palisade.sources.files import read_attackers, read_flows, read_log_lines

VECTOR_ORDER = ["source_file", "timestamp", "entity_id", "attack_category"]


def flow_dataset(flows: DataFrame, order=("row_number",)) -> DataFrame:
    """Flow rows to labelled features. Without a time column the row order stands in for the time."""
    read = {"source_file", "entity_id", "flow_time", "flow_time_text", "flow_label", *numeric_flow_columns(flows), *order}
    cleaned = clean_flows(flows.select(*[F.col(f"`{c}`") for c in flows.columns if c in read]), list(order))
    if "entity_id" not in cleaned.columns:
        stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
        cleaned = cleaned.withColumn("entity_id", F.concat_ws("_", stem, F.col("row_number").cast("string")))
    if "flow_time" in cleaned.columns:
        made = flow_features(cleaned, ORIGINAL_TIME)
    elif "flow_time_text" in cleaned.columns:
        made = flow_features(checked_times(cleaned.withColumn("flow_time", repaired_time(F.col("flow_time_text")))))
    else:
        made = flow_features(row_order_time(cleaned), PROXY_TIME)
    return made.withColumn("dataset_source", F.lit("cicids2017"))


def login_dataset(lines: DataFrame, attackers: DataFrame | None = None) -> DataFrame:
    """Login log lines (source_file, line_number, line) to labelled features per window and address."""
    events = event_flags(infer_years(parse_syslog(lines)))
    labelled = label_by_rules(syslog_features(events), attackers)
    return labelled.withColumn("dataset_source", F.lit("loghub"))


def unified_dataset(*datasets: DataFrame) -> DataFrame:
    """Aligned columns of several sources; equal vectors of a source, file and time count once."""
    aligned = None
    for dataset in datasets:
        ready = sanitized(dataset, fill_missing=False)
        # stored, so that the shuffles of a source are gone when all of them are compared
        ready = packed(ready.select(*[c for c in S.LABELLED_COLUMNS if c in ready.columns]))
        aligned = ready if aligned is None else aligned.unionByName(ready, allowMissingColumns=True)
    return distinct_vectors(aligned, VECTOR_ORDER, ("dataset_source", "source_file", "timestamp"))


def prepare_flows(spark: SparkSession, paths, folder: str, frac=(0.6, 0.2, 0.2), strategy: str = "day",
                  max_rows: int | None = None) -> dict:
    """Flow files to a split folder; returns the manifest. ``max_rows`` takes evenly spaced rows of all files."""
    flows = checkpointed(flow_dataset(read_flows(spark, paths)))
    kept = checkpointed(distinct_vectors(flows, VECTOR_ORDER))
    audit = duplicate_audit(flows, kept).first().asDict()
    rows = spaced_rows(kept, VECTOR_ORDER, max_rows) if max_rows else kept
    split = checkpointed(day_split(rows) if strategy == "day" else temporal_split(rows, frac))
    return save_splits(split, folder, {"dataset_source": "cicids2017", "split_strategy": strategy,
                                       "deduplication_audit": audit})


def prepare_logins(spark: SparkSession, paths, folder: str, frac=(0.6, 0.2, 0.2), attackers: str | None = None,
                   max_rows: int | None = None) -> dict:
    """Login log files to a split folder with parts that share no address; returns the manifest."""
    known = read_attackers(spark, attackers) if attackers else None
    lines = read_log_lines(spark, paths)
    rows = checkpointed(distinct_vectors(login_dataset(lines, known), VECTOR_ORDER))
    rows = spaced_rows(rows, VECTOR_ORDER, max_rows) if max_rows else rows
    split = checkpointed(temporal_split(rows, frac, entity_disjoint=True))
    return save_splits(split, folder, {"dataset_source": "loghub"})


def prepare_unified(spark: SparkSession, datasets, folder: str, frac=(0.6, 0.2, 0.2), max_rows: int | None = None) -> dict:
    """All sources in one table, cut in time inside each source and once over everything."""
    rows = checkpointed(unified_dataset(*datasets))
    rows = spaced_rows(rows, VECTOR_ORDER, max_rows) if max_rows else rows
    rows.write.mode("overwrite").parquet(f"{folder}/dataset")
    per_source = checkpointed(temporal_split(rows, frac, by="dataset_source"))
    sources = [r[0] for r in rows.select("dataset_source").distinct().collect()]  # a handful of names
    manifests = {
        s: save_splits(per_source.where(F.col("dataset_source") == s), f"{folder}/source_splits/{s}") for s in sources
    }
    manifests["all"] = save_splits(checkpointed(temporal_split(rows, frac)), f"{folder}/train_test_split")
    return manifests
