"""Network-flow tables: column names, time repair, feature mapping, file statistics."""

from pyspark.sql import Column, DataFrame, functions as F

from palisade import schema as S
from palisade.functions.labels import flow_category, flow_label
from palisade.functions.numbers import clip, count_if, finite
from palisade.operators.ordering import first_per_key, numbered_within
from palisade.session import packed_for

# --- fixed values -----------------------------------------------------------------------
# Header in the flow export -> name used here.
FLOW_HEADERS = {
    "Flow Packets/s": "flow_packets_s",
    "Flow Bytes/s": "flow_bytes_s",
    "Total Fwd Packets": "total_fwd_packets",
    "Total Backward Packets": "total_bwd_packets",
    "Packet Length Variance": "packet_length_variance",
    "SYN Flag Count": "syn_flags",
    "ACK Flag Count": "ack_flags",
    "RST Flag Count": "rst_flags",
    "PSH Flag Count": "psh_flags",
    "Fwd PSH Flags": "fwd_psh_flags",
    "ECE Flag Count": "ece_flags",
    "CWE Flag Count": "cwe_flags",
    "Active Mean": "active_mean",
    "Subflow Fwd Packets": "subflow_fwd_packets",
    "Flow IAT Mean": "flow_iat_mean",
    "Flow IAT Std": "flow_iat_std",
    "Avg Bwd Segment Size": "avg_bwd_segment_size",
    "Destination Port": "destination_port",
}
LABEL_HEADERS = ["Label", "label", "LABEL"]
TIME_HEADERS = ["Timestamp", "timestamp", "Flow Start Time", "Flow Start Date", "Date first seen", "Start Time"]
ENTITY_HEADERS = ["Source IP", "Src IP", "Source_IP", "Flow ID", "Destination Port"]
# Capture order of the files; the first pattern found in the lower-case name counts.
CAPTURE_ORDER = [
    "monday",
    "tuesday",
    "wednesday",
    "thursday-workinghours-morning",
    "thursday-workinghours-afternoon",
    "thursday",
    "friday-workinghours-morning",
    "friday-workinghours-afternoon-portscan",
    "friday-workinghours-afternoon-ddos",
    "friday",
]
CONCURRENCY_BLOCK = 120
LABEL_SOURCE = "original_cicids2017_label"
ORIGINAL_TIME, PROXY_TIME = "original_flow_timestamp", "synthetic_row_order_proxy"
# ----------------------------------------------------------------------------------------


def standard_columns(df: DataFrame) -> DataFrame:
    """Trim header names, then give the known ones their short names."""
    present = [c.strip() for c in df.columns]
    trimmed = df.toDF(*present)

    def first(names):
        return next((n for n in names if n in present), None)

    label, time, entity = first(LABEL_HEADERS), first(TIME_HEADERS), first(ENTITY_HEADERS)
    if label is None:
        raise ValueError("the flow table has no label column")
    renames = {k: v for k, v in FLOW_HEADERS.items() if k in present}
    columns = [F.col(f"`{c}`").alias(renames.get(c, c)) for c in present if c not in (label, time)]
    columns.append(F.col(f"`{label}`").alias("flow_label"))
    if time:
        columns.append(F.col(f"`{time}`").alias("flow_time_text"))
    if entity:
        columns.append(F.col(f"`{entity}`").cast("string").alias("entity_id"))
    return trimmed.select(*columns)


def numeric_flow_columns(df: DataFrame) -> list:
    return [c for c in [*FLOW_HEADERS.values()] if c in df.columns]


def coerced(df: DataFrame) -> DataFrame:
    """Text to double where needed; infinities and NaN become NULL."""
    return df.withColumns({c: finite(F.col(c)) for c in numeric_flow_columns(df)})


def capture_rank(file_name: Column) -> Column:
    low = F.lower(file_name)
    rank = F
    for place, pattern in enumerate(CAPTURE_ORDER):
        rank = rank.when(low.contains(pattern), place)
    return rank.otherwise(len(CAPTURE_ORDER))


def repaired_time(text: Column) -> Column:
    """ISO-like or day-first text to a time; hours 1 to 7 without AM / PM are afternoon hours."""
    trimmed = F.trim(text.cast("string"))
    iso = trimmed.rlike(r"^\d{4}[-/]")
    marked = trimmed.rlike(r"(?i)\b(?:am|pm)\b")
    parse = lambda value, pattern: F.try_to_timestamp(value, F.lit(pattern))
    iso_time = F.coalesce(
        parse(F.translate(trimmed, "/T", "- "), "yyyy-M-d H:mm[:ss][.SSSSSS][.SSS]"),
        parse(F.translate(trimmed, "/", "-"), "yyyy-M-d"),
    )
    day_first = F.when(marked, parse(F.upper(trimmed), "d/M/yyyy h:mm[:ss] a")).otherwise(
        parse(trimmed, "d/M/yyyy H:mm[:ss]")
    )
    read = F.when(iso, iso_time).otherwise(day_first)
    shift = F.hour(read).between(1, 7) & ~marked
    return F.when(shift, read + F.expr("INTERVAL 12 HOURS")).otherwise(read)


def capture_start(file_name: Column) -> Column:
    """Begin of capture by file name, used when a file has no time column."""
    low = F.lower(file_name)
    day = (
        F.when(low.contains("monday"), "2017-07-03 09:00:00")
        .when(low.contains("tuesday"), "2017-07-04 09:00:00")
        .when(low.contains("wednesday"), "2017-07-05 09:00:00")
        .when(low.contains("thursday") & low.contains("afternoon"), "2017-07-06 14:00:00")
        .when(low.contains("thursday"), "2017-07-06 09:00:00")
        .when(low.contains("friday") & low.contains("ddos"), "2017-07-07 15:00:00")
        .when(low.contains("friday") & low.contains("portscan"), "2017-07-07 13:00:00")
        .when(low.contains("friday"), "2017-07-07 09:00:00")
        .otherwise("2017-07-03 09:00:00")
    )
    return F.to_timestamp(day)


def row_order_time(df: DataFrame, row_number: str = "row_number", file: str = "source_file") -> DataFrame:
    """Add ``flow_time``: capture start plus one second per row of the file."""
    seconds = F.unix_seconds(capture_start(F.col(file))) + F.col(row_number)
    return df.withColumn("flow_time", F.timestamp_seconds(seconds))


def checked_times(df: DataFrame, column: str = "flow_time", file: str = "source_file") -> DataFrame:
    """Raise at run time when a row of a file with a time column has no readable time."""
    message = F.concat(F.col(file), F.lit(" contains rows with invalid Timestamp values."))
    return df.withColumn(
        column, F.when(F.col(column).isNull(), F.raise_error(message).cast("timestamp")).otherwise(F.col(column))
    )


def concurrency(df: DataFrame, row_number: str = "row_number", file: str = "source_file") -> DataFrame:
    """Add ``global_active_ips``: estimate per block of 120 consecutive rows of a file."""
    port = F.col("destination_port") if "destination_port" in df.columns else F.lit(80.0)
    framed = df.withColumn("_block", F.floor(F.col(row_number) / CONCURRENCY_BLOCK)).withColumn("_port", port)
    blocks = framed.groupBy(file, "_block").agg(
        F.count("_port").cast("double").alias("_flows"), F.count_distinct("_port").cast("double").alias("_ports")
    )
    one = F.lit(1.0)
    estimate = F.sqrt(F.greatest(F.col("_flows"), one)) * F.log1p(F.greatest(F.col("_ports"), one))
    return (
        framed.join(blocks, [file, "_block"])
        .withColumn("global_active_ips", clip(estimate, 1.0, 250.0))
        .drop("_block", "_port", "_flows", "_ports")
    )


def _at_least(value: Column, low: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def flow_feature_columns(df: DataFrame) -> dict:
    """The flow columns as thirteen of the fourteen features (concurrency comes from its own step)."""
    value = lambda name: F.col(name) if name in df.columns else F.lit(0.0)
    syn, ack = value("syn_flags"), value("ack_flags")
    packets = _at_least(value("total_fwd_packets") + value("total_bwd_packets"), 1.0)
    pushes = value("psh_flags") + value("fwd_psh_flags")
    echoes = value("ece_flags") + value("cwe_flags")
    return {
        "auth_fail_count": clip(syn, 0.0, 1000.0),
        "auth_success_count": clip(ack, 0.0, 50000.0),
        "auth_fail_ratio": F.when(syn + ack > 0, syn / F.greatest(syn + ack, F.lit(1.0))).otherwise(0.0),
        "distinct_username": clip(value("subflow_fwd_packets"), 0.0, 1000.0),
        "fail_interarrival_mean": clip(value("flow_iat_mean") / 1e6, 0.0, 3600.0),
        "fail_interarrival_std": clip(value("flow_iat_std") / 1e6, 0.0, 3600.0),
        "http_req_rate": clip(value("flow_packets_s"), 0.0, 50000.0),
        "http_4xx_ratio": clip(value("rst_flags") / packets, 0.0, 1.0),
        "http_5xx_ratio": clip(echoes / packets, 0.0, 1.0),
        "http_post_ratio": clip(pushes / packets, 0.0, 1.0),
        "distinct_user_agent": clip(F.log1p(F.abs(value("packet_length_variance"))), 0.0, 50.0),
        "bytes_sent_mean": clip(value("avg_bwd_segment_size"), 0.0, 100000.0),
        "burst_rate": clip(value("flow_bytes_s") / (value("active_mean") + 1.0), 0.0, 10000.0),
    }


def flow_features(df: DataFrame, time_source: str = ORIGINAL_TIME) -> DataFrame:
    """Clean flows with ``flow_time``, ``entity_id`` and ``global_active_ips`` to labelled features."""
    made = flow_feature_columns(df)
    made["global_active_ips"] = F.col("global_active_ips")
    return df.select(
        F.col("flow_time").alias("timestamp"), F.col("flow_time").alias("window_start"), "entity_id",
        F.lit(time_source).alias("timestamp_source"), "source_file", F.lit(LABEL_SOURCE).alias("label_source"),
        *[made[name].alias(name) for name in S.FEATURES],
        flow_label(F.col("flow_label")).alias("label"), flow_category(F.col("flow_label")).alias("attack_category"),
    )


def distinct_measurements(df: DataFrame, order, file: str = "source_file") -> DataFrame:
    """Per file, the first row of every group with the same measurements (label and time do not count)."""
    return first_per_key(df, [file, *numeric_flow_columns(df)], order)


def clean_flows(df: DataFrame, order, file: str = "source_file") -> DataFrame:
    """Numbers, distinct measurements, row numbers within the file and the concurrency estimate."""
    numbers = coerced(df)
    # stored between its two shuffles, so that the files of one are gone when the other writes
    with packed_for(distinct_measurements(numbers, order, file)) as kept:
        numbered = numbered_within(kept, file, order)
    return concurrency(numbered, file=file)


def file_statistics(raw: DataFrame, cleaned: DataFrame, file: str = "source_file") -> DataFrame:
    """Per file: rows before and after, duplicates, missing and infinite cells, label counts."""
    numeric = numeric_flow_columns(raw)
    cells = [F.col(c).try_cast("double") for c in numeric]
    none = F.lit(0)
    missing = sum([F.when(c.isNull() | F.isnan(c), 1).otherwise(0) for c in cells], none)
    infinite = sum([F.when(F.abs(c) == float("inf"), 1).otherwise(0) for c in cells], none)
    before = raw.groupBy(file).agg(
        F.count(F.lit(1)).alias("initial_rows"), F.sum(missing).alias("nan_replaced"),
        F.sum(infinite).alias("inf_replaced"),
    )
    label = flow_label(F.col("flow_label"))
    after = cleaned.groupBy(file).agg(
        F.count(F.lit(1)).alias("cleaned_rows"), count_if(label == S.NORMAL).alias("normal_count"),
        count_if(label == S.ANOMALY).alias("anomaly_count"),
    )
    return before.join(after, file, "left").select(
        file, "initial_rows", "cleaned_rows", (F.col("initial_rows") - F.col("cleaned_rows")).alias("duplicates_removed"),
        "nan_replaced", "inf_replaced", "normal_count", "anomaly_count",
    )
