"""Joins between events, windows, results and labels."""

from pyspark.sql import DataFrame, functions as F


SECOND = 1_000_000  # microseconds
FAN = 8  # buckets of one level that a bucket of the next one holds
BUCKETS = "array<struct<level: int, bucket: long>>"


def bucket_cover(first, last, levels: int):
    """Array of (level, bucket): buckets of FAN^level units that cover the units first .. last - 1, the largest that fit.

    Below the top level fewer than FAN buckets on either side, so an interval has O(log) of them.
    """
    parts = []
    for k in range(levels + 1):
        size = FAN ** k
        a, b = F.ceil(first / size).cast("long"), F.floor(last / size).cast("long")
        rise = b if k == levels else F.least(b, F.ceil(a / FAN).cast("long") * FAN)
        fall = F.greatest(rise, F.floor(b / FAN).cast("long") * FAN)
        for low, high in ((a, rise), (fall, b)):
            listed = F.transform(F.sequence(low, high - 1), lambda at: F.struct(F.lit(k).alias("level"), at.alias("bucket")))  # noqa: B023
            parts.append(F.coalesce(F.when(low < high, listed), F.array().cast(BUCKETS)))
    return F.concat(*parts)


def own_buckets(unit, levels: int, lowest: int = 0):
    """Array of (level, bucket) that hold a unit, one a level; level -1 is the unit itself."""
    return F.array(*[
        F.struct(F.lit(k).alias("level"), F.floor(unit / FAN ** max(k, 0)).cast("long").alias("bucket")) for k in range(lowest, levels + 1)])


def time_levels(spans: DataFrame) -> int:
    """Highest level that the longest span of units (columns ``_first``, ``_last``) needs."""
    longest = spans.agg(F.max(F.col("_last") - F.col("_first"))).first()[0] or 1
    return max(0, int(longest).bit_length() - 1) // (FAN.bit_length() - 1)


def in_units(df: DataFrame, start: str, end: str, unit: int) -> DataFrame:
    """Add _from and _to (microseconds) and _first, _last: the whole units inside are _first .. _last - 1."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = df.withColumns({"_from": micros(start), "_to": micros(end)})
    return timed.withColumns({
        "_first": F.ceil(F.col("_from") / unit).cast("long"), "_last": F.floor((F.col("_to") + 1) / unit).cast("long")})


def unit_of(micros, unit: int):
    return F.floor(micros / unit).cast("long")


def severity_in_intervals(intervals: DataFrame, events: DataFrame, seconds: int = 1) -> DataFrame:
    """Add ``max_severity``: the gravest event of the address between start_time and end_time, 0 without one.

    Events are reduced to their maximum per address and unit of ``seconds``, and again per 8, 64 ... units. An interval
    is cut into the few buckets of this hierarchy that cover its whole units and meets one number in each; single events
    are compared in the units at its two ends only. So the joins give rows in proportion to the intervals, also when one
    address has nearly all events.
    """
    unit = seconds * SECOND
    span = ["src_ip", "_from", "_to"]
    keyed = in_units(intervals, "start_time", "end_time", unit)
    spans = keyed.select(*span, "_first", "_last").distinct().where("_from <= _to")
    levels = time_levels(spans)
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    reduced = events.select(F.col("source_ip").alias("src_ip"), at.alias("_at"), "severity").groupBy("src_ip", "_at").agg(
        F.max("severity").alias("severity")).withColumn("_unit", unit_of(F.col("_at"), unit))
    per_unit = reduced.groupBy("src_ip", "_unit").agg(F.max("severity").alias("severity"))
    hierarchy = per_unit.select("src_ip", "severity", F.inline(own_buckets(F.col("_unit"), levels))).groupBy(
        "src_ip", "level", "bucket").agg(F.max("severity").alias("severity"))
    whole = spans.where("_first < _last").select(*span, F.inline(bucket_cover(F.col("_first"), F.col("_last"), levels)))
    covered = whole.join(hierarchy, ["src_ip", "level", "bucket"]).select(*span, "severity")
    ends = F.array_distinct(F.array(unit_of(F.col("_from"), unit), unit_of(F.col("_to"), unit)))
    met = spans.select(*span, F.explode(ends).alias("_unit")).join(reduced, ["src_ip", "_unit"])
    met = met.where("_at >= _from AND _at <= _to").select(*span, "severity")
    best = covered.unionByName(met).groupBy(*span).agg(F.max("severity").alias("max_severity"))
    return keyed.join(best, span, "left").select(
        *intervals.columns, F.coalesce("max_severity", F.lit(0)).alias("max_severity")
    )


def first_event_per_address(events: DataFrame, keys=("src_ip",)) -> DataFrame:
    """Per address (and window): highest severity, and id and agent of the earliest event."""
    address = events if "src_ip" in events.columns else events.withColumnRenamed("source_ip", "src_ip")
    order = F.struct(F.col("timestamp"), F.col("event_id"))
    first = F.min_by(F.struct("event_id", "agent_id"), order)
    return address.where(F.col("src_ip").isNotNull()).groupBy(*keys).agg(
        F.coalesce(F.max("severity"), F.lit(0)).alias("max_severity"), first.alias("_first")
    ).select(*keys, "max_severity", "_first.event_id", "_first.agent_id")


def with_event_context(features: DataFrame, events: DataFrame, keys=("src_ip",)) -> DataFrame:
    """Features with severity, first event and agent of their address; severity is 0 without events."""
    joined = features.join(first_event_per_address(events, keys), list(keys), "left")
    return joined.withColumn("max_severity", F.coalesce("max_severity", F.lit(0)))


def lineage(events: DataFrame, vectors: DataFrame, results: DataFrame, risk: DataFrame) -> DataFrame:
    """Ids from event and feature vector over the result to the risk row."""
    base = results.select(F.col("id").alias("anomaly_result_id"), "event_id", "feature_vector_id")
    known = events.select("event_id", F.lit(True).alias("event_found"))
    made = vectors.select(F.col("id").alias("feature_vector_id"), F.lit(True).alias("vector_found"))
    scored = risk.where(F.col("anomaly_result_id").isNotNull()).select("anomaly_result_id", F.col("id").alias("risk_id"))
    no = F.lit(False)
    return (
        base.join(known, "event_id", "left").join(made, "feature_vector_id", "left")
        .join(scored, "anomaly_result_id", "left")
        .select("event_id", "feature_vector_id", "anomaly_result_id", "risk_id",
                F.coalesce("event_found", no).alias("event_found"), F.coalesce("vector_found", no).alias("vector_found"))
    )


def users_by_address(logins: DataFrame, user: str = "user", address: str = "src_ip") -> DataFrame:
    """Per user the number of distinct addresses, joined back to each (user, address) pair."""
    pairs = logins.select(user, address).dropna().distinct()
    spread = pairs.groupBy(user).agg(F.count(F.lit(1)).alias("addresses"))
    return pairs.join(spread, user)


def with_history(current: DataFrame, past: DataFrame, key: str = "src_ip") -> DataFrame:
    """Counts per key now and in the past; 0 where the past has none."""
    now = current.groupBy(key).agg(F.count(F.lit(1)).alias("current_count"))
    then = past.groupBy(key).agg(F.count(F.lit(1)).alias("past_count"))
    return now.join(then, key, "left").withColumn("past_count", F.coalesce("past_count", F.lit(0)))


def with_window_total(features: DataFrame, per_window: DataFrame, key: str = "window_start") -> DataFrame:
    return features.join(per_window, key)
