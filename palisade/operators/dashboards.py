"""Operations views over the result tables: counters, trends, rankings, log and metric rates."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.numbers import count_if
from palisade.functions.risk import risk_ordinal
from palisade.operators.joins import BUCKETS, SECOND, bucket_cover, in_units, own_buckets, time_levels, unit_of
from palisade.operators.ordering import first_per_key, running_totals

# --- fixed values: log search expressions -----------------------------------------------
AUTH_LINES = r"(?i)sshd|auth|password|session"
FAILED_LINES = r"(?i)failed password|invalid user|authentication failure"
SUCCESS_LINES = r"(?i)accepted password|session opened"
FAILED_RATE_LINES = r"(?i)failed password|invalid user"
ACCEPTED_RATE_LINES = r"(?i)accepted password"
ERROR_LINES = r"(?i)error|exception|fail"
VIRTUAL_DEVICES = r"^(lo|docker.*|veth.*)$"
# ----------------------------------------------------------------------------------------

CLASS_NAMES = {3: "Critical", 2: "High", 1: "Medium", 0: "Low"}


def in_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Closed time range; a missing bound is open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def selected(df: DataFrame, **values) -> DataFrame:
    """Keep rows whose columns are in the chosen lists; an absent list keeps all."""
    for column, chosen in values.items():
        if chosen is not None:
            df = df.where(F.col(column).isin(list(chosen)))
    return df


def per(column: str, span: str) -> Column:
    """Start of the time bucket."""
    return F.window(F.col(column), span)["start"].alias("time")


def risk_counters(risk: DataFrame) -> DataFrame:
    """One row: rows per class, distinct addresses and the mean score."""
    return risk.agg(
        *[count_if(F.col("risk_class") == c).alias(c.lower()) for c in ("Critical", "High", "Medium", "Low")],
        F.count_distinct("src_ip").alias("unique_ips"), F.avg("score").alias("avg_score"),
    )


def risk_trend(risk: DataFrame, span: str = "1 minute") -> DataFrame:
    return risk.groupBy(per("timestamp", span)).agg(
        F.avg("score").alias("avg_risk_score"), F.max("score").alias("max_risk_score")
    )


def class_counts_over_time(risk: DataFrame, span: str = "5 minutes") -> DataFrame:
    return risk.groupBy(per("timestamp", span), "risk_class").agg(F.count(F.lit(1)).alias("value"))


def top_offenders(risk: DataFrame, rows: int = 15) -> DataFrame:
    """Addresses with the highest scores. ``worst_class`` is the largest name, ``worst_class_ordinal`` the gravest."""
    gravest = F.max(risk_ordinal(F.col("risk_class")))
    named = F.coalesce(*[F.when(gravest == k, v) for k, v in CLASS_NAMES.items()])
    return risk.groupBy("src_ip").agg(
        F.max("score").alias("max_score"), F.count(F.lit(1)).alias("events"), F.max("risk_class").alias("worst_class"),
        named.alias("worst_class_ordinal"), F.max("timestamp").alias("last_seen"),
    ).orderBy(F.col("max_score").desc(), F.col("events").desc(), "src_ip").limit(rows)


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("metric")).agg(F.count(F.lit(1)).alias("value"))


def score_trend(results: DataFrame, span: str = "1 minute") -> DataFrame:
    return results.groupBy(per("window_start", span), "model_version").agg(F.avg("anomaly_score").alias("anomaly_score"))


def match_rate(results: DataFrame) -> DataFrame:
    """Percent of rows with known truth where the prediction agrees; NULL without such rows."""
    known = results.where(F.col("ground_truth_label").isNotNull())
    return known.agg(
        (100.0 * count_if(F.col("predicted_label") == F.col("ground_truth_label")).cast("double")
         / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("match_rate")
    )


def event_rate(events: DataFrame) -> DataFrame:
    return events.groupBy(per("timestamp", "1 minute"), "event_type").agg(
        (F.count(F.lit(1)).cast("double") / 60.0).alias("events_per_sec")
    )


def severity_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy(per("timestamp", "5 minutes"), "severity").agg(F.count(F.lit(1)).alias("value"))


def top_rules(events: DataFrame, rows: int = 10) -> DataFrame:
    return events.where(F.col("rule_id").isNotNull()).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("occurrences"), F.max("severity").alias("max_severity"),
        F.max("timestamp").alias("last_seen"),
    ).orderBy(F.col("occurrences").desc(), "rule_id").limit(rows)


def evaluation_kpis(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.max("roc_auc").alias("max_roc_auc"), F.min("false_positive_rate").alias("min_fpr"),
        F.count_distinct("run_id").alias("runs"),
    )


def latest_runs(metrics: DataFrame, *keys) -> DataFrame:
    """The newest row per key."""
    return first_per_key(metrics, list(keys), ["evaluated_at", "id"], newest=True)


def best_recent_f1(metrics: DataFrame) -> DataFrame:
    """The first configuration by name, with the F1 of its newest and then best run."""
    newest = first_per_key(metrics, ["model_config"], ["evaluated_at", "f1_score"], newest=True)
    return newest.orderBy("model_config").limit(1).select(F.col("model_config").alias("metric"), F.col("f1_score").alias("f1"))


def trade_off(metrics: DataFrame) -> DataFrame:
    newest = latest_runs(metrics, "model_config", "dataset_split")
    return newest.select(
        "model_config", "dataset_split", "recall_score", "false_positive_rate",
        (F.col("recall_score") - F.col("false_positive_rate")).alias("trade_off_score"),
    )


def recent_parameters(metrics: DataFrame, rows: int = 20) -> DataFrame:
    """The newest runs with their parameters as indented JSON."""
    given = metrics.where(F.col("hyperparameters").isNotNull())
    newest = given.orderBy(F.col("evaluated_at").desc(), "id").limit(rows)
    document = F.from_json("hyperparameters", "map<string,string>")
    return newest.select(
        "run_id", "model_config", "dataset_split", F.to_json(document, {"pretty": "true"}).alias("hyperparameters"),
        "evaluated_at",
    )


def variable_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def scenario_durations(scenarios: DataFrame) -> DataFrame:
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp")))
    return scenarios.select(
        "scenario_name", "attack_type", "attacker_ip", "start_time", "end_time",
        (seconds / 1000000.0).cast("double").alias("duration_seconds"),
    )


def running_count(df: DataFrame, time: str, name: str = "running_count") -> DataFrame:
    """Every row with the number of rows up to and including its time; equal times share the value."""
    per_time = df.groupBy(time).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(per_time, [time], unique=True, _before=F.col("_n"))
    counted = placed.select(time, (F.col("_before") + F.col("_n")).alias(name))
    return df.join(counted, time)


def search_lines(lines: DataFrame, pattern: str, column: str = "raw_log", **labels) -> DataFrame:
    """Case-insensitive search over lines, with exact label filters."""
    return selected(lines, **labels).where(F.col(column).rlike(f"(?i){pattern}"))


def login_line_counts(lines: DataFrame, column: str = "raw_log") -> DataFrame:
    line = F.col(column)
    return lines.agg(
        count_if(line.rlike(AUTH_LINES)).alias("auth_lines"), count_if(line.rlike(FAILED_LINES)).alias("failed_lines"),
        count_if(line.rlike(SUCCESS_LINES)).alias("success_lines"),
    )


def trailing_rate(lines: DataFrame, step: str = "1 minute", column: str = "raw_log", time: str = "timestamp",
                  patterns=None) -> DataFrame:
    """Matching lines per second in each one-minute step, for failed and for accepted logins."""
    chosen = patterns or {"failed_per_sec": FAILED_RATE_LINES, "accepted_per_sec": ACCEPTED_RATE_LINES}
    counted = [(count_if(F.col(column).rlike(p)).cast("double") / 60.0).alias(n) for n, p in chosen.items()]
    hit = F.lit(False)
    for p in chosen.values():
        hit = hit | F.col(column).rlike(p)
    return lines.where(hit).groupBy(per(time, step)).agg(*counted)


def rolling_rate(lines: DataFrame, time: str = "timestamp", seconds: int = 60, by: str = "source_host") -> DataFrame:
    """Per second and key: lines in the minute that ends there, over its length.

    Lines are counted per second first. Seconds are summed inside buckets of an hour (or of ``seconds``, if that is
    longer); the last seconds of a bucket are also listed in the next one. A bucket is small whatever the share of
    a key, and a second is copied once at most.
    """
    size = max(3600, seconds)
    second = F.unix_seconds(F.col(time).cast("timestamp"))
    per_second = lines.groupBy(by, second.alias("second")).agg(F.count(F.lit(1)).alias("n"))
    own, last = F.floor(F.col("second") / size), F.floor((F.col("second") + (seconds - 1)) / size)
    listed = per_second.withColumn("_bucket", F.explode(F.array_distinct(F.array(own, last))))
    frame = Window.partitionBy(by, "_bucket").orderBy("second").rangeBetween(1 - seconds, 0)
    summed = listed.withColumn("rate", F.sum("n").over(frame).cast("double") / float(seconds))
    return summed.where(own == F.col("_bucket")).select(by, "second", "rate")


def container_log_stats(lines: DataFrame, container: str = "source_host", column: str = "raw_log") -> DataFrame:
    return lines.groupBy(F.col(container).alias("container")).agg(
        F.count(F.lit(1)).alias("lines"), count_if(F.col(column).rlike(ERROR_LINES)).alias("error_lines"),
    )


def counter_rates(samples: DataFrame, keys, time: str = "timestamp", value: str = "value",
                  bucket: Column | None = None) -> DataFrame:
    """Per series and bucket: increase per second of a counter; a fall means that the counter restarted.

    Series are cut into time buckets before they are ordered, so one busy series is not ordered by one
    task; the last sample of the bucket before is handed on.
    """
    start = F.date_trunc("hour", F.col(time)) if bucket is None else bucket
    framed = samples.withColumn("_bucket", start)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(time)
    last = framed.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(F.col(time), F.col(value)), F.col(time)).alias("_last"))
    # one row per series and bucket
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_last")
    joined = framed.join(carried, [*keys, "_bucket"])
    first = F.row_number().over(inside) == 1
    before_value = F.when(first, F.col("_carried")[value]).otherwise(F.lag(value).over(inside))
    before_time = F.when(first, F.col("_carried")[time]).otherwise(F.lag(time).over(inside))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    steps = joined.withColumns({"_v": before_value, "_t": before_time}).where(F.col("_t").isNotNull())
    increase = F.when(F.col(value) >= F.col("_v"), F.col(value) - F.col("_v")).otherwise(F.col(value))
    return steps.withColumns({
        "increase": increase, "seconds": (micros(F.col(time)) - micros(F.col("_t"))) / 1000000.0,
    }).withColumn("rate", F.when(F.col("seconds") > 0, F.col("increase") / F.col("seconds"))).drop("_v", "_t", "_carried", "_bucket")


def cpu_busy_percent(rates: DataFrame, span: str = "1 minute", time: str = "timestamp") -> DataFrame:
    """100 minus the idle share, from the rates of the idle counters."""
    return rates.groupBy(per(time, span)).agg((100.0 - F.avg("rate") * 100.0).alias("cpu_busy_percent"))


def memory_usage(memory: DataFrame) -> DataFrame:
    used = F.col("total_bytes") - F.col("available_bytes")
    return memory.withColumns({
        "memory_used_bytes": used,
        "memory_used_percent": (1.0 - F.col("available_bytes").cast("double") / F.col("total_bytes")) * 100.0,
    })


def network_rate(rates: DataFrame, span: str = "1 minute", time: str = "timestamp", device: str = "device") -> DataFrame:
    real = rates.where(~F.col(device).rlike(VIRTUAL_DEVICES))
    return real.groupBy(per(time, span)).agg(F.sum("rate").alias("receive_bytes_per_sec"))


def annotations(scenarios: DataFrame, start=None, end=None) -> DataFrame:
    """Scenario intervals for a time chart."""
    return in_range(scenarios, "start_time", start, end).select(
        F.col("start_time").alias("time"), F.col("end_time").alias("timeend"), F.col("scenario_name").alias("text"),
        F.col("attack_type").alias("tags"),
    )


def overlay(chart: DataFrame, scenarios: DataFrame, seconds: int = 1, time: str = "time") -> DataFrame:
    """Chart points joined with the scenarios that run at that time.

    A scenario is cut into the few buckets of 1, 8, 64 ... units of ``seconds`` that cover its whole units, and into the
    units at its ends. A point looks up its own bucket at each level, so all rows that the join finds are results
    (but for the two end units), and many scenarios of the same day do not meet in one key.
    """
    unit = seconds * SECOND
    bounds = in_units(scenarios, "start_time", "end_time", unit).where("_from <= _to")
    levels = time_levels(bounds)
    ends = F.array_distinct(F.array(unit_of(F.col("_from"), unit), unit_of(F.col("_to"), unit)))
    # an end that is covered whole is no edge
    ends = F.filter(ends, lambda at: ~((at >= F.col("_first")) & (at < F.col("_last"))))
    edges = F.transform(ends, lambda at: F.struct(F.lit(-1).alias("level"), at.alias("bucket")))
    cover = F.when(F.col("_first") < F.col("_last"), bucket_cover(F.col("_first"), F.col("_last"), levels))
    spread = bounds.select(*scenarios.columns, "_from", "_to", F.inline(F.concat(F.coalesce(cover, F.array().cast(BUCKETS)), edges)))
    points = chart.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp")))
    listed = points.select(*chart.columns, "_at", F.inline(own_buckets(unit_of(F.col("_at"), unit), levels, -1)))
    inside = (F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to"))
    return listed.join(spread, ["level", "bucket"]).where(inside).drop("level", "bucket", "_at", "_from", "_to")
