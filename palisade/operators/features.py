"""Behaviour features per time window and source address.

One scan, one parse, two shuffles: every line gives a 10-second record with its counters plus one
record per user name and user agent. The first aggregation is keyed by those records, so a single
busy address is spread over many tasks before the small per-address result is formed.
"""

from pyspark.sql import Column, DataFrame, functions as F

from palisade import schema as S
from palisade.functions.numbers import count_if, ratio
from palisade.functions.text import parsed_lines
from palisade.session import checkpointed

BUCKET_SECONDS = 10
TIME, USER, AGENT = "time", "user", "agent"


KEYS = ("window_start", "src_ip")


def time_window(when: Column, seconds: float, slide_seconds: float | None = None) -> Column:
    """Tumbling window, or sliding ones when a slide is given."""
    span = f"{int(round(seconds * 1000))} milliseconds"
    if slide_seconds is None:
        return F.window(when, span)
    return F.window(when, span, f"{int(round(slide_seconds * 1000))} milliseconds")


def window_column(when: Column, seconds: float) -> Column:
    """Start of the tumbling window that holds the event."""
    return time_window(when, seconds)["start"]


def event_records(parsed: DataFrame, keys=KEYS, extra=()) -> DataFrame:
    """One row per line for its 10-second bucket, plus one for its user name and one for its user agent.

    ``extra`` columns go along with each record.
    """
    second = F.unix_seconds("event_time")
    bucket = (F.floor(second / BUCKET_SECONDS) * BUCKET_SECONDS).cast("long")
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    entries = F.array_compact(F.array(
        entry(TIME, bucket.cast("string")),
        F.when(F.col("user_name") != "unknown", entry(USER, F.col("user_name"))),
        F.when(F.col("http_agent") != "unknown", entry(AGENT, F.col("http_agent"))),
    ))
    return parsed.select(
        *keys, *extra, "is_failure", "is_timed_failure", "is_success", "is_http", "has_auth_hint",
        "http_status", "http_method", "http_bytes", (second % BUCKET_SECONDS).cast("int").alias("_offset"),
        F.inline(entries),
    )


CONTEXT = ("severity", "timestamp", "event_id", "agent_id")


def record_counters(records: DataFrame, keys=KEYS, context: bool = False) -> DataFrame:
    """Counters per record; with ``context`` also the highest severity and the earliest (time, event, agent)."""
    event = F.col("kind") == TIME
    web = event & F.col("is_http")
    low = F.col("http_status").between(400, 499)
    high = F.col("http_status").between(500, 599)
    post = F.col("http_method") == "POST"
    mark = F.call_function("shiftleft", F.lit(1), F.col("_offset"))
    return records.groupBy(*keys, "kind", "key").agg(
        count_if(event).alias("lines"),
        count_if(event & F.col("is_failure")).alias("fails"),
        count_if(event & F.col("is_timed_failure") & F.col("_offset").isNotNull()).alias("timed_fails"),
        count_if(event & F.col("is_success")).alias("oks"),
        count_if(web).alias("web"),
        count_if(web & low).alias("web_4xx"), count_if(event & low).alias("all_4xx"),
        count_if(web & high).alias("web_5xx"), count_if(event & high).alias("all_5xx"),
        count_if(web & post).alias("web_post"), count_if(event & post).alias("all_post"),
        F.sum(F.when(web, F.col("http_bytes"))).alias("web_bytes"),
        F.sum(F.when(event, F.col("http_bytes"))).alias("all_bytes"),
        F.max(F.col("is_http")).alias("any_web"),
        F.max(F.col("has_auth_hint")).alias("any_auth"),
        # which of the ten seconds of a bucket saw a failure
        F.bit_or(F.when(event & F.col("is_timed_failure"), mark)).alias("fail_seconds"),
        *([F.max("severity").alias("max_severity"), F.min(F.struct(*CONTEXT[1:])).alias("first_event")] if context else []),
    )


def address_counters(per_record: DataFrame, keys=KEYS, context: bool = False) -> DataFrame:
    summed = ["lines", "fails", "timed_fails", "oks", "web", "web_4xx", "all_4xx", "web_5xx", "all_5xx",
              "web_post", "all_post", "web_bytes", "all_bytes"]
    timed = (F.col("kind") == TIME) & F.col("key").isNotNull()
    agent = F.col("kind") == AGENT
    marks = F.when(timed & (F.col("fail_seconds") > 0),
                   F.struct(F.col("key").cast("long").alias("start"), F.col("fail_seconds").alias("marks")))
    return per_record.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in summed],
        count_if(F.col("kind") == USER).alias("users"),
        count_if(agent).alias("all_agents"),
        count_if(agent & F.col("any_web")).alias("web_agents"),
        F.max("any_web").alias("any_web"),
        F.max("any_auth").alias("any_auth"),
        F.max(F.when(timed, F.col("lines"))).alias("peak"),
        count_if(timed).alias("buckets"),
        F.sum(F.when(timed, F.col("lines"))).alias("timed_lines"),
        # at most one entry per ten seconds of the window
        F.sort_array(F.collect_list(marks)).alias("marks"),
        # every line has one record of its own at least, so the records hold all severities and first events
        *([F.max("max_severity").alias("max_severity"), F.min("first_event").alias("first_event")] if context else []),
    )


def failure_gaps(seconds: Column, failures: Column) -> tuple[Column, Column]:
    """Mean and population deviation of the gaps between ordered failures.

    ``seconds`` holds the distinct failure seconds in order. Failures within one second add gaps of
    zero, so sums over the distinct seconds and the number of failures are enough.
    """
    steps = F.zip_with(F.slice(seconds, 2, F.greatest(F.size(seconds), F.lit(1))), seconds,
                       lambda later, earlier: later - earlier)
    squares = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, d: acc + F.coalesce(d * d, F.lit(0).cast("long")))
    span = F.element_at(seconds, -1) - F.element_at(seconds, 1)
    gaps = failures - 1
    spread = (gaps * squares - span * span).cast("double") / (gaps * gaps)
    enough = failures >= 2
    mean = F.when(enough, span.cast("double") / gaps).otherwise(0.0)
    deviation = F.when(enough, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(0.0)
    return mean, deviation


def _expanded_seconds(marks: Column) -> Column:
    spread = F.transform(marks, lambda m: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BUCKET_SECONDS - 1)),
                 lambda i: F.getbit(m["marks"], i) == 1),
        lambda i: m["start"] + i,
    ))
    return F.flatten(spread)


def feature_columns(window_seconds: float, burst: Column) -> dict:
    """The per-address counters turned into the fourteen features."""
    all_web = ~F.col("window_has_web") & ~F.col("window_has_auth")  # nothing to tell lines apart: all count
    requests = F.when(all_web, F.col("lines")).otherwise(F.col("web"))
    pick = lambda name: F.when(all_web, F.col(f"all_{name}")).otherwise(F.col(f"web_{name}"))
    mean, deviation = failure_gaps(_expanded_seconds(F.col("marks")), F.col("timed_fails"))
    return {
        "auth_fail_count": F.col("fails").cast("double"),
        "auth_success_count": F.col("oks").cast("double"),
        "auth_fail_ratio": ratio(F.col("fails"), F.col("fails") + F.col("oks")),
        "distinct_username": F.col("users").cast("double"),
        "fail_interarrival_mean": mean,
        "fail_interarrival_std": deviation,
        "http_req_rate": requests.cast("double") / max(float(window_seconds), 1.0),
        "http_4xx_ratio": ratio(pick("4xx"), requests),
        "http_5xx_ratio": ratio(pick("5xx"), requests),
        "http_post_ratio": ratio(pick("post"), requests),
        "distinct_user_agent": pick("agents").cast("double"),
        "bytes_sent_mean": ratio(pick("bytes"), requests),
        "global_active_ips": F.col("window_addresses").cast("double"),
        "burst_rate": burst,
    }


def counters_of(parsed: DataFrame, keys=KEYS) -> DataFrame:
    """Counters per key from parsed lines that carry the key columns."""
    return address_counters(record_counters(event_records(parsed, keys), keys), keys)


def window_summary(counters: DataFrame) -> DataFrame:
    """One row per window: active addresses and whether any line looked like web or login traffic."""
    return counters.groupBy("window_start").agg(
        F.count(F.lit(1)).alias("window_addresses"),
        F.max("any_web").alias("window_has_web"),
        F.max("any_auth").alias("window_has_auth"),
    )


def peak_burst() -> Column:
    """Busiest 10-second bucket over the mean of the non-empty ones; 1 when there are no times."""
    mean = F.col("timed_lines").cast("double") / F.col("buckets")
    return F.when(F.col("buckets") > 0, F.col("peak") / F.greatest(mean, F.lit(1.0))).otherwise(1.0)


def history_burst(counters: DataFrame, history: DataFrame, history_window: Column | None = None) -> DataFrame:
    """Add ``burst_rate``: current lines over the mean number of past lines per past window.

    ``history_window`` tells the past windows apart. Without it the distinct values of the first time
    column count as windows, and without a time column the past is taken as one window.
    """
    times = [c for c in ("window_start", "timestamp", "time", "window_end", "ts", "datetime") if c in history.columns]
    if history_window is None and times:
        history_window = F.col(times[0])
    address = "src_ip" if "src_ip" in history.columns else "source_ip"
    past = history.groupBy(F.col(address).alias("src_ip")).agg(F.count(F.lit(1)).alias("past_lines"))
    joined = counters.join(past, "src_ip", "left")
    if history_window is None:
        spans = F.lit(1.0)
    else:
        spans = F.greatest(history.agg(F.count_distinct(history_window).cast("double")).scalar(), F.lit(1.0))
    base = F.greatest(F.coalesce(F.col("past_lines"), F.lit(0)).cast("double") / spans, F.lit(1.0))
    return joined.withColumn("burst_rate", F.col("lines").cast("double") / base).drop("past_lines")


def finished_features(counters: DataFrame, window_seconds: float, history: DataFrame | None = None,
                      history_window: Column | None = None, feature_version: str = S.DEFAULT_FEATURE_VERSION,
                      computed_at=None, keep=()) -> DataFrame:
    """Counters of whole windows to features: adds what depends on all addresses of a window; ``keep`` columns stay."""
    framed = counters.join(window_summary(counters), "window_start")
    if history is not None:
        framed, burst = history_burst(framed, history, history_window), F.col("burst_rate")
    else:
        burst = peak_burst()
    made = F.current_timestamp() if computed_at is None else F.lit(computed_at).cast("timestamp")
    columns = feature_columns(window_seconds, burst)
    return framed.select(
        "window_start", "src_ip", *[c.alias(n) for n, c in columns.items()],
        F.lit(feature_version).alias("feature_version"), made.alias("computed_at"), *keep,
    )


def extract_features(logs: DataFrame, *, window_seconds: float = 60.0, slide_seconds: float | None = None,
                     window_start=None, history=None, history_window: Column | None = None, time: Column | None = None,
                     year: int | None = None, feature_version: str = S.DEFAULT_FEATURE_VERSION,
                     computed_at=None) -> DataFrame:
    """The fourteen features per (window_start, src_ip).

    Windows are event-time windows of ``window_seconds``, sliding when ``slide_seconds`` is given. With
    ``window_start`` all lines form one window that begins there (one poll of a batch service).
    """
    parsed = parsed_lines(logs, time, year)
    if window_start is not None:
        start = window_start if isinstance(window_start, Column) else F.lit(window_start)
        parsed = parsed.withColumn("window_start", start.cast("timestamp"))
    else:
        parsed = parsed.withColumn("_window", time_window(F.col("event_time"), window_seconds, slide_seconds))
        parsed = parsed.withColumn("window_start", F.col("_window.start"))
    counters = checkpointed(counters_of(parsed))  # small, and read twice
    return finished_features(counters, window_seconds, history, history_window, feature_version, computed_at)
