"""Security alerts as JSON: nested document to ``log_event`` columns."""

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.numbers import row_hash

# --- fixed values -----------------------------------------------------------------------
ADDRESS = r"^(\d{1,3}\.){3}\d{1,3}$|^([0-9a-fA-F]{1,4}:){1,7}[0-9a-fA-F]{1,4}$"
LOCAL_ADDRESSES = ["any", "127.0.0.1", "localhost"]
WEB_WORDS = "nginx|apache|web|http"
DEFAULT_HOST = "wazuh-manager"
ALERT_FIELDS = (
    "timestamp string, location string, full_log string, log string, message string, "
    "agent struct<id:string,name:string,hostname:string,ip:string>, "
    "rule struct<id:string,level:string>, "
    "data struct<srcip:string,src_ip:string,dstip:string,dstuser:string,srcuser:string,systemuser:string,"
    "user:string,src_host:string,hostname:string>, "
    "predecoder struct<hostname:string>"
)
KEEP_LEVEL, NOTIFY_LEVEL = 3, 12
# ----------------------------------------------------------------------------------------


def is_json(line: Column) -> Column:
    """True for lines that hold one JSON value and nothing after it.

    As the only element of an array the line must leave an array of length one; nothing is built. That
    reader takes single quotes as well, so lines with one are read by the strict parser too.
    """
    single = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    strict = ~line.contains("'") | F.try_parse_json(line).isNotNull()
    return F.coalesce(single & strict, F.lit(False))


def _given(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _whole_number(value: Column) -> Column:
    """Integers, also written as decimals in JSON numbers; anything else is NULL."""
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("int")).otherwise(
        F.when(value.rlike(r"^[+-]?\d+\.\d+$"), value.try_cast("double").cast("int"))
    )


def source_address(alert: Column) -> Column:
    """srcip, src_ip, dstip, then the agent; local names fall back to the agent; other text must be an address."""
    data, agent = alert["data"], alert["agent"]
    first = F.coalesce(_given(data["srcip"]), _given(data["src_ip"]), _given(data["dstip"]), _given(agent["ip"]))
    fallback = F.when(agent["ip"] != "127.0.0.1", _given(agent["ip"]))
    trimmed = F.trim(first)
    return F.when(first.isNull() | first.isin(LOCAL_ADDRESSES), fallback).otherwise(
        F.when(trimmed.rlike(ADDRESS), trimmed)
    )


def parse_alerts(lines: DataFrame, column: str = "value", default_time: Column | None = None) -> DataFrame:
    """JSON lines to the ``log_event`` columns; the id is a hash of the line, so a replay gives the same rows."""
    framed = lines.withColumn("_a", F.from_json(F.col(column), ALERT_FIELDS))
    a = F.col("_a")
    data, agent = a["data"], a["agent"]
    user = F.coalesce(*[_given(data[n]) for n in ("dstuser", "srcuser", "systemuser", "user")])
    host = F.coalesce(
        _given(agent["name"]), _given(agent["hostname"]), _given(data["src_host"]), _given(data["hostname"]),
        _given(a["predecoder"]["hostname"]), F.lit(DEFAULT_HOST),
    )
    log = F.coalesce(_given(a["full_log"]), _given(a["log"]), _given(a["message"]))
    web = F.lower(F.coalesce(a["location"], F.lit(""))).rlike(WEB_WORDS) | F.lower(F.coalesce(log, F.lit(""))).rlike(WEB_WORDS)
    level = F.coalesce(_whole_number(a["rule"]["level"]), F.lit(0))
    payload = F.get_json_object(F.col(column), "$.data")
    when = F.try_to_timestamp(a["timestamp"])
    return framed.select(
        F.sha2(F.col(column), 256).alias("event_id"),
        (when if default_time is None else F.coalesce(when, default_time)).alias("timestamp"),
        source_address(a).alias("source_ip"),
        F.substring(host, 1, 100).alias("source_host"),
        F.substring(user, 1, 100).alias("username"),
        F.when(web, "nginx").otherwise("auth").alias("event_type"),
        F.least(F.greatest(level, F.lit(0)), F.lit(16)).alias("severity"),
        _whole_number(a["rule"]["id"]).alias("rule_id"),
        F.coalesce(log, F.when(payload != "{}", payload), F.col(column)).alias("raw_log"),
        F.col(column).alias("parsed_json"),
        F.substring(F.coalesce(agent["id"], F.lit("000")), 1, 50).alias("agent_id"),
    )


def is_storable() -> Column:
    """The constraints of the event table; NULL in a required column fails."""
    return (
        F.col("timestamp").isNotNull() & F.col("raw_log").isNotNull()
        & F.coalesce(F.col("event_type").isin("auth", "nginx"), F.lit(False))
        & F.coalesce(F.col("severity").between(0, 16), F.lit(False))
    )


def alert_levels(events: DataFrame, keep: int = KEEP_LEVEL, notify: int = NOTIFY_LEVEL) -> DataFrame:
    """Events of at least the kept level, with a flag for those that send a notification."""
    kept = events.where(F.col("severity") >= keep)
    return kept.withColumn("notify", F.col("severity") >= notify)


def with_event_ids(events: DataFrame, *columns) -> DataFrame:
    return events.withColumn("event_id", row_hash(*columns))
