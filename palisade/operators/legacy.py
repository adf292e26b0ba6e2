"""Older per-address features over a whole batch (or per extra key, such as a window)."""

from pyspark.sql import DataFrame, functions as F

from palisade.functions.numbers import count_if
from palisade.functions.text import line_text, loose_user_name, parsed_lines, source_ip


def address_entropy(logs: DataFrame) -> DataFrame:
    """Shannon entropy in bits of the shares of the source addresses, as one row."""
    counts = logs.select(source_ip(logs).alias("src_ip")).dropna().groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").cast("double")).scalar()
    share = F.col("n") / total
    return counts.agg(F.coalesce(-F.sum(share * F.log2(share + 1e-9)), F.lit(0.0)).alias("ip_entropy"))


def agent_entropy(parsed: DataFrame, keys=("src_ip",)) -> DataFrame:
    """Entropy of the user agents of each address; also right when one address has very many agents."""
    counts = parsed.groupBy(*keys, "http_agent").agg(F.count(F.lit(1)).cast("double").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.join(totals, list(keys)).groupBy(*keys).agg(
        (-F.sum(share * F.log2(share + 1e-9))).alias("user_agent_entropy")
    )


def address_activity(parsed: DataFrame, keys=("src_ip",), window_minutes: float = 1) -> DataFrame:
    """Line counts, request rate per minute, share of distinct URLs and of unusual methods, 4xx share."""
    lines = F.count(F.lit(1)).cast("double")
    other = count_if(~F.col("http_method").isin("GET", "POST")).cast("double")
    web = count_if(F.col("is_http")).cast("double")
    errors = count_if(F.col("is_http") & F.col("http_status").between(400, 499)).cast("double")
    return parsed.groupBy(*keys).agg(
        lines.alias("time_window_count"),
        (lines / float(max(window_minutes, 1))).alias("request_rate"),
        (F.count_distinct("http_url") / lines).alias("url_frequency"),
        (other / lines).alias("method_distribution"),
        F.when(web > 0, errors / web).otherwise(0.0).alias("status_4xx_rate"),
    )


def address_switching(logs: DataFrame) -> DataFrame:
    """For each address: the largest number of addresses that any of its users came from."""
    named = logs.select(source_ip(logs).alias("src_ip"), loose_user_name(line_text(logs)).alias("user"))
    pairs = named.where("src_ip IS NOT NULL AND user <> 'unknown'").distinct()
    spread = pairs.groupBy("user").agg(F.count(F.lit(1)).alias("addresses"))
    widest = pairs.join(spread, "user").groupBy("src_ip").agg(F.max("addresses").cast("double").alias("widest"))
    every = named.where("src_ip IS NOT NULL").select("src_ip").distinct()
    return every.join(widest, "src_ip", "left").select(
        "src_ip", F.coalesce("widest", F.lit(0.0)).alias("ip_switch_frequency")
    )


def legacy_features(logs: DataFrame, window_minutes: float = 1) -> DataFrame:
    """All per-address legacy features of a batch in one frame."""
    parsed = parsed_lines(logs)
    return (
        address_activity(parsed, window_minutes=window_minutes)
        .join(agent_entropy(parsed), "src_ip")
        .join(address_switching(logs), "src_ip")
    )


def legacy_aliases(features: DataFrame) -> DataFrame:
    """The names that older callers use for three of the features."""
    return features.withColumns({
        "login_fail_count": F.col("auth_fail_count"),
        "fail_success_ratio": F.col("auth_fail_ratio"),
        "unique_failed_ip_count": F.col("distinct_username"),
    })
