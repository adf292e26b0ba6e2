"""Day partitions and their expiry."""

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

# Days that a table is kept; tables that are not named are kept for ever.
KEEP_DAYS = {"log_event": 90, "feature_vectors": 180}


def write_daily(df: DataFrame, table: str, time: str, mode: str = "append") -> None:
    """A managed table with one partition per day of ``time``."""
    df.withColumn("event_date", F.to_date(time)).hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").format("parquet").saveAsTable(table)


def retained(df: DataFrame, time: str, keep_days: int, today: date) -> DataFrame:
    return df.where(F.to_date(time) >= F.lit(today - timedelta(days=keep_days)))


def daily_slice(df: DataFrame, start, end, time: str = "timestamp", day: str = "event_date") -> DataFrame:
    """Time range with the matching day range, so that other partitions are not read."""
    inside = F.col(time).between(F.lit(start), F.lit(end))
    return df.where(inside & F.col(day).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def drop_expired(spark: SparkSession, table: str, keep_days: int, today: date) -> list:
    """Drop the day partitions that are too old; returns their names."""
    oldest = str(today - timedelta(days=keep_days))
    days = [r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]  # one row per day
    expired = sorted(d for d in days if d < oldest)
    for day in expired:
        spark.sql(f"ALTER TABLE {table} DROP PARTITION (event_date = '{day}')")
    return expired


def chunk_days(df: DataFrame, time: str, days: int = 1) -> DataFrame:
    """Rows and time range per chunk of days."""
    start = F.window(F.col(time), f"{days} days")["start"].alias("chunk_start")
    return df.groupBy(start).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"))
