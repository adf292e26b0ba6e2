"""Alert stream to the event table, with rejected lines kept aside."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.functions.alerts import is_json, is_storable, parse_alerts
from palisade.functions.numbers import count_if
from palisade.sinks.datasets import split_rejected


def alert_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Valid JSON lines as events (works on streams and on tables)."""
    trimmed = lines.withColumn(column, F.trim(column)).where(F.col(column) != "")
    return parse_alerts(trimmed.where(is_json(F.col(column))), column)


def without_repeats(events: DataFrame, delay: str = "10 minutes", time: str = "timestamp") -> DataFrame:
    """Drop replays of a line: the id is a hash of its content, remembered for the length of the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_id"])


def write_batch(folder: str, column: str = "value"):
    """A foreachBatch writer: events and dead letters of a batch go to a folder of its number.

    Running a batch again overwrites the same folder, so a retry after a lost executor adds nothing. Alerts
    without a readable time get the time of arrival.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        filled = batch.withColumn(column, F.trim(column)).where(F.col(column) != "").persist()
        try:
            good = is_json(F.col(column))
            accepted, refused = split_rejected(
                parse_alerts(filled.where(good), column, F.current_timestamp()), is_storable())
            dead = filled.where(~good).select(F.col(column).alias("line"), F.lit("not JSON").alias("reason")).unionByName(
                refused.select(F.col("parsed_json").alias("line"), F.lit("constraint").alias("reason")))
            accepted.write.mode("overwrite").parquet(f"{folder}/log_event/batch={batch_id}")
            dead.write.mode("overwrite").parquet(f"{folder}/dead_letter/batch={batch_id}")
            counts = filled.agg(count_if(good).alias("accepted"), count_if(~good).alias("rejected"))
            counts.write.mode("overwrite").parquet(f"{folder}/ingest_counts/batch={batch_id}")
        finally:
            filled.unpersist()

    return write




def start_ingest(lines: DataFrame, folder: str, checkpoint: str, every: str | None = "2 seconds"):
    """Start the query; ``every=None`` drains what is there and stops."""
    writer = lines.writeStream.foreachBatch(write_batch(folder)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def read_ingested(spark: SparkSession, folder: str, table: str = "log_event") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}").drop("batch")
