"""Run a stream to the end of its input and read what it wrote."""

import contextlib

from pyspark.sql import DataFrame, SparkSession

from palisade.session import scratch_path

# State of a stream lies on the disk of the executors, with a bound on the memory that all its parts share on one of them.
STATE = "spark.sql.streaming.stateStore."
ON_DISK = {
    STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    STATE + "rocksdb.changelogCheckpointing.enabled": "true", STATE + "rocksdb.boundedMemoryUsage": "true",
    STATE + "rocksdb.maxMemoryUsageMB": "256",
}


@contextlib.contextmanager
def state_on_disk(spark: SparkSession):
    """Streams that start inside the block keep their state on disk instead of the heap; a provider that the session names stays."""
    given = {name: spark.conf.get(name, None) for name in ON_DISK}
    named = given[STATE + "providerClass"]
    chosen = {} if named and not named.endswith(".HDFSBackedStateStoreProvider") else ON_DISK
    for name, value in chosen.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in chosen:
            if given[name] is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, given[name])


def drained(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """All rows the stream emits for the input that is there now."""
    spark = stream.sparkSession
    path = scratch_path(spark, "drained")
    query = (
        stream.writeStream.outputMode(output_mode).format("parquet").option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drained_batches(stream: DataFrame, writer, result: str = "rows") -> DataFrame:
    """Like ``drained`` for a foreachBatch writer: ``writer(folder)`` gives the function."""
    spark = stream.sparkSession
    path = scratch_path(spark, "drained")
    with state_on_disk(spark):
        query = (
            stream.writeStream.outputMode("append").foreachBatch(writer(f"{path}/{result}"))
            .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/{result}").drop("batch")
