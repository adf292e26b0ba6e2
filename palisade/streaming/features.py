"""Windowed features and scores over an event stream."""

from pyspark.sql import DataFrame, functions as F

from palisade import schema as S
from palisade.functions.text import parsed_lines
from palisade.operators.features import CONTEXT, address_counters, event_records, finished_features, record_counters, time_window
from palisade.session import remove_path, scratch_path, shuffles_removed
from palisade.sinks.merge import MergeTable
from palisade.sinks.upsert import RESULT_KEYS, RESULT_UPDATED, RISK_KEYS, RISK_UPDATED, VECTOR_KEYS
from palisade.streaming.drain import state_on_disk

STREAM_KEYS = ("window", "src_ip")


def stream_counters(events: DataFrame, window_seconds: float = 60.0, slide_seconds: float | None = None,
                    delay: str = "10 minutes", time: str = "timestamp", context: bool = False) -> DataFrame:
    """Counters per (window, address) in append mode: a window leaves once, when the watermark has passed it.

    The two aggregations of the batch form run as two chained stateful steps. The state per address is
    bounded by the window: one entry per ten seconds, and one row per distinct user and agent. With
    ``context`` the state also carries the highest severity and the earliest event of the window, so that
    scoring a closed window needs no look at the event table.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    parsed = parsed_lines(timed, F.col(time)).withColumn(
        "window", time_window(F.col("event_time"), window_seconds, slide_seconds))
    records = event_records(parsed, STREAM_KEYS, CONTEXT if context else ())
    return address_counters(record_counters(records, STREAM_KEYS, context), STREAM_KEYS, context)


def batch_features(counters: DataFrame, window_seconds: float = 60.0, feature_version: str = S.DEFAULT_FEATURE_VERSION,
                   computed_at=None) -> DataFrame:
    """Finish the windows of one micro-batch: all addresses of a closed window arrive together.

    Counters with context also give max_severity (0 without one), event_id and agent_id.
    """
    framed = counters.withColumn("window_start", F.col("window.start")).drop("window")
    keep = []
    if "first_event" in counters.columns:
        keep = [F.coalesce("max_severity", F.lit(0)).alias("max_severity"), F.col("first_event.event_id"), F.col("first_event.agent_id")]
    return finished_features(framed, window_seconds, feature_version=feature_version, computed_at=computed_at, keep=keep)


def write_features(folder: str, window_seconds: float = 60.0, computed_at=None):
    """A foreachBatch writer; the folder of a batch is overwritten when the batch runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        path = scratch_path(batch.sparkSession, "closed")
        try:
            closed = _stored(batch, path)  # read twice
            batch_features(closed, window_seconds, computed_at=computed_at).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        finally:
            remove_path(batch.sparkSession, path)

    return write


def _stored(batch: DataFrame, path: str, session=None) -> DataFrame:
    """Rows of a micro-batch as files, whose shuffles are gone when they are written."""
    with shuffles_removed(batch.sparkSession):
        batch.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return (session or batch.sparkSession).read.schema(batch.schema).parquet(path)


def result_tables(spark, root: str) -> dict:
    """The keyed result tables below a folder."""
    return {
        "feature_vectors": MergeTable(spark, f"{root}/feature_vectors", VECTOR_KEYS, [*S.FEATURES, "computed_at"], ["computed_at"]),
        "anomaly_result": MergeTable(spark, f"{root}/anomaly_result", RESULT_KEYS, RESULT_UPDATED),
        "risk_score": MergeTable(spark, f"{root}/risk_score", RISK_KEYS, RISK_UPDATED),
    }


def score_and_upsert(root: str, model, scaler, window_seconds: float = 60.0, spark=None, compact_every: int = 50):
    """A foreachBatch writer: features of closed windows, scores and risk rows, appended to keyed tables.

    The counters carry severity and first event of each window, and a batch reads none of the stored tables
    (but for the merge of every ``compact_every``-th one), so its cost is that of its own windows. A batch
    that runs again finds its rows stored.
    """
    from palisade.plans.serve import score_ready

    def write(batch: DataFrame, batch_id: int) -> None:
        # the session of a stateful stream plans without adaptive execution, so the closed windows are
        # stored and scored in the caller's session
        session = spark or batch.sparkSession
        path = f"{root}/closed_windows/batch={batch_id}"
        closed = _stored(batch, path, session)
        if closed.isEmpty():  # the watermark moved, but no window was closed
            return
        made = score_ready(batch_features(closed, window_seconds), model, scaler)
        for name, stored in result_tables(session, root).items():
            stored.append(made[name], batch_id)
            if batch_id % compact_every == compact_every - 1:
                stored.compact()

    return write


def score_vectors(root: str, model, scaler, compact_every: int = 50):
    """A foreachBatch writer over appended feature vectors: predictions and risk rows."""
    from palisade.plans.serve import infer_on_features
    from palisade.sinks.results import prediction_columns
    from palisade.session import packed_for

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = infer_on_features(batch, model, scaler).withColumn("model_version", F.lit(model.model_version))
        with packed_for(scored) as kept:  # scored once for both tables, and gone when they are written
            stored = result_tables(batch.sparkSession, root)
            for name, (rows, columns) in zip(("anomaly_result", "risk_score"), prediction_columns(kept)):
                stored[name].append(rows, batch_id, columns)
                if batch_id % compact_every == compact_every - 1:
                    stored[name].compact()

    return write


def start(stream: DataFrame, writer, checkpoint: str, every: str | None = None):
    """Start a foreachBatch query; without an interval it drains what is there and stops."""
    query = stream.writeStream.outputMode("append").foreachBatch(writer).option("checkpointLocation", checkpoint)
    with state_on_disk(stream.sparkSession):
        return (query.trigger(availableNow=True) if every is None else query.trigger(processingTime=every)).start()
