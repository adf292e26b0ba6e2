"""Streaming jobs, run to the end of the given tables."""

from datetime import datetime

from pyspark.sql import functions as F

from palisade import schema as S
from palisade.catalog import inputs as I
from palisade.catalog.detection import day_model, labelled_days, parts
from palisade.catalog.logs import ALERT_ROWS, DAY, _ALERT_COLUMNS
from palisade.catalog.registry import query
from palisade.catalog.sqltext import PARSED, features, rounded, with_inputs
from palisade.plans import serve as V
from palisade.session import scratch_path
from palisade.streaming import decay as K, drain as D, features as W, ingest as G

_CLOSED = "WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
_EVENT_STREAM_ALERTS = I.ALERTS


def _alert_stream(spark, sf_dir):
    return I.event_stream(spark, sf_dir, _EVENT_STREAM_ALERTS).select("value")


def _ingested(spark, sf_dir):
    folder = scratch_path(spark, "ingest")
    G.start_ingest(_alert_stream(spark, sf_dir), folder, f"{folder}/state", every=None).awaitTermination()
    return folder


@query("X01_alert_stream", with_inputs(f"SELECT {', '.join(_ALERT_COLUMNS)} FROM ({ALERT_ROWS})", "alerts"))
def alert_stream(spark, sf_dir):
    """Alert lines as a stream into the event table, read back."""
    stored = G.read_ingested(spark, _ingested(spark, sf_dir))
    return stored.withColumn("rule_id", F.coalesce(F.col("rule_id").cast("string"), F.lit("none"))).select(*_ALERT_COLUMNS)


@query("S16_stream_batches", with_inputs("""SELECT CAST(count(*) FILTER (json_valid(value)) AS BIGINT) AS accepted,
  CAST(count(*) FILTER (NOT json_valid(value)) AS BIGINT) AS rejected FROM alerts""", "alerts"))
def stream_batches(spark, sf_dir):
    counts = G.read_ingested(spark, _ingested(spark, sf_dir), "ingest_counts")
    return counts.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


@query("X09_repeated_alerts", with_inputs(f"SELECT DISTINCT event_id FROM ({ALERT_ROWS})", "alerts"))
def repeated_alerts(spark, sf_dir):
    """Every line arrives twice; its content hash keeps one."""
    twice = _alert_stream(spark, sf_dir).withColumn("value", F.explode(F.array("value", "value")))
    return D.drained(G.without_repeats(G.alert_events(twice), "40 days").select("event_id"))


@query("X02_progress_mark", with_inputs("SELECT max(timestamp) AS mark, count(*) AS rows FROM log_event WHERE timestamp > TIMESTAMP '2024-01-10'", "log_event"))
def progress_mark(spark, sf_dir):
    """A run stores the last event time; the next run starts behind it."""
    from palisade.sources.tables import next_mark, since_mark

    path = scratch_path(spark, "marks")
    events = I.log_event(spark, sf_dir)
    K.save_mark(spark, path, datetime(2024, 1, 10))
    fresh = since_mark(events, K.load_mark(spark, path), datetime(2024, 3, 1))
    K.save_mark(spark, path, next_mark(fresh, datetime(2024, 3, 1)))
    marks = spark.read.parquet(path).agg(F.max("mark").alias("mark"))
    return marks.withColumn("rows", fresh.agg(F.count(F.lit(1))).scalar())


@query("X03_tumbling_features", f"WITH {features()} SELECT window_start, src_ip, {rounded(S.FEATURES)} FROM features {_CLOSED}")
def tumbling_features(spark, sf_dir):
    """Features of closed day windows from the stream equal those of the batch."""
    made = D.drained_batches(W.stream_counters(I.event_stream(spark, sf_dir), DAY), lambda f: W.write_features(f, DAY))
    return made.select("window_start", "src_ip", *S.FEATURES)


_HALF = """(SELECT p.*, w FROM ({0}) p, LATERAL (SELECT unnest([date_trunc('hour', event_time) - to_hours(CAST(hour(event_time) % 12 AS INT)),
  date_trunc('hour', event_time) - to_hours(CAST(hour(event_time) % 12 + 12 AS INT))]) AS w) x)""".format(PARSED)


@query("X04_sliding_features", f"WITH {features(source=_HALF, start='w')} SELECT window_start, src_ip, {rounded(['auth_fail_count', 'http_4xx_ratio', 'global_active_ips'])} FROM features {_CLOSED}")
def sliding_features(spark, sf_dir):
    stream = W.stream_counters(I.event_stream(spark, sf_dir), DAY, DAY / 2)
    made = D.drained_batches(stream, lambda f: W.write_features(f, DAY))
    return made.select("window_start", "src_ip", "auth_fail_count", "http_4xx_ratio", "global_active_ips")


@query("X05_stream_gaps", f"WITH {features()} SELECT window_start, src_ip, {rounded(['fail_interarrival_mean', 'fail_interarrival_std'])} FROM features {_CLOSED}")
def stream_gaps(spark, sf_dir):
    """Gap statistics inside the stream, from the ten-second marks of each window."""
    from palisade.operators.features import _expanded_seconds, failure_gaps

    counters = W.stream_counters(I.event_stream(spark, sf_dir), DAY)
    mean, deviation = failure_gaps(_expanded_seconds(F.col("marks")), F.col("timed_fails"))
    return D.drained(counters.select(F.col("window.start").alias("window_start"), "src_ip", mean.alias("fail_interarrival_mean"),
                                     deviation.alias("fail_interarrival_std")))


_FIRST = """(SELECT date_trunc('day', timestamp) AS window_start, source_ip AS src_ip, max(severity) AS max_severity,
  arg_min(event_id, place) AS event_id, arg_min(agent_id, place) AS agent_id
  FROM (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS place FROM log_event {0}) GROUP BY 1, 2)"""


@query("X06_stream_context", with_inputs(f"""SELECT window_start, src_ip, CAST(coalesce(max_severity, 0) AS INT) AS max_severity, event_id, agent_id
FROM {_FIRST.format('')} {_CLOSED}""", "log_event"))
def stream_context(spark, sf_dir):
    """Highest severity and first event of each closed window, out of the state of the stream."""
    made = D.drained(W.stream_counters(I.event_stream(spark, sf_dir), DAY, context=True))
    return made.select(F.col("window.start").alias("window_start"), "src_ip", F.coalesce("max_severity", F.lit(0)).cast("int").alias("max_severity"),
                       "first_event.event_id", "first_event.agent_id")


_SCORED = """SELECT f.window_start, f.src_ip, e.event_id, sha256(concat_ws('|', strftime(f.window_start, '%Y-%m-%d %H:%M:%S'), f.src_ip, '{0}')) AS id,
  sha256(concat_ws('|', strftime(f.window_start, '%Y-%m-%d %H:%M:%S'), f.src_ip, '{1}')) AS feature_vector_id, {2}
  FROM features f JOIN {3} e ON e.window_start = f.window_start AND e.src_ip = f.src_ip"""


def _scored_sql(first, tail="", source=None):
    made = _SCORED.format(S.DEFAULT_MODEL_VERSION, S.DEFAULT_FEATURE_VERSION, ", ".join(f"f.{n}" for n in S.FEATURES), first)
    columns = f"window_start, src_ip, event_id, id, feature_vector_id, {rounded(S.FEATURES)}"
    return f"WITH log_event AS ({I.SQL['log_event']}), {features(source=source)} SELECT {columns} FROM ({made}) {tail}"


def _scored_rows(results, vectors):
    """Results with the features that they stand for."""
    named = vectors.select(F.col("id").alias("feature_vector_id"), *S.FEATURES)
    rows = results.select("window_start", "src_ip", "event_id", "id", "feature_vector_id").join(named, "feature_vector_id")
    return rows.select("window_start", "src_ip", "event_id", "id", "feature_vector_id", *S.FEATURES)


@query("X06_scored_stream", _scored_sql(_FIRST.format(""), _CLOSED))
def scored_stream(spark, sf_dir):
    """Stream to features, scores and risk rows in the keyed result tables; one result per window and address."""
    root = scratch_path(spark, "tables")
    scaler = parts(spark, sf_dir)[0]
    counters = W.stream_counters(I.event_stream(spark, sf_dir), DAY, context=True)
    W.start(counters, W.score_and_upsert(root, day_model(spark, sf_dir), scaler, DAY, spark), f"{root}/state").awaitTermination()
    stored = W.result_tables(spark, root)
    return _scored_rows(stored["anomaly_result"].read(), stored["feature_vectors"].read())


@query("X07_fading_risk", with_inputs("""
SELECT src_ip, round(score, 6) + 0.0 AS score, timestamp, decayed,
  CASE WHEN score > 80 THEN 'Critical' WHEN score > 50 THEN 'High' WHEN score > 25 THEN 'Medium' ELSE 'Low' END AS risk_class FROM (
  SELECT src_ip, CAST(score AS DOUBLE) AS score, timestamp, false AS decayed FROM risk
  UNION ALL
  SELECT src_ip, greatest(15.0, s / power(2, k)), timestamp + to_days(CAST(30 * k AS INTEGER)), true FROM (
    SELECT src_ip, s, timestamp, unnest(range(1, 12)) AS k, upto FROM (
      SELECT src_ip, CAST(score AS DOUBLE) AS s, timestamp, coalesce(lead(timestamp) OVER (PARTITION BY src_ip ORDER BY timestamp, score),
        (SELECT max(timestamp) - INTERVAL 1 MINUTE FROM risk)) AS upto FROM risk))
  WHERE greatest(15.0, s / power(2, k - 1)) > 15 AND timestamp + to_days(CAST(30 * k AS INTEGER)) <= upto)""", "risk"))
def fading_risk(spark, sf_dir):
    """Risk of addresses that go quiet, halved for every idle month of event time."""
    schema = I.table(spark, sf_dir, "orders").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    risk = raw.selectExpr("*", I._SPARK_TIME["orders"]).selectExpr(*I.RISK)
    return D.drained(K.fading_risk(risk, 30 * DAY))


_SPAN = "timestamp > TIMESTAMP '2024-01-03' AND timestamp <= TIMESTAMP '2024-01-09'"


@query("X08_backfill", _scored_sql(_FIRST.format(f"WHERE {_SPAN}"), source=f"(SELECT * FROM ({PARSED}) WHERE {_SPAN})"))
def backfill(spark, sf_dir):
    """Features, first events and ids of a range of days."""
    scaler = parts(spark, sf_dir)[0]
    made = V.backfill(I.log_event(spark, sf_dir), datetime(2024, 1, 3), datetime(2024, 1, 9), day_model(spark, sf_dir), scaler, DAY)
    return _scored_rows(made["anomaly_result"], made["feature_vectors"])


@query("X10_rescored_vectors")
def rescored_vectors(spark, sf_dir):
    """Appended feature vectors as a stream; each gets one prediction."""
    root = scratch_path(spark, "vectors")
    labelled_days(spark, sf_dir).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    W.start(stream, W.score_vectors(root, day_model(spark, sf_dir), parts(spark, sf_dir)[0]), f"{root}/state").awaitTermination()
    return W.result_tables(spark, root)["anomaly_result"].read().select("window_start", "src_ip", "anomaly_score", "predicted_label")
