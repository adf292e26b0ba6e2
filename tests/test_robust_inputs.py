"""Odd inputs that must neither stop a job nor lose rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palisade import schema as S
from palisade.detectors import ocsvm as O
from palisade.functions.alerts import is_storable, parse_alerts
from palisade.functions.patterns import parse_logfmt
from palisade.functions.text import event_time
from palisade.operators.features import extract_features
from palisade.sinks.upsert import RISK_KEYS, RISK_UPDATED, upsert
from palisade.sources import files as R
from palisade.sources import tables as Q
from palisade.streaming.ingest import read_ingested, write_batch


def test_alert_times(spark):
    lines = spark.createDataFrame([
        ('{"timestamp": "2024-01-02T03:04:05Z", "full_log": "a"}',), ('{"timestamp": "never", "full_log": "b"}',), ('{"full_log": "c"}',),
    ], "value string")
    parsed = {r.raw_log: r for r in parse_alerts(lines).withColumn("ok", is_storable()).collect()}
    assert [parsed[k].ok for k in "abc"] == [True, False, False]
    arrived = parse_alerts(lines, default_time=F.lit(datetime(2024, 5, 5)))
    assert {r.raw_log: r.timestamp.month for r in arrived.collect()} == {"a": 1, "b": 5, "c": 5}


def test_ingest_keeps_alerts_without_time(spark, tmp_path):
    lines = spark.createDataFrame([('{"full_log": "c"}',), ("no json",), ('{"timestamp": "x", "full_log": "d"}',)], "value string")
    write_batch(str(tmp_path))(lines, 0)
    assert sorted(r.raw_log for r in read_ingested(spark, str(tmp_path)).collect()) == ["c", "d"]
    assert read_ingested(spark, str(tmp_path), "dead_letter").count() == 1


def test_text_times_fall_back(spark):
    rows = spark.createDataFrame(
        [("not a time", "2024-01-01 00:00:05", "x"), ("2024-01-01 00:00:01", None, "y"), ("bad", None, "z")],
        "timestamp string, ts string, raw_message string")
    got = {r.raw_message: r.t for r in rows.select("raw_message", event_time(rows).alias("t")).collect()}
    assert (got["x"], got["y"], got["z"]) == (datetime(2024, 1, 1, 0, 0, 5), datetime(2024, 1, 1, 0, 0, 1), None)
    lines = spark.createDataFrame(
        [("bad", "10.0.0.1", "Failed password for root from 10.0.0.1 port 1 ssh2"),
         ("2024-01-01 00:00:01", "10.0.0.1", "Failed password for bob from 10.0.0.1 port 1 ssh2")],
        "timestamp string, src_ip string, raw_message string")
    assert extract_features(lines, window_seconds=60).count() >= 1


def test_logfmt_repeated_key(spark):
    lines = spark.createDataFrame([('a=1 b="x y" a=2 a=2 c= b=z',), ("",), (None,)], "line string")
    got = [r.fields for r in parse_logfmt(lines, "line").collect()]
    assert got[0] == {"a": "2", "c": "", "b": "z"} and not got[1] and not got[2]


def test_mixed_encodings_and_absent_folders(spark, tmp_path):
    folder = tmp_path / "flows"
    folder.mkdir()
    (folder / "a.csv").write_bytes("Flow ID,Label\n1,café – a\n".encode("cp1252"))
    (folder / "b.csv").write_bytes("Flow ID,Label\n1,café – b\n".encode("utf-8"))
    assert sorted(r.flow_label for r in R.read_flows(spark, str(folder)).collect()) == ["café – a", "café – b"]
    found = R.discover_files(spark, [str(tmp_path / "absent"), str(folder)]).collect()
    assert [(r.file_name, r.priority) for r in found] == [("a.csv", 1), ("b.csv", 1)]
    assert R.discover_files(spark, [str(tmp_path / "absent")]).count() == 0


def test_no_default_cuts_rows(spark):
    rows = spark.range(60_000).withColumn("timestamp", F.lit(datetime(2024, 1, 1))).withColumnRenamed("id", "event_id")
    assert Q.query_frame(spark, "SELECT * FROM many", many=rows).count() == 60_000
    with pytest.raises(TypeError):
        Q.range_or_newest(rows, datetime(2030, 1, 1), datetime(2030, 1, 2))
    assert Q.range_or_newest(rows, datetime(2030, 1, 1), datetime(2030, 1, 2), 70_000).count() == 60_000
    assert O.fit_boundaries.__defaults__[0] is None and O.fit_ocsvm.__defaults__[-1] is None


def test_risk_moves_over_midnight(spark, tmp_path):
    path = str(tmp_path / "risk")
    columns = "anomaly_result_id string, score double, risk_class string, ai_component double, rule_component double, timestamp timestamp, id string"

    def batch(*rows):
        made = spark.createDataFrame([(k, s, "Low", s, 0.0, t, f"id{k}") for k, s, t in rows], columns)
        upsert(spark, path, made, RISK_KEYS, RISK_UPDATED, partition="event_date", time="timestamp")

    batch(("a", 1.0, datetime(2024, 1, 1, 23, 59)), ("b", 2.0, datetime(2024, 1, 1, 12)), ("c", 3.0, datetime(2024, 1, 3)))
    batch(("a", 9.0, datetime(2024, 1, 2, 0, 1)), ("c", 8.0, datetime(2024, 1, 4)))
    batch(("c", 8.0, datetime(2024, 1, 4)))
    got = sorted((r.anomaly_result_id, r.score, str(r.event_date)) for r in spark.read.parquet(path).collect())
    assert got == [("a", 9.0, "2024-01-02"), ("b", 2.0, "2024-01-01"), ("c", 8.0, "2024-01-04")]
    assert S.TABLES
