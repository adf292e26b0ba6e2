"""Keyed tables merged on read: replays, midnight, crashes, lookups; stream context against the batch."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palisade.operators.joins import with_event_context
from palisade.session import child_names, path_exists
from palisade.sinks.merge import MergeTable
from palisade.sinks.upsert import RISK_KEYS, RISK_UPDATED
from palisade.streaming import drain as D, features as SF

RISK = "id string, anomaly_result_id string, score double, risk_class string, ai_component double, rule_component double, timestamp timestamp"


def risk_rows(spark, rows):
    return spark.createDataFrame([(i, a, s, "Low", s, s, t) for i, a, s, t in rows], RISK)


def content(df):
    return sorted(((r["id"], r["anomaly_result_id"], r["score"], r["timestamp"]) for r in df.collect()), key=repr)


@pytest.fixture
def risk(spark, tmp_path):
    return MergeTable(spark, str(tmp_path / "risk"), RISK_KEYS, RISK_UPDATED, buckets=4)


def test_versions_over_midnight_and_replays(spark, risk):
    evening, morning = datetime(2024, 1, 1, 23, 59), datetime(2024, 1, 2, 0, 1)
    assert risk.read() is None
    first = risk_rows(spark, [("i1", "a", 10.0, evening), ("i2", "b", 20.0, evening), ("i3", None, 5.0, evening)])
    second = risk_rows(spark, [("i4", "a", 30.0, morning), ("i5", "c", 40.0, morning), ("i6", None, 6.0, morning)])
    for _ in range(2):  # each batch arrives twice
        risk.append(first, 0)
        risk.append(second, 1)
    want = [("i1", "a", 30.0, morning), ("i2", "b", 20.0, evening), ("i5", "c", 40.0, morning), ("i3", None, 5.0, evening), ("i6", None, 6.0, morning)]
    assert content(risk.read()) == sorted(want, key=repr)
    risk.compact()
    assert content(risk.read()) == sorted(want, key=repr)
    risk.append(risk_rows(spark, [("i9", "b", 50.0, evening)]), 2)
    want[1] = ("i2", "b", 50.0, evening)
    assert content(risk.read()) == sorted(want, key=repr)
    risk.compact()
    risk.compact()
    assert content(risk.read()) == sorted(want, key=repr)


def test_a_failed_batch_does_not_count(spark, risk, tmp_path):
    risk.append(risk_rows(spark, [("i1", "a", 1.0, datetime(2024, 1, 1))]), 0)
    broken = risk_rows(spark, [("i2", "a", 2.0, datetime(2024, 1, 1))])
    risk.append(broken, 1)
    (tmp_path / "risk" / "kind=delta" / "batch=1" / "_SUCCESS").unlink()  # as if the writer had stopped
    assert content(risk.read())[0][2] == 1.0
    risk.append(broken, 1)
    assert content(risk.read())[0][2] == 2.0


def test_a_stop_between_merge_and_removal(spark, risk, monkeypatch):
    for n in range(3):
        risk.append(risk_rows(spark, [(f"i{k}", f"a{k}", n + k / 100, datetime(2024, 1, 1)) for k in range(50)]), n)
    want = content(risk.read())
    monkeypatch.setattr(MergeTable, "clean", lambda self: None)
    risk.compact()
    assert len(child_names(spark, f"{risk.path}/kind=delta")) == 3 and content(risk.read()) == want
    monkeypatch.undo()
    risk.clean()
    assert not child_names(spark, f"{risk.path}/kind=delta") and content(risk.read()) == want


def test_a_base_that_was_not_finished(spark, risk, tmp_path):
    for n in range(2):
        risk.append(risk_rows(spark, [("i1", "a", float(n), datetime(2024, 1, 1))]), n)
    want = content(risk.read())
    risk._write(risk.read().withColumn("score", F.lit(99.0)), "base", 1)
    (tmp_path / "risk" / "kind=base" / "batch=1" / "_SUCCESS").unlink()
    assert content(risk.read()) == want
    risk.compact()
    assert content(risk.read()) == want and path_exists(spark, f"{risk.path}/kind=base/batch=1/_SUCCESS")


def test_lookup_opens_the_buckets_of_its_keys(spark, risk):
    for n in range(3):
        risk.append(risk_rows(spark, [(f"i{k}", f"a{k}", n + k / 100, datetime(2024, 1, 1)) for k in range(200)]), n)
    wanted = spark.createDataFrame([("a7",), ("nowhere",)], "anomaly_result_id string")
    found = risk.lookup(wanted)
    assert content(found) == [("i7", "a7", 2.07, datetime(2024, 1, 1))]
    opened = {name.split("/bucket=")[1].split("/")[0] for name in found.inputFiles()}
    assert len(opened) <= 2 and len({f.split("/bucket=")[1].split("/")[0] for f in risk.stored().inputFiles()}) == 4
    risk.compact()
    risk.append(risk_rows(spark, [("x", "a7", 9.0, datetime(2024, 1, 1))]), 3)
    touched = {name.split("/bucket=")[1].split("/")[0] for name in risk.lookup(wanted.limit(1)).inputFiles()}
    assert len(touched) == 1 and content(risk.lookup(wanted))[0][2] == 9.0
    assert risk.compact() == 1  # only the bucket with a delta is written again


def test_order_within_a_batch_and_first_values(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "v"), ["k"], ["value", "at"], ["at"], buckets=2)
    schema = "k string, name string, value int, at int"
    table.append(spark.createDataFrame([("a", "first", 1, 5), ("a", "later", 2, 9), ("a", "mid", 3, 7)], schema), 3)
    table.append(spark.createDataFrame([("a", "new", 4, 1), ("b", "b", 5, 1)], schema), 10)
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", "first", 4, 1), ("b", "b", 5, 1)]
    table.append(spark.createDataFrame([], schema), 11)
    table.compact()
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", "first", 4, 1), ("b", "b", 5, 1)]


def test_stream_context_equals_the_join(spark, tmp_path):
    rows = [(f"e{i:03d}", datetime(2024, 1, 1, i // 60 % 24, i % 60, 0), f"10.0.0.{0 if i % 3 == 0 else i % 7}",
             "Failed password for u1" if i % 2 else "x", None if i % 11 == 0 else i % 13, f"agent{i % 4}") for i in range(600)]
    frame = spark.createDataFrame(rows, "event_id string, timestamp timestamp, source_ip string, raw_log string, severity int, agent_id string")
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = D.drained(SF.stream_counters(stream, 300, context=True, delay="1 day"))
    assert made.count() == 0  # nothing is closed within a day
    made = D.drained(SF.stream_counters(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 300, context=True))
    got = made.select(F.col("window.start").alias("window_start"), "src_ip", F.coalesce("max_severity", F.lit(0)).alias("s"), "first_event.event_id", "first_event.agent_id")
    keyed = frame.withColumn("window_start", F.window("timestamp", "5 minutes")["start"])
    want = with_event_context(got.select("window_start", "src_ip"), keyed, ("window_start", "src_ip"))
    assert got.count() > 50 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_columns_made_after_the_move_are_the_rows(spark, tmp_path):
    """Both ways store the same rows in the same buckets; ids and JSON are made behind the shuffle."""
    from palisade.sinks.results import prediction_columns, prediction_rows
    from palisade.streaming.features import result_tables

    labels = ["Anomaly", "Normal", "Uncertain", None]
    scored = spark.createDataFrame(
        [(None if k % 9 == 0 else f"10.0.0.{k % 7}", k % 5, k / 40, labels[k % 4], None if k % 6 == 0 else 2.5 * k) for k in range(40)],
        "src_ip string, minute int, anomaly_score double, predicted_label string, risk_score double").selectExpr(
        "*", "timestamp_seconds(1700000000 + 60 * minute) AS window_start", "'v' AS model_version", "minute / 3 AS burst_rate")
    plain, late = result_tables(spark, str(tmp_path / "plain")), result_tables(spark, str(tmp_path / "late"))
    for name, rows, (base, columns) in zip(("anomaly_result", "risk_score"), prediction_rows(scored), prediction_columns(scored)):
        plain[name].append(rows, 0)
        late[name].append(base, 0, columns)
        found = [sorted(map(repr, t[name].stored().collect())) for t in (plain, late)]
        assert found[0] == found[1] and len(found[0]) > 10
    moved = []
    late["risk_score"]._folder = lambda kind, batch: str(tmp_path / "again")
    hint = type(scored).hint
    try:
        type(scored).hint = lambda df, *a: moved.append(df) or hint(df, *a)
        late["risk_score"].append(base, 1, columns)
    finally:
        type(scored).hint = hint
    assert not {"id", "anomaly_result_id", "feature_snapshot"} & set(moved[0].columns)


def test_every_appended_vector_has_a_row(spark, tmp_path):
    from palisade.catalog import models
    from tests.conftest import SMALL

    path = str(tmp_path / "lineitem.parquet")
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").limit(50)
    rows.unionByName(rows.limit(20).withColumn("l_quantity", F.lit(1).cast(rows.schema["l_quantity"].dataType))).unionByName(
        rows.limit(5)).coalesce(1).write.parquet(path)
    assert models.stored_vectors(spark, str(tmp_path)).count() == 75
