"""Files, upserts, retention, jobs on files, streams."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from palisade.operators.flows import capture_rank, checked_times, repaired_time
from palisade.plans import prepare, serve as V
from palisade.session import ship_package
from palisade.sinks import datasets as O, retention as N, results as U, upsert as M
from palisade.sources import files as R, tables as T
from palisade.streaming import decay as K, drain as D, features as SF, ingest as G
from palisade.operators.features import extract_features

HEADER = "Flow ID, Source IP, Timestamp, SYN Flag Count, ACK Flag Count, Flow Bytes/s, Destination Port, Label\n"


def write_days(folder):
    folder.mkdir(parents=True)
    for d, day in enumerate(["Monday-WorkingHours.csv", "Tuesday-WorkingHours.csv", "Thursday-WorkingHours-Morning.csv"]):
        rows = [f"f{i},10.0.{d}.{i % 5},{3 + d}/7/2017 {8 + i % 9}:{i % 60:02d},{i % 7},{i % 5},{'Infinity' if i % 20 == 0 else i * 3.5},{i % 90},"
                f"{'BENIGN' if i % 4 or d == 0 else 'DoS'}\n" for i in range(200)]
        (folder / day).write_text(HEADER + "".join(rows) + ",,,,,,,\n" + rows[1])


def test_flow_files(spark, tmp_path):
    write_days(tmp_path / "flows")
    flows = R.read_flows(spark, str(tmp_path / "flows"))
    assert flows.count() == 603 and {"entity_id", "syn_flags", "flow_label", "flow_time_text"} <= set(flows.columns)
    limited = R.read_flows(spark, str(tmp_path / "flows"), max_rows=50)
    assert limited.groupBy("source_file").count().where("count <> 50").count() == 0
    manifest = prepare.prepare_flows(spark, str(tmp_path / "flows"), str(tmp_path / "out"))
    assert manifest["saved_counts"] == {"train": 200, "validation": 200, "test": 200, "train_benign": 200}
    assert manifest["provenance"]["deduplication_audit"]["duplicates_removed"] == 0
    assert O.read_json(spark, str(tmp_path / "out/split_manifest"))["training_allowed"]
    assert O.load_splits(spark, str(tmp_path / "out")).where("split = 'test' AND label = 'Anomaly'").count() == 50
    with pytest.raises(ValueError):
        prepare.flow_dataset(spark.createDataFrame([(1,)], "x int").transform(lambda d: R.standard_columns(d)))


def test_file_discovery(spark, tmp_path):
    write_days(tmp_path / "first")
    write_days(tmp_path / "second")
    (tmp_path / "second" / "other.csv").write_text("x\n")
    rows = R.discover_files(spark, [str(tmp_path / "first"), str(tmp_path / "second")]).collect()
    assert [r["rank"] for r in rows] == [0, 1, 3, 10] and [r["priority"] for r in rows] == [0, 0, 0, 1]
    frame = spark.createDataFrame([("Friday-WorkingHours-Afternoon-DDos.pcap.csv",)], "n string")
    assert frame.select(capture_rank(F.col("n"))).first()[0] == 8


def test_encoding_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Flow ID,Label\n1,Web Attack – XSS\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("Flow ID,Label\n1,Web Attack – XSS\n".encode("utf-8"))
    for name in ("a.csv", "b.csv"):
        assert R.read_flows(spark, str(tmp_path / name)).first()["flow_label"] == "Web Attack – XSS"


def test_time_repair(spark):
    cases = {"3/7/2017 8:55": "2017-07-03 08:55:00", "03/07/2017 01:05:10": "2017-07-03 13:05:10", "2017-07-03 05:00:00": "2017-07-03 17:00:00",
             "3/7/2017 1:30:00 AM": "2017-07-03 01:30:00", "2017/07/03 12:00": "2017-07-03 12:00:00"}
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [str(r[0]) for r in frame.select(repaired_time(F.col("t"))).collect()] == list(cases.values())
    bad = spark.createDataFrame([("f", "never")], "source_file string, t string").withColumn("flow_time", repaired_time(F.col("t")))
    with pytest.raises(Exception, match="invalid Timestamp"):
        checked_times(bad).collect()


def test_login_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = []
    for minute in range(90):
        for attempt in range(minute % 7):
            lines.append(f"Dec 10 {6 + minute // 60:02d}:{minute % 60:02d}:{attempt * 5:02d} h sshd[1]: Failed password for u{attempt} from 1.1.1.{minute % 3} port 1 ssh2")
        lines.append(f"Dec 10 {6 + minute // 60:02d}:{minute % 60:02d}:59 h sshd[1]: Accepted password for ok from 2.2.2.{minute} port 1 ssh2")
    (folder / "auth.log").write_text("\n\n".join(lines) + "\n")
    assert R.read_log_lines(spark, str(folder)).count() == len(lines)
    assert R.read_log_lines(spark, str(folder), 11).count() == 6  # blank lines count
    (tmp_path / "attacks.csv").write_text("attacker_ip\n2.2.2.5\n")
    manifest = prepare.prepare_logins(spark, str(folder), str(tmp_path / "out"), attackers=str(tmp_path / "attacks.csv"))
    assert manifest["entity_disjoint"] and manifest["saved_counts"]["train"] > 0
    stored = O.load_splits(spark, str(tmp_path / "out"))
    assert stored.where("attack_category = 'SSH-KnownAttacker'").count() >= 1
    unified = prepare.prepare_unified(spark, [stored.where("split <> 'train_benign'").drop("split")], str(tmp_path / "all"))
    assert set(unified) == {"loghub", "all"}


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(datetime(2024, 1, d), "a", 1.0, "old") for d in (1, 2, 3)], "w timestamp, ip string, s double, id string")
    M.upsert(spark, path, rows, ["w", "ip"], ["s"], partition="day", time="w")
    change = rows.where("day(w) > 1").withColumns({"s": F.lit(2.0), "id": F.lit("new")})
    for _ in range(2):
        M.upsert(spark, path, change, ["w", "ip"], ["s"], partition="day", time="w")
    got = sorted((r["w"].day, r["s"], r["id"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1.0, "old"), (2, 2.0, "old"), (3, 2.0, "old")]


def test_table_rules(spark, tmp_path):
    with pytest.raises(ValueError):
        T.read_table(spark, str(tmp_path), "users; drop")
    with pytest.raises(ValueError):
        V.checked_range(datetime(2024, 1, 2), datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        V.checked_range(datetime(2024, 1, 1), datetime(2024, 1, 9))
    assert V.default_risk(spark, datetime(2024, 1, 1)).first()["risk_class"] == "Low"
    labels = spark.createDataFrame([("weird",), ("attack",), (None,)], "predicted_label string").withColumn("risk_score", F.lit(5.0))
    results, risks = U.prediction_rows(labels)
    assert sorted(r[0] for r in results.select("predicted_label").collect()) == ["Anomaly", "Normal", "Uncertain"] and risks.count() == 2


def test_decay_has_a_floor(spark):
    risk = spark.createDataFrame([("a", "x", 100.0, datetime(2024, 1, 1), "1"), ("a", "x", 64.0, datetime(2024, 1, 2), "2"),
                                  ("b", None, 10.0, datetime(2024, 1, 1), "3")], "src_ip string, asset_id string, score double, timestamp timestamp, id string")
    rows = {r["src_ip"]: r for r in V.decayed_risk(risk, datetime(2024, 1, 3)).collect()}
    assert rows["a"]["score"] == 32 and rows["b"]["score"] == 15 and rows["b"]["asset_id"] == "agent-001"
    low = V.decayed_risk(risk.where("src_ip = 'b'"), datetime(2024, 1, 3))
    assert V.decay_to_store(low).count() == 0


def test_retention(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS kept_days")
    frame = spark.createDataFrame([(datetime(2024, 1, d), d) for d in range(1, 11)], "timestamp timestamp, v int")
    frame.withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").option("path", str(tmp_path / "k")).saveAsTable("kept_days")
    assert len(N.drop_expired(spark, "kept_days", 3, date(2024, 1, 10))) == 6
    assert spark.table("kept_days").count() == 4
    assert N.retained(frame, "timestamp", 3, date(2024, 1, 10)).count() == 4
    spark.sql("DROP TABLE kept_days")


def event_files(tmp_path, spark):
    rows = [(f"e{i}", datetime(2024, 1, 1, i // 60 % 24, i % 60, i % 50), f"10.0.0.{0 if i % 3 == 0 else i % 7}",
             "Failed password for u%d" % (i % 4) if i % 2 else '"GET /x HTTP/1.1" 404 7 "-" "A%d"' % (i % 3)) for i in range(600)]
    frame = spark.createDataFrame(rows, "event_id string, timestamp timestamp, source_ip string, raw_log string").orderBy("timestamp")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    return frame, spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))


def test_stream_equals_batch(spark, tmp_path):
    frame, stream = event_files(tmp_path, spark)
    got = D.drained_batches(SF.stream_counters(stream, 300), lambda f: SF.write_features(f, 300)).drop("computed_at")
    batch = extract_features(frame, window_seconds=300).drop("computed_at")
    closed = batch.where(F.col("window_start") + F.expr("INTERVAL 5 MINUTES") <= frame.agg(F.max("timestamp") - F.expr("INTERVAL 10 MINUTES")).scalar())
    assert got.count() == closed.count() > 0 and got.exceptAll(closed).count() == 0


def test_ingest_can_run_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"timestamp": "2024-01-01T00:00:00Z", "full_log": "x"}\nnot json\n\n{"full_log": "no time"}\n')
    for _ in range(2):
        lines = R.stream_json_lines(spark, str(tmp_path / "in"))
        G.start_ingest(lines, str(tmp_path / "out"), str(tmp_path / "state"), every=None).awaitTermination()
    # the alert without a time is stored with the time of arrival
    assert sorted(r["raw_log"] for r in G.read_ingested(spark, str(tmp_path / "out")).collect()) == ["no time", "x"]
    reasons = sorted(r["reason"] for r in G.read_ingested(spark, str(tmp_path / "out"), "dead_letter").collect())
    assert reasons == ["not JSON"]


def test_tagged_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    rows = D.drained(R.stream_log_files(spark, str(tmp_path / "in"), hostname="h", env="lab")).collect()
    assert sorted(r["raw_log"] for r in rows) == ["one", "two"] and rows[0]["env"] == "lab"


def test_idle_addresses_fade(spark, tmp_path):
    for n, rows in enumerate([[("a", 80.0, datetime(2024, 1, 1)), ("b", 10.0, datetime(2024, 1, 1))], [("c", 20.0, datetime(2024, 1, 2))]]):
        spark.createDataFrame(rows, "src_ip string, score double, timestamp timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src_ip string, score double, timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = D.drained(K.fading_risk(stream, 3600)).where("decayed").orderBy("timestamp").collect()
    assert [(r["src_ip"], r["score"]) for r in rows][:1] == [("a", 40.0)]
    assert all(r["score"] >= 15 for r in rows)


def test_fading_does_not_depend_on_triggers(spark, tmp_path):
    hours = [("a", 80.0, 0), ("b", 90.0, 0), ("b", 30.0, 1), ("a", 70.0, 7), ("c", 60.0, 7), ("c", 61.0, 7), ("c", 20.0, 30)]
    rows = [(k, s, datetime(2024, 1, 1 + h // 24, h % 24)) for k, s, h in hours]
    schema, found = "src_ip string, score double, timestamp timestamp", []
    for name, parts in (("one", [rows]), ("many", [[r] for r in rows])):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        found.append(sorted((r["src_ip"], r["timestamp"], r["score"], r["decayed"]) for r in D.drained(K.fading_risk(stream, 3600)).collect()))
    assert found[0] == found[1]
    faded = [(r[0], r[1].hour, r[2]) for r in found[0] if r[3]]
    assert faded == [("a", 1, 40.0), ("a", 2, 20.0), ("a", 3, 15.0), ("a", 8, 35.0), ("a", 9, 17.5), ("a", 10, 15.0), ("b", 1, 45.0),
                     ("b", 2, 15.0), ("c", 8, 30.5), ("c", 9, 15.25), ("c", 10, 15.0)]


def test_marks(spark, tmp_path):
    path = str(tmp_path / "marks")
    assert K.load_mark(spark, path) is None
    K.save_mark(spark, path, datetime(2024, 1, 2))
    K.save_mark(spark, path, datetime(2024, 1, 1))
    assert K.load_mark(spark, path) == datetime(2024, 1, 2)


def test_package_is_shipped_once(spark):
    ship_package(spark)
    ship_package(spark)

    def package_name(batches):
        import pandas as pd

        import palisade

        for _ in batches:
            yield pd.DataFrame({"n": [palisade.__name__]})

    names = spark.range(4).mapInPandas(package_name, "n string").collect()
    assert {r[0] for r in names} == {"palisade"}
