"""Worked examples."""

import json

import pytest
from pyspark.sql import functions as F

from palisade import schema as S
from palisade.functions import alerts, labels, risk
from palisade.functions.text import source_ip
from palisade.operators import metrics as M, syslog as Y
from palisade.operators.cleaning import feature_matrix, features_and_target, require_features
from palisade.operators.features import extract_features

LINES = [
    ("192.168.1.100", '192.168.1.100 - - [15/Jul/2026:22:00:00 +0700] "GET /index.html HTTP/1.1" 200 4324',
     {"status": 200, "url": "/index.html", "method": "GET", "user_agent": "Mozilla/5.0"}),
    ("172.16.0.1", '172.16.0.1 - - [15/Jul/2026:22:00:01 +0700] "GET /admin/config.php HTTP/1.1" 404 120',
     {"status": 404, "url": "/admin/config.php", "method": "GET", "user_agent": "Gobuster/v3.0"}),
    ("10.0.0.5", "sshd[1234]: Failed password for invalid user admin from 10.0.0.5 port 54322 ssh2", {"user": "admin"}),
    ("10.0.0.5", "sshd[1234]: Accepted password for root from 10.0.0.5 port 54322 ssh2", {"user": "root"}),
]


def test_features_of_one_poll(spark):
    logs = spark.createDataFrame([(a, b, json.dumps(c)) for a, b, c in LINES], "src_ip string, raw_message string, parsed_json string")
    rows = {r["src_ip"]: r for r in extract_features(logs, window_start="2026-07-15 15:00:00").collect()}
    web, scan, ssh = rows["192.168.1.100"], rows["172.16.0.1"], rows["10.0.0.5"]
    assert (web["auth_fail_count"], web["bytes_sent_mean"], web["distinct_user_agent"]) == (0, 4324, 1)
    assert web["http_req_rate"] == pytest.approx(1 / 60) and web["global_active_ips"] == 3 and web["burst_rate"] == 1
    assert (scan["http_4xx_ratio"], scan["http_5xx_ratio"], scan["bytes_sent_mean"]) == (1, 0, 120)
    assert (ssh["auth_fail_count"], ssh["auth_success_count"], ssh["auth_fail_ratio"], ssh["distinct_username"]) == (1, 1, 0.5, 2)
    assert ssh["http_req_rate"] == 0 and ssh["fail_interarrival_mean"] == 0


def test_lines_that_say_nothing_count_as_web(spark):
    logs = spark.createDataFrame([("a", "hello 503 7 there"), ("a", "hello"), ("b", "x")], "src_ip string, raw_message string")
    rows = {r["src_ip"]: r for r in extract_features(logs, window_start="2026-01-01").collect()}
    assert rows["a"]["http_req_rate"] == pytest.approx(2 / 60)
    assert rows["a"]["http_5xx_ratio"] == 0.5 and rows["a"]["bytes_sent_mean"] == 3.5


def test_gap_statistics(spark):
    times = ["00:00:01.9", "00:00:01.1", "00:00:05.5", "00:00:25.0", "00:00:26.0"]
    logs = spark.createDataFrame([("a", "Failed password for x", f"2024-01-01 {t}") for t in times],
                                 "src_ip string, raw_message string, timestamp string")
    row = extract_features(logs.withColumn("timestamp", F.to_timestamp("timestamp"))).first()
    gaps = [0, 4, 20, 1]
    mean = sum(gaps) / 4
    assert row["fail_interarrival_mean"] == pytest.approx(mean)
    assert row["fail_interarrival_std"] == pytest.approx((sum((g - mean) ** 2 for g in gaps) / 4) ** 0.5)
    assert row["burst_rate"] == pytest.approx(3 / (5 / 2))  # buckets hold 3 and 2 lines


def test_no_rows_give_no_features(spark):
    empty = spark.createDataFrame([], "src_ip string, raw_message string, timestamp timestamp")
    assert extract_features(empty).count() == 0


def test_address_from_text(spark):
    logs = spark.createDataFrame([('10.0.0.99 - - [15/Jul/2026:22:00:00] "GET /test HTTP/1.1" 200 120',), ("none",)], "raw_log string")
    assert [r[0] for r in logs.select(source_ip(logs)).collect()] == ["10.0.0.99", "0.0.0.0"]


@pytest.mark.parametrize("score, severity, value, name", [
    (1.0, 15.0, 100, "Critical"), (0.0, 0.0, 0, "Low"), (0.5, 20.0, 70, "High"), (0.5, -5.0, 30, "Medium"),
    (0.5, 7.5, 49.0, "Medium"), (0.2, 3.0, 12.0, "Low"), (0.8, 12.0, 81.0, "Critical"), (0.2, 15.0, 45.0, "Medium"),
])
def test_risk(spark, score, severity, value, name):
    frame = spark.createDataFrame([(score, severity)], "s double, v double")
    made = risk.risk_score(F.col("s"), F.col("v"))
    row = frame.select(made.alias("r"), risk.risk_class(made).alias("c")).first()
    assert row["r"] == pytest.approx(value) and row["c"] == name


def test_risk_edges(spark):
    frame = spark.createDataFrame([(v,) for v in (25.0, 25.1, 50.0, 50.1, 80.0, 80.1, None, float("nan"))], "v double")
    assert [r[0] for r in frame.select(risk.risk_class(F.col("v"))).collect()] == [
        "Low", "Medium", "Medium", "High", "High", "Critical", "Low", "Low"]
    custom = frame.select(risk.risk_score(F.lit(0.9), F.lit(15.0), 0.7, 0.3).alias("a"), risk.risk_score(F.lit(0.1), F.lit(0.0), 0.7, 0.3).alias("b")).first()
    assert (custom["a"], custom["b"]) == (pytest.approx(93), pytest.approx(7))


SYSLOG = [
    ("Dec 10 06:55:46 LabSZ sshd[24200]: Failed password for invalid user bob from 1.2.3.4 port 22 ssh2", "failed_password", "bob", "1.2.3.4"),
    ("Dec 10 06:55:47 LabSZ sshd[24200]: Invalid user bob from 1.2.3.4", "invalid_user", "bob", "1.2.3.4"),
    ("Dec  1 06:55:48 LabSZ sshd[24201]: Accepted password for eve from 1.2.3.5 port 22 ssh2", "accepted", "eve", "1.2.3.5"),
    ("Jan  2 06:55:48 LabSZ sshd[24202]: reverse mapping ... [1.2.3.6] failed - POSSIBLE BREAK-IN ATTEMPT!", "other", None, "1.2.3.6"),
    ("Jan  2 06:55:49 LabSZ sshd[24202]: POSSIBLE BREAK-IN ATTEMPT from x [1.2.3.7]", "break_in_attempt", None, "1.2.3.7"),
    ("Jan  2 06:55:50 LabSZ sshd[24203]: Connection closed by 1.2.3.8 [preauth]", "other", None, "1.2.3.8"),
]


def test_syslog_lines(spark):
    frame = spark.createDataFrame([("f", i, line) for i, (line, *_) in enumerate(SYSLOG)], "source_file string, line_number long, line string")
    parsed = Y.parse_syslog(frame)
    rows = parsed.orderBy("line_number").collect()
    assert [(r["event_type"], r["username"], r["src_ip"]) for r in rows] == [tuple(s[1:]) for s in SYSLOG]
    flags = Y.event_flags(parsed).orderBy("line_number").collect()
    assert flags[3]["is_breakin"] and not flags[3]["is_fail"]
    dated = Y.infer_years(parsed).orderBy("line_number").collect()
    assert [r["event_year"] for r in dated] == [2017, 2017, 2017, 2018, 2018, 2018]


def test_metrics_example(spark):
    rows = list(zip([1, 1, -1, -1, 1, -1], [1, -1, -1, 1, 1, -1]))
    frame = spark.createDataFrame(rows, "y int, p int")
    row = M.basic_metrics(frame, "y", "p", (), "outlier", "outlier").first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (2, 1, 1, 2)
    assert row["accuracy"] == pytest.approx(4 / 6) and row["precision"] == pytest.approx(2 / 3)


def test_labels(spark):
    frame = spark.createDataFrame([(v,) for v in ("Benign", " ATTACK ", "-1", "suspicious", None, "nan")], "l string")
    got = [tuple(r) for r in frame.select(labels.binary_label(F.col("l")), labels.is_unknown(F.col("l"))).collect()]
    assert got == [(0, False), (1, False), (1, False), (-1, False), (-1, True), (-1, True)]


def test_legacy_names_and_missing_features(spark):
    old = spark.createDataFrame([(85.0, 15.0, 120.0, 0.9, "Anomaly")],
                                "login_fail_count double, burst_rate double, request_rate double, status_4xx_rate double, label string")
    made = feature_matrix(old, keep=["label"])
    assert made.columns == ["label", *S.FEATURES]
    row = made.first()
    assert (row["auth_fail_count"], row["http_req_rate"], row["http_4xx_ratio"], row["auth_success_count"]) == (85, 120, 0.9, 0)
    with pytest.raises(ValueError):
        features_and_target(old)
    with pytest.raises(ValueError):
        require_features(old)


JSON_CASES = ['{}', '{"a":1}', '[1,2]', '5', '"x"', 'null', 'abc', '{"a":1', '{"a":[1,}', '{"a":1} x', '{"a": 1}}', "{'a': 1}",
              '{"a":1}{"b":2}', "01", '{"it": "don\'t"}']


def test_json_lines(spark):
    def valid(line):
        try:
            json.loads(line)
            return True
        except ValueError:
            return False

    frame = spark.createDataFrame([(c,) for c in JSON_CASES], "value string")
    got = [r[0] for r in frame.select(alerts.is_json(F.col("value"))).collect()]
    assert got == [valid(c) for c in JSON_CASES]


def test_alert_fallbacks(spark):
    docs = [
        {"timestamp": "2024-01-01T00:00:00Z", "agent": {"ip": "10.1.1.1", "id": "007"}, "data": {"srcip": "any"}, "rule": {"level": 99, "id": "x"}},
        {"timestamp": "2024-01-01T00:00:00Z", "agent": {"ip": "127.0.0.1"}, "data": {"srcip": "nonsense"}, "full_log": "GET http"},
    ]
    frame = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    first, second = alerts.parse_alerts(frame).collect()
    assert (first["source_ip"], first["severity"], first["rule_id"], first["agent_id"]) == ("10.1.1.1", 16, None, "007")
    assert first["event_type"] == "auth" and first["raw_log"] == json.dumps({"srcip": "any"}).replace(" ", "")
    assert (second["source_ip"], second["event_type"], second["agent_id"]) == (None, "nginx", "000")
