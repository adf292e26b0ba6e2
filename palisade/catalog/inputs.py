"""Operator inputs derived from the given tables.

Every derivation is a list of SQL expressions that Spark and DuckDB read alike, so both sides of a
check start from the same rows.
"""

from pyspark.sql import DataFrame, SparkSession

from palisade.session import spread

# events -> log_event: login lines from 'error' and 'signup', access lines from the other types.
_EVENT_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k"
_EVENT_IP = (
    "concat('10.0.', CAST(CAST(floor(user_id / 256) AS INT) AS STRING), '.', "
    "CAST(CAST(user_id % 256 AS INT) AS STRING)) AS ip"
)
_STATUS = "CASE WHEN k % 10 < 6 THEN '200' WHEN k % 10 < 9 THEN '404' ELSE '500' END"
_AUTH = "event_type IN ('error', 'signup')"
_HEADER = (
    "concat('Jan ', lpad(CAST(day(ts) AS STRING), 2, ' '), ' ', substr(CAST(ts AS STRING), 12, 8), ' host', "
    "CAST(k % 3 AS STRING), ' sshd[', CAST(1000 + k AS STRING), ']: ')"
)
_MESSAGE = (
    "CASE WHEN event_type = 'error' THEN concat('Failed password for ', CASE WHEN k % 2 = 0 THEN 'invalid user ' "
    "ELSE '' END, 'u', CAST(k % 7 AS STRING), ' from ', ip, ' port 22 ssh2') "
    "ELSE concat('Accepted password for u', CAST(k % 7 AS STRING), ' from ', ip, ' port 22 ssh2') END"
)
_ACCESS = (
    "concat(ip, ' - - [x] \"', CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END, ' /p', "
    f"CAST(k % 10 AS STRING), ' HTTP/1.1\" ', {_STATUS}, ' ', CAST(CAST(floor(value * 10) AS BIGINT) AS STRING), "
    "' \"-\" \"UA', CAST(k % 5 AS STRING), '\"')"
)
_JSON = (
    f"CASE WHEN NOT ({_AUTH}) AND k % 3 = 0 THEN concat('{{\"status\": \"404\", \"user_agent\": \"JA', "
    "CAST(k % 4 AS STRING), '\", \"dstuser\": \"j', CAST(k % 2 AS STRING), '\"}') ELSE NULL END"
)
LOG_EVENT = [
    "CAST(event_id AS STRING) AS event_id",
    "ts AS timestamp",
    "ip AS source_ip",
    "concat('host', CAST(k % 3 AS STRING)) AS source_host",
    f"CASE WHEN {_AUTH} THEN concat('u', CAST(k % 7 AS STRING)) ELSE NULL END AS username",
    f"CASE WHEN {_AUTH} THEN 'auth' ELSE 'nginx' END AS event_type",
    "k % 17 AS severity",
    "CASE WHEN k % 11 = 0 THEN NULL ELSE 5700 + k % 20 END AS rule_id",
    f"CASE WHEN {_AUTH} THEN concat({_HEADER}, {_MESSAGE}) ELSE {_ACCESS} END AS raw_log",
    f"{_JSON} AS parsed_json",
    "concat('agent-', CAST(k % 4 AS STRING)) AS agent_id",
]

# lineitem -> flow table. Column names are those of the flow export without blanks.
FLOWS = [
    "l_shipdate AS flow_time",
    "concat('10.1.', CAST(CAST(floor(l_suppkey / 256) AS INT) AS STRING), '.', "
    "CAST(CAST(l_suppkey % 256 AS INT) AS STRING)) AS source_ip",
    "CAST(l_orderkey AS STRING) AS flow_id",
    "CAST(l_partkey % 1024 AS DOUBLE) AS destination_port",
    "CAST(l_quantity AS DOUBLE) AS total_fwd_packets",
    "CAST(l_linenumber AS DOUBLE) AS total_bwd_packets",
    "CAST(l_extendedprice AS DOUBLE) AS flow_bytes_s",
    "CAST(l_extendedprice / 100 AS DOUBLE) AS flow_packets_s",
    "CAST(round(l_discount * 100) AS DOUBLE) AS syn_flags",
    "CAST(round(l_tax * 100) AS DOUBLE) AS ack_flags",
    "CAST(l_linenumber % 3 AS DOUBLE) AS rst_flags",
    "CAST(l_partkey % 4 AS DOUBLE) AS psh_flags",
    "CAST(l_suppkey % 2 AS DOUBLE) AS ece_flags",
    "CAST(l_extendedprice - 1000 AS DOUBLE) AS packet_length_variance",
    "CAST(l_partkey % 50 AS DOUBLE) AS active_mean",
    "CAST(l_linenumber * 2 AS DOUBLE) AS subflow_fwd_packets",
    "CAST(l_quantity * 100000 AS DOUBLE) AS flow_iat_mean",
    "CAST(l_quantity * 250000 AS DOUBLE) AS flow_iat_std",
    "CAST(l_quantity * 10 AS DOUBLE) AS avg_bwd_segment_size",
    "CASE WHEN l_returnflag = 'R' THEN 'DoS' ELSE 'BENIGN' END AS flow_label",
    "CASE WHEN l_linestatus = 'O' THEN 'Monday-WorkingHours.csv' ELSE 'Tuesday-WorkingHours.csv' END AS source_file",
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]

# orders -> scored rows with labels (NULL for every fiftieth key) and two detectors.
SCORED = [
    "o_orderkey AS row_id",
    "CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Anomaly' ELSE 'Normal' END AS label",
    "CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score",
    "CAST(o_custkey % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS other_score",
    "CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 1000 >= 800 THEN 'Anomaly' "
    "WHEN CAST(floor(o_totalprice) AS BIGINT) % 1000 >= 760 THEN 'Uncertain' ELSE 'Normal' END AS prediction",
    "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'BENIGN' END AS attack_category",
    "o_orderdate AS timestamp",
    "concat('10.2.', CAST(CAST(floor(o_custkey / 256) AS INT) AS STRING), '.', "
    "CAST(CAST(o_custkey % 256 AS INT) AS STRING)) AS src_ip",
]

# orders -> risk_score
_RISK = "CAST(CAST(floor(o_totalprice) AS BIGINT) % 1001 AS DOUBLE) / CAST(10 AS DOUBLE)"
RISK = [
    "concat('r', CAST(o_orderkey AS STRING)) AS id",
    "concat('10.2.', CAST(CAST(floor(o_custkey / 256) AS INT) AS STRING), '.', "
    "CAST(CAST(o_custkey % 256 AS INT) AS STRING)) AS src_ip",
    "concat('agent-', CAST(o_custkey % 4 AS STRING)) AS asset_id",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('a', CAST(o_orderkey AS STRING)) END AS anomaly_result_id",
    f"{_RISK} * CAST(0.006 AS DOUBLE) AS ai_component",
    f"{_RISK} * CAST(0.004 AS DOUBLE) AS rule_component",
    f"{_RISK} AS score",
    f"CASE WHEN {_RISK} <= 25 THEN 'Low' WHEN {_RISK} <= 50 THEN 'Medium' WHEN {_RISK} <= 80 THEN 'High' "
    "ELSE 'Critical' END AS risk_class",
    "o_orderdate + make_interval_minutes AS timestamp",
]

# orders -> anomaly_result
RESULTS = [
    "concat('a', CAST(o_orderkey AS STRING)) AS id",
    "o_orderdate AS window_start",
    "concat('10.2.', CAST(CAST(floor(o_custkey / 256) AS INT) AS STRING), '.', "
    "CAST(CAST(o_custkey % 256 AS INT) AS STRING)) AS src_ip",
    "concat('e', CAST(o_orderkey AS STRING)) AS event_id",
    "concat('f', CAST(o_orderkey AS STRING)) AS feature_vector_id",
    "concat('{\"auth_fail_count\": ', CAST(o_orderkey % 9 AS STRING), ', \"burst_rate\": ', "
    "CAST(o_custkey % 5 AS STRING), '}') AS feature_snapshot",
    "CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS anomaly_score",
    "CASE WHEN o_custkey % 3 = 0 THEN 'cascade-v1.1' ELSE 'cascade-v1.0' END AS model_version",
    "CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 1000 >= 800 THEN 'Anomaly' ELSE 'Normal' END AS predicted_label",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Anomaly' ELSE 'Normal' END "
    "AS ground_truth_label",
    "CASE WHEN o_orderstatus = 'F' THEN 'analyst_confirmed' ELSE 'baseline_normal' END AS label_source",
]

# part -> evaluation_metrics: one row per run, configuration and split with repeated runs.
METRICS = [
    "concat('m', CAST(p_partkey AS STRING)) AS id",
    "concat('run_', CAST(CAST(floor(p_partkey / 24) AS INT) AS STRING)) AS run_id",
    "CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'wazuh_rule_only' WHEN 1 THEN 'iforest_only' "
    "WHEN 2 THEN 'ocsvm_only' ELSE 'cascade_iforest_ocsvm' END AS model_config",
    "'cascade-v1.0' AS model_version",
    "CASE CAST(floor(p_partkey / 4) AS INT) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END "
    "AS dataset_split",
    "CAST(p_partkey * 7 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS precision_score",
    "CAST(p_partkey * 13 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS recall_score",
    "CAST(p_partkey * 17 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS f1_score",
    "CAST(p_partkey * 3 % 50 AS DOUBLE) / CAST(1000 AS DOUBLE) AS false_positive_rate",
    "CAST(500 + p_partkey * 11 % 500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS roc_auc",
    "CAST(p_size AS DOUBLE) AS latency_ms_avg",
    "CAST(p_size * 2 AS DOUBLE) AS latency_ms_p95",
    "CAST(p_retailprice AS DOUBLE) AS throughput_events_per_sec",
    "CAST(p_partkey % 90 AS DOUBLE) AS cpu_usage_percent",
    "CAST(100 + p_partkey % 400 AS DOUBLE) AS ram_usage_mb",
    "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat('{\"size\":', CAST(p_size AS STRING), ',\"brand\":\"', "
    "p_brand, '\"}') END AS hyperparameters",
    "evaluated_at",
]

# events -> attack_scenarios: one per failure, lasting k minutes.
SCENARIOS = [
    "concat('s', CAST(event_id AS STRING)) AS id",
    "concat('scenario ', CAST(event_id AS STRING)) AS scenario_name",
    "CASE CAST(k % 8 AS INT) WHEN 0 THEN 'SSH-BruteForce' WHEN 1 THEN 'Web Attack' WHEN 2 THEN 'DDoS LOIT' "
    "WHEN 3 THEN 'DoS Hulk' WHEN 4 THEN 'PortScan' WHEN 5 THEN 'ddos' WHEN 6 THEN 'Bot' ELSE 'Web brute' END "
    "AS attack_type",
    "ts AS start_time",
    "end_time",
    "ip AS attacker_ip",
]

# orders -> feature vectors with labels of every kind.
VECTORS = [
    "concat('f', CAST(o_orderkey AS STRING)) AS id",
    "o_orderkey AS row_id",
    "o_orderdate AS window_start",
    "o_orderdate AS timestamp",
    "concat('10.2.', CAST(CAST(floor(o_custkey / 256) AS INT) AS STRING), '.', "
    "CAST(CAST(o_custkey % 256 AS INT) AS STRING)) AS src_ip",
    "concat('10.2.', CAST(CAST(floor(o_custkey / 256) AS INT) AS STRING), '.', "
    "CAST(CAST(o_custkey % 256 AS INT) AS STRING)) AS entity_id",
    "CAST(o_orderkey % 9 AS DOUBLE) AS auth_fail_count",
    "CAST(o_custkey % 7 AS DOUBLE) AS auth_success_count",
    "CAST(o_orderkey % 9 AS DOUBLE) / CAST(o_orderkey % 9 + o_custkey % 7 + 1 AS DOUBLE) AS auth_fail_ratio",
    "CAST(o_orderkey % 4 AS DOUBLE) AS distinct_username",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 60 AS DOUBLE) END AS fail_interarrival_mean",
    "CAST(o_custkey % 11 AS DOUBLE) AS fail_interarrival_std",
    "CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) / CAST(1000 AS DOUBLE) AS http_req_rate",
    "CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS http_4xx_ratio",
    "CAST(o_custkey % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS http_5xx_ratio",
    "CAST(o_orderkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS http_post_ratio",
    "CAST(o_custkey % 6 AS DOUBLE) AS distinct_user_agent",
    "CAST(CAST(floor(o_totalprice) AS BIGINT) % 5000 AS DOUBLE) AS bytes_sent_mean",
    "CAST(100 + o_orderkey % 50 AS DOUBLE) AS global_active_ips",
    "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(1 + o_custkey % 8 AS DOUBLE) END AS burst_rate",
    "CASE WHEN o_custkey % 5 = 0 THEN 'v1' ELSE 'v2' END AS feature_version",
    "o_orderdate AS computed_at",
    "CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'attack' WHEN 1 THEN 'Suspicious' WHEN 2 THEN ' BENIGN ' "
    "WHEN 3 THEN NULL WHEN 4 THEN 'unknown' WHEN 5 THEN '1' ELSE 'benign' END AS label",
    "o_orderpriority AS attack_category",
    "concat('file', CAST(o_custkey % 3 AS STRING), '.csv') AS source_file",
    "CASE WHEN o_orderstatus = 'F' THEN 'cicids2017' ELSE 'loghub' END AS dataset_source",
    "'original_flow_timestamp' AS timestamp_source",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'analyst_confirmed' ELSE 'baseline_normal' END AS label_source",
]

# events -> login log lines, two seconds apart, seven addresses, two files.
_LOGIN_T = [
    "event_id * 2 AS t", "concat('10.3.0.', CAST(user_id % 7 AS STRING)) AS from_ip",
    "concat('u', CAST(k % 7 AS STRING)) AS u",
]
_TWO = lambda e: f"lpad(CAST({e} AS STRING), 2, '0')"
LOGINS = [
    "concat('auth', CAST(user_id % 2 AS STRING), '.log') AS source_file",
    "event_id AS line_number",
    "concat('Dec ', CAST(10 + CAST(floor(t / 86400) AS INT) % 20 AS STRING), ' ', "
    + _TWO("CAST(floor(t / 3600) AS INT) % 24") + ", ':', " + _TWO("CAST(floor(t / 60) AS INT) % 60") + ", ':', "
    + _TWO("CAST(t % 60 AS INT)") + ", ' host', CAST(k % 3 AS STRING), ' sshd[', CAST(1000 + k AS STRING), ']: ', "
    "CASE WHEN event_type = 'error' THEN concat('Failed password for ', CASE WHEN k % 2 = 0 THEN 'invalid user ' "
    "ELSE '' END, u, ' from ', from_ip, ' port 22 ssh2') "
    "WHEN event_type = 'signup' THEN concat('Accepted password for ', u, ' from ', from_ip, ' port 22 ssh2') "
    "WHEN event_type = 'click' THEN concat('Invalid user ', u, ' from ', from_ip) "
    "WHEN event_type = 'purchase' AND k = 0 THEN concat('POSSIBLE BREAK-IN ATTEMPT from x [', from_ip, ']') "
    "ELSE concat('Connection closed by ', from_ip, ' [preauth]') END) AS line",
]

# orders -> login log lines over several years, for the years that the lines do not hold.
_MONTH = "CASE CAST(month(o_orderdate) AS INT) " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate(
        ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"], 1)) + " END"
YEARS = [
    "concat('auth', CAST(o_custkey % 3 AS STRING), '.log') AS source_file",
    "o_orderdate AS line_day", "o_orderkey AS line_number",
    f"concat({_MONTH}, ' ', lpad(CAST(day(o_orderdate) AS STRING), 2, ' '), ' ', "
    + _TWO("o_orderkey % 24") + ", ':', " + _TWO("o_orderkey % 60") + ", ':00 host sshd[77]: Failed password for root "
    "from 10.4.0.', CAST(o_custkey % 250 AS STRING), ' port 22 ssh2') AS line",
]

# events -> alerts as JSON lines, nested and incomplete in several ways; some lines are not JSON.
ALERTS = [
    "event_id", "CASE WHEN k % 23 = 0 THEN concat('broken ', CAST(event_id AS STRING)) ELSE "
    "concat('{\"timestamp\": \"', substr(CAST(ts AS STRING), 1, 19), '\", \"agent\": {\"id\": \"00', "
    "CAST(k % 4 AS STRING), '\", \"ip\": \"10.9.0.', CAST(k % 4 AS STRING), '\"', "
    "CASE WHEN k % 5 = 0 THEN '' ELSE concat(', \"name\": \"host', CAST(k % 3 AS STRING), '\"') END, '}', "
    "', \"rule\": {\"id\": \"', CASE WHEN k % 7 = 0 THEN 'x' ELSE CAST(5700 + k % 20 AS STRING) END, "
    "'\", \"level\": ', CAST(k % 21 - 2 AS STRING), '}, \"data\": {', "
    "CASE WHEN k % 6 = 0 THEN '\"srcip\": \"127.0.0.1\"' WHEN k % 6 = 1 THEN '\"srcip\": \"not-an-ip\"' "
    "WHEN k % 6 = 2 THEN concat('\"src_ip\": \"', ip, '\"') WHEN k % 6 = 3 THEN '\"dstip\": \"fe80:0:0:1\"' "
    "ELSE concat('\"srcip\": \"', ip, '\"') END, "
    "CASE WHEN event_type = 'error' THEN concat(', \"dstuser\": \"u', CAST(k % 7 AS STRING), '\"') ELSE '' END, '}', "
    "', \"location\": \"', CASE WHEN event_type = 'click' THEN '/var/log/nginx/access.log' ELSE '/var/log/auth.log' "
    "END, '\"', CASE WHEN event_type = 'view' THEN '' ELSE concat(', \"full_log\": \"event ', event_type, '\"') END, "
    "'}') END AS value",
]

_SPARK_TIME = {
    "orders": "o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT), 0) AS event_minute",
    "part": "make_timestamp_ntz(2024, 1, 1, 0, 0, 0) + make_dt_interval(0, 0, CAST(p_partkey * 5 AS INT), 0) "
            "AS evaluated_at",
    "events": "ts + make_dt_interval(0, 0, k, 0) AS end_time",
}
_DUCK_TIME = {
    "orders": "o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)) AS event_minute",
    "part": "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p_partkey * 5 AS INT)) AS evaluated_at",
    "events": "ts + to_minutes(k) AS end_time",
}
RISK[-1] = "event_minute AS timestamp"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT_TASK_BYTES = 4 << 20  # about 200,000 events; each gives up to six records with a sliding window


def _events(spark, sf_dir):
    base = spread(table(spark, sf_dir, "events"), EVENT_TASK_BYTES).selectExpr("*", _EVENT_K, _EVENT_IP)
    return base.selectExpr("*", _SPARK_TIME["events"])


def log_event(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*LOG_EVENT)


def flows(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem")).selectExpr(*FLOWS)


def scored(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*SCORED)


def risk(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("*", _SPARK_TIME["orders"]).selectExpr(*RISK)


def results(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*RESULTS)


def metrics(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("*", _SPARK_TIME["part"]).selectExpr(*METRICS)


def scenarios(spark, sf_dir) -> DataFrame:
    failures = _events(spark, sf_dir).where("event_type = 'error'")
    return failures.selectExpr(*SCENARIOS)


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*VECTORS)


def logins(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("*", *_LOGIN_T).selectExpr(*LOGINS)


def years(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*YEARS)


def alerts(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*ALERTS)


def event_stream(spark, sf_dir, columns=None) -> DataFrame:
    """The events table as a stream, with the same derivation as the batch table."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.selectExpr("*", _EVENT_K, _EVENT_IP).selectExpr(*(columns or LOG_EVENT))


def _select(columns, source):
    return "SELECT " + ", ".join(columns) + " FROM " + source


_EVENTS_SQL = f"(SELECT *, {_DUCK_TIME['events']} FROM (SELECT *, {_EVENT_K}, {_EVENT_IP} FROM events))"
SQL = {
    "log_event": _select(LOG_EVENT, _EVENTS_SQL),
    "flows": _select(FLOWS, "lineitem"),
    "scored": _select(SCORED, "orders"),
    "risk": _select(RISK, f"(SELECT *, {_DUCK_TIME['orders']} FROM orders)"),
    "results": _select(RESULTS, "orders"),
    "vectors": _select(VECTORS, "orders"),
    "logins": _select(LOGINS, f"(SELECT *, {', '.join(_LOGIN_T)} FROM {_EVENTS_SQL})"),
    "years": _select(YEARS, "orders"),
    "alerts": _select(ALERTS, _EVENTS_SQL),
    "metrics": _select(METRICS, f"(SELECT *, {_DUCK_TIME['part']} FROM part)"),
    "scenarios": _select(SCENARIOS, f"(SELECT * FROM {_EVENTS_SQL} WHERE event_type = 'error')"),
}


def with_inputs(sql: str, *names: str) -> str:
    """Prefix a statement with the input tables it reads."""
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"
