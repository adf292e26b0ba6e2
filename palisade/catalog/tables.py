"""Sources, sinks, scalar rules, risk, joins over the result tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

from palisade import schema as S
from palisade.catalog import inputs as I
from palisade.catalog.registry import query
from palisade.catalog.sqltext import PARSED, features, js, r, rounded, with_inputs
from palisade.functions import alerts as A, labels as L, risk as K
from palisade.operators import cleaning as C, dashboards as D, flows as W, joins as J
from palisade.operators.features import extract_features
from palisade.plans import serve as V
from palisade.session import scratch_path, write_text
from palisade.sinks import datasets as O, results as U, retention as N, upsert as M
from palisade.sinks.merge import MergeTable
from palisade.sources import files as R, tables as T

FEATURES_SQL = rounded(S.FEATURES)


def q_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


NORMAL, ANOMALY, UNKNOWN = q_in(S.NORMAL_ALIASES), q_in(S.ANOMALY_ALIASES), q_in(S.UNKNOWN_ALIASES)
FOLD = "lower(trim(label))"

# --- sources -------------------------------------------------------------------------------


@query("S01_feature_csv", with_inputs(f"SELECT id, src_ip, {FEATURES_SQL}, label FROM vectors", "vectors"))
def feature_csv(spark, sf_dir):
    path = scratch_path(spark, "features")
    table = I.vectors(spark, sf_dir).select("id", "src_ip", *S.FEATURES, "label")
    table.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return R.read_features(spark, path, table.schema)


@query("S02_read_table", with_inputs(
    f"SELECT id, window_start, src_ip, {r('anomaly_score', 'anomaly_score')}, predicted_label FROM results", "results"))
def read_table(spark, sf_dir):
    root = scratch_path(spark, "root")
    I.results(spark, sf_dir).write.parquet(f"{root}/anomaly_result")
    return T.read_table(spark, root, "anomaly_result").select("id", "window_start", "src_ip", "anomaly_score", "predicted_label")


@query("S03_train_test", with_inputs(f"""
SELECT CASE WHEN window_start < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS part, id, window_start, {FEATURES_SQL} FROM vectors""", "vectors"))
def train_test(spark, sf_dir):
    """Both files, row by row."""
    root = scratch_path(spark, "two")
    table = I.vectors(spark, sf_dir).select("id", "window_start", *S.FEATURES)
    early = F.col("window_start") < F.lit(datetime(1999, 1, 1))
    table.where(early).write.option("header", True).csv(f"{root}/train")
    table.where(~early).write.option("header", True).csv(f"{root}/test")
    train, test = R.read_train_test(spark, f"{root}/train", f"{root}/test", table.schema)
    return train.select(F.lit("train").alias("part"), "*").unionByName(test.select(F.lit("test").alias("part"), "*"))


@query("S04_features_between", with_inputs(f"""SELECT id, window_start, src_ip, {FEATURES_SQL} FROM vectors
WHERE window_start BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND feature_version = 'v2'""", "vectors"))
def features_between(spark, sf_dir):
    found = T.features_between(I.vectors(spark, sf_dir), datetime(1996, 1, 1), datetime(1997, 12, 31))
    return found.select("id", "window_start", "src_ip", *S.FEATURES)


@query("S05_labelled_features", with_inputs(f"""SELECT id, window_start, src_ip, {r('anomaly_score', 'anomaly_score')},
  {r("CAST(" + js('auth_fail_count', 'feature_snapshot') + " AS DOUBLE)", 'auth_fail_count')},
  {r("CAST(" + js('burst_rate', 'feature_snapshot') + " AS DOUBLE)", 'burst_rate')}, ground_truth_label AS label
FROM results WHERE model_version = 'cascade-v1.0'""", "results"))
def labelled_features(spark, sf_dir):
    opened = T.labelled_features(I.results(spark, sf_dir))
    return opened.select("id", "window_start", "src_ip", "anomaly_score", "auth_fail_count", "burst_rate", "label")


@query("S06_query_frame", with_inputs(f"""SELECT src_ip, count(*) AS n, {r('max(score)', 'top')} FROM risk
WHERE score >= 60 GROUP BY src_ip""", "risk"))
def query_frame(spark, sf_dir):
    return T.query_frame(spark, "SELECT src_ip, count(*) AS n, max(score) AS top FROM palisade_risk WHERE score >= :low "
                         "GROUP BY src_ip", None, {"low": 60.0}, palisade_risk=I.risk(spark, sf_dir))


@query("S07_newest_vectors", with_inputs(f"""SELECT id, window_start, src_ip, {FEATURES_SQL} FROM vectors
ORDER BY window_start DESC, src_ip, id LIMIT 100""", "vectors"))
def newest_vectors(spark, sf_dir):
    return T.newest_vectors(I.vectors(spark, sf_dir)).select("id", "window_start", "src_ip", *S.FEATURES)


@query("S08_newest_risk", with_inputs(f"""SELECT id, src_ip, {r('score', 'score')}, risk_class, timestamp FROM risk
ORDER BY timestamp DESC, id LIMIT 100""", "risk"))
def newest_risk(spark, sf_dir):
    return T.newest_risk(I.risk(spark, sf_dir)).select("id", "src_ip", "score", "risk_class", "timestamp")


@query("S09_features_from_csv", f"WITH {features('hour', 3600)} SELECT window_start, src_ip, {FEATURES_SQL} FROM features")
def features_from_csv(spark, sf_dir):
    path = scratch_path(spark, "logs")
    events = I.log_event(spark, sf_dir)
    events.write.option("header", True).option("escape", '"').csv(f"{path}/logs")
    read = spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).schema(
        events.schema).csv(f"{path}/logs")
    extract_features(read, window_seconds=3600).write.option("header", True).csv(f"{path}/features")
    made = R.read_features(spark, f"{path}/features")
    return made.select(F.to_timestamp("window_start").alias("window_start"), "src_ip",
                       *[F.col(f).cast("double").alias(f) for f in S.FEATURES])


@query("S10_range_or_newest", with_inputs("""
SELECT event_id, timestamp, source_ip FROM log_event ORDER BY timestamp DESC, event_id LIMIT 500""", "log_event"))
def range_or_newest(spark, sf_dir):
    found = T.range_or_newest(I.log_event(spark, sf_dir), datetime(2030, 1, 1), datetime(2030, 2, 1), 500)
    return found.select("event_id", "timestamp", "source_ip")


_HEADERS = {v: k for k, v in W.FLOW_HEADERS.items()}


def _flow_csv(spark, sf_dir):
    path = scratch_path(spark, "flows")
    flows = I.flows(spark, sf_dir)
    named = [F.col(c).alias(f" {_HEADERS[c]}") for c in flows.columns if c in _HEADERS]
    flows.select(F.col("flow_id").alias("Flow ID"), F.col("source_ip").alias(" Source IP"), *named,
                 F.col("flow_label").alias(" Label")).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).csv(path)
    return R.read_flows(spark, path)


@query("S11_flow_csv", with_inputs(f"""SELECT source_ip AS entity_id, {r('flow_bytes_s', 'flow_bytes_s')},
  {r('syn_flags', 'syn_flags')}, {r('total_fwd_packets', 'total_fwd_packets')}, flow_label FROM flows""", "flows"))
def flow_csv(spark, sf_dir):
    read = W.coerced(_flow_csv(spark, sf_dir))
    return read.select("entity_id", "flow_bytes_s", "syn_flags", "total_fwd_packets", "flow_label")


_NAMES = ("CASE CAST(l_suppkey % 6 AS INT) WHEN 0 THEN 'Monday-WorkingHours.pcap.csv' WHEN 1 THEN "
          "'Friday-WorkingHours-Afternoon-DDos.csv' WHEN 2 THEN 'Thursday-WorkingHours-Morning-Web.csv' WHEN 3 THEN "
          "'other.csv' WHEN 4 THEN 'Friday-WorkingHours-Morning.csv' ELSE 'wednesday.csv' END")


@query("S13_capture_rank", f"""SELECT name, count(*) AS rows, CASE WHEN name LIKE 'Monday%' THEN 0 WHEN name LIKE 'wednesday%' THEN 2
  WHEN name LIKE 'Thursday%' THEN 3 WHEN name LIKE 'Friday-WorkingHours-M%' THEN 6 WHEN name LIKE 'Friday%' THEN 8 ELSE 10 END
  AS rank FROM (SELECT {_NAMES} AS name FROM lineitem) GROUP BY 1""")
def capture_rank(spark, sf_dir):
    names = I.table(spark, sf_dir, "lineitem").selectExpr(f"{_NAMES} AS name")
    return names.groupBy("name", W.capture_rank(F.col("name")).alias("rank")).agg(F.count(F.lit(1)).alias("rows"))


@query("S12_discovered_files", f"""SELECT name AS file_name, CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END AS priority, CASE WHEN name LIKE 'Monday%' THEN 0
  WHEN name LIKE 'wednesday%' THEN 2 WHEN name LIKE 'Thursday%' THEN 3 WHEN name LIKE 'Friday-WorkingHours-M%' THEN 6 WHEN name LIKE 'Friday%' THEN 8 ELSE 10 END AS rank
FROM (SELECT {_NAMES} AS name, count(*) AS n FROM lineitem GROUP BY 1)""")
def discovered_files(spark, sf_dir):
    """Capture files by name in two folders and one that is not there; names with an even number of rows are in the first one, too."""
    root = scratch_path(spark, "captures")
    names = I.table(spark, sf_dir, "lineitem").selectExpr(f"{_NAMES} AS name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    for name, n in names.collect():  # one row per capture file
        for folder in (["first", "second"] if n % 2 == 0 else ["second"]):
            write_text(spark, f"rows\n{n}\n", f"{root}/{folder}/{name}")
    write_text(spark, "x", f"{root}/second/notes.txt")
    return R.discover_files(spark, [f"{root}/first", f"{root}/nowhere", f"{root}/second"]).select(
        "file_name", F.least("priority", F.lit(1)).alias("priority"), "rank")


@query("S14_log_lines", with_inputs("SELECT trim(line) AS line FROM logins", "logins"))
def log_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    I.logins(spark, sf_dir).select("line").write.text(path)
    return R.read_log_lines(spark, path).select("line")


@query("S14_line_numbers", with_inputs("SELECT count(*) AS lines, count(*) AS places FROM logins", "logins"))
def line_numbers(spark, sf_dir):
    """Every line of a file has a place of its own, also when the file is read in pieces."""
    path = scratch_path(spark, "lines")
    I.logins(spark, sf_dir).select("line").write.text(path)
    lines = R.read_log_lines(spark, path)
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("source_file", "line_number").alias("places"))


@query("S15_ingest_counts", with_inputs("""SELECT CAST(count(*) FILTER (json_valid(value)) AS BIGINT) AS accepted,
  CAST(count(*) FILTER (NOT json_valid(value)) AS BIGINT) AS rejected FROM alerts""", "alerts"))
def ingest_counts(spark, sf_dir):
    return R.ingest_counts(I.alerts(spark, sf_dir))


@query("S17_since_mark", with_inputs("""SELECT event_id, timestamp FROM log_event WHERE timestamp > TIMESTAMP '2024-01-10 00:00:00'
  AND timestamp <= TIMESTAMP '2024-01-12 00:00:00'""", "log_event"))
def since_mark(spark, sf_dir):
    found = T.since_mark(I.log_event(spark, sf_dir), datetime(2024, 1, 10), datetime(2024, 1, 12))
    return found.select("event_id", "timestamp")


@query("S17_first_run", with_inputs("""SELECT event_id, timestamp FROM log_event WHERE timestamp > TIMESTAMP '2024-01-11 23:00:00'
  AND timestamp <= TIMESTAMP '2024-01-12 00:00:00'""", "log_event"))
def first_run(spark, sf_dir):
    found = T.since_mark(I.log_event(spark, sf_dir), None, datetime(2024, 1, 12), 60)
    return found.select("event_id", "timestamp")


@query("S18_read_quarantine", with_inputs(f"""SELECT id, coalesce(label, 'missing') AS label FROM vectors
WHERE label IS NULL OR {FOLD} IN {UNKNOWN}""", "vectors"))
def read_quarantine(spark, sf_dir):
    folder = scratch_path(spark, "quarantine")
    O.quarantine(I.vectors(spark, sf_dir), folder)
    return T.read_quarantine(spark, folder).select("id", F.coalesce("label", F.lit("missing")).alias("label"))


@query("S20_tag_lines", with_inputs(
    "SELECT event_id, raw_log, 'web-1' AS hostname, 'lab' AS env, 'auth' AS agent_type FROM log_event", "log_event"))
def tag_lines(spark, sf_dir):
    return R.tag_lines(I.log_event(spark, sf_dir).select("event_id", "raw_log"), hostname="web-1", env="lab", agent_type="auth")


# --- sinks -----------------------------------------------------------------------------------

_COUNTS = """SELECT date_trunc('day', timestamp) AS window_start, source_ip AS src_ip, count(*) AS n FROM log_event GROUP BY 1, 2"""


def _through_table(spark, existing, incoming, keys, updated, order=()):
    """A stored base, a batch after it, and that batch once more."""
    stored = MergeTable(spark, scratch_path(spark, "merged"), keys, updated, order, buckets=8)
    stored.append(existing, 0)
    stored.compact()
    for _ in range(2):
        stored.append(incoming, 1)
    return stored.read()


@query("K01_upsert_vectors", with_inputs(f"""
SELECT window_start, src_ip, CASE WHEN window_start <= TIMESTAMP '2024-01-20' THEN 'old' ELSE 'new' END AS id,
  CAST(CASE WHEN window_start >= TIMESTAMP '2024-01-15' THEN n + 100 ELSE n END AS DOUBLE) AS auth_fail_count FROM ({_COUNTS})""", "log_event"))
def upsert_vectors(spark, sf_dir):
    """Days 1 to 20 are stored, days 15 to 30 arrive with other values."""
    day = F.date_trunc("day", "timestamp").alias("window_start")
    counts = I.log_event(spark, sf_dir).groupBy(day, F.col("source_ip").alias("src_ip")).agg(F.count(F.lit(1)).alias("n"))
    rows = lambda id_, extra: counts.select(
        F.lit(id_).alias("id"), "window_start", "src_ip", (F.col("n") + extra).cast("double").alias("auth_fail_count"),
        F.lit("v2").alias("feature_version"), F.lit(extra).alias("computed_at"))
    existing = rows("old", 0).where("window_start <= TIMESTAMP'2024-01-20'")
    incoming = rows("new", 100).where("window_start >= TIMESTAMP'2024-01-15'")
    order = ["window_start", "src_ip", "feature_version"]
    merged = _through_table(spark, existing, incoming, order, ["auth_fail_count", "computed_at"], ["computed_at"])
    return merged.select("id", "window_start", "src_ip", "auth_fail_count")


_BASE = """SELECT window_start, src_ip, model_version, min(id) AS id, min(event_id) AS event_id, min(feature_vector_id)
  AS feature_vector_id, min(feature_snapshot) AS feature_snapshot, max(anomaly_score) AS anomaly_score,
  min(predicted_label) AS predicted_label, min(ground_truth_label) AS ground_truth_label, min(label_source) AS label_source
  FROM results GROUP BY 1, 2, 3"""


@query("K02_upsert_results", with_inputs(f"""
SELECT window_start, src_ip, model_version, id, {r("CASE WHEN window_start >= TIMESTAMP '1998-01-01' THEN anomaly_score / 2 ELSE anomaly_score END", 'anomaly_score')},
  CASE WHEN window_start >= TIMESTAMP '1998-01-01' THEN 'Uncertain' ELSE predicted_label END AS predicted_label,
  CASE WHEN window_start >= TIMESTAMP '1998-01-01' THEN 'fv' ELSE feature_vector_id END AS feature_vector_id, ground_truth_label, label_source
FROM ({_BASE})""", "results"))
def upsert_results(spark, sf_dir):
    keys = ["window_start", "src_ip", "model_version"]
    rest = ["id", "event_id", "feature_vector_id", "feature_snapshot", "predicted_label", "ground_truth_label", "label_source"]
    base = I.results(spark, sf_dir).groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in rest], F.max("anomaly_score").alias("anomaly_score"))
    incoming = base.where(F.col("window_start") >= F.lit(datetime(1998, 1, 1))).withColumns({
        "id": F.lit("new"), "anomaly_score": F.col("anomaly_score") / 2, "predicted_label": F.lit("Uncertain"),
        "feature_vector_id": F.lit("fv"), "ground_truth_label": F.lit("changed"), "label_source": F.lit("changed")})
    merged = _through_table(spark, base, incoming, M.RESULT_KEYS, M.RESULT_UPDATED)
    return merged.select(*keys, "id", "anomaly_score", "predicted_label", "feature_vector_id", "ground_truth_label", "label_source")


@query("K03_upsert_risk", with_inputs(f"""
SELECT CASE WHEN anomaly_result_id IS NOT NULL AND timestamp < TIMESTAMP '1999-01-01' THEN id
            WHEN anomaly_result_id IS NULL AND half = 0 THEN id ELSE 'new' END AS id, coalesce(anomaly_result_id, 'none') AS anomaly_result_id,
  src_ip, {r('CASE WHEN half = 1 THEN score / 2 ELSE score END', 'score')}, risk_class
FROM (SELECT r.*, CASE WHEN timestamp >= TIMESTAMP '1997-01-01' AND anomaly_result_id IS NOT NULL THEN 1 ELSE part END AS half
      FROM risk r, (SELECT unnest([0, 1]) AS part) p
      WHERE (anomaly_result_id IS NOT NULL AND part = 0) OR (anomaly_result_id IS NULL AND (part = 0 AND timestamp < TIMESTAMP '1999-01-01'
             OR part = 1 AND timestamp >= TIMESTAMP '1997-01-01')))""", "risk"))
def upsert_risk(spark, sf_dir):
    """Rows without a result id never match, so both sides keep theirs."""
    risk = I.risk(spark, sf_dir)
    existing = risk.where(F.col("timestamp") < F.lit(datetime(1999, 1, 1)))
    incoming = risk.where(F.col("timestamp") >= F.lit(datetime(1997, 1, 1))).withColumns(
        {"id": F.lit("new"), "score": F.col("score") / 2})
    merged = _through_table(spark, existing, incoming, M.RISK_KEYS, M.RISK_UPDATED)
    return merged.select("id", F.coalesce("anomaly_result_id", F.lit("none")).alias("anomaly_result_id"), "src_ip", "score", "risk_class")


def _prob(column):
    return f"CASE WHEN isfinite({column}) THEN least(greatest({column}, 0), 1) END"


_RAW_METRICS = """SELECT *, CASE WHEN p_mod = 0 THEN 'cascade' WHEN p_mod = 1 THEN 'IFOREST' WHEN p_mod = 2 THEN 'rule_based'
  WHEN p_mod = 3 THEN 'mystery' ELSE model_config END AS raw_config,
  CASE WHEN p_mod = 0 THEN precision_score + 1 WHEN p_mod = 1 THEN CAST('NaN' AS DOUBLE) ELSE precision_score END AS raw_precision,
  CASE WHEN p_mod = 2 THEN CAST('Infinity' AS DOUBLE) ELSE latency_ms_avg END AS raw_latency
  FROM (SELECT *, CAST(latency_ms_avg AS INT) % 6 AS p_mod FROM {0})"""
_CONFIG = """CASE raw_config WHEN 'cascade' THEN 'cascade_iforest_ocsvm' WHEN 'IFOREST' THEN 'iforest_only' WHEN 'rule_based'
  THEN 'wazuh_rule_only' WHEN 'mystery' THEN 'cascade_iforest_ocsvm' ELSE raw_config END"""


def _raw_metrics(spark, sf_dir):
    frame = I.metrics(spark, sf_dir).withColumn("p_mod", F.col("latency_ms_avg").cast("int") % 6)
    config = (F.when(F.col("p_mod") == 0, "cascade").when(F.col("p_mod") == 1, "IFOREST").when(F.col("p_mod") == 2, "rule_based")
              .when(F.col("p_mod") == 3, "mystery").otherwise(F.col("model_config")))
    precision = (F.when(F.col("p_mod") == 0, F.col("precision_score") + 1).when(F.col("p_mod") == 1, F.lit(float("nan")))
                 .otherwise(F.col("precision_score")))
    return frame.withColumns({
        "model_config": config, "precision_score": precision,
        "latency_ms_avg": F.when(F.col("p_mod") == 2, F.lit(float("inf"))).otherwise(F.col("latency_ms_avg")),
    })


@query("K04_evaluation_rows", with_inputs(f"""
SELECT sha256(concat_ws('|', run_id, {_CONFIG}, dataset_split)) AS id, run_id, {_CONFIG} AS model_config, dataset_split,
  {r(_prob('raw_precision'), 'precision_score')}, {r(_prob('recall_score'), 'recall_score')}, {r(_prob('f1_score'), 'f1_score')},
  {r("CASE WHEN isfinite(raw_latency) THEN raw_latency END", 'latency_ms_avg')}, coalesce(hyperparameters, '{{}}') AS hyperparameters
FROM ({_RAW_METRICS.format('metrics')})""", "metrics"))
def evaluation_rows(spark, sf_dir):
    rows = U.evaluation_rows(_raw_metrics(spark, sf_dir), datetime(2024, 1, 1))
    return rows.select("id", "run_id", "model_config", "dataset_split", "precision_score", "recall_score", "f1_score",
                       "latency_ms_avg", "hyperparameters")


@query("K04_upsert_metrics", with_inputs(f"""
SELECT run_id, model_config, dataset_split, max(n) AS n, {r('max_by(f1_score, evaluated_at)', 'f1_score')},
  min_by(id, evaluated_at) AS id FROM (SELECT *, count(*) OVER (PARTITION BY run_id, model_config, dataset_split) AS n
  FROM (SELECT * REPLACE (concat('run_', CAST(CAST(substr(run_id, 5) AS INT) // 4 AS VARCHAR)) AS run_id) FROM metrics)) GROUP BY 1, 2, 3""", "metrics"))
def upsert_metrics(spark, sf_dir):
    """Repeated runs of a configuration and split: the last one counts, the first id stays."""
    run = F.concat(F.lit("run_"), F.floor(F.substring("run_id", 5, 9).cast("int") / 4).cast("string"))
    rows = I.metrics(spark, sf_dir).withColumn("run_id", run)
    keys = ["run_id", "model_config", "dataset_split"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    merged = M.merged_rows(None, rows, keys, [c for c in rows.columns if c not in ("id", *keys)], ["evaluated_at"])
    return merged.join(counts, keys).select(*keys, "n", "f1_score", "id")


_MODEL_NAME = "CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'IForest v2' WHEN 1 THEN 'OCSVM rbf' WHEN 2 THEN 'Cascade iforest+ocsvm' " \
              "WHEN 3 THEN 'Rule engine' ELSE 'other model' END"


@query("K05_comparison_rows", f"""
SELECT run_id, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'iforest_only' WHEN 1 THEN 'ocsvm_only' WHEN 3 THEN 'wazuh_rule_only'
  ELSE 'cascade_iforest_ocsvm' END AS model_config, {_MODEL_NAME} AS model_version, 'CICIDS2017' AS dataset_split,
  {r('p_size / 50.0', 'precision_score')} FROM (SELECT *, concat('b', CAST(p_partkey AS VARCHAR)) AS run_id FROM part)""")
def comparison_rows(spark, sf_dir):
    bench = I.table(spark, sf_dir, "part").selectExpr(
        "concat('b', CAST(p_partkey AS STRING)) AS run_id", f"{_MODEL_NAME} AS model_name", "p_size / 50.0D AS precision",
        "p_size / 100.0D AS accuracy")
    rows = U.comparison_rows(bench, evaluated_at=datetime(2024, 1, 1))
    return rows.select("run_id", "model_config", "model_version", "dataset_split", "precision_score")


@query("K07_append", with_inputs("SELECT count(*) * 2 AS rows, count(DISTINCT id) AS ids FROM results", "results"))
def append_rows(spark, sf_dir):
    path = scratch_path(spark, "append")
    M.append(I.results(spark, sf_dir), path)
    M.append(I.results(spark, sf_dir), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


_ATTACK = """CASE attack_type WHEN 'SSH-BruteForce' THEN 'ssh_bruteforce' WHEN 'Web Attack' THEN 'web_bruteforce' WHEN 'DDoS LOIT' THEN 'ddos'
  WHEN 'DoS Hulk' THEN 'dos' WHEN 'PortScan' THEN 'portscan' WHEN 'ddos' THEN 'ddos' WHEN 'Bot' THEN 'other' ELSE 'ssh_bruteforce' END"""


@query("K08_scenario_rows", with_inputs(
    f"SELECT scenario_name, {_ATTACK} AS attack_type, start_time, end_time, attacker_ip FROM scenarios", "scenarios"))
def scenario_rows(spark, sf_dir):
    return U.scenario_rows(I.scenarios(spark, sf_dir)).drop("id")


def _predictions(spark, sf_dir):
    frame = I.scored(spark, sf_dir)
    risk = K.risk_score(F.col("score"), F.col("row_id") % 16)
    return frame.select(
        F.col("timestamp").alias("window_start"), "src_ip", "label", F.col("prediction").alias("predicted_label"),
        (F.col("score") * 1.2).alias("anomaly_score"), F.col("score").alias("auth_fail_count"),
        (F.col("row_id") % 16).cast("double").alias("severity_weight"), risk.alias("risk_score"),
        F.lower(K.risk_class(risk)).alias("risk_class"), F.col("row_id").cast("string").alias("event_id"),
    )


_SEV = "CAST(row_id % 16 AS DOUBLE)"


def calibrated(x):
    return (f"CASE WHEN {x} <= 3 THEN 0 WHEN {x} <= 6 THEN ({x} - 3) * 0.1 WHEN {x} <= 9 THEN 0.3 + ({x} - 6) * (0.35 / 3) "
            f"ELSE least(1, 0.65 + least({x} - 9, 6) * (0.35 / 6)) END")


def risk_sql(score, severity):
    raw = f"(100 * (0.6 * {score} + 0.4 * ({calibrated(severity)})))"
    return f"greatest(least(CASE WHEN {score} < 0.25 THEN least({raw}, 45) ELSE {raw} END, 100), 0)"


def class_sql(risk):
    return f"CASE WHEN {risk} <= 25 THEN 'Low' WHEN {risk} <= 50 THEN 'Medium' WHEN {risk} <= 80 THEN 'High' ELSE 'Critical' END"


@query("K09_result_rows", with_inputs(f"""
SELECT event_id, window_start, src_ip, {r('least(score * 1.2, 1)', 'anomaly_score')}, prediction AS predicted_label, label AS ground_truth_label,
  (prediction = 'Uncertain') AS review FROM (SELECT *, CAST(row_id AS VARCHAR) AS event_id, timestamp AS window_start FROM scored)""", "scored"))
def result_rows(spark, sf_dir):
    results, _ = U.prediction_rows(_predictions(spark, sf_dir))
    review = F.coalesce(F.get_json_object("feature_snapshot", "$._review_required") == "true", F.lit(False))
    return results.select("event_id", "window_start", "src_ip", "anomaly_score", "predicted_label", "ground_truth_label",
                          review.alias("review"))


@query("K09_risk_rows", with_inputs(f"""
SELECT src_ip, timestamp, {r('0.6 * least(score * 1.2, 1)', 'ai_component')}, {r(f'0.4 * ({calibrated(_SEV)})', 'rule_component')},
  {r(risk_sql('score', _SEV), 'score')}, {class_sql(risk_sql('score', _SEV))} AS risk_class FROM scored WHERE prediction <> 'Uncertain'""", "scored"))
def risk_rows(spark, sf_dir):
    _, risks = U.prediction_rows(_predictions(spark, sf_dir))
    return risks.select("src_ip", "timestamp", "ai_component", "rule_component", "score", "risk_class")


@query("K10_metric_names", with_inputs(f"""
SELECT run_id, {r('precision_score', 'precision_score')}, {r('recall_score', 'recall_score')}, {r('f1_score', 'f1_score')},
  {r('false_positive_rate', 'false_positive_rate')}, {r('latency_ms_avg', 'latency_ms_avg')},
  {r('throughput_events_per_sec', 'throughput_events_per_sec')} FROM metrics""", "metrics"))
def metric_names(spark, sf_dir):
    """Short metric names are understood as well."""
    short = I.metrics(spark, sf_dir).select(
        "run_id", "model_config", "dataset_split", F.col("precision_score").alias("precision"), F.col("recall_score").alias("recall"),
        F.col("f1_score").alias("f1"), F.col("false_positive_rate").alias("fpr"), F.col("latency_ms_avg").alias("latency_mean_ms"),
        F.col("throughput_events_per_sec").alias("throughput"))
    rows = U.evaluation_rows(short, datetime(2024, 1, 1))
    return rows.select("run_id", "precision_score", "recall_score", "f1_score", "false_positive_rate", "latency_ms_avg",
                       "throughput_events_per_sec")


@query("K12_quarantine_audit", with_inputs(f"""
SELECT count(*) AS total_input_samples, count(*) - u AS labeled_samples_count, u AS unknown_samples_count,
  {r('round(CAST(u AS DOUBLE) / count(*) * 100, 4)', 'unknown_ratio_percent')} FROM vectors,
  (SELECT count(*) AS u FROM vectors WHERE label IS NULL OR {FOLD} IN {UNKNOWN}) GROUP BY u""", "vectors"))
def quarantine_audit(spark, sf_dir):
    folder = scratch_path(spark, "audit")
    O.quarantine(I.vectors(spark, sf_dir), folder)
    return T.read_audit(spark, folder).select("total_input_samples", "labeled_samples_count", "unknown_samples_count", "unknown_ratio_percent")


@query("K13_rejected_rows", with_inputs(f"""
SELECT CASE WHEN severity > 12 OR source_ip LIKE '%7' THEN 'dead_letter' ELSE 'log_event' END AS target, count(*) AS rows
FROM log_event GROUP BY 1""", "log_event"))
def rejected_rows(spark, sf_dir):
    """Rows that break a constraint go to the dead letters, the rest is kept."""
    events = I.log_event(spark, sf_dir).withColumns({
        "severity": F.when(F.col("severity") > 12, F.col("severity") + 10).otherwise(F.col("severity")),
        "event_type": F.when(F.col("source_ip").endswith("7"), "ftp").otherwise(F.col("event_type"))})
    good, dead = O.split_rejected(events, A.is_storable())
    tagged = good.select(F.lit("log_event").alias("target")).unionByName(dead.select(F.lit("dead_letter").alias("target")))
    return tagged.groupBy("target").agg(F.count(F.lit(1)).alias("rows"))


@query("K14_catalog_rows", with_inputs(f"""
SELECT concat('export_', id) AS run_id, id AS model_version, 'cicids2017' AS dataset_split, {r('precision_score', 'precision_score')},
  {r('f1_score', 'f1_score')}, 0.5 + 0.0 AS roc_auc FROM metrics""", "metrics"))
def catalog_rows(spark, sf_dir):
    catalog = I.metrics(spark, sf_dir).select(
        F.col("id").alias("version"), F.to_json(F.struct(F.col("precision_score").alias("precision"), "f1_score")).alias("metrics"),
        F.coalesce("hyperparameters", F.lit("{}")).alias("hyperparameters"))
    rows = U.catalog_rows(catalog, datetime(2024, 1, 1))
    return rows.select("run_id", "model_version", "dataset_split", "precision_score", "f1_score", "roc_auc")


@query("K16_daily_chunks", with_inputs("""SELECT date_trunc('day', timestamp) AS chunk_start, count(*) AS rows, min(timestamp) AS first,
  max(timestamp) AS last FROM log_event GROUP BY 1""", "log_event"))
def daily_chunks(spark, sf_dir):
    return N.chunk_days(I.log_event(spark, sf_dir), "timestamp")


@query("K16_retained", with_inputs("""SELECT event_id FROM log_event WHERE CAST(timestamp AS DATE) >= DATE '2024-01-16'""", "log_event"))
def retained(spark, sf_dir):
    return N.retained(I.log_event(spark, sf_dir), "timestamp", 15, date(2024, 1, 31)).select("event_id")


@query("K16_partitioned_write", with_inputs("""SELECT CAST(timestamp AS DATE) AS event_date, count(*) AS rows FROM log_event
WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-07 18:00:00' GROUP BY 1""", "log_event"))
def partitioned_write(spark, sf_dir):
    """A day-partitioned table read with the pruning range filter."""
    path = scratch_path(spark, "daily")
    I.log_event(spark, sf_dir).withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(path)
    part = N.daily_slice(spark.read.parquet(path), datetime(2024, 1, 5, 6), datetime(2024, 1, 7, 18))
    return part.groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"))


# --- projections and scalar rules ----------------------------------------------------------------

@query("F01_current_names", with_inputs(f"""SELECT id, {r('auth_fail_count', 'auth_fail_count')}, {r('http_req_rate', 'http_req_rate')},
  {r('auth_fail_ratio', 'auth_fail_ratio')}, {r('burst_rate', 'burst_rate')} FROM vectors""", "vectors"))
def current_names(spark, sf_dir):
    old = I.vectors(spark, sf_dir).selectExpr("id", "auth_fail_count AS login_fail_count", "http_req_rate AS request_rate",
                                              "auth_fail_ratio AS fail_success_ratio", "burst_rate")
    return C.with_current_names(old).select("id", "auth_fail_count", "http_req_rate", "auth_fail_ratio", "burst_rate")


@query("F02_feature_matrix", with_inputs(f"""SELECT id, 0.0 AS distinct_username, {r("CASE WHEN row_id % 9 = 0 THEN NULL ELSE bytes_sent_mean END", 'bytes_sent_mean')},
  {r('burst_rate', 'burst_rate')} FROM vectors""", "vectors"))
def feature_matrix(spark, sf_dir):
    broken = I.vectors(spark, sf_dir).drop("distinct_username").withColumn(
        "bytes_sent_mean", F.when(F.col("row_id") % 9 == 0, F.lit(float("inf"))).otherwise(F.col("bytes_sent_mean")))
    return C.feature_matrix(broken, keep=["id"]).select("id", "distinct_username", "bytes_sent_mean", "burst_rate")


@query("F03_sanitized", with_inputs(f"""SELECT id, {r('coalesce(burst_rate, 0)', 'burst_rate')}, {r('coalesce(fail_interarrival_mean, 0)', 'fail_interarrival_mean')},
  'Normal' AS label, 'BENIGN' AS attack_category FROM vectors""", "vectors"))
def sanitized(spark, sf_dir):
    bare = I.vectors(spark, sf_dir).drop("label", "attack_category")
    return C.sanitized(bare).select("id", "burst_rate", "fail_interarrival_mean", "label", "attack_category")


@query("F04_narrow_types", with_inputs(f"SELECT id, {r('CAST(http_req_rate AS FLOAT)', 'http_req_rate', 3)} FROM vectors", "vectors"), digits=3)
def narrow_types(spark, sf_dir):
    return C.narrow_types(I.vectors(spark, sf_dir)).select("id", "http_req_rate")


@query("F05_features_and_target", with_inputs(f"SELECT {FEATURES_SQL}, coalesce(label, 'missing') AS label FROM vectors", "vectors"))
def features_and_target(spark, sf_dir):
    return C.features_and_target(I.vectors(spark, sf_dir)).fillna("missing", ["label"])


_CANON = f"CASE WHEN {FOLD} IN {NORMAL} THEN 'Normal' WHEN {FOLD} IN {ANOMALY} THEN 'Anomaly' ELSE label END"


@query("F06_canonical_label", with_inputs(f"SELECT id, coalesce({_CANON}, 'missing') AS label FROM vectors", "vectors"))
def canonical_label(spark, sf_dir):
    return C.with_canonical_labels(I.vectors(spark, sf_dir)).select("id", F.coalesce("label", F.lit("missing")).alias("label"))


@query("F07_binary_label", with_inputs(f"""
SELECT id, CASE WHEN {FOLD} IN {NORMAL} THEN 0 WHEN {FOLD} IN {ANOMALY} THEN 1 ELSE -1 END AS y_text,
  CASE WHEN row_id % 3 = 1 THEN 1 WHEN row_id % 3 = 0 THEN 0 ELSE -1 END AS y_binary,
  CASE WHEN row_id % 2 = 0 THEN 1 ELSE 0 END AS y_outlier FROM vectors""", "vectors"))
def binary_label(spark, sf_dir):
    frame = I.vectors(spark, sf_dir)
    outlier = F.when(F.col("row_id") % 2 == 0, -1).otherwise(1)
    return frame.select(
        "id", L.binary_label(F.col("label")).alias("y_text"), L.binary_label(F.col("row_id") % 3, "binary").alias("y_binary"),
        L.binary_label(outlier, "outlier").alias("y_outlier"))


@query("F08_inlier_label", with_inputs(f"""
SELECT id, CASE WHEN {FOLD} IN {NORMAL} THEN 1.0 WHEN {FOLD} IN {ANOMALY} THEN -1.0 ELSE 0.0 END AS y FROM vectors""", "vectors"))
def inlier_label(spark, sf_dir):
    return I.vectors(spark, sf_dir).select("id", F.coalesce(L.inlier_label(F.col("label")), F.lit(0.0)).alias("y"))


@query("F09_labelled_rows", with_inputs(f"SELECT id, label FROM vectors WHERE label IS NOT NULL AND {FOLD} NOT IN {UNKNOWN}", "vectors"))
def labelled_rows(spark, sf_dir):
    return C.labelled_rows(I.vectors(spark, sf_dir)).select("id", "label")


@query("U02_unknown_rows", with_inputs(f"SELECT id FROM vectors WHERE label IS NULL OR {FOLD} IN {UNKNOWN}", "vectors"))
def unknown_rows(spark, sf_dir):
    return C.unknown_rows(I.vectors(spark, sf_dir)).select("id")


@query("F10_benign_rows", with_inputs(f"SELECT id FROM vectors WHERE {FOLD} IN {NORMAL}", "vectors"))
def benign_rows(spark, sf_dir):
    return C.benign_rows(I.vectors(spark, sf_dir)).select("id")


@query("F11_flow_label", with_inputs("""SELECT flow_id, l_linenumber, l_partkey, l_suppkey, CASE WHEN x IS NULL OR x = ' benign ' THEN 'Normal' ELSE 'Anomaly' END AS label,
  trim(coalesce(x, 'BENIGN')) AS attack_category FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_returnflag = 'R' THEN 'DoS'
  ELSE ' benign ' END AS x FROM flows)""", "flows"))
def flow_label(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") == 1, None).when(F.col("l_returnflag") == "R", "DoS").otherwise(" benign ")
    return I.flows(spark, sf_dir).select("flow_id", "l_linenumber", "l_partkey", "l_suppkey", L.flow_label(raw).alias("label"),
                                         L.flow_category(raw).alias("attack_category"))


_PACKETS = "greatest(total_fwd_packets + total_bwd_packets, 1)"


def clip_sql(x, low, high):
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, {high}), {low}) END"


FLOW_MAP = {
    "auth_fail_count": clip_sql("syn_flags", 0, 1000), "auth_success_count": clip_sql("ack_flags", 0, 50000),
    "auth_fail_ratio": "CASE WHEN syn_flags + ack_flags > 0 THEN syn_flags / greatest(syn_flags + ack_flags, 1) ELSE 0 END",
    "distinct_username": clip_sql("subflow_fwd_packets", 0, 1000),
    "fail_interarrival_mean": clip_sql("flow_iat_mean / 1e6", 0, 3600), "fail_interarrival_std": clip_sql("flow_iat_std / 1e6", 0, 3600),
    "http_req_rate": clip_sql("flow_packets_s", 0, 50000), "http_4xx_ratio": clip_sql(f"rst_flags / {_PACKETS}", 0, 1),
    "http_5xx_ratio": clip_sql(f"ece_flags / {_PACKETS}", 0, 1), "http_post_ratio": clip_sql(f"psh_flags / {_PACKETS}", 0, 1),
    "distinct_user_agent": clip_sql("ln(1 + abs(packet_length_variance))", 0, 50),
    "bytes_sent_mean": clip_sql("avg_bwd_segment_size", 0, 100000),
    "burst_rate": clip_sql("flow_bytes_s / (active_mean + 1)", 0, 10000),
}


@query("F12_flow_features", with_inputs(f"SELECT flow_id, l_linenumber, l_partkey, l_suppkey, {', '.join(r(e, n, 8) for n, e in FLOW_MAP.items())} FROM flows", "flows"), digits=8)
def flow_features(spark, sf_dir):
    flows = I.flows(spark, sf_dir)
    return flows.select("flow_id", "l_linenumber", "l_partkey", "l_suppkey",
                        *[c.alias(n) for n, c in W.flow_feature_columns(flows).items()])


@query("F13_entity_id", with_inputs("SELECT source_ip AS entity_id, count(*) AS rows FROM flows GROUP BY 1", "flows"))
def entity_id(spark, sf_dir):
    raw = I.flows(spark, sf_dir).select(F.col("flow_id").alias("Flow ID"), F.col("source_ip").alias(" Source IP"),
                                        F.col("flow_label").alias("Label"))
    return W.standard_columns(raw).groupBy("entity_id").agg(F.count(F.lit(1)).alias("rows"))


_SCORE_ROWS = "(SELECT *, CAST(row_id % 20 - 2 AS DOUBLE) AS severity FROM scored)"


def _score_rows(spark, sf_dir):
    return I.scored(spark, sf_dir).withColumn("severity", (F.col("row_id") % 20 - 2).cast("double"))


@query("F14_calibrated_severity", with_inputs(f"SELECT row_id, {r(calibrated('severity'), 'calibrated')} FROM {_SCORE_ROWS}", "scored"))
def calibrated_severity(spark, sf_dir):
    return _score_rows(spark, sf_dir).select("row_id", K.calibrated_severity(F.col("severity")).alias("calibrated"))


@query("F15_risk_score", with_inputs(f"SELECT row_id, {r(risk_sql('score', 'severity'), 'risk_score')} FROM {_SCORE_ROWS}", "scored"))
def risk_score(spark, sf_dir):
    return _score_rows(spark, sf_dir).select("row_id", K.risk_score(F.col("score"), F.col("severity")).alias("risk_score"))


@query("F16_risk_components", with_inputs(f"""SELECT row_id, {r(risk_sql('score', 'severity'), 'risk_score')}, {r('0.6 * score', 'ai_component')},
  {r(f"0.4 * ({calibrated('severity')})", 'rule_component')} FROM {_SCORE_ROWS}""", "scored"))
def risk_components(spark, sf_dir):
    score, severity = F.col("score"), F.col("severity")
    return _score_rows(spark, sf_dir).select(
        "row_id", K.risk_score(score, severity).alias("risk_score"), K.ai_component(score).alias("ai_component"),
        K.rule_component(severity).alias("rule_component"))


@query("F17_risk_class", with_inputs(f"""SELECT row_id, {class_sql('score * 100')} AS risk_class, CASE WHEN score * 100 <= 20 THEN 'Low'
  WHEN score * 100 <= 60 THEN 'Medium' WHEN score * 100 <= 85 THEN 'High' ELSE 'Critical' END AS custom_class FROM scored""", "scored"))
def risk_class(spark, sf_dir):
    value = F.col("score") * 100
    return I.scored(spark, sf_dir).select("row_id", K.risk_class(value).alias("risk_class"),
                                          K.risk_class(value, 20, 60, 85).alias("custom_class"))


@query("F19_decision_label", with_inputs(f"""SELECT row_id, CASE WHEN score >= 0.8 THEN 'Anomaly' WHEN score < 0.74 THEN 'Normal' ELSE 'Uncertain' END
  AS predicted_label, CASE WHEN score >= 0.74 AND score < 0.8 THEN 'UNCERTAIN' ELSE 'CONFIDENT' END AS prediction_status,
  {r('abs(score - 0.8)', 'confidence_margin')} FROM scored""", "scored"))
def decision_label(spark, sf_dir):
    label = K.decision_label(F.col("score"), 0.74, 0.8)
    return I.scored(spark, sf_dir).select("row_id", label.alias("predicted_label"), K.decision_status(label).alias("prediction_status"),
                                          F.abs(F.col("score") - 0.8).alias("confidence_margin"))


@query("F20_review_gating", with_inputs(f"""SELECT row_id, prediction AS predicted_label, (prediction = 'Uncertain') AS review_required,
  {r("CASE WHEN prediction <> 'Uncertain' THEN score * 100 END", 'risk_score')} FROM scored""", "scored"))
def review_gating(spark, sf_dir):
    frame = I.scored(spark, sf_dir).select("row_id", F.col("prediction").alias("predicted_label"), (F.col("score") * 100).alias("risk_score"))
    return U.review_gated(frame).drop("uncertainty_reason")


@query("F21_feature_snapshot", with_inputs(f"""SELECT id, {r('auth_fail_count', 'auth_fail_count')}, {r('burst_rate', 'burst_rate')},
  CASE WHEN row_id % 4 = 0 THEN 'true' ELSE 'none' END AS review FROM vectors""", "vectors"))
def feature_snapshot(spark, sf_dir):
    frame = I.vectors(spark, sf_dir)
    packed = frame.select("id", U.feature_snapshot(frame, review=F.col("row_id") % 4 == 0).alias("doc"))
    number = lambda n: F.get_json_object("doc", f"$.{n}").cast("double").alias(n)
    return packed.select("id", number("auth_fail_count"), number("burst_rate"),
                         F.coalesce(F.get_json_object("doc", "$._review_required"), F.lit("none")).alias("review"))


@query("F23_risk_decay", with_inputs(f"""
SELECT src_ip, asset_id, {r('round(greatest(15, score * 0.5), 1)', 'score')}, {r('0.6 * greatest(15, score * 0.5)', 'ai_component')},
  {r('0.4 * (greatest(15, score * 0.5) / 100 * 15)', 'rule_component')}, {class_sql('greatest(15, score * 0.5)')} AS risk_class
FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY timestamp DESC, id DESC) AS n FROM risk) WHERE n = 1""", "risk"))
def risk_decay(spark, sf_dir):
    decayed = V.decayed_risk(I.risk(spark, sf_dir), datetime(2024, 1, 1))
    return V.decay_to_store(decayed).select("src_ip", "asset_id", "score", "ai_component", "rule_component", "risk_class")


@query("F24_range_filter", with_inputs("""SELECT id, src_ip, risk_class FROM risk WHERE timestamp BETWEEN TIMESTAMP '1996-01-01' AND
TIMESTAMP '1996-12-31' AND risk_class IN ('High', 'Critical')""", "risk"))
def range_filter(spark, sf_dir):
    inside = D.in_range(I.risk(spark, sf_dir), "timestamp", datetime(1996, 1, 1), datetime(1996, 12, 31))
    return D.selected(inside, risk_class=["High", "Critical"], src_ip=None).select("id", "src_ip", "risk_class")


@query("F25_durations", with_inputs(f"""SELECT scenario_name, attack_type, attacker_ip, start_time, end_time,
  {r('(epoch_us(end_time) - epoch_us(start_time)) / 1000000.0', 'duration_seconds')} FROM scenarios""", "scenarios"))
def durations(spark, sf_dir):
    return D.scenario_durations(I.scenarios(spark, sf_dir))


# --- joins ---------------------------------------------------------------------------------------------

@query("A26_max_severity", with_inputs(f"""
SELECT date_trunc('day', timestamp) AS window_start, source_ip AS src_ip, max(severity) AS max_severity FROM log_event GROUP BY 1, 2""", "log_event"))
def max_severity(spark, sf_dir):
    events = I.log_event(spark, sf_dir).withColumn("window_start", F.date_trunc("day", "timestamp"))
    return J.first_event_per_address(events, ("window_start", "src_ip")).select("window_start", "src_ip", "max_severity")


@query("J03_event_context", with_inputs("""
SELECT source_ip AS src_ip, max(severity) AS max_severity, min_by(event_id, (timestamp, event_id)) AS event_id,
  min_by(agent_id, (timestamp, event_id)) AS agent_id FROM log_event GROUP BY 1""", "log_event"))
def event_context(spark, sf_dir):
    events = I.log_event(spark, sf_dir)
    addresses = events.select(F.col("source_ip").alias("src_ip")).distinct()
    return J.with_event_context(addresses, events).select("src_ip", "max_severity", "event_id", "agent_id")


@query("J05_severity_in_intervals", with_inputs("""
SELECT s.id, s.attacker_ip AS src_ip, coalesce(max(l.severity), 0) AS max_severity
FROM (SELECT id, attacker_ip, start_time, start_time + INTERVAL 3 DAY AS end_time FROM scenarios) s
LEFT JOIN log_event l ON l.source_ip = s.attacker_ip AND l.timestamp >= s.start_time AND l.timestamp <= s.end_time GROUP BY 1, 2""", "scenarios", "log_event"))
def severity_in_intervals(spark, sf_dir):
    intervals = I.scenarios(spark, sf_dir).select(
        "id", F.col("attacker_ip").alias("src_ip"), "start_time", (F.col("start_time") + F.expr("INTERVAL 3 DAYS")).alias("end_time"))
    return J.severity_in_intervals(intervals, I.log_event(spark, sf_dir)).select("id", "src_ip", "max_severity")


@query("J06_users_by_address", f"""
WITH pairs AS (SELECT DISTINCT src_ip, loose_user FROM ({PARSED}) WHERE loose_user <> 'unknown')
SELECT loose_user, src_ip, count(*) OVER (PARTITION BY loose_user) AS addresses FROM pairs""")
def users_by_address(spark, sf_dir):
    from palisade.functions.text import line_text, loose_user_name

    events = I.log_event(spark, sf_dir)
    named = events.select(loose_user_name(line_text(events)).alias("loose_user"), F.col("source_ip").alias("src_ip"))
    return J.users_by_address(named.where("loose_user <> 'unknown'"), "loose_user")


@query("J07_with_history", with_inputs("""
SELECT n.src_ip, n.c AS current_count, coalesce(p.c, 0) AS past_count FROM
  (SELECT source_ip AS src_ip, count(*) AS c FROM log_event WHERE timestamp >= TIMESTAMP '2024-01-29' GROUP BY 1) n LEFT JOIN
  (SELECT source_ip AS src_ip, count(*) AS c FROM log_event WHERE timestamp < TIMESTAMP '2024-01-29' GROUP BY 1) p ON p.src_ip = n.src_ip""", "log_event"))
def with_history(spark, sf_dir):
    events = I.log_event(spark, sf_dir).withColumnRenamed("source_ip", "src_ip")
    return J.with_history(events.where("timestamp >= TIMESTAMP_NTZ'2024-01-29'"), events.where("timestamp < TIMESTAMP_NTZ'2024-01-29'"))


@query("J10_lineage", with_inputs("""
SELECT a.event_id, a.feature_vector_id, a.id AS anomaly_result_id, r.id AS risk_id, (e.event_id IS NOT NULL) AS event_found,
  (v.id IS NOT NULL) AS vector_found FROM results a LEFT JOIN risk r ON r.anomaly_result_id = a.id
  LEFT JOIN (SELECT concat('e', event_id) AS event_id FROM log_event) e ON e.event_id = a.event_id LEFT JOIN vectors v ON v.id = a.feature_vector_id""",
    "results", "risk", "log_event", "vectors"))
def lineage(spark, sf_dir):
    events = I.log_event(spark, sf_dir).select(F.concat(F.lit("e"), "event_id").alias("event_id"))
    return J.lineage(events, I.vectors(spark, sf_dir), I.results(spark, sf_dir), I.risk(spark, sf_dir))


@query("J11_overlay", with_inputs("""
SELECT c.time, c.n, s.scenario_name, s.attack_type FROM (SELECT date_trunc('hour', timestamp) AS time, count(*) AS n FROM log_event GROUP BY 1) c
JOIN scenarios s ON c.time BETWEEN s.start_time AND s.end_time""", "log_event", "scenarios"))
def overlay(spark, sf_dir):
    hour = F.date_trunc("hour", "timestamp").alias("time")
    chart = I.log_event(spark, sf_dir).groupBy(hour).agg(F.count(F.lit(1)).alias("n"))
    return D.overlay(chart, I.scenarios(spark, sf_dir)).select("time", "n", "scenario_name", "attack_type")


@query("J11_annotations", with_inputs("""SELECT start_time AS time, end_time AS timeend, scenario_name AS text, attack_type AS tags FROM scenarios
WHERE start_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""", "scenarios"))
def annotations(spark, sf_dir):
    return D.annotations(I.scenarios(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 20))


@query("U01_union_sources", with_inputs("""
SELECT dataset_source, count(*) AS rows, count(burst_rate) AS bursts FROM (SELECT dataset_source, burst_rate FROM vectors
  UNION ALL SELECT 'risk' AS dataset_source, NULL AS burst_rate FROM risk) GROUP BY 1""", "vectors", "risk"))
def union_sources(spark, sf_dir):
    both = I.vectors(spark, sf_dir).select("dataset_source", "burst_rate").unionByName(
        I.risk(spark, sf_dir).select(F.lit("risk").alias("dataset_source")), allowMissingColumns=True)
    return both.groupBy("dataset_source").agg(F.count(F.lit(1)).alias("rows"), F.count("burst_rate").alias("bursts"))


