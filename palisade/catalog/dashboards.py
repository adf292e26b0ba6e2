"""Operations views."""

from pyspark.sql import functions as F

from palisade.catalog import inputs as I
from palisade.catalog.logs import _day_features
from palisade.catalog.registry import query
from palisade.catalog.sqltext import PARSED, features, r, with_inputs
from palisade.catalog.tables import class_sql, risk_sql
from palisade.functions import risk as K
from palisade.operators import dashboards as D, joins as J
from palisade.operators.ordering import first_per_key

_OFFENDERS = """SELECT src_ip, {0}, count(*) AS events, max(risk_class) AS worst_class,
  CASE max(CASE risk_class WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END) WHEN 3 THEN 'Critical' WHEN 2 THEN 'High'
  WHEN 1 THEN 'Medium' ELSE 'Low' END AS worst_class_ordinal, max(timestamp) AS last_seen FROM {1} GROUP BY 1 ORDER BY max(score) DESC, events DESC, src_ip LIMIT 15"""


@query("top_offenders_from_logs", f"""WITH {features()},
  levels AS (SELECT date_trunc('day', timestamp) AS window_start, src_ip, max(severity) AS severity FROM ({PARSED}) GROUP BY 1, 2),
  base AS (SELECT f.window_start, f.src_ip, severity, least(0.6 * auth_fail_ratio + 0.4 * http_4xx_ratio, 1) AS s FROM features f JOIN levels USING (window_start, src_ip)),
  scored_ AS (SELECT window_start AS timestamp, src_ip, {risk_sql('s', 'severity')} AS score FROM base),
  risk AS (SELECT *, {class_sql('score')} AS risk_class FROM scored_)
{_OFFENDERS.format(r('max(score)', 'max_score'), 'risk')}""")
def top_offenders_from_logs(spark, sf_dir):
    """Log lines to features per day and address, with the gravest rule level, to risk and the worst addresses."""
    events = I.log_event(spark, sf_dir).withColumn("window_start", F.date_trunc("day", "timestamp"))
    joined = J.with_event_context(_day_features(spark, sf_dir), events, ("window_start", "src_ip"))
    score = F.least(F.col("auth_fail_ratio") * 0.6 + F.col("http_4xx_ratio") * 0.4, F.lit(1.0))
    risk = joined.select(F.col("window_start").alias("timestamp"), "src_ip", K.risk_score(score, F.col("max_severity")).alias("score"))
    return D.top_offenders(risk.withColumn("risk_class", K.risk_class(F.col("score"))))


@query("A27_risk_counters", with_inputs(f"""SELECT {', '.join(f"CAST(count(*) FILTER (risk_class = '{c}') AS BIGINT) AS {c.lower()}" for c in ('Critical', 'High', 'Medium', 'Low'))},
  count(DISTINCT src_ip) AS unique_ips, {r('avg(score)', 'avg_score')} FROM risk""", "risk"))
def risk_counters(spark, sf_dir):
    return D.risk_counters(I.risk(spark, sf_dir))


@query("A28_risk_trend", with_inputs(f"SELECT date_trunc('minute', timestamp) AS time, {r('avg(score)', 'avg_risk_score')}, {r('max(score)', 'max_risk_score')} FROM risk GROUP BY 1", "risk"))
def risk_trend(spark, sf_dir):
    return D.risk_trend(I.risk(spark, sf_dir))


_FIVE = "make_timestamp((epoch_us({0}) // 300000000) * 300000000)"


@query("A29_class_counts", with_inputs(f"SELECT {_FIVE.format('timestamp')} AS time, risk_class, count(*) AS value FROM risk GROUP BY 1, 2", "risk"))
def class_counts(spark, sf_dir):
    return D.class_counts_over_time(I.risk(spark, sf_dir))


@query("A30_top_offenders", with_inputs(_OFFENDERS.format(r('max(score)', 'max_score'), 'risk'), "risk"))
def top_offenders(spark, sf_dir):
    return D.top_offenders(I.risk(spark, sf_dir))


@query("A31_class_distribution", with_inputs("SELECT risk_class AS metric, count(*) AS value FROM risk GROUP BY 1", "risk"))
def class_distribution(spark, sf_dir):
    return D.distribution(I.risk(spark, sf_dir), "risk_class")


@query("A31_label_distribution", with_inputs("SELECT predicted_label AS metric, count(*) AS value FROM results WHERE model_version = 'cascade-v1.0' GROUP BY 1", "results"))
def label_distribution(spark, sf_dir):
    return D.distribution(D.selected(I.results(spark, sf_dir), model_version=["cascade-v1.0"]), "predicted_label")


@query("A32_score_trend", with_inputs(f"SELECT date_trunc('minute', window_start) AS time, model_version, {r('avg(anomaly_score)', 'anomaly_score')} FROM results GROUP BY 1, 2", "results"))
def score_trend(spark, sf_dir):
    return D.score_trend(I.results(spark, sf_dir))


@query("A33_match_rate", with_inputs(f"""SELECT {r('100.0 * count(*) FILTER (predicted_label = ground_truth_label) / nullif(count(*), 0)', 'match_rate')} FROM results
WHERE ground_truth_label IS NOT NULL""", "results"))
def match_rate(spark, sf_dir):
    return D.match_rate(I.results(spark, sf_dir))


@query("A34_event_rate", with_inputs(f"SELECT date_trunc('minute', timestamp) AS time, event_type, {r('count(*) / 60.0', 'events_per_sec')} FROM log_event GROUP BY 1, 2", "log_event"))
def event_rate(spark, sf_dir):
    return D.event_rate(I.log_event(spark, sf_dir))


@query("A35_severity_histogram", with_inputs(f"SELECT {_FIVE.format('timestamp')} AS time, severity, count(*) AS value FROM log_event GROUP BY 1, 2", "log_event"))
def severity_histogram(spark, sf_dir):
    return D.severity_histogram(I.log_event(spark, sf_dir))


@query("A36_top_rules", with_inputs("""SELECT rule_id, count(*) AS occurrences, max(severity) AS max_severity, max(timestamp) AS last_seen FROM log_event
WHERE rule_id IS NOT NULL GROUP BY 1 ORDER BY occurrences DESC, rule_id LIMIT 10""", "log_event"))
def top_rules(spark, sf_dir):
    return D.top_rules(I.log_event(spark, sf_dir))


@query("A37_evaluation_kpis", with_inputs(f"""SELECT {r('max(roc_auc)', 'max_roc_auc')}, {r('min(false_positive_rate)', 'min_fpr')}, count(DISTINCT run_id) AS runs FROM metrics
WHERE dataset_split IN ('validation', 'test')""", "metrics"))
def evaluation_kpis(spark, sf_dir):
    return D.evaluation_kpis(D.selected(I.metrics(spark, sf_dir), dataset_split=["validation", "test"]))


@query("A37_best_recent_f1", with_inputs(f"""SELECT model_config AS metric, {r('f1_score', 'f1')} FROM (SELECT DISTINCT ON (model_config) model_config, f1_score FROM metrics
ORDER BY model_config, evaluated_at DESC, f1_score DESC) ORDER BY metric LIMIT 1""", "metrics"))
def best_recent_f1(spark, sf_dir):
    return D.best_recent_f1(I.metrics(spark, sf_dir))


_SAMPLES = ("SELECT concat('host', CAST(user_id % 5 AS VARCHAR)) AS host, CASE WHEN user_id % 4 = 0 THEN 'lo' ELSE concat('eth', CAST(user_id % 4 AS VARCHAR)) END AS device, "
            "ts AS timestamp, CAST(event_id % 997 AS DOUBLE) AS value FROM events")


def _samples(spark, sf_dir):
    return I.table(spark, sf_dir, "events").selectExpr(
        "concat('host', CAST(user_id % 5 AS STRING)) AS host",
        "CASE WHEN user_id % 4 = 0 THEN 'lo' ELSE concat('eth', CAST(user_id % 4 AS STRING)) END AS device", "ts AS timestamp",
        "CAST(event_id % 997 AS DOUBLE) AS value")


RATE_ROWS = f"""steps AS (SELECT *, lag(value) OVER w AS v, lag(timestamp) OVER w AS t FROM ({_SAMPLES}) WINDOW w AS (PARTITION BY host, device ORDER BY timestamp)),
  rates AS (SELECT *, CASE WHEN value >= v THEN value - v ELSE value END AS increase, (epoch_us(timestamp) - epoch_us(t)) / 1000000.0 AS seconds FROM steps WHERE t IS NOT NULL)"""


@query("A41_counter_rates", f"WITH {RATE_ROWS} SELECT host, device, timestamp, {r('increase', 'increase')}, {r('increase / seconds', 'rate')} FROM rates")
def counter_rates(spark, sf_dir):
    return D.counter_rates(_samples(spark, sf_dir), ["host", "device"]).select("host", "device", "timestamp", "increase", "rate")


@query("A41_cpu_busy", f"WITH {RATE_ROWS} SELECT date_trunc('hour', timestamp) AS time, {r('100 - avg(increase / seconds) * 100', 'cpu_busy_percent')} FROM rates GROUP BY 1")
def cpu_busy(spark, sf_dir):
    return D.cpu_busy_percent(D.counter_rates(_samples(spark, sf_dir), ["host", "device"]), "1 hour")


@query("A41_network_rate", f"WITH {RATE_ROWS} SELECT date_trunc('hour', timestamp) AS time, {r('sum(increase / seconds)', 'receive_bytes_per_sec')} FROM rates WHERE device <> 'lo' GROUP BY 1")
def network_rate(spark, sf_dir):
    return D.network_rate(D.counter_rates(_samples(spark, sf_dir), ["host", "device"]), "1 hour")


@query("A41_memory_usage", f"""SELECT event_id, {r('(1 - CAST(user_id + 1 AS DOUBLE) / 5000) * 100', 'memory_used_percent')}, {r('5000 - (user_id + 1)', 'memory_used_bytes')} FROM events""")
def memory_usage(spark, sf_dir):
    memory = I.table(spark, sf_dir, "events").selectExpr(
        "event_id", "CAST(5000 AS DOUBLE) AS total_bytes", "CAST(user_id + 1 AS DOUBLE) AS available_bytes")
    return D.memory_usage(memory).select("event_id", "memory_used_percent", "memory_used_bytes")


@query("W02_running_count", with_inputs("""SELECT id, timestamp, count(*) OVER (ORDER BY timestamp) AS running_count FROM risk WHERE risk_class = 'Critical'""", "risk"))
def running_count(spark, sf_dir):
    critical = I.risk(spark, sf_dir).where("risk_class = 'Critical'")
    return D.running_count(critical, "timestamp").select("id", "timestamp", "running_count")


@query("W01_failure_gaps", f"""SELECT window_start, src_ip, count(gap) AS gaps, {r('avg(gap)', 'mean_gap')}, {r('stddev_pop(gap)', 'deviation')} FROM (
  SELECT date_trunc('day', event_time) AS window_start, src_ip, sec - lag(sec) OVER (PARTITION BY date_trunc('day', event_time), src_ip ORDER BY sec) AS gap
  FROM ({PARSED}) WHERE is_timed_failure) WHERE gap IS NOT NULL GROUP BY 1, 2""")
def failure_gaps(spark, sf_dir):
    """Consecutive differences inside a window, by the library from its distinct seconds (a day has 86,400 at most)."""
    from palisade.functions.text import parsed_lines
    from palisade.operators.features import failure_gaps as gaps_of

    parsed = parsed_lines(I.log_event(spark, sf_dir)).where("is_timed_failure")
    listed = parsed.groupBy(F.date_trunc("day", "event_time").alias("window_start"), "src_ip").agg(
        F.sort_array(F.collect_set(F.unix_seconds("event_time"))).alias("seconds"), F.count(F.lit(1)).alias("failures"))
    mean, deviation = gaps_of(F.col("seconds"), F.col("failures"))
    return listed.where("failures > 1").select(
        "window_start", "src_ip", (F.col("failures") - 1).alias("gaps"), mean.alias("mean_gap"), deviation.alias("deviation"))


@query("W03_latest_runs", with_inputs(f"""SELECT DISTINCT ON (model_config, dataset_split) run_id, model_config, dataset_split, {r('f1_score', 'f1_score')}, {r('roc_auc', 'roc_auc')}, evaluated_at
FROM metrics ORDER BY model_config, dataset_split, metrics.evaluated_at DESC""", "metrics"))
def latest_runs(spark, sf_dir):
    newest = D.latest_runs(I.metrics(spark, sf_dir), "model_config", "dataset_split")
    return newest.select("run_id", "model_config", "dataset_split", "f1_score", "roc_auc", "evaluated_at")


@query("W03_latest_resources", with_inputs(f"""SELECT DISTINCT ON (model_config) model_config, {r('latency_ms_avg', 'latency_ms_avg')}, {r('cpu_usage_percent', 'cpu_usage_percent')},
  {r('throughput_events_per_sec', 'throughput_events_per_sec')} FROM metrics ORDER BY model_config, evaluated_at DESC""", "metrics"))
def latest_resources(spark, sf_dir):
    newest = D.latest_runs(I.metrics(spark, sf_dir), "model_config")
    return newest.select("model_config", "latency_ms_avg", "cpu_usage_percent", "throughput_events_per_sec")


@query("W05_newest_per_address", with_inputs(f"""SELECT src_ip, id, {r('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY timestamp DESC, id DESC) AS n FROM risk)
WHERE n = 1""", "risk"))
def newest_per_address(spark, sf_dir):
    return first_per_key(I.risk(spark, sf_dir), ["src_ip"], ["timestamp", "id"], newest=True).select("src_ip", "id", "score")


@query("W14_sorted_head", with_inputs(f"SELECT id, timestamp, {r('score', 'score')} FROM risk ORDER BY risk.score DESC, id LIMIT 40", "risk"))
def sorted_head(spark, sf_dir):
    return I.risk(spark, sf_dir).orderBy(F.col("score").desc(), "id").limit(40).select("id", "timestamp", "score")


@query("U03_variable_values", with_inputs("SELECT DISTINCT src_ip FROM risk ORDER BY 1", "risk"))
def variable_values(spark, sf_dir):
    return D.variable_values(I.risk(spark, sf_dir), "src_ip")


@query("F26_trade_off", with_inputs(f"""SELECT DISTINCT ON (model_config, dataset_split) model_config, dataset_split, {r('recall_score', 'recall_score')},
  {r('false_positive_rate', 'false_positive_rate')}, {r('recall_score - false_positive_rate', 'trade_off_score')} FROM metrics ORDER BY model_config, dataset_split, evaluated_at DESC""", "metrics"))
def trade_off(spark, sf_dir):
    return D.trade_off(I.metrics(spark, sf_dir))


@query("F28_recent_parameters", with_inputs("""SELECT run_id, model_config, dataset_split, json_extract_string(hyperparameters, '$.size') AS size, evaluated_at FROM metrics
WHERE hyperparameters IS NOT NULL ORDER BY evaluated_at DESC, id LIMIT 20""", "metrics"))
def recent_parameters(spark, sf_dir):
    newest = D.recent_parameters(I.metrics(spark, sf_dir))
    return newest.select("run_id", "model_config", "dataset_split", F.get_json_object("hyperparameters", "$.size").alias("size"), "evaluated_at")


