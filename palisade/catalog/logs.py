"""Parsing, per-window features, legacy features and log searches."""

from pyspark.sql import functions as F

from palisade import schema as S
from palisade.catalog import inputs as I
from palisade.catalog.registry import query
from palisade.catalog.sqltext import PARSED, SQL, features, first, match, q, r, rounded, with_inputs
from palisade.functions import alerts as A, patterns as P, text as X
from palisade.operators import dashboards as D, features as Q, flows as W, legacy as G, syslog as Y
from palisade.operators.ordering import numbered_within
from palisade.sources import files as R

DAY = 86400
LOG = SQL["log_event"]


def _json(df):
    return F.from_json("parsed_json", X.JSON_FIELDS)


def _day_features(spark, sf_dir):
    return Q.extract_features(I.log_event(spark, sf_dir), window_seconds=DAY)


def _parsed_day(spark, sf_dir):
    parsed = X.parsed_lines(I.log_event(spark, sf_dir))
    return parsed.withColumn("window_start", Q.window_column(F.col("event_time"), DAY))


# --- parsing -----------------------------------------------------------------------------

_MSG = f"CASE WHEN {match('raw_log', Y.HEADER)} THEN regexp_extract(raw_log, {q(Y.HEADER)}, 4) ELSE raw_log END"
SYSLOG = f"""
SELECT *, CASE WHEN {match('msg', Y.FAILED)} THEN 'failed_password' WHEN {match('msg', Y.INVALID)} THEN 'invalid_user'
  WHEN {match('msg', Y.ACCEPTED)} THEN 'accepted' WHEN {match('msg', Y.BREAK_IN)} THEN 'break_in_attempt'
  ELSE 'other' END AS event_type,
  CASE WHEN {match('msg', Y.FAILED)} THEN {first('msg', Y.FAILED, 2)} WHEN {match('msg', Y.INVALID)} THEN {first('msg', Y.INVALID)}
  WHEN {match('msg', Y.ACCEPTED)} THEN {first('msg', Y.ACCEPTED)} END AS username,
  CASE WHEN {match('msg', Y.FAILED)} THEN {first('msg', Y.FAILED, 3)} WHEN {match('msg', Y.INVALID)} THEN {first('msg', Y.INVALID, 2)}
  WHEN {match('msg', Y.ACCEPTED)} THEN {first('msg', Y.ACCEPTED, 2)} WHEN {match('msg', Y.BREAK_IN)} THEN {first('msg', Y.BREAK_IN)}
  ELSE {first('msg', Y.ANY_IP)} END AS src_ip,
  {first('raw_log', Y.HEADER, 1)} AS header_time, {first('raw_log', Y.HEADER, 2)} AS host, {first('raw_log', Y.HEADER, 3)} AS pid
FROM (SELECT *, {_MSG} AS msg FROM (SELECT *, trim(line) AS raw_log FROM logins))
"""
FLAGS = f"""
SELECT source_file, line_number, raw_log, event_type, lower(coalesce(username, '')) AS username, src_ip, header_time,
  (event_type IN ('failed_password','invalid_user','break_in_attempt') OR {match('raw_log', Y.FAIL_TEXT)}) AS is_fail,
  (event_type = 'accepted' OR {match('raw_log', Y.OK_TEXT)}) AS is_ok,
  (event_type = 'break_in_attempt' OR {match('raw_log', Y.BREAK_IN_TEXT)}) AS is_breakin
FROM ({SYSLOG})
"""


@query("P01_parse_syslog", with_inputs(
    f"SELECT source_file, line_number, event_type, username, src_ip, header_time, host, pid FROM ({SYSLOG})", "logins"))
def parse_syslog(spark, sf_dir):
    return Y.parse_syslog(I.logins(spark, sf_dir)).drop("line", "raw_log")


@query("P02_event_flags", with_inputs(
    f"SELECT source_file, line_number, username, is_fail, is_ok, is_breakin FROM ({FLAGS})", "logins"))
def event_flags(spark, sf_dir):
    flagged = Y.event_flags(Y.parse_syslog(I.logins(spark, sf_dir)))
    return flagged.select("source_file", "line_number", "username", "is_fail", "is_ok", "is_breakin")


@query("P03_infer_years", with_inputs("""
SELECT source_file, line_number, 2017 + CAST(sum(down) OVER (PARTITION BY source_file ORDER BY line_day, line_number) AS INT)
  AS event_year, CASE WHEN month(line_day) = 2 AND day(line_day) = 29 AND event_year % 4 <> 0 THEN -1 ELSE month(line_day) END
  AS event_month
FROM (SELECT *, CASE WHEN month(line_day) < lag(month(line_day)) OVER (PARTITION BY source_file ORDER BY line_day, line_number)
  THEN 1 ELSE 0 END AS down FROM years)""", "years"))
def infer_years(spark, sf_dir):
    events = Y.parse_syslog(I.years(spark, sf_dir))
    dated = Y.infer_years(events, ("line_day", "line_number"), piece=F.col("line_day"))
    return dated.select("source_file", "line_number", "event_year", F.coalesce(F.month("event_time").cast("long"), F.lit(-1)).alias("event_month"))


@query("P04_header_time", with_inputs(f"""
SELECT event_id, strptime('2024 ' || regexp_replace({first('raw_log', X.HEADER_TIME)}, '\\s+', ' ', 'g'),
  '%Y %b %d %H:%M:%S') AS header_time FROM log_event""", "log_event"))
def header_time(spark, sf_dir):
    events = I.log_event(spark, sf_dir)
    return events.select("event_id", X.header_time(X.line_text(events), 2024).alias("header_time"))


@query("P05_http_fields", f"""
SELECT event_id, http_status, http_method, {r('http_bytes', 'http_bytes')}, http_agent, http_url FROM ({PARSED})""")
def http_fields(spark, sf_dir):
    parsed = X.parsed_lines(I.log_event(spark, sf_dir))
    return parsed.select("event_id", "http_status", "http_method", "http_bytes", "http_agent", "http_url")


@query("P06_is_http", f"SELECT event_id, is_http, has_auth_hint FROM ({PARSED})")
def is_http(spark, sf_dir):
    return X.parsed_lines(I.log_event(spark, sf_dir)).select("event_id", "is_http", "has_auth_hint")


@query("P07_user_name", f"SELECT event_id, user_name FROM ({PARSED})")
def user_name(spark, sf_dir):
    return X.parsed_lines(I.log_event(spark, sf_dir)).select("event_id", "user_name")


@query("P08_loose_user_name", f"SELECT event_id, loose_user FROM ({PARSED})")
def loose_user_name(spark, sf_dir):
    events = I.log_event(spark, sf_dir)
    return events.select("event_id", X.loose_user_name(X.line_text(events)).alias("loose_user"))


@query("P09_source_ip", with_inputs(f"""
SELECT event_id, coalesce({first('raw_log', X.IPV4)}, '0.0.0.0') AS src_ip FROM log_event""", "log_event"))
def source_ip(spark, sf_dir):
    events = I.log_event(spark, sf_dir).drop("source_ip")
    return events.select("event_id", X.source_ip(events).alias("src_ip"))


_AD = "json_extract_string(value, '$.data.{0}')"
ALERT_ROWS = f"""
SELECT event_id AS row_id, sha256(value) AS event_id,
  CAST(json_extract_string(value, '$.timestamp') AS TIMESTAMP) AS timestamp,
  CASE WHEN a IS NULL OR a IN ('any','127.0.0.1','localhost') THEN CASE WHEN g <> '127.0.0.1' THEN nullif(g, '') END
       WHEN {match('trim(a)', A.ADDRESS)} THEN trim(a) END AS source_ip,
  coalesce(json_extract_string(value, '$.agent.name'), 'wazuh-manager') AS source_host,
  {_AD.format('dstuser')} AS username,
  CASE WHEN regexp_matches(lower(json_extract_string(value, '$.location')), 'nginx|apache|web|http')
       OR regexp_matches(lower(coalesce(json_extract_string(value, '$.full_log'), '')), 'nginx|apache|web|http')
       THEN 'nginx' ELSE 'auth' END AS event_type,
  least(greatest(CAST(json_extract_string(value, '$.rule.level') AS INT), 0), 16) AS severity,
  coalesce(CAST(TRY_CAST(json_extract_string(value, '$.rule.id') AS INT) AS VARCHAR), 'none') AS rule_id,
  json_extract_string(value, '$.agent.id') AS agent_id
FROM (SELECT *, coalesce({_AD.format('srcip')}, {_AD.format('src_ip')}, {_AD.format('dstip')},
        json_extract_string(value, '$.agent.ip')) AS a, json_extract_string(value, '$.agent.ip') AS g
      FROM alerts WHERE json_valid(value))
"""
_ALERT_COLUMNS = ["event_id", "timestamp", "source_ip", "source_host", "username", "event_type", "severity", "rule_id", "agent_id"]


@query("P10_parse_alerts", with_inputs(f"SELECT {', '.join(_ALERT_COLUMNS)} FROM ({ALERT_ROWS})", "alerts"))
def parse_alerts(spark, sf_dir):
    good, _ = R.split_json_lines(I.alerts(spark, sf_dir))
    parsed = A.parse_alerts(good).withColumn("rule_id", F.coalesce(F.col("rule_id").cast("string"), F.lit("none")))
    return parsed.select(*_ALERT_COLUMNS)


_WEB_LINE = (
    "concat(source_ip, ' h u [', lpad(CAST(day(timestamp) AS STRING), 2, '0'), '/Jan/2024:', "
    "substr(CAST(timestamp AS STRING), 12, 8), ' +0000] ', substr(raw_log, strpos_mark, length(raw_log)))"
)


def _web_lines(spark, sf_dir):
    events = I.log_event(spark, sf_dir).where("event_type = 'nginx'").withColumn("strpos_mark", F.instr("raw_log", '"'))
    return events.selectExpr("event_id", f"{_WEB_LINE} AS line")


_NGINX, _NG = P.numbered_groups(P.FORMATS["nginx"])
WEB_SQL = with_inputs(f"SELECT event_id, {_WEB_LINE} AS line FROM (SELECT *, instr(raw_log, '\"') AS strpos_mark "
                      "FROM log_event WHERE event_type = 'nginx')", "log_event")


@query("P11_access_log_format", f"""
SELECT event_id, {', '.join(f"{first('line', _NGINX, n)} AS {c}" for c, n in _NG.items() if c != 'time')},
  strptime({first('line', _NGINX, _NG['time'])}, '%d/%b/%Y:%H:%M:%S +0000') AS parsed_time FROM ({WEB_SQL})""")
def access_log_format(spark, sf_dir):
    return P.parse_format(_web_lines(spark, sf_dir), "line", "nginx").drop("line", "time", "matched")


_5424 = (
    "concat('<', CAST(k_pri AS STRING), '>1 ', substr(CAST(timestamp AS STRING), 1, 10), 'T', "
    "substr(CAST(timestamp AS STRING), 12, 8), 'Z ', source_host, ' app ', CAST(severity AS STRING), ' id - ', raw_log)"
)
_3164 = "concat('<', CAST(k_pri AS STRING), '>Jan  5 10:00:00 ', source_host, ' sshd[', CAST(severity AS STRING), ']: ', raw_log)"
_3164_LOCAL = "concat('<', CAST(k_pri AS STRING), '>Jan 15 10:00:00 cron[', CAST(severity AS STRING), ']: ', raw_log)"


def _priority_lines(spark, sf_dir, line):
    return I.log_event(spark, sf_dir).withColumn("k_pri", F.col("severity") * 8 + 3).selectExpr("event_id", f"{line} AS line")


def _format_sql(name, line, extra=""):
    pattern, groups = P.numbered_groups(P.FORMATS[name])
    columns = ", ".join(f"{first('line', pattern, n)} AS {c}" for c, n in groups.items())
    inner = f"SELECT event_id, {line} AS line FROM (SELECT *, severity * 8 + 3 AS k_pri FROM log_event)"
    return with_inputs(f"SELECT event_id, {columns}{extra} FROM ({inner})", "log_event")


_PRI = ", CAST(regexp_extract(line, '<([0-9]+)>', 1) AS INT) // 8 AS facility, " \
       "CAST(regexp_extract(line, '<([0-9]+)>', 1) AS INT) % 8 AS pri_severity"


@query("P12_syslog_rfc5424", _format_sql("syslog_rfc5424", _5424, _PRI))
def syslog_rfc5424(spark, sf_dir):
    parsed = P.parse_format(_priority_lines(spark, sf_dir, _5424), "line", "syslog_rfc5424")
    return P.with_priority(parsed).drop("line", "matched")


@query("P13_syslog_rfc3164", _format_sql("syslog_rfc3164", _3164, _PRI))
def syslog_rfc3164(spark, sf_dir):
    parsed = P.parse_format(_priority_lines(spark, sf_dir, _3164), "line", "syslog_rfc3164")
    return P.with_priority(parsed).drop("line", "matched")


@query("P13_syslog_rfc3164_local", _format_sql("syslog_rfc3164_local", _3164_LOCAL))
def syslog_rfc3164_local(spark, sf_dir):
    parsed = P.parse_format(_priority_lines(spark, sf_dir, _3164_LOCAL), "line", "syslog_rfc3164_local")
    return parsed.drop("line", "matched")


_LOGFMT = ("concat('time=\"', substr(CAST(timestamp AS STRING), 1, 10), '\" level=', event_type, ' msg=\"m ', source_host, "
           "'\" n=', CAST(severity AS STRING))")


@query("P14_logfmt", with_inputs("""SELECT event_id, substr(CAST(timestamp AS STRING), 1, 10) AS time, event_type AS level,
  concat('m ', source_host) AS msg, CAST(severity AS STRING) AS n FROM log_event""", "log_event"))
def logfmt(spark, sf_dir):
    lines = I.log_event(spark, sf_dir).selectExpr("event_id", f"{_LOGFMT} AS line")
    fields = P.parse_logfmt(lines, "line")
    return fields.select("event_id", *[F.col("fields")[n].alias(n) for n in ("time", "level", "msg", "n")])


_PRESETS = {
    "cri": "concat('2024-01-01T00:00:00.1Z ', CASE WHEN severity % 2 = 0 THEN 'stdout' ELSE 'stderr' END, ' F ', raw_log)",
    "docker_daemon": "concat('time=\"t', CAST(severity AS STRING), '\" level=', event_type, ' msg=\"', source_host, ' x\"')",
    "apache": "concat(source_ip, ' - u [', source_host, '] \"GET /a', CAST(severity AS STRING), ' HTTP/1.1\" 200 ', "
              "CAST(severity AS STRING), ' \"-\" \"A\"')",
    "apache2": "concat(source_ip, ' - u [', source_host, '] \"GET /b', CAST(severity AS STRING), ' HTTP/1.1\" 200 5')",
    "apache_error": "concat('[Mon ', source_host, '] [error] [pid ', CAST(severity AS STRING), '] [client ', source_ip, '] m')",
    "mongodb": "concat('2024-01-01T00:00:00.1 I NETWORK  [conn', CAST(severity AS STRING), '] end ', source_ip, ' 12ms')",
    "k8s_nginx_ingress": "concat(source_ip, ' - u [t] \"GET /x HTTP/1.1\" 200 7 \"-\" \"A\" 1 0.1 [up] [] ', source_ip, "
                         "':80 5 0.2 200 ', event_id)",
    "envoy": "concat('[t] \"GET /p HTTP/1.1\" 200 - 1 2 ', CAST(severity AS STRING), ' 4 \"', source_ip, '\" \"UA\" \"', "
             "event_id, '\" \"a\" \"h\"')",
    "istio_envoy_proxy": "concat('[t] \"GET /p HTTP/1.1\" 200 - via - \"-\" 1 2 ', CAST(severity AS STRING), ' 4 \"', source_ip, "
                         "'\" \"UA\" \"', event_id, '\" \"a\" \"h\" c l d r s n')",
    "kube_custom": "concat('kube.pod-', CAST(severity AS STRING), '_ns_', source_host, '-', repeat('ab', 32), '.log')",
    "kmsg_netfilter": "concat('<5>1 t h kernel - - - [1.2] DROP IN=eth0 OUT= MAC=00:11:22:33:44:55:66:77:88:99:aa:bb:08:00 SRC=', "
                      "source_ip, ' DST=1.1.1.1 LEN=60 TOS=0x00 PREC=0x00 TTL=', CAST(severity AS STRING), "
                      "' ID=1 DF PROTO=TCP SPT=1 DPT=22 WINDOW=9 RES=0x00 SYN URGP=0')",
}


def _preset(name, line):
    @query(f"P14_format_{name}", _format_sql(name, line))
    def parse(spark, sf_dir):
        return P.parse_format(_priority_lines(spark, sf_dir, line), "line", name).drop("line", "matched", "parsed_time")


for _name, _line in _PRESETS.items():
    _preset(_name, _line)


_FLOW_TEXT = (
    "CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN concat('2017-07-', lpad(CAST(1 + l_linenumber AS STRING), 2, '0'), ' ', "
    "lpad(CAST(l_suppkey % 24 AS STRING), 2, '0'), ':15:00') "
    "WHEN 1 THEN concat(CAST(1 + l_linenumber AS STRING), '/7/2017 ', CAST(l_suppkey % 24 AS STRING), ':15') "
    "ELSE concat(CAST(1 + l_linenumber AS STRING), '/07/2017 ', CAST(1 + l_suppkey % 12 AS STRING), ':15:00 PM') END"
)


@query("P15_flow_time", f"""
SELECT t AS text, count(*) AS n, CASE WHEN hour(x) BETWEEN 1 AND 7 AND NOT contains(t, 'PM') THEN x + INTERVAL 12 HOUR ELSE x END
  AS flow_time
FROM (SELECT t, CASE WHEN regexp_matches(t, '^\\d{{4}}-') THEN CAST(t AS TIMESTAMP)
             WHEN contains(t, 'PM') THEN strptime(t, '%d/%m/%Y %I:%M:%S %p') ELSE strptime(t, '%d/%m/%Y %H:%M') END AS x
      FROM (SELECT {_FLOW_TEXT} AS t FROM lineitem)) GROUP BY t, x""")
def flow_time(spark, sf_dir):
    texts = I.table(spark, sf_dir, "lineitem").selectExpr(f"{_FLOW_TEXT} AS text")
    return texts.groupBy("text", W.repaired_time(F.col("text")).alias("flow_time")).agg(F.count(F.lit(1)).alias("n"))


_ALL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, flow_time"
FLOW_ORDER = [c.strip() for c in _ALL.split(",")]


@query("P16_row_order_time", with_inputs(f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN contains(lower(source_file), 'monday')
  THEN TIMESTAMP '2017-07-03 09:00:00' ELSE TIMESTAMP '2017-07-04 09:00:00' END + to_seconds(n - 1) AS flow_time
FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY {_ALL}) AS n FROM flows)""", "flows"))
def row_order_time(spark, sf_dir):
    numbered = numbered_within(I.flows(spark, sf_dir), "source_file", FLOW_ORDER)
    return W.row_order_time(numbered).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "flow_time")


@query("P17_alert_shape", with_inputs("SELECT event_id, json_valid(value) AS is_json FROM alerts", "alerts"))
def alert_shape(spark, sf_dir):
    return I.alerts(spark, sf_dir).select("event_id", A.is_json(F.col("value")).alias("is_json"))


@query("P18_line_text", with_inputs(
    "SELECT event_id, coalesce(CASE WHEN severity % 3 = 0 THEN NULL ELSE raw_log END, '') AS text FROM log_event", "log_event"))
def line_text(spark, sf_dir):
    events = I.log_event(spark, sf_dir).withColumn("raw_message", F.when(F.col("severity") % 3 != 0, F.col("raw_log")))
    return events.select("event_id", X.line_text(events).alias("text"))


# --- the fourteen features -----------------------------------------------------------------

def _feature_sql(names, digits=6, body=None, extra=""):
    return f"WITH {body or features()} SELECT window_start, src_ip, {rounded(names, digits)}{extra} FROM features"


def _feature_query(name, columns, digits=6):
    @query(name, _feature_sql(columns, digits), digits)
    def run(spark, sf_dir):
        return _day_features(spark, sf_dir).select("window_start", "src_ip", *columns)


@query("G01_extract_features", _feature_sql(S.FEATURES))
def extract_features(spark, sf_dir):
    """The flagship operator: fourteen features per day and address."""
    return _day_features(spark, sf_dir).select("window_start", "src_ip", *S.FEATURES)


_feature_query("G02_auth_fail_count", ["auth_fail_count"])
_feature_query("G03_auth_success_count", ["auth_success_count"])
_feature_query("G04_auth_fail_ratio", ["auth_fail_ratio"])
_feature_query("G05_distinct_username", ["distinct_username"])
_feature_query("G06_fail_interarrival", ["fail_interarrival_mean", "fail_interarrival_std"])
_feature_query("G07_http_req_rate", ["http_req_rate"], 12)
_feature_query("G08_http_status_ratios", ["http_4xx_ratio", "http_5xx_ratio"])
_feature_query("G09_http_post_ratio", ["http_post_ratio"])
_feature_query("G10_distinct_user_agent", ["distinct_user_agent"])
_feature_query("G11_bytes_sent_mean", ["bytes_sent_mean"])
_feature_query("G12_global_active_ips", ["global_active_ips"])
_feature_query("G14_peak_burst", ["burst_rate"])


@query("G01_sliding_windows", _feature_sql(S.FEATURES, body=features(
    source=f"(SELECT p.*, w FROM ({PARSED}) p, LATERAL (SELECT unnest([date_trunc('hour', event_time) "
           "- to_hours(CAST(hour(event_time) % 12 AS INT)), date_trunc('hour', event_time) "
           "- to_hours(CAST(hour(event_time) % 12 + 12 AS INT))]) AS w) x)",
    start="w")))
def sliding_features(spark, sf_dir):
    """Day-long windows that start every twelve hours."""
    made = Q.extract_features(I.log_event(spark, sf_dir), window_seconds=DAY, slide_seconds=DAY / 2)
    return made.select("window_start", "src_ip", *S.FEATURES)


@query("G13_history_burst", f"""
WITH parsed AS ({PARSED}),
  past AS (SELECT src_ip, count(*) AS n FROM parsed WHERE event_time < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1),
  spans AS (SELECT count(DISTINCT date_trunc('day', event_time)) AS days FROM parsed
            WHERE event_time < TIMESTAMP '2024-01-16 00:00:00'),
  now_ AS (SELECT date_trunc('day', event_time) AS window_start, src_ip, count(*) AS n FROM parsed
           WHERE event_time >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, 2)
SELECT window_start, now_.src_ip, {r('now_.n / greatest(coalesce(past.n, 0) / CAST((SELECT days FROM spans) AS DOUBLE), 1)', 'burst_rate')}
FROM now_ LEFT JOIN past ON past.src_ip = now_.src_ip""")
def history_burst(spark, sf_dir):
    events = I.log_event(spark, sf_dir)
    past = events.where("timestamp < TIMESTAMP_NTZ'2024-01-16 00:00:00'")
    current = events.where("timestamp >= TIMESTAMP_NTZ'2024-01-16 00:00:00'")
    made = Q.extract_features(current, window_seconds=DAY, history=past, history_window=F.to_date("timestamp"))
    return made.select("window_start", "src_ip", "burst_rate")


@query("G15_feature_versions", f"""
WITH {features()} SELECT window_start, src_ip, 'v2' AS feature_version, TIMESTAMP '2024-02-01 00:00:00' AS computed_at FROM features""")
def feature_versions(spark, sf_dir):
    made = Q.extract_features(I.log_event(spark, sf_dir), window_seconds=DAY,
                              computed_at=F.lit("2024-02-01 00:00:00"))
    return made.select("window_start", "src_ip", "feature_version", "computed_at")


# --- legacy features -------------------------------------------------------------------------

@query("G16_address_entropy", with_inputs(f"""
SELECT {r('-sum(p * log2(p + 1e-9))', 'ip_entropy')} FROM (
  SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM log_event GROUP BY source_ip)""", "log_event"))
def address_entropy(spark, sf_dir):
    return G.address_entropy(I.log_event(spark, sf_dir))


def _activity(name, column, sql, minutes=1):
    @query(name, f"SELECT src_ip, {r(sql, column)} FROM ({PARSED}) GROUP BY src_ip")
    def run(spark, sf_dir):
        parsed = X.parsed_lines(I.log_event(spark, sf_dir))
        return G.address_activity(parsed, window_minutes=minutes).select("src_ip", column)


_activity("G17_request_rate", "request_rate", "count(*) / 5.0", 5)
_activity("G18_status_4xx_rate", "status_4xx_rate",
          "CASE WHEN count(*) FILTER (is_http) > 0 THEN count(*) FILTER (is_http AND http_status BETWEEN 400 AND 499) "
          "/ CAST(count(*) FILTER (is_http) AS DOUBLE) ELSE 0 END")
_activity("G19_url_frequency", "url_frequency", "count(DISTINCT http_url) / CAST(count(*) AS DOUBLE)")
_activity("G21_method_distribution", "method_distribution",
          "count(*) FILTER (http_method NOT IN ('GET', 'POST')) / CAST(count(*) AS DOUBLE)")
_activity("G22_time_window_count", "time_window_count", "count(*)")


@query("G20_user_agent_entropy", f"""
SELECT src_ip, {r('-sum(p * log2(p + 1e-9))', 'user_agent_entropy')} FROM (
  SELECT src_ip, count(*) / CAST(sum(count(*)) OVER (PARTITION BY src_ip) AS DOUBLE) AS p FROM ({PARSED})
  GROUP BY src_ip, http_agent) GROUP BY src_ip""")
def user_agent_entropy(spark, sf_dir):
    return G.agent_entropy(X.parsed_lines(I.log_event(spark, sf_dir)))


@query("G23_address_switching", f"""
WITH pairs AS (SELECT DISTINCT src_ip, loose_user FROM ({PARSED}) WHERE loose_user <> 'unknown'),
  spread AS (SELECT loose_user, count(*) AS n FROM pairs GROUP BY 1),
  top AS (SELECT src_ip, max(n) AS n FROM pairs JOIN spread USING (loose_user) GROUP BY 1)
SELECT src_ip, {r('coalesce(n, 0)', 'ip_switch_frequency')} FROM (SELECT DISTINCT src_ip FROM ({PARSED})) LEFT JOIN top USING (src_ip)""")
def address_switching(spark, sf_dir):
    return G.address_switching(I.log_event(spark, sf_dir))


@query("G24_legacy_aliases", f"""
WITH {features()} SELECT window_start, src_ip, {r('auth_fail_count', 'login_fail_count')},
  {r('auth_fail_ratio', 'fail_success_ratio')}, {r('distinct_username', 'unique_failed_ip_count')} FROM features""")
def legacy_aliases(spark, sf_dir):
    made = G.legacy_aliases(_day_features(spark, sf_dir))
    return made.select("window_start", "src_ip", "login_fail_count", "fail_success_ratio", "unique_failed_ip_count")


# --- login logs ------------------------------------------------------------------------------

LOGIN_FEATURES = f"""
  flags AS ({FLAGS}),
  timed AS (SELECT *, strptime(concat('2017 ', regexp_replace(header_time, '\\s+', ' ', 'g')), '%Y %b %d %H:%M:%S') AS ts
            FROM flags WHERE src_ip IS NOT NULL AND header_time IS NOT NULL),
  spans AS (SELECT source_file, CASE WHEN max(epoch(ts)) - min(epoch(ts)) < 3600 THEN 60 ELSE 300 END AS w,
            greatest(count(*) / CAST(count(DISTINCT src_ip) AS DOUBLE), 1) AS per_ip FROM timed GROUP BY 1),
  framed AS (SELECT timed.*, w, per_ip, CAST(epoch(ts) AS BIGINT) AS sec,
             make_timestamp((CAST(epoch(ts) AS BIGINT) // w) * w * 1000000) AS window_start FROM timed JOIN spans USING (source_file)),
  active AS (SELECT source_file, window_start, count(DISTINCT src_ip) AS active FROM framed GROUP BY 1, 2),
  gaps AS (SELECT source_file, window_start, src_ip, avg(g) AS m, stddev_pop(g) AS s FROM (
           SELECT *, sec - lag(sec) OVER (PARTITION BY source_file, window_start, src_ip ORDER BY sec) AS g
           FROM framed WHERE is_fail) GROUP BY 1, 2, 3),
  sums AS (SELECT source_file, window_start, src_ip, max(w) AS w, count(*) FILTER (is_fail) AS fails,
           count(*) FILTER (is_ok) AS oks, count(DISTINCT username) FILTER (is_fail) AS users, bool_or(is_breakin) AS breakin,
           count(*) / max(per_ip) AS burst FROM framed GROUP BY 1, 2, 3),
  login_features AS (SELECT source_file, window_start, window_start + to_seconds(w) AS timestamp, src_ip, breakin,
           CAST(fails AS DOUBLE) AS auth_fail_count, CAST(oks AS DOUBLE) AS auth_success_count,
           CASE WHEN fails + oks > 0 THEN CAST(fails AS DOUBLE) / (fails + oks) ELSE 0 END AS auth_fail_ratio,
           CAST(users AS DOUBLE) AS distinct_username, coalesce(m, 0) AS fail_interarrival_mean,
           coalesce(s, 0) AS fail_interarrival_std, CAST(active AS DOUBLE) AS global_active_ips, burst AS burst_rate
           FROM sums JOIN active USING (source_file, window_start) LEFT JOIN gaps USING (source_file, window_start, src_ip))
"""
_LOGIN_COLUMNS = ["auth_fail_count", "auth_success_count", "auth_fail_ratio", "distinct_username", "fail_interarrival_mean",
                  "fail_interarrival_std", "global_active_ips", "burst_rate"]


def login_feature_frame(spark, sf_dir):
    events = Y.event_flags(Y.infer_years(Y.parse_syslog(I.logins(spark, sf_dir))))
    return Y.syslog_features(events)


@query("G25_syslog_features", with_inputs(f"""
WITH {LOGIN_FEATURES} SELECT source_file, window_start, timestamp, src_ip, {rounded(_LOGIN_COLUMNS)} FROM login_features""", "logins"))
def syslog_features(spark, sf_dir):
    return login_feature_frame(spark, sf_dir).select("source_file", "window_start", "timestamp", "src_ip", *_LOGIN_COLUMNS)


LOGIN_LABELS = f"""{LOGIN_FEATURES},
  known AS (SELECT DISTINCT concat('10.3.0.', CAST(s_suppkey AS STRING)) AS src_ip FROM supplier WHERE s_nationkey < 3),
  labelled AS (SELECT f.*, CASE WHEN breakin THEN 'SSH-BreakInAttempt'
       WHEN distinct_username >= 3 AND auth_fail_count >= 3 THEN 'SSH-PasswordSpraying'
       WHEN auth_fail_count >= 5 OR (auth_fail_count >= 3 AND auth_fail_ratio >= 0.75) OR (burst_rate >= 2 AND auth_fail_count >= 3)
       THEN 'SSH-BruteForce' WHEN known.src_ip IS NOT NULL THEN 'SSH-KnownAttacker' ELSE 'BENIGN' END AS attack_category
       FROM login_features f LEFT JOIN known ON known.src_ip = f.src_ip)
"""


def _attackers(spark, sf_dir):
    return I.table(spark, sf_dir, "supplier").where("s_nationkey < 3").selectExpr(
        "concat('10.3.0.', CAST(s_suppkey AS STRING)) AS attacker_ip")


@query("G26_label_by_rules", with_inputs(f"""
WITH {LOGIN_LABELS} SELECT source_file, window_start, src_ip, attack_category,
  CASE WHEN attack_category = 'BENIGN' THEN 'Normal' ELSE 'Anomaly' END AS label,
  CASE attack_category WHEN 'SSH-BreakInAttempt' THEN 'explicit_sshd_breakin_alert' WHEN 'SSH-PasswordSpraying'
  THEN 'mitre_t1110_spraying_rule' WHEN 'SSH-BruteForce' THEN 'mitre_t1110_bruteforce_rule' WHEN 'SSH-KnownAttacker'
  THEN 'external_ground_truth_ip' ELSE 'benign_background_traffic' END AS label_source FROM labelled""", "logins"))
def label_by_rules(spark, sf_dir):
    labelled = Y.label_by_rules(login_feature_frame(spark, sf_dir), _attackers(spark, sf_dir))
    return labelled.select("source_file", "window_start", "src_ip", "attack_category", "label", "label_source")


@query("J02_window_totals", with_inputs(f"""
WITH {LOGIN_FEATURES} SELECT source_file, window_start, src_ip, {r('global_active_ips', 'global_active_ips')} FROM login_features""", "logins"))
def window_totals(spark, sf_dir):
    return login_feature_frame(spark, sf_dir).select("source_file", "window_start", "src_ip", "global_active_ips")


@query("J04_known_attackers", with_inputs(f"""
WITH {LOGIN_LABELS} SELECT source_file, window_start, f.src_ip, (known.src_ip IS NOT NULL) AS is_known_attacker
FROM login_features f LEFT JOIN known ON known.src_ip = f.src_ip""", "logins"))
def known_attackers(spark, sf_dir):
    marked = Y.with_known_attackers(login_feature_frame(spark, sf_dir), _attackers(spark, sf_dir))
    return marked.select("source_file", "window_start", "src_ip", "is_known_attacker")


# --- searches and line rates -------------------------------------------------------------------

@query("F27_search_lines", with_inputs(f"""
SELECT event_id, raw_log FROM log_event WHERE source_host = 'host1' AND {match('raw_log', '(?i)failed PASSWORD')}""", "log_event"))
def search_lines(spark, sf_dir):
    found = D.search_lines(I.log_event(spark, sf_dir), "failed PASSWORD", source_host=["host1"])
    return found.select("event_id", "raw_log")


@query("F31_alert_levels", with_inputs(
    "SELECT event_id, severity, severity >= 12 AS notify FROM log_event WHERE severity >= 3", "log_event"))
def alert_levels(spark, sf_dir):
    return A.alert_levels(I.log_event(spark, sf_dir)).select("event_id", "severity", "notify")


@query("A38_login_line_counts", with_inputs(f"""
SELECT CAST(count(*) FILTER ({match('raw_log', D.AUTH_LINES)}) AS BIGINT) AS auth_lines,
  CAST(count(*) FILTER ({match('raw_log', D.FAILED_LINES)}) AS BIGINT) AS failed_lines,
  CAST(count(*) FILTER ({match('raw_log', D.SUCCESS_LINES)}) AS BIGINT) AS success_lines FROM log_event""", "log_event"))
def login_line_counts(spark, sf_dir):
    return D.login_line_counts(I.log_event(spark, sf_dir))


@query("A39_line_rate", with_inputs(f"""
SELECT date_trunc('minute', timestamp) AS time, {r(f"count(*) FILTER ({match('raw_log', D.FAILED_RATE_LINES)}) / 60.0", 'failed_per_sec')},
  {r(f"count(*) FILTER ({match('raw_log', D.ACCEPTED_RATE_LINES)}) / 60.0", 'accepted_per_sec')} FROM log_event
WHERE {match('raw_log', D.FAILED_RATE_LINES)} OR {match('raw_log', D.ACCEPTED_RATE_LINES)} GROUP BY 1""", "log_event"))
def line_rate(spark, sf_dir):
    return D.trailing_rate(I.log_event(spark, sf_dir))


@query("A39_rolling_rate", with_inputs(f"""
SELECT DISTINCT source_host, second, {r('n / 60.0', 'rate')} FROM (
  SELECT source_host, epoch_us(timestamp) // 1000000 AS second, count(*) OVER (PARTITION BY source_host
    ORDER BY epoch_us(timestamp) // 1000000 RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM log_event)""", "log_event"))
def rolling_rate(spark, sf_dir):
    return D.rolling_rate(I.log_event(spark, sf_dir))


@query("A40_container_log_stats", with_inputs(f"""
SELECT source_host AS container, count(*) AS lines, CAST(count(*) FILTER ({match('raw_log', D.ERROR_LINES)}) AS BIGINT)
  AS error_lines FROM log_event GROUP BY 1""", "log_event"))
def container_log_stats(spark, sf_dir):
    return D.container_log_stats(I.log_event(spark, sf_dir))


