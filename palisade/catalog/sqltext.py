"""SQL fragments that several checks share, written for DuckDB."""

from palisade.catalog.inputs import SQL, with_inputs
from palisade.catalog.registry import r
from palisade.functions import text as X


def q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def match(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def first(column: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, {q(only_group(pattern, group))}, 1), '')"


def only_group(pattern: str, group: int) -> str:
    """The pattern with one capturing group left (the checking engine knows at most nine)."""
    out, index, count = [], 0, 0
    while index < len(pattern):
        if pattern[index] == "\\":
            out.append(pattern[index:index + 2])
            index += 2
        elif pattern[index] == "[":
            end = index + (2 if pattern[index + 1] != "^" else 3)
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            out.append(pattern[index:end + 1])
            index = end + 1
        else:
            plain = pattern[index] == "(" and pattern[index + 1] != "?"
            count += plain
            out.append("(?:" if plain and count != group else pattern[index])
            index += 1
    return "".join(out)


def js(key: str, column: str = "parsed_json") -> str:
    return f"json_extract_string({column}, '$.{key}')"


_HTTP = match("raw_log", X.HTTP_LINE)
_TIMED = f"({match('raw_log', X.FAIL_PHRASE)} OR (NOT {_HTTP} AND {match('raw_log', X.FAIL_WORD)}))"

# log_event with one column per parsed field
PARSED = f"""
SELECT l.*, source_ip AS src_ip, timestamp AS event_time, epoch_us(timestamp) // 1000000 AS sec,
  coalesce({first('raw_log', X.USER)}, nullif({js('user')}, ''), nullif({js('dstuser')}, ''),
           nullif({js('username')}, ''), 'unknown') AS user_name,
  coalesce({first('raw_log', X.USER_LOOSE)}, 'unknown') AS loose_user,
  {_TIMED} AS is_timed_failure,
  ({_TIMED} OR (event_type = 'auth' AND {match('raw_log', X.FAIL_PREFIX)})) AS is_failure,
  (({match('raw_log', X.OK_PHRASE)} OR (NOT {_HTTP} AND {match('raw_log', X.OK_WORD)}))
    AND NOT {match('raw_log', X.OK_DENIED)}) AS is_success,
  coalesce(CAST(TRY_CAST(coalesce({js('status')}, {first('raw_log', X.STATUS)}) AS DOUBLE) AS INT), 200) AS http_status,
  upper(coalesce({js('method')}, {first('raw_log', X.METHOD)}, 'GET')) AS http_method,
  coalesce(TRY_CAST(coalesce({js('bytes')}, {first('raw_log', X.BYTES)}) AS DOUBLE), 0) AS http_bytes,
  coalesce({js('user_agent')}, {first('raw_log', X.AGENT)}, 'unknown') AS http_agent,
  coalesce({js('url')}, {first('raw_log', X.URL)}, '/') AS http_url,
  ({match('raw_log', X.METHOD)} OR {match('raw_log', X.URL)} OR lower(event_type) IN ('web','http','nginx','apache')
    OR coalesce(list_has_any(json_keys(parsed_json), ['url','method','status','user_agent']), false)) AS is_http,
  {match('raw_log', X.AUTH_HINT)} AS has_auth_hint
FROM ({SQL['log_event']}) l
"""


def features(span: str = "day", seconds: int = 86400, source: str | None = None, start: str | None = None) -> str:
    """CTE body list ending in ``features``: the fourteen features per window and address."""
    base = source or f"({PARSED})"
    window = start or f"date_trunc('{span}', event_time)"
    return f"""
  lines AS (SELECT *, {window} AS window_start FROM {base}),
  per_window AS (SELECT window_start, count(DISTINCT src_ip) AS active, bool_or(is_http) AS any_web,
                 bool_or(has_auth_hint) AS any_auth FROM lines GROUP BY 1),
  marked AS (SELECT lines.*, active, (is_http OR NOT (any_web OR any_auth)) AS web
             FROM lines JOIN per_window USING (window_start)),
  gaps AS (SELECT window_start, src_ip, avg(gap) AS m, stddev_pop(gap) AS s FROM (
             SELECT window_start, src_ip, sec - lag(sec) OVER (PARTITION BY window_start, src_ip ORDER BY sec) AS gap
             FROM marked WHERE is_timed_failure) GROUP BY 1, 2),
  bursts AS (SELECT window_start, src_ip, max(n) / greatest(avg(n), 1) AS burst FROM (
             SELECT window_start, src_ip, sec // 10 AS bucket, count(*) AS n FROM marked GROUP BY 1, 2, 3) GROUP BY 1, 2),
  sums AS (SELECT window_start, src_ip, count(*) FILTER (is_failure) AS fails, count(*) FILTER (is_success) AS oks,
             count(DISTINCT user_name) FILTER (user_name <> 'unknown') AS users, count(*) FILTER (web) AS reqs,
             count(*) FILTER (web AND http_status BETWEEN 400 AND 499) AS c4,
             count(*) FILTER (web AND http_status BETWEEN 500 AND 599) AS c5,
             count(*) FILTER (web AND http_method = 'POST') AS posts,
             count(DISTINCT http_agent) FILTER (web AND http_agent <> 'unknown') AS agents,
             avg(http_bytes) FILTER (web) AS bytes, max(active) AS active, count(*) AS n
           FROM marked GROUP BY 1, 2),
  features AS (SELECT window_start, src_ip, n, CAST(fails AS DOUBLE) AS auth_fail_count,
             CAST(oks AS DOUBLE) AS auth_success_count,
             CASE WHEN fails + oks > 0 THEN CAST(fails AS DOUBLE) / (fails + oks) ELSE 0 END AS auth_fail_ratio,
             CAST(users AS DOUBLE) AS distinct_username, coalesce(m, 0) AS fail_interarrival_mean,
             coalesce(s, 0) AS fail_interarrival_std, CAST(reqs AS DOUBLE) / {seconds} AS http_req_rate,
             CASE WHEN reqs > 0 THEN CAST(c4 AS DOUBLE) / reqs ELSE 0 END AS http_4xx_ratio,
             CASE WHEN reqs > 0 THEN CAST(c5 AS DOUBLE) / reqs ELSE 0 END AS http_5xx_ratio,
             CASE WHEN reqs > 0 THEN CAST(posts AS DOUBLE) / reqs ELSE 0 END AS http_post_ratio,
             CAST(agents AS DOUBLE) AS distinct_user_agent, coalesce(bytes, 0) AS bytes_sent_mean,
             CAST(active AS DOUBLE) AS global_active_ips, burst AS burst_rate
           FROM sums LEFT JOIN gaps USING (window_start, src_ip) LEFT JOIN bursts USING (window_start, src_ip))
"""


def rounded(names, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


__all__ = ["PARSED", "SQL", "features", "first", "js", "match", "q", "r", "rounded", "with_inputs"]
