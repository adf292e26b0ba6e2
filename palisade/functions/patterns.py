"""Named line formats of log collectors, read with one regular expression each."""

import re

from pyspark.sql import Column, DataFrame, functions as F


# --- fixed values: line formats; the named groups become columns ------------------------
FORMATS = {
    "nginx": r'^(?<remote>[^ ]*) (?<host>[^ ]*) (?<user>[^ ]*) \[(?<time>[^\]]*)\] "(?<method>\S+)(?: +(?<path>[^\"]*?)(?: +\S*)?)?" (?<code>[^ ]*) (?<size>[^ ]*)(?: "(?<referer>[^\"]*)" "(?<agent>[^\"]*)")',
    "apache": r'^(?<host>[^ ]*) [^ ]* (?<user>[^ ]*) \[(?<time>[^\]]*)\] "(?<method>\S+)(?: +(?<path>[^\"]*?)(?: +\S*)?)?" (?<code>[^ ]*) (?<size>[^ ]*)(?: "(?<referer>[^\"]*)" "(?<agent>[^\"]*)")?$',
    "apache2": r'^(?<host>[^ ]*) [^ ]* (?<user>[^ ]*) \[(?<time>[^\]]*)\] "(?<method>\S+)(?: +(?<path>[^ ]*) +\S*)?" (?<code>[^ ]*) (?<size>[^ ]*)(?: "(?<referer>[^\"]*)" "(?<agent>.*)")?$',
    "apache_error": r'^\[[^ ]* (?<time>[^\]]*)\] \[(?<level>[^\]]*)\](?: \[pid (?<pid>[^\]]*)\])?( \[client (?<client>[^\]]*)\])? (?<message>.*)$',
    "k8s_nginx_ingress": r'^(?<host>[^ ]*) - (?<user>[^ ]*) \[(?<time>[^\]]*)\] "(?<method>\S+)(?: +(?<path>[^\"]*?)(?: +\S*)?)?" (?<code>[^ ]*) (?<size>[^ ]*) "(?<referer>[^\"]*)" "(?<agent>[^\"]*)" (?<request_length>[^ ]*) (?<request_time>[^ ]*) \[(?<proxy_upstream_name>[^ ]*)\] (\[(?<proxy_alternative_upstream_name>[^ ]*)\] )?(?<upstream_addr>[^ ]*) (?<upstream_response_length>[^ ]*) (?<upstream_response_time>[^ ]*) (?<upstream_status>[^ ]*) (?<reg_id>[^ ]*).*$',
    "docker_daemon": r'time="(?<time>[^ ]*)" level=(?<level>[^ ]*) msg="(?<msg>[^ ].*)"',
    "syslog_rfc5424": r'^\<(?<pri>[0-9]{1,5})\>1 (?<time>[^ ]+) (?<host>[^ ]+) (?<ident>[^ ]+) (?<pid>[-0-9]+) (?<msgid>[^ ]+) (?<extradata>(\[(.*?)\]|-)) (?<message>.+)$',
    "syslog_rfc3164_local": r'^\<(?<pri>[0-9]+)\>(?<time>[^ ]* {1,2}[^ ]* [^ ]*) (?<ident>[a-zA-Z0-9_\/\.\-]*)(?:\[(?<pid>[0-9]+)\])?(?:[^\:]*\:)? *(?<message>.*)$',
    "syslog_rfc3164": r'^\<(?<pri>[0-9]+)\>(?<time>[^ ]* {1,2}[^ ]* [^ ]*) (?<host>[^ ]*) (?<ident>[a-zA-Z0-9_\/\.\-]*)(?:\[(?<pid>[0-9]+)\])?(?:[^\:]*\:)? *(?<message>.*)$',
    "mongodb": r'^(?<time>[^ ]*)\s+(?<severity>\w)\s+(?<component>[^ ]+)\s+\[(?<context>[^\]]+)]\s+(?<message>.*?) *(?<ms>(\d+))?(:?ms)?$',
    "envoy": r'^\[(?<start_time>[^\]]*)\] "(?<method>\S+)(?: +(?<path>[^\"]*?)(?: +\S*)?)? (?<protocol>\S+)" (?<code>[^ ]*) (?<response_flags>[^ ]*) (?<bytes_received>[^ ]*) (?<bytes_sent>[^ ]*) (?<duration>[^ ]*) (?<x_envoy_upstream_service_time>[^ ]*) "(?<x_forwarded_for>[^ ]*)" "(?<user_agent>[^\"]*)" "(?<request_id>[^\"]*)" "(?<authority>[^ ]*)" "(?<upstream_host>[^ ]*)"',
    "istio_envoy_proxy": r'^\[(?<start_time>[^\]]*)\] "(?<method>\S+)(?: +(?<path>[^\"]*?)(?: +\S*)?)? (?<protocol>\S+)" (?<response_code>[^ ]*) (?<response_flags>[^ ]*) (?<response_code_details>[^ ]*) (?<connection_termination_details>[^ ]*) "(?<upstream_transport_failure_reason>[^ ]*)" (?<bytes_received>[^ ]*) (?<bytes_sent>[^ ]*) (?<duration>[^ ]*) (?<x_envoy_upstream_service_time>[^ ]*) "(?<x_forwarded_for>[^ ]*)" "(?<user_agent>[^\"]*)" "(?<x_request_id>[^\"]*)" "(?<authority>[^ ]*)" "(?<upstream_host>[^ ]*)" (?<upstream_cluster>[^ ]*) (?<upstream_local_address>[^ ]*) (?<downstream_local_address>[^ ]*) (?<downstream_remote_address>[^ ]*) (?<requested_server_name>[^ ]*) (?<route_name>[^  ]*)$',
    "cri": r'^(?<time>[^ ]+) (?<stream>stdout|stderr) (?<logtag>[^ ]*) (?<message>.*)$',
    "kube_custom": r'(?<tag>[^.]+)?\.?(?<pod_name>[a-z0-9](?:[-a-z0-9]*[a-z0-9])?(?:\.[a-z0-9]([-a-z0-9]*[a-z0-9])?)*)_(?<namespace_name>[^_]+)_(?<container_name>.+)-(?<docker_id>[a-z0-9]{64})\.log$',
    "kmsg_netfilter": r'^\<(?<pri>[0-9]{1,5})\>1 (?<time>[^ ]+) (?<host>[^ ]+) kernel - - - \[[0-9\.]*\] (?<logprefix>[^ ]*)\s?IN=(?<in>[^ ]*) OUT=(?<out>[^ ]*) MAC=(?<macsrc>[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}):(?<macdst>[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}):(?<ethtype>[0-9a-f]{2}:[0-9a-f]{2}) SRC=(?<saddr>[^ ]*) DST=(?<daddr>[^ ]*) LEN=(?<len>[^ ]*) TOS=(?<tos>[^ ]*) PREC=(?<prec>[^ ]*) TTL=(?<ttl>[^ ]*) ID=(?<id>[^ ]*) (D*F*)\s*PROTO=(?<proto>[^ ]*)\s?((SPT=)?(?<sport>[0-9]*))\s?((DPT=)?(?<dport>[0-9]*))\s?((LEN=)?(?<protolen>[0-9]*))\s?((WINDOW=)?(?<window>[0-9]*))\s?((RES=)?(?<res>0?x?[0-9]*))\s?(?<flag>[^ ]*)\s?((URGP=)?(?<urgp>[0-9]*))',
}
TIME_FORMATS = {
    "nginx": "dd/MMM/yyyy:HH:mm:ss Z", "apache": "dd/MMM/yyyy:HH:mm:ss Z", "apache2": "dd/MMM/yyyy:HH:mm:ss Z",
    "k8s_nginx_ingress": "dd/MMM/yyyy:HH:mm:ss Z",
}
# ----------------------------------------------------------------------------------------

_NAMED = re.compile(r"\(\?<([a-z_]+)>")


def numbered_groups(pattern: str) -> tuple[str, dict]:
    """The pattern with plain groups, and the number of each named group."""
    names, position, index = {}, 0, 0
    while index < len(pattern):
        if pattern[index] == "\\":
            index += 2
            continue
        if pattern[index] == "[":  # a bracket inside a class does not open a group
            index += 2 if pattern[index + 1] != "^" else 3
            while pattern[index] != "]":
                index += 2 if pattern[index] == "\\" else 1
        elif pattern[index] == "(":
            named = _NAMED.match(pattern, index)
            if named:
                position += 1
                names[named.group(1)] = position
            elif pattern[index + 1] != "?":
                position += 1
        index += 1
    return _NAMED.sub("(", pattern), names


CUT, MARK = "\u0002", "\u0001"  # around a match and between its groups


def parse_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Add one text column per named group and ``matched``; groups of lines without a match are NULL.

    The pattern runs once a line: the match is replaced by its groups with marks between them. Lines that hold such marks
    themselves are read group by group.
    """
    plain, names = numbered_groups(pattern)
    line = F.col(column)
    found, groups, dirty = (_unused(df, c) for c in ("_found", "_groups", "_dirty"))
    marked = CUT + MARK.join(f"${group}" for group in names.values()) + CUT
    each = F.array(*[F.regexp_extract(line, plain, group) for group in names.values()])
    listed = F.split(F.get(F.split(F.col(found), CUT), F.lit(1)), MARK)
    read = df.withColumn(dirty, line.contains(CUT) | line.contains(MARK))
    read = read.withColumn(found, F.when(~F.col(dirty), F.regexp_replace(line, F.lit(plain), F.lit(marked))))
    read = read.withColumn(groups, F.when(F.col(dirty), each).otherwise(listed))
    return read.withColumns({
        **{name: F.nullif(F.get(F.col(groups), F.lit(i)), F.lit("")) for i, name in enumerate(names)},
        "matched": F.when(F.col(dirty), line.rlike(plain)).otherwise(F.col(found).contains(CUT)),
    }).drop(found, groups, dirty)


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def parse_format(df: DataFrame, column: str, name: str) -> DataFrame:
    """Read a named format; where its time format is known ``parsed_time`` is added."""
    parsed = parse_pattern(df, column, FORMATS[name])
    if name in TIME_FORMATS:
        return parsed.withColumn("parsed_time", F.try_to_timestamp(F.col("time"), F.lit(TIME_FORMATS[name])))
    return parsed


def with_priority(df: DataFrame) -> DataFrame:
    """Split the syslog priority into facility and severity."""
    number = F.col("pri").try_cast("int")
    return df.withColumns({"facility": F.floor(number / 8).cast("int"), "pri_severity": number % 8})


def parse_logfmt(df: DataFrame, column: str) -> DataFrame:
    """Add ``fields``: the key=value pairs of a line as a map; quoted values may hold blanks, the last of equal keys wins."""
    line = F.col(column)
    pairs = F.regexp_extract_all(line, F.lit(r'([A-Za-z0-9_.\-]+=(?:"[^"]*"|[^ ]*))'), F.lit(1))
    entry = lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("key"),
        F.btrim(F.regexp_replace(p, r"^[^=]*=", ""), F.lit('"')).alias("value"),
    )
    listed = F.transform(pairs, entry)
    # a key may come again: the last value counts
    later = lambda e, i: F.exists(F.slice(listed, i + 2, F.size(listed)), lambda f: f["key"] == e["key"])
    return df.withColumn("fields", F.map_from_entries(F.filter(listed, lambda e, i: ~later(e, i))))


def parse_json_lines(df: DataFrame, column: str, fields: str) -> DataFrame:
    """JSON and container-runtime lines: the listed fields as columns."""
    return df.withColumn("_json", F.from_json(F.col(column), fields)).select(*df.columns, "_json.*")
