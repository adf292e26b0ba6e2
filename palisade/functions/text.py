"""Columns read out of log lines: users, addresses, login outcomes, web request fields."""

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: text rules -----------------------------------------------------------
HTTP_LINE = r'"(?:GET|POST|HEAD|PUT|DELETE|OPTIONS)\s'
FAIL_PHRASE = r"(?i)failed\s+password|invalid\s+user|authentication\s+failure|BREAK-IN"
FAIL_WORD = r"(?i)\b(?:fail|failure)\b"
FAIL_PREFIX = r"(?i)\bfail"
OK_PHRASE = r"(?i)\b(?:Accepted\s+(?:password|publickey)|session\s+opened)\b"
OK_WORD = r"(?i)\b(?:Accepted|success)\b"
OK_DENIED = r"(?i)\b(?:unsuccessful|not successful)\b"
AUTH_HINT = r"(?i)sshd|Failed password|Invalid user|Accepted (?:password|publickey)"
USER = r"for\s+(?:invalid\s+user\s+)?([a-zA-Z0-9_\-\.]+)"
USER_LOOSE = r"for\s+(?:user\s+|invalid\s+user\s+)?([^\s]+)"
HEADER_TIME = r"^(\w{3}\s+\d+\s[\d:]{8})"
STATUS = r"\s([1-5]\d{2})\s"
METHOD = r'"(GET|POST|HEAD|PUT|DELETE|OPTIONS|PATCH|CONNECT)\s'
BYTES = r"\s[1-5]\d{2}\s+(\d+)"
AGENT = r'"[^"]*"\s+"([^"]*)"'
URL = r'"(?:GET|POST|HEAD|PUT|DELETE|OPTIONS)\s([^\s?]+)'
IPV4 = r"(\b(?:\d{1,3}\.){3}\d{1,3}\b)"
WEB_EVENT_TYPES = ["web", "http", "nginx", "apache"]
JSON_WEB_KEYS = ["url", "method", "status", "user_agent"]
TIME_COLUMNS = ["timestamp", "ts", "time", "window_start"]
BURST_TIME_COLUMNS = ["timestamp", "time", "window_start", "ts", "datetime", "computed_at"]
# ----------------------------------------------------------------------------------------

JSON_FIELDS = (
    "status string, method string, bytes string, user_agent string, url string, "
    "user string, dstuser string, username string"
)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def line_text(df: DataFrame) -> Column:
    """``raw_message``, else ``raw_log``, else empty text; NULL becomes empty."""
    for name in ("raw_message", "raw_log"):
        if name in df.columns:
            return F.coalesce(F.col(name), F.lit(""))
    return F.lit("")


def source_ip(df: DataFrame) -> Column:
    """``src_ip``, else ``source_ip``, else the first IPv4 address in the text, else 0.0.0.0."""
    for name in ("src_ip", "source_ip"):
        if name in df.columns:
            return F.col(name)
    for name in ("raw_log", "raw_message"):
        if name in df.columns:
            return F.coalesce(extract(F.col(name), IPV4), F.lit("0.0.0.0"))
    return F.lit("0.0.0.0")


def line_json(df: DataFrame) -> Column:
    """The JSON document of a line as a struct; all fields NULL when there is none."""
    if "parsed_json" in df.columns:
        return F.from_json(F.col("parsed_json").cast("string"), JSON_FIELDS)
    return F.from_json(F.lit(None).cast("string"), JSON_FIELDS)


def header_time(text: Column, year: int) -> Column:
    """Time from a syslog header without a year."""
    found = F.regexp_replace(extract(text, HEADER_TIME), r"\s+", " ")
    return F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), found), F.lit("yyyy MMM d HH:mm:ss"))


def event_time(df: DataFrame, year: int | None = None, columns=None) -> Column | None:
    """First time column with a value; the text header when a year is given; None without either."""
    found = [F.col(c).try_cast("timestamp") for c in (columns or TIME_COLUMNS) if c in df.columns]
    if year is not None:
        found.append(header_time(line_text(df), year))
    return F.coalesce(*found) if found else None


def user_name(text: Column, json: Column) -> Column:
    """The name after ``for``; the JSON user fields fill the gaps; else ``unknown``."""
    filled = [F.nullif(json[name], F.lit("")) for name in ("user", "dstuser", "username")]
    return F.coalesce(extract(text, USER), *filled, F.lit("unknown"))


def loose_user_name(text: Column) -> Column:
    return F.coalesce(extract(text, USER_LOOSE), F.lit("unknown"))


def _any_of(text: Column, words) -> Column:
    """Cheap substring test that must hold before a regular expression is worth running."""
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def _request(text: Column) -> Column:
    return text.contains('"') & text.rlike(HTTP_LINE)


def is_timed_failure(text: Column, low: Column | None = None) -> Column:
    """Failures that enter the gap statistics. ``low`` is the line in lower case, if it is at hand."""
    low = F.lower(text) if low is None else low
    phrase = _any_of(low, ["failed", "invalid", "authentication", "break-in"]) & text.rlike(FAIL_PHRASE)
    return phrase | (low.contains("fail") & text.rlike(FAIL_WORD) & ~_request(text))


def is_failure(text: Column, event_type: Column | None = None, low: Column | None = None,
               timed: Column | None = None) -> Column:
    """Failures that are counted; authentication events need only a word that starts with ``fail``."""
    low = F.lower(text) if low is None else low
    failed = is_timed_failure(text, low) if timed is None else timed
    if event_type is not None:
        by_type = F.coalesce(event_type == "auth", F.lit(False))
        failed = failed | (by_type & low.contains("fail") & text.rlike(FAIL_PREFIX))
    return failed


def is_success(text: Column, low: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    phrase = _any_of(low, ["accepted", "session"]) & text.rlike(OK_PHRASE)
    word = _any_of(low, ["accepted", "success"]) & text.rlike(OK_WORD) & ~_request(text)
    return (phrase | word) & ~(low.contains("success") & text.rlike(OK_DENIED))


def _quoted(text: Column, pattern: str) -> Column:
    return F.when(text.contains('"'), extract(text, pattern))


def http_status(text: Column, json: Column) -> Column:
    found = F.coalesce(json["status"], extract(text, STATUS))
    return F.coalesce(found.try_cast("double").cast("int"), F.lit(200))


def http_method(text: Column, json: Column) -> Column:
    return F.upper(F.coalesce(json["method"], _quoted(text, METHOD), F.lit("GET")))


def http_bytes(text: Column, json: Column) -> Column:
    return F.coalesce(F.coalesce(json["bytes"], extract(text, BYTES)).try_cast("double"), F.lit(0.0))


def http_agent(text: Column, json: Column) -> Column:
    return F.coalesce(json["user_agent"], F.when(text.contains('"') & text.rlike(AGENT), F.regexp_extract(text, AGENT, 1)), F.lit("unknown"))


def http_url(text: Column, json: Column) -> Column:
    return F.coalesce(json["url"], _quoted(text, URL), F.lit("/"))


def is_http(df: DataFrame, text: Column) -> Column:
    """Request text, JSON with web keys, or a web event type. The batch-wide fallback is not applied here."""
    web = text.contains('"') & (text.rlike(METHOD) | text.rlike(URL))
    if "parsed_json" in df.columns:
        keys = F.json_object_keys(F.col("parsed_json").cast("string"))
        shared = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in JSON_WEB_KEYS]))
        web = web | F.coalesce(shared, F.lit(False))
    if "event_type" in df.columns:
        web = web | F.coalesce(F.lower(F.col("event_type")).isin(WEB_EVENT_TYPES), F.lit(False))
    return web


def has_auth_hint(text: Column, low: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    return _any_of(low, ["sshd", "failed", "invalid", "accepted"]) & text.rlike(AUTH_HINT)


def parsed_lines(df: DataFrame, time: Column | None = None, year: int | None = None) -> DataFrame:
    """All input columns plus every field the feature operators need; lines without an address are dropped."""
    text = line_text(df)
    when = time if time is not None else event_time(df, year)
    base = df.withColumns({
        "_text": text,
        "_json": line_json(df),
        "src_ip": source_ip(df),
        "event_time": when if when is not None else F.lit(None).cast("timestamp"),
    }).where(F.col("src_ip").isNotNull())
    line, json, low = F.col("_text"), F.col("_json"), F.col("_low")
    event_type = F.col("event_type") if "event_type" in df.columns else None
    base = base.withColumn("_low", F.lower("_text")).withColumn("is_timed_failure", is_timed_failure(line, low))
    return base.withColumns({
        "user_name": user_name(line, json),
        "is_failure": is_failure(line, event_type, low, F.col("is_timed_failure")),
        "is_success": is_success(line, low),
        "is_http": is_http(df, line),
        "has_auth_hint": has_auth_hint(line, low),
        "http_status": http_status(line, json),
        "http_method": http_method(line, json),
        "http_bytes": http_bytes(line, json),
        "http_agent": http_agent(line, json),
        "http_url": http_url(line, json),
    }).drop("_text", "_json", "_low")
