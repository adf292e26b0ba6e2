"""Login daemon syslog: lines to events, years, windows, features and rule labels."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade import schema as S
from palisade.functions.numbers import count_if, ratio
from palisade.functions.text import extract
from palisade.operators.features import BUCKET_SECONDS, _expanded_seconds, failure_gaps
from palisade.session import checkpointed, small_side

# --- fixed values: line patterns and label rules ----------------------------------------
HEADER = r"^([A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(.*)$"
FAILED = r"Failed password for (invalid user )?(\S+) from (\d{1,3}(?:\.\d{1,3}){3})"
INVALID = r"Invalid user (\S+) from (\d{1,3}(?:\.\d{1,3}){3})"
ACCEPTED = r"Accepted (?:password|publickey) for (\S+) from (\d{1,3}(?:\.\d{1,3}){3})"
BREAK_IN = r"POSSIBLE BREAK-IN ATTEMPT.*\[(\d{1,3}(?:\.\d{1,3}){3})\]"
ANY_IP = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
FAIL_TEXT = r"(?i)failed\s+password|invalid\s+user|authentication\s+failure"
OK_TEXT = r"(?i)accepted\s+password|accepted\s+publickey"
BREAK_IN_TEXT = r"(?i)possible\s+break-in\s+attempt|break-in"
FIRST_YEAR = 2017
TIMESTAMP_SOURCE = "original_syslog_timestamp_year_inferred"
# ----------------------------------------------------------------------------------------

BLANKS = " \t\r\n\x0b\x0c"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def parse_syslog(lines: DataFrame, column: str = "line") -> DataFrame:
    """Add raw_log, header_time, host, pid, event_type, username and src_ip; the first matching rule wins.

    The fields of a line are generated as one record: they are worked out once, while a projection would
    be repeated inside every filter that is pushed below it.
    """
    framed = lines.withColumn("raw_log", stripped(F.col(column))).where("raw_log <> ''")
    text = F.col("raw_log")
    header = F.regexp_extract_all(text, F.lit(HEADER), F.lit(4))
    framed = framed.withColumn("_message", F.coalesce(F.get(header, F.lit(0)), text))
    message = F.col("_message")
    event = (
        F.when(message.rlike(FAILED), "failed_password")
        .when(message.rlike(INVALID), "invalid_user")
        .when(message.rlike(ACCEPTED), "accepted")
        .when(message.rlike(BREAK_IN), "break_in_attempt")
        .otherwise("other")
    )
    user = F.coalesce(extract(message, FAILED, 2), extract(message, INVALID, 1), extract(message, ACCEPTED, 1))
    address = F.coalesce(
        extract(message, FAILED, 3), extract(message, INVALID, 2), extract(message, ACCEPTED, 2),
        extract(message, BREAK_IN, 1), extract(message, ANY_IP, 1),
    )
    record = F.struct(
        extract(text, HEADER, 1).alias("header_time"), extract(text, HEADER, 2).alias("host"),
        extract(text, HEADER, 3).alias("pid"), event.alias("event_type"), user.alias("username"), address.alias("src_ip"),
    )
    return framed.select(*lines.columns, "raw_log", F.inline(F.array(record)))


def event_flags(events: DataFrame) -> DataFrame:
    """Add is_fail, is_ok and is_breakin from the event type or the text; user names in lower case."""
    text, kind = F.col("raw_log"), F.col("event_type")
    return events.withColumns({
        "username": F.lower(F.coalesce("username", F.lit(""))),
        "is_fail": kind.isin("failed_password", "invalid_user", "break_in_attempt") | text.rlike(FAIL_TEXT),
        "is_ok": (kind == "accepted") | text.rlike(OK_TEXT),
        "is_breakin": (kind == "break_in_attempt") | text.rlike(BREAK_IN_TEXT),
    })


def _header_as(year: Column) -> Column:
    spaced = F.regexp_replace(F.initcap(F.col("header_time")), r"\s+", " ")
    return F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), spaced), F.lit("yyyy MMM d HH:mm:ss"))


PIECE_LINES = 65_536


def infer_years(events: DataFrame, order=("line_number",), source: str = "source_file",
                first_year: int = FIRST_YEAR, piece: Column | None = None) -> DataFrame:
    """Add ``event_time``: a new year begins in a file whenever the month goes down from the line before.

    Only lines with an address and a readable time take part. ``piece`` never goes down in the order of a file and cuts
    it into pieces of bounded size (by default ``PIECE_LINES`` line numbers). A piece is summed up by its first, last,
    smallest and largest month; year changes between pieces follow from these few rows, and only pieces that hold more
    than one month are read in order, one window each. The lines are stored once, parsed, and never sorted as a whole.
    """
    cut = F.floor(F.col(order[0]) / PIECE_LINES) if piece is None else piece
    usable = events.where(F.col("src_ip").isNotNull()).withColumns({"_in_leap_year": _header_as(F.lit(2000)), "_piece": cut})
    usable = usable.where(F.col("_in_leap_year").isNotNull()).withColumn("_month", F.month("_in_leap_year")).drop("_in_leap_year")
    usable = checkpointed(usable)
    place, key = [source, "_piece"], F.struct(*order)
    pieces = usable.groupBy(*place).agg(
        F.min_by("_month", key).alias("_head"), F.max_by("_month", key).alias("_tail"),
        (F.min("_month") < F.max("_month")).alias("_mixed"))
    marked = usable.join(small_side(pieces.where("_mixed").select(*place, "_mixed")), place, "left")
    inside = Window.partitionBy(*place).orderBy(*order)
    down = F.coalesce(F.col("_month") < F.lag("_month").over(inside), F.lit(False)).cast("int")
    stepped = marked.where("_mixed").withColumn("_down", down)
    stepped = stepped.withColumn("_steps", F.sum("_down").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    steps = stepped.groupBy(*place).agg(F.sum("_down").alias("_inside"))
    in_file = Window.partitionBy(source).orderBy("_piece")
    joined = pieces.join(steps, place, "left").withColumns({
        "_inside": F.coalesce("_inside", F.lit(0)),
        "_new": F.coalesce(F.col("_head") < F.lag("_tail").over(in_file), F.lit(False)).cast("int"),
    })
    so_far = F.sum(F.col("_new") + F.col("_inside")).over(in_file.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inside")
    years = small_side(joined.select(*place, so_far.alias("_years")))
    every = stepped.drop("_down").unionByName(marked.where("_mixed IS NULL").withColumn("_steps", F.lit(0).cast("long")))
    year = F.lit(first_year) + F.col("_years") + F.col("_steps")
    dated = every.join(years, place).withColumn("event_year", year.cast("int")).drop("_piece", "_month", "_mixed", "_steps", "_years")
    return dated.withColumn("event_time", _header_as(F.col("event_year")))


def window_choice(events: DataFrame, source: str = "source_file") -> DataFrame:
    """Per file: 1-minute windows below an hour of log, else 5-minute ones, and the mean events per address."""
    addresses = events.groupBy(source, "src_ip").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last")
    )
    span = F.unix_micros(F.max("last")) - F.unix_micros(F.min("first"))
    return addresses.groupBy(source).agg(
        F.when(span < 3600 * 1000000, 60).otherwise(300).alias("window_seconds"),
        F.greatest(F.sum("n").cast("double") / F.count(F.lit(1)), F.lit(1.0)).alias("events_per_address"),
    )


def windowed(events: DataFrame, source: str = "source_file") -> DataFrame:
    """Add window_start, window_seconds and events_per_address."""
    joined = events.join(small_side(window_choice(events, source)), source)  # one row per file
    second = F.unix_seconds("event_time")
    start = F.floor(second / F.col("window_seconds")) * F.col("window_seconds")
    return joined.withColumn("window_start", F.timestamp_seconds(start))


def syslog_features(events: DataFrame, source: str = "source_file") -> DataFrame:
    """The fourteen features per (file, window, address) of flagged login events; web features are 0."""
    # parsed once: the window choice needs all events before the first window is known
    needed = [source, "event_time", "src_ip", "username", "is_fail", "is_ok", "is_breakin"]
    base = windowed(checkpointed(events.select(*needed)), source)
    second = F.unix_seconds("event_time")
    bucket = (F.floor(second / BUCKET_SECONDS) * BUCKET_SECONDS).cast("long")
    entries = F.array_compact(F.array(
        F.struct(F.lit("time").alias("kind"), bucket.cast("string").alias("key")),
        F.when(F.col("is_fail"), F.struct(F.lit("user").alias("kind"), F.col("username").alias("key"))),
    ))
    keys = [source, "window_start", "src_ip"]
    mark = F.call_function("shiftleft", F.lit(1), (second % BUCKET_SECONDS).cast("int"))
    event = F.col("kind") == "time"
    records = base.select(
        *keys, "window_seconds", "events_per_address", "is_fail", "is_ok", "is_breakin", mark.alias("_mark"),
        F.inline(entries),
    )
    per_record = records.groupBy(*keys, "kind", "key").agg(
        F.max("window_seconds").alias("window_seconds"), F.max("events_per_address").alias("events_per_address"),
        count_if(event).alias("lines"), count_if(event & F.col("is_fail")).alias("fails"),
        count_if(event & F.col("is_ok")).alias("oks"), F.max("is_breakin").alias("has_breakin"),
        F.bit_or(F.when(event & F.col("is_fail"), F.col("_mark"))).alias("marks"),
    )
    marks = F.when(event & (F.col("marks") > 0),
                   F.struct(F.col("key").cast("long").alias("start"), F.col("marks").alias("marks")))
    counters = checkpointed(per_record.groupBy(*keys).agg(
        F.max("window_seconds").alias("window_seconds"), F.max("events_per_address").alias("events_per_address"),
        F.sum("lines").alias("lines"), F.sum("fails").alias("fails"), F.sum("oks").alias("oks"),
        F.max("has_breakin").alias("has_breakin"), count_if(F.col("kind") == "user").alias("fail_users"),
        F.sort_array(F.collect_list(marks)).alias("marks"),  # at most one entry per ten seconds
    ))
    active = counters.groupBy(source, "window_start").agg(F.count(F.lit(1)).cast("double").alias("global_active_ips"))
    mean, deviation = failure_gaps(_expanded_seconds(F.col("marks")), F.col("fails"))
    zero = F.lit(0.0)
    made = {
        "auth_fail_count": F.col("fails").cast("double"),
        "auth_success_count": F.col("oks").cast("double"),
        "auth_fail_ratio": ratio(F.col("fails"), F.col("fails") + F.col("oks")),
        "distinct_username": F.col("fail_users").cast("double"),
        "fail_interarrival_mean": mean,
        "fail_interarrival_std": deviation,
        "http_req_rate": zero, "http_4xx_ratio": zero, "http_5xx_ratio": zero, "http_post_ratio": zero,
        "distinct_user_agent": zero, "bytes_sent_mean": zero,
        "global_active_ips": F.col("global_active_ips"),
        "burst_rate": F.col("lines") / F.col("events_per_address"),
    }
    end = F.timestamp_seconds(F.unix_seconds("window_start") + F.col("window_seconds"))
    return counters.join(active, [source, "window_start"]).select(
        F.col(source), "window_start", end.alias("timestamp"), "src_ip", F.col("src_ip").alias("entity_id"),
        *[made[name].alias(name) for name in S.FEATURES], "has_breakin",
    )


def with_known_attackers(features: DataFrame, attackers: DataFrame | None) -> DataFrame:
    """Add ``is_known_attacker`` from a label list with ``attacker_ip`` or ``ip``."""
    if attackers is None:
        return features.withColumn("is_known_attacker", F.lit(False))
    column = "attacker_ip" if "attacker_ip" in attackers.columns else "ip"
    known = attackers.select(F.col(column).cast("string").alias("src_ip")).dropna().distinct()
    marked = known.withColumn("_known", F.lit(True))
    return features.join(marked, "src_ip", "left").withColumn(
        "is_known_attacker", F.coalesce("_known", F.lit(False))
    ).drop("_known")


def label_by_rules(features: DataFrame, attackers: DataFrame | None = None) -> DataFrame:
    """Add label, attack_category, label_source and timestamp_source from fixed login rules."""
    marked = with_known_attackers(features, attackers)
    fails, rate, users = F.col("auth_fail_count"), F.col("auth_fail_ratio"), F.col("distinct_username")
    brute = (fails >= 5) | ((fails >= 3) & (rate >= 0.75)) | ((F.col("burst_rate") >= 2.0) & (fails >= 3))
    spraying = (users >= 3) & (fails >= 3)
    rules = [
        (F.col("has_breakin"), "SSH-BreakInAttempt", "explicit_sshd_breakin_alert"),
        (spraying, "SSH-PasswordSpraying", "mitre_t1110_spraying_rule"),
        (brute, "SSH-BruteForce", "mitre_t1110_bruteforce_rule"),
        (F.col("is_known_attacker"), "SSH-KnownAttacker", "external_ground_truth_ip"),
    ]

    def first_rule(position, other):
        choice = F
        for rule in rules:
            choice = choice.when(rule[0], rule[position])
        return choice.otherwise(other)

    category = first_rule(1, "BENIGN")
    return marked.withColumns({
        "attack_category": category,
        "label_source": first_rule(2, "benign_background_traffic"),
        "label": F.when(category == "BENIGN", S.NORMAL).otherwise(S.ANOMALY),
        "timestamp_source": F.lit(TIMESTAMP_SOURCE),
    }).drop("has_breakin", "is_known_attacker")
