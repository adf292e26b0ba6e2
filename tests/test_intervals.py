"""Interval joins over hierarchical time buckets: brute force, one hot address, sizes of the joins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.operators import dashboards as D, joins as J


@pytest.mark.parametrize("levels", [0, 1, 2, 4])
def test_cover(spark, levels):
    rng = np.random.default_rng(levels)
    spans = sorted({(int(a), int(a + n)) for a, n in zip(rng.integers(0, 700, 300), rng.integers(1, 600, 300))} | {(0, 1), (7, 9), (8, 16), (0, 512), (63, 65)})
    frame = spark.createDataFrame(spans, "a long, b long").withColumn("cover", J.bucket_cover(F.col("a"), F.col("b"), levels))
    for a, b, cover in frame.collect():
        units = [u for level, k in cover for u in range(k * 8 ** level, (k + 1) * 8 ** level)]
        assert sorted(units) == list(range(a, b))
        below = [level for level, _ in cover if level < levels]
        assert len(below) <= 14 * levels
    held = spark.createDataFrame([(300,)], "u long").select(J.own_buckets(F.col("u"), 3, -1)).first()[0]
    assert [tuple(x) for x in held] == [(-1, 300), (0, 300), (1, 37), (2, 4), (3, 0)]


def hot_tables(spark, n=4000, m=300):
    rng = np.random.default_rng(9)
    micros = rng.integers(0, 5 * 86400 * 10**6, n)
    micros[:200] = micros[0] + np.arange(200)  # many events of one second
    events = pd.DataFrame({"source_ip": np.where(rng.random(n) < 0.9, "hot", "cold"), "at": micros, "severity": rng.integers(0, 15, n)})
    spans = pd.DataFrame({"id": range(m), "src_ip": np.where(rng.random(m) < 0.8, "hot", "none"), "a": rng.integers(0, 5 * 86400 * 10**6, m)})
    spans["b"] = spans["a"] + np.where(rng.random(m) < 0.5, rng.integers(-5, 3000, m), rng.integers(0, 86400 * 10**6 * 2, m))
    spans.loc[0, ["a", "b"]] = [micros[0] + 50, micros[0] + 60]
    spans.loc[1, ["a", "b"]] = [micros[0] // 10**6 * 10**6, micros[0] // 10**6 * 10**6 + 10**6 - 1]  # one whole second
    e = spark.createDataFrame(events).withColumn("timestamp", F.timestamp_micros("at"))
    s = spark.createDataFrame(spans).withColumns({"start_time": F.timestamp_micros("a"), "end_time": F.timestamp_micros("b")})
    return events, spans, e, s


@pytest.mark.parametrize("seconds", [1, 60, 86400])
def test_severity_under_a_hot_address(spark, seconds):
    events, spans, e, s = hot_tables(spark)
    got = {r["id"]: r["max_severity"] for r in J.severity_in_intervals(s, e, seconds).collect()}
    for r in spans.itertuples():
        hit = events[(events.source_ip == r.src_ip) & (events["at"] >= r.a) & (events["at"] <= r.b)]
        assert got[r.id] == (hit.severity.max() if len(hit) else 0)
    assert J.severity_in_intervals(s.limit(0), e, seconds).count() == 0
    assert J.severity_in_intervals(s, e.limit(0), seconds).where("max_severity <> 0").count() == 0


def test_rows_of_the_interval_join(spark):
    """One-minute intervals over a day of an address with nearly all events: rows in proportion to the intervals."""
    n = 20_000
    e = spark.range(n).select(F.lit("hot").alias("source_ip"), F.timestamp_millis(F.col("id") * 4000).alias("timestamp"), (F.col("id") % 9).cast("int").alias("severity"))
    s = spark.range(1300).select("id", F.lit("hot").alias("src_ip"), F.timestamp_seconds(F.col("id") * 60).alias("start_time"), F.timestamp_seconds(F.col("id") * 60 + 59).alias("end_time"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = J.severity_in_intervals(s, e)
        made.collect()
        nodes = made._jdf.queryExecution().executedPlan()
        rows, waiting = [], [nodes]
        while waiting:
            node = waiting.pop()
            if "Join" in node.nodeName():
                rows.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            waiting += [children.apply(i) for i in range(children.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) >= 2 and max(rows) <= n


def test_overlay(spark):
    events, spans, e, s = hot_tables(spark, 900, 120)
    chart = e.select(F.col("timestamp").alias("time"), "at", F.col("severity").alias("n"))
    scenarios = s.select("id", "start_time", "end_time")
    for seconds in (1, 3600):
        got = sorted((r["at"], r["id"]) for r in D.overlay(chart, scenarios, seconds).select("at", "id").collect())
        want = sorted((at, r.id) for at in events["at"] for r in spans.itertuples() if r.a <= at <= r.b)
        assert got == want
