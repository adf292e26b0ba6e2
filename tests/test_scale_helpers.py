"""Global order, quantiles, splits and curves against brute force, with skewed input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.operators import metrics as M, resampling as B, significance as G, splits as P
from palisade.operators.joins import severity_in_intervals
from palisade.operators.ordering import SortedSlices, exact_quantiles, first_per_key, numbered_within, running_totals, with_row_number
from palisade.detectors.ocsvm import least_norm_point


def skewed(spark, n=3000):
    """One group and one value hold a third of all rows."""
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n)),
                          "v": np.where(rng.random(n) < 0.34, 0.5, rng.random(n).round(3)), "w": rng.integers(0, 5, n)})
    return frame, spark.createDataFrame(frame).repartition(7)


def test_running_totals_and_numbers(spark):
    pdf, df = skewed(spark)
    ordered = pdf.sort_values(["g", "v", "id"]).reset_index(drop=True)
    got = running_totals(df, ["g", "v", "id"], unique=True, before=F.col("w")).toPandas().set_index("id")["before"]
    assert (got.loc[ordered["id"]].to_numpy() == ordered["w"].cumsum().to_numpy() - ordered["w"].to_numpy()).all()
    by_group = running_totals(df, ["v", "id"], unique=True, by=["g"], before=F.col("w")).toPandas().set_index("id")["before"]
    inside = ordered.groupby("g")["w"].cumsum() - ordered["w"]
    assert (by_group.loc[ordered["id"]].to_numpy() == inside.to_numpy()).all()
    numbers = with_row_number(df, ["g", "v", "id"], unique=True).toPandas().set_index("id")["row_number"]
    assert (numbers.loc[ordered["id"]].to_numpy() == np.arange(len(ordered))).all()
    within = numbered_within(df, "g", ["v", "id"], unique=True).toPandas().set_index("id")["row_number"]
    assert (within.loc[ordered["id"]].to_numpy() == ordered.groupby("g").cumcount().to_numpy()).all()


def test_previous_row_across_slices(spark):
    pdf, df = skewed(spark)
    slices = SortedSlices(df, "v", "id", unique=True)
    got = slices.previous(before="id").orderBy("v", "id").toPandas()["before"]
    want = pdf.sort_values(["v", "id"])["id"].shift(1)
    assert got.isna().sum() == 1 and (got.dropna().to_numpy() == want.dropna().to_numpy()).all()


def test_ties_are_spread(spark):
    same = spark.range(5000).withColumn("k", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small slices would be put together
    try:
        slices = SortedSlices(same, "k")
        sizes = [r["count"] for r in slices.frame.groupBy("_slice").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 5000 and with_row_number(same, ["k"]).select("row_number").distinct().count() == 5000


def test_exact_quantiles(spark):
    pdf, df = skewed(spark)
    steps = [0.0, 0.1, 0.25, 0.5, 0.95, 0.9999, 1.0]
    rows = exact_quantiles(df, ["v", "w"], steps).collect()
    for r in rows:
        assert r["value"] == pytest.approx(np.quantile(pdf[r["name"]], r["probability"]), abs=1e-12)
    assert len(rows) == 14


def test_first_per_key(spark):
    pdf, df = skewed(spark)
    got = first_per_key(df, ["g"], ["v", "id"]).toPandas().sort_values("g")["id"].to_numpy()
    want = pdf.sort_values(["v", "id"]).groupby("g")["id"].first().to_numpy()
    assert (got == want).all()


def brute_ap(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    ap = tp = fp = 0.0
    for value in np.unique(s)[::-1]:
        hit = s == value
        new = y[hit].sum()
        tp, fp = tp + new, fp + (~y[hit].astype(bool)).sum()
        ap += new / y.sum() * tp / (tp + fp)
    return ap


def test_ranking_by_group(spark):
    pdf, df = skewed(spark)
    labelled = df.withColumn("label", (F.col("w") == 0).cast("int"))
    got = {r["g"]: r for r in M.ranking_metrics(labelled, "label", "v", "binary", by=["g"]).collect()}
    for g, part in pdf.groupby("g"):
        y, s = (part["w"] == 0).to_numpy().astype(int), part["v"].to_numpy()
        if y.sum():
            assert got[g]["pr_auc"] == pytest.approx(brute_ap(y, s))
            wins = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
            assert got[g]["roc_auc"] == pytest.approx(wins)


def test_area_does_not_change_under_monotone_maps(spark):
    _, df = skewed(spark)
    labelled = df.withColumn("label", (F.col("w") == 0).cast("int")).withColumn("e", F.exp(F.col("v") * 3))
    a = M.ranking_metrics(labelled, "label", "v", "binary").first()
    b = M.ranking_metrics(labelled, "label", "e", "binary").first()
    assert a["roc_auc"] == pytest.approx(b["roc_auc"]) and a["pr_auc"] == pytest.approx(b["pr_auc"])


def test_polarity_and_thresholds(spark):
    _, df = skewed(spark)
    labelled = df.withColumn("label", (F.col("v") < 0.3).cast("int"))
    turned = M.ranking_metrics(labelled, "label", "v", "binary", align_polarity=True).first()
    assert turned["roc_auc"] == pytest.approx(1.0) and turned["pr_auc"] == pytest.approx(1.0)
    assert M.ranking_metrics(labelled, "label", "v", "binary").first()["roc_auc"] == pytest.approx(0.0)
    good = labelled.withColumn("s", -F.col("v"))
    t = M.pick_threshold(good, "label", "s", "f1", convention="binary")
    row = M.basic_metrics(good.withColumn("p", (F.col("s") >= t).cast("int")), "label", "p", (), "binary", "binary").first()
    assert row["f1"] > 0.97
    nothing = labelled.withColumn("label", F.lit(0))
    assert M.pick_threshold(nothing, "label", "v", "f2", convention="binary") == pytest.approx(
        np.quantile(labelled.select("v").toPandas()["v"], 0.95))
    with pytest.raises(ValueError):
        M.pick_threshold(nothing, "label", "v")


def test_intervals_hold_the_point(spark):
    _, df = skewed(spark)
    labelled = df.withColumn("label", (F.col("v") + F.col("w") / 10 > 0.7).cast("int"))
    one = B.average_precision_interval(labelled, "label", "v", 200, convention="binary").first()
    assert one["ci_low"] < one["point"] < one["ci_high"] and one["n_boot"] == 200
    again = B.average_precision_interval(labelled.repartition(3), "label", "v", 200, convention="binary").first()
    assert abs(again["mean"] - one["mean"]) < 0.01
    guessed = labelled.withColumn("p", (F.col("v") > 0.6).cast("int"))
    for r in B.classification_intervals(guessed, "label", "p", 300, label_convention="binary", prediction_convention="binary").collect():
        assert r["ci_low"] <= r["point"] <= r["ci_high"]


def test_paired_tests(spark):
    a = [1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30]
    b = [0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    row = G.wilcoxon_tests(df, [("a", "b")]).first()
    assert row["statistic"] == 5 and row["p_value"] == pytest.approx(0.0390625)  # published example
    t = G.paired_t_tests(df, [("a", "b")]).first()
    d = np.array(a) - np.array(b)
    assert t["t_statistic"] == pytest.approx(d.mean() / (d.std(ddof=1) / 3))
    assert G.t_two_sided(2.306, 8) == pytest.approx(0.05, abs=1e-4) and G.t_two_sided(0.0, 5) == pytest.approx(1.0)
    same = G.wilcoxon_tests(df.withColumn("b", F.col("a")), [("a", "b")]).first()
    assert (same["statistic"], same["p_value"], same["significant"]) == (0, 1.0, False)
    flat = G.paired_t_tests(df.withColumn("b", F.col("a")), [("a", "b")]).first()
    assert (flat["t_statistic"], flat["p_value"]) == (0, 1.0)


def test_split_parts_are_disjoint(spark):
    _, df = skewed(spark)
    framed = df.select("id", F.col("g").cast("string").alias("entity_id"), F.timestamp_seconds(F.col("id") % 500).alias("timestamp"),
                       F.when(F.col("w") == 0, "Anomaly").otherwise("Normal").alias("label"))
    split = P.temporal_split(framed, entity_disjoint=True)
    assert not any(P.entity_overlap(split).first())
    times = split.groupBy("split").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).toPandas().set_index("split")
    assert times.loc["train", "b"] < P.temporal_split(framed).where("split = 'test'").agg(F.min("timestamp")).first()[0]
    again = P.temporal_split(framed.repartition(3), entity_disjoint=True)
    assert again.exceptAll(split).count() == 0
    with pytest.raises(ValueError):
        P.temporal_split(framed, (0.5, 0.2, 0.2))
    with pytest.raises(ValueError):
        P.check_splits(P.temporal_split(framed), {})
    sizes = {r["split"]: r["count"] for r in P.random_split(spark.range(80), ["id"]).groupBy("split").count().collect()}
    assert sizes == {"train": 56, "test": 24}
    assert P.spaced_rows(framed, ["id"], 100).count() == 100


def test_rows_without_time_come_last(spark):
    frame = spark.createDataFrame([(i, float(i) if i < 8 else None) for i in range(10)], "id int, t double")
    framed = frame.withColumn("timestamp", F.timestamp_seconds("t"))
    got = {r["id"]: r["split"] for r in P.temporal_split(framed).collect()}
    assert [got[i] for i in range(10)] == ["train"] * 6 + ["validation"] * 2 + ["test"] * 2


def test_severity_in_long_intervals(spark):
    rng = np.random.default_rng(3)
    events = pd.DataFrame({"source_ip": np.where(rng.random(800) < 0.4, "hot", "cold"), "at": rng.integers(0, 50000, 800), "severity": rng.integers(0, 15, 800)})
    spans = pd.DataFrame({"id": range(60), "src_ip": np.where(rng.random(60) < 0.5, "hot", "none"), "a": rng.integers(0, 40000, 60)})
    spans["b"] = spans["a"] + rng.integers(0, 20000, 60)
    e = spark.createDataFrame(events).withColumn("timestamp", F.timestamp_seconds("at"))
    s = spark.createDataFrame(spans).withColumns({"start_time": F.timestamp_seconds("a"), "end_time": F.timestamp_seconds("b")})
    got = {r["id"]: r["max_severity"] for r in severity_in_intervals(s, e, 3600).collect()}
    for r in spans.itertuples():
        hit = events[(events.source_ip == r.src_ip) & (events["at"] >= r.a) & (events["at"] <= r.b)]
        assert got[r.id] == (hit.severity.max() if len(hit) else 0)


def test_least_norm_point_is_the_mean_when_all_rows_weigh_alike():
    points = np.random.default_rng(0).normal(3, 1, (50, 4))
    assert np.allclose(least_norm_point(points, 1.0), points.mean(axis=0))
    inner = least_norm_point(points, 0.1)
    assert np.linalg.norm(inner) < np.linalg.norm(points.mean(axis=0))


def test_quantiles_sort_few_values(spark, monkeypatch):
    """Distinct values, one value in a third of all rows, infinities, NULL and NaN; only values near the ranks are sorted."""
    from palisade.operators import ordering

    rng = np.random.default_rng(5)
    n = 120_000
    plain = rng.normal(size=n)
    hot = np.where(rng.random(n) < 0.34, 0.25, rng.random(n))
    edge = np.where(rng.random(n) < 0.01, -np.inf, np.where(rng.random(n) < 0.01, np.inf, plain))
    df = spark.createDataFrame(pd.DataFrame({"a": plain, "b": hot, "c": edge})).repartition(5)
    df = df.withColumns({"d": F.when(F.col("a") > 1, F.col("a")).when(F.col("a") < -1, F.lit(float("nan"))), "e": F.lit(None).cast("double")})
    sorted_rows = []
    pick = ordering.values_in_cells
    monkeypatch.setattr(ordering, "values_in_cells", lambda *args: sorted_rows.append(pick(*args)) or sorted_rows[-1])
    steps = [0.0, 0.001, 0.3, 0.5, 0.77, 0.999, 1.0]
    got = ordering.quantile_values(df, ["a", "b", "c", "d", "e"], steps)
    kept = {"a": plain, "b": hot, "c": edge, "d": plain[plain > 1]}
    assert {c for c, _ in got} == set(kept)
    for (c, p), value in got.items():
        position = p * (len(kept[c]) - 1)
        low, high = np.sort(kept[c])[[int(np.floor(position)), int(np.ceil(position))]]
        assert value == pytest.approx(low if low == high else low + (high - low) * (position - np.floor(position)), abs=1e-12)
    assert sum(f.count() for f in sorted_rows) < 0.02 * 4 * n


def test_quantiles_of_equal_and_few_values(spark):
    from palisade.operators.ordering import quantile_table

    same = spark.range(5000).select(F.lit(3.0).alias("v"), (F.col("id") % 2).cast("double").alias("w"))
    assert quantile_table(same, ["v", "w"], [0.1, 0.5, 0.9]) == {"v": [3.0] * 3, "w": [0.0, 0.5, 1.0]}
    assert quantile_table(same.limit(1), ["v"], [0.3]) == {"v": [3.0]}
    assert quantile_table(same.limit(0), ["v"], [0.3]) == {"v": [None]}


def all_signs(differences):
    """Two-sided exact tail of the signed-rank test by going through all sign patterns."""
    import itertools

    d = np.array([x for x in differences if x != 0])
    size = np.abs(d)
    ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    sums = np.array([ranks[list(np.flatnonzero(signs))].sum() for signs in itertools.product([0, 1], repeat=len(d))])
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    return w, min(1.0, 2 * (sums <= w + 1e-9).mean())


@pytest.mark.parametrize("values", [[1.0, -2.0, 3.0, 4.0, -5.5], [1.0, 1.0, -1.0, 2.0, 2.0, -2.0, 0.0, 3.0, 0.0], [0.5] * 8, [0.0, 0.0], [2.0]])
def test_exact_signed_ranks_with_ties_and_zeros(spark, values):
    df = spark.createDataFrame([(v, 0.0) for v in values], "a double, b double")
    got = G.wilcoxon_tests(df, [("a", "b")], method="exact").first()
    if any(values):
        w, p = all_signs(values)
        assert got["statistic"] == w and got["p_value"] == pytest.approx(p)
    else:
        assert got["p_value"] == 1.0


def test_the_caller_chooses_the_tail(spark):
    import math

    rng = np.random.default_rng(3)
    for n in (50, 51):  # both sides of the automatic choice
        df = spark.createDataFrame([(float(v), 0.0) for v in rng.normal(0.2, 1, n)], "a double, b double")
        rows = {m: G.wilcoxon_tests(df, [("a", "b")], method=m, few=60).first() for m in ("auto", "exact", "normal")}
        assert rows["auto"] == rows["exact"]  # the bound is the caller's
        assert rows["exact"]["p_value"] == pytest.approx(rows["normal"]["p_value"], abs=0.02)
        usual = G.wilcoxon_tests(df, [("a", "b")]).first()
        assert usual["p_value"] == pytest.approx(rows["exact" if n == 50 else "normal"]["p_value"])
    with pytest.raises(Exception, match="at most 50"):
        G.wilcoxon_tests(df, [("a", "b")], method="exact").collect()
    with pytest.raises(ValueError):
        G.wilcoxon_tests(df, [("a", "b")], method="other")
    grid = [0.0, 1e-9, 0.3, 1.96, 4.2, 4.25, 6.0, 9.0, 30.0, 45.0]
    frame = spark.createDataFrame([(z,) for z in grid], "z double").select("z", G.normal_tail(F.col("z")).alias("p"))
    for z, p in frame.collect():
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9, abs=1e-300)


def test_first_rows_move_the_order_once(spark):
    """The order columns are in the compared row only; NULLs, ties and texts behave as before."""
    rows = [(1, None, "b", 1.0), (1, 3, "a", 2.0), (2, 5, "z", None), (2, 5, "c", 4.0), (None, 7, "q", 1.5), (None, 7, "q", 1.5)]
    df = spark.createDataFrame(rows, "k long, t long, name string, v double")
    first = first_per_key(df, ["k"], ["t", "name"])
    assert first._jdf.queryExecution().optimizedPlan().toString().count("min_by") == 0
    assert {tuple(r) for r in first.collect()} == {(1, None, "b", 1.0), (2, 5, "c", 4.0), (None, 7, "q", 1.5)}
    newest = first_per_key(df, ["k"], ["t", "name"], newest=True)
    assert {tuple(r) for r in newest.collect()} == {(1, 3, "a", 2.0), (2, 5, "z", None), (None, 7, "q", 1.5)}
    mapped = df.withColumn("m", F.create_map(F.lit("x"), F.col("v")))  # maps have no order
    assert {r.m["x"] for r in first_per_key(mapped, ["k"], ["t", "name"]).collect()} == {1.0, 4.0, 1.5}
    descending = first_per_key(df, ["k"], [-F.col("t"), F.col("name")])
    assert {r.name for r in descending.collect()} == {"b", "c", "q"}


def test_sorted_slices_are_packed(spark):
    """Plain columns go into compressed files, others into a checkpoint; the rows stay."""
    df = spark.range(500).selectExpr("id", "CAST(id % 3 AS STRING) AS g", "id / 7 AS v")
    plain, dated = SortedSlices(df, "g", "id"), SortedSlices(df.selectExpr("*", "DATE '1500-01-01' AS d"), "g", "id")
    assert plain.frame.inputFiles() and not dated.frame.inputFiles()
    for slices in (plain, dated):
        got = {r.id: r.n for r in slices.numbered("n", ["g"]).collect()}
        assert got == {i: i // 3 for i in range(500)}


def test_tasks_of_a_scan_are_bounded_by_bytes(spark, tmp_path):
    from palisade.session import spread, stored_bytes

    spark.range(200_000).selectExpr("id", "uuid() AS u").repartition(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = stored_bytes(df)
    dealt = spread(df, size // 40)
    assert dealt.rdd.getNumPartitions() >= 40 and dealt.exceptAll(df).isEmpty() and dealt.count() == 200_000
    assert spread(df).rdd.getNumPartitions() >= 8
