"""Detectors: planted outliers, shares, stored models, sweeps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade import schema as S
from palisade.detectors import cascade as C, iforest as T, ocsvm as O, sweeps as W
from palisade.detectors.preprocess import Scaler, fit_scaler
from palisade.operators.metrics import ranking_metrics
from palisade.plans import serve as V, train as P
from palisade.sinks.registry import ModelRegistry

NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    rows = np.vstack([rng.normal(0, 0.5, (900, 5)), rng.normal(6, 2, (100, 5))])
    frame = pd.DataFrame(rows, columns=NAMES)
    frame["label"] = ["Normal"] * 900 + ["Anomaly"] * 100
    return spark.createDataFrame(frame).cache()


def test_scaler(spark, tmp_path):
    frame = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (None, None)], "a double, b double")
    scaler = fit_scaler(frame, ["a", "b"])
    assert scaler.medians == [2.0, 0.0] and scaler.means[0] == pytest.approx(2.25) and scaler.scales[1] == 1.0
    out = scaler.transform(frame)
    assert out.agg(F.avg("a")).first()[0] == pytest.approx(0) and out.agg(F.stddev_pop("a")).first()[0] == pytest.approx(1)
    scaler.save(spark, str(tmp_path / "s"))
    assert Scaler.load(spark, str(tmp_path / "s")) == scaler


def test_path_length_of_a_small_tree():
    assert T.average_path(2) == 1 and T.average_path(1) == 0
    assert float(T.average_path(256)) == pytest.approx(10.244770, abs=1e-5)
    nodes = pd.DataFrame([(0, 0, 0, 0.5, 1, 2, 4, 0), (0, 1, -1, 0.0, -1, -1, 1, 1), (0, 2, 0, 0.8, 3, 4, 3, 1),
                          (0, 3, -1, 0.0, -1, -1, 2, 2), (0, 4, -1, 0.0, -1, -1, 1, 2)],
                         columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    forest = T.Forest.from_nodes(nodes, ["x"], {}, 4)
    paths = -np.log2(forest.anomaly(np.array([[0.1], [0.6], [0.9]]))) * float(T.average_path(4))
    assert np.allclose(paths, [1, 3, 2])


def test_forest(planted):
    forest = T.fit_iforest(planted.where("label = 'Normal'"), NAMES)
    assert len(forest.roots) == 200 and forest.sample_size == 256 and forest.levels.max() <= 8
    scored = T.score_iforest(planted, forest)
    assert ranking_metrics(scored, "label", "iforest_anomaly").first()["roc_auc"] > 0.99
    share = scored.where("label = 'Normal'").agg(F.avg((F.col("iforest_label") == -1).cast("double"))).first()[0]
    assert share == pytest.approx(0.02, abs=0.003)
    low, high = scored.agg(F.min("iforest_score"), F.max("iforest_score")).first()
    assert -1 <= low <= high <= 0


def test_offered_rows_are_fair(spark):
    rows = spark.range(20000).select(F.col("id").cast("double").alias("x")).repartition(5)
    sample = T.offered_rows(rows, ["x"], [(0, t) for t in range(50)], 0.01, 7).toPandas()
    per_tree = sample.groupby("tree").size()
    assert len(per_tree) == 50 and abs(per_tree.mean() - 200) < 10 and not sample.duplicated(["tree", "x"]).any()
    assert abs(sample["x"].mean() - 10000) < 300


def test_boundary(planted):
    normal = planted.where("label = 'Normal'")
    bound = O.fit_ocsvm(normal, NAMES, {"nu": 0.05})
    scored = O.score_ocsvm(planted, bound)
    assert ranking_metrics(scored, "label", "ocsvm_anomaly").first()["roc_auc"] > 0.98
    share = scored.where("label = 'Normal'").agg(F.avg((F.col("ocsvm_label") == -1).cast("double"))).first()[0]
    assert share == pytest.approx(0.05, abs=0.005)


def exact_margins(points, nu, gamma, steps=4000):
    """One-class dual by pairwise updates, for comparison."""
    n = len(points)
    kernel = np.exp(-gamma * ((points[:, None] - points[None]) ** 2).sum(-1))
    cap = 1 / (nu * n)
    alpha = np.full(n, 1 / n)
    gradient = kernel @ alpha
    for _ in range(steps):
        up, down = np.where(alpha < cap - 1e-12)[0], np.where(alpha > 1e-12)[0]
        i, j = up[gradient[up].argmin()], down[gradient[down].argmax()]
        curve = kernel[i, i] + kernel[j, j] - 2 * kernel[i, j]
        step = min((gradient[j] - gradient[i]) / max(curve, 1e-12), cap - alpha[i], alpha[j])
        if step < 1e-12:
            break
        alpha[i] += step
        alpha[j] -= step
        gradient += step * (kernel[:, i] - kernel[:, j])
    return gradient


def test_boundary_agrees_with_the_exact_kernel_problem(spark):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(0, 1, (270, 2)), rng.uniform(-5, 5, (30, 2))])
    frame = spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]).assign(i=range(300)))
    bound = O.fit_ocsvm(frame, ["x", "y"], {"nu": 0.1, "gamma": 0.25})
    ours = O.score_ocsvm(frame, bound).toPandas().sort_values("i")["ocsvm_score"]
    want = pd.Series(exact_margins(points, 0.1, 0.25))
    assert np.corrcoef(ours, want)[0, 1] > 0.95
    lowest = lambda values: set(np.argsort(np.asarray(values))[:15])
    assert len(lowest(ours) & lowest(want)) >= 12


def test_cascade(spark, planted, tmp_path):
    model = C.fit_cascade(planted, NAMES, "label", planted, uncertainty_margin=0.05)
    detailed = model.predict_detailed(planted).cache()
    assert ranking_metrics(detailed, "label", "anomaly_score").first()["pr_auc"] > 0.9
    low, high = detailed.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 <= low <= high <= 1
    assert detailed.where("predicted_label = 'Uncertain' AND prediction_status <> 'UNCERTAIN'").count() == 0
    gate = model.gate_statistics(planted.where("label = 'Normal'")).first()
    assert gate["gate_rate_actual"] == pytest.approx(0.2, abs=1 / 900 ** 0.5) and gate["rows_without_stage2"] > 450
    ids = planted.withColumns({"src_ip": F.lit("x"), "window_start": F.lit("w")})
    assert {"src_ip", "window_start", "stage2_score"} <= set(model.predict_with_details(ids).columns)
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    for n in range(4):
        registry.register(model, None, {"f1_score": n})
    assert registry.catalog().count() == 3 and registry.versions().count() == 1 and registry.latest_version() == "cascade-v1.0"
    again, _ = registry.load()
    ours = model.score(planted).agg(F.sum("anomaly_score")).first()[0]
    assert again.score(planted).agg(F.sum("anomaly_score")).first()[0] == pytest.approx(ours)
    with pytest.raises(FileNotFoundError):
        registry.load("none")
    with pytest.raises(ValueError):
        C.fit_cascade(planted.where("label = 'Anomaly'"), NAMES, "label")


def test_rank_column_equals_interpolation(spark):
    knots = sorted(np.random.default_rng(0).random(21).round(2).tolist())
    values = [-1.0, *knots, 0.333, 0.5, 2.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in frame.select(C.empirical_rank_column(F.col("v"), knots)).collect()]
    assert np.allclose(got, np.interp(values, knots, np.linspace(0, 1, 21)))
    assert np.allclose(C.empirical_rank(np.array([0.0, 5.0, np.nan]), None, 0.0, 10.0), [0, 0.5, 0])


def test_sweeps(planted):
    normal = planted.where("label = 'Normal'")
    gates = W.gate_rate_sweep(normal, planted, planted, NAMES, gate_rates=(0.1, 0.5, 1.0)).toPandas()
    assert list(gates["gate_rate"]) == [0.1, 0.5, 1.0] and gates["stage2_rows_saved"].is_monotonic_decreasing
    sens = W.hyperparameter_sensitivity(normal, planted, planted, NAMES).toPandas()
    flat = sens[sens["param"] == "contamination"]
    assert len(sens) == 15 and flat["pr_auc"].nunique() == 1  # contamination moves no gate and no rank
    drop = W.feature_group_ablation(normal, planted, planted, NAMES, {"one": ["a"], "all": NAMES}).toPandas()
    assert list(drop["config"]) == ["full_14_features", "minus_one"] and drop["delta_pr_auc"][0] == 0
    found = W.grid_search_iforest(normal, planted, NAMES, {"n_estimators": [20, 40]}, "label")
    assert found["best_score"] > 0.9 and len(found["results"]) == 2
    spread = W.grid_search_ocsvm(normal, normal, NAMES, {"nu": [0.05], "gamma": ["scale"]}, "label")
    assert spread["best_score"] > 0


def test_training_and_inference(spark):
    rng = np.random.default_rng(14)
    frame = pd.DataFrame(rng.random((100, 14)), columns=S.FEATURES)
    frame["label"] = ["attack"] * 20 + ["benign"] * 80
    frame["src_ip"] = [f"10.0.0.{i % 10}" for i in range(100)]
    frame["window_start"] = pd.date_range("2024-01-01", periods=100, freq="min")
    rows = spark.createDataFrame(frame)
    made = P.run_training(rows, frac=(0.7, 0.0, 0.3), iforest={"n_estimators": 20})
    counts = {r["split"]: r["count"] for r in made["split"].groupBy("split").count().collect()}
    assert counts == {"train": 56, "test": 44}
    out = V.infer_on_features(rows.drop("label"), made["model"], made["scaler"])
    assert out.count() == 100 and out.where("risk_score < 0 OR risk_score > 100").count() == 0
    with pytest.raises(ValueError):
        V.infer_on_features(rows.drop("burst_rate"), made["model"], made["scaler"])
