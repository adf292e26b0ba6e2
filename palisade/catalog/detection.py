"""Preprocessing and detectors.

Models are fitted on tables derived from the given ones and kept per session, so that queries which
look at the same model do not fit it again.
"""

from pyspark.sql import functions as F

from palisade import schema as S
from palisade.catalog import inputs as I
from palisade.catalog.logs import _day_features
from palisade.catalog.registry import query
from palisade.catalog.sqltext import r, with_inputs
from palisade.detectors import cascade as C, comparison as X, iforest as T, ocsvm as O, sweeps as W
from palisade.detectors.preprocess import Scaler, fit_scaler
from palisade.operators.ordering import quantile_table
from palisade.operators.splits import TEST, TRAIN, VALIDATION, part, temporal_split
from palisade.plans import serve as V, train as P
from palisade.session import checkpointed, scratch_path, spread
from palisade.sinks.registry import ModelRegistry

_KEPT: dict = {}


def kept(spark, sf_dir, name, build):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def forget() -> None:
    """Drop what was kept, so that the next query fits its own models."""
    _KEPT.clear()


def labelled_days(spark, sf_dir):
    """Day features; two or more failures in a day make it an anomaly."""
    def build():
        made = _day_features(spark, sf_dir)
        label = F.when(F.col("auth_fail_count") >= 2, S.ANOMALY).otherwise(S.NORMAL)
        return checkpointed(made.withColumn("label", label))

    return kept(spark, sf_dir, "days", build)


def parts(spark, sf_dir):
    """Scaled training, validation and test parts in time order."""
    def build():
        split = checkpointed(temporal_split(labelled_days(spark, sf_dir), time="window_start"))
        train = part(split, TRAIN).where(F.col("label") == S.NORMAL)
        scaler = fit_scaler(train)
        return scaler, [checkpointed(scaler.transform(p)) for p in (train, part(split, VALIDATION), part(split, TEST))], split

    return kept(spark, sf_dir, "parts", build)


def day_model(spark, sf_dir):
    def build():
        _, (train, validation, _), _ = parts(spark, sf_dir)
        return C.fit_cascade(train, label="label", validation=validation, uncertainty_margin=0.05)

    return kept(spark, sf_dir, "model", build)


ITEMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEM_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def item_matrix(spark, sf_dir):
    """Scaled line items; one row in five hundred is stretched so that it stands out."""
    def build():
        wide = spread(I.table(spark, sf_dir, "lineitem"))
        planted = F.col("l_orderkey") % 500 == 0
        rows = wide.select(*ITEM_KEYS, *[F.when(planted, F.col(c) * 20).otherwise(F.col(c)).alias(c) for c in ITEMS],
                           planted.alias("planted"))
        return checkpointed(fit_scaler(rows, ITEMS).transform(rows))

    return kept(spark, sf_dir, "items", build)


def item_forest(spark, sf_dir):
    return kept(spark, sf_dir, "forest", lambda: T.fit_iforest(item_matrix(spark, sf_dir), ITEMS, keys=ITEM_KEYS))


def item_boundary(spark, sf_dir):
    return kept(spark, sf_dir, "boundary", lambda: O.fit_ocsvm(item_matrix(spark, sf_dir), ITEMS))


# --- preprocessing ---------------------------------------------------------------------------------------

_SCALER = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, quantile_cont({f}, 0.5) AS median, avg(coalesce({f}, m)) AS mean, "
    f"CASE WHEN stddev_pop(coalesce({f}, m)) = 0 THEN 1 ELSE stddev_pop(coalesce({f}, m)) END AS scale "
    f"FROM vectors, (SELECT quantile_cont({f}, 0.5) AS m FROM vectors)" for f in S.FEATURES)


@query("M02_stored_scaler", with_inputs(f"SELECT feature, {r('median', 'median')}, {r('mean', 'mean')}, {r('scale', 'scale')} FROM ({_SCALER})", "vectors"))
def stored_scaler(spark, sf_dir):
    path = scratch_path(spark, "scaler")
    fit_scaler(I.vectors(spark, sf_dir)).save(spark, path)
    return Scaler.load(spark, path).table(spark).drop("position")


_SCALED = ["fail_interarrival_mean", "burst_rate", "http_req_rate", "auth_fail_ratio"]


@query("M01_scaled_features", with_inputs(f"""WITH s AS ({_SCALER})
SELECT row_id, {', '.join(r(f"(coalesce({f}, (SELECT median FROM s WHERE feature = '{f}')) - (SELECT mean FROM s WHERE feature = '{f}')) / (SELECT scale FROM s WHERE feature = '{f}')", f) for f in _SCALED)}
FROM vectors""", "vectors"))
def scaled_features(spark, sf_dir):
    vectors = I.vectors(spark, sf_dir)
    return fit_scaler(vectors).transform(vectors).select("row_id", *_SCALED)


# --- single detectors --------------------------------------------------------------------------------------


@query("M03_forest_trees")
def forest_trees(spark, sf_dir):
    """Shape of every tree of a forest over all line items."""
    nodes = item_forest(spark, sf_dir).node_table(spark)
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"),
                                     F.max("size").alias("rows"))


@query("M04_forest_scores")
def forest_scores(spark, sf_dir):
    scored = T.score_iforest(item_matrix(spark, sf_dir), item_forest(spark, sf_dir))
    return scored.select(*ITEM_KEYS, "planted", "iforest_score", "iforest_decision", "iforest_anomaly", "iforest_label")


@query("M05_boundary_scores")
def boundary_scores(spark, sf_dir):
    scored = O.score_ocsvm(item_matrix(spark, sf_dir), item_boundary(spark, sf_dir))
    return scored.select(*ITEM_KEYS, "planted", "ocsvm_score", "ocsvm_anomaly", "ocsvm_label")


@query("M05_wide_vectors")
def wide_vectors(spark, sf_dir):
    """Both detectors over the 64 columns of the embeddings."""
    table = I.table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(64)]
    rows = checkpointed(table.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]))
    scored = O.score_ocsvm(T.score_iforest(rows, T.fit_iforest(rows, names)), O.fit_ocsvm(rows, names))
    return scored.select("vec_id", "iforest_anomaly", "ocsvm_anomaly")


# --- cascade ---------------------------------------------------------------------------------------------------


@query("M06_cascade_parameters")
def cascade_parameters(spark, sf_dir):
    m = day_model(spark, sf_dir)
    return spark.createDataFrame(
        [(m.gate_rate, m.gate_threshold, m.normal_threshold, m.threshold, m.tau_low, m.tau_high)],
        "gate_rate double, gate_threshold double, normal_threshold double, threshold double, tau_low double, tau_high double")


def _test_part(spark, sf_dir):
    return parts(spark, sf_dir)[1][2]


@query("M07_predict_detailed")
def predict_detailed(spark, sf_dir):
    made = day_model(spark, sf_dir).predict_detailed(_test_part(spark, sf_dir))
    return made.select("window_start", "src_ip", "stage1_score", "stage2_score", "anomaly_score", "confidence_margin",
                       "prediction_status", "predicted_label")


@query("M10_predict_with_details")
def predict_with_details(spark, sf_dir):
    return day_model(spark, sf_dir).predict_with_details(_test_part(spark, sf_dir))


@query("M10_score")
def cascade_score(spark, sf_dir):
    return day_model(spark, sf_dir).score(_test_part(spark, sf_dir)).select("window_start", "src_ip", "anomaly_score")


@query("F18_predict_risk")
def predict_risk(spark, sf_dir):
    framed = _test_part(spark, sf_dir).withColumn("severity_weight", F.lit(7.0))
    return day_model(spark, sf_dir).predict_risk(framed).select("window_start", "src_ip", "anomaly_score", "risk_score")


_GRID = ", ".join(repr(p) for p in C.GRID)


@query("M08_empirical_rank", with_inputs(f"""WITH k AS (SELECT quantile_cont(score, [{_GRID}]) AS q FROM scored WHERE timestamp < TIMESTAMP '1999-01-01')
SELECT row_id, {r("CASE WHEN n = 0 THEN 0 WHEN n > 500 THEN 1 ELSE (n - 1 + (score - q[n]) / (q[n + 1] - q[n])) / 500 END", 'place')}
FROM (SELECT row_id, score, q, len(list_filter(q, lambda x: x <= score)) AS n FROM scored, k)""", "scored"))
def empirical_rank(spark, sf_dir):
    """Place of each score among the quantiles of the earlier rows."""
    scored = I.scored(spark, sf_dir)
    early = scored.where(F.col("timestamp") < F.lit("1999-01-01").cast("timestamp_ntz"))
    knots = quantile_table(early, ["score"], C.GRID)["score"]
    return scored.select("row_id", C.empirical_rank_column(F.col("score"), knots).alias("place"))


@query("M09_fused_score", with_inputs(f"""SELECT row_id, {r('CASE WHEN score >= 0.6 THEN 0.4 * score + 0.6 * other_score ELSE score END', 'fused')} FROM scored""", "scored"))
def fused_score(spark, sf_dir):
    score, other = F.col("score"), F.col("other_score")
    return I.scored(spark, sf_dir).select("row_id", C.fused_score(score >= 0.6, score, other, 0.4).alias("fused"))


@query("M11_gate_statistics", with_inputs(f"""SELECT count(*) AS n_samples, {r('avg(CASE WHEN score >= 0.8 THEN 1.0 ELSE 0 END)', 'gate_rate_actual')},
  CAST(count(*) FILTER (score < 0.8) AS BIGINT) AS rows_without_stage2 FROM scored""", "scored"))
def gate_statistics(spark, sf_dir):
    staged = I.scored(spark, sf_dir).withColumn("stage2_score", F.when(F.col("score") >= 0.8, F.col("other_score")))
    return C.gate_statistics(staged)


@query("M20_score_spread", with_inputs(f"SELECT {r('stddev_pop(score)', 'score')} FROM scored", "scored"))
def score_spread(spark, sf_dir):
    """Without two classes a detector is judged by the spread of its scores."""
    value = W._grid_values(I.scored(spark, sf_dir), None, {"score": 0.5}, "pr_auc")
    return spark.createDataFrame([(value["score"],)], "score double")


# --- searches and studies ------------------------------------------------------------------------------------------


def _rows(spark, found):
    table = [(str(sorted((k, str(v)) for k, v in e.items() if k != "score")), e["score"]) for e in found["results"]]
    return spark.createDataFrame(table, "params string, score double")


@query("M12_grid_search_iforest")
def grid_search_iforest(spark, sf_dir):
    _, (train, validation, _), _ = parts(spark, sf_dir)
    return _rows(spark, W.grid_search_iforest(train, validation, label="label"))


@query("M12_grid_search_ocsvm")
def grid_search_ocsvm(spark, sf_dir):
    _, (train, validation, _), _ = parts(spark, sf_dir)
    return _rows(spark, W.grid_search_ocsvm(train, validation, label="label"))


@query("M13_hyperparameter_search")
def hyperparameter_search(spark, sf_dir):
    _, (train, validation, _), _ = parts(spark, sf_dir)
    return W.hyperparameter_search(train, validation)["table"].select("config", "f1", "pr_auc", "gate_rate_actual", "threshold")


@query("M14_grid_search_cascade")
def grid_search_cascade(spark, sf_dir):
    _, (train, validation, _), _ = parts(spark, sf_dir)
    found = W.grid_search_cascade(train, validation, [70, 80, 90], iforest_grid={"n_estimators": [100, 200]}, ocsvm_grid={"nu": [0.02, 0.05]})
    return found["table"].select("config", "f1", "pr_auc", "gate_rate_actual", "threshold")


@query("M15_gate_rate_sweep")
def gate_rate_sweep(spark, sf_dir):
    return W.gate_rate_sweep(*parts(spark, sf_dir)[1])


@query("M16_ablation_study")
def ablation_study(spark, sf_dir):
    _, (train, _, test), _ = parts(spark, sf_dir)
    return X.ablation_study(train, test)


@query("M17_feature_group_ablation")
def feature_group_ablation(spark, sf_dir):
    return W.feature_group_ablation(*parts(spark, sf_dir)[1])


@query("M18_hyperparameter_sensitivity")
def hyperparameter_sensitivity(spark, sf_dir):
    return W.hyperparameter_sensitivity(*parts(spark, sf_dir)[1])


def _comparison(spark, sf_dir):
    def build():
        _, (train, validation, test), split = parts(spark, sf_dir)
        return X.compare_models(train, test, validation, include_rules=True, rule_test=part(split, TEST),
                                rule_validation=part(split, VALIDATION), ties=["src_ip", "window_start"])

    return kept(spark, sf_dir, "comparison", build)


@query("M19_compare_models")
def compare_models(spark, sf_dir):
    return _comparison(spark, sf_dir)["tables"]["baselines"]


@query("M19_significance")
def significance(spark, sf_dir):
    return _comparison(spark, sf_dir)["significance"]


# --- jobs -------------------------------------------------------------------------------------------------------------


@query("M21_infer_on_features")
def infer_on_features(spark, sf_dir):
    scaler = parts(spark, sf_dir)[0]
    made = V.infer_on_features(labelled_days(spark, sf_dir).withColumn("severity_weight", F.lit(9.0)), day_model(spark, sf_dir), scaler)
    return made.select("window_start", "src_ip", "anomaly_score", "predicted_label", "review_required", "risk_score", "risk_class",
                       "ai_component", "rule_component")


@query("M22_run_training")
def run_training(spark, sf_dir):
    made = P.run_training(labelled_days(spark, sf_dir), registry=ModelRegistry(spark, scratch_path(spark, "registry")))
    return made["metrics"]


@query("M23_run_evaluation")
def run_evaluation(spark, sf_dir):
    return P.run_evaluation(labelled_days(spark, sf_dir))["tables"]["baselines"]


@query("M23_one_class_evaluation")
def one_class_evaluation(spark, sf_dir):
    return P.one_class_evaluation(labelled_days(spark, sf_dir), ["window_start", "src_ip"])


@query("K15_model_registry")
def model_registry(spark, sf_dir):
    """Register a model twice, load the newest revision and score with it."""
    scaler, (_, _, test), _ = parts(spark, sf_dir)
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    for f1 in (0.4, 0.5):
        registry.register(day_model(spark, sf_dir), scaler, {"f1_score": f1})
    loaded, _ = registry.load()
    versions = registry.versions().select("version", F.get_json_object("metrics", "$.f1_score").alias("f1_score"))
    scored = loaded.score(test).agg(F.count(F.lit(1)).alias("rows"), F.avg("anomaly_score").alias("mean_score"))
    return versions.withColumn("_s", scored.select(F.struct("rows", "mean_score")).scalar()).select("version", "f1_score", "_s.*")
