"""Scoring with a stored model that a rule defines, so that SQL can score the same rows.

The trees, the weights of the boundary, the scaler and the knots below follow from small rules. Spark stores the model in
a registry, loads it and scores the line items; SQL walks down the same trees and sums the same cosines.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from palisade import schema as S
from palisade.catalog import inputs as I
from palisade.catalog.detection import ITEM_KEYS, ITEMS, kept
from palisade.catalog.registry import query, r
from palisade.catalog.tables import calibrated, class_sql, risk_sql
from palisade.detectors import cascade as C, comparison as X, iforest as T, ocsvm as O
from palisade.detectors.preprocess import Scaler
from palisade.plans import serve as V
from palisade.session import checkpointed, scratch_path
from palisade.sinks.registry import ModelRegistry
from palisade.streaming import features as W

TREES, DEPTH, SAMPLE, PARTS, GAMMA, SEED = 7, 4, 64, 8, 0.4, 3
MEANS, SCALES = [25.5, 38000.0, 0.05, 0.04], [14.5, 23000.0, 0.03, 0.026]
NORMAL = [0.31 - 0.055 * j for j in range(PARTS)]
OFFSETS = (-0.47, 0.12)  # forest, boundary
KNOTS1, KNOTS2 = [-0.05 + 0.008 * k for k in range(21)], [-0.6 + 0.06 * k for k in range(21)]
GATE, WEIGHT, THRESHOLD, MARGIN, SEVERITY = 0.0371, 0.4, 0.45, 0.05, 7.0


def nodes() -> pd.DataFrame:
    """Full binary trees, numbered from the root by level; children of i are 2 i + 1 and 2 i + 2."""
    inner, rows = 2 ** DEPTH - 1, []
    for t in range(TREES):
        for i in range(2 * inner + 1):
            depth = (i + 1).bit_length() - 1
            if i < inner:
                cut = -1.5 + 3.0 * ((5 * i + 3 * t) % 13 + 0.5) / 13.0
                rows.append((t, i, (i + 2 * t + i // 3) % 4, cut, 2 * i + 1, 2 * i + 2, SAMPLE >> depth, depth))
            else:
                rows.append((t, i, -1, 0.0, -1, -1, (3 * t + 5 * i) % 6 + 1, depth))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def forest() -> T.Forest:
    return T.Forest.from_nodes(nodes(), ITEMS, {**T.DEFAULTS, "contamination": 0.03}, SAMPLE, OFFSETS[0])


def boundary() -> O.Boundary:
    return O.Boundary(list(ITEMS), {**O.DEFAULTS, "nu": 0.05}, [0, 1, 2, 3], GAMMA, SEED, np.array(NORMAL), OFFSETS[1])


def scaler() -> Scaler:
    return Scaler(list(ITEMS), [0.0] * 4, list(MEANS), list(SCALES))


def stored_model(spark, sf_dir):
    """The model out of a registry."""
    def build():
        made = C.Cascade(forest(), boundary(), 0.2, WEIGHT, MARGIN, "fixed-v1", GATE, 0.0, THRESHOLD, list(KNOTS1), list(KNOTS2))
        registry = ModelRegistry(spark, scratch_path(spark, "registry"))
        registry.register(made, scaler(), {"f1_score": 0.5})
        return registry.load("fixed-v1")

    return kept(spark, sf_dir, "fixed", build)


def raw_items(spark, sf_dir):
    planted = F.col("l_orderkey") % 500 == 0
    return I.table(spark, sf_dir, "lineitem").select(*ITEM_KEYS, *[
        F.when(planted, F.col(c) * 20).otherwise(F.col(c)).cast("double").alias(c) for c in ITEMS],
        F.when(planted, S.ANOMALY).otherwise(S.NORMAL).alias("label"))


def items(spark, sf_dir):
    return scaler().transform(raw_items(spark, sf_dir))


# --- the same in SQL ---------------------------------------------------------------------------------------------------


def scored_sql() -> str:
    """CTEs up to ``staged``: one row per item with its keys, label, f0 (forest), margin (boundary)."""
    table = nodes()
    ends = table["depth"] + T.average_path(table["size"])
    walls = ", ".join(f"({t}, {n}, {f}, {c!r}, {left}, {float(e)!r})" for t, n, f, c, left, e in zip(
        table["tree"], table["node"], table["feature"], table["threshold"].tolist(), table["left"], ends))
    directions, phases = O.fourier_basis(4, GAMMA, PARTS, SEED)
    waves = ", ".join(f"({j}, {directions[:, j].tolist()!r}, {float(phases[j])!r}, {NORMAL[j]!r})" for j in range(PARTS))
    scaled = ", ".join(
        f"(CAST(CASE WHEN l_orderkey % 500 = 0 THEN {c} * 20 ELSE {c} END AS DOUBLE) - {m!r}) / {s!r}" for c, m, s in zip(ITEMS, MEANS, SCALES))
    expected = float(T.average_path(SAMPLE)) * TREES
    return f"""RECURSIVE nodes(tree, node, feature, threshold, first, path) AS (VALUES {walls}),
waves(j, d, phase, w) AS (VALUES {waves}),
items AS MATERIALIZED (SELECT {', '.join(ITEM_KEYS)}, CASE WHEN l_orderkey % 500 = 0 THEN 'Anomaly' ELSE 'Normal' END AS label,
  [{scaled}] AS v, row_number() OVER () AS item FROM lineitem),
walk(item, v, tree, node) AS (
  SELECT item, v, tree, 0 FROM items, (SELECT DISTINCT tree FROM nodes) t
  UNION ALL SELECT k.item, k.v, k.tree, n.first + CASE WHEN k.v[n.feature + 1] > n.threshold THEN 1 ELSE 0 END
  FROM walk k JOIN nodes n ON n.tree = k.tree AND n.node = k.node WHERE n.feature >= 0),
paths AS (SELECT item, power(2, -sum(path) / {expected!r}) AS f0 FROM walk JOIN nodes USING (tree, node) WHERE feature < 0 GROUP BY item),
margins AS (SELECT item, sum(w * cos(v[1] * d[1] + v[2] * d[2] + v[3] * d[3] + v[4] * d[4] + phase)) * sqrt(2.0 / {PARTS}) AS margin
  FROM items, waves GROUP BY item),
staged AS MATERIALIZED (SELECT items.*, f0, margin FROM items JOIN paths USING (item) JOIN margins USING (item))"""


def place_sql(score: str, knots) -> str:
    """Place of a score among knots, 0 .. 1."""
    last = len(knots) - 1
    n = f"len(list_filter({knots!r}, lambda q: q <= {score}))"
    return (f"CASE WHEN {n} = 0 THEN 0 WHEN {n} > {last} THEN 1 "
            f"ELSE ({n} - 1 + ({score} - {knots!r}[{n}]) / ({knots!r}[{n} + 1] - {knots!r}[{n}])) / {last}.0 END")


DETAILED = f"""{scored_sql()},
stages AS MATERIALIZED (SELECT *, f0 + {OFFSETS[0]} AS stage1, CASE WHEN f0 + {OFFSETS[0]} >= {GATE} THEN {OFFSETS[1]} - margin END AS stage2 FROM staged),
fused AS MATERIALIZED (SELECT *, greatest(least(CASE WHEN stage2 IS NULL THEN norm1 ELSE {WEIGHT} * norm1 + {1 - WEIGHT} * norm2 END, 1), 0) AS score
  FROM (SELECT *, {place_sql('stage1', KNOTS1)} AS norm1, {place_sql('stage2', KNOTS2)} AS norm2 FROM stages)),
detailed AS (SELECT *, abs(score - {THRESHOLD}) AS off,
  CASE WHEN score >= {THRESHOLD} THEN 'Anomaly' WHEN score < {THRESHOLD - MARGIN!r} THEN 'Normal' ELSE 'Uncertain' END AS predicted FROM fused)"""
KEYS = ", ".join(ITEM_KEYS)


# --- queries -------------------------------------------------------------------------------------------------------------


@query("M03_forest_samples", f"""SELECT CAST(t AS INTEGER) AS tree, least(256, (SELECT count(*) FROM lineitem)) AS rows
FROM (SELECT unnest(range({T.DEFAULTS['n_estimators']})) AS t)""")
def forest_samples(spark, sf_dir):
    """Every tree of a forest has the rows it asked for."""
    grown = T.grow_forests(raw_items(spark, sf_dir), ITEMS, [{}], ITEM_KEYS)[0].node_table(spark)
    return grown.where("feature < 0").groupBy(F.col("tree").cast("int").alias("tree")).agg(F.sum("size").alias("rows"))


@query("M04_stored_forest", f"""WITH {scored_sql()} SELECT {KEYS}, {r('-f0', 'iforest_score')}, {r(f'-f0 - ({OFFSETS[0]})', 'iforest_decision')},
  CASE WHEN -f0 - ({OFFSETS[0]}) < 0 THEN -1 ELSE 1 END AS iforest_label FROM staged""")
def stored_forest(spark, sf_dir):
    scored = T.score_iforest(items(spark, sf_dir), stored_model(spark, sf_dir)[0].forest)
    return scored.select(*ITEM_KEYS, "iforest_score", "iforest_decision", "iforest_label")


@query("M05_stored_boundary", f"""WITH {scored_sql()} SELECT {KEYS}, {r(f'margin - {OFFSETS[1]}', 'ocsvm_score')},
  CASE WHEN margin - {OFFSETS[1]} < 0 THEN -1 ELSE 1 END AS ocsvm_label FROM staged""")
def stored_boundary(spark, sf_dir):
    scored = O.score_ocsvm(items(spark, sf_dir), stored_model(spark, sf_dir)[0].boundary)
    return scored.select(*ITEM_KEYS, "ocsvm_score", "ocsvm_label")


@query("M07_stored_cascade", f"""WITH {DETAILED} SELECT {KEYS}, {r('stage1', 'stage1_score')}, {r('stage2', 'stage2_score')}, {r('score', 'anomaly_score')},
  {r('off', 'confidence_margin')}, predicted AS predicted_label, CASE WHEN predicted = 'Uncertain' THEN 'UNCERTAIN' ELSE 'CONFIDENT' END AS prediction_status
FROM detailed""")
def stored_cascade(spark, sf_dir):
    made = stored_model(spark, sf_dir)[0].predict_detailed(items(spark, sf_dir))
    return made.select(*ITEM_KEYS, "stage1_score", "stage2_score", "anomaly_score", "confidence_margin", "predicted_label", "prediction_status")


@query("M10_stored_labels", f"""WITH {DETAILED} SELECT {KEYS}, {r('stage1', 'stage1_score')}, {r('score', 'anomaly_score')}, predicted AS predicted_label FROM detailed""")
def stored_labels(spark, sf_dir):
    return stored_model(spark, sf_dir)[0].predict_with_details(items(spark, sf_dir), ITEM_KEYS).select(
        *ITEM_KEYS, "stage1_score", "anomaly_score", "predicted_label")


@query("F18_stored_risk", f"""WITH {DETAILED} SELECT {KEYS}, {r('score', 'anomaly_score')}, {r(risk_sql('score', SEVERITY), 'risk_score')} FROM detailed""")
def stored_risk(spark, sf_dir):
    framed = items(spark, sf_dir).withColumn("severity_weight", F.lit(SEVERITY))
    return stored_model(spark, sf_dir)[0].predict_risk(framed).select(*ITEM_KEYS, "anomaly_score", "risk_score")


_SURE = "predicted <> 'Uncertain'"
_INFERRED = f"""SELECT {KEYS}, {r('score', 'anomaly_score')}, predicted AS predicted_label, predicted = 'Uncertain' AS review_required,
  {r(f"CASE WHEN {_SURE} THEN {risk_sql('score', SEVERITY)} END", 'risk_score')}, CASE WHEN {_SURE} THEN {class_sql(risk_sql('score', SEVERITY))} END AS risk_class,
  {r(f"CASE WHEN {_SURE} THEN 0.6 * score END", 'ai_component')}, {r(f"CASE WHEN {_SURE} THEN 0.4 * ({calibrated(SEVERITY)}) END", 'rule_component')} FROM detailed"""


@query("M21_stored_inference", f"WITH {DETAILED} {_INFERRED}")
def stored_inference(spark, sf_dir):
    """Unscaled features through scaler, both stages, risk and review gate."""
    model, scale = stored_model(spark, sf_dir)
    made = V.infer_on_features(raw_items(spark, sf_dir).withColumn("severity_weight", F.lit(SEVERITY)), model, scale)
    return made.select(*ITEM_KEYS, "anomaly_score", "predicted_label", "review_required", "risk_score", "risk_class", "ai_component", "rule_component")


@query("K15_stored_registry", f"""WITH {DETAILED} SELECT 'fixed-v1' AS version, '0.5' AS f1_score, count(*) AS rows, {r('avg(score)', 'mean_score')}, CAST(count(stage2) AS BIGINT) AS gated FROM detailed""")
def stored_registry(spark, sf_dir):
    """Two registrations, the newest one is loaded and scores all items."""
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    model = stored_model(spark, sf_dir)[0]
    for f1 in (0.4, 0.5):
        registry.register(model, scaler(), {"f1_score": f1})
    loaded, scale = registry.load()
    scored = loaded.predict_detailed(scale.transform(raw_items(spark, sf_dir))).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("anomaly_score").alias("mean_score"), F.count("stage2_score").alias("gated"))
    versions = registry.versions().select("version", F.get_json_object("metrics", "$.f1_score").alias("f1_score"))
    return versions.withColumn("_s", scored.select(F.struct("rows", "mean_score", "gated")).scalar()).select("version", "f1_score", "_s.*")


_GRID = "[" + ", ".join(repr(p) for p in C.GRID) + "]"


def _rank(score, knots):
    n = f"len(list_filter({knots}, lambda q: q <= {score}))"
    return (f"CASE WHEN {n} = 0 THEN 0 WHEN {n} > 500 THEN 1 ELSE ({n} - 1 + ({score} - {knots}[{n}]) / ({knots}[{n} + 1] - {knots}[{n}])) / 500.0 END")


@query("M06_calibrated_cascade", f"""WITH {scored_sql()},
normal AS (SELECT * FROM staged WHERE label = 'Normal'),
k AS (SELECT quantile_cont(f0, {_GRID}) AS q1, quantile_cont(-margin, {_GRID}) AS q2, quantile_cont(f0, 0.97) AS o1, quantile_cont(-margin, 0.95) AS o2,
  quantile_cont(f0, 0.8) AS g, quantile_cont(f0, 0.6000000000000001) AS n FROM normal),
ranked AS (SELECT f0 >= g AS gated, {_rank('f0', 'q1')} AS n1, {_rank('-margin', 'q2')} AS n2 FROM normal, k)
SELECT {r('-o1', 'forest_offset')}, {r('-o2', 'boundary_offset')}, {r('g - o1', 'gate_threshold')}, {r('n - o1', 'normal_threshold')},
  {r("(SELECT quantile_cont(greatest(least(CASE WHEN gated THEN 0.4 * n1 + 0.6 * n2 ELSE n1 END, 1), 0), 0.8) FROM ranked)", 'threshold')} FROM k""")
def calibrated_cascade(spark, sf_dir):
    """Offsets, gate and threshold of two grown stages from their scores over all normal items."""
    rows = checkpointed(items(spark, sf_dir).where(F.col("label") == S.NORMAL).select(*ITEMS))
    m = C.calibrated(forest(), boundary(), rows)
    return spark.createDataFrame(
        [(m.forest.offset, m.boundary.offset, m.gate_threshold, m.normal_threshold, m.threshold)],
        "forest_offset double, boundary_offset double, gate_threshold double, normal_threshold double, threshold double")


@query("X10_stored_vectors", f"WITH {DETAILED} SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS src_ip, {r('score', 'anomaly_score')}, predicted AS predicted_label FROM detailed")
def stored_vectors(spark, sf_dir):
    """Appended vectors as a stream, scored with the stored model into the keyed result table.

    Items may repeat; each has a time of its own, so that the table has a row for every one.
    """
    root = scratch_path(spark, "vectors")
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.monotonically_increasing_id()
    named = raw_items(spark, sf_dir).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("src_ip"), F.timestamp_micros(start).alias("window_start"), *ITEMS)
    named.write.option("compression", "zstd").parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    model, scale = stored_model(spark, sf_dir)
    W.start(stream, W.score_vectors(root, model, scale), f"{root}/state").awaitTermination()
    return W.result_tables(spark, root)["anomaly_result"].read().select("src_ip", "anomaly_score", "predicted_label")


def _study_sql() -> str:
    parts = []
    for name, score, decision in (
            ("iForest Only", f"f0 + ({OFFSETS[0]})", f"f0 + ({OFFSETS[0]}) > 0"), ("OCSVM Only", f"{OFFSETS[1]} - margin", f"{OFFSETS[1]} - margin > 0"),
            ("Cascade", "score", None)):
        guess = f"CASE WHEN {decision} THEN 'Anomaly' ELSE 'Normal' END" if decision else "predicted"
        parts.append(f"SELECT '{name}' AS detector, label, round({score}, 9) AS s, {guess} AS guess FROM detailed")
    return " UNION ALL ".join(parts)


@query("M16_stored_study", f"""WITH {DETAILED}, long AS MATERIALIZED ({_study_sql()}),
cells AS (SELECT detector, CAST(count(*) FILTER (label = 'Anomaly' AND guess = 'Anomaly') AS BIGINT) AS tp, CAST(count(*) FILTER (label = 'Normal' AND guess = 'Anomaly') AS BIGINT) AS fp,
  CAST(count(*) FILTER (label = 'Anomaly' AND guess = 'Normal') AS BIGINT) AS fn, CAST(count(*) FILTER (label = 'Normal' AND guess = 'Normal') AS BIGINT) AS tn FROM long GROUP BY detector),
counts AS (SELECT detector, s, count(*) FILTER (label = 'Anomaly') AS pos, count(*) FILTER (label = 'Normal') AS neg FROM long GROUP BY detector, s),
curve AS (SELECT *, sum(pos) OVER w AS p, sum(neg) OVER w AS n, sum(pos) OVER (PARTITION BY detector) AS all_pos, sum(neg) OVER (PARTITION BY detector) AS all_neg
  FROM counts WINDOW w AS (PARTITION BY detector ORDER BY s DESC)),
areas AS (SELECT detector, sum(pos * p / (p + n)) / max(all_pos) AS ap, sum(neg * (p - pos / 2.0)) / (max(all_pos) * max(all_neg)) AS area FROM curve GROUP BY detector)
SELECT c.*, {r('ap', 'pr_auc')}, {r('area', 'roc_auc')} FROM cells c JOIN areas USING (detector)""")
def stored_study(spark, sf_dir):
    """Forest, boundary and cascade side by side over labelled items; every item is scored once."""
    scored = checkpointed(X.all_scores(items(spark, sf_dir), stored_model(spark, sf_dir)[0]))
    named = lambda c: F.when(F.col(c) == -1, S.ANOMALY).otherwise(S.NORMAL)
    rounded = {c: F.round(c, 9) for c in ("iforest_anomaly", "ocsvm_anomaly", "anomaly_score")}
    made = X.detector_metrics(X._long(scored.withColumns(rounded), "label", {
        "iForest Only": ("iforest_anomaly", named("iforest_label")), "OCSVM Only": ("ocsvm_anomaly", named("ocsvm_label")),
        "Cascade": ("anomaly_score", F.col("predicted_label"))}), "label", align_polarity=False)
    return made.select("detector", "tp", "fp", "fn", "tn", "pr_auc", "roc_auc")
