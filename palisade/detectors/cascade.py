"""Two-stage cascade: the forest screens every row, the boundary looks at the suspicious share only."""

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade import schema as S
from palisade.detectors.iforest import Forest, forest_scores, grow_forests
from palisade.detectors.ocsvm import Boundary, boundary_margins, fit_boundaries
from palisade.functions.labels import binary_label
from palisade.functions.risk import decision_label, decision_status, risk_score
from palisade.operators.cleaning import benign_rows
from palisade.operators.metrics import pick_threshold
from palisade.operators.ordering import quantile_table
from palisade.session import checkpointed

GRID = [i / 500 for i in range(501)]
GATE_RATE, W_STAGE1, UNCERTAINTY_MARGIN = 0.20, 0.40, 0.0
DETAILS = "stage1_score double, stage2_score double, norm1 double, norm2 double"


def gate_rate_from_percentile(percentile: float) -> float:
    """Older setting: the percentile above which rows go to the second stage."""
    share = (100.0 - percentile) / 100.0 if percentile >= 50.0 else percentile / 100.0
    return max(0.01, min(0.99, share))


def gate_level(gate_rate: float) -> float:
    return max(0.01, min(0.9999, 1.0 - gate_rate))


def empirical_rank(score: np.ndarray, quantiles, low: float, high: float) -> np.ndarray:
    """Place of a score among the training quantiles, 0..1; min-max when there are no quantiles."""
    finite = np.where(np.isfinite(score), score, low)
    if quantiles is not None and len(quantiles) > 1:
        return np.clip(np.interp(finite, quantiles, np.linspace(0.0, 1.0, len(quantiles))), 0.0, 1.0)
    span = high - low
    return np.clip((finite - low) / ((span if abs(span) >= 1e-12 else 1.0) + 1e-12), 0.0, 1.0)


def empirical_rank_column(score: Column, quantiles) -> Column:
    """The same place as a column expression.

    The last quantile that is not above the score gives the lower knot; the place in between is linear.
    """
    knots = F.array(*[F.lit(float(q)) for q in quantiles])
    last = len(quantiles) - 1
    reached = F.size(F.filter(knots, lambda q: q <= score))
    low, high = F.get(knots, reached - 1), F.get(knots, reached)
    inner = (reached - 1 + (score - low) / (high - low)) / float(last)
    return F.when(reached <= 0, 0.0).when(reached > last, 1.0).otherwise(inner)


def fused_score(gated: Column, norm1: Column, norm2: Column, weight) -> Column:
    """Gated rows mix both stages; other rows keep the first one."""
    mixed = norm1 * weight + norm2 * (1.0 - weight)
    return F.greatest(F.least(F.when(gated, mixed).otherwise(norm1), F.lit(1.0)), F.lit(0.0))


@dataclass
class Cascade:
    forest: Forest
    boundary: Boundary
    gate_rate: float = GATE_RATE
    w_stage1: float = W_STAGE1
    uncertainty_margin: float = UNCERTAINTY_MARGIN
    model_version: str = S.DEFAULT_MODEL_VERSION
    gate_threshold: float = 0.0
    normal_threshold: float = 0.0
    threshold: float = 0.45
    forest_quantiles: list = field(default_factory=list, repr=False)
    boundary_quantiles: list = field(default_factory=list, repr=False)

    @property
    def features(self) -> list:
        return self.forest.features

    @property
    def tau_low(self) -> float:
        return max(0.0, self.threshold - self.uncertainty_margin)

    @property
    def tau_high(self) -> float:
        return self.threshold

    def stage_scores(self, df: DataFrame, everything: bool = False) -> DataFrame:
        """Add ``_stages``: both stages in one pass over Arrow batches; stage 2 runs on the gated rows only.

        With ``everything`` it runs on all rows, whose margins are added; scores and ranks stay the same.
        """
        shared = df.sparkSession.sparkContext.broadcast(self)  # bounded by the node count of the forest

        @F.pandas_udf(DETAILS + (", margin double" if everything else ""))
        def stages(*columns: pd.Series) -> pd.DataFrame:
            model = shared.value
            rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            first = model.forest.anomaly(rows) + model.forest.offset
            gated = first >= model.gate_threshold
            second, margin = np.full(len(rows), np.nan), None
            if everything:
                margin = model.boundary.margin(rows)
                second[gated] = model.boundary.offset - margin[gated]
            elif gated.any():
                second[gated] = model.boundary.offset - model.boundary.margin(rows[gated])
            q1, q2 = model.forest_quantiles, model.boundary_quantiles
            low2 = q2[0] if q2 else 0.0
            return pd.DataFrame({
                "stage1_score": first,
                "stage2_score": pd.Series(second).where(gated, None),
                "norm1": empirical_rank(first, q1, q1[0], q1[-1]),
                "norm2": empirical_rank(np.where(gated, second, low2), q2, low2, q2[-1] if q2 else 1.0),
                **({"margin": margin} if everything else {}),
            })

        return df.withColumn("_stages", stages(*[F.col(f).cast("double") for f in self.features]))

    def predict_detailed(self, df: DataFrame) -> DataFrame:
        """All input columns plus stage scores, fused score, margin, status and label."""
        return self.detailed(self.stage_scores(df)).drop("_stages")

    def detailed(self, scored: DataFrame) -> DataFrame:
        first, second = F.col("_stages.stage1_score"), F.col("_stages.stage2_score")
        fused = fused_score(first >= self.gate_threshold, F.col("_stages.norm1"), F.col("_stages.norm2"), self.w_stage1)
        out = scored.withColumns({
            "stage1_score": first,
            "stage2_score": F.when(F.isnan(second), None).otherwise(second),
            "anomaly_score": fused,
        })
        label = decision_label(F.col("anomaly_score"), self.tau_low, self.tau_high)
        return out.withColumns({
            "confidence_margin": F.abs(F.col("anomaly_score") - self.threshold),
            "predicted_label": label,
            "prediction_status": decision_status(label),
        })

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_detailed(df).select(*df.columns, "predicted_label")

    def score(self, df: DataFrame) -> DataFrame:
        return self.predict_detailed(df).select(*df.columns, "anomaly_score")

    def predict_with_details(self, df: DataFrame, ids=("src_ip", "window_start")) -> DataFrame:
        detailed = self.predict_detailed(df)
        return detailed.select(
            *[c for c in ids if c in df.columns], "stage1_score", "stage2_score", "anomaly_score", "confidence_margin",
            "prediction_status", "predicted_label",
        )

    def predict_risk(self, df: DataFrame, severity="severity_weight", alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
        level = F.col(severity) if severity in df.columns else F.lit(0.0)
        return self.score(df).withColumn("risk_score", risk_score(F.col("anomaly_score"), level, alpha, beta))

    def gate_statistics(self, df: DataFrame) -> DataFrame:
        """One row: rows, share sent to stage 2 and rows that skip it."""
        return gate_statistics(self.predict_detailed(df))

    def info(self) -> str:
        return json.dumps({
            "forest": self.forest.info(), "boundary": self.boundary.info(), "gate_rate": self.gate_rate,
            "w_stage1": self.w_stage1, "uncertainty_margin": self.uncertainty_margin,
            "model_version": self.model_version, "gate_threshold": self.gate_threshold,
            "normal_threshold": self.normal_threshold, "threshold": self.threshold,
            "forest_quantiles": self.forest_quantiles, "boundary_quantiles": self.boundary_quantiles,
        })

    @staticmethod
    def from_parts(info: str, nodes: DataFrame) -> "Cascade":
        data = json.loads(info)
        forest = data.pop("forest")
        grown = Forest.from_nodes(  # bounded by the node count of the forest
            nodes.toPandas(), forest["features"], forest["params"], forest["sample_size"], forest["offset"])
        return Cascade(grown, Boundary.from_info(data.pop("boundary")), **data)


def gate_statistics(detailed: DataFrame) -> DataFrame:
    gated = F.col("stage2_score").isNotNull()
    return detailed.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(gated.cast("double")).alias("gate_rate_actual"),
        F.count(F.when(~gated, True)).alias("rows_without_stage2"),
    )


def raw_scores(df: DataFrame, forests, boundaries, features) -> DataFrame:
    """Add f0, f1, ... and b0, b1, ...: higher is more anomalous, offsets not applied. Either list may be empty."""
    spark = df.sparkSession
    framed = df.withColumn("_f", forest_scores(spark, forests, features)) if forests else df
    framed = framed.withColumn("_b", boundary_margins(spark, boundaries, features)) if boundaries else framed
    names = {f"f{i}": F.col(f"_f.f{i}") for i in range(len(forests))}
    names.update({f"b{i}": -F.col(f"_b.b{i}") for i in range(len(boundaries))})
    return framed.withColumns(names).drop("_f", "_b")


def fit_cascade(train: DataFrame, features=None, label: str | None = None, validation: DataFrame | None = None,
                gate_rate: float = GATE_RATE, w_stage1: float = W_STAGE1, iforest: dict | None = None,
                ocsvm: dict | None = None, criterion: str = "fpr_budget", max_fpr: float = 0.02,
                uncertainty_margin: float = UNCERTAINTY_MARGIN, threshold_percentile: float | None = None,
                model_version: str = S.DEFAULT_MODEL_VERSION, convention: str = "text", max_rows: int | None = None) -> Cascade:
    """Fit both stages on benign rows and calibrate gate, ranks and threshold.

    ``train`` holds scaled features. With a ``label`` only its normal rows are used. Offsets, gate and
    ranks of both stages come from one quantile job over the training scores.
    """
    features = list(features or S.FEATURES)
    if threshold_percentile is not None:
        gate_rate = gate_rate_from_percentile(threshold_percentile)
    rows = benign_rows(train, label) if label else train
    rows = checkpointed(rows.select(*[F.col(f).cast("double").alias(f) for f in features]))  # read many times
    forest = grow_forests(rows, features, [iforest or {}])[0]
    boundary = fit_boundaries(rows, features, [ocsvm or {}], max_rows)[0]
    return calibrated(forest, boundary, rows, label, validation, gate_rate, w_stage1, criterion, max_fpr, uncertainty_margin,
                      model_version, convention)


def calibrated(forest: Forest, boundary: Boundary, rows: DataFrame, label: str | None = None, validation: DataFrame | None = None,
               gate_rate: float = GATE_RATE, w_stage1: float = W_STAGE1, criterion: str = "fpr_budget", max_fpr: float = 0.02,
               uncertainty_margin: float = UNCERTAINTY_MARGIN, model_version: str = S.DEFAULT_MODEL_VERSION,
               convention: str = "text") -> Cascade:
    """A cascade of two grown stages: offsets, gate and ranks from the training rows, the threshold from labels or rows."""
    features = forest.features
    scored = checkpointed(raw_scores(rows, [forest], [boundary], features).select("f0", "b0"))
    level = gate_level(gate_rate)
    extra = [1.0 - forest.params["contamination"], 1.0 - boundary.params["nu"], level, max(0.01, level - 0.2)]
    table = quantile_table(scored, ["f0", "b0"], sorted({*GRID, *extra}))
    place = {p: i for i, p in enumerate(sorted({*GRID, *extra}))}
    at = lambda column, p: table[column][place[p]]
    forest.offset = -float(at("f0", extra[0]))
    boundary.offset = -float(at("b0", extra[1]))
    model = Cascade(
        forest, boundary, gate_rate, w_stage1, uncertainty_margin, model_version,
        gate_threshold=float(at("f0", level)) + forest.offset,
        normal_threshold=float(at("f0", extra[3])) + forest.offset,
        forest_quantiles=[float(at("f0", p)) + forest.offset for p in GRID],
        boundary_quantiles=[float(at("b0", p)) + boundary.offset for p in GRID],
    )
    spare = max(0.5, 1.0 - gate_rate)
    if validation is not None and label:
        judged = checkpointed(model.score(validation).select(F.col(label).alias("label"), "anomaly_score"))
        truth = binary_label(F.col("label"), convention)
        classes = {r[0] for r in judged.select(truth).distinct().collect()}  # -1, 0 and 1 at most
        if {0, 1} <= classes:
            model.threshold = pick_threshold(judged, "label", "anomaly_score", criterion, max_fpr, convention)
        else:
            model.threshold = float(quantile_table(judged, ["anomaly_score"], [spare])["anomaly_score"][0])
    else:
        model.threshold = float(quantile_table(checkpointed(model.score(rows).select("anomaly_score")), ["anomaly_score"], [spare])["anomaly_score"][0])
    return model
