"""Detector evaluation: confusion counts, ranking, thresholds and reports.

Curves are built from counts per distinct score in sorted slices, so no task sees the whole curve.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.labels import binary_label, folded
from palisade.functions.numbers import count_if
from palisade.operators.ordering import SortedSlices, quantile_table

EPS = 1e-12
EVENTS_PER_HOUR = 8000 * 60
BASE_RATES = (0.10, 0.01, 0.001)
TOP_K = (10, 25, 50, 100, 250)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame to every row, as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_beside", packed).select(*df.columns, "_beside.*")


def rate_name(prefix: str, rate: float) -> str:
    return f"{prefix}_at_{rate:g}".replace(".", "_").replace("-", "_")


# --- confusion counts --------------------------------------------------------------------

def confusion_rates(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, f1, f2, fpr and tnr to frames with tp, fp, fn and tn."""
    d = lambda name: F.col(name).cast("double")
    safe = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    base = counts.withColumns({
        "accuracy": safe(d("tp") + d("tn"), d("tp") + d("tn") + d("fp") + d("fn")),
        "precision": safe(d("tp"), d("tp") + d("fp")),
        "recall": safe(d("tp"), d("tp") + d("fn")),
    })
    p, r = F.col("precision"), F.col("recall")
    return base.withColumns({
        "f1": safe(2.0 * p * r, p + r),
        "f2": 5.0 * p * r / (4.0 * p + r + EPS),
        "fpr": d("fp") / (d("fp") + d("tn") + EPS),
        "tnr": d("tn") / (d("fp") + d("tn") + EPS),
    })


def basic_metrics(df: DataFrame, label: str, prediction: str, by=(), label_convention: str = "text",
                  prediction_convention: str = "text") -> DataFrame:
    """One row (per group): confusion counts and rates; abstained and unknown rows are left out."""
    truth = binary_label(F.col(label), label_convention)
    guess = binary_label(F.col(prediction), prediction_convention)
    abstained = F.coalesce(folded(F.col(prediction)) == "uncertain", F.lit(False))
    used = (truth >= 0) & ~abstained
    cell = lambda t, g: count_if(used & (truth == t) & (guess == g))
    known = count_if(truth >= 0)
    counts = df.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"),
        (count_if(used).cast("double") / F.greatest(known, F.lit(1))).alias("coverage"),
        count_if(abstained).alias("uncertain_count"),
        count_if(truth < 0).alias("unknown_ground_truth_count"),
    )
    ordered = ["tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "f2", "fpr", "tnr", "coverage",
               "uncertain_count", "unknown_ground_truth_count"]
    return confusion_rates(counts).select(*by, *ordered)


def confusion_table(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Two rows: predicted Normal / Anomaly against the actual classes."""
    truth, guess = binary_label(F.col(label)), binary_label(F.col(prediction))
    framed = df.select(truth.alias("actual"), guess.alias("guess")).where("actual >= 0 AND guess >= 0")
    return framed.groupBy(
        F.when(F.col("guess") == 1, "Predicted Anomaly").otherwise("Predicted Normal").alias("predicted")
    ).agg(
        count_if(F.col("actual") == 0).alias("actual_normal"), count_if(F.col("actual") == 1).alias("actual_anomaly")
    )


def category_detection(df: DataFrame, category: str, prediction: str) -> DataFrame:
    """Per attack category: rows, detected, missed and the detection rate."""
    hit = count_if(binary_label(F.col(prediction)) == 1)
    total = F.count(F.lit(1))
    return df.groupBy(category).agg(
        total.alias("total_samples"), hit.alias("detected_count"), (total - hit).alias("missed_count"),
        (hit.cast("double") / total).alias("detection_rate"),
    )


# --- closed forms ------------------------------------------------------------------------

def bayesian_detection_rate(tpr: Column, fpr: Column, base_rate) -> Column:
    """Chance that an alarm is an intrusion at the given base rate."""
    hit = tpr * base_rate
    return hit / (hit + fpr * (1.0 - base_rate) + EPS)


def alarms_per_hour(fpr: Column, tpr: Column, base_rate: float, events: float = EVENTS_PER_HOUR) -> Column:
    return fpr * (events * (1 - base_rate)) + tpr * (events * base_rate)


def _entropy(parts) -> Column:
    return -sum([F.when(p > 0, p * F.log2(p)).otherwise(0.0) for p in parts], F.lit(0.0))


def detection_capability(tpr: Column, fpr: Column, base_rate: float) -> Column:
    """Mutual information of class and alarm over the entropy of the class."""
    b = base_rate
    joint = [(1 - fpr) * (1 - b), fpr * (1 - b), (1 - tpr) * b, tpr * b]
    classes = _entropy([joint[0] + joint[1], joint[2] + joint[3]])
    alarms = _entropy([joint[0] + joint[2], joint[1] + joint[3]])
    return (classes + alarms - _entropy(joint)) / (classes + EPS)


def base_rate_columns(recall: Column, fpr: Column, base_rates=BASE_RATES) -> dict:
    made = {rate_name("bdr", b): bayesian_detection_rate(recall, fpr, b) for b in base_rates}
    made["cid_at_0_01"] = detection_capability(recall, fpr, 0.01)
    made["alarms_per_hour_at_0_01"] = alarms_per_hour(fpr, recall, 0.01)
    return made


def base_rate_table(rates: DataFrame, base_rates=(0.10, 0.01, 0.001, 0.0001)) -> DataFrame:
    """Long form: one row per base rate with the Bayesian detection rate."""
    rate = F.explode(F.array(*[F.lit(float(b)) for b in base_rates])).alias("base_rate")
    return rates.select("*", rate).withColumn(
        "bdr", bayesian_detection_rate(F.col("recall"), F.col("fpr"), F.col("base_rate"))
    )


# --- ranking -----------------------------------------------------------------------------

def score_counts(df: DataFrame, label: str, score: str, convention: str = "text", by=()) -> DataFrame:
    """(by, score, pos, neg) over rows with a known label."""
    truth = binary_label(F.col(label), convention)
    known = df.select(*by, F.col(score).cast("double").alias("score"), truth.alias("y"))
    known = known.where("y >= 0 AND score IS NOT NULL")
    return known.groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def ranking_metrics(df: DataFrame, label: str, score: str, convention: str = "text", align_polarity: bool = False,
                    by=()) -> DataFrame:
    """One row (per group): prevalence, ROC area with ties, average precision and its lift over prevalence.

    ``align_polarity`` turns the score around when anomalies score lower on average than normal rows.
    All groups share one global order, so a group of any size is spread over many slices.
    """
    slices = SortedSlices(score_counts(df, label, score, convention, by), *by, F.col("score").desc(), unique=True)
    placed = slices.running(by, pos_run=F.col("pos"), neg_run=F.col("neg"))
    d = lambda name: F.col(name).cast("double")
    mean = lambda name: F.sum(d(name) * F.col("score")) / F.sum(name)
    totals = slices.frame.groupBy(*by).agg(
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"),
        F.coalesce(mean("pos") < mean("neg"), F.lit(False)).alias("lower"),
    )
    joined = placed.join(totals, list(by)) if by else beside(placed, totals)
    pos_above, neg_above = d("pos_run"), d("neg_run")
    above, below = pos_above + d("pos"), neg_above + d("neg")
    up, down = d("p") - pos_above, d("n") - neg_above  # read from the low end
    sums = joined.groupBy(*by).agg(
        F.max("p").alias("p"), F.max("n").alias("n"), F.max("lower").alias("lower"),
        F.sum(d("pos") * above / (above + below)).alias("ap"),
        F.sum(d("pos") * up / (up + down)).alias("ap_turned"),
        F.sum(d("neg") * (pos_above + d("pos") / 2.0)).alias("area"),
    )
    turned = F.col("lower") if align_polarity else F.lit(False)
    both = (F.col("p") > 0) & (F.col("n") > 0)
    area = F.when(both, F.col("area") / (F.col("p") * F.col("n"))).otherwise(0.5)
    precision = F.when(turned, F.col("ap_turned")).otherwise(F.col("ap")) / F.col("p")
    return sums.select(
        *by, F.coalesce(F.col("p") / (F.col("p") + F.col("n")), F.lit(0.0)).alias("prevalence"),
        F.when(turned & both, 1.0 - area).otherwise(area).alias("roc_auc"),
        F.when(F.col("p") > 0, precision).otherwise(0.0).alias("pr_auc"),
    ).withColumn("pr_auc_over_prevalence", F.col("pr_auc") / (F.col("prevalence") + EPS))


def aligned_score(df: DataFrame, label: str, score: str, convention: str = "text") -> DataFrame:
    """Add ``aligned_score``: the score, negated when anomalies have the lower mean."""
    truth = binary_label(F.col(label), convention)
    lower = df.agg(
        F.coalesce(F.avg(F.when(truth == 1, F.col(score))) < F.avg(F.when(truth == 0, F.col(score))), F.lit(False))
    ).scalar()
    return df.withColumn("aligned_score", F.when(lower, -F.col(score)).otherwise(F.col(score)))


def top_k_metrics(df: DataFrame, label: str, score: str, ties=(), ks=TOP_K, convention: str = "text") -> DataFrame:
    """One row per k: recall and precision among the k highest scores."""
    known = df.withColumn("_y", binary_label(F.col(label), convention)).where("_y >= 0")
    totals = known.agg(F.count(F.lit(1)).alias("_rows"), F.sum("_y").alias("_pos"))
    top = known.orderBy(F.col(score).desc(), *ties).limit(max(ks)).select(
        "_y", F.row_number().over(Window.orderBy(F.col(score).desc(), *ties)).alias("_rank")  # at most max(ks) rows
    )
    hits = top.agg(*[F.coalesce(F.sum(F.when(F.col("_rank") <= k, F.col("_y"))), F.lit(0)).alias(f"_{k}") for k in ks])
    joined = beside(hits, totals)
    entry = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("hits")) for k in ks]))
    return joined.select("_rows", "_pos", entry).select(
        "k",
        (F.col("hits").cast("double") / F.greatest(F.coalesce("_pos", F.lit(0)), F.lit(1))).alias("recall"),
        F.when(F.col("_rows") > 0, F.col("hits").cast("double") / F.least(F.col("k"), F.col("_rows"))).otherwise(0.0)
        .alias("precision"),
    )


def top_k_wide(df: DataFrame, label: str, score: str, ties=(), ks=TOP_K, convention: str = "text") -> DataFrame:
    table = top_k_metrics(df, label, score, ties, ks, convention)
    return table.agg(*[
        F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_at_{k}") for m in ("recall", "precision") for k in ks
    ])


# --- thresholds --------------------------------------------------------------------------

CANDIDATE_STEPS = [float(p) for p in np.linspace(0.10, 0.9999, 400)]


def threshold_candidates(df: DataFrame, scores) -> dict:
    """Per score column: its distinct 400 quantiles between 10 % and 99.99 %, and one value above the maximum."""
    found = quantile_table(df, scores, [*CANDIDATE_STEPS, 1.0])
    return {
        name: sorted({*values[:-1], math.nextafter(values[-1], math.inf)}) if values[-1] is not None else []
        for name, values in found.items()
    }


def _passed(candidates):
    """How many of the sorted candidates a score reaches."""
    edges = np.asarray(candidates, dtype=float)

    @F.pandas_udf("int")
    def count_passed(score: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, score.to_numpy(dtype=float), side="right"))

    return count_passed


def threshold_gaps(df: DataFrame, label: str, candidates: dict, convention: str = "text") -> DataFrame:
    """(name, passed, pos, neg): each score falls between two candidates; at most len(candidates) + 1 rows per name."""
    truth = binary_label(F.col(label), convention)
    known = df.withColumn("_y", truth).where("_y >= 0")
    reached = known.select("_y", *[_passed(c)(F.col(n).cast("double")).alias(n) for n, c in candidates.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("passed")) for n in candidates])
    return reached.select("_y", F.inline(entries)).groupBy("name", "passed").agg(
        F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")
    )


def threshold_scan(df: DataFrame, label: str, score: str, candidates: list, convention: str = "text") -> DataFrame:
    """Confusion counts and rates for ``score >= threshold`` at every candidate."""
    gaps = threshold_gaps(df, label, {score: candidates}, convention).drop("name")
    grid = df.sparkSession.createDataFrame(
        [(i, float(c)) for i, c in enumerate([-math.inf, *candidates])], "passed int, threshold double"
    )
    rows = grid.join(gaps, "passed", "left").fillna(0, ["pos", "neg"])
    from_here = Window.orderBy("passed").rowsBetween(0, Window.unboundedFollowing)  # len(candidates) + 1 rows
    everything = Window.orderBy("passed").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = rows.select(
        "passed", "threshold", F.sum("pos").over(from_here).alias("tp"), F.sum("neg").over(from_here).alias("fp"),
        F.sum("pos").over(everything).alias("all_pos"), F.sum("neg").over(everything).alias("all_neg"),
    )
    cells = cells.withColumns({"fn": F.col("all_pos") - F.col("tp"), "tn": F.col("all_neg") - F.col("fp")})
    return confusion_rates(cells).where("passed > 0").drop("passed", "all_pos", "all_neg")


def _rates(tp, fp, pos, neg):
    precision = np.divide(tp, tp + fp, out=np.zeros(len(tp)), where=tp + fp > 0)
    recall = tp / pos if pos else np.zeros(len(tp))
    both = precision + recall
    return {
        "precision": precision, "recall": recall, "fpr": fp / (fp + (neg - fp) + EPS),
        "f1": np.divide(2 * precision * recall, both, out=np.zeros(len(tp)), where=both > 0),
        "f2": 5 * precision * recall / (4 * precision + recall + EPS),
        "accuracy": (tp + neg - fp) / max(pos + neg, 1),
    }


def pick_thresholds(df: DataFrame, label: str, scores, criterion: str = "fpr_budget", max_fpr: float | None = None,
                    convention: str = "text") -> dict:
    """Best threshold per score column by ``f1``, ``f2``, another rate, or recall within a false-positive budget.

    The smallest threshold wins ties. Without positives it is the 95 % quantile of the score. All columns
    share one quantile job and one counting job.
    """
    if criterion == "fpr_budget" and max_fpr is None:
        raise ValueError("max_fpr must be specified when criterion='fpr_budget'")
    candidates = threshold_candidates(df, list(scores))
    counts = {}
    usable = {n: c for n, c in candidates.items() if c}
    for row in threshold_gaps(df, label, usable, convention).collect() if usable else []:  # a few hundred rows per column
        counts[row["name"], row["passed"]] = (row["pos"], row["neg"])
    chosen, flat = {}, []
    for name in scores:
        edges = candidates[name]
        if not edges:
            chosen[name] = 0.5
            continue
        cells = np.array([counts.get((name, i), (0, 0)) for i in range(len(edges) + 1)], dtype=float)
        pos, neg = cells.sum(axis=0)
        if not pos:
            flat.append(name)
            continue
        tp, fp = cells[::-1].cumsum(axis=0)[::-1][1:].T
        rates = _rates(tp, fp, pos, neg)
        value = rates.get({"fpr_budget": "recall", "f1_score": "f1"}.get(criterion, criterion), rates["f1"])
        if criterion == "fpr_budget":
            value = np.where(rates["fpr"] <= max_fpr, value, -np.inf)
            if np.isneginf(value).all():
                raise ValueError(f"No validation threshold satisfies FPR budget {max_fpr:.4f}; refusing silent fallback.")
        chosen[name] = float(edges[int(np.argmax(value))])
    if flat:
        for name, values in quantile_table(df, flat, [0.95]).items():
            chosen[name] = float(values[0])
    return chosen


def pick_threshold(df: DataFrame, label: str, score: str, criterion: str = "fpr_budget", max_fpr: float | None = None,
                   convention: str = "text") -> float:
    return pick_thresholds(df, label, [score], criterion, max_fpr, convention)[score]


# --- reports -----------------------------------------------------------------------------

def classification_metrics(df: DataFrame, label: str, prediction: str, score: str | None = None,
                           label_convention: str = "text", prediction_convention: str = "text") -> DataFrame:
    """One row under the classic names; ranking uses the score turned to the right polarity."""
    basic = basic_metrics(df, label, prediction, (), label_convention, prediction_convention)
    named = basic.select(
        "accuracy", "precision", "recall", F.col("f1").alias("f1_score"), F.col("f2").alias("f2_score"),
        F.col("fpr").alias("false_positive_rate"), F.col("recall").alias("true_positive_rate"),
        (F.col("fn").cast("double") / F.greatest(F.col("fn") + F.col("tp"), F.lit(1))).alias("false_negative_rate"),
        "tp", "fp", "tn", "fn", "coverage", "uncertain_count", "unknown_ground_truth_count",
    )
    if score is None:
        return named
    ranked = ranking_metrics(df, label, score, label_convention, align_polarity=True).select("roc_auc", "pr_auc")
    return beside(named, ranked).withColumns(
        base_rate_columns(F.col("recall"), F.col("false_positive_rate"))
    )


def full_report(df: DataFrame, label: str, score: str, threshold: float, prediction: str | None = None,
                tau_low: float | None = None, tau_high: float | None = None, ties=(), base_rates=BASE_RATES,
                events_per_hour: float = EVENTS_PER_HOUR, convention: str = "text") -> DataFrame:
    """One row with every point metric of a detector (intervals come from the resampling operators)."""
    if prediction is not None:
        framed = df.withColumn("_guess", F.col(prediction).cast("string"))
    elif tau_low is not None and tau_high is not None:
        band = F.when(F.col(score) >= tau_high, "Anomaly").when(F.col(score) < tau_low, "Normal").otherwise("Uncertain")
        framed = df.withColumn("_guess", band)
    else:
        framed = df.withColumn("_guess", F.when(F.col(score) >= threshold, "Anomaly").otherwise("Normal"))
    report = framed.agg(
        F.lit(float(threshold)).alias("threshold"),
        count_if(binary_label(F.col(label), convention) >= 0).alias("n_samples"),
        (count_if(binary_label(F.col("_guess")) == 1).cast("double") / F.greatest(F.count(F.lit(1)), F.lit(1)))
        .alias("alert_rate"),
    )
    report = beside(report, basic_metrics(framed, label, "_guess", (), convention))
    report = beside(report, ranking_metrics(df, label, score, convention))
    recall, fpr = F.col("recall"), F.col("fpr")
    columns = {rate_name("bdr", b): bayesian_detection_rate(recall, fpr, b) for b in base_rates}
    columns["cid_at_0_01"] = detection_capability(recall, fpr, 0.01)
    columns["alarms_per_hour_at_0_01"] = alarms_per_hour(fpr, recall, 0.01, events_per_hour)
    return beside(report.withColumns(columns), top_k_wide(df, label, score, ties, convention=convention))


def alert_reduction(rule_row: DataFrame, cascade_row: DataFrame) -> DataFrame:
    """One row: alerts of the rules and of the cascade, reduction in percent, and the change in recall."""
    named = lambda df, who: df.select(
        (F.col("tp") + F.col("fp")).alias(f"alerts_{who}"), F.col("recall").alias(f"recall_{who}"))
    both = beside(named(rule_row, "rule_only"), named(cascade_row, "cascade"))
    share = F.col("alerts_cascade").cast("double") / F.greatest(F.col("alerts_rule_only"), F.lit(1))
    return both.select(
        "alerts_rule_only", "alerts_cascade", (100.0 * (1.0 - share)).alias("reduction_pct"), "recall_rule_only",
        "recall_cascade", (F.col("recall_cascade") - F.col("recall_rule_only")).alias("recall_delta"),
    )


BASELINE_COLUMNS = ["precision", "recall", "f1", "f2", "fpr", "pr_auc", "pr_auc_over_prevalence",
                    "alarms_per_hour_at_0_01", "cid_at_0_01"]


def comparison_tables(reports: dict) -> dict:
    """Baseline, base-rate and top-k tables: one row per detector."""
    stacked = None
    for name, report in reports.items():
        named = report.withColumn("detector", F.lit(name))
        stacked = named if stacked is None else stacked.unionByName(named, allowMissingColumns=True)
    rates = [c for c in stacked.columns if c.startswith("bdr_at_")]
    top = [c for c in stacked.columns if c.startswith(("recall_at_", "precision_at_"))]
    return {
        "baselines": stacked.select("detector", *BASELINE_COLUMNS),
        "bdr": stacked.select("detector", *rates, "recall", "fpr"),
        "topk": stacked.select("detector", *top),
    }
