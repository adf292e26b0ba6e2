"""Bootstrap intervals that never resample rows one by one."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palisade.operators.metrics import basic_metrics, confusion_rates, ranking_metrics, score_counts
from palisade.operators.ordering import SortedSlices, exact_quantiles

RATES = ["precision", "recall", "f1", "f2", "fpr", "tnr"]


def _weights(counts, replicate: int, slice_id: int, seed: int, kind: int):
    """Poisson weights of a slice in one replicate; the same numbers in every pass."""
    rng = np.random.default_rng([seed, replicate, slice_id, kind])
    return rng.poisson(counts)


def _interval(values: DataFrame, columns, alpha: float) -> DataFrame:
    """(name, mean, ci_low, ci_high, n_boot) over replicate rows."""
    low, high = alpha / 2, 1 - alpha / 2
    edges = exact_quantiles(values, columns, [low, high]).groupBy("name").agg(
        F.max(F.when(F.col("probability") == low, F.col("value"))).alias("ci_low"),
        F.max(F.when(F.col("probability") == high, F.col("value"))).alias("ci_high"),
    )
    entries = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns]))
    means = values.select(entries).groupBy("name").agg(
        F.avg("value").alias("mean"), F.count("value").alias("n_boot")
    )
    return means.join(edges, "name").select("name", "mean", "ci_low", "ci_high", "n_boot")


def average_precision_replicates(df: DataFrame, label: str, score: str, n_boot: int = 1000, seed: int = 42,
                                 convention: str = "text") -> DataFrame:
    """(replicate, pr_auc): average precision under Poisson weights, class by class.

    Score counts stay in sorted slices. The first pass sums the weights of each slice in each replicate;
    the second one adds the sums of the slices before it, so no task needs the whole curve.
    """
    slices = SortedSlices(score_counts(df, label, score, convention), F.col("score").desc(), unique=True)
    frame = slices.frame.select("_slice", "_place", "pos", "neg")
    replicates = n_boot

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        part = int(pdf["_slice"].iloc[0])
        rows = [
            (part, b, int(_weights(pdf["pos"].values, b, part, seed, 1).sum()),
             int(_weights(pdf["neg"].values, b, part, seed, 0).sum()))
            for b in range(replicates)
        ]
        return pd.DataFrame(rows, columns=["_slice", "replicate", "pos", "neg"])

    sums = frame.groupBy("_slice").applyInPandas(totals, "_slice int, replicate int, pos long, neg long")
    before = "SUM({0}) OVER (PARTITION BY replicate ORDER BY _slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = sums.select(  # one row per slice in each replicate
        "_slice", "replicate", F.expr(f"COALESCE({before.format('pos')}, 0)").alias("pos_above"),
        F.expr(f"COALESCE({before.format('neg')}, 0)").alias("neg_above"),
    )

    def contributions(curve: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if curve.empty:
            return pd.DataFrame({"replicate": [], "gain": [], "pos": []})
        curve = curve.sort_values("_place")
        part = int(curve["_slice"].iloc[0])
        rows = []
        for b, pos_above, neg_above in above[["replicate", "pos_above", "neg_above"]].itertuples(index=False):
            pos = _weights(curve["pos"].values, b, part, seed, 1)
            neg = _weights(curve["neg"].values, b, part, seed, 0)
            hits = pos_above + np.cumsum(pos)
            alarms = hits + neg_above + np.cumsum(neg)
            gain = np.divide(pos * hits, alarms, out=np.zeros(len(pos)), where=alarms > 0).sum()
            rows.append((int(b), float(gain), int(pos.sum())))
        return pd.DataFrame(rows, columns=["replicate", "gain", "pos"])

    gains = frame.groupBy("_slice").cogroup(offsets.groupBy("_slice")).applyInPandas(
        contributions, "replicate int, gain double, pos long"
    )
    return gains.groupBy("replicate").agg(F.sum("gain").alias("gain"), F.sum("pos").alias("pos")).select(
        "replicate", F.when(F.col("pos") > 0, F.col("gain") / F.col("pos")).otherwise(0.0).alias("pr_auc")
    )


def average_precision_interval(df: DataFrame, label: str, score: str, n_boot: int = 1000, alpha: float = 0.05,
                               seed: int = 42, convention: str = "text") -> DataFrame:
    """One row: point, mean and percentile interval of the average precision."""
    point = ranking_metrics(df, label, score, convention).select("pr_auc").scalar()
    values = average_precision_replicates(df, label, score, n_boot, seed, convention)
    return _interval(values, ["pr_auc"], alpha).withColumn("point", point).select(
        "name", "point", "mean", "ci_low", "ci_high", "n_boot"
    )


def classification_replicates(cells: DataFrame, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Resampled rates: drawing rows per class only moves rows between the two cells of the class.

    So each replicate is two binomial draws from the four confusion cells of the one-row input.
    """
    fields = ["tp", "fp", "fn", "tn"]
    cell = {name: cells.select(F.col(name).cast("long")).scalar() for name in fields}
    frame = cells.sparkSession.range(n_boot).withColumnRenamed("id", "replicate").withColumns(cell)

    def draw(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, int(row.replicate)])
                positives, negatives = row.tp + row.fn, row.fp + row.tn
                tp = rng.binomial(positives, row.tp / positives) if positives else 0
                fp = rng.binomial(negatives, row.fp / negatives) if negatives else 0
                out.append((row.replicate, tp, fp, positives - tp, negatives - fp))
            yield pd.DataFrame(out, columns=["replicate", *fields])

    drawn = frame.mapInPandas(draw, "replicate long, tp long, fp long, fn long, tn long")
    return confusion_rates(drawn).select("replicate", *RATES)


def classification_intervals(df: DataFrame, label: str, prediction: str, n_boot: int = 1000, alpha: float = 0.05,
                             seed: int = 42, label_convention: str = "text",
                             prediction_convention: str = "text") -> DataFrame:
    """One row per rate: point, mean and percentile interval."""
    basic = basic_metrics(df, label, prediction, (), label_convention, prediction_convention)
    values = classification_replicates(basic, n_boot, seed)
    points = basic.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("point")) for c in RATES
    ])))
    return points.join(_interval(values, RATES, alpha), "name")
