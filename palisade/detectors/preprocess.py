"""Median imputation and standard scaling, fitted on the training part only."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade import schema as S
from palisade.functions.numbers import finite
from palisade.operators.cleaning import with_current_names
from palisade.operators.ordering import quantile_table


@dataclass
class Scaler:
    """Per feature: median, mean of the imputed values and their population deviation (1 when it is 0)."""

    features: list
    medians: list
    means: list
    scales: list

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the features by their scaled values; all other columns stay. Missing features count as 0."""
        named = with_current_names(df)
        columns = {}
        for name, median, mean, scale in zip(self.features, self.medians, self.means, self.scales):
            value = finite(F.col(name)) if name in named.columns else F.lit(0.0)
            columns[name] = (F.coalesce(value, F.lit(median)) - mean) / scale
        return named.withColumns(columns)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(len(self.features)), self.features, self.medians, self.means, self.scales))
        return spark.createDataFrame(rows, "position int, feature string, median double, mean double, scale double")

    @staticmethod
    def from_table(table: DataFrame) -> "Scaler":
        rows = sorted(table.collect(), key=lambda r: r["position"])  # one row per feature
        return Scaler(*[[r[c] for r in rows] for c in ("feature", "median", "mean", "scale")])

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scaler":
        return Scaler.from_table(spark.read.parquet(path))


def fit_scaler(df: DataFrame, features=None) -> Scaler:
    """Exact medians from sorted value counts, then one aggregation. A column without values stays 0."""
    features = list(features or S.FEATURES)
    named = with_current_names(df)
    clean = named.select(*[
        (finite(F.col(f)) if f in named.columns else F.lit(0.0)).alias(f) for f in features
    ])
    medians = [0.0 if v[0] is None else float(v[0]) for v in quantile_table(clean, features, [0.5]).values()]
    filled = clean.fillna(dict(zip(features, medians)))
    aggregates = []
    for name in features:
        aggregates += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_scale")]
    row = filled.agg(*aggregates).first()
    means = [float(row[f"{f}_mean"] or 0.0) for f in features]
    scales = [float(row[f"{f}_scale"] or 0.0) or 1.0 for f in features]
    return Scaler(features, medians, means, scales)
