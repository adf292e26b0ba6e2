"""Readers over the result tables, kept as Parquet below one folder."""

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from palisade import schema as S


def checked_name(name: str) -> str:
    if name not in S.TABLES:
        raise ValueError(f"table not allowed: {name}")
    return name


def read_table(spark: SparkSession, root: str, name: str, limit: int | None = None) -> DataFrame:
    """A known table; ``limit`` takes any such number of rows."""
    table = spark.read.parquet(f"{root}/{checked_name(name)}")
    return table if limit is None else table.limit(limit)


def query_frame(spark: SparkSession, sql: str, limit: int | None = None, args: dict | None = None, **frames) -> DataFrame:
    """Parameterised SQL over the given frames."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    result = spark.sql(sql, args=args)
    return result if limit is None else result.limit(limit)


def features_between(vectors: DataFrame, start, end, version: str = S.DEFAULT_FEATURE_VERSION) -> DataFrame:
    """Vectors of a closed time range and a version, by window and address."""
    kept = vectors.where(F.col("window_start").between(F.lit(start), F.lit(end)) & (F.col("feature_version") == version))
    return kept.orderBy("window_start", "src_ip")


def labelled_features(results: DataFrame, version: str | None = S.DEFAULT_MODEL_VERSION, features=S.FEATURES) -> DataFrame:
    """Results with the feature snapshot as columns and the ground truth as ``label``."""
    kept = results if version is None else results.where(F.col("model_version") == version)
    fields = T.StructType([T.StructField(f, T.DoubleType()) for f in features])
    opened = kept.withColumn("_s", F.from_json("feature_snapshot", fields))
    return opened.select(
        "id", "window_start", "src_ip", "anomaly_score", "predicted_label", "ground_truth_label", "label_source", "_s.*",
        F.col("ground_truth_label").alias("label"),
    )


def newest(df: DataFrame, time: str, limit: int = 100, ties=("src_ip",)) -> DataFrame:
    """The newest rows; ties in a fixed order."""
    return df.orderBy(F.col(time).desc(), *ties).limit(limit)


def newest_vectors(vectors: DataFrame, limit: int = 100) -> DataFrame:
    return newest(vectors, "window_start", limit, ("src_ip", "id"))


def newest_risk(risk: DataFrame, limit: int = 100) -> DataFrame:
    return newest(risk, "timestamp", limit, ("id",))


def range_or_newest(events: DataFrame, start, end, limit: int, time: str = "timestamp") -> DataFrame:
    """Rows of the time range; the ``limit`` newest rows of the table when the range is empty."""
    inside = events.where((F.col(time) >= F.lit(start)) & (F.col(time) <= F.lit(end)))
    return newest(events, time, limit, ("event_id",)) if inside.isEmpty() else inside


def since_mark(events: DataFrame, mark, end, lookback_minutes: float = 10, time: str = "timestamp") -> DataFrame:
    """Rows after the mark up to ``end``; the first run looks back a few minutes."""
    start = mark if mark is not None else end - timedelta(minutes=lookback_minutes)
    return events.where((F.col(time) > F.lit(start)) & (F.col(time) <= F.lit(end)))


def next_mark(events: DataFrame, end, time: str = "timestamp"):
    """Largest event time of the batch, or the end of the run when it is empty."""
    return events.agg(F.max(time)).first()[0] or end


def read_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/unlabeled_samples")


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder}/audit_metadata")
