"""Model registry as Parquet: trees and parameters per version, one catalog table."""

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palisade.detectors.cascade import Cascade
from palisade.detectors.preprocess import Scaler
from palisade.session import path_exists

KEEP_BACKUPS = 2


class ModelRegistry:
    """Every registration is a new revision of its version; the newest one is current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def register(self, model: Cascade, scaler: Scaler | None = None, metrics: dict | None = None,
                 registered_at: datetime | None = None) -> str:
        when = registered_at or datetime.now()
        revision = when.strftime("%Y%m%d%H%M%S%f")
        home = f"{self.root}/models/version={model.model_version}/revision={revision}"
        model.forest.node_table(self.spark).write.mode("overwrite").parquet(f"{home}/nodes")
        if scaler is not None:
            scaler.save(self.spark, f"{home}/scaler")
        entry = {
            "version": model.model_version, "revision": revision, "registered_at": when,
            "metrics": json.dumps(metrics or {}, default=str), "model": model.info(),
            "hyperparameters": json.dumps({
                "gate_rate": model.gate_rate, "gate_threshold": model.gate_threshold, "threshold": model.threshold,
                "w_stage1": model.w_stage1, "iforest_anomaly_threshold": model.gate_threshold,
                "iforest_normal_threshold": model.normal_threshold, "iforest_params": model.forest.params,
                "ocsvm_params": model.boundary.params,
            }, default=str),
        }
        frame = self.spark.createDataFrame(
            [tuple(entry[c] for c in ("version", "revision", "registered_at", "metrics", "model", "hyperparameters"))],
            "version string, revision string, registered_at timestamp, metrics string, model string, hyperparameters string",
        )
        frame.write.mode("append").parquet(f"{self.root}/catalog")  # last step: a failed run leaves no entry
        return model.model_version

    def catalog(self) -> DataFrame:
        """All kept revisions: the current one and the newest two backups of each version."""
        if not path_exists(self.spark, f"{self.root}/catalog"):
            raise FileNotFoundError(f"no model is registered below {self.root}")
        entries = self.spark.read.parquet(f"{self.root}/catalog")
        age = F.row_number().over(Window.partitionBy("version").orderBy(F.col("revision").desc()))  # few registrations
        return entries.withColumn("age", age).where(F.col("age") <= KEEP_BACKUPS + 1)

    def versions(self) -> DataFrame:
        return self.catalog().where("age = 1").drop("age", "model")

    def latest_version(self) -> str:
        return self.catalog().agg(F.max_by("version", "registered_at")).first()[0]

    def manifest(self, version: str | None = None) -> dict:
        version = version or self.latest_version()
        row = self.catalog().where((F.col("version") == version) & (F.col("age") == 1)).first()
        if row is None:
            raise FileNotFoundError(f"model version {version} is not registered")
        return row.asDict()

    def load(self, version: str | None = None) -> tuple[Cascade, Scaler | None]:
        entry = self.manifest(version)
        home = f"{self.root}/models/version={entry['version']}/revision={entry['revision']}"
        model = Cascade.from_parts(entry["model"], self.spark.read.parquet(f"{home}/nodes"))
        scaler = Scaler.load(self.spark, f"{home}/scaler") if path_exists(self.spark, f"{home}/scaler") else None
        return model, scaler
