"""Writing results: Parquet, CSV, model artifacts, idempotent checkpoints, stage states, manifests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import exists


def save_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def save_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """With a header; one file is for reports, which are small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def save_all_csv(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        save_csv(df, f"{root}/{name}")


def save_model(trained, root: str, spark: SparkSession) -> None:
    """A trained model, its figures, confusion counts and importances under root. A constant answer has no model."""
    from tessera.operators.boosting import BoostedPipeline
    from tessera.operators.jurisdiction import importances

    if trained.model is not None:
        if isinstance(trained.model, BoostedPipeline):
            trained.model.save(f"{root}/model", spark)
        else:
            trained.model.write().overwrite().save(f"{root}/model")
    figures = {k: v for k, v in trained.metrics.items() if not isinstance(v, DataFrame)}
    spark.createDataFrame([(json.dumps(figures, default=str), json.dumps(trained.labels))], "metrics string, labels string").write.mode("overwrite").json(f"{root}/metrics")
    if "confusion" in trained.metrics:
        save_csv(trained.metrics["confusion"], f"{root}/confusion")
    rows = importances(trained)
    if rows:
        save_csv(spark.createDataFrame(rows, "feature string, importance double"), f"{root}/importances")


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys are not there yet; running it again adds nothing. Returns how many were new."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    new = new.cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


class StageStates:
    """pending, running, done or failed for (country, stage): every change is an appended row, the last one counts."""

    SCHEMA = "country string, stage string, status string, detail string, at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        df = self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)
        return df.groupBy("country", "stage").agg(F.max_by(F.struct("status", "detail"), "at").alias("s"), F.max("at").alias("at")).select("country", "stage", "s.status", "s.detail", "at")

    def mark(self, country: str, stage: str, status: str, detail: str = "") -> None:
        row = self.spark.range(1).select(F.lit(country).alias("country"), F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.lit(detail).alias("detail"), F.current_timestamp().alias("at"))
        row.write.mode("append").parquet(self.path)

    def is_done(self, country: str, stage: str) -> bool:
        return not self.table().where((F.col("country") == country) & (F.col("stage") == stage) & (F.col("status") == "done")).isEmpty()

    def reset(self, country: str) -> None:
        for r in self.table().where(F.col("country") == country).select("stage").collect():  # a handful of stages
            self.mark(country, r["stage"], "pending")


def last_modified(spark: SparkSession, path: str) -> str:
    """ISO time (UTC, to the second) of a file or folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()
    return datetime.fromtimestamp(at / 1000, timezone.utc).isoformat(timespec="seconds")


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """role, path, exists, rows of Parquet tables (counts come from file footers), and when each was last changed, as the store says."""
    rows = [(role, p, True, spark.read.parquet(p).count(), last_modified(spark, p)) if exists(spark, p) else (role, p, False, None, None) for role, p in paths.items()]
    return spark.createDataFrame(rows, "role string, path string, exists boolean, rows long, last_modified string")
