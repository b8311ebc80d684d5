"""Resumable ingest: landed responses become tables by Structured Streaming, each item once, hits and misses both remembered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import exists
from tessera.sources.sinks import append_new

LANDED = "lei string, value string"


def pending(wanted: DataFrame, scanned: DataFrame | None) -> DataFrame:
    """The lei of wanted that no scan has covered yet."""
    todo = wanted.where("lei is not null").select("lei").distinct()
    return todo if scanned is None else todo.join(scanned.select("lei").distinct(), "lei", "left_anti")


def scanned_table(spark: SparkSession, root: str) -> DataFrame | None:
    return spark.read.parquet(f"{root}/scanned") if exists(spark, f"{root}/scanned") else None


def ingest(spark: SparkSession, landing: str, root: str, parse: Callable[[DataFrame], DataFrame], keys: list[str], max_files: int = 100) -> None:
    """Take all landed JSON lines (lei, value) that no earlier run took. Every batch appends its parsed rows and its scanned lei.

    The stream's checkpoint remembers files, and appends skip keys that are there, so a run that broke off in a batch can be repeated.
    """

    def flush(batch: DataFrame, _: int) -> None:
        batch = batch.cache()
        append_new(parse(batch), f"{root}/rows", keys)
        append_new(batch.select("lei").where("lei is not null"), f"{root}/scanned", ["lei"])
        batch.unpersist()

    lines = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", max_files).json(landing)
    query = lines.writeStream.foreachBatch(flush).option("checkpointLocation", f"{root}/_stream").trigger(availableNow=True).start()
    query.awaitTermination()


def scan_progress(wanted: DataFrame, scanned: DataFrame | None) -> DataFrame:
    """One row: wanted, scanned, left."""
    n = wanted.where("lei is not null").agg(F.count_distinct("lei").alias("wanted"))
    left = pending(wanted, scanned).agg(F.count("*").alias("left"))
    return n.crossJoin(left).withColumn("scanned", F.col("wanted") - F.col("left"))
