"""Positions over a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.components import cut_lineage

_BITS = 33  # of a row's place in its partition, in monotonically_increasing_id


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with each row's place, from 1, in the given order, which should tell all rows apart.

    Rows are dealt by range and sorted in their partitions; the sorted table is written, so that places and rows come from one run. Only one
    count a partition is added up in order.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id())
    rows, _ = cut_lineage(dealt, "numbered")
    rows = rows.withColumns({"_part": F.shiftright("_id", _BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # one row a partition
    return rows.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1)).drop("_id", "_part", "_at", "_before")
