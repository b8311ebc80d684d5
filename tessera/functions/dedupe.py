"""First row of each key, in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.schemas import ORDINAL


def first_by(df: DataFrame, keys: str | list[str], *order: Column | str, keep_ordinal: bool = False) -> DataFrame:
    """The first row of each key by order, then the ordinal, then all columns: a stated result whatever the row order.

    The ranked filter lets Spark drop all but one row of a key before the shuffle, so hot keys cost one row a task.
    """
    keys = [keys] if isinstance(keys, str) else keys
    simple = [F.col(c).asc_nulls_last() for c, t in df.dtypes if c not in keys and c != ORDINAL and not t.startswith(("map", "array", "struct"))]
    by = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order] + ([F.col(ORDINAL).asc_nulls_last()] if ORDINAL in df.columns else []) + simple
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*(by or keys)))
    out = df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
    return out if keep_ordinal or ORDINAL not in df.columns else out.drop(ORDINAL)
