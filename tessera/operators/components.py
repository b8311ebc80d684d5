"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that this process wrote and has not dropped, for scratch().
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session; a temporary one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or f"{tempfile.gettempdir()}/checkpoints"


def cut_lineage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder, and its path: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as a shuffle has. A small file may hold many rows, and is one scan task however long the work on a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def drop_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut_lineage writes inside are deleted at the end, when the results that rest on them must be stored."""
    before = set(WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in WRITTEN if p not in before]:
            drop_table(spark, path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Each node's least neighbour comes from a partial aggregate and is joined back, so no neighbour list is gathered.

    large: neighbours above a node move to the least of node and neighbours. small: node and its neighbours below move there.
    """
    if large:
        both = edges.union(edges.select(F.col("dst"), F.col("src"))).toDF("u", "v")
    else:
        both = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    moved = joined.where(F.col("v") > F.col("u")) if large else joined.select("v", "m").union(least.select("u", "m")).toDF("v", "m")
    return moved.select(F.col("v").alias("src"), F.col("m").alias("dst")).where(F.col("src") != F.col("dst")).distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """edges with lineage cut, the path, and a count with an order-free hash sum.

    The mark is its own scan of the written columns: an Observation would make the session unfit for closures of Spark ML models.
    """
    now, path = cut_lineage(edges, "components")
    return now, path, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def component_labels(edges: DataFrame, max_steps: int = 500) -> DataFrame:
    """(node, component) for every node of edges (src, dst): component is the least node that edges reach, in either direction.

    Edges with a null end and self-loops alone add nothing. Steps end when the edge set no longer changes, which a count and an
    order-free hash sum tell; each step's table is written to the shared folder, and the one before the last is deleted. Steps grow with
    the logarithm of the longest path; if they have not ended after max_steps, an error says so.
    """
    spark = edges.sparkSession
    now = edges.select(F.col("src"), F.col("dst")).where("src is not null and dst is not null and src <> dst").distinct()
    now, path, mark = _marked(now)
    old = [path]
    for _ in range(max_steps):
        if not mark[0]:
            break
        seen = mark
        now, path, mark = _marked(_star(_star(now, True), False))
        old.append(path)
        if len(old) > 2:
            drop_table(spark, old.pop(0))
        if mark == seen:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_steps} steps")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select("dst", "dst").distinct())


def merged_labels(labels: DataFrame, added: DataFrame, max_steps: int = 500) -> DataFrame:
    """component_labels of a graph after edges were added, from its labels (node, component) before and the added edges (src, dst) alone.

    Each end of an added edge stands for its component (a new node for itself), so the steps run on a graph of components whose size is
    that of the addition; no old edge is read. A component is named by its least node, and the least name of those that meet is the least
    node of their union, so the result equals a fresh start on all edges. Edges with a null end, self-loops and edges within a component
    join nothing; new nodes of self-loops alone get no row, as in component_labels. labels: a node once.
    """
    ends = added.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()
    # Read twice below, and to be joined with all labels once: both ends of an edge as rows of one table.
    of = labels.select(F.col("node"), F.col("component"))
    sides = ends.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("first")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("first")))).alias("e")).select("e.*")
    placed, path = cut_lineage(sides.join(of, "node", "left").select("node", "other", "first", F.col("component").isNull().alias("new"), F.coalesce("component", "node").alias("at")), "contracted")
    one = placed.where("first").select(F.col("node").alias("src"), F.col("other").alias("dst"), F.col("at").alias("a"))
    two = placed.where("not first").select(F.col("other").alias("src"), F.col("node").alias("dst"), F.col("at").alias("b"))
    renamed = component_labels(one.join(two, ["src", "dst"]).select(F.col("a").alias("src"), F.col("b").alias("dst")), max_steps).toDF("old", "now")
    fresh = placed.where("new").select("node", F.col("at").alias("component")).distinct()
    out = of.union(fresh).join(renamed, F.col("component") == F.col("old"), "left").select("node", F.coalesce("now", "component").alias("component"))
    out, _ = cut_lineage(out, "merged")
    drop_table(added.sparkSession, path)
    return out
