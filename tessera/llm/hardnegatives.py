"""Hard negatives by a Voronoi-partitioned, distributed join for the largest inner products.

Inner products become distances by a further coordinate: with R the largest norm, a candidate c gets sqrt(R^2 - |c|^2) and an anchor a
gets 0, so |a' - c'|^2 = |a|^2 + R^2 - 2<a, c>, and the largest inner product is the nearest neighbour. Both are assigned to their nearest
of a bounded number of pivots. What a cell's anchors need reaches a certain distance around its pivot (its reach), which follows from the
cells' summaries; by the triangle inequality a candidate outside cannot serve them. So candidates are copied only to the groups of cells that
they might serve, and each group is joined exactly where it is. The first join gives each anchor's positives; their scores say how far
the negatives of its band can be, which is the reach of the second.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise, small_batches, table

#: Documented parameters: positives of an anchor, negatives of a pair, the band of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Points for each pivot, pivots at most; anchors of a group, candidates of a shard of it; scores that are held at once; the sample's seed.
CELL, MAX_PIVOTS, GROUP, SHARD, HELD, SEED = 1024, 256, 8192, 4096, 1 << 22, 12
#: Scores of this size or more are held at it, so that a hundred of one fit in a long.
MOST = 1 << 56

Pivots = dict[int, np.ndarray]


class Space:
    """The pivots of each vector length, augmented, and the largest squared norm of any vector."""

    def __init__(self, pivots: dict[int, np.ndarray], most: float):
        self.most = most
        self.pivots = {d: self.raised(x.astype(float), False) for d, x in pivots.items()}

    def raised(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def slack(self, d: int) -> float:
        """More than rounding can move a distance or a reach."""
        return 1e-7 * np.sqrt(self.most * (d + 1)) + 1e-9

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Of each vector to each pivot of its length; lengths that have none share one cell around the origin."""
        y = self.raised(x.astype(float), anchors)
        p = self.pivots.get(x.shape[1], np.zeros((1, x.shape[1] + 1)))
        return np.sqrt(np.maximum((y * y).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * y @ p.T, 0))

    def between(self, d: int) -> np.ndarray:
        p = self.pivots.get(d, np.zeros((1, d + 1)))
        return np.sqrt(((p[:, None] - p) ** 2).sum(axis=2))

    def order(self, d: int) -> np.ndarray:
        """Places of the pivots along median splits of their widest side, so that neighbours in order are near each other."""
        p = self.pivots.get(d, np.zeros((1, d + 1)))
        out = np.empty(len(p), int)

        def split(own: np.ndarray, first: int) -> None:
            if len(own) < 2:
                out[own] = first
                return
            side = (p[own].max(axis=0) - p[own].min(axis=0)).argmax()
            own, half = own[np.argsort(p[own, side], kind="stable")], len(own) // 2
            split(own[:half], first)
            split(own[half:], first + half)

        split(np.arange(len(p)), 0)
        return out


def by_length(vectors: pd.Series, f: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """f(places, vectors as a matrix) for the rows of each vector length."""
    sizes = vectors.map(len).to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        f(at, np.stack(vectors.iloc[at].to_list()).reshape(len(at), d))


def nearest_pivot(space: Space, anchors: bool):
    """A column function: cell and dist (to its pivot) of each vector."""

    @F.pandas_udf("cell int, dist double")
    def cell(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": np.zeros(len(vectors), np.int32), "dist": np.zeros(len(vectors))})

        def fill(at: np.ndarray, x: np.ndarray) -> None:
            d = space.distances(x, anchors)
            out.iloc[at, 0], out.iloc[at, 1] = d.argmin(axis=1).astype(np.int32), d.min(axis=1)

        by_length(vectors, fill)
        return out

    return cell


def served(space: Space, x: np.ndarray, cells: np.ndarray, reach: np.ndarray, groups: np.ndarray) -> list[list[int]]:
    """For each candidate, the groups of the cells whose reach it lies in."""
    near = space.distances(x, False)[:, cells] <= reach + space.slack(x.shape[1])
    return [np.unique(groups[row]).tolist() for row in near]


def grouped(space: Space, d: int, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A group number for each cell: cells in the pivots' order, cut at GROUP anchors or more."""
    by = np.argsort(space.order(d)[cells])
    out = np.empty(len(cells), np.int64)
    out[by] = (np.cumsum(counts[by]) - counts[by]) // GROUP
    return out


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, held at MOST in size."""
    size = int(max(1, np.abs(a).max(initial=0))) * int(max(1, np.abs(c).max(initial=0))) * max(1, a.shape[1])
    if size < 1 << 53:
        return (a.astype(float) @ c.T.astype(float)).astype(np.int64)
    if size < MOST:
        return a @ c.T
    return np.clip(a.astype(object) @ c.T.astype(object), -MOST, MOST).astype(np.int64)


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= kth)
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (array<long>): rows that take part, one for each id (the smallest label, then vector)."""
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(F.exists("vector", lambda x: x.isNull()), F.lit(True))
    some = vectors.select("vec_id", "label", F.col("vector").cast("array<long>").alias("vector")).where(whole)
    one = F.row_number().over(W.partitionBy("vec_id").orderBy("label", "vector"))
    return some.withColumn("_n", one).where("_n = 1").drop("_n")


def dealt(candidates: DataFrame, anchors: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with shard and block, and the columns of a group: SHARD candidates and GROUP anchors or so, however hot a key is.

    A key's candidates are dealt over its shards, which each anchor visits; beyond GROUP anchors, candidates come once for each block of them.
    """
    plan = candidates.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards")).join(anchors.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("blocks")), key)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = candidates.join(plan, key).withColumn("shard", F.pmod(F.xxhash64("label", "vector"), F.col("shards"))).withColumn("block", numbers("blocks"))
    right = anchors.join(plan, key).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).withColumn("shard", numbers("shards"))
    group = [*key, "shard", "block"]
    return left.select(*group, *[c for c in candidates.columns if c not in key]), right.select(*group, *[c for c in anchors.columns if c not in key]), group


def spread(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of points with several ids each: the points' vectors, and each id's point and the id."""
    at = np.repeat(np.arange(len(frame)), frame["ids"].map(len))
    return np.stack(frame["vector"].to_list()), at, np.concatenate(frame["ids"].to_list()).astype(np.int64)


def blocks_of(a: np.ndarray, c: np.ndarray):
    """(first row, scores) of as many anchors at once as HELD allows."""
    step = max(1, HELD // max(1, len(c)))
    for at in range(0, len(a), step):
        yield at, scores(a[at : at + step], c)


def best_positives(points: DataFrame, anchors: DataFrame, space: Space, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score: each anchor's first k other rows of its label."""
    need = k + 1  # the anchor may be among them
    cell = nearest_pivot(space, False)
    # A summary of each label's cells: the distances of the need rows nearest to the pivot, and the farthest anchor.
    inside = points.withColumn("at", cell("vector")).select("label", "size", "at.cell", "at.dist", F.explode("ids"))
    near = inside.withColumn("_n", F.row_number().over(W.partitionBy("label", "size", "cell").orderBy("dist"))).where(F.col("_n") <= need)
    near = near.groupBy("label", "size", "cell").agg(F.collect_list("dist").alias("near"))
    far = anchors.groupBy("label", "size", "cell").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("anchors"))
    summary = near.join(far, ["label", "size", "cell"], "full")

    def bounds(cells: pd.DataFrame) -> pd.DataFrame:
        """One label's cells with anchors, at most MAX_PIVOTS: reach and group."""
        d = int(cells["size"].iloc[0])
        own = cells[cells["anchors"].notna()]
        if not len(own):
            return pd.DataFrame(columns=["label", "size", "cells", "reach", "groups"])
        between, at = space.between(d), own["cell"].to_numpy()
        some = [(j, float(x)) for j, xs in zip(cells["cell"], cells["near"]) if xs is not None for x in xs]
        js, xs = np.array([j for j, _ in some], int), np.array([x for _, x in some])
        # The k-th other row is no farther from an anchor than far + this; so it is no farther from the pivot than far twice + this.
        kth = np.sort(between[np.ix_(at, js)] + xs, axis=1)[:, need - 1] if len(some) >= need else np.full(len(at), np.inf)
        groups = grouped(space, d, at, own["anchors"].to_numpy().astype(int))
        return pd.DataFrame({"label": [cells["label"].iloc[0]], "size": [d], "cells": [at], "reach": [2 * own["far"].to_numpy() + kth], "groups": [groups]})

    known = materialise(summary.groupBy("label", "size").applyInPandas(bounds, "label long, size int, cells array<int>, reach array<double>, groups array<long>"), "negatives-bounds")

    @F.pandas_udf("array<long>")
    def serves(vectors: pd.Series, cells: pd.Series, reach: pd.Series, groups: pd.Series) -> pd.Series:
        out = [[]] * len(vectors)

        def fill(at: np.ndarray, x: np.ndarray) -> None:
            near = space.distances(x, False)
            for i, row in zip(at, near):
                out[i] = np.unique(groups.iloc[i][row[cells.iloc[i]] <= reach.iloc[i] + space.slack(x.shape[1])]).tolist()

        by_length(vectors, fill)
        return pd.Series(out)

    # One row for each label: Spark sends it to all where it is small, and splits a label that is hot where it is not.
    sent = points.join(known, ["label", "size"]).select("label", "size", F.explode(serves("vector", "cells", "reach", "groups")).alias("grp"), "vector", "ids")
    of = known.select("label", "size", F.explode(F.arrays_zip("cells", "groups")).alias("z")).select("label", "size", F.col("z.cells").alias("cell"), F.col("z.groups").alias("grp"))
    left, right, group = dealt(sent, anchors.join(of, ["label", "size", "cell"]).select("label", "size", "grp", "vec_id", "vector"), ["label", "size", "grp"])

    def join(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            x, at, ids = spread(rows)
            a, own = np.stack(asks["vector"].to_list()), asks["vec_id"].to_numpy()
            for start, s in blocks_of(a, x):
                for i, row in enumerate(s):
                    # More ids than points: the points' scores choose before ids are looked at.
                    full = row[at]
                    me = own[start + i]
                    out += [(me, ids[j], full[j]) for j in first(full, ids, need) if ids[j] != me][:k]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    part = left.groupBy(group).cogroup(right.groupBy(group)).applyInPandas(join, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return part.withColumn("place", place).where(F.col("place") <= k).drop("place")


def banded(points: DataFrame, anchors: DataFrame, pairs: DataFrame, space: Space, k: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, negative_id, negative_score: of each pair, the first k rows of another label in its band."""
    lists = pairs.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("pairs"), F.min("positive_score").alias("least"))
    asks = anchors.join(lists, anchors["vec_id"] == lists["anchor_id"]).drop("anchor_id")
    # |a' - c'|^2 = |a|^2 + R^2 - 2<a, c>, and no negative of the anchor scores below low hundredths of its least positive.
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    away = F.sqrt(F.greatest(F.lit(0.0), square + F.lit(space.most) - F.lit(low / 50) * F.col("least")))
    reach = asks.groupBy("size", "cell").agg(F.max(F.col("dist") + away).alias("reach"), F.count(F.lit(1)).alias("anchors"))
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    rows = reach.toPandas()  # a row for each pivot with anchors: MAX_PIVOTS at most, and one for each length without pivots
    for d, own in rows.groupby("size"):
        cells = own["cell"].to_numpy()
        known[int(d)] = cells, own["reach"].to_numpy(), grouped(space, int(d), cells, own["anchors"].to_numpy())

    @F.pandas_udf("array<long>")
    def serves(vectors: pd.Series) -> pd.Series:
        out = [[]] * len(vectors)

        def fill(at: np.ndarray, x: np.ndarray) -> None:
            if x.shape[1] in known:
                for i, some in zip(at, served(space, x, *known[x.shape[1]])):
                    out[i] = some

        by_length(vectors, fill)
        return pd.Series(out)

    @F.pandas_udf("long")
    def group_of(size: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series([int(known[d][2][known[d][0] == c][0]) for d, c in zip(size, cell)])

    sent = points.select("size", F.explode(serves("vector")).alias("grp"), "label", "vector", F.slice("ids", 1, k).alias("ids"))
    left, right, group = dealt(sent, asks.select("size", group_of("size", "cell").alias("grp"), "vec_id", "label", "vector", "pairs"), ["size", "grp"])

    def join(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            x, at, ids = spread(rows)
            labels = rows["label"].to_numpy()
            a = np.stack(asks["vector"].to_list())
            for start, s in blocks_of(a, x):
                for i, row in enumerate(s):
                    me, own, pairs = asks["vec_id"].iloc[start + i], asks["label"].iloc[start + i], asks["pairs"].iloc[start + i]
                    least = min(p["positive_score"] for p in pairs)
                    some = np.flatnonzero((100 * row >= low * least) & (labels != own))
                    some = np.flatnonzero(np.isin(at, some)) if len(some) < len(row) else np.arange(len(at))
                    value, name = row[at[some]], ids[some]
                    for p in pairs:
                        good = p["positive_score"]
                        fit = np.flatnonzero((low * good <= 100 * value) & (100 * value <= high * good))
                        out += [(me, p["positive_id"], good, name[fit[j]], value[fit[j]]) for j in first(value[fit], name[fit], k)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    part = left.groupBy(group).cogroup(right.groupBy(group)).applyInPandas(join, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    place = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return part.withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("int"))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, vector (integers; others ignored). anchor: a condition on vec_id. An anchor's positives are its first other rows of
    its label by inner product, ties to the smaller vec_id; each pair's negatives are the first rows of other labels whose score lies from low
    to high hundredths of the positive's. A pair of negative score has none, nor has an anchor that stands alone in its label.

    Rows with a null id, label, vector or component take no part; of rows that repeat an id, the one with the smallest label, then vector.
    Vectors meet only those of their length; zero vectors score 0 everywhere, and a pair that scores 0 has negatives that score 0. Equal
    vectors of one label are one point with as many smallest ids as can be needed, so groups of copies cost no more. Empty tables give no
    rows. Components are longs; scores beyond 2^56 are held there.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = clean(vectors).withColumn("size", F.size("vector")).withColumn("label", F.col("label").cast("long"))
    keep = max(positives + 1, negatives)
    place = F.row_number().over(W.partitionBy("label", "vector").orderBy("vec_id"))
    points = rows.withColumn("_n", place).where(F.col("_n") <= keep).groupBy("label", "size", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = materialise(points, "negatives-points")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most = points.agg(F.count(F.lit(1)), F.max(square)).first()
    few = points.select("vector").orderBy(F.xxhash64("vector", F.lit(SEED)), "vector").limit(max(1, min(MAX_PIVOTS, n // CELL)))
    pivots: dict[int, list] = {}
    for r in few.toLocalIterator():
        pivots.setdefault(len(r[0]), []).append(r[0])
    space = Space({d: np.array(v, dtype=np.int64).reshape(len(v), d) for d, v in pivots.items()}, float(most or 0.0) * (1 + 1e-12))
    asked = rows.where(anchor).withColumn("at", nearest_pivot(space, True)("vector"))
    asked = materialise(asked.select("vec_id", "label", "size", "vector", "at.cell", "at.dist"), "negatives-anchors")
    pairs = materialise(best_positives(points, asked, space, positives), "negatives-pairs")
    return banded(points, asked, pairs, space, negatives, low, high).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lambda c: c.cast("double")
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(whole.select("vec_id", label.alias("label"), F.transform("embedding", lambda c: F.floor(256 * x(c))).alias("vector")), F.col("vec_id") % 50 == 0)


ORACLE: dict[str, str] = {
    "op12_hard_negatives": """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), pos AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM met WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN met USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3"""
}
