"""Approximate nearest neighbours by stable projections and a kd-tree.

A vector is projected on M Gaussian (2-stable) directions, so a squared projected distance over the squared true distance is chi-square
with M degrees of freedom. The kd-tree's top (fitted on a bounded sample) deals all projected rows into cells; each cell's own tree is
built where its rows are. A query first meets its home cell, then those cells alone whose region passes the chi-square test for the K-th
distance it has so far. In a cell, projected neighbours come in order of projected distance and are verified by true distance, until the
test says that what is left beats the K-th best with a chance below 1 - CONFIDENCE.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise, small_batches, table

#: Documented parameters: directions, neighbours, stopping confidence, leaf size; distinct vectors of a cell, cells at most, rows of the
#: sample that the top of the tree is fitted on; vectors and queries of a group.
M, K, CONFIDENCE, LEAF, CELL, MAX_CELLS, SAMPLE, SHARD, BLOCK, SEED = 24, 10, 0.95, 128, 8192, 1024, 16_384, 16_384, 65_536, 4


def chi_square_quantile(p: float, m: int) -> float:
    """The value below which a chi-square variable with m (even) degrees of freedom falls with chance p, by bisection of its closed form."""
    def below(x: float) -> float:
        term = total = np.exp(-x / 2)
        for k in range(1, m // 2):
            term *= x / 2 / k
            total += term
        return 1 - total

    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(d: int, m: int = M) -> np.ndarray:
    return np.random.default_rng((SEED, d)).standard_normal((d, m))


class KdTree:
    """Median splits of the widest side down to leaves of LEAF points; box corners of every node."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left, right (-1: leaf)
        self.low, self.high = [], []
        self._build(0, len(points))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, a: int, b: int) -> int:
        at = len(self.nodes)
        p = self.points[self.order[a:b]]
        self.low.append(p.min(axis=0))
        self.high.append(p.max(axis=0))
        self.nodes.append((a, b, -1, -1))
        side = int((self.high[at] - self.low[at]).argmax())
        if b - a > LEAF and self.high[at][side] > self.low[at][side]:
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(p[:, side], mid)]
            left = self._build(a, a + mid)
            self.nodes[at] = (a, b, left, self._build(a + mid, b))
        return at

    def leaves(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared distance to the leaf's box, its points), nearest box first."""
        gap = lambda i: float((np.maximum(0, np.maximum(self.low[i] - q, q - self.high[i])) ** 2).sum())
        heap = [(gap(0), 0)]
        while heap:
            d, i = heapq.heappop(heap)
            a, b, left, right = self.nodes[i]
            if left < 0:
                yield d, self.order[a:b]
            else:
                heapq.heappush(heap, (gap(left), left))
                heapq.heappush(heap, (gap(right), right))


class TopTree:
    """The top of the kd-tree: median splits of a sample's widest side, until there are so many cells; each cell's region is a box."""

    def __init__(self, points: np.ndarray, cells: int):
        self.low, self.high = [np.full(points.shape[1], -np.inf)], [np.full(points.shape[1], np.inf)]
        self.splits: list[tuple[int, int, float]] = []  # cell, side, value: rows of the cell at value or above move to a new last cell
        todo = [(len(points), 0, points)]
        while len(self.low) < cells and todo:
            _, cell, own = todo.pop(max(range(len(todo)), key=lambda i: todo[i][0]))
            if len(own) < 2:
                break
            side = int((own.max(axis=0) - own.min(axis=0)).argmax())
            value = float(np.median(own[:, side]))
            up = own[:, side] >= value
            if up.all():
                continue  # equal points cannot be parted
            self.splits.append((cell, side, value))
            self.low.append(self.low[cell].copy())
            self.high.append(self.high[cell].copy())
            self.high[cell][side] = self.low[-1][side] = value
            todo += [(int((~up).sum()), cell, own[~up]), (int(up.sum()), len(self.low) - 1, own[up])]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def cell(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for new, (cell, side, value) in enumerate(self.splits, 1):
            at[(at == cell) & (points[:, side] >= value)] = new
        return at

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance to each cell's region."""
        return (np.maximum(0, np.maximum(self.low - q, q - self.high)) ** 2).sum(axis=1)


def search(tree: KdTree, vectors: np.ndarray, q: np.ndarray, projected: np.ndarray, k: int, limit: float, kth: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and squared distances of the k nearest found (k-th ties kept in full among what was verified), and how many were verified.

    kth: a squared distance within which k are known already.
    """
    rows, dist, verified = np.zeros(0, np.int64), np.zeros(0), 0
    wait, apart = np.zeros(0, np.int64), np.zeros(0)  # points of opened leaves, and their projected distances

    def verify(some: np.ndarray) -> None:
        nonlocal rows, dist, verified, kth
        verified += len(some)
        d = ((vectors[some] - q) ** 2).sum(axis=1)
        keep = d <= kth
        rows, dist = np.concatenate([rows, some[keep]]), np.concatenate([dist, d[keep]])
        if len(dist) >= k:
            kth = min(kth, np.partition(dist, k - 1)[k - 1])
            rows, dist = rows[dist <= kth], dist[dist <= kth]

    for gap, leaf in tree.leaves(projected):
        ready = apart <= gap
        if ready.any():
            verify(wait[ready])
            left = ~ready & (apart <= limit * kth)
            wait, apart = wait[left], apart[left]
        # What is left has squared projected distance of gap or more: nearer than kth with a chance below 1 - CONFIDENCE.
        if gap > limit * kth:
            break
        d = ((tree.points[leaf] - projected) ** 2).sum(axis=1)
        near = d <= limit * kth
        wait, apart = np.concatenate([wait, leaf[near]]), np.concatenate([apart, d[near]])
    order = np.argsort(apart, kind="stable")
    for at in range(0, len(order), LEAF):
        some = order[at : at + LEAF]
        if apart[some[0]] > limit * kth:
            break
        verify(wait[some[apart[some] <= limit * kth]])
    return rows, dist, verified


def usable(vec: str = "embedding") -> Column:
    """Vectors that take part: not null, not empty, all components finite, not zero."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _meet(cells: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, verified: each of asks (query_id, q, size, cell, kth) against the rows of its cell.

    A cell of more than SHARD rows is dealt over several groups by hash, which each query visits; one that more than BLOCK queries visit
    has its rows once for each block of them. So a group's size is bounded, whatever cell is hot.
    """
    key = ["size", "cell"]
    plan = cells.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards")).join(asks.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), key)
    plan = F.broadcast(plan)  # at most MAX_CELLS rows for each vector length
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = cells.join(plan, key).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards"))).withColumn("block", numbers("blocks"))
    right = asks.join(plan, key).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).withColumn("shard", numbers("shards"))
    limit = chi_square_quantile(CONFIDENCE, M)

    def run(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(some):
            x, ids = np.stack(rows["embedding"].to_list()), rows["ids"].to_list()
            a = directions(x.shape[1])
            tree = KdTree(x @ a)
            for qid, q, kth in zip(some["query_id"], some["q"], some["kth"]):
                at, d, n = search(tree, x, q, q @ a, k + 1, limit, kth * kth * (1 + 1e-12))
                best = sorted((e, int(i)) for r, e in zip(at, d) for i in ids[r] if i != qid)[:k]
                out += [(int(qid), i, float(np.sqrt(e)), n) for e, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"])

    group = ["size", "cell", "shard", "block"]
    return left.select(*group, "embedding", "ids").groupBy(group).cogroup(right.select(*group, "query_id", "q", "kth").groupBy(group)).applyInPandas(run, "query_id long, vec_id long, score double, verified long")


def top_trees(distinct: DataFrame, rows: int) -> dict[int, TopTree]:
    """A top tree for each vector length of a sample of SAMPLE rows at most, chosen by hash. Lengths that it misses have one cell."""
    cells = min(MAX_CELLS, max(1, -(-rows // CELL)))
    if cells == 1:
        return {}
    # A hash threshold picks about SAMPLE rows where they are; the limit holds the bound, and a hash's order makes it the same each time.
    share = min(1.0, 1.2 * SAMPLE / rows)
    draw = F.pmod(F.xxhash64("embedding", F.lit(SEED)), F.lit(1 << 30))
    few = distinct.select("embedding", draw.alias("draw")).where(F.col("draw") < int(share * (1 << 30))).orderBy("draw", "embedding").limit(SAMPLE).select("embedding")
    by: dict[int, list] = {}
    for r in few.toLocalIterator():
        by.setdefault(len(r[0]), []).append(r[0])
    return {size: TopTree(np.array(v) @ directions(size), max(1, cells * len(v) // max(sum(map(len, by.values())), 1))) for size, v in by.items()}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of vectors but itself, by Euclidean distance in double precision.

    Both: vec_id, embedding (others ignored). Null, empty, zero and non-finite vectors take no part, as candidates or queries. Ties
    go to the smaller vec_id: equal vectors are one point with the k + 1 smallest ids, so no group of copies is cut in the tree's order.
    Rows that repeat an id count once; queries meet only vectors of their length. Empty tables give no rows.
    """
    return found_neighbours(vectors, queries, k).select("query_id", "rank", "vec_id", "score")


def found_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """As nearest(), with verified: how many vectors the groups that gave the row compared truly for the query."""
    small_batches(vectors.sparkSession)
    # k + 1 ids of each distinct vector are enough; the ranked filter drops the rest before the shuffle.
    first = W.partitionBy("embedding").orderBy("vec_id")
    clean = vectors.where(usable() & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    ranked = clean.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    distinct = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # Written once, as it is read for the sample, for the cells' sizes and for both rounds.
    distinct = materialise(distinct, "vectors")
    asked = queries.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).distinct()
    trees = top_trees(distinct, distinct.count())

    def dealt(vec: str):
        """Adds size and cell to rows with a vector."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                f["size"], f["cell"] = f[vec].map(len).astype("int32"), np.int32(0)
                for size, own in f.groupby("size"):
                    if size in trees:
                        f.loc[own.index, "cell"] = trees[size].cell(np.stack(own[vec].to_list()) @ directions(size)).astype("int32")
                yield f

        return run

    cells = distinct.mapInPandas(dealt("embedding"), "embedding array<double>, ids array<long>, size int, cell int")
    home = asked.mapInPandas(dealt("q"), "query_id long, q array<double>, size int, cell int")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    found = _meet(cells, home.withColumn("kth", F.lit(float("inf"))), k).withColumn("rank", place).where(F.col("rank") <= k)
    if not any(len(t.low) > 1 for t in trees.values()):
        return found.withColumn("rank", F.col("rank").cast("int"))
    found = materialise(found.drop("rank"), "neighbours")
    best = found.groupBy("query_id").agg(F.max("score").alias("far"), F.count(F.lit(1)).alias("n"))
    known = home.join(best, "query_id", "left").select("query_id", "q", "size", "cell", F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).alias("kth"))
    limit = chi_square_quantile(CONFIDENCE, M)

    def onward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each other cell that the chi-square test does not rule out for a query."""
        for f in frames:
            parts = [f.iloc[:0]]
            for i, (size, q, cell, kth) in enumerate(zip(f["size"], f["q"], f["cell"], f["kth"])):
                if size in trees:
                    go = np.flatnonzero(trees[size].gaps(q @ directions(size)) <= limit * kth * kth)
                    go = go[go != cell]
                    parts.append(f.iloc[np.full(len(go), i)].assign(cell=go.astype("int32")))
                    if sum(map(len, parts)) > 10_000:
                        yield pd.concat(parts)
                        parts = [f.iloc[:0]]
            yield pd.concat(parts)

    more = known.mapInPandas(onward, "query_id long, q array<double>, size int, cell int, kth double")
    both = found.unionByName(_meet(cells, more, k)).withColumn("rank", place).where(F.col("rank") <= k)
    return both.withColumn("rank", F.col("rank").cast("int"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE: dict[str, str] = {}
