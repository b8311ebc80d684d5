"""A fitted ensemble over pair features, and the boxes of the feature space in which it can reach a probability.

An ensemble of trees is constant between its thresholds. So nodes of one side that lie between the same thresholds are one class, and pairs
are formed class by class, only in boxes whose bound on the probability allows it; members meet once their classes have passed.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.boosting import Boosted, _leaf
from tessera.operators.components import cut_lineage, drop_table, shared_dir

#: Boxes at most: those that are not settled then stay as they are, and their pairs are scored like all others.
MAX_BOXES = 2048
FEATURES = graph.PAIR_FEATURES
OF_SOURCE = ["source_out_degree", "source_pagerank", "source_component_size"]
OF_TARGET = ["target_in_degree", "target_pagerank", "target_component_size"]
#: Features that are 0 where two nodes have no neighbour in common.
SHARED = ["jaccard_coefficient", "adamic_adar", "common_neighbors"]


@dataclass
class PairModel:
    """Complete trees of one depth (as in boosting): their leaf values' mean is the probability, or, logistic, their sum and bias its logit."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float = 0.0
    logistic: bool = False
    importance: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))

    @staticmethod
    def of_boosted(b: Boosted) -> PairModel:
        return PairModel(b.feature[:, 0], b.threshold[:, 0], b.value[:, 0], float(b.prior[0]), True, b.importances())

    @staticmethod
    def of_forest(model: RandomForestClassificationModel, spark) -> PairModel:
        """From the model's stored form: one row for each node of its trees."""
        path = f"{shared_dir(spark)}/tables/forest-{uuid.uuid4().hex}"
        model.write().save(path)
        rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # the trees' nodes
        drop_table(spark, path)
        nodes = {(r["treeID"], r["id"]): r for r in rows}
        n, depth = len({t for t, _ in nodes}), max(1, model.getMaxDepth())
        out = PairModel(np.full((n, (1 << depth) - 1), -1), np.zeros((n, (1 << depth) - 1)), np.zeros((n, 1 << depth)), importance=model.featureImportances.toArray())

        def fill(tree: int, node: int, level: int, place: int) -> None:
            r = nodes[tree, node]
            if level == depth:
                out.value[tree, place] = r["impurityStats"][1] / sum(r["impurityStats"])
            elif r["leftChild"] < 0:
                fill(tree, node, level + 1, 2 * place)  # a leaf above the last level: all goes left
            else:
                at = (1 << level) - 1 + place
                out.feature[tree, at], out.threshold[tree, at] = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
                fill(tree, r["leftChild"], level + 1, 2 * place)
                fill(tree, r["rightChild"], level + 1, 2 * place + 1)

        for tree in range(n):
            fill(tree, 0, 0, 0)
        return out

    def _joined(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(total + self.bias))) if self.logistic else total / len(self.value)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            total += v[_leaf(x, f, t)]
        return self._joined(total)

    def score(self, rows: DataFrame) -> DataFrame:
        """rows and link_probability, to four places."""

        @F.pandas_udf("double")
        def p(x: pd.Series) -> pd.Series:
            return pd.Series(self.probability(np.stack(x.to_list())) if len(x) else [], dtype=float)

        return rows.withColumn("link_probability", F.round(p(F.array(*[F.col(c).cast("double") for c in FEATURES])), 4))

    def transform(self, rows: DataFrame) -> DataFrame:
        scored = self.score(rows)
        return scored.withColumn("probability", F.array(1 - F.col("link_probability"), F.col("link_probability")))

    def thresholds(self, feature: str) -> list[float]:
        return sorted(set(self.threshold[self.feature == FEATURES.index(feature)].tolist()))

    def reachable(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes and leaves rows with low < x <= high can come to."""
        reach = np.zeros((len(self.feature), self.feature.shape[1] + self.value.shape[1]), bool)
        reach[:, 0] = True
        for at in range(self.feature.shape[1]):
            f, t = self.feature[:, at], self.threshold[:, at]
            reach[:, 2 * at + 1] = reach[:, at] & ((f < 0) | (low[f] < t))
            reach[:, 2 * at + 2] = reach[:, at] & (f >= 0) & (high[f] > t)
        return reach[:, : self.feature.shape[1]], reach[:, self.feature.shape[1] :]

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Least and greatest probability of a box, the reachable inner nodes, and each tree's span of values."""
        inner, leaf = self.reachable(low, high)
        least, most = np.where(leaf, self.value, np.inf).min(axis=1), np.where(leaf, self.value, -np.inf).max(axis=1)
        a, b = self._joined(np.array([least.sum(), most.sum()]))
        return float(a), float(b), inner, most - least

    def _cut(self, low: np.ndarray, high: np.ndarray, inner: np.ndarray, span: np.ndarray) -> tuple[int, float] | None:
        """The feature and threshold, at the top of the trees' undecided parts, that decides most; None where all trees are decided."""
        both = inner & (self.feature >= 0) & (low[self.feature] < self.threshold) & (high[self.feature] > self.threshold)
        tree = np.flatnonzero(both.any(axis=1) & (span > 0))
        if not len(tree):
            return None
        node = both[tree].argmax(axis=1)  # nodes are numbered by level
        weight: dict[tuple[int, float], float] = {}
        for f, t, s in zip(self.feature[tree, node], self.threshold[tree, node], span[tree]):
            weight[int(f), float(t)] = weight.get((int(f), float(t)), 0.0) + float(s)
        return max(weight, key=lambda k: (weight[k], k))

    def boxes(self, floor: float, same: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Disjoint (low, high] boxes that hold every pair without common neighbours that can reach floor, in the same component or not."""
        low, high = np.full(len(FEATURES), -np.inf), np.full(len(FEATURES), np.inf)
        for name in SHARED:
            low[FEATURES.index(name)], high[FEATURES.index(name)] = -1e-9, 0
        at = FEATURES.index("same_component")
        low[at], high[at] = same - 1e-9, same  # one value, so that no cut parts it
        out, heap, turn = [], [], 0

        def add(low: np.ndarray, high: np.ndarray) -> None:
            nonlocal turn
            a, b, inner, span = self.bounds(low, high)
            if b < floor:
                return
            cut = None if a >= floor else self._cut(low, high, inner, span)
            if cut is None:
                out.append((low, high))
            else:
                turn += 1
                heapq.heappush(heap, (a - b, turn, low, high, cut))

        add(low, high)
        while heap and len(heap) + len(out) < MAX_BOXES:
            _, _, low, high, (f, t) = heapq.heappop(heap)
            left, right = high.copy(), low.copy()
            left[f] = right[f] = t
            add(low, left)
            add(right, high)
        return out + [(low, high) for _, _, low, high, _ in heap]


def _between(model: PairModel, features: list[str]) -> list[Column]:
    """For each feature, how many of the ensemble's thresholds lie below the value: what it tells of the value, and no more."""
    at = lambda c: F.size(F.filter(F.array(*[F.lit(t) for t in model.thresholds(c)]).cast("array<double>"), lambda t: t < F.col(c).cast("double")))
    return [at(c).alias(f"at_{c}") for c in features]


def _boxed(classes: DataFrame, features: list[str], boxes: list[tuple[np.ndarray, np.ndarray]], reach: bool = False) -> DataFrame:
    """classes with a row for each box (of MAX_BOXES at most) that they can lie in; reach: also the box's bounds of the degrees' product."""
    own = [FEATURES.index(f) for f in features]
    low, high = np.array([b[0] for b in boxes]).reshape(-1, len(FEATURES)), np.array([b[1] for b in boxes]).reshape(-1, len(FEATURES))

    @F.pandas_udf("array<int>")
    def inside(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_list()) if len(x) else np.zeros((0, len(own)))
        return pd.Series([np.flatnonzero((low[:, own] < r).all(axis=1) & (r <= high[:, own]).all(axis=1)).astype(np.int32) for r in rows])

    out = classes.withColumn("box", F.explode(inside(F.array(*[F.col(c).cast("double") for c in features]))))
    if reach:
        product = FEATURES.index("preferential_attachment")
        bound = lambda side: F.element_at(F.array(*[F.lit(float(x)) for x in side[:, product]]), F.col("box") + 1)
        out = out.withColumns({"low": bound(low), "high": bound(high)}) if boxes else out.withColumns({"low": F.lit(0.0), "high": F.lit(0.0)})
    return out


def side_rows(ids: DataFrame, stats: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """{side}_lei, its own features, degree (undirected) and component of each id. A node outside the graph stands alone."""
    key, degree = f"{side}_lei", graph.undirected(edges).groupBy(F.col("u").alias("lei")).agg(F.sum(F.when(F.col("u") == F.col("v"), 2).otherwise(1)).alias("degree"))
    of = {"source": ("out_degree", "source_out_degree"), "target": ("in_degree", "target_in_degree")}[side]
    rows = ids.join(stats, "lei", "left").join(degree, "lei", "left")
    return rows.select(
        F.col("lei").alias(key), F.coalesce(of[0], F.lit(0)).alias(of[1]), F.coalesce("pagerank", F.lit(0.0)).alias(f"{side}_pagerank"), F.coalesce("weakly_connected_component_size", F.lit(1)).alias(f"{side}_component_size"),
        F.coalesce("degree", F.lit(0)).alias(f"{side}_degree"), F.coalesce("component", F.concat(F.lit(f"{side}|"), "lei")).alias(f"{side}_component"),
    )


def class_pairs(model: PairModel, sources: DataFrame, targets: DataFrame, floor: float, same: int) -> DataFrame:
    """FEATURES, and the classes they are of: pairs of classes that meet in a box that can reach floor.

    sources, targets: side_rows with source_class or target_class. same: classes of one component (its column is kept), else of all.
    """
    boxes = model.boxes(floor, same)
    own = ["component"] if same else []
    part = lambda df, side, features: df.groupBy(*[F.col(f"{side}_component").alias("component")] * same, f"{side}_class", f"{side}_degree").agg(*[F.max(c).alias(c) for c in features])
    left, right = _boxed(part(sources, "source", OF_SOURCE), OF_SOURCE, boxes, True), _boxed(part(targets, "target", OF_TARGET), OF_TARGET, boxes)
    product = (F.col("source_degree") * F.col("target_degree")).cast("double")
    met = left.join(right, [*own, "box"]).withColumn("preferential_attachment", product).where((F.col("low") < product) & (product <= F.col("high")))
    zeros = {c: F.lit(0.0) for c in SHARED}
    return met.withColumns(zeros | {"same_component": F.lit(same)}).select(*own, "source_class", "target_class", "source_degree", "target_degree", *FEATURES)


def near_pairs(sources: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """source_lei, target_lei that have a neighbour in common other than themselves: from the neighbours' rows, never from all pairs."""
    around = graph.undirected(edges)
    mine = around.join(sources.select(F.col("source_lei").alias("u")), "u", "left_semi").select(F.col("u").alias("source_lei"), F.col("v").alias("w"))
    theirs = around.join(targets.select(F.col("target_lei").alias("u")), "u", "left_semi").select(F.col("u").alias("target_lei"), F.col("v").alias("w"))
    met = mine.join(theirs, "w").where((F.col("w") != F.col("source_lei")) & (F.col("w") != F.col("target_lei")) & (F.col("source_lei") != F.col("target_lei")))
    return met.select("source_lei", "target_lei").distinct()


def likely_pairs(model: PairModel, sources: DataFrame, targets: DataFrame, edges: DataFrame, stats: DataFrame, floor: float) -> DataFrame:
    """source_lei, target_lei, link_probability of every pair (but of a node with itself) at floor or more, to four places.

    sources, targets: lei, each once. stats: as pair_features reads. Pairs with a common neighbour are few and scored one by one; all others
    are scored by classes. So pairs are formed only where they pass, or have a common neighbour.
    """
    keyed = lambda df, side, features: df.withColumn(f"{side}_class", F.concat_ws("|", *_between(model, features)))
    s, _ = cut_lineage(keyed(side_rows(sources, stats, edges, "source"), "source", OF_SOURCE), "link-sources")
    t, _ = cut_lineage(keyed(side_rows(targets, stats, edges, "target"), "target", OF_TARGET), "link-targets")
    at = floor - 0.5e-4 - 1e-9  # rounding lifts no more
    near, _ = cut_lineage(near_pairs(s, t, edges), "near-pairs")
    rows, _ = cut_lineage(graph.pair_features(near, edges, stats), "near-features")
    good = model.score(rows.select(*FEATURES).distinct()).where(F.col("link_probability") >= floor)
    out = rows.join(good, FEATURES).select("source_lei", "target_lei", "link_probability")
    # Nodes of one component: only sources with an edge share theirs.
    linked = s.where("source_degree > 0")
    beside = t.join(linked.select(F.col("source_component").alias("target_component")).distinct(), "target_component", "left_semi")
    key = ["source_class", "target_class", "source_degree", "target_degree"]
    passed = lambda met, own: model.score(met).where(F.col("link_probability") >= floor).select(*own, *key, "link_probability")
    inside = passed(class_pairs(model, linked, beside, at, 1), ["component"])
    within = inside.join(linked.withColumnRenamed("source_component", "component"), ["component", "source_class", "source_degree"]).join(beside.withColumnRenamed("target_component", "component"), ["component", "target_class", "target_degree"])
    within = within.select("source_lei", "target_lei", "link_probability").where(F.col("source_lei") != F.col("target_lei")).join(near, ["source_lei", "target_lei"], "left_anti")
    across, _ = cut_lineage(passed(class_pairs(model, s, t, at, 0), []), "link-classes")
    apart = across.join(s, ["source_class", "source_degree"]).join(t, ["target_class", "target_degree"]).where(F.col("source_component") != F.col("target_component"))
    return out.unionByName(within).unionByName(apart.select("source_lei", "target_lei", "link_probability").where(F.col("source_lei") != F.col("target_lei")))
