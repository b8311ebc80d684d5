import numpy as np
import pytest
from helpers import REL, frame
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.operators import boosting, graph, holdout, links, pairmodel
from tessera.operators.components import cut_lineage

rng = np.random.default_rng(7)
NAMES = pairmodel.FEATURES


def rows_of(n):
    """Feature rows as pairs have them, and labels that depend on several."""
    x = np.column_stack([rng.random(n) * (rng.random(n) < 0.3), rng.random(n) * (rng.random(n) < 0.3), rng.integers(0, 9, n), rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(0, 4, n), rng.integers(0, 12, n), rng.random(n) / 50, rng.random(n) / 50, rng.integers(1, 40, n), rng.integers(1, 40, n)]).astype(float)
    score = x[:, 6] / 12 + (x[:, 10] > 20) * 0.6 + x[:, 4] * 0.5 + (x[:, 2] > 4) * 0.4 + (x[:, 8] > 0.01) * 0.5 + rng.normal(0, 0.3, n)
    return x, (score > 1.4).astype(int)


@pytest.fixture(scope="module")
def models(spark):
    x, y = rows_of(500)
    df, _ = cut_lineage(spark.createDataFrame([(0, a.tolist(), int(b)) for a, b in zip(x, y)], "model int, x array<double>, y int"), "test-rows")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=25, maxDepth=4, seed=1)
    ready = df.select(array_to_vector("x").alias("features"), "x", F.col("y").cast("double").alias("label"))
    fitted = forest.fit(ready)
    return {"forest": pairmodel.PairModel.of_forest(fitted, spark), "boosted": pairmodel.PairModel.of_boosted(boosting.fit(df, 2, 20, 3)[0]), "spark": fitted, "rows": ready}


def test_forest_keeps_its_probabilities(models):
    got = models["spark"].transform(models["rows"]).select("x", vector_to_array("probability")[1].alias("p")).collect()
    assert np.allclose(models["forest"].probability(np.array([r["x"] for r in got])), [r["p"] for r in got])


@pytest.mark.parametrize("kind", ["forest", "boosted"])
@pytest.mark.parametrize("most", [2048, 20])
def test_boxes_hold_every_row_that_passes(models, kind, most, monkeypatch):
    monkeypatch.setattr(pairmodel, "MAX_BOXES", most)
    model = models[kind]
    x, _ = rows_of(4000)
    x[:, [NAMES.index(c) for c in pairmodel.SHARED]] = 0
    p = model.probability(x)
    for same in (0, 1):
        own = x[:, NAMES.index("same_component")] == same
        for floor in (0.3, 0.6, 0.9):
            boxes = model.boxes(floor, same)
            assert len(boxes) <= most + 1
            inside = np.array([((low < x) & (x <= high)).all(axis=1) for low, high in boxes]).reshape(-1, len(x))
            assert inside.sum(axis=0).max(initial=0) <= 1
            assert inside.any(axis=0)[own & (p >= floor)].all()
            if most > 1000 and floor == 0.9:
                assert inside.any(axis=0)[own].mean() < 0.6  # the rest is never formed
            for (low, high), some in zip(boxes, inside):
                a, b, *_ = model.bounds(low, high)
                assert (p[some] >= a - 1e-12).all() and (p[some] <= b + 1e-12).all()


@pytest.fixture(scope="module")
def world(spark):
    """A graph with a hub, chains, and free sources of which some are others' parents."""
    own = [(f"D{i}", "MY") for i in range(120)]
    up = [(f"P{i}", "US") for i in range(25)]
    rel = [(f"D{i}", f"P{(i * i) % 7}", "direct_parent") for i in range(60)] + [(f"D{i}", f"P{7 + i % 5}", "ultimate_parent") for i in range(0, 60, 3)]
    rel += [(f"D{i}", f"D{60 + i % 9}", "direct_parent") for i in range(0, 30, 2)] + [(f"P{i}", f"P{i + 1}", "ultimate_parent") for i in range(12, 20)] + [("P20", "D71", "direct_parent")]
    e, p = (frame(spark, "lei:s country_legal:s", r) for r in (own, up))
    r = frame(spark, REL, rel)
    edges, _ = cut_lineage(graph.edges_of(r), "test-edges")
    nodes, _ = cut_lineage(graph.vertices_of(e.unionByName(p), edges), "test-nodes")
    stats, _ = cut_lineage(graph.pair_stats(nodes, edges, max_iter=20), "test-stats")
    return e, p, r, nodes, edges, stats


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_likely_pairs_equal_all_pairs(spark, models, world, kind):
    e, p, r, nodes, edges, stats = world
    # The ensemble as it is, over features on this graph's scale, so that every kind of pair passes somewhere.
    free = e.select("lei").join(r.select(F.col("source_lei").alias("lei")).distinct(), "lei", "left_anti")
    targets = p.select("lei").union(spark.createDataFrame([("nowhere",), ("D70",)], "lei string")).distinct()
    every = free.select(F.col("lei").alias("source_lei")).crossJoin(targets.select(F.col("lei").alias("target_lei"))).where("source_lei <> target_lei")
    scored = models[kind].score(graph.pair_features(every, edges, stats)).select("source_lei", "target_lei", "link_probability", "common_neighbors", "same_component").cache()
    kinds = {(c > 0, s) for c, s in scored.select("common_neighbors", "same_component").distinct().collect()}
    assert kinds == {(True, 1), (False, 1), (False, 0)}
    seen = 0
    for floor in (0.05, 0.2, 0.5):
        want = {(x[0], x[1]): x[2] for x in scored.where(F.col("link_probability") >= floor).collect()}
        found = pairmodel.likely_pairs(models[kind], free, targets, edges, stats, floor).collect()
        assert len(found) == len(want) and all(want[x["source_lei"], x["target_lei"]] == pytest.approx(x["link_probability"], abs=1e-9) for x in found)
        seen += len(want)
    assert seen
    scored.unpersist()


def test_pairs_formed_stay_far_below_the_product(spark, models):
    """Thousands of lone sources are one class, and targets are as many as the thresholds tell apart."""
    sources = spark.range(5000).selectExpr("concat('D', id) as lei")
    targets = spark.range(400).selectExpr("concat('P', id) as lei")
    edges = spark.range(4000).selectExpr("concat('C', id) as src", "concat('P', id * id % 400) as dst").distinct()
    stats = graph.degrees(sources.union(targets).union(edges.select("src")), edges).selectExpr("lei", "in_degree", "out_degree", "lei as component", "1L as weakly_connected_component_size", "(1 + in_degree) / 9000D as pagerank")
    keyed = lambda ids, side, own: pairmodel.side_rows(ids, stats, edges, side).withColumn(f"{side}_class", F.concat_ws("|", *pairmodel._between(models["boosted"], own)))
    met = pairmodel.class_pairs(models["boosted"], keyed(sources, "source", pairmodel.OF_SOURCE), keyed(targets, "target", pairmodel.OF_TARGET), 0.3, 0)
    formed = met.count() + pairmodel.near_pairs(sources.withColumnRenamed("lei", "source_lei"), targets.withColumnRenamed("lei", "target_lei"), edges).count()
    assert formed < 5000 * 400 / 1000


def test_train_and_predict(spark, world):
    e, p, r, nodes, edges, _ = world
    trained = links.train(nodes, edges, links.training_pairs(r, e, p), folds=2, trees=10)
    m = trained.metrics
    assert set(m["cv_auc"]) == set(m["cv_auc_std"]) == {"gradient_boosting", "random_forest"} and m["folds"] == 2 and m["cv_auc"][m["model"]] == max(m["cv_auc"].values())
    assert sum(x for _, x in m["importances"]) == pytest.approx(1)
    want = links.score_candidates(trained, links.candidates(e, r, p).where("source_lei <> target_lei"), nodes, edges, 0.01).collect()
    got = links.predicted(trained, e, r, p, nodes, edges, 0.01).collect()
    assert {tuple(x) for x in got} == {tuple(x) for x in want}


def plain_ranks(nodes, edges):
    """PageRank by 300 plain steps."""
    at = {v: i for i, v in enumerate(nodes)}
    src, dst = (np.array([at[e[k]] for e in edges]) for k in (0, 1))
    fan = np.bincount(src, minlength=len(at))
    x = np.full(len(at), 1 / len(at))
    for _ in range(300):
        x = 0.85 * (np.bincount(dst, x[src] / fan[src], len(at)) + x[fan == 0].sum() / len(at)) + 0.15 / len(at)
    return [(v, float(x[i])) for v, i in at.items()]


def test_held_out_features_equal_recomputation(spark, world):
    e, p, r, nodes, edges, _ = world
    gone = edges.where("src like 'D%'").withColumn("fold", F.pmod(F.xxhash64("src", "dst"), F.lit(9)).cast("int")).where("fold < 2")
    gone = gone.unionByName(spark.createDataFrame([("P20", "D71", 1)], "src string, dst string, fold int")).distinct()
    pairs = edges.select(F.col("src").alias("source_lei"), F.col("dst").alias("target_lei")).union(spark.createDataFrame([("D119", "P1"), ("D70", "P12"), ("D71", "P3")], "source_lei string, target_lei string")).distinct()
    every = pairs.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    got = {(x["fold"], x["source_lei"], x["target_lei"]): x for x in holdout.held_out_features(nodes, edges, every, gone).collect()}
    assert len(got) == every.count()
    for f in (1,):
        left, _ = cut_lineage(edges.join(gone.where(F.col("fold") == f), ["src", "dst"], "left_anti"), "test-left")
        ranks = spark.createDataFrame(plain_ranks([x[0] for x in nodes.select("lei").collect()], [tuple(x) for x in left.collect()]), "lei string, pagerank double")
        stats, _ = cut_lineage(graph.degrees(nodes, left).join(graph.components(nodes, left), "lei").join(ranks, "lei"), "test-left-stats")
        for x in graph.pair_features(pairs, left, stats).collect():
            mine = got[f, x["source_lei"], x["target_lei"]]
            assert all(mine[c] == pytest.approx(x[c], abs=1e-9) for c in pairmodel.FEATURES), (f, x, mine)


def test_what_is_not_reached_is_not_touched(spark):
    """A link out of one of many chains changes that chain's nodes below it, and no others."""
    edges, _ = cut_lineage(spark.range(300).selectExpr("concat('a', id, '-', 0) as src", "concat('a', id, '-', 1) as dst").union(spark.range(300).selectExpr("concat('a', id, '-', 1)", "concat('a', id, '-', 2)")), "test-chains")
    nodes = graph.vertices_of(edges.select(F.col("src").alias("lei")), edges)
    mass = holdout.masses(nodes, edges)
    gone = spark.createDataFrame([(0, "a7-0", "a7-1")], "fold int, src string, dst string")
    got = {x["lei"]: x["mass"] for x in holdout.mass_changes(mass, edges, gone, 900).collect()}
    assert got == {"a7-1": pytest.approx(-0.85), "a7-2": pytest.approx(-0.85**2)}
    parts = graph.components(nodes, edges)
    assert holdout.split_components(parts, edges, gone).count() == 3


def test_candidates_are_formed_by_all_tasks_in_groups_of_a_target(spark):
    own = spark.range(600).selectExpr("concat('C', id) AS lei")
    up = spark.range(7).selectExpr("concat('S', id) AS lei")
    linked = spark.range(0, 600, 3).selectExpr("concat('C', id) AS source_lei", "'S1' AS target_lei")
    got = links.candidates(own, linked, up)
    assert {tuple(r) for r in got.collect()} == {(f"C{i}", f"S{j}") for i in range(600) if i % 3 for j in range(7)} and got.count() == 400 * 7
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    parts: dict[int, list[str]] = {}
    for r in got.select(F.spark_partition_id().alias("p"), "target_lei").collect():
        parts.setdefault(r["p"], []).append(r["target_lei"])
    assert all(sum(a != b for a, b in zip(t, t[1:])) < len(t) / 10 for t in parts.values())
