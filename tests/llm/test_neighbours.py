import math

import numpy as np
import pytest

from tessera.llm import neighbours

rng = np.random.default_rng(5)
SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 0.0) for i, v in rows], SCHEMA)


def brute(rows, ids, k=10):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ids:
        if q in ok:
            near = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out[q] = near
    return out


def search(spark, rows, k=10):
    df = table(spark, rows)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 100 = 0"), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: [(s, i) for _, s, i in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize("cell", [100, 8192])
def test_recall_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "SHARD", 300)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    centres = rng.normal(size=(10, 32))
    rows = [(i, (centres[i % 10] + 0.5 * rng.normal(size=32)).tolist()) for i in range(2000)]
    want, got = brute(rows, range(0, 2000, 100)), search(spark, rows)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit / (10 * len(want)) >= 0.9
    for q in got:
        assert got[q] == sorted(got[q])
        exact = {i: s for s, i in brute(rows, [q], 2000)[q]}
        assert all(s == pytest.approx(exact[i], abs=1e-12) for s, i in got[q])


def test_small_tables_ties_and_unusable_vectors(spark):
    v, w = [1.0, 2.0, 0.0], [1.0, 2.0, 0.5]
    rows = [(i, v) for i in range(0, 30)] + [(100, w), (101, w), (200, None), (300, [0.0, 0.0, 0.0]), (400, [1.0, float("nan"), 0.0]), (500, [float("inf"), 1.0, 1.0]), (600, [None, 1.0, 1.0]), (700, []), (800, [1.0, 2.0]), (900, v), (900, v), (None, v), (901, [1.0, float("-inf"), 2.0])]
    want, got = brute(rows, [0, 100, 200, 300, 400, 500, 600, 700, 800, 900]), search(spark, rows)
    want = {q: v for q, v in want.items() if v}
    assert set(got) == set(want) == {0, 100, 900}
    assert [i for _, i in got[0]] == list(range(1, 11)) and [i for _, i in got[900]] == list(range(10))
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 2.0])]
    assert [i for _, i in search(spark, rows)[0]] == [1, 2]
    assert search(spark, [(0, [1.0, 0.0])]) == {} and search(spark, []) == {}


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05), rel=1e-6)
    draws = (np.random.default_rng(1).standard_normal((200_000, 8)) ** 2).sum(axis=1)
    assert np.quantile(draws, 0.9) == pytest.approx(neighbours.chi_square_quantile(0.9, 8), rel=0.02)


def test_tree_leaves_come_by_distance():
    points = rng.normal(size=(500, 4))
    points[:100] = points[0]  # equal points cannot be parted
    tree, q = neighbours.KdTree(points), rng.normal(size=4)
    gaps, seen = zip(*tree.leaves(q))
    assert list(gaps) == sorted(gaps) and sorted(np.concatenate(seen).tolist()) == list(range(500))
    for gap, leaf in zip(gaps, seen):
        assert ((points[leaf] - q) ** 2).sum(axis=1).min() >= gap - 1e-9


def unit(n, d=64):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(n, d=64, groups=40):
    return rng.normal(size=(groups, d))[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, d))


@pytest.mark.parametrize("make,most", [(unit, 0.7), (clustered, 0.15)])
def test_the_stop_leaves_vectors_unverified(make, most):
    x = make(4000)
    a, limit = neighbours.directions(64), neighbours.chi_square_quantile(neighbours.CONFIDENCE, neighbours.M)
    tree, hit, share = neighbours.KdTree(x @ a), [], []
    for i in range(0, 4000, 100):
        rows, dist, verified = neighbours.search(tree, x, x[i], x[i] @ a, 11, limit)
        exact = ((x - x[i]) ** 2).sum(axis=1)
        assert np.allclose(dist, exact[rows], rtol=0, atol=0)
        hit.append(len(set(np.argsort(exact)[:11]) & set(rows[np.argsort(dist)[:11]])) / 11)
        share.append(verified / 4000)
    assert np.mean(hit) >= 0.9 and np.mean(share) <= most


def test_a_known_distance_prunes_from_the_start():
    x = clustered(3000)
    a, limit = neighbours.directions(64), neighbours.chi_square_quantile(neighbours.CONFIDENCE, neighbours.M)
    tree = neighbours.KdTree(x[1:] @ a)
    free = neighbours.search(tree, x[1:], x[0], x[0] @ a, 10, limit)
    told = neighbours.search(tree, x[1:], x[0], x[0] @ a, 10, limit, free[1].max())
    assert set(told[0]) == set(free[0]) and told[2] <= free[2]
    assert neighbours.search(tree, x[1:], x[0], x[0] @ a, 10, limit, 1e-9)[2] < 50


@pytest.mark.parametrize("cells", [1, 7, 64, 5000])
def test_the_top_of_the_tree_parts_all_points(cells):
    fit, points = rng.normal(size=(300, 6)), rng.normal(size=(1000, 6)) * 3
    fit[:50] = fit[0]
    top = neighbours.TopTree(fit, cells)
    at = top.cell(points)
    assert len(top.low) <= cells and (cells > 300 or len(top.low) == cells)
    for p, c in zip(points, at):
        gaps = top.gaps(p)
        assert gaps[c] == 0 and (top.low[c] <= p).all() and (p <= top.high[c]).all()
        others = points[at != c]
        if len(others):
            nearest = ((others - p) ** 2).sum(axis=1)
            assert (gaps[at[at != c]] <= nearest + 1e-9).all()


def test_a_hot_cell_is_dealt_over_groups(spark, monkeypatch):
    for name, value in (("CELL", 50), ("SHARD", 40), ("BLOCK", 3), ("SAMPLE", 200)):
        monkeypatch.setattr(neighbours, name, value)
    x = np.concatenate([1 + 1e-4 * rng.normal(size=(900, 8)), rng.normal(size=(300, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute(rows, range(0, 1200, 100)), search(spark, rows)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 10 * len(want)
