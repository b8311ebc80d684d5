import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hardnegatives as hn

rng = np.random.default_rng(12)
SCHEMA = "vec_id long, label int, vector array<long>, size string, ids long, cell double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, y, None if v is None else [None if x is None else int(x) for x in v], "s", 1, 0.5, 7) for i, y, v in rows], SCHEMA)


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95):
    ok = {}
    for i, y, v in rows:
        if i is not None and y is not None and v is not None and None not in v:
            v = tuple(map(int, v))
            ok[i] = min(ok.get(i, (y, v)), (y, v))
    out = []
    for a in filter(anchor, ok):
        y, v = ok[a]
        met = [(-sum(p * q for p, q in zip(v, w)), i, z == y) for i, (z, w) in ok.items() if i != a and len(w) == len(v)]
        met.sort()
        for s, p, _ in [m for m in met if m[2]][:positives]:
            fit = [(t, i) for t, i, same in met if not same and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit[:negatives])]
    return sorted(out)


def found(spark, rows, every=5, **more):
    df = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, **more)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hn, "CELL", 25)
    monkeypatch.setattr(hn, "SHARD", 32)
    monkeypatch.setattr(hn, "GROUP", 8)


def test_equals_brute_force_over_many_cells_groups_and_shards(spark, small):
    centres = rng.normal(size=(9, 6)) * 300
    rows = [(i, int(rng.integers(4)), np.round(centres[rng.integers(9)] + rng.normal(size=6) * rng.choice([3, 90]))) for i in range(400)]
    # A hot label, a lone label, a label of two; copies within and across labels, zero vectors, another length.
    rows += [(1000 + i, 0, rows[3][2]) for i in range(120)] + [(1200 + i, 1, rows[3][2] * 0.9 // 1) for i in range(40)]
    rows += [(2000, 77, rows[3][2]), (2005, 78, rows[4][2]), (2006, 78, rows[5][2]), (2010, 0, [0] * 6), (2011, 1, [0] * 6), (2012, 0, [0] * 6)]
    rows += [(3000 + i, i % 2, [i - 6, 3, i]) for i in range(20)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert found(spark, rows) == want and len(want) > 400 and {2010} <= {r[0] for r in want}
    assert found(spark, rows, 10, positives=2, negatives=4, low=20, high=80) == brute(rows, lambda i: i % 10 == 0, 2, 4, 20, 80)


def test_rows_that_take_no_part_and_repeats(spark):
    v = [[5, 1], [4, 2], [6, 0], [3, 3], [4, 0]]
    rows = [(i, i % 2, v[i % 5]) for i in range(10)]
    odd = [(None, 0, [9, 9]), (20, None, [9, 9]), (25, 0, None), (30, 1, [None, 9]), (35, 1, [9, None])]
    again = [*rows, *rows, (3, 1, [99, 99]), (4, 5, [1, 1])]  # an id with other rows: the smallest label, then vector
    assert found(spark, rows + odd) == brute(rows, lambda i: i % 5 == 0) != []
    assert found(spark, again) == brute(again, lambda i: i % 5 == 0)
    assert found(spark, []) == [] and found(spark, odd) == [] and found(spark, rows[:1]) == []
    assert found(spark, [(0, 0, []), (1, 0, []), (2, 1, [])]) == brute([(0, 0, []), (1, 0, []), (2, 1, [])], lambda i: i % 5 == 0)


def test_scores_are_exact_at_every_size():
    for size in (10, 1 << 24, 1 << 27, 1 << 60):
        a, c = (rng.integers(-size, size, (3, 4)) for _ in range(2))
        want = np.clip(a.astype(object) @ c.T.astype(object), -hn.MOST, hn.MOST)
        assert (hn.scores(a, c) == want).all()


def test_candidates_go_only_where_they_might_serve():
    centres = np.eye(16, dtype=np.int64) * 1000
    space = hn.Space({16: centres}, 1.1e6)
    x = np.repeat(centres, 50, axis=0) + rng.integers(-5, 6, (800, 16))
    cells, groups = np.arange(16), np.arange(16)
    sent = hn.served(space, x, cells, np.full(16, 400.0), groups)
    assert [len(s) for s in sent] == [1] * 800 and [s[0] for s in sent] == np.repeat(groups, 50).tolist()
    # Whatever lies within an anchor's needed distance of it is within the reach of the anchor's cell.
    for _ in range(50):
        a = centres[rng.integers(16)] + rng.integers(-40, 41, 16)
        y, z = space.raised(a[None].astype(float), True)[0], space.raised(x.astype(float), False)
        far = np.sqrt(((z - y) ** 2).sum(axis=1))
        d = space.distances(a[None], True)[0]
        need = np.sort(far)[30]
        got = hn.served(space, x, np.array([d.argmin()]), np.array([d.min() + need]), np.array([7]))
        assert all(got[i] == [7] for i in np.flatnonzero(far <= need))


def test_groups_follow_the_pivots_order():
    space = hn.Space({2: np.array([[0, 0], [100, 0], [1, 1], [101, 1]])}, 2e4)
    assert sorted(space.order(2)) == [0, 1, 2, 3] and abs(space.order(2)[0] - space.order(2)[2]) == 1
    assert len(set(hn.grouped(space, 2, np.arange(4), np.full(4, hn.GROUP)))) == 4 and len(set(hn.grouped(space, 2, np.arange(4), np.full(4, 3)))) == 1
