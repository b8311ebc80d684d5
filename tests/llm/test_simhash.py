import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

rng = random.Random(3)
WORDS = [f"w{i}" for i in range(500)]


def reference(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_against_brute_force():
    for t in (None, "", " \n", "one", "one two", "A b C d", "É é\u00a0x y z", " ".join(rng.choices(WORDS, k=300))):
        assert simhash.fingerprint(t) == reference(t), t


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a b é",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b é".encode(), 42)


def test_parts_add_up(monkeypatch):
    t = " ".join(rng.choices(WORDS, k=400))
    whole = simhash.fingerprint(t)
    monkeypatch.setattr(simhash, "PART", 7)
    assert simhash.fingerprint(t) == whole


def components(fps):
    """Brute force: least place reachable."""
    n = len(fps)
    own = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if own[j] < own[i] and bin(fps[i] ^ fps[j]).count("1") <= 2:
                    own[i], changed = own[j], True
    return own


def flipped(fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def linked(spark, fps, hot=None, monkeypatch=None):
    if hot:
        monkeypatch.setattr(simhash, "HOT", hot)
    df = spark.createDataFrame([(simhash._signed(f),) for f in set(fps)], "fp long")
    return [(r["src"] & (1 << 64) - 1, r["dst"] & (1 << 64) - 1) for r in simhash.links(df).collect()]


def check_links(fps, got):
    """Links hold, and join just what brute force joins."""
    fps = sorted(set(fps))
    at = {f: i for i, f in enumerate(fps)}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in got)
    own = list(range(len(fps)))
    for _ in fps:
        for a, b in got:
            m = min(own[at[a]], own[at[b]])
            own[at[a]] = own[at[b]] = m
    assert own == components(fps)


def near_group():
    out, fps = [], [rng.getrandbits(64) for _ in range(30)]
    for f in fps:
        chain = f
        for _ in range(3):
            chain = flipped(chain, rng.choice([1, 2, 2, 3]))
            out.append(chain)
    return fps + out


def test_links_against_brute_force(spark):
    fps = near_group()
    check_links(fps, linked(spark, fps))


def test_hot_buckets_split_without_loss(spark, monkeypatch):
    base = rng.getrandbits(64)
    fps = near_group() + [flipped(base, rng.randrange(1, 4)) for _ in range(60)]
    got = linked(spark, fps, 5, monkeypatch)
    check_links(fps, got)


def test_pivots_discard_only_what_is_far():
    fps = np.array([rng.getrandbits(64) for _ in range(40)], np.uint64)
    t = np.stack([simhash.popcount(fps ^ p) for p in simhash.pivots()], axis=1).astype(int)
    for i in range(40):
        for j in range(40):
            assert np.abs(t[i] - t[j]).max() <= int(simhash.popcount(fps[i : i + 1] ^ fps[j])[0])


def test_components_of_documents(spark, docs):
    a, b = " ".join(rng.choices(WORDS, k=80)), " ".join(rng.choices(WORDS, k=80))
    rows = [(9, a), (4, a.upper()), (7, a), (3, b), (12, None), (11, ""), (20, b), (20, b), (30, "x" * 50_000), (None, "alone and null")]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got}
    assert [by[i][1] for i in (4, 7, 9, 3, 20, 12, 11, 30)] == [4, 4, 4, 3, 3, 11, 11, 30]
    assert by[12][0] == "0" * 16 and by[4][0] == f"{reference(a):016x}" and by[None][1] is None
    assert simhash.near_duplicates(docs([])).count() == 0


def test_many_copies_make_few_rows(spark, docs):
    rows = [(i, "same text over and over") for i in range(3000)] + [(5000 + i, " ".join(rng.choices(WORDS, k=50))) for i in range(20)]
    got = simhash.near_duplicates(docs(rows))
    assert got.where("doc_id < 3000").select("component_id").distinct().collect()[0][0] == 0 and got.count() == len(rows)


def kept(df):
    return sorted(simhash.keep_one(df).select("doc_id", "text").collect(), key=str)


@pytest.mark.parametrize("bits,bitmaps", [(simhash.BITS, simhash.BITMAPS), (2, 1)])
def test_one_row_of_each_group(spark, docs, tmp_path, monkeypatch, bits, bitmaps):
    """The second: as many parts as bitmaps, which more rows to drop than any part holds need."""
    monkeypatch.setattr(simhash, "BITS", bits)
    monkeypatch.setattr(simhash, "BITMAPS", bitmaps)
    long = "one two three four five six seven " * 50
    rows = [(5, long), (3, long), (9, long), (9, long), (None, long), (None, "alone and null"), (None, "alone and null"), (7, None), (8, ""), (6, "  "), (1, "quite another text with its own words"), (1, "quite another text with its own words"), (1, "same id, other words in this text"), (20, "x " * 200_000)]
    want = sorted([(3, long), (None, "alone and null"), (6, "  "), (1, rows[10][1]), (1, rows[12][1]), (20, rows[13][1])], key=str)
    df = docs(rows).withColumnRenamed("score", "file").withColumnRenamed("class", "row")
    assert [tuple(r) for r in kept(df)] == want and simhash.keep_one(df).columns == df.columns
    path = str(tmp_path / "d.parquet")
    df.repartition(5).write.parquet(path)
    read = spark.read.parquet(path)
    assert [tuple(r) for r in kept(read)] == want and simhash.keep_one(read).columns == df.columns
    assert kept(read.where("doc_id < 0")) == []
    plan = simhash.keep_one(read)._jdf.queryExecution().executedPlan().toString()
    # Whatever the number of rows to drop, no text is shuffled: bitmaps go to where texts are read.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_bitmaps_hold_every_place(spark, docs, tmp_path):
    rows = [(i, f"text number {i // 3} with its own words {i // 3 * 7919}") for i in range(900)]
    path = str(tmp_path / "many.parquet")
    docs(rows).coalesce(1).write.parquet(path)
    before = set(simhash.WRITTEN)
    got = simhash.keep_one(spark.read.parquet(path))
    assert len(set(simhash.WRITTEN) - before) == 1  # the bitmaps; what led to them is deleted
    least = {}
    for r in simhash.near_duplicates(spark.read.parquet(path)).collect():
        least.setdefault(r["component_id"], []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(map(min, least.values())) and len(least) <= 300
