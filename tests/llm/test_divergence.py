import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import divergence

rng = random.Random(13)
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    by, docs, groups = {}, {}, sorted({(lang or "", source or "") for lang, source, _ in rows})
    for lang, source, text in rows:
        c = Counter(TERM.findall((text or "").translate(LOWER)))
        by.setdefault((lang or "", source or ""), Counter()).update(c)
        docs.setdefault(lang or "", Counter()).update(c.keys())
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        peers = [s for g, s in groups if g == lang]

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        whole = Counter()
        for s in peers:
            whole.update(by[lang, s])
        own, every = p(by[lang, source]), p(whole)
        f = lambda x, y: (x - y) ** 2 // y
        pair = sorted((-sum(f(own[t], q[t]) for t in kept), s.encode(), s) for s in peers if s != source for q in [p(by[lang, s])])
        term = sorted((-f(own[t], every[t]), t.encode(), t) for t in kept if by[lang, source][t] and own[t] > every[t])[:200]
        for part, found in (("pair", pair), ("term", term)):
            out += [(lang, source, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def found(spark, rows):
    schema = "lang string, source string, text string, n long, term string, seat int, vector string, docs int"
    df = divergence.source_divergence(spark.createDataFrame([(*r, 5, "t", 1, "v", 2) for r in rows], schema))
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def texts(n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_equals_brute_force_over_many_shards_and_waves(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD", 25)
    monkeypatch.setattr(divergence, "WAVE", 3)
    words = [f"{a}{b}" for a in "abcXYéñ中😀" for b in ("", "a", "B", "-c", "'d", "ö9", "zz")] + ["ΣΑΣ", "İx", "\xa0nb"]
    rows = [("en", f"s{i % 7}" if i % 3 else "hot", t) for i, t in enumerate(texts(150, words))]
    rows += [("de", s, t) for s, t in zip("ab" * 20, texts(40, words[:12]))]
    rows += [(None, None, "one two"), (None, "x", None), ("", "x", "one"), ("", "", "One ONE"), ("one", "only", "a b"), ("one", "only", "a"), ("one", "only", "a a")]  # a language of null, and one of one source
    rows += [("v0", s, f"{s}{s}") for s in "abc"] + [("v0", "d", None), ("v0", "e", "")]  # no term in three documents
    rows += [("rep", s, "same words same") for s in "ab" for _ in range(4)] + [("long", "a", "wort " * 100_000 + "x" * 70_000), ("long", "b", "x" * 70_000), ("long", "b", "x" * 70_000 + " y")]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 300
    assert {r[2] for r in got if r[0] == "one"} <= {"term"} and {r[4] for r in got if r[0] == "v0"} == {0} and sum(r[0] == "v0" for r in got) == 20
    assert found(spark, []) == [] and found(spark, [(None, None, None)]) == []


def test_more_terms_than_are_told(spark):
    many = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(260))
    rows = [("en", "a", many)] * 3 + [("en", "b", "other words here")] * 3
    got = found(spark, rows)
    assert got == brute(rows) and sum(r[:3] == ("en", "a", "term") for r in got) == 200


def test_shares_and_vectors_are_exact():
    for _ in range(300):
        v, n = rng.randrange(1, 10**7), rng.randrange(10 ** rng.randrange(1, 15))
        c = rng.randrange(n + 1)
        assert divergence.shares(np.array([c]), n, v)[0] == 1 + 10**9 * (c + 1) // (n + v)
    ids = np.array(sorted(rng.sample(range(10**6), 500)))
    counts = np.array([rng.randrange(1, 2**62) for _ in ids])
    got = divergence.expanded(divergence.compressed(ids, counts))
    assert (got[0] == ids).all() and (got[1] == counts).all()


def test_every_pair_meets_once(spark):
    for m in (2, 4, 10):
        seats = spark.range(m).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(m - 2))))
        got = seats.select("r", F.col("id").alias("a"), divergence.partner(F.col("id"), F.col("r"), F.lit(m)).alias("b")).collect()
        assert all(x["a"] != x["b"] for x in got) and len({(x["r"], x["b"]) for x in got}) == m * (m - 1)  # in a round each has one partner
        assert len({(x["a"], x["b"]) for x in got}) == m * (m - 1) and all((x["r"], x["b"], x["a"]) in {(y["r"], y["a"], y["b"]) for y in got} for x in got)


def test_residents_are_not_shuffled_again(spark):
    left = spark.range(100).selectExpr("string(id) as lang", "id as shard", "int(id) as seat").repartition(4, "lang", "shard", "seat").persist()
    plan = left.hint("shuffle_hash").join(spark.range(50).selectExpr("string(id) as lang", "id as shard", "int(id) as seat"), ["lang", "shard", "seat"])
    text = plan._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert text.count("Exchange") == 1
    left.unpersist()
