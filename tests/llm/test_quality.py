import random

import pytest

from tessera.llm import quality
from tessera.llm.common import label_sample

rng = random.Random(1)
GOOD = ["the", "river", "moved", "slowly", "under", "old", "stones", "while", "people", "spoke", "softly", "about", "rain", "and", "harvest"]


def good(n=80):
    return " ".join(f"{rng.choice(GOOD)}{rng.randrange(40)}" for _ in range(n))


def bad(n=80):
    return " ".join(f"{rng.choice(GOOD).upper()}{rng.randrange(40)}{rng.choice(['###', '$$$', '%%%'])}" for _ in range(n))


def brute_repeats(words):
    found = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(found):
        if found.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_repeated_words_against_brute_force():
    for n in (0, 1, 2, 3, 4, 10, 60, 255, 256, 300):
        for kinds in (1, 2, 5, 40):
            words = [str(rng.randrange(kinds)).encode() for _ in range(n)]
            assert quality.repeated_words(words) == brute_repeats(words), (n, kinds)


def test_base_counts():
    text = "a b\u00a0c\n\na b\u00a0c\n #*$ \x1c x\r\n \n#*$\x0b|"
    words = text.encode().split()
    n, chars, symbols, dup, _ = quality.base_counts(text, words)
    assert n == len(words) and chars == sum(len(w.decode()) for w in words)
    assert symbols == sum(text.count(c) for c in "#*$%&|<>") and dup == 1


def test_margin_equals_features():
    import numpy as np

    w = np.random.default_rng(0).normal(size=quality.DIMS).astype(np.float32)
    for t in (good(), bad(), "", "x", "ab", "é" * 50):
        words = t.encode().split()
        at, v = quality.features(t, words)
        assert quality.margin(t, words, w, 0.5) == pytest.approx(float(v @ w[at]) + 0.5, abs=1e-4)


def test_long_text_in_parts(monkeypatch):
    import numpy as np

    w, t = np.random.default_rng(0).normal(size=quality.DIMS).astype(np.float32), good(400)
    whole = quality.margin(t, t.encode().split(), w, 0.0)
    monkeypatch.setattr(quality, "PART", 100)
    assert quality.margin(t, t.encode().split(), w, 0.0) == pytest.approx(whole, abs=1e-6)


def test_verdicts_and_edges(spark, docs):
    rows = [(i, good() if i % 2 else bad()) for i in range(200)] + [(1000, None), (1001, ""), (1002, "word " * 60), (1003, good()), (1003, rows_text := good()), (1004, bad(20_000)), (None, good())]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(7777, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs(rows), labels).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    held = [i for i in range(150, 200)]
    assert sum(by[i]["kept"] == bool(i % 2) for i in held) / len(held) > 0.95
    assert by[1000]["base_failed"] and not by[1000]["kept"] and by[1001]["n_words"] == 0 and by[1002]["base_failed"] and not by[1004]["kept"]
    assert by[1002]["n_repeat_words"] == 60 and rows_text
    kept = quality.keep_good(docs(rows), labels)
    assert kept.columns == docs([]).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if r["kept"])


def test_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs([(1, good())]), none).first()["kept"]
    assert quality.quality(docs([]), none).count() == 0


def test_sample_is_bounded_and_repeatable(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] * 2, "doc_id long, quality int, toxic int")
    d = docs([(i, "t") for i in range(100)])
    a, b = (sorted(label_sample(labels, "quality", d, 10, 5).collect()) for _ in range(2))
    assert a == b and len(a) == 20
