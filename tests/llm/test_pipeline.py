import random

import corpus_pipeline
import pytest
from tessera.llm import langid, packing, quality, registry, simhash
from tessera.llm.common import materialise

rng = random.Random(9)
STEMS = {"aa": ["lor", "mip", "dus", "kan", "vel"], "bb": ["ost", "ürt", "gej", "vaz", "hik"]}


def text(lang, n=90):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, text(("aa", "bb")[i % 2]), ("aa", "bb")[i % 2], "s", 1) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2], "copy", 1) for i in range(20)]
    rows += [(300 + i, " ".join(f"{w}###$$$" for w in text("aa").upper().split()), "aa", "junk", 1) for i in range(40)]
    rows += [(400, "too short", "aa", "s", 1), (401, None, None, None, None), (402, " ".join(f"{rng.randrange(10**9)}" for _ in range(80)), "aa", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def brute(spark, folder):
    """Stage by stage over plain rows, with the operators' own row functions and a quadratic near-duplicate search."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    df = spark.read.parquet(f"{folder}/documents.parquet")
    weights, bias = quality.train(df, spark.read.parquet(f"{folder}/labels.parquet"))
    docs = {i: t for i, t in docs.items() if quality.judge(t, weights, bias)[6]}
    one = docs.copy()
    who = langid.train(df.where(df["doc_id"].isin(list(one))))
    docs = {i: t for i, t in docs.items() if not who.identify([t])[0][2]}
    fps = {i: simhash.fingerprint(t) for i, t in docs.items()}
    own = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for i in docs:
            for j in docs:
                if own[j] < own[i] and (fps[i] ^ fps[j]).bit_count() <= 2:
                    own[i], changed = own[j], True
    kept = {i: t for i, t in docs.items() if own[i] == i}
    enc = packing.encoder(packing.VOCABULARY)
    return one, docs, kept, {i: len(enc.encode(t)) // 4 + 1 for i, t in kept.items()}


def test_stages_against_brute_force(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), name.replace(" ", "-"))
        assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.collect()})
    good, known, single, tokens = brute(spark, folder)
    assert seen == [set(good), set(known), set(single)]
    assert {i for i in range(120)} <= seen[2] and not any(i >= 200 for i in seen[2])
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert out.groupby("doc_id")["length"].sum().to_dict() == tokens
    assert (out.groupby("sequence_id")["length"].sum() <= packing.CAPACITY).all()


def test_stages_take_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registry_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language id", "simhash near-dedup", "packing"]


def test_stages_take_nulls_repeats_and_giants(spark, folder, tmp_path):
    giant = " ".join("".join(rng.choices(STEMS["aa"], k=6)) for _ in range(120_000))
    rows = [(1, None, None, None, None), (None, None, "aa", "s", 1), (2, "", "aa", "s", 0), (3, giant, "aa", "s", 1), (3, giant, "aa", "s", 1), (None, giant, None, None, None), (None, text("bb"), "bb", "s", 1), (4, text("aa"), None, "s", 1)]
    made = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, file long")
    extra = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' AS component_id", "1L AS file").where("doc_id < 120")
    path = str(tmp_path / "d.parquet")
    made.union(extra).write.parquet(path)
    docs, seen = spark.read.parquet(path), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), name.replace(" ", "-"))
        assert docs.columns == made.columns
        seen.append([(r["doc_id"], len(r["text"] or "")) for r in docs.where("component_id = 'clash'").collect()])
    known = [(3, len(giant)), (3, len(giant)), (None, len(giant)), (None, len(rows[6][1])), (4, len(rows[7][1]))]
    assert sorted(seen[1], key=str) == sorted(known, key=str)
    assert sorted(seen[2], key=str) == sorted([(3, len(giant)), (None, len(rows[6][1])), (4, len(rows[7][1]))], key=str)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert (out.groupby("sequence_id")["length"].sum() <= packing.CAPACITY).all() and 3 in set(out["doc_id"])
