import inspect

import pytest
from helpers import REL, by, frame
from pyspark.sql import functions as F

from tessera.operators import graph, jurisdiction, links
from tessera.plans import pipelines
from tessera.sources import sinks

ENT = "lei:s legal_name:s category:s legal_form:s registered_at:s country_legal:s city_legal:s"


@pytest.fixture
def data(spark):
    e = frame(spark, ENT, [(f"D{i}", f"Firm {i} {'SDN BHD' if i % 2 else 'BERHAD MALAYSIA'}", "GENERAL" if i % 3 else None, "BHD" if i % 2 else "LTD", "2019-01-01" if i % 4 else "bad", "MY", "KL" if i % 2 else None) for i in range(40)])
    p = frame(spark, ENT, [(f"P{i}", "p", "GENERAL", "LTD", None, ("US", "SG", "DE")[i % 3], None) for i in range(6)])
    r = frame(spark, REL, [(f"D{i}", f"P{(i % 2) + (0 if i % 5 else 3)}", "direct_parent") for i in range(32)])
    return e, p, r


def test_bucketing(spark):
    df = spark.createDataFrame([("US", 15), ("US", 14), ("NZ", 3), ("XX", 1), ("JE", 1)], "c string, n long")
    assert [r[0] for r in df.select(jurisdiction.bucket(F.col("c"), F.col("n"))).collect()] == ["US", "OTHER", "ASIA_OTHER", "OTHER", "OFFSHORE"]


def test_labels_and_pseudo_labels(spark, data):
    e, p, r = data
    pseudo = frame(spark, "lei:s matched_parent_lei:s match_score:d", [("D39", "P2", 96.0), ("D38", "P2", 94.0), ("D1", "P2", 99.0)])
    got = by(jurisdiction.training_labels(r, p, pseudo), "lei")
    assert len(got) == 33 and got["D39"]["parent_country"] == "DE" and "D38" not in got and got["D1"]["parent_country"] == "SG"
    assert got["D39"]["parent_bucket"] == "OTHER"


def test_features(spark, data):
    got = by(jurisdiction.features(data[0], None, frame(spark, "lei:s exception_reason:s", [("D1", "NON_CONSOLIDATING")])), "lei")
    assert (got["D1"]["has_sdn_bhd"], got["D2"]["has_berhad"], got["D2"]["has_local_country"], got["D1"]["city_frequency"], got["D2"]["city_frequency"]) == (1, 1, 1, 20, 0)
    assert (got["D4"]["registration_year"], got["D1"]["registration_year"], got["D1"]["name_token_count"], got["D1"]["is_non_consolidating"], got["D2"]["has_exception"]) == (0, 2019, 4, 1, 0)
    assert got["D0"]["category_cat"] == "UNKNOWN"


@pytest.fixture(scope="module")
def few_trees():
    return {"trees": 10, "folds": 2}


def test_training_compares_both_kinds(spark, data, tmp_path, few_trees):
    e, p, r = data
    out = pipelines.jurisdiction_prediction(pipelines.Inputs(e, p, r), **few_trees)
    m = out["model"].metrics
    assert 0 <= m["accuracy"] <= m["top3_accuracy"] <= 1 and set(m["all_models"]) == set(jurisdiction.KINDS) and m["n_samples"] == 32 and m["folds"] == 2
    assert m["accuracy"] == max(m["all_models"].values()) and m["model"] == next(n for n in jurisdiction.KINDS if m["all_models"][n] == m["accuracy"])
    assert m["baseline"] == max(m["class_sizes"].values()) / 32 and m["lift"] == pytest.approx(m["accuracy"] - m["baseline"])
    # Every labelled row is held out once, so the confusion counts add up to the classes.
    counted = {x[0]: x[1] for x in m["confusion"].groupBy("parent_bucket").sum("n").collect()}
    right = sum(x["n"] for x in m["confusion"].collect() if x["parent_bucket"] == x["predicted"])
    assert counted == m["class_sizes"] and right / 32 == pytest.approx(m["accuracy"], abs=0.05)
    got = out["predictions"].collect()
    assert {x["lei"] for x in got} == {f"D{i}" for i in range(32, 40)}
    for x in got:
        assert x["predicted_parent_country"] == x["top3_countries"].split(";")[0] and 0 <= x["confidence_gap"] <= x["prediction_probability"] <= 1
    sinks.save_model(out["model"], str(tmp_path / "m"), spark)
    assert (tmp_path / "m/model").exists() and (tmp_path / "m/importances").exists()


def test_boosted_model_can_be_stored(spark, data, tmp_path):
    from tessera.operators.boosting import BoostedPipeline

    e, p, r = data
    rows = jurisdiction.features(e).join(jurisdiction.training_labels(r, p), "lei")
    trained = jurisdiction.train(rows, trees=10, folds=0, kinds=("gradient_boosting",))
    assert trained.metrics["model"] == "gradient_boosting" and trained.metrics["accuracy"] is None
    assert dict(jurisdiction.importances(trained))["categories"] >= 0 and sum(x for _, x in jurisdiction.importances(trained)) == pytest.approx(1)
    sinks.save_model(trained, str(tmp_path / "m"), spark)
    again = BoostedPipeline.load(str(tmp_path / "m/model"), spark)
    both = [sorted((x["lei"], *x["probability"]) for x in m.transform(rows).collect()) for m in (trained.model, again)]
    assert both[0] == both[1] and all(sum(x[1:]) == pytest.approx(1) for x in both[0])


def test_too_few_rows_are_not_cross_validated(spark, data):
    e, p, r = data
    rows = jurisdiction.features(e).join(jurisdiction.training_labels(r.where("source_lei in ('D0', 'D1', 'D2')"), p), "lei").withColumn("parent_bucket", F.when(F.col("lei") == "D0", "US").otherwise("SG"))
    trained = jurisdiction.train(rows, trees=10)
    assert trained.metrics["model"] == "gradient_boosting" and trained.metrics["folds"] == 0 and trained.metrics["accuracy"] is None
    assert jurisdiction.predict(trained, rows).count() == 3


def test_one_class_is_constant(spark, data):
    e, p, r = data
    rows = jurisdiction.features(e).join(jurisdiction.training_labels(r.where("target_lei = 'P0'"), p), "lei")
    trained = jurisdiction.train(rows)
    assert trained.model is None and jurisdiction.predict(trained, rows).select("predicted_parent_country").distinct().count() == 1


def test_training_pairs(spark, data):
    e, p, r = data
    got = links.training_pairs(r, e, p, 2).collect()
    pos, neg = ({(x["source_lei"], x["target_lei"]) for x in got if x["label"] == k} for k in (1, 0))
    assert len(pos) == 32 and len(neg) == 64 and not pos & neg
    assert {tuple(x) for x in links.training_pairs(r, e, p, 2).collect()} == {tuple(x) for x in got}


def test_link_model_and_candidates(spark, data):
    e, p, r = data
    edges = graph.edges_of(r)
    nodes = graph.vertices_of(e.unionByName(p), edges)
    trained = links.train(nodes, edges, links.training_pairs(r, e, p), folds=2, trees=10, kinds=("random_forest",))
    assert 0 <= trained.metrics["cv_auc"]["random_forest"] <= 1 and [n for n, _ in trained.metrics["importances"]]
    cand = links.candidates(e, r, p)
    assert cand.count() == 8 * 6 and links.candidates(e, r, p, 10).count() == 10
    scored = links.score_candidates(trained, cand, nodes, edges, 0.0)
    assert scored.count() == 48 and {x["rank"] for x in links.ranked(scored).collect()} == set(range(1, 49))
    assert links.best_links(scored, p).count() == 8


def test_phases_in_order(spark, data):
    e, p, r = data
    a = frame(spark, "lei:s address_line1:s postal_code:s", [(f"D{i}", "Jln 1", "5") for i in range(30, 36)])
    x = pipelines.Inputs(e, p, r, frame(spark, "lei:s exception_reason:s", [("D39", "NON_CONSOLIDATING")]), a)
    out = pipelines.address_clustering(x)
    product = pipelines.graph_and_scoring(x, None, out["inferred"], out["clusters"], False, pagerank_iterations=5)
    got = by(product["uie"], "lei")
    assert len(got) == 40 and got["D33"]["uie_source"] == "phase2_address_cluster" and got["D39"]["uie_source"] == "reporting_exception_no_country"
    assert product["review"].count() > 0 and product["scored"].count() == 46
    enriched = pipelines.enriched_relationships(x, None, out["inferred"])
    assert enriched.count() == 32 + 4


def test_single_sources_score_like_their_pairs(spark, data):
    e, p, r = data
    edges = graph.edges_of(r.unionByName(frame(spark, REL, [("X", "D39", "direct_parent")])))
    nodes = graph.vertices_of(e.unionByName(p), edges)
    trained = links.train(nodes, edges, links.training_pairs(r, e, p), folds=1, trees=10, kinds=("random_forest",))
    pairs = links.candidates(e, r, p).unionByName(frame(spark, "source_lei:s target_lei:s", [("Z", "P1"), ("D38", "D38"), ("P5", "nowhere")]).drop("_ord"))
    want = trained.model.transform(graph.pair_features(pairs, edges, graph.pair_stats(nodes, edges))).collect()
    got = {(x["source_lei"], x["target_lei"]): x["link_probability"] for x in links.score_candidates(trained, pairs, nodes, edges, 0.0).collect()}
    assert len(got) == len(want) == 51 and all(got[x["source_lei"], x["target_lei"]] == pytest.approx(float(x["probability"][1]), abs=1e-4) for x in want)


def test_every_candidate_is_given(spark, data, monkeypatch):
    from tessera.plans import catalog

    e, p, r = data
    monkeypatch.setattr(catalog, "At", lambda *_: type("Tables", (), {"domestic": e, "parents": p, "relationships": r}))
    assert catalog.queries()["link_candidates"](spark, "").count() == 8 * 6


def test_queries_train_whole_models(spark, data, monkeypatch):
    from tessera.plans import catalog

    class Seen(Exception):
        pass

    def stop(*_, **given):
        raise Seen(given)

    e, p, r = data
    whole = inspect.signature(links.train).parameters["trees"].default
    tables = type("Tables", (), {"domestic": e, "parents": p, "relationships": r, "exceptions": None, "entities": e.unionByName(p)})
    for name in ("At", "Shared"):
        monkeypatch.setattr(catalog, name, lambda *_: tables)
    monkeypatch.setattr(links, "train", stop)
    monkeypatch.setattr(jurisdiction, "train", stop)
    for name in ("link_predictions", "jurisdiction_predictions"):
        with pytest.raises(Seen) as said:
            catalog.queries()[name](spark, "")
        assert said.value.args[0] == {}
    assert whole == 200
