import math

import pytest
from helpers import REL, by, frame

from tessera.operators import components, graph
from tessera.operators.components import component_labels, merged_labels
from tessera.plans import pipelines


def net(spark, links, alone=()):
    e = frame(spark, "src:s dst:s", links).drop("_ord").distinct()
    ends = {x for link in links for x in link} | set(alone)
    return spark.createDataFrame([(x,) for x in sorted(ends)], "lei string"), e


def test_empty_graph(spark):
    got = graph.graph_summary(frame(spark, "lei:s legal_name:s country_legal:s city_legal:s category:s legal_form:s", []), frame(spark, REL, []))
    assert got.count() == 0 and {"in_degree", "out_degree", "weakly_connected_component_size", "pagerank", "degree_centrality"} <= set(got.columns)


def test_edges_collapse_and_last_attributes_win(spark):
    rels = frame(spark, REL, [("A", "P", "direct_parent"), ("A", "P", "ultimate_parent"), (None, "P", "x"), ("B", None, "x")])
    assert graph.edges_of(rels).count() == 1
    e = frame(spark, "lei:s legal_name:s", [("A", "old"), ("A", "new")])
    assert by(graph.vertices_of(e, graph.edges_of(rels)), "lei")["A"]["legal_name"] == "new"


def test_components_against_union_find(spark):
    import random

    rng = random.Random(2)
    links = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    own = {}

    def find(x):
        own.setdefault(x, x)
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        own[b] = a
    want = {}
    for x in own:
        want.setdefault(find(x), set()).add(x)
    want = {x: min(g) for g in want.values() for x in g if len(g) > 1}
    got = {r["node"]: r["component"] for r in component_labels(net(spark, links)[1]).collect()}
    assert got == want
    assert component_labels(net(spark, [])[1].where("src = 'none'")).count() == 0


def test_added_edges_merge_labels_as_a_fresh_start_does(spark):
    import random

    rng = random.Random(5)
    links = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(80)] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    # Links between components, into one component from many sides, within one, from new nodes, among new nodes; repeated, looped and null rows.
    more = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(25)] + [("c30", f"n{i}") for i in range(0, 60, 7)] + [("c1", "c20"), ("a0", "c5"), ("z1", "z2"), ("z2", "a1"), ("z1", "z2"), ("s", "s"), (None, "c1"), ("c2", None)]
    old, new = (frame(spark, "src:s dst:s", x).drop("_ord") for x in (links, more))
    got = {r["node"]: r["component"] for r in merged_labels(component_labels(old), new).collect()}
    assert got == {r["node"]: r["component"] for r in component_labels(old.union(new)).collect()}
    none = new.where("false")
    assert {r["node"]: r["component"] for r in merged_labels(component_labels(old), none).collect()} == {r["node"]: r["component"] for r in component_labels(old).collect()}
    assert {r["node"]: r["component"] for r in merged_labels(component_labels(none), new).collect()} == {r["node"]: r["component"] for r in component_labels(new).collect()}


def test_steps_of_a_merge_depend_on_the_addition_alone(spark, monkeypatch):
    real, steps = components._star, []
    monkeypatch.setattr(components, "_star", lambda edges, large: steps.append(edges.count()) or real(edges, large))
    of = lambda n: spark.createDataFrame([(f"c{i:04}", f"c{i - i % n:04}") for i in range(400)], "node string, component string")
    added = frame(spark, "src:s dst:s", [("c0001", "c0399"), ("c0002", "q")]).drop("_ord")
    ran = []
    for n in (20, 200):  # labels of paths of 20 and of 200 nodes
        steps.clear()
        merged = {r["node"]: r["component"] for r in merged_labels(of(n), added).collect()}
        assert merged["q"] == merged["c0399"] == "c0000" and len(merged) == 401
        ran.append(list(steps))
    assert ran[0] == ran[1] and max(ran[0]) <= 2


def test_components_of_an_enriched_graph(spark):
    v, e = net(spark, [*F25, ("X", "Y")], ["D4"])
    added = frame(spark, "src:s dst:s", [("D4", "P2"), ("X", "D1"), ("N", "Y")]).drop("_ord")
    vertices = v.union(spark.createDataFrame([("N",)], "lei string"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.components_after(vertices, graph.components(v, e), added)) == rows(graph.components(vertices, e.union(added)))


def test_the_graph_phase_merges_inferred_links_into_known_components(spark, monkeypatch):
    from tessera.operators import ladder, links

    monkeypatch.setattr(links, "train", lambda *_, **__: type("Untrained", (), {"model": None}))
    d = frame(spark, "lei:s legal_name:s country_legal:s", [(f"D{i}", "n", "MY") for i in range(1, 7)])
    p = frame(spark, "lei:s legal_name:s country_legal:s", [("P1", "p", "US"), ("P2", "q", "SG"), ("P3", "r", "US")])
    r = frame(spark, REL, [("D1", "P1", "direct_parent"), ("D2", "P2", "direct_parent"), ("D3", "P2", "ultimate_parent")])
    m = frame(spark, "lei:s matched_parent_lei:s brand_token:s match_score:d match_field:s", [("D4", "P1", "b", 100.0, "legal_name"), ("D5", "P3", "b", 95.0, "legal_name")])
    x = pipelines.Inputs(d, p, r)
    got, rels, entities = pipelines.graph_prediction(x, m), pipelines.enriched_relationships(x, m), ladder.combine_entities(d, p)
    edges = graph.edges_of(rels)
    labels = spark.createDataFrame([("D1", "US"), ("D2", "SG"), ("D3", "SG"), ("D4", "US"), ("D5", "US")], "lei string, label string")
    assert got["readiness"].first() == graph.readiness(d, rels, entities).first()
    want = graph.propagate_labels(graph.vertices_of(entities, edges), edges, labels)
    assert by(got["propagated"], "lei") == by(want, "lei") and {"P1", "P2", "P3"} <= set(by(want, "lei"))


def slow_pagerank(nodes, links, steps):
    out = {n: [b for a, b in links if a == n] for n in nodes}
    r = {n: 1 / len(nodes) for n in nodes}
    for _ in range(steps):
        loose = sum(r[n] for n in nodes if not out[n])
        r = {n: 0.85 * (sum(r[m] / len(out[m]) for m in nodes if n in out[m]) + loose / len(nodes)) + 0.15 / len(nodes) for n in nodes}
    return r


def test_pagerank(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "d"), ("e", "e")]
    v, e = net(spark, links, ["f"])
    want = slow_pagerank(list("abcdef"), links, 7)
    got = {r["lei"]: r["pagerank"] for r in graph.pagerank(v, e, max_iter=7, tol=0).collect()}
    assert all(got[n] == pytest.approx(want[n], abs=1e-12) for n in want)
    assert sum(r["pagerank"] for r in graph.pagerank(v, e).collect()) == pytest.approx(1)


def test_degrees_and_centrality(spark):
    v, e = net(spark, [("a", "b"), ("c", "b"), ("d", "d")])
    d = by(graph.degrees(v, e), "lei")
    assert (d["b"]["in_degree"], d["a"]["out_degree"], d["d"]["in_degree"]) == (2, 1, 1)
    c = by(graph.degree_centrality(v, e), "lei")
    assert c["b"]["degree_centrality"] == pytest.approx(2 / 3) and c["d"]["degree_centrality"] == pytest.approx(2 / 3)
    single = net(spark, [("x", "x")])
    assert graph.degree_centrality(*single).first()["degree_centrality"] == 1


F25 = [("D1", "P1"), ("D2", "P1"), ("D3", "P2")]


def test_pair_features(spark):
    v, e = net(spark, [*F25, ("D1", "P2"), ("P1", "Q")], ["D4", "P3"])
    pairs = frame(spark, "source_lei:s target_lei:s", [("D1", "P1"), ("D1", "D2"), ("P1", "P2"), ("D4", "P1"), ("ZZ", "P1")])
    got = {(r["source_lei"], r["target_lei"]): r for r in graph.pair_features(pairs, e, graph.pair_stats(v, e)).collect()}
    assert got["D1", "P1"]["same_component"] == 1 and got["D1", "P1"]["preferential_attachment"] == 6
    assert got["D1", "D2"]["common_neighbors"] == 1 and got["D1", "D2"]["jaccard_coefficient"] == pytest.approx(1 / 2)
    assert got["P1", "P2"]["adamic_adar"] == pytest.approx(1 / math.log(2))
    assert got["D4", "P1"]["same_component"] == 0 and got["D4", "P1"]["jaccard_coefficient"] == 0
    assert got["ZZ", "P1"]["source_component_size"] == 1 and got["ZZ", "P1"]["source_pagerank"] == 0


def test_label_propagation(spark):
    v, e = net(spark, [*F25, ("X", "P1")], ["D4", "D5"])
    labels = frame(spark, "lei:s label:s", [("D1", "US"), ("D3", "SG"), ("D2", "US")])
    got = by(graph.propagate_labels(v, e, labels), "lei")
    assert set(got) == {"P1", "P2", "X"}
    assert (got["P1"]["propagated_country"], got["P1"]["hops"], got["P1"]["confidence"]) == ("US", 1, 0.5)
    assert (got["X"]["hops"], got["X"]["confidence"]) == (2, 0.3333) and got["P2"]["propagated_country"] == "SG"


def test_readiness(spark):
    e = frame(spark, "lei:s legal_name:s country_legal:s", [(f"D{i}", "n", "MY") for i in range(1, 6)])
    p = frame(spark, "lei:s legal_name:s country_legal:s", [(f"P{i}", "n", "US") for i in range(1, 4)])
    rels = frame(spark, REL, [(*x, "direct_parent") for x in F25])
    r = graph.readiness(e, rels, e.unionByName(p)).first()
    assert (r["ready"], r["n_nodes"], r["n_edges"], r["n_parent_nodes"], r["labeled_ratio"], r["n_components"], r["largest_component"]) == (False, 8, 3, 2, 0.6, 5, 3)
    assert graph.readiness(e, rels, e, min_edges=2, min_parents=2).first()["ready"]


def test_mock_pipeline(spark):
    got = by(pipelines.mock_pipeline(spark), "lei")
    assert {n: (r["in_degree"], r["out_degree"], r["weakly_connected_component_size"], r["foreign_parent"]) for n, r in got.items()} == {"A1": (0, 2, 4, 1), "A2": (0, 1, 4, 1), "A3": (0, 0, 1, 0), "P1": (2, 0, 4, 0), "P2": (1, 0, 4, 0)}
    assert [n for n, r in got.items() if r["appears_in_edgar"]] == ["P2"]


def test_labels_reach_the_ends_of_long_chains(spark, monkeypatch):
    from tessera.plans import catalog

    e = frame(spark, "lei:s legal_name:s category:s legal_form:s country_legal:s city_legal:s", [(f"X{i}", "n", "", "", "MY", "") for i in range(9)])
    p = frame(spark, "lei:s legal_name:s country_legal:s", [("P", "p", "US")])
    r = frame(spark, REL, [("X0", "P", "direct_parent"), *((f"X{i + 1}", f"X{i}", "direct_parent") for i in range(8))])
    for name in ("At", "Shared"):
        monkeypatch.setattr(catalog, name, lambda *_: type("Tables", (), {"entities": e, "parents": p, "relationships": r}))
    got = by(catalog.queries()["label_propagation"](spark, ""), "lei")
    assert {n: x["hops"] for n, x in got.items()} == {"P": 1, **{f"X{i}": i for i in range(1, 9)}}
