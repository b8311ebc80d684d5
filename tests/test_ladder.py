from helpers import ENT, REL, by, frame

from tessera.operators import graph, ladder


def entities(spark, rows):
    return frame(spark, ENT, rows)


def one(spark, domestic, rels, parents, **more):
    d = entities(spark, domestic)
    return by(ladder.build_uie_assignments(d, frame(spark, REL, rels), ladder.combine_entities(d, entities(spark, parents)), **more), "lei")


MY = [("A1", "Alpha Berhad", "MY")]


def test_foreign_flag(spark):
    e = entities(spark, [("A1", "a", "MY"), ("A2", "b", "MY"), ("P1", "c", "US"), ("P2", "d", "MY")])
    r = frame(spark, REL, [("A1", "P1", "direct_parent"), ("A2", "P2", "direct_parent"), ("A2", "P1", "other"), ("A1", "P1", "ultimate_parent"), ("A2", "P9", "direct_parent")])
    assert [tuple(x) for x in graph.foreign_parents(r, e).collect()] == [("A1", 1)]
    assert graph.foreign_parents(frame(spark, REL, []), e).columns == ["lei", "foreign_parent"]


def test_known_ultimate(spark):
    got = one(spark, MY, [("A1", "P1", "direct_parent"), ("A1", "U1", "ultimate_parent")], [("P1", "p", "SG"), ("U1", "u", "US")])["A1"]
    assert (got["uie_lei"], got["uie_country"], got["uie_source"], got["evidence_tier"], got["uie_confidence"]) == ("U1", "US", "gleif_ultimate_parent", "A_known_ultimate_parent", 1.0)


def test_chain_climbs_one_hop_and_prefers_ultimate(spark):
    chain = frame(spark, REL, [("P1", "D1", "direct_parent"), ("P1", "U1", "ultimate_parent"), ("U1", "X1", "ultimate_parent")])
    got = one(spark, MY, [("A1", "P1", "direct_parent")], [("P1", "p", "SG"), ("U1", "u", "US"), ("D1", "d", "JP"), ("X1", "x", "DE")], chain_relationships=chain)["A1"]
    assert (got["uie_lei"], got["uie_source"], got["uie_confidence"], got["is_known_uie"]) == ("U1", "gleif_upstream_ultimate_parent", 0.97, 1)
    direct = one(spark, MY, [("A1", "P1", "direct_parent")], [("P1", "p", "SG"), ("D1", "d", "JP")], chain_relationships=frame(spark, REL, [("P1", "D1", "direct_parent")]))["A1"]
    assert (direct["uie_source"], direct["uie_confidence"]) == ("gleif_upstream_direct_parent", 0.9)


def test_circular_chain_is_blank(spark):
    for target in ("A1", "P1"):
        got = one(spark, MY, [("A1", "P1", "direct_parent")], [("P1", "p", "SG")], chain_relationships=frame(spark, REL, [("P1", target, "ultimate_parent")]))["A1"]
        assert got["uie_source"] == "gleif_direct_parent" and got["chain_parent_lei"] is None and got["chain_parent_relationship_type"] is None


def test_missing_parent_entity_falls_through(spark):
    got = one(spark, MY, [("A1", "GONE", "ultimate_parent"), ("A1", "P1", "direct_parent")], [("P1", "p", "SG")])["A1"]
    assert got["uie_source"] == "gleif_direct_parent" and got["ultimate_parent_lei"] == "GONE"


def test_name_beats_model_and_tiers(spark):
    preds = frame(spark, "lei:s predicted_parent_country:s prediction_probability:d", [("A1", "SG", 0.7)])
    names = frame(spark, "lei:s matched_parent_lei:s brand_token:s match_score:d", [("A1", "P1", "X", 85.0), ("A1", "P2", "Y", 95.0)])
    got = one(spark, MY, [], [("P1", "p", "FR"), ("P2", "q", "DE")], name_matches=names, jurisdiction_predictions=preds)["A1"]
    assert (got["uie_country"], got["evidence_tier"], got["uie_confidence"], got["is_inferred_uie"]) == ("DE", "C_name_match_high", 0.95, 1)
    low = one(spark, MY, [], [("P1", "p", "FR")], name_matches=names.where("match_score < 90"))["A1"]
    assert low["evidence_tier"] == "D_name_match_medium"


def test_model_address_exception_and_nothing(spark):
    preds = frame(spark, "lei:s predicted_parent_country:s prediction_probability:d", [("A1", "SG", 0.71239)])
    got = one(spark, MY, [], [], jurisdiction_predictions=preds)["A1"]
    assert (got["uie_country"], got["evidence_tier"], got["uie_confidence"], got["uie_lei"]) == ("SG", "E_model_predicted_jurisdiction", 0.7124, None)
    addr = frame(spark, "lei:s inferred_parent_lei:s confidence:d", [("A1", "P1", None)])
    assert one(spark, MY, [], [("P1", "p", "FR")], address_inferred=addr, jurisdiction_predictions=preds)["A1"]["uie_confidence"] == 0.6
    exc = frame(spark, "lei:s exception_reason:s", [("A1", "NON_CONSOLIDATING"), ("A1", "NO_LEI")])
    assert one(spark, MY, [], [], exceptions=exc)["A1"]["uie_source"] == "reporting_exception_no_country"
    bare = one(spark, MY, [], [])["A1"]
    assert (bare["uie_source"], bare["evidence_tier"], bare["uie_confidence"], bare["is_known_uie"], bare["is_inferred_uie"]) == ("unassigned", "U_unassigned", 0.0, 0, 0)


def test_override_comes_first(spark):
    over = frame(spark, "lei:s uie_name:s uie_country:s uie_source:s uie_confidence:s", [("A1", "State", "MY", None, None), ("A1", "Other", "US", "x", "1")])
    got = one(spark, MY, [("A1", "U1", "ultimate_parent")], [("U1", "u", "US")], overrides=over)["A1"]
    assert (got["uie_country"], got["uie_source"], got["evidence_tier"], got["uie_confidence"], got["is_known_uie"]) == ("MY", "manual_verified", "A_manual_verified_uie", 0.95, 1)
    own = one(spark, MY, [], [], overrides=frame(spark, "lei:s uie_country:s uie_source:s uie_confidence:s", [("A1", "MY", "desk", "bad number")]))["A1"]
    assert (own["uie_confidence"], own["is_known_uie"], own["is_inferred_uie"]) == (0.95, 0, 0)


def test_scope_totality_and_columns(spark):
    rows = [("A1", "a", "MY"), ("A2", "b", "MY"), ("B1", "c", "SG")]
    d = entities(spark, rows)
    got = ladder.build_uie_assignments(d, frame(spark, REL, []), d)
    assert got.columns == ladder.COLUMNS and len(ladder.COLUMNS) == 47
    assert sorted(r["lei"] for r in got.collect()) == ["A1", "A2"]
    assert ladder.build_uie_assignments(d, frame(spark, REL, []), d, country="TH").count() == 3
    assert ladder.investor_summary(got).count() == 0


def test_summary_of_economies(spark):
    rels = [("A1", "U1", "ultimate_parent"), ("A2", "U1", "direct_parent"), ("A3", "U2", "direct_parent")]
    d = entities(spark, [(f"A{i}", "n", "MY") for i in (1, 2, 3, 4)])
    uie = ladder.build_uie_assignments(d, frame(spark, REL, rels), ladder.combine_entities(d, entities(spark, [("U1", "u", "US"), ("U2", "v", "SG")])))
    assert [tuple(r) for r in ladder.investor_summary(uie).collect()] == [("MY", "US", 2, 2, 0, 0.925), ("MY", "SG", 1, 1, 0, 0.85)]


def test_first_rows_win(spark):
    rels = frame(spark, REL, [("A1", "P2", "direct_parent"), ("A1", "P1", "direct_parent")])
    assert ladder.first_relationships(rels, "direct_parent").collect()[0]["direct_parent_lei"] == "P2"
    both = ladder.combine_entities(entities(spark, [("X", "first", "MY")]), entities(spark, [("X", "second", "US"), (None, "no id", "US")]))
    assert [r["legal_name"] for r in both.collect()] == ["first"]


def test_the_wide_table_stays_dealt_by_lei(spark):
    """Parents' names join the evidence, not the entities: no join of the entities' own rows is by another key."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        d, p = entities(spark, MY), entities(spark, [("P1", "p", "SG")])
        match = frame(spark, "lei:s matched_parent_lei:s brand_token:s match_score:d", [("A1", "P1", "X", 95.0)])
        near = frame(spark, "lei:s inferred_parent_lei:s confidence:d", [("A1", "P1", 0.5)])
        out = ladder.build_uie_assignments(d, frame(spark, REL, [("A1", "P1", "direct_parent")]), ladder.combine_entities(d, p), name_matches=match, address_inferred=near)
        node, keys = out._jdf.queryExecution().sparkPlan(), []
        while node.children().size():
            if "Join" in node.nodeName():
                keys.append(node.leftKeys().apply(0).name())
            node = node.children().apply(0)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(keys) > 5 and set(keys) == {"lei"}
