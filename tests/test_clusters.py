import pytest
from helpers import by, frame

from tessera.functions import text
from tessera.operators import clusters

ADDR = "lei:s address_line1:s postal_code:s"


@pytest.mark.parametrize("line,want", [("No. 5, Jln. Ampang", "NO 5 JALAN AMPANG"), ("12 TMN Melati", "12 TAMAN MELATI"), (None, ""), ("", ""), ("Level 3 - Block A", "LEVEL 3 - BLOCK A"), ("SRI kg.", "SERI KAMPUNG")])
def test_lines(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(text.address_line("x")).first()[0] == want


def rows(spark):
    return frame(spark, ADDR, [("L1", "Jln Labuan 1", "87000"), ("L2", "JALAN LABUAN 1", " 87000 "), ("L3", "Jln. Labuan 1", "87000"), ("L4", "Elsewhere", "1"), ("L5", None, "1"), ("L6", "Nullpost", None), ("L7", "nullpost", None), ("L8", "nullpost", None)])


def test_clusters(spark):
    got = by(clusters.cluster_by_address(rows(spark)), "lei")
    assert set(got) == {"L1", "L2", "L3", "L6", "L7", "L8"}
    assert got["L1"]["cluster_address_key"] == "JALAN LABUAN 1|87000" and got["L1"]["is_office_hotel"] and got["L1"]["cluster_size"] == 3
    assert got["L6"]["cluster_address_key"] == "NULLPOST|None" and not got["L6"]["is_office_hotel"]
    assert {got["L1"]["address_cluster_id"], got["L6"]["address_cluster_id"]} == {0, 1}
    assert clusters.cluster_by_address(rows(spark), 4).count() == 0


def test_countries_without_rules_use_the_defaults(spark):
    got = clusters.cluster_by_address(frame(spark, ADDR, [(f"L{i}", "BT. 9 Wisma UOA", "1") for i in range(3)]), country="XX").first()
    assert got["cluster_address_key"].startswith("BUKIT") and got["is_office_hotel"]


CL = "lei:s address_cluster_id:l cluster_size:l cluster_address_key:s is_office_hotel:b"


def inferred(spark, members, links):
    return by(clusters.infer_cluster_parents(frame(spark, CL, members), frame(spark, "source_lei:s target_lei:s", links)), "lei")


def test_parents_spread(spark):
    got = inferred(spark, [(f"L{i}", 0, 3, "k", False) for i in (1, 2, 3)], [("L1", "P1"), ("L1", "P2")])
    assert {k: v["inferred_parent_lei"] for k, v in got.items()} == {"L2": "P1", "L3": "P1"}
    assert got["L2"]["confidence"] == 0.7 and got["L2"]["confidence_basis"] == "small_shared_address"


def test_confidence(spark):
    small = inferred(spark, [("A", 0, 4, "k", False), ("B", 0, 4, "k", False)], [("A", "P")])["B"]
    large = inferred(spark, [("A", 0, 120, "k", True), ("B", 0, 120, "k", True)], [("A", "P")])["B"]
    many = inferred(spark, [(x, 0, 20, "k", False) for x in "ABCDE"], [(x, "P" + x) for x in "ABCD"])["E"]
    assert large["confidence"] == 0.2 <= 0.3 < small["confidence"]
    assert many["confidence"] == pytest.approx(0.64) and many["confidence_basis"] == "medium_shared_address_multi_anchor" and many["inferred_parent_lei"] == "PA"


def test_summary(spark):
    s = clusters.cluster_summary(clusters.cluster_by_address(rows(spark))).first()
    assert (s["total_clustered_entities"], s["num_clusters"], s["largest_cluster"], s["office_hotel_entities"], s["avg_cluster_size"]) == (6, 2, 3, 3, 3.0)
    none = clusters.cluster_summary(frame(spark, CL, [])).first()
    assert none["total_clustered_entities"] == 0 and none["avg_cluster_size"] == 0


def test_keys_are_made_once_an_address_and_not_by_the_scan_of_rows(spark):
    plan = clusters.cluster_by_address(rows(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
