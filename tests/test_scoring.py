import pytest
from helpers import by, frame

from tessera.operators import scoring


def test_score_and_flags(spark):
    rows = frame(spark, "lei:s size_proxy:d has_inferred_parent:i in_address_cluster:i is_non_consolidating:i", [("A", 100.0, 1, 1, 1), ("B", 0.0, 0, 0, None)])
    got = by(scoring.coverage_score(rows), "lei")
    assert got["A"]["coverage_gap_score"] == pytest.approx(0.25 + 0.10 + 0.05 + 0.05 + 0.15 + 0.10)
    assert got["A"]["reason_flags"] == "large_network_presence;inferred_parent_match;shared_address_cluster;non_consolidating_entity;missing_direct_parent;missing_ultimate_parent"
    assert got["B"]["coverage_gap_score"] == pytest.approx(0.25) and got["B"]["size_scaled"] == 0


def test_constant_sizes_and_empty(spark):
    same = scoring.coverage_score(frame(spark, "lei:s size_proxy:d", [("A", 5.0), ("B", 5.0)]))
    assert {r["size_scaled"] for r in same.collect()} == {0.0}
    empty = scoring.coverage_score(frame(spark, "lei:s", []))
    assert empty.count() == 0 and {"coverage_gap_score", "coverage_gap_priority_score", "reason_flags"} <= set(empty.columns)


def queue(spark, scored, uie, statuses=None, limit=500):
    s = frame(spark, "lei:s legal_name:s coverage_gap_priority_score:d reason_flags:s", scored)
    u = frame(spark, "lei:s uie_country:s uie_source:s evidence_tier:s uie_confidence:d", uie)
    return scoring.review_targets(s, u, statuses, limit).collect()


def test_queue_order_and_focus(spark):
    got = queue(spark, [("M1", "Model Co", 0.3, ""), ("K1", "Known Co", 0.6, ""), ("L1", "Low Co", 0.1, "")], [("M1", "SG", "phase3_jurisdiction_model", "E", 0.5), ("K1", "US", "gleif_ultimate_parent", "A", 1.0), ("L1", "US", "gleif_ultimate_parent", "A", 1.0)])
    assert [(r["lei"], r["review_priority_score"], r["review_reason"]) for r in got] == [("K1", 0.6, "known_uie_but_high_coverage_gap"), ("M1", 0.48, "validate_model_only_investor_economy")]
    assert got[0].__fields__ == scoring.REVIEW_COLUMNS and len(scoring.REVIEW_COLUMNS) == 38


@pytest.mark.parametrize("name", ["Growth Equity Fund", "AMANAH SAHAM MALAYSIA", "X DANA Y", "ASN EQUITY 3", "Fundamental fundamentals", "A.Fund"])
def test_funds(spark, name):
    got = queue(spark, [("F1", name, 0.5, "")], [("F1", None, "unassigned", "U", 0.0)])[0]
    assert (got["entity_type"], got["review_status"], got["review_reason"], got["review_priority_score"]) == ("fund_or_product_vehicle", "product_vehicle_rule_applied", "fund_product_vehicle_rule_applied", 0.55)


def test_types_and_buckets(spark):
    rows = [("N", "ABC NOMINEES SDN BHD", 0.9, ""), ("B", "BANK OF X", 0.1, ""), ("O", "OPERATING CO", 0.3, ""), ("F", "SOME FUND", 0.9, ""), ("Z", None, 0.2, "")]
    got = queue(spark, rows, [(r[0], None, "unassigned", "U", 0.0) for r in rows])
    assert [r["lei"] for r in got] == ["O", "Z", "B", "N", "F"]
    assert {r["lei"]: r["entity_type"] for r in got} == {"N": "nominee_or_custodian", "B": "financial_institution", "O": "operating_or_holding_company", "F": "fund_or_product_vehicle", "Z": "operating_or_holding_company"}
    assert len(queue(spark, rows, [(r[0], None, "unassigned", "U", 0.0) for r in rows], limit=2)) == 2


def test_given_status_is_kept(spark):
    st = frame(spark, "lei:s review_status:s entity_type:s review_note:s", [("F", "verified", "state_owned_entity", "n"), ("F", "later", "x", "m")])
    got = queue(spark, [("F", "SOME FUND", 0.9, "")], [("F", None, "unassigned", "U", 0.0)], st)[0]
    assert (got["review_status"], got["entity_type"], got["review_note"]) == ("verified", "state_owned_entity", "n")


def test_missing_assignment_counts_as_other(spark):
    got = queue(spark, [("X", "CO", 0.45, "")], [])[0]
    assert (got["review_priority_score"], got["review_reason"]) == (0.55, "find_parent_or_investor_economy")


def test_search_benchmark(spark):
    t = frame(spark, "lei:s legal_name:s review_priority_score:d review_status:s entity_type:s uie_country:s uie_source:s", [("A", " Alpha ", 0.5, "todo", "x", "MY", "s"), ("B", "Beta", 0.4, "todo", "x", None, "s"), ("C", "Gone", 0.1, "todo", "x", "MY", "s")])
    c = frame(spark, "query:s rank:i lei:s legal_name:s country_legal:s country_hq:s total_results:i", [("Alpha", 1, "A", "Alpha", "MY", "MY", 2), ("Alpha", 2, "Q", "Alpha 2", "US", "US", 2), ("Beta", 1, "R", "Beta", "US", "US", 1)])
    got = sorted((r["lei"], r["gleif_candidate_rank"] or 0, r["review_flag"], r["gleif_total_results"]) for r in scoring.search_benchmark(t, c).collect())
    assert got == [("A", 1, "self_entity_found", 2), ("A", 2, "candidate_country_differs_from_current_uie", 2), ("B", 1, "candidate_for_review", 1), ("C", 0, "no_candidate", 0)]
