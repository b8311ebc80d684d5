import pytest
from helpers import by, frame

from tessera.functions import text
from tessera.operators import profile

COLS = "lei:s legal_name:s category:s legal_form:s entity_status:s registered_at:s country_legal:s city_legal:s country_hq:s"
ROWS = [
    ("L1", "a", "GENERAL", "BHD", "ACTIVE", "2019-05-01", "MY", "KUALA LUMPUR", "MY"), ("L2", "b", "FUND", None, "INACTIVE", "2020-01-01T00:00:00Z", "MY", " kuala lumpur ", "SG"),
    ("L3", "c", None, "BHD", "ACTIVE", "not a date", "MY", None, "MY"), ("L4", "d", "BRANCH", "LTD", "ACTIVE", "2020-07-01", "SG", "SINGAPORE", "SG"),
]


@pytest.fixture
def df(spark):
    return frame(spark, COLS, ROWS)


@pytest.mark.parametrize("x", ["KUALA-LUMPUR", "(SABAH)", "o'neill 3rd", "éCOLE du nord", ""])
def test_title(spark, x):
    assert spark.createDataFrame([(x,)], "x string").select(text.title_case("x")).first()[0] == x.title()


def test_discovery(df):
    r = profile.discovery_summary(df).first()
    assert (r["total_records"], r["unique_leis"], r["active_entities"], r["inactive_entities"], r["countries_legal"], r["cities_legal"], r["earliest_registration"]) == (4, 4, 3, 1, 2, 3, "2019-05-01")


def test_cities_keep_a_null_group(df):
    got = {r["city_legal"]: (r["count"], r["pct"]) for r in profile.geographic_concentration(df).collect()}
    assert got == {"Kuala Lumpur": (2, 50.0), None: (1, 25.0), "Singapore": (1, 25.0)}
    assert profile.geographic_concentration(df, 1).count() == 1


def test_mismatch_distributions_timeline(df):
    assert [r["lei"] for r in profile.hq_mismatch(df).collect()] == ["L2"]
    assert {r["legal_form"]: r["count"] for r in profile.distribution(df, "legal_form").collect()} == {"BHD": 2, "LTD": 1, "UNKNOWN": 1}
    assert [(r["period"], r["count"]) for r in profile.registration_timeline(df).collect()] == [("2019", 1), ("2020", 2)]


def test_countries_side_by_side(df):
    got = profile.country_profiles(df).collect()
    assert [(r["country"], r["total_entities"], r["top_city"], r["top_city_concentration_pct"], r["hq_mismatch_pct"], r["pct_fund"]) for r in got] == [("MY", 3, "Kuala Lumpur", 66.7, 33.3, 33.3), ("SG", 1, "Singapore", 100.0, 0.0, 0.0)]


def test_empty(spark):
    none = frame(spark, COLS, [])
    assert profile.discovery_summary(none).first()["total_records"] == 0
    report = profile.structural_report(none)
    assert len(report) == 8 and all(t.count() == 0 for n, t in report.items() if n != "discovery")


def test_exception_flags(spark):
    got = by(profile.with_exception_flags(frame(spark, "lei:s", [("A",), ("B",), ("C",)]), frame(spark, "lei:s exception_reason:s", [("A", "NON_CONSOLIDATING"), ("B", "NO_LEI"), ("B", "NON_CONSOLIDATING")])), "lei")
    assert {k: (r["is_non_consolidating"], r["has_exception_filed"]) for k, r in got.items()} == {"A": (1, 1), "B": (0, 1), "C": (0, 0)}


def test_histogram(spark):
    got = {r["bin"]: r["n"] for r in profile.out_degree_histogram(frame(spark, "out_degree:l", [(0,), (1,), (30,), (30,)])).collect()}
    assert got == {1: 1, 2: 1, 30: 2}
