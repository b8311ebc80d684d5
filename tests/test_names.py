import pytest
from helpers import ENT, frame

from tessera.functions import text
from tessera.operators import names


def value(spark, f, x):
    return spark.createDataFrame([(x,)], "x string").select(f("x")).first()[0]


@pytest.mark.parametrize("name,want", [(None, ""), ("  Nestlé S.A. ", "NESTL S A "), ("X INC.", "X INC "), ("a  b", "A B")])
def test_clean_keeps_a_closing_blank(spark, name, want):
    assert value(spark, text.clean_company_name, name) == want


@pytest.mark.parametrize("name,want", [("NESTLE S.A.", "NESTLE"), ("Siemens AG", "SIEMENS"), ("DEUTSCHE BANK AG", "DEUTSCHE BANK"), ("Shell plc", "SHELL"), ("ACME HOLDINGS SDN. BHD.", "ACME")])
def test_brand_token(spark, name, want):
    assert value(spark, text.brand_token, name) == want


def test_country_suffixes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("VINA TNHH",)], "x string")
    assert df.select(text.brand_token(F.col("x"), "VN")).first()[0] == "VINA" and df.select(text.brand_token(F.col("x"), "MY")).first()[0] == "VINA TNHH"


def test_brands_drop_short_and_generic(spark):
    p = frame(spark, "lei:s legal_name:s", [("P1", "NESTLE SA"), ("P2", "AB LTD"), ("P3", "Global Services Ltd"), ("P4", "Nestle Inc"), ("P5", None), (None, "Orphan Ltd"), ("P6", "Asia XYZ Ltd")])
    assert [(r["parent_lei"], r["brand_token"]) for r in names.brand_tokens(p).collect()] == [("P1", "NESTLE")]


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("a,b", [("", "x"), ("abc", "abc"), ("kitten", "sitting"), ("ACME TECH", "TECH ACME"), ("aab", "abaa"), ("x" * 70, "yx" * 40)])
def test_ratio_is_lcs(a, b):
    assert text.ratio(a, b) == (200 * lcs(a, b) / (len(a) + len(b)) if a and b else 0)


def test_word_ratios():
    assert text.token_set_ratio("NESTLE", "NESTLE MALAYSIA") == 100 and text.token_set_ratio("", "A") == 0
    assert text.token_sort_ratio("B A", "A B") == 100
    assert text.token_sort_ratio("ACME TECHNOLOGIES SDN BHD", "ACME TECHNOLOGY SDN BHD") == pytest.approx(91.67, abs=0.01)


E_ROWS = [("D1", "NESTLE MALAYSIA BERHAD"), ("D2", "NUTSHELL CORP"), ("D3", "TOTALLY OTHER SDN BHD"), ("D4", "NESTEL FOODS SDN BHD"), ("D5", "SHELL REFINING SDN BHD"), ("D6", None)]


@pytest.mark.parametrize("threshold", [80, 90])
def test_matches(spark, threshold):
    b = names.brand_tokens(frame(spark, "lei:s legal_name:s", [("P1", "NESTLE SA"), ("P2", "SHELL PLC")]))
    e = frame(spark, "lei:s legal_name:s", E_ROWS)
    got = {r["lei"]: (r["matched_parent_lei"], r["match_score"]) for r in names.match_names(e, b, None, threshold).collect()}
    assert got["D1"] == ("P1", 100) and got["D5"] == ("P2", 100) and "D3" not in got and "D2" not in got
    known = names.match_names(e, b, frame(spark, "lei:s", [("D1",)]), threshold)
    assert "D1" not in {r["lei"] for r in known.collect()}


def slow_match(name, brands, threshold):
    """The rule as stated, pair by pair."""
    import re

    from tessera.functions import rules

    clean = re.sub(r"\s+", " ", re.sub("[^A-Z0-9 ]+", " ", (name or "").upper().strip()))
    token = re.sub(r"\s+", " ", re.sub(text.suffix_pattern(), "", clean)).strip()
    best, score = None, 0
    for lei, b in brands:
        if re.search(rf"\b{re.escape(b)}\b", clean):
            s = 100
        else:
            s = text.token_set_ratio(b, token)
            if s >= threshold and not ({*b.split()} - {*rules.GENERIC_WORDS}) & {*clean.split()}:
                s = max(s - 15, 0)
        if s > score and s >= threshold:
            best, score = (lei, b), s
    return (best[0], best[1], score) if best else None


def test_blocking_loses_nothing(spark):
    import random

    rng = random.Random(1)
    stems = ["ALPHA", "BETA", "GAMMA", "BANK", "GLOBAL", "DELTAS", "DELTA", "ORION", "ORIONS", "FUND"]
    parents = [(f"P{i}", " ".join(rng.choices(stems, k=rng.randrange(1, 4))) + " LTD") for i in range(25)]
    e = [(f"D{i}", " ".join(rng.choices(stems, k=rng.randrange(1, 5))) + rng.choice([" SDN BHD", "", " Bank"])) for i in range(80)]
    brands = names.brand_tokens(frame(spark, "lei:s legal_name:s", parents))
    order = [(r["parent_lei"], r["brand_token"]) for r in sorted(brands.collect(), key=lambda r: r["_ord"])]
    for t in (86, 90, 95):
        got = {r["lei"]: (r["matched_parent_lei"], r["brand_token"], r["match_score"]) for r in names.match_names(frame(spark, "lei:s legal_name:s", e), brands, None, t).collect()}
        want = {lei: m for lei, n in e if (m := slow_match(n, order, t))}
        assert got == want, t


def test_edges_and_summary(spark):
    m = frame(spark, "lei:s matched_parent_lei:s brand_token:s match_score:d match_field:s", [("A", "P", "X", 95.0, "legal_name"), ("B", "P", "X", 85.0, "legal_name"), ("C", "Q", "Y", 82.0, "legal_name"), ("D", "Q", "Y", 75.0, "legal_name")])
    edges = names.inferred_edges(m).collect()
    assert len(edges) == 3 and edges[0]["relationship_type"] == "inferred_name_match" and edges[0]["relationship_status"] == "INFERRED" and edges[0]["accounting_standard"] is None
    s = names.match_summary(m).first()
    assert (s["total_matches"], s["high_confidence"], s["medium_confidence"], s["unique_parents"]) == (4, 1, 2, 2)


def test_ticker_fan_out_and_blank_match(spark):
    e = frame(spark, "lei:s legal_name:s", [("A", "Acme, Inc"), ("B", None), ("C", "None Such")])
    t = frame(spark, "cik:s ticker:s title:s", [("1", "A", "ACME INC"), ("2", "A-B", "Acme  Inc"), ("3", "Z", "")])
    got = sorted((r["lei"], r["ticker"] or "", r["appears_in_edgar"]) for r in names.match_tickers(e, t).collect())
    assert got == [("A", "A", 1), ("A", "A-B", 1), ("B", "Z", 1), ("C", "", 0)]


@pytest.mark.parametrize("name,want", [("Acme Sendirian Berhad", "ACME SDN BHD"), ("Acme Berhad", "ACME BHD"), ("ACME PRIVATE LIMITED", "ACME PTE LTD"), ("A Company Limited", "A CO LTD")])
def test_registry_names(spark, name, want):
    assert value(spark, text.registry_name, name) == want


def registry(spark, entity, directory, threshold=95.0):
    d = frame(spark, "ctos_name:s ctos_url:s ctos_registration_no:s", [(n, "u", "1") for n in directory])
    return [(r["ctos_name"], r["ctos_match_method"]) for r in names.match_registry(frame(spark, "lei:s legal_name:s", [("A", entity)]), d, threshold).collect()]


def test_registry_matches(spark):
    assert registry(spark, "Acme Sdn. Bhd.", ["ACME SENDIRIAN BERHAD", "Acme Sdn Bhd"]) == [("ACME SENDIRIAN BERHAD", "exact")]
    assert registry(spark, "ACME TECHNOLOGIES SDN BHD", ["ACME TECHNOLOGY SDN BHD"]) == []
    assert registry(spark, "ACME TECHNOLOGIES SDN BHD", ["ACME TECHNOLOGY SDN BHD"], 90.0) == [("ACME TECHNOLOGY SDN BHD", "fuzzy")]
    assert registry(spark, "ALPHA TRADING SDN BHD", ["ALPHO TRADING SDN BHD"], 90.0) == []
    assert registry(spark, "MALAYSIA HOLDINGS", ["MALAYSIA HOLDING"], 90.0) == [] and registry(spark, None, ["X"]) == []


@pytest.mark.parametrize("threshold", [70, 85, 90, 95])
def test_text_blocks_lose_no_pair(spark, threshold):
    import random

    rng = random.Random(threshold)
    base = ["".join(rng.choices("abcd ", k=rng.randrange(1, 30))).strip() for _ in range(40)]
    texts = list({x for x in base if x})
    probes = set(texts)
    for x in texts * 6:
        y = list(x)
        for _ in range(rng.randrange(1, 7)):
            if rng.random() < 0.5 and y:
                y.pop(rng.randrange(len(y)))
            else:
                y.insert(rng.randrange(len(y) + 1), rng.choice("abcd"))
        probes.add("".join(y))
    got = names.text_blocks(spark.createDataFrame([(x, x) for x in probes], "p string, probe string"), spark.createDataFrame([(x, x) for x in texts], "t string, text string"), "p", "t", threshold)
    met = {(r["p"], r["t"]) for r in got.collect()}
    alike = {(p, t) for p in probes for t in texts if p and text.ratio(p, t) >= threshold}
    assert alike <= met and len(met) < len(probes) * len(texts)


def test_numbered_is_a_global_order(spark):
    from pyspark.sql import functions as F
    from tessera.operators.ranking import numbered

    rows = [(i % 3, i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "a long, b long"), F.desc("a"), "b").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
    assert numbered(spark.createDataFrame([], "a long"), "a").count() == 0


def test_registry_names_are_made_once_and_not_by_the_scan_of_rows(spark):
    e = frame(spark, ENT, [("A", "Palm Oil Berhad", "MY"), ("B", "Palm Oil Berhad", "MY"), ("C", "Palm Oils Berhad", "MY"), ("D", None, "MY")])
    d = frame(spark, "ctos_name:s ctos_url:s ctos_registration_no:s", [("PALM OIL BHD", "u", "1")])
    got = names.match_registry(e, d, 85)
    assert sorted((r["lei"], r["ctos_match_method"]) for r in got.collect()) == [("A", "exact"), ("B", "exact"), ("C", "fuzzy")]
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_equal_names_are_cleaned_once(spark):
    e = frame(spark, ENT, [("A", "Alphatron Sdn Bhd", "MY"), ("B", "Alphatron Sdn Bhd", "MY"), ("C", "ALPHATRON, SDN BHD", "MY"), ("D", None, "MY")])
    brands = spark.createDataFrame([("ALPHATRON", "P")], "brand_token string, parent_lei string")
    got = names.match_names(e, brands)
    assert sorted((r["lei"], r["matched_parent_lei"], r["match_score"]) for r in got.collect()) == [(x, "P", 100.0) for x in "ABC"]
    assert "coalesce(legal_name" not in got._jdf.queryExecution().optimizedPlan().toString()
