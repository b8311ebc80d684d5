import json

import pytest
from helpers import frame

from tessera.plans import cli
from tessera.sources import landing, sinks


def replies(*items):
    todo = list(items)

    def request():
        x = todo.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    return request


def test_retries_and_waits():
    waits = []
    assert landing.ask(replies((429, ""), OSError("lost"), (503, ""), (200, '{"a": 1}')), sleep=waits.append) == {"a": 1}
    assert waits == [8, 11, 17, 0.35]
    assert [landing.Policy().wait(n) for n in range(8)] == [8, 11, 17, 29, 53, 101, 120, 120]
    with pytest.raises(landing.PullError):
        landing.ask(replies((400, "")), sleep=waits.append)
    with pytest.raises(landing.PullError):
        landing.ask(replies((500, ""), (500, "")), landing.Policy(tries=2), sleep=waits.append)
    assert landing.ask(replies((404, "")), landing.Policy(missing_is_empty=True), sleep=waits.append) == {}


def test_pulls_split_only_where_cut_off():
    asked = []

    def pull(f):
        asked.append(len(f))
        return [f], len(f) < 2 or f.get("filter[entity.status]") == "ACTIVE" and len(f) < 3

    got = list(landing.split_pull(pull, {"c": "SG"}))
    assert len(got) == 4 + 1 and not any(cut for _, _, cut in got) and asked == [1, 2, 3, 3, 3, 3, 2]


def test_pages():
    pages = {1: [1, 2], 2: [3]}
    assert landing.paged(lambda n: pages.get(n, []), 5, 2) == ([1, 2, 3], False)
    assert landing.paged(lambda n: [n, n], 2, 2) == ([1, 1, 2, 2], True)

    def beyond(n):
        if n > 1:
            raise landing.PullError("400")
        return [n]

    assert landing.paged(beyond) == ([1], True)


def test_crawl():
    def fetch(letter, n):
        if letter == "B" or (letter, n) == ("A", 2):
            raise OSError("down")
        return "" if (letter, n) == ("C", 2) else f"{letter}{n}"

    got = [x[2] for x in landing.crawl(fetch, bool, "ABC", 4, [("A", 1)], 2)]
    assert got == ["A3", "A4", "C1"]


def test_landing_and_cache(spark, tmp_path):
    path = str(tmp_path / "l")
    assert not landing.use_cached(spark, path)
    assert landing.land(spark, ((f"L{i}", json.dumps({"i": i})) for i in range(5)), "lei string, value string", path, 2) == 5
    assert spark.read.json(path).count() == 5 and landing.use_cached(spark, path) and not landing.use_cached(spark, path, True)


FEW = {"trees": 3, "folds": 1}


def country_tables(spark, root, code, letter, n=24):
    """Entities, every other with a parent in one of two countries; names that match, and one that does not."""
    e = frame(spark, "lei:s legal_name:s country_legal:s category:s legal_form:s city_legal:s registered_at:s", [(f"{letter}{i:02}", f"{('ALPHA', 'OMEGA')[i % 2]} WORKS {letter}{i} SDN BHD", code, "GENERAL", "F", "X", "2001-01-01") for i in range(n)] + [(f"{letter}90", "ZETA TRADING BERHAD", code, "FUND", "G", "Y", None)]).drop("_ord")
    p = frame(spark, "lei:s legal_name:s country_legal:s", [("P1", "ALPHA PLC", "US"), ("P2", "OMEGA PLC", "DE")]).drop("_ord")
    r = frame(spark, "source_lei:s target_lei:s relationship_type:s", [(f"{letter}{i:02}", f"P{i % 2 + 1}", "direct_parent") for i in range(n - 4)]).drop("_ord")
    a = frame(spark, "lei:s address_line1:s postal_code:s", [(f"{letter}{i:02}", "1 Jalan Raja", "50000") for i in range(5)] + [(f"{letter}90", "9 Jalan Raja", "50000")]).drop("_ord")
    x = frame(spark, "lei:s exception_reason:s", [(f"{letter}90", "NATURAL_PERSONS")]).drop("_ord")
    for name, df in (("lei", e), ("related_lei", p), ("relationships", r), ("addresses", a), ("reporting_exceptions", x)):
        sinks.save_parquet(df, f"{root}/{name}/country={code.lower()}")


def test_batch_runs_all_phases_of_each_country_once(spark, tmp_path, capsys):
    root = str(tmp_path)
    country_tables(spark, root, "MY", "A")
    country_tables(spark, root, "SG", "B")
    run = lambda: {(x["country"], x["stage"]): (x["status"], x["at"]) for x in cli.run_batch(spark, root, ["MY", "SG", "TH"], inference=FEW, iterations=5).collect()}
    first = run()
    assert {k: v[0] for k, v in first.items()} == {(c, s): "done" for c in ("MY", "SG") for s in ("inference", "scoring")}
    for code, letter in (("my", "A"), ("sg", "B")):
        uie = {x["lei"]: x for x in spark.read.parquet(f"{root}/processed/country={code}/uie").collect()}
        assert uie[f"{letter}00"]["uie_source"] == "gleif_direct_parent" and uie[f"{letter}20"]["uie_source"] == "phase1_name_match"
        # No name, address or parent: only the model's evidence is left.
        assert uie[f"{letter}90"]["uie_source"] == "phase3_jurisdiction_model" and uie[f"{letter}90"]["uie_country"] is not None
        at = f"{root}/inference/country={code}/graph"
        assert {"P1", "P2"} <= {x["lei"] for x in spark.read.parquet(f"{at}/propagated").collect()}
        summary = spark.read.parquet(f"{at}/summary").first()
        assert summary["link_predictions_count"] == spark.read.parquet(f"{at}/links").count()
        assert spark.read.json(f"{root}/inference/country={code}/jurisdiction/model/metrics").count() == 1
    assert run() == first
    assert cli.main(["profile", "--root", root], spark) == 0 and "profile/country=my" in capsys.readouterr().out


def test_model_and_links_get_what_the_phases_before_found(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path), {}
    country_tables(spark, root, "MY", "A")

    def model(x, matches=None, graph_table=None, **train):
        seen["model"] = ({r["lei"] for r in matches.collect()}, {r["lei"]: r["in_degree"] for r in graph_table.collect()}, train)
        return {"labels": matches}

    def graph_phase(x, matches=None, **train):
        seen["links"] = ({r["lei"] for r in matches.collect()}, train)
        return {"readiness": matches}

    monkeypatch.setattr(cli.pipelines, "jurisdiction_prediction", model)
    monkeypatch.setattr(cli.pipelines, "graph_prediction", graph_phase)
    for command in ("model", "links"):
        assert cli.main([command, "--root", root, "--trees", "7", "--folds", "2"], spark) == 0
    named, ranks, train = seen["model"]
    assert named == {"A20", "A21", "A22", "A23"} and (ranks["P1"], ranks["P2"], ranks["A90"]) == (10, 10, 0)
    assert train == {"trees": 7, "folds": 2} and seen["links"] == (named, train)


def test_pull_registry_tickers_and_benchmark_from_landed_files(spark, tmp_path):
    root = str(tmp_path)

    def land(path, rows):
        (tmp_path / "landing" / path).mkdir(parents=True)
        (tmp_path / "landing" / path / "part.json").write_text("\n".join(json.dumps(r) for r in rows))

    record = lambda lei, name, country="MY": {"id": lei, "attributes": {"lei": lei, "entity": {"legalName": {"name": name}, "legalAddress": {"country": country, "addressLines": ["1 Jalan Raja", "Level 2"], "postalCode": "50000"}}}}
    link = {"data": {"attributes": {"relationship": {"startNode": {"id": "A1"}, "endNode": {"id": "P1"}, "status": "ACTIVE"}}}}
    land("country=my/lei", [{"value": json.dumps({"data": [record("A1", "ACME TRADING SDN BHD"), record("A2", "ORION PALM SDN BHD")]})}])
    land("country=my/related_lei", [{"value": json.dumps({"data": record("P1", "ACME PLC", "US")})}])
    land("country=my/relationships", [{"kind": "direct_parent", "value": json.dumps(link)}, {"kind": "ultimate_parent", "value": "{}"}])
    land("country=my/addresses", [{"value": json.dumps({"data": record("A1", "x")})}])
    land("country=my/reporting_exceptions", [{"lei": "A2", "value": json.dumps({"data": {"attributes": {"reason": "NO_LEI"}}})}])
    land("registry/listing", [{"html": '<a href="/single-report/malaysia-company/1">ORION PALM SENDIRIAN BERHAD</a>'}])
    land("registry/details", [{"ctos_url": "/single-report/malaysia-company/1", "html": "<p>Company Registration No. 55 / 1 Nature of Business Palm Date of Registration 2001-01-01 State Perak COMPANY DESCRIPTION</p>"}])
    land("tickers", [{"value": json.dumps({"0": {"cik_str": 7, "ticker": "OP", "title": "Orion Palm Sdn Bhd"}})}])
    land("searches", [{"query": "ORION PALM SDN BHD", "value": json.dumps({"meta": {"pagination": {"total": 1}}, "data": [record("A2", "ORION PALM SDN BHD")]})}])
    for command in ("pull", "registry", "tickers", "score", "benchmark"):
        assert cli.main([command, "--root", root], spark) == 0
    assert spark.read.parquet(f"{root}/relationships/country=my").count() == 1 and spark.read.parquet(f"{root}/addresses/country=my").first()["address_line2"] == "Level 2"
    match = spark.read.parquet(f"{root}/registry_matches/country=my/matches").collect()
    assert [(r["lei"], r["ctos_registration_no"], r["ctos_match_method"]) for r in match] == [("A2", "55 / 1", "exact")]
    assert {r["lei"]: r["cik"] for r in spark.read.parquet(f"{root}/ticker_matches/country=my/matches").collect()} == {"A1": None, "A2": "0000000007"}
    flags = {r["lei"]: r["review_flag"] for r in spark.read.parquet(f"{root}/benchmark/country=my/benchmark").collect()}
    assert flags["A2"] == "self_entity_found"
