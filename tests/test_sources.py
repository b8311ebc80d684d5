import re
import json

import pytest
from helpers import by, frame

from tessera.functions import rules, schemas
from tessera.functions.dedupe import first_by
from tessera.sources import files, sinks
from tessera.streaming import incremental


def lines(spark, *values):
    return spark.createDataFrame([("q", f"L{i}", v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "query string, lei string, value string")


RECORD = {"id": "L1", "attributes": {"lei": "L1", "entity": {"legalName": {"name": "Acme"}, "otherNames": [{"name": "x", "language": "en"}], "category": "GENERAL", "legalForm": {"id": "BHD"}, "status": "ACTIVE", "legalAddress": {"country": "MY", "city": "KL", "postalCode": "5", "addressLines": ["1 Jln", "Floor 2", "Block C"]}, "headquartersAddress": {"country": "SG"}}, "registration": {"initialRegistrationDate": "2020-01-01T00:00:00Z", "status": "ISSUED"}}}


def test_entity_records(spark):
    got = by(files.entity_records(lines(spark, {"data": [RECORD, RECORD, {"attributes": {"lei": "L2"}}]}, "no json", {"data": None})), "lei")
    assert set(got) == {"L1", "L2"}
    assert (got["L1"]["legal_name"], got["L1"]["legal_form"], got["L1"]["country_hq"], got["L1"]["city_hq"], got["L2"]["legal_name"]) == ("Acme", "BHD", "SG", None, None)
    assert json.loads(got["L1"]["other_names"])[0]["name"] == "x"


def test_addresses_relationships_exceptions(spark):
    a = files.address_records(lines(spark, {"data": RECORD})).first()
    assert (a["address_line1"], a["address_line2"], a["postal_code"]) == ("1 Jln", "Floor 2 | Block C", "5")
    rel = {"data": {"attributes": {"validFrom": "2019", "relationship": {"startNode": {"id": "A"}, "endNode": {"id": "P"}, "status": "ACTIVE", "periods": [{"accountingStandard": "IFRS", "endDate": "2018"}, {"accountingStandard": "US_GAAP", "endDate": "2020"}]}}}}
    r = files.relationship_records(lines(spark, rel, {}), "direct_parent").collect()
    assert len(r) == 1 and (r[0]["source_lei"], r[0]["target_lei"], r[0]["accounting_standard"], r[0]["period_end"], r[0]["valid_from"]) == ("A", "P", "US_GAAP", "2020", "2019")
    e = files.exception_records(lines(spark, {"data": {"attributes": {"reason": "NO_LEI"}}}, {"data": {"attributes": {}}}, {})).collect()
    assert [tuple(x) for x in e] == [("L0", "NO_LEI", None)]


def test_search_tickers_observations(spark):
    s = files.search_records(lines(spark, {"data": [RECORD, RECORD], "meta": {"pagination": {"total": 9}}})).collect()
    assert [(x["rank"], x["total_results"], x["registration_status"]) for x in s] == [(1, 9, "ISSUED"), (2, 9, "ISSUED")]
    t = files.ticker_records(lines(spark, {"0": {"cik_str": 320193, "ticker": "A", "title": "Acme"}})).first()
    assert tuple(t) == ("0000320193", "A", "Acme")
    o = files.observations(lines(spark, {"data": {"dataSets": [{"observations": {"0:1": [5.5, 0], "0:2": []}}]}}))
    assert {r["obs_key"]: r["value"] for r in o.collect()} == {"0:1": "5.5", "0:2": None}
    f = files.flatten_objects(lines(spark, {"a": {"b": 1, "c": {"d": "x"}}, "e": [1]}))
    assert {r["path"]: r["value"] for r in f.collect()} == {"a.b": "1", "a.c.d": "x", "e": "[1]"}


def test_registry_pages(spark):
    page = f"<ul><a class='x' href='{rules.REGISTRY_LINK}1/acme'>ACME &amp; SONS <b>SDN</b></a><a href='/other'>no</a><a href='http://h{rules.REGISTRY_LINK}2'> </a></ul>"
    got = files.registry_listing(spark.createDataFrame([(page,), (page,)], "html string"), "https://r")
    assert [tuple(r) for r in got.collect()] == [("ACME & SONS SDN", f"https://r{rules.REGISTRY_LINK}1/acme")]
    detail = "<p>Company Registration No. 123-A / 2019</p><p>Nature of Business Trading<!-- --> - </p><p>Date of Registration 2019-01-02</p><p>State null COMPANY DESCRIPTION</p>"
    r = files.registry_details(spark.createDataFrame([("u", detail), ("v", "")], "ctos_url string, html string"))
    rows = by(r, "ctos_url")
    assert (rows["u"]["ctos_registration_no"], rows["u"]["ctos_nature_of_business"], rows["u"]["ctos_registration_date"], rows["u"]["ctos_state"]) == ("123-A / 2019", "Trading", "2019-01-02", None)
    full = by(files.enrich_directory(spark.createDataFrame([("u", "keep"), ("w", None)], "ctos_url string, ctos_registration_no string"), r), "ctos_url")
    assert full["u"]["ctos_registration_no"] == "keep" and full["u"]["ctos_nature_of_business"] == "Trading" and full["w"]["ctos_state"] is None


def test_links_and_text_in_any_spelling(spark):
    import random

    rng, pages, want = random.Random(3), [], []
    for i in range(60):
        url, name = f"{rules.REGISTRY_LINK}{i}", f"A{i} & <Co> B"
        quote = rng.choice(["'", '"', ""])
        attrs = [f"href={quote}{url}{quote}", "title='a > b'", 'data-x="</a>"', "download"]
        rng.shuffle(attrs)
        inner = rng.choice(["A{0} &amp; &lt;Co&gt; B", "<b>A{0}</b>\n &amp; <i class='</b>'>&lt;Co&gt;</i> B", "<span><span>A{0} &#38;</span> &#x3c;Co&gt;</span><br/>B", "<!-- <a href='/no'> -->A{0} &amp; &lt;Co> B"]).format(i)
        end = rng.choice(["</a>", "</A >", "<a>other</a>", ""])
        pages.append((f"<{rng.choice('aA')} {' '.join(attrs)}>{inner}{end}<script>'<a href=\"{url}/s\">s</a>'</script>",))
        want.append((name, f"https://r{url}"))
    got = files.registry_listing(spark.createDataFrame([*pages, (None,), ("",), ("<a href>x</a><a href='",)], "html string"), "https://r")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    odd = "<style>State no COMPANY DESCRIPTION</style><p title='State > x'>State<!-- <b> --> <b>Johor</b> COMPANY DESCRIPTION"
    rows = by(files.registry_details(spark.createDataFrame([("u", odd), ("n", None)], "ctos_url string, html string")), "ctos_url")
    assert rows["u"]["ctos_state"] == "Johor" and rows["n"]["ctos_state"] is None


def test_csv_rules(spark, tmp_path):
    (tmp_path / "o.csv").write_text("﻿active,host_country,lei,uie_country,uie_confidence\n,my,L1,US,\nno,MY,L2,US,1\nTRUE,MY,L1,SG,0.5\nyes,SG,L3,US,1\ny,MY,L4,JP,abc\n", "utf-8")
    got = by(files.overrides(spark, str(tmp_path / "o.csv")), "lei")
    assert {k: (r["uie_country"], r["uie_confidence"], r["uie_source"]) for k, r in got.items()} == {"L1": ("US", "0.95", "manual_verified"), "L4": ("JP", "0.95", "manual_verified")}
    (tmp_path / "s.csv").write_text("host_country,lei,review_status\nMY,L1,verified\nMY,L1,todo\n", "utf-8")
    assert [r["review_status"] for r in files.review_statuses(spark, str(tmp_path / "s.csv")).collect()] == ["verified"]
    assert files.overrides(spark, str(tmp_path / "none.csv")).count() == 0


def test_load_and_save(spark, tmp_path):
    root = str(tmp_path)
    df = frame(spark, "lei:s legal_name:s", [("A", "x")])
    sinks.save_parquet(df, f"{root}/a")
    assert files.load(spark, f"{root}/a", schemas.ENTITY).columns[:13] == schemas.ENTITY.names
    with pytest.raises(FileNotFoundError):
        files.load(spark, f"{root}/b")
    assert files.load_optional(spark, f"{root}/b", schemas.ENTITY).count() == 0
    assert files.load_first(spark, [f"{root}/b", f"{root}/a"], schemas.ENTITY).count() == 1
    assert files.country_paths(root, "MY")["lei"] == [f"{root}/lei/country=my", f"{root}/malaysia_lei.parquet"]
    sinks.save_all_csv({"t": df}, f"{root}/csv")
    assert spark.read.option("header", True).csv(f"{root}/csv/t").first()["lei"] == "A"
    m = by(sinks.manifest(spark, {"a": f"{root}/a", "b": f"{root}/b"}), "role")
    assert (m["a"]["rows"], m["b"]["exists"]) == (1, False)


def test_chain_context(spark, tmp_path):
    rel = frame(spark, "source_lei:s target_lei:s relationship_type:s country:s", [("A", "P", "direct_parent", "my"), ("A", "P", "direct_parent", "sg"), ("A", "P", "ultimate_parent", "sg")]).drop("_ord")
    sinks.save_parquet(rel, f"{tmp_path}/relationships", ["country"])
    rels, entities = files.chain_context(spark, str(tmp_path))
    assert rels.count() == 2 and entities.count() == 0


def test_append_and_states(spark, tmp_path):
    df = frame(spark, "lei:s v:i", [("A", 1), ("B", 2), ("A", 1)]).drop("_ord")
    assert [sinks.append_new(df, f"{tmp_path}/t", ["lei"]) for _ in range(2)] == [2, 0]
    s = sinks.StageStates(spark, f"{tmp_path}/states")
    assert not s.is_done("MY", "pull")
    s.mark("MY", "pull", "running")
    s.mark("MY", "pull", "done", "5 rows")
    assert s.is_done("MY", "pull") and s.table().first()["detail"] == "5 rows"
    s.reset("MY")
    assert not s.is_done("MY", "pull")


def test_incremental_scan(spark, tmp_path):
    land, root = tmp_path / "land", str(tmp_path / "out")
    land.mkdir()

    def put(name, *rows):
        (land / name).write_text("".join(json.dumps({"lei": k, "value": json.dumps(v)}) + "\n" for k, v in rows))

    hit = {"data": {"attributes": {"reason": "NO_LEI"}}}
    put("1.json", ("A", hit), ("B", {}))
    for _ in range(2):
        incremental.ingest(spark, str(land), root, files.exception_records, ["lei"])
    assert spark.read.parquet(f"{root}/rows").count() == 1
    put("2.json", ("C", hit), ("A", hit))
    incremental.ingest(spark, str(land), root, files.exception_records, ["lei"])
    assert sorted(r["lei"] for r in spark.read.parquet(f"{root}/rows").collect()) == ["A", "C"]
    wanted = frame(spark, "lei:s", [("A",), ("B",), ("C",), ("D",), (None,)])
    seen = incremental.scanned_table(spark, root)
    assert [r["lei"] for r in incremental.pending(wanted, seen).collect()] == ["D"]
    assert tuple(incremental.scan_progress(wanted, seen).first()[c] for c in ("wanted", "scanned", "left")) == (4, 3, 1)
    assert incremental.pending(wanted, None).count() == 4


def test_conform_and_first_by(spark):
    df = frame(spark, "lei:s extra:s", [("A", "x"), ("A", "y"), (None, "z")])
    assert schemas.conform(df, schemas.EXCEPTION).columns == [*schemas.EXCEPTION.names, "_ord"]
    assert sorted((r["lei"] or "", r["extra"]) for r in first_by(df, "lei").collect()) == [("", "z"), ("A", "x")]
    assert rules.country_rules("zz").code == "ZZ" and rules.supported_countries()[0] == "BN" and len(rules.COUNTRIES) == 11


def test_tables_on_spark_have_the_rows_of_their_sql_and_join_fewer_orders(spark):
    from tessera.sources import adapter

    at = "/root/testdata/sf0.001"
    reads = {t: spark.read.parquet(f"{at}/{t}.parquet") for t in adapter.BASE}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for name in ("domestic", "parents", "relationships"):
        text = adapter.SQL[name]
        for t in adapter.BASE:
            text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
        df = adapter.canonical(spark, at, name)
        assert sorted(map(str, df.collect())) == sorted(map(str, spark.sql(text, **{t: reads[t] for t in adapter.BASE if f"{{{t}}}" in text}).collect()))
    # Orders of other customers go before lines are joined.
    rows = [x for x in plan(adapter.canonical(spark, at, "relationships")).splitlines() if "Filter" in x]
    assert any("o_orderkey" in x and "% 3" in x for x in rows)
