import pytest
from helpers import frame

from tessera.operators import macro

WIDE = "COUNTRY:s COUNTERPART_COUNTRY:s DI_DIRECTION:s DI_ENTITY:s INSTR_ASSET:s ACCOUNTING_ENTRY:s 2023:s"
FIX = ("All entities", "All financial instruments")


def test_positions(spark):
    net = "Net (liabilities less assets)"
    rows = [("Malaysia", "United States", "Inward", *FIX, net, "10.5"), ("Malaysia", "United States", "Inward", *FIX, net, "2"), ("Malaysia", "United States", "Inward", *FIX, net, "-1"), ("Malaysia", "United States", "Inward", *FIX, net, "C"), ("Malaysia", "Mars", "Inward", *FIX, net, "5"), ("France", "United States", "Inward", *FIX, net, "5"), ("Malaysia", "United States", "Outward", *FIX, "Net (assets less liabilities)", "7"), ("Malaysia", "United States", "Inward", "SPEs", FIX[1], net, "9")]
    df = frame(spark, WIDE.replace("2023", "y"), rows).withColumnRenamed("y", "2023")
    hosts, partners = {"Malaysia": "MY"}, {"United States": "US"}
    assert [tuple(r) for r in macro.positions(df, "Inward", hosts, partners).collect()] == [("MY", "US", 12.5)]
    assert [tuple(r) for r in macro.positions(df, "Outward", hosts, partners).collect()] == [("MY", "US", 7.0)]


def test_mix_counts_and_density(spark):
    uie = frame(spark, "host_country:s lei:s uie_country:s uie_source:s is_known_uie:i", [("MY", "a", "US", "gleif_ultimate_parent", 1), ("MY", "b", "OFFSHORE", "phase3_jurisdiction_model", 0), ("MY", "c", "MY", "manual_verified", 1), ("MY", "d", None, "unassigned", 0)])
    m = macro.uie_mix(uie).first()
    assert (m["uie_rows"], m["foreign_uie_count"], m["known_uie_share_pct"], m["model_fallback_share_pct"], m["unassigned"]) == (4, 2, 50.0, 25.0, 1)
    assert sorted(tuple(r) for r in macro.bilateral_counts(uie).collect()) == [("MY", "MY", 1), ("MY", "US", 1)]
    inward = frame(spark, "host:s parent:s fdi_usd_mn:d", [("MY", "US", 1500.0), ("MY", "SG", 500.0)])
    d = macro.inward_density(macro.uie_mix(uie), inward).first()
    assert (d["inward_fdi_usd_bn"], d["inward_lei_density"]) == (2.0, 1.0)


def test_outward_and_pooled(spark):
    counts = frame(spark, "host:s parent:s entity_count:l", [("MY", "SG", 6), ("TH", "SG", 4), ("MY", "US", 3)])
    out = frame(spark, "host:s parent:s fdi_usd_mn:d", [("SG", "MY", 2000.0), ("SG", "TH", 500.0)])
    pairs = macro.outward_bilateral(counts, out)
    assert sorted((r["source"], r["destination"], r["outward_lei_density"]) for r in pairs.collect()) == [("SG", "MY", 3.0), ("SG", "TH", 8.0)]
    s = macro.outward_source_summary(pairs).first()
    assert (s["destination_count"], s["my_owned_or_source_owned_leis"], s["asean_outward_lei_density"]) == (2, 10, 4.0)
    inward = frame(spark, "host:s parent:s fdi_usd_mn:d", [("MY", "SG", 1000.0), ("TH", "SG", 1000.0), ("MY", "US", 100.0)])
    assert [(r["parent"], r["entities_per_10bn"], r["n_hosts"]) for r in macro.entities_per_10bn(counts, inward).collect()] == [("SG", 50.0, 2)]


def test_rank_correlation(spark):
    import pandas as pd

    rows = [("MY", f"P{i}", x, y) for i, (x, y) in enumerate([(1, 5.0), (2, 4.0), (2, 7.0), (5, 9.0), (8, 8.0), (8, 8.0)])] + [("TH", "P0", 1, 1.0), ("TH", "P1", 2, 2.0)]
    counts = frame(spark, "host:s parent:s entity_count:l", [(h, p, x) for h, p, x, _ in rows])
    inward = frame(spark, "host:s parent:s fdi_usd_mn:d", [(h, p, y) for h, p, _, y in rows])
    got = {r["host"]: r for r in macro.spearman_by_host(counts, inward).collect()}
    d = pd.DataFrame(rows, columns=["h", "p", "x", "y"])
    want = lambda g: g["x"].rank().corr(g["y"].rank())
    assert set(got) == {"MY", "ALL"} and got["MY"]["rho"] == pytest.approx(want(d[d.h == "MY"])) and got["ALL"]["rho"] == pytest.approx(want(d))


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.07338803), (0.0, 5, 1.0), (12.706205, 1, 0.05), (1.959964, 1e7, 0.05), (5.0, 3, 0.01539245)])
def test_t_tail(t, df, p):
    assert macro.t_tail(t, df) == pytest.approx(p, rel=1e-4)
