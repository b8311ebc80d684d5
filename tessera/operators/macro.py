"""Macro validation: investment positions, densities, and rank correlation with entity counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import rules
from tessera.operators.profile import share


def _mapped(column: str, codes: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in codes.items() for x in p])[F.col(column)] if codes else F.lit(None).cast("string")


def positions(wide: DataFrame, direction: str, hosts: dict[str, str], partners: dict[str, str], year: str = "2023") -> DataFrame:
    """host, parent, fdi_usd_mn: positive net positions of one direction, summed. hosts and partners: names to ISO codes."""
    kept = wide.where((F.col("DI_DIRECTION") == direction) & (F.col("DI_ENTITY") == rules.POSITION_ENTITY) & (F.col("INSTR_ASSET") == rules.POSITION_INSTRUMENT) & (F.col("ACCOUNTING_ENTRY") == rules.POSITION_ENTRY[direction]) & F.col("COUNTRY").isin(list(hosts)))
    rows = kept.select(_mapped("COUNTRY", hosts).alias("host"), _mapped("COUNTERPART_COUNTRY", partners).alias("parent"), F.col(f"`{year}`").cast("string").try_cast("double").alias("v"))
    return rows.where("host is not null and parent is not null and v > 0").groupBy("host", "parent").agg(F.sum("v").alias("fdi_usd_mn"))


def bilateral_counts(uie: DataFrame) -> DataFrame:
    """host, parent, entity_count of entities with a known parent in a two-letter economy."""
    return uie.where("is_known_uie = 1 and uie_country rlike '^[A-Z]{2}$'").groupBy(F.col("host_country").alias("host"), F.col("uie_country").alias("parent")).agg(F.count("*").alias("entity_count"))


def uie_mix(uie: DataFrame) -> DataFrame:
    """One row a host: rows, foreign, known and per-source counts and shares. Buckets of countries count as foreign."""
    n = F.col("uie_rows")
    names = {"gleif_ultimate": "gleif_ultimate_parent", "gleif_direct": "gleif_direct_parent", "address_cluster": "phase2_address_cluster", "name_match": "phase1_name_match", "manual_verified": "manual_verified", "unassigned": "unassigned"}
    out = uie.groupBy(F.col("host_country").alias("country")).agg(F.count("*").alias("uie_rows"), F.count_if(F.col("uie_country").isNotNull() & (F.col("uie_country") != F.col("host_country"))).alias("foreign_uie_count"), F.sum("is_known_uie").alias("known_uie_count"), F.count_if(F.col("uie_source") == "phase3_jurisdiction_model").alias("model_fallback_count"), *[F.count_if(F.col("uie_source") == s).alias(k) for k, s in names.items()])
    return out.withColumns({"known_uie_share_pct": share(F.col("known_uie_count"), n), "model_fallback_share_pct": share(F.col("model_fallback_count"), n)})


def raw_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """metric, n: one count a table, as one union."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def country_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """country, and the rows of each table (all with a column country) in a column of its name; countries of the first table, 0 for none."""
    out = None
    for name, df in tables.items():
        n = df.groupBy("country").agg(F.count("*").alias(name))
        out = n if out is None else out.join(n, "country", "left")
    return out.na.fill(0)


def inward_density(mix: DataFrame, inward: DataFrame) -> DataFrame:
    """mix with inward_fdi_usd_bn and foreign entities per billion; null without positions."""
    totals = inward.groupBy(F.col("host").alias("country")).agg((F.sum("fdi_usd_mn") / 1000).alias("inward_fdi_usd_bn"))
    return mix.join(totals, "country", "left").withColumn("inward_lei_density", F.try_divide(F.col("foreign_uie_count"), F.col("inward_fdi_usd_bn")))


def outward_bilateral(counts: DataFrame, outward: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """source, destination, entity_count, positions and density for parents that are hosts themselves."""
    left = counts.where(F.col("parent").isin(hosts or rules.HOSTS)).select(F.col("parent").alias("source"), F.col("host").alias("destination"), "entity_count")
    out = left.join(outward.select(F.col("host").alias("source"), F.col("parent").alias("destination"), "fdi_usd_mn"), ["source", "destination"])
    return out.withColumn("fdi_usd_bn", F.col("fdi_usd_mn") / 1000).withColumn("outward_lei_density", F.col("entity_count") / F.col("fdi_usd_bn"))


def outward_source_summary(bilateral: DataFrame) -> DataFrame:
    out = bilateral.groupBy(F.col("source").alias("country")).agg(F.count_distinct("destination").alias("destination_count"), F.sum("entity_count").alias("my_owned_or_source_owned_leis"), F.sum("fdi_usd_mn").alias("outward_fdi_usd_mn"))
    return out.withColumn("outward_fdi_usd_bn", F.col("outward_fdi_usd_mn") / 1000).withColumn("asean_outward_lei_density", F.col("my_owned_or_source_owned_leis") / F.col("outward_fdi_usd_bn"))


def entities_per_10bn(counts: DataFrame, inward: DataFrame, floor: float = rules.POOLED_FLOOR) -> DataFrame:
    """Entities per ten billion dollars by parent economy, hosts pooled; economies of at least floor million."""
    out = counts.join(inward, ["host", "parent"]).groupBy("parent").agg(F.sum("entity_count").alias("total_entities"), F.sum("fdi_usd_mn").alias("total_fdi_usd_mn"), F.count_distinct("host").alias("n_hosts"))
    return out.where(F.col("total_fdi_usd_mn") >= floor).withColumn("fdi_usd_bn", F.col("total_fdi_usd_mn") / 1000).withColumn("entities_per_10bn", F.round(F.col("total_entities") / F.col("fdi_usd_bn") * 10, 1)).orderBy(F.desc("total_fdi_usd_mn"))


def average_rank(group: list[str], value: str) -> Column:
    """Rank with ties at their mean."""
    same = W.partitionBy(*group, value)
    return F.rank().over(W.partitionBy(*group).orderBy(value)) + (F.count("*").over(same) - 1) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta function at df / (df + t^2)."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a rank correlation over n pairs; null below three."""
    return pd.Series([None if r is None or math.isnan(r) or k < 3 else 0.0 if abs(r) >= 1 else t_tail(r * math.sqrt((k - 2) / (1 - r * r)), k - 2) for r, k in zip(rho, n)], dtype="float64")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("")


def spearman_by_host(counts: DataFrame, inward: DataFrame, min_pairs: int = 3, with_p: bool = True) -> DataFrame:
    """host (and ALL for the pool), n_pairs, rho and, with_p, p_value and stars. Hosts below min_pairs are left out, the pool never is."""
    pairs = counts.join(inward, ["host", "parent"]).select("host", F.col("entity_count").cast("double").alias("x"), F.col("fdi_usd_mn").cast("double").alias("y"))
    both = pairs.select("host", "x", "y").unionByName(pairs.select(F.lit("ALL").alias("host"), "x", "y"))
    ranked = both.withColumns({"rx": average_rank(["host"], "x"), "ry": average_rank(["host"], "y")})
    out = ranked.groupBy("host").agg(F.count("*").alias("n_pairs"), F.corr("rx", "ry").alias("rho")).where((F.col("n_pairs") >= min_pairs) | (F.col("host") == "ALL"))
    if not with_p:
        return out
    return out.withColumn("p_value", spearman_p("rho", "n_pairs")).withColumn("stars", stars(F.col("p_value")))
