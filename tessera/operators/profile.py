"""Entity profiles: counts, shares and timelines of an entity table, and of countries side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dedupe import first_by
from tessera.functions.text import title_case


def share(part: Column, whole: Column) -> Column:
    """Per cent to one place; 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole * 100, 1)).otherwise(0.0)


def discovery_summary(df: DataFrame) -> DataFrame:
    """One row of totals, distinct values and first and last registration (as text)."""
    distinct = {"countries_legal": "country_legal", "countries_hq": "country_hq", "cities_legal": "city_legal", "categories": "category", "legal_forms": "legal_form"}
    row = df.agg(F.count("*").alias("total_records"), F.count_distinct("lei").alias("unique_leis"), F.count_if(F.col("entity_status") == "ACTIVE").alias("active_entities"), *[F.count_distinct(c).alias(n) for n, c in distinct.items()], F.min("registered_at").alias("earliest_registration"), F.max("registered_at").alias("latest_registration"))
    return row.withColumns({"duplicates_removed": F.col("total_records") - F.col("unique_leis"), "inactive_entities": F.col("total_records") - F.col("active_entities")})


def _counted(df: DataFrame, keys: list[str], top_n: int | None) -> DataFrame:
    """keys, count, pct of all rows; the largest groups, ties by key. The whole is a one-row table beside the groups."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("count")).crossJoin(F.broadcast(df.agg(F.count("*").alias("_all"))))
    out = groups.orderBy(F.desc("count"), *[F.asc_nulls_last(k) for k in keys])
    out = out if top_n is None else out.limit(top_n)
    return out.select(*keys, "count", share(F.col("count"), F.col("_all")).alias("pct"))


def geographic_concentration(df: DataFrame, top_n: int | None = 20) -> DataFrame:
    """Largest cities by legal address in title case; a missing city or country is a group of its own."""
    return _counted(df.select(title_case(F.trim("city_legal")).alias("city_legal"), "country_legal"), ["city_legal", "country_legal"], top_n)


def hq_mismatch(df: DataFrame) -> DataFrame:
    return df.where("country_legal is not null and country_hq is not null and country_legal <> country_hq").select("lei", "legal_name", "country_legal", "country_hq")


def distribution(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """Values of a column (null: UNKNOWN) with counts and shares."""
    return _counted(df.select(F.coalesce(column, F.lit("UNKNOWN")).alias(column)), [column], top_n)


def registration_timeline(df: DataFrame) -> DataFrame:
    """Registrations a year, oldest first; what is no date is left out."""
    years = df.select(F.year(F.try_to_timestamp("registered_at")).cast("string").alias("period")).where("period is not null")
    return years.groupBy("period").agg(F.count("*").alias("count")).orderBy("period")


def country_profiles(df: DataFrame, key: str = "country_legal") -> DataFrame:
    """One row a country, most entities first: one aggregate for the measures, one for the largest city."""
    base = df.select(F.col(key).alias("country"), "lei", "entity_status", "city_legal", "legal_form", "category", "country_legal", "country_hq")
    mismatch = F.col("country_legal").isNotNull() & F.col("country_hq").isNotNull() & (F.col("country_legal") != F.col("country_hq"))
    kind = F.coalesce("category", F.lit("UNKNOWN"))
    n = F.col("total_entities")
    sums = base.groupBy("country").agg(F.count("*").alias("total_entities"), F.count_if(F.col("entity_status") == "ACTIVE").alias("_active"), F.count_distinct("city_legal").alias("n_cities"), F.count_distinct("legal_form").alias("n_legal_forms"), F.count_if(mismatch).alias("hq_mismatch_count"), *[F.count_if(kind == k).alias(f"_{k}") for k in ("GENERAL", "FUND", "BRANCH", "SOLE_PROPRIETOR")])
    cities = base.select("country", title_case(F.trim("city_legal")).alias("top_city"), "country_legal").groupBy("country", "top_city", "country_legal").agg(F.count("*").alias("_n"))
    rank = F.row_number().over(W.partitionBy("country").orderBy(F.desc("_n"), F.asc_nulls_last("top_city"), F.asc_nulls_last("country_legal")))
    top = cities.withColumn("_k", rank).where(F.col("_k") == 1).select("country", "top_city", "_n")
    out = sums.join(top, sums["country"].eqNullSafe(top["country"]), "left").drop(top["country"])
    return out.select(
        "country", "total_entities", share(F.col("_active"), n).alias("active_pct"), "n_cities", "top_city", share(F.col("_n"), n).alias("top_city_concentration_pct"), "n_legal_forms", "hq_mismatch_count",
        share(F.col("hq_mismatch_count"), n).alias("hq_mismatch_pct"), *[share(F.col(f"_{k}"), n).alias(f"pct_{k.lower()}") for k in ("GENERAL", "FUND", "BRANCH", "SOLE_PROPRIETOR")],
    ).orderBy(F.desc("total_entities"), "country")


def structural_report(df: DataFrame, country: str = "MY") -> dict[str, DataFrame]:
    """All parts as lazy tables."""
    return {
        "discovery": discovery_summary(df), "geographic_concentration": geographic_concentration(df), "hq_vs_legal_mismatch": hq_mismatch(df), "legal_form_distribution": distribution(df, "legal_form", 20),
        "category_distribution": distribution(df, "category"), "entity_status_distribution": distribution(df, "entity_status"), "registration_timeline": registration_timeline(df), "profile": country_profiles(df.withColumn("_code", F.lit(country)), "_code"),
    }


def with_exception_flags(entities: DataFrame, exceptions: DataFrame) -> DataFrame:
    """entities with is_non_consolidating and has_exception_filed (0 or 1), by the first exception of each."""
    first = first_by(exceptions.select("lei", "exception_reason", *[c for c in ("_ord",) if c in exceptions.columns]), "lei")
    out = entities.drop("exception_reason").join(first, "lei", "left")
    return out.withColumns({"is_non_consolidating": F.coalesce((F.col("exception_reason") == "NON_CONSOLIDATING").cast("int"), F.lit(0)), "has_exception_filed": F.col("exception_reason").isNotNull().cast("int")}).drop("exception_reason")


def out_degree_histogram(summary: DataFrame, bins: int = 30) -> DataFrame:
    """bin (from 1), n of out-degrees over equal widths from the least to the largest; the largest falls in the last bin."""
    ends = summary.agg(F.min("out_degree").cast("double").alias("lo"), F.max("out_degree").cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("out_degree") - F.col("lo")) / width) + 1, F.lit(bins)))
    return summary.select("out_degree").crossJoin(F.broadcast(ends)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
