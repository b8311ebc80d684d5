"""Coverage-gap score and the prioritised review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.dedupe import first_by
from tessera.functions.text import contains_any, is_fund_name

FLAGS = [n for n, _ in rules.SCORE_WEIGHTS if n != "size_scaled"] + [n for n, _ in rules.MISSING_WEIGHTS]


def int_flag(value: Column) -> Column:
    """0 for null and for what is no number."""
    return F.coalesce(value.cast("string").try_cast("double").cast("int"), F.lit(0))


def coverage_score(df: DataFrame) -> DataFrame:
    """df with size_scaled, coverage_gap_score, coverage_gap_priority_score and reason_flags; missing inputs count as 0.

    Sizes are scaled by the table's largest: a one-row aggregate beside the rows, not a window over all of them. One size: 0.
    """
    out = df.withColumns({c: (int_flag(F.col(c)) if c in df.columns else F.lit(0)) for c in FLAGS})
    size = F.coalesce(F.col("size_proxy").cast("double"), F.lit(0.0)) if "size_proxy" in df.columns else F.lit(0.0)
    out = out.withColumn("size_proxy", size).withColumn("_log", F.log1p("size_proxy"))
    range_ = out.agg(F.min("_log").alias("_least"), F.max("_log").alias("_most"))
    out = out.crossJoin(F.broadcast(range_)).withColumn("size_scaled", F.when(F.col("_least") == F.col("_most"), 0.0).otherwise(F.col("_log") / F.greatest("_most", F.lit(1.0)))).drop("_log", "_least", "_most")
    score = F.lit(0.0)
    for name, w in rules.SCORE_WEIGHTS:
        score = score + F.lit(w) * F.col(name)
    for name, w in rules.MISSING_WEIGHTS:
        score = score + F.lit(w) * (1 - F.col(name))
    reasons = [F.when(F.col("size_scaled") > rules.LARGE_SIZE, F.lit("large_network_presence"))] + [F.when(F.col(c) == v, F.lit(r)) for c, v, r in rules.REASONS]
    return out.withColumn("coverage_gap_score", score).withColumns({"coverage_gap_priority_score": F.col("coverage_gap_score"), "reason_flags": F.concat_ws(";", *reasons)})


def sorted_scores(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("coverage_gap_score"), "lei")


REVIEW_COLUMNS = """lei legal_name review_priority_score review_reason review_status entity_type review_note coverage_gap_priority_score
reason_flags uie_country uie_source evidence_tier uie_confidence predicted_parent_country prediction_probability confidence_gap
top3_countries top3_probabilities direct_parent_name direct_parent_country ultimate_parent_name ultimate_parent_country
ctos_registered_malaysia ctos_name ctos_match_score ctos_match_method override_reason source_url source_note city size_proxy
has_parent_link has_ultimate_link foreign_parent is_non_consolidating has_exception_filed has_inferred_parent in_address_cluster""".split()
FROM_SCORED = ["lei", "legal_name", "country", "city", "coverage_gap_priority_score", "coverage_gap_score", "reason_flags", "size_proxy", "has_parent_link", "has_ultimate_link", "foreign_parent", "is_non_consolidating", "has_exception_filed", "has_inferred_parent", "in_address_cluster"]
FROM_UIE = ["uie_country", "uie_source", "evidence_tier", "uie_confidence", "is_known_uie", "is_inferred_uie", "direct_parent_name", "direct_parent_country", "ultimate_parent_name", "ultimate_parent_country", "predicted_parent_country", "prediction_probability", "confidence_gap", "top3_countries", "top3_probabilities", "ctos_registered_malaysia", "ctos_name", "ctos_match_score", "ctos_match_method", "override_reason", "source_url", "source_note"]


def entity_type(name: Column, source: Column, existing: Column) -> Column:
    """An existing type, else nominee, fund, manual, bank or operating company, by name and source."""
    n = F.upper(F.coalesce(name, F.lit("")))
    return (
        F.when(F.trim(F.coalesce(existing, F.lit(""))) != "", existing).when(contains_any(n, rules.NOMINEE_MARKERS), "nominee_or_custodian").when(is_fund_name(n), "fund_or_product_vehicle")
        .when(source.eqNullSafe("manual_verified"), "manual_verified_entity").when(n.contains("BANK"), "financial_institution").otherwise("operating_or_holding_company")
    )


def review_targets(scored: DataFrame, uie: DataFrame, statuses: DataFrame | None = None, limit: int | None = rules.REVIEW_LIMIT) -> DataFrame:
    """REVIEW_COLUMNS of the rows with a weak source or a high gap, first things first; limit rows (None: all). The queue is a top-k report."""
    spark = scored.sparkSession
    have = [c for c in FROM_SCORED if c in scored.columns]
    side = [c for c in FROM_UIE if c in uie.columns]
    out = scored.select(*have).join(first_by(uie.select("lei", *side), "lei"), "lei", "left")
    if statuses is None:
        statuses = spark.createDataFrame([], "lei string, review_status string, entity_type string, review_note string")
    wanted = [c for c in ("review_status", "entity_type", "review_note", "_ord") if c in statuses.columns]
    out = out.join(first_by(statuses.select("lei", *wanted), "lei"), "lei", "left")
    for c in {"review_status", "entity_type", "review_note", *FROM_UIE, *FROM_SCORED} - set(out.columns):
        out = out.withColumn(c, F.lit(None).cast("double" if c in ("coverage_gap_priority_score", "coverage_gap_score", "size_proxy") else "string"))
    num = lambda c: F.col(c).cast("string").try_cast("double")
    base = F.coalesce(num("coverage_gap_priority_score") if "coverage_gap_priority_score" in scored.columns else num("coverage_gap_score"), F.lit(0.0))
    penalty = F.coalesce(F.create_map(*[F.lit(x) for p in rules.SOURCE_PENALTY.items() for x in p])[F.coalesce("uie_source", F.lit(""))], F.lit(rules.OTHER_PENALTY))
    bonus = F.least(F.greatest(F.coalesce(num("ctos_registered_malaysia"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * rules.REGISTRY_BONUS
    out = out.withColumn("entity_type", entity_type(F.col("legal_name"), F.col("uie_source"), F.col("entity_type")))
    fund, nominee = F.col("entity_type") == "fund_or_product_vehicle", F.col("entity_type") == "nominee_or_custodian"
    raw = base + penalty + bonus - fund.cast("double") * rules.FUND_DISCOUNT - nominee.cast("double") * rules.NOMINEE_DISCOUNT
    reason = F.when(fund, "fund_product_vehicle_rule_applied").when(nominee, "nominee_or_custodian_rule_applied")
    for s, r in rules.SOURCE_REASONS.items():
        reason = reason.when(F.col("uie_source") == s, r)
    high = num("coverage_gap_priority_score") >= rules.HIGH_GAP
    reason = reason.when(F.col("uie_source").isNull(), rules.SOURCE_REASONS["unassigned"]).when(high, "known_uie_but_high_coverage_gap").otherwise("lower_priority_known_uie")
    status = (
        F.when(F.trim(F.coalesce("review_status", F.lit(""))) != "", F.col("review_status")).when(F.col("uie_source").eqNullSafe("manual_verified"), "verified")
        .when(fund, "product_vehicle_rule_applied").when(nominee, "nominee_or_custodian_rule_applied").otherwise("todo")
    )
    out = out.withColumns({"review_priority_score": F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4), "review_reason": reason, "review_status": status, "_bucket": (fund | nominee).cast("int")})
    out = out.where(F.coalesce(F.col("uie_source").isin(rules.WEAK_SOURCES), F.lit(False)) | F.coalesce(high, F.lit(False)))
    out = out.orderBy("_bucket", F.desc("review_priority_score"), F.desc_nulls_last("coverage_gap_priority_score"), F.asc_nulls_last("legal_name"), "lei").select(*REVIEW_COLUMNS)
    return out if limit is None else out.limit(limit)


def split_vehicles(targets: DataFrame, limit: int = rules.REVIEW_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(main queue of at most limit rows, product vehicles) of an unlimited queue."""
    fund = F.col("entity_type").eqNullSafe("fund_or_product_vehicle")
    return targets.where(~fund).limit(limit), targets.where(fund)


def search_benchmark(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each target with its full-text candidates by trimmed name, or one row flagged no_candidate."""
    named = targets.withColumn("gleif_search_query", F.trim(F.coalesce("legal_name", F.lit(""))))
    c = candidates.select(F.col("query").alias("_query"), *[F.col(x).alias(f"_{x}") for x in ("rank", "lei", "legal_name", "country_legal", "country_hq", "total_results")], F.lit(True).alias("_found"))
    joined = named.join(c, F.col("gleif_search_query") == F.col("_query"), "left")
    flag = (
        F.when(F.col("_found").isNull(), "no_candidate").when((F.coalesce("_lei", F.lit("")) != "") & (F.col("_lei") == F.col("lei")), "self_entity_found")
        .when(F.coalesce(F.col("uie_country") != F.col("_country_legal"), F.lit(False)), "candidate_country_differs_from_current_uie").otherwise("candidate_for_review")
    )
    return joined.select(
        "lei", "legal_name", "review_priority_score", "review_status", "entity_type", F.col("uie_country").alias("current_uie_country"), F.col("uie_source").alias("current_uie_source"),
        F.col("_lei").alias("gleif_candidate_lei"), F.col("_legal_name").alias("gleif_candidate_name"), F.col("_country_legal").alias("gleif_candidate_country"), F.col("_country_hq").alias("gleif_candidate_hq_country"),
        F.col("_rank").cast("int").alias("gleif_candidate_rank"), F.coalesce(F.col("_total_results").cast("int"), F.lit(0)).alias("gleif_total_results"), "gleif_search_query", F.lit("fulltext").alias("gleif_match_method"), flag.alias("review_flag"),
    )
