"""The evidence ladder: one ultimate investor economy for each domestic entity, from the first rung that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.dedupe import first_by
from tessera.functions.schemas import ENTITY, EXCEPTION, NAME_MATCH, ORDINAL, OVERRIDE, PREDICTION, REGISTRY_MATCH, RELATIONSHIP, conform, empty

COLUMNS = """host_country lei legal_name entity_country direct_parent_lei direct_parent_name direct_parent_country ultimate_parent_lei
ultimate_parent_name ultimate_parent_country chain_parent_lei chain_parent_name chain_parent_country chain_parent_relationship_type uie_lei
uie_name uie_country uie_source evidence_tier uie_confidence is_known_uie is_inferred_uie is_non_consolidating exception_reason
matched_parent_lei matched_parent_name matched_parent_country brand_token match_score inferred_parent_lei address_parent_name
address_parent_country confidence predicted_parent_country prediction_probability confidence_gap top3_countries top3_probabilities
ctos_registered_malaysia ctos_name ctos_registration_no ctos_match_score ctos_match_method ctos_url override_reason source_url source_note""".split()


def first_relationships(rels: DataFrame, kind: str) -> DataFrame:
    """lei, <kind>_lei: the first row of each source."""
    rows = rels.where((F.col("relationship_type") == kind) & F.col("source_lei").isNotNull() & F.col("target_lei").isNotNull())
    return first_by(rows.select(F.col("source_lei").alias("lei"), F.col("target_lei").alias(f"{kind}_lei"), *_ordinal(rows)), "lei")


def _ordinal(df: DataFrame) -> list[str]:
    return [ORDINAL] if ORDINAL in df.columns else []


def preferred_upstream(rels: DataFrame) -> DataFrame:
    """direct_parent_lei, chain_parent_lei, chain_parent_relationship_type: of each source, its ultimate parent before its direct one."""
    rows = rels.where(F.col("relationship_type").isin("ultimate_parent", "direct_parent") & F.col("source_lei").isNotNull() & F.col("target_lei").isNotNull())
    named = rows.select(F.col("source_lei").alias("direct_parent_lei"), F.col("target_lei").alias("chain_parent_lei"), F.col("relationship_type").alias("chain_parent_relationship_type"), *_ordinal(rows))
    return first_by(named, "direct_parent_lei", F.when(F.col("chain_parent_relationship_type") == "ultimate_parent", 0).otherwise(1))


def combine_entities(*tables: DataFrame) -> DataFrame:
    """All tables' entities, the first row of each lei in the order of the tables; rows without lei go."""
    out = None
    for i, t in enumerate(tables):
        t = conform(t, ENTITY).withColumn("_table", F.lit(i))
        t = t if ORDINAL in t.columns else t.withColumn(ORDINAL, F.lit(0).cast("long"))
        out = t if out is None else out.unionByName(t)
    return first_by(out.where("lei is not null"), "lei", F.col("_table")).drop("_table")


def domestic_scope(entities: DataFrame, host: str) -> DataFrame:
    """Entities of the host country; all of them if there is none."""
    own = entities.where(F.col("country_legal") == host)
    return entities if own.isEmpty() else own


def build_uie_assignments(
    domestic: DataFrame, relationships: DataFrame, entities: DataFrame, *, country: str = "MY", chain_relationships: DataFrame | None = None,
    exceptions: DataFrame | None = None, name_matches: DataFrame | None = None, address_inferred: DataFrame | None = None,
    jurisdiction_predictions: DataFrame | None = None, registry_matches: DataFrame | None = None, overrides: DataFrame | None = None, host_scope: bool = True,
) -> DataFrame:
    """COLUMNS for each domestic entity. Every joined table has one row a key first, so no join adds rows; Spark picks how to join by size.

    Parents' names join each kind of evidence before it meets the entities, so the wide table stays dealt by lei throughout.
    """
    spark = domestic.sparkSession
    host = country.upper()
    rels = conform(relationships, RELATIONSHIP)
    chain = conform(chain_relationships, RELATIONSHIP) if chain_relationships is not None else rels
    own = conform(domestic, ENTITY)
    out = (domestic_scope(own, host) if host_scope else own).select(F.lit(host).alias("host_country"), "lei", "legal_name", F.col("country_legal").alias("entity_country"))
    known = conform(entities, ENTITY).where("lei is not null")
    lookup = first_by(known.select("lei", "legal_name", "country_legal", *_ordinal(known)), "lei")

    def named(df: DataFrame, key: str, prefix: str) -> DataFrame:
        return df.join(lookup.select(F.col("lei").alias(key), F.col("legal_name").alias(f"{prefix}_name"), F.col("country_legal").alias(f"{prefix}_country")), key, "left")

    direct = first_relationships(rels, "direct_parent")
    climbed = direct.join(preferred_upstream(chain), "direct_parent_lei").drop("direct_parent_lei")
    for side, prefix in ((direct, "direct_parent"), (first_relationships(rels, "ultimate_parent"), "ultimate_parent"), (climbed, "chain_parent")):
        out = out.join(named(side, f"{prefix}_lei", prefix), "lei", "left")
    circular = F.coalesce(F.col("chain_parent_lei").isin(F.col("direct_parent_lei"), F.col("lei")), F.lit(False))
    out = out.withColumns({c: F.when(~circular, F.col(c)) for c in ("chain_parent_name", "chain_parent_country", "chain_parent_relationship_type")}).withColumn("chain_parent_lei", F.when(~circular, F.col("chain_parent_lei")))

    exc = conform(exceptions, EXCEPTION) if exceptions is not None else empty(spark, EXCEPTION)
    out = out.join(first_by(exc.select("lei", "exception_reason", *_ordinal(exc)), "lei"), "lei", "left")
    out = out.withColumn("is_non_consolidating", F.coalesce((F.col("exception_reason") == "NON_CONSOLIDATING").cast("int"), F.lit(0)))
    names = conform(name_matches, NAME_MATCH) if name_matches is not None else empty(spark, NAME_MATCH)
    names = first_by(names.select("lei", "matched_parent_lei", "brand_token", "match_score", *_ordinal(names)), "lei", F.col("match_score").desc_nulls_last())
    out = out.join(named(names, "matched_parent_lei", "matched_parent"), "lei", "left")
    if address_inferred is not None:
        addr = first_by(address_inferred.select("lei", "inferred_parent_lei", "confidence", *_ordinal(address_inferred)), "lei", F.col("confidence").desc_nulls_last())
    else:
        addr = spark.createDataFrame([], "lei string, inferred_parent_lei string, confidence double")
    out = out.join(named(addr, "inferred_parent_lei", "address_parent"), "lei", "left")
    preds = conform(jurisdiction_predictions, PREDICTION) if jurisdiction_predictions is not None else empty(spark, PREDICTION)
    out = out.join(first_by(preds, "lei"), "lei", "left")
    reg = conform(registry_matches, REGISTRY_MATCH) if registry_matches is not None else empty(spark, REGISTRY_MATCH)
    out = out.join(first_by(reg.drop("legal_name"), "lei", F.col("ctos_match_score").desc_nulls_last()), "lei", "left")
    out = out.withColumn("ctos_registered_malaysia", F.coalesce("ctos_registered_malaysia", F.lit(0)))
    over = conform(overrides, OVERRIDE) if overrides is not None else empty(spark, OVERRIDE)
    renamed = over.select("lei", *[F.col(c).alias(f"override_{c}") for c in ("uie_lei", "uie_name", "uie_country", "uie_source", "evidence_tier", "uie_confidence")], "override_reason", "source_url", "source_note", *_ordinal(over))
    out = out.join(first_by(renamed, "lei"), "lei", "left")

    out = out.withColumn("_uie", choose_uie()).select("*", "_uie.*")
    flags = {"is_known_uie": F.col("uie_source").isin(rules.KNOWN_SOURCES).cast("int"), "is_inferred_uie": F.col("uie_source").isin(rules.INFERRED_SOURCES).cast("int")}
    return out.withColumns(flags).select(*COLUMNS)


def choose_uie() -> Column:
    """The first rung that holds, as a struct; a rung holds when its country is known."""

    def pick(lei, name, country, source, tier, confidence) -> Column:
        c = lambda x, t="string": (x if isinstance(x, Column) else F.lit(x)).cast(t)
        return F.struct(c(lei).alias("uie_lei"), c(name).alias("uie_name"), c(country).alias("uie_country"), c(source).alias("uie_source"), c(tier).alias("evidence_tier"), c(confidence, "double").alias("uie_confidence"))

    col = F.col
    upstream = col("chain_parent_relationship_type") == "ultimate_parent"
    score = F.coalesce(col("match_score") / 100, F.lit(0.8))
    rungs = [
        (col("override_uie_country").isNotNull(), pick(col("override_uie_lei"), col("override_uie_name"), col("override_uie_country"), F.coalesce("override_uie_source", F.lit("manual_verified")), F.coalesce("override_evidence_tier", F.lit("A_manual_verified_uie")), F.round(F.coalesce(col("override_uie_confidence").try_cast("double"), F.lit(0.95)), 4))),
        (col("ultimate_parent_country").isNotNull(), pick(col("ultimate_parent_lei"), col("ultimate_parent_name"), col("ultimate_parent_country"), "gleif_ultimate_parent", "A_known_ultimate_parent", 1.0)),
        (col("chain_parent_country").isNotNull(), pick(col("chain_parent_lei"), col("chain_parent_name"), col("chain_parent_country"), F.when(upstream, "gleif_upstream_ultimate_parent").otherwise("gleif_upstream_direct_parent"), F.when(upstream, "A_known_upstream_ultimate_parent").otherwise("B_known_upstream_direct_parent"), F.when(upstream, 0.97).otherwise(0.9))),
        (col("direct_parent_country").isNotNull(), pick(col("direct_parent_lei"), col("direct_parent_name"), col("direct_parent_country"), "gleif_direct_parent", "B_known_direct_parent", 0.85)),
        (col("matched_parent_country").isNotNull(), pick(col("matched_parent_lei"), col("matched_parent_name"), col("matched_parent_country"), "phase1_name_match", F.when(score >= 0.9, "C_name_match_high").otherwise("D_name_match_medium"), F.round(score, 4))),
        (col("address_parent_country").isNotNull(), pick(col("inferred_parent_lei"), col("address_parent_name"), col("address_parent_country"), "phase2_address_cluster", "D_address_cluster", F.round(F.coalesce("confidence", F.lit(0.6)), 4))),
        (col("predicted_parent_country").isNotNull(), pick(None, None, col("predicted_parent_country"), "phase3_jurisdiction_model", "E_model_predicted_jurisdiction", F.round(F.coalesce("prediction_probability", F.lit(0.0)), 4))),
        (col("is_non_consolidating") == 1, pick(None, None, None, "reporting_exception_no_country", "B_subsidiary_signal_no_uie", 0.7)),
    ]
    out = F.when(*rungs[0])
    for r in rungs[1:]:
        out = out.when(*r)
    return out.otherwise(pick(None, None, None, "unassigned", "U_unassigned", 0.0))


def sorted_assignments(uie: DataFrame) -> DataFrame:
    return uie.orderBy(F.asc_nulls_last("evidence_tier"), F.desc_nulls_last("uie_confidence"), F.asc_nulls_last("legal_name"), "lei")


def investor_summary(uie: DataFrame) -> DataFrame:
    """Totals by host and investor economy; rows without an economy are left out. Means are of decimals, so that no order of rows shows."""
    rows = uie.where("uie_country is not null").groupBy("host_country", "uie_country")
    return rows.agg(F.count("lei").alias("total_entities"), F.sum("is_known_uie").alias("known_uie_entities"), F.sum("is_inferred_uie").alias("inferred_uie_entities"), F.round(F.avg(F.col("uie_confidence").cast("decimal(18,4)")), 4).cast("double").alias("avg_confidence")).orderBy(F.desc("total_entities"), "uie_country", "host_country")


def headline_metrics(uie: DataFrame, review: DataFrame) -> DataFrame:
    """One row: domestic entities, those with an economy, known, inferred, and review targets."""
    row = uie.agg(F.count("*").alias("domestic_entities"), F.count("uie_country").alias("assigned_uie"), F.coalesce(F.sum("is_known_uie"), F.lit(0)).alias("known_uie"), F.coalesce(F.sum("is_inferred_uie"), F.lit(0)).alias("inferred_uie"))
    return row.crossJoin(review.agg(F.count("*").alias("review_targets")))


def only(df: DataFrame, **values: list) -> DataFrame:
    """Rows whose columns hold one of the given values; an empty list leaves a column free."""
    for column, wanted in values.items():
        if wanted:
            df = df.where(F.col(column).isin(wanted))
    return df
