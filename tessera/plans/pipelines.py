"""Drivers: the phases end to end over canonical tables, each result a lazy table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dedupe import first_by
from tessera.functions.schemas import RELATIONSHIP, conform
from tessera.operators import clusters, graph, jurisdiction, ladder, links, macro, names, profile, scoring
from tessera.operators.components import cut_lineage


@dataclass
class Inputs:
    """Canonical tables of one host country; optional ones may be None."""

    domestic: DataFrame
    parents: DataFrame
    relationships: DataFrame
    exceptions: DataFrame | None = None
    addresses: DataFrame | None = None
    tickers: DataFrame | None = None
    directory: DataFrame | None = None
    predictions: DataFrame | None = None
    overrides: DataFrame | None = None
    statuses: DataFrame | None = None
    chain: DataFrame | None = None
    country: str = "MY"


def entity_analysis(x: Inputs) -> dict[str, DataFrame]:
    return profile.structural_report(x.domestic, x.country)


def comparative_analysis(x: Inputs) -> DataFrame:
    return profile.country_profiles(x.domestic)


def reporting_exceptions(x: Inputs) -> dict[str, DataFrame]:
    """Entities without relationship rows, and reasons by number."""
    free = x.domestic.select("lei").join(x.relationships.select(F.col("source_lei").alias("lei")).distinct(), "lei", "left_anti")
    return {"to_scan": free, "histogram": x.exceptions.groupBy("exception_reason").agg(F.count("*").alias("n"))}


def name_inference(x: Inputs, threshold: int = 90) -> dict[str, DataFrame]:
    brands = names.brand_tokens(x.parents, x.country)
    matches = names.match_names(x.domestic, brands, x.relationships.select(F.col("source_lei").alias("lei")), threshold, x.country)
    return {"brands": brands, "matches": matches, "edges": names.inferred_edges(matches), "summary": names.match_summary(matches)}


def address_clustering(x: Inputs, min_size: int = 3) -> dict[str, DataFrame]:
    found = clusters.cluster_by_address(x.addresses, min_size, x.country)
    return {"clusters": found, "inferred": clusters.infer_cluster_parents(found, x.relationships), "summary": clusters.cluster_summary(found)}


def jurisdiction_prediction(x: Inputs, matches: DataFrame | None = None, graph_table: DataFrame | None = None, **train) -> dict:
    """Labels, the trained model, predictions for entities without a label."""
    labels = jurisdiction.training_labels(x.relationships, x.parents, matches)
    rows = jurisdiction.features(x.domestic, graph_table, x.exceptions, x.country)
    trained = jurisdiction.train(rows.join(labels.select("lei", "parent_bucket"), "lei"), x.country, **train)
    return {"labels": labels, "model": trained, "predictions": jurisdiction.predict(trained, rows.join(labels.select("lei"), "lei", "left_anti"))}


def model_inputs(x: Inputs, threshold: int = 90) -> tuple[DataFrame, DataFrame]:
    """What the phases before give the country model: name matches, and the graph's columns; written once each."""
    matches, _ = cut_lineage(name_inference(x, threshold)["matches"], "name-matches")
    return matches, cut_lineage(graph.graph_summary(ladder.combine_entities(x.domestic, x.parents), x.relationships), "graph-columns")[0]


def enriched_relationships(x: Inputs, matches: DataFrame | None = None, addresses: DataFrame | None = None) -> DataFrame:
    """Relationships, then inferred links, each (source, target) once. Address links take part only where they are passed."""
    out = conform(x.relationships, RELATIONSHIP).withColumn("_from", F.lit(0)).drop("_ord")
    if matches is not None:
        out = out.unionByName(conform(names.inferred_edges(matches), RELATIONSHIP).withColumn("_from", F.lit(1)))
    if addresses is not None:
        more = addresses.select(F.col("lei").alias("source_lei"), F.col("inferred_parent_lei").alias("target_lei"), F.lit("inferred_address_cluster").alias("relationship_type"))
        out = out.unionByName(conform(more, RELATIONSHIP).withColumn("_from", F.lit(2)))
    return first_by(out, ["source_lei", "target_lei"], F.col("_from")).drop("_from")


def graph_prediction(x: Inputs, matches: DataFrame | None = None, neg_ratio: int = 3, min_probability: float = 0.3, cap: int | None = None, **train) -> dict:
    """Readiness, propagated labels and, if both classes have pairs, links for entities without any."""
    # Written once each: every loop and every fold reads them.
    rels, _ = cut_lineage(enriched_relationships(x, matches), "enriched")
    entities, _ = cut_lineage(ladder.combine_entities(x.domestic, x.parents), "entities")
    edges, _ = cut_lineage(graph.edges_of(rels), "edges")
    nodes, _ = cut_lineage(graph.vertices_of(entities, edges), "nodes")
    # Components of the known links, into which the inferred ones merge.
    known, _ = cut_lineage(graph.edges_of(x.relationships), "known-edges")
    before, _ = cut_lineage(graph.components(graph.vertices_of(entities, known), known).select("lei", "component"), "known-components")
    parts, _ = cut_lineage(graph.components_after(nodes, before, edges.join(known, ["src", "dst"], "left_anti")), "components")
    labels = jurisdiction.training_labels(rels, x.parents).select("lei", F.col("parent_country").alias("label"))
    out = {"readiness": graph.readiness(x.domestic, rels, entities, parts=parts), "propagated": graph.propagate_labels(nodes, edges, labels, parts=parts)}
    pairs, _ = cut_lineage(links.training_pairs(rels, x.domestic, x.parents, neg_ratio), "training-pairs")
    trained = links.train(nodes, edges, pairs, **train)
    out |= {"training_pairs": pairs, "model": trained}
    if trained.model is not None:
        if cap is None:
            scored, _ = cut_lineage(links.predicted(trained, x.domestic, rels, x.parents, nodes, edges, min_probability), "likely-links")
        else:
            scored = links.score_candidates(trained, links.candidates(x.domestic, rels, x.parents, cap), nodes, edges, min_probability)
        out |= {"links": links.ranked(scored), "best": links.best_links(scored, x.parents)}
    return out


def graph_and_scoring(x: Inputs, matches: DataFrame | None = None, inferred: DataFrame | None = None, found: DataFrame | None = None, use_tickers: bool = True, pagerank_iterations: int = 100) -> dict[str, DataFrame]:
    """The main product: scored nodes, assignments, investor economies, review queue and product vehicles."""
    entities = ladder.combine_entities(x.domestic, x.parents)
    summary = graph.graph_summary(entities, x.relationships, pagerank_iterations=pagerank_iterations).withColumnsRenamed({"country_legal": "country", "city_legal": "city"})
    scored = graph.size_proxy(summary.join(graph.parent_flags(x.relationships), "lei", "left").join(graph.foreign_parents(x.relationships, entities, x.country), "lei", "left"))
    if use_tickers and x.tickers is not None:
        scored = names.match_tickers(scored, x.tickers)
    if x.exceptions is not None:
        scored = profile.with_exception_flags(scored, x.exceptions)
    for table, flag in ((matches, "has_inferred_parent"), (found, "in_address_cluster")):
        if table is not None:
            scored = scored.join(table.select("lei").distinct().withColumn(flag, F.lit(1)), "lei", "left")
    scored = scoring.coverage_score(scored)
    registry = names.match_registry(x.domestic, x.directory) if x.directory is not None else None
    uie = ladder.build_uie_assignments(x.domestic, x.relationships, entities, country=x.country, chain_relationships=x.chain, exceptions=x.exceptions, name_matches=matches, address_inferred=inferred, jurisdiction_predictions=x.predictions, registry_matches=registry, overrides=x.overrides)
    queue = scoring.review_targets(scored.join(x.domestic.select("lei"), "lei", "left_semi"), uie, x.statuses, None)
    main, vehicles = scoring.split_vehicles(queue)
    return {"scored": scored, "uie": uie, "investor_summary": ladder.investor_summary(uie), "review": main, "product_vehicles": vehicles}


def full_inference(x: Inputs, threshold: int = 90, min_size: int = 3, trees: int = 200, folds: int | None = None) -> dict:
    """Exceptions, names, addresses, model, graph, in that order; each phase reads what came before. folds: None for each model's own number."""
    out: dict = {"exceptions": reporting_exceptions(x) if x.exceptions is not None else None, "names": name_inference(x, threshold)}
    out["addresses"] = address_clustering(x, min_size) if x.addresses is not None else None
    matches, _ = cut_lineage(out["names"]["matches"], "name-matches")
    out["names"] |= {"matches": matches, "edges": names.inferred_edges(matches), "summary": names.match_summary(matches)}
    entities = ladder.combine_entities(x.domestic, x.parents)
    out["jurisdiction"] = jurisdiction_prediction(x, matches, graph.graph_summary(entities, x.relationships), trees=trees, folds=folds)
    out["jurisdiction"] |= {"summary": jurisdiction.prediction_summary(out["jurisdiction"]["predictions"])}
    out["graph"] = graph_prediction(x, matches, trees=trees, **({} if folds is None else {"folds": folds}))
    if "links" in out["graph"]:
        out["graph"] |= {"summary": links.link_summary(out["graph"]["readiness"], out["graph"]["links"], out["graph"]["propagated"])}
    return out


def macro_validation(uie: DataFrame, inward: DataFrame, outward: DataFrame) -> dict[str, DataFrame]:
    """Densities and rank correlations of assignments against positions."""
    counts, mix = macro.bilateral_counts(uie), macro.uie_mix(uie)
    pairs = macro.outward_bilateral(counts, outward)
    return {"mix": mix, "density": macro.inward_density(mix, inward), "outward": pairs, "outward_summary": macro.outward_source_summary(pairs), "correlation": macro.spearman_by_host(counts, inward), "per_10bn": macro.entities_per_10bn(counts, inward)}


# The offline example's entities and links.
MOCK_ENTITIES = [
    ("A1", "MALAYSIA HOLDINGS BERHAD", "MY", "KUALA LUMPUR", "GENERAL", "BHD"), ("A2", "ASEAN ENERGY SDN BHD", "MY", "KUALA LUMPUR", "GENERAL", "SDN"),
    ("P1", "SINGAPORE PARENT LTD", "SG", "SINGAPORE", "GENERAL", "LTD"), ("P2", "GLOBAL ULTIMATE INC", "US", "NEW YORK", "GENERAL", "INC"), ("A3", "PALM EXPORTS BERHAD", "MY", "SHAH ALAM", "GENERAL", "BHD"),
]
MOCK_LINKS = [("A1", "P1", "direct_parent"), ("A1", "P2", "ultimate_parent"), ("A2", "P1", "direct_parent")]


def mock_pipeline(spark: SparkSession) -> DataFrame:
    """The example scored end to end, with a filing flag on P2 only."""
    entities = spark.createDataFrame([(*e, i) for i, e in enumerate(MOCK_ENTITIES)], "lei string, legal_name string, country_legal string, city_legal string, category string, legal_form string, _ord long")
    rels = spark.createDataFrame([(*r, i) for i, r in enumerate(MOCK_LINKS)], "source_lei string, target_lei string, relationship_type string, _ord long")
    summary = graph.graph_summary(entities, rels)
    flags = summary.join(graph.parent_flags(rels), "lei", "left").join(graph.foreign_parents(rels, entities), "lei", "left")
    return scoring.sorted_scores(scoring.coverage_score(graph.size_proxy(flags).withColumn("appears_in_edgar", (F.col("lei") == "P2").cast("int"))))
