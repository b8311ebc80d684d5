"""Shared registered addresses: clusters, and parents inferred from cluster members that have one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.dedupe import first_by
from tessera.functions.schemas import ADDRESS_INFERRED, CLUSTER, ORDINAL
from tessera.functions.text import address_key, contains_any
from tessera.operators.components import cut_lineage


def cluster_by_address(addresses: DataFrame, min_size: int = 3, country: str = "MY") -> DataFrame:
    """CLUSTER columns of entities whose address key at least min_size rows share; ids from 0 by falling size, then key.

    Sizes and ids come from one row a key; a key's rows are never gathered. Keys are made once for each distinct address, after a shuffle: a
    small file of many addresses is one scan task, which should not do that work.
    """
    cfg = rules.country_rules(country)
    counted = addresses.groupBy(F.col("address_line1").alias("_line"), F.col("postal_code").alias("_code")).agg(F.count("*").alias("_rows"))
    keys = counted.withColumn("cluster_address_key", address_key("_line", "_code", cfg.abbreviations or rules.DEFAULT_ABBREVIATIONS))
    # Read twice below, and again by each use of the clusters. Empty keys go after that: their filter would be made part of the scan.
    keys = cut_lineage(keys, "address-keys")[0].where("cluster_address_key <> ''")
    sizes = keys.groupBy("cluster_address_key").agg(F.sum("_rows").alias("cluster_size")).where(F.col("cluster_size") >= min_size)
    # An id is the number of clusters of greater size, and the rank among those of its own: distinct sizes are few, so no task sees all clusters.
    per_size = sizes.groupBy("cluster_size").agg(F.count("*").alias("n"))
    larger = F.coalesce(F.sum("n").over(W.orderBy(F.desc("cluster_size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy("cluster_size").orderBy("cluster_address_key")) - 1
    ids = sizes.withColumn("rank", rank).join(per_size.select("cluster_size", larger.alias("larger")), "cluster_size").select("cluster_address_key", "cluster_size", (F.col("larger") + F.col("rank")).cast("long").alias("address_cluster_id"))
    office = contains_any(F.upper("cluster_address_key"), cfg.office_markers or rules.DEFAULT_OFFICES)
    placed = keys.join(ids, "cluster_address_key").withColumn("is_office_hotel", office)
    at = F.col("address_line1").eqNullSafe(F.col("_line")) & F.col("postal_code").eqNullSafe(F.col("_code"))
    return addresses.join(placed, at).select(*CLUSTER.names)


def cluster_confidence(size: Column, office: Column, anchors: Column) -> tuple[Column, Column]:
    """Confidence and the name of its basis: smaller clusters, several anchors and no office address count for more."""
    base = F.when(size <= 5, 0.70).when(size <= 20, 0.55).when(size <= 100, 0.40).otherwise(0.30)
    name = F.when(size <= 5, "small_shared_address").when(size <= 20, "medium_shared_address").when(size <= 100, "large_registered_address").otherwise("very_large_registered_address")
    c = base - F.when(office, 0.10).otherwise(0.0) + F.when(anchors > 1, F.least(F.lit(0.10), 0.03 * (anchors - 1))).otherwise(0.0)
    basis = F.concat(name, F.when(office, "_office_hotel_discount").otherwise(""), F.when(anchors > 1, "_multi_anchor").otherwise(""))
    return F.round(F.greatest(F.lit(0.20), F.least(c, F.lit(0.80))), 4), basis


def infer_cluster_parents(clusters: DataFrame, relationships: DataFrame) -> DataFrame:
    """ADDRESS_INFERRED of cluster members without a parent, from members with one (anchors).

    A cluster gives one parent: that of its first anchor link, so members join one row a cluster and nothing multiplies. Of an entity's
    clusters the most confident counts, ties by the order of links.
    """
    links = relationships.where("source_lei is not null").select(F.col("source_lei").alias("lei"), F.col("target_lei").alias("inferred_parent_lei"), *([F.col(ORDINAL).alias("_link")] if ORDINAL in relationships.columns else []))
    known = links.select("lei").distinct()
    members = clusters.select("address_cluster_id", "lei").distinct()
    anchored = members.join(links, "lei")
    first = first_by(anchored, "address_cluster_id", *([F.col("_link")] if "_link" in links.columns else [])).drop("lei")
    counts = anchored.groupBy("address_cluster_id").agg(F.count_distinct("lei").alias("anchors"))
    shape = clusters.groupBy("address_cluster_id").agg(F.max("cluster_size").alias("cluster_size"), F.coalesce(F.max("is_office_hotel"), F.lit(False)).alias("is_office_hotel"))
    given = first.join(counts, "address_cluster_id").join(shape, "address_cluster_id")
    confidence, basis = cluster_confidence(F.col("cluster_size"), F.col("is_office_hotel"), F.col("anchors"))
    out = members.join(known, "lei", "left_anti").join(given, "address_cluster_id").withColumns({"inference_source": F.lit("address_cluster"), "confidence": confidence, "confidence_basis": basis})
    best = first_by(out, "lei", F.col("confidence").desc(), *([F.col("_link")] if "_link" in out.columns else []))
    return best.select(*[F.col(f.name).cast(f.dataType) for f in ADDRESS_INFERRED])


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """One row: entities, clusters, the largest, office-address entities, mean size."""
    return clusters.agg(F.count("*").alias("total_clustered_entities"), F.count_distinct("address_cluster_id").alias("num_clusters"), F.coalesce(F.max("cluster_size"), F.lit(0)).alias("largest_cluster"), F.coalesce(F.sum(F.col("is_office_hotel").cast("int")), F.lit(0)).alias("office_hotel_entities")).withColumn("avg_cluster_size", F.when(F.col("num_clusters") > 0, F.round(F.col("total_clustered_entities") / F.col("num_clusters"), 1)).otherwise(0.0))
