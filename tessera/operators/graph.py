"""The ownership digraph: degrees, components, PageRank, pair features, label propagation. All loops are DataFrame jobs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dedupe import first_by
from tessera.functions.schemas import ORDINAL
from tessera.operators.components import component_labels, cut_lineage, drop_table, merged_labels


def edges_of(relationships: DataFrame) -> DataFrame:
    """Distinct (src, dst): a direct and an ultimate link of one pair are one edge. Rows with a missing end are no edges."""
    return relationships.where("source_lei is not null and target_lei is not null").select(F.col("source_lei").alias("src"), F.col("target_lei").alias("dst")).distinct()


def vertices_of(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """All lei of entities and edges; of a repeated entity the last row's attributes, as a later node overwrites an earlier one."""
    wanted = [c for c in ("lei", "legal_name", "country_legal", "city_legal", "category", "legal_form") if c in entities.columns]
    last = first_by(entities.where("lei is not null").select(*wanted, *([ORDINAL] if ORDINAL in entities.columns else [])), "lei", *([F.col(ORDINAL).desc()] if ORDINAL in entities.columns else []))
    ends = edges.select(F.col("src").alias("lei")).union(edges.select("dst")).distinct()
    return ends.join(last, "lei", "full_outer").select("lei", *[F.col(c) for c in wanted if c != "lei"])


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """lei, in_degree, out_degree by one aggregate over both ends of every edge."""
    ends = edges.select(F.col("src").alias("lei"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    counted = ends.groupBy("lei").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return vertices.select("lei").join(counted, "lei", "left").na.fill(0, ["in_degree", "out_degree"])


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """lei, component (its least lei), weakly_connected_component_size."""
    return _sized(vertices, component_labels(edges))


def components_after(vertices: DataFrame, before: DataFrame, added: DataFrame) -> DataFrame:
    """What components gives for all edges, from its result before and the added edges: later phases add inferred links without a fresh start.

    vertices: all lei of the enriched graph, each once; before: lei, component of the graph without the added edges.
    """
    return _sized(vertices, merged_labels(before.select(F.col("lei").alias("node"), "component"), added))


def _sized(vertices: DataFrame, labels: DataFrame) -> DataFrame:
    of = vertices.select("lei").join(labels, F.col("lei") == F.col("node"), "left").select("lei", F.coalesce("component", "lei").alias("component"))
    sizes = of.groupBy("component").agg(F.count("*").alias("weakly_connected_component_size"))
    return of.join(sizes, "component").select("lei", "component", "weakly_connected_component_size")


def pagerank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, cut_every: int = 5) -> DataFrame:
    """lei, pagerank: dangling mass spreads evenly; the result is that of the first step whose L1 change is under nodes * tol.

    Lineage is cut every few steps; the changes of all steps since are added up in that one scan, and the ranks of each are kept till then.
    """
    nodes = vertices.select("lei").distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("pagerank", F.lit(0.0))
    fan = edges.groupBy("src").agg(F.count("*").alias("fan"))
    links, path = cut_lineage(edges.join(fan, "src").select("src", "dst", "fan"), "pagerank-links")
    base, base_path = cut_lineage(nodes.join(fan, nodes["lei"] == fan["src"], "left").select("lei", F.col("fan").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")), "pagerank")
    now, old = base, [base_path]
    kept: list[str] = []
    spark = vertices.sparkSession
    for step in range(1, max_iter + 1):
        loose = now.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        given = links.join(now.select(F.col("lei").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("lei")).agg(F.sum(F.col("rank") / F.col("fan")).alias("given"))
        # loose has one row.
        new = now.withColumnRenamed("rank", f"rank{len(kept)}").join(given, "lei", "left").crossJoin(F.broadcast(loose))
        kept.append(f"rank{len(kept)}")
        now = new.select("lei", "dangling", *kept, (alpha * (F.coalesce("given", F.lit(0.0)) + F.col("loose") / n) + (1 - alpha) / n).alias("rank"))
        if step % cut_every == 0 or step == max_iter:
            now, path = cut_lineage(now, "pagerank")
            old.append(path)
            if len(old) > 2:
                drop_table(spark, old.pop(0))
            after = [*kept[1:], "rank"]
            if tol:
                changes = now.agg(*[F.sum(F.abs(F.col(b) - F.col(a))) for a, b in zip(kept, after)]).first()
                if settled := [b for b, x in zip(after, changes) if x < n * tol]:
                    return now.select("lei", F.col(settled[0]).alias("pagerank"))
            now, kept = now.select("lei", "dangling", "rank"), []
    return now.select("lei", F.col("rank").alias("pagerank"))


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) both ways, each once."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).distinct()


def degree_centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """lei, degree_centrality: undirected degree over nodes - 1 (a self-loop counts twice; a single node has 1)."""
    both = undirected(edges).groupBy("u").agg(F.sum(F.when(F.col("u") == F.col("v"), 2).otherwise(1)).alias("d"))
    # One row, so the cross join adds a constant.
    n = vertices.agg(F.count("*").alias("n"))
    joined = vertices.select("lei").join(both, F.col("lei") == F.col("u"), "left").crossJoin(F.broadcast(n))
    return joined.select("lei", F.when(F.col("n") == 1, 1.0).otherwise(F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).alias("degree_centrality"))


def graph_summary(entities: DataFrame, relationships: DataFrame, *, ranks: bool = True, pagerank_iterations: int = 100, tol: float = 1e-6) -> DataFrame:
    """One row for each node: attributes, degrees, component size and, with ranks, PageRank and degree centrality."""
    edges = edges_of(relationships)
    nodes = vertices_of(entities, edges)
    out = nodes.join(degrees(nodes, edges), "lei").join(components(nodes, edges).drop("component"), "lei")
    if ranks:
        out = out.join(pagerank(nodes, edges, max_iter=pagerank_iterations, tol=tol), "lei").join(degree_centrality(nodes, edges), "lei")
    return out


def sorted_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("weakly_connected_component_size"), F.desc("in_degree"), F.desc("out_degree"), "lei")


def size_proxy(summary: DataFrame) -> DataFrame:
    """size_proxy: degrees + component size + 1000 PageRank + 100 centrality; missing columns and nulls take their defaults."""
    defaults = {"in_degree": 0, "out_degree": 0, "weakly_connected_component_size": 1, "pagerank": 0.0, "degree_centrality": 0.0}
    out = summary.withColumns({c: F.coalesce(c, F.lit(v)) if c in summary.columns else F.lit(v) for c, v in defaults.items()})
    c = lambda x: F.col(x).cast("double")
    return out.withColumn("size_proxy", c("in_degree") + c("out_degree") + c("weakly_connected_component_size") + c("pagerank") * 1000 + c("degree_centrality") * 100)


def parent_flags(relationships: DataFrame) -> DataFrame:
    """lei, has_parent_link, has_ultimate_link for every source with either kind of link."""
    kind = F.col("relationship_type")
    rows = relationships.where(kind.isin("direct_parent", "ultimate_parent") & F.col("source_lei").isNotNull())
    return rows.groupBy(F.col("source_lei").alias("lei")).agg(F.max((kind == "direct_parent").cast("int")).alias("has_parent_link"), F.max((kind == "ultimate_parent").cast("int")).alias("has_ultimate_link"))


def foreign_parents(relationships: DataFrame, entities: DataFrame, country: str = "MY") -> DataFrame:
    """lei, foreign_parent=1 of sources with a direct or ultimate parent in a known other country."""
    where = first_by(entities.where("lei is not null").select(F.col("lei").alias("target_lei"), F.col("country_legal").alias("target_country"), *([ORDINAL] if ORDINAL in entities.columns else [])), "target_lei")
    rows = relationships.where(F.col("relationship_type").isin("direct_parent", "ultimate_parent")).select("source_lei", "target_lei").join(where, "target_lei")
    return rows.where(F.col("target_country") != country).select(F.col("source_lei").alias("lei")).distinct().withColumn("foreign_parent", F.lit(1))


def readiness(entities: DataFrame, relationships: DataFrame, all_entities: DataFrame | None = None, min_edges: int = 50, min_labeled_ratio: float = 0.05, min_parents: int = 10, parts: DataFrame | None = None) -> DataFrame:
    """One row: whether the graph is dense enough for link prediction, and why. parts: the graph's components, where they are known."""
    edges = edges_of(relationships)
    nodes = vertices_of(entities if all_entities is None else all_entities, edges)
    parts = components(nodes, edges) if parts is None else parts
    own = entities.where("lei is not null").select("lei").distinct()
    labeled = relationships.where("source_lei is not null").select(F.col("source_lei").alias("lei")).distinct().join(own, "lei", "left_semi")
    parents = relationships.where("target_lei is not null").select(F.col("target_lei").alias("lei")).distinct().join(own, "lei", "left_anti")
    one = nodes.agg(F.count("*").alias("n_nodes"))
    for df in (edges.agg(F.count("*").alias("n_edges")), own.agg(F.count("*").alias("n_domestic_entities")), labeled.agg(F.count("*").alias("n_labeled_entities")), parents.agg(F.count("*").alias("n_parent_nodes")), parts.agg(F.count_distinct("component").alias("n_components"), F.coalesce(F.max("weakly_connected_component_size"), F.lit(0)).alias("largest_component"))):
        one = one.crossJoin(df)
    share = F.col("n_labeled_entities") / F.greatest("n_domestic_entities", F.lit(1))
    density = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)
    out = one.withColumn("ready", (F.col("n_edges") >= min_edges) & (share >= min_labeled_ratio) & (F.col("n_parent_nodes") >= min_parents))
    return out.withColumns({"density": F.round(density, 6), "labeled_ratio": F.round(share, 4), "min_edges_threshold": F.lit(min_edges), "min_labeled_ratio_threshold": F.lit(min_labeled_ratio), "min_parent_nodes_threshold": F.lit(min_parents)})


PAIR_FEATURES = ["jaccard_coefficient", "adamic_adar", "preferential_attachment", "common_neighbors", "same_component", "source_out_degree", "target_in_degree", "source_pagerank", "target_pagerank", "source_component_size", "target_component_size"]


def pair_features(pairs: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    """PAIR_FEATURES of each distinct (source_lei, target_lei).

    stats: lei, in_degree, out_degree, component, weakly_connected_component_size, pagerank. Common neighbours come from a join of the
    pairs' own neighbour rows, never from all pairs of a neighbour. A node outside the graph has degree and rank 0, component size 1.
    A neighbour of degree one has no Adamic-Adar weight: the value of such a pair is 0 as a whole.
    """
    around = undirected(edges)
    size = around.groupBy("u").agg(F.sum(F.when(F.col("u") == F.col("v"), 2).otherwise(1)).alias("degree"), F.count("*").alias("neighbours"))
    pairs = pairs.select("source_lei", "target_lei").distinct()
    mine = pairs.join(around.select(F.col("u").alias("source_lei"), F.col("v").alias("w")), "source_lei")
    shared = mine.join(around.select(F.col("u").alias("target_lei"), F.col("v").alias("w")), ["target_lei", "w"]).where((F.col("w") != F.col("source_lei")) & (F.col("w") != F.col("target_lei")))
    weighed = shared.join(size.select(F.col("u").alias("w"), F.col("degree")), "w")
    common = weighed.groupBy("source_lei", "target_lei").agg(F.count("*").alias("common"), F.when(F.min("degree") <= 1, 0.0).otherwise(F.sum(F.when(F.col("degree") > 1, 1 / F.log(F.col("degree"))))).alias("aa"))
    # The union's size needs all shared neighbours, the two ends too.
    every = mine.join(around.select(F.col("u").alias("target_lei"), F.col("v").alias("w")), ["target_lei", "w"]).groupBy("source_lei", "target_lei").agg(F.count("*").alias("meet"))

    def side(prefix: str) -> DataFrame:
        key = f"{prefix}_lei"
        s = stats.select(F.col("lei").alias(key), F.col("out_degree").alias(f"{prefix}_out"), F.col("in_degree").alias(f"{prefix}_in"), F.col("component").alias(f"{prefix}_component"), F.col("weakly_connected_component_size").alias(f"{prefix}_size"), F.col("pagerank").alias(f"{prefix}_rank"))
        return s.join(size.select(F.col("u").alias(key), F.col("degree").alias(f"{prefix}_degree"), F.col("neighbours").alias(f"{prefix}_n")), key, "left")

    zero = lambda c: F.coalesce(c, F.lit(0))
    all_ = pairs.join(side("source"), "source_lei", "left").join(side("target"), "target_lei", "left").join(common, ["source_lei", "target_lei"], "left").join(every, ["source_lei", "target_lei"], "left")
    union = zero("source_n") + zero("target_n") - zero("meet")
    return all_.select(
        "source_lei", "target_lei", F.when(union > 0, zero("common") / union).otherwise(0.0).alias("jaccard_coefficient"), F.coalesce("aa", F.lit(0.0)).alias("adamic_adar"),
        (zero("source_degree") * zero("target_degree")).cast("double").alias("preferential_attachment"), zero("common").alias("common_neighbors"),
        F.coalesce((F.col("source_component") == F.col("target_component")).cast("int"), F.lit(0)).alias("same_component"),
        zero("source_out").alias("source_out_degree"), zero("target_in").alias("target_in_degree"), F.coalesce("source_rank", F.lit(0.0)).alias("source_pagerank"), F.coalesce("target_rank", F.lit(0.0)).alias("target_pagerank"),
        F.coalesce("source_size", F.lit(1)).alias("source_component_size"), F.coalesce("target_size", F.lit(1)).alias("target_component_size"),
    )


def pair_stats(vertices: DataFrame, edges: DataFrame, **ranks) -> DataFrame:
    """The node columns that pair_features reads, computed once."""
    return degrees(vertices, edges).join(components(vertices, edges), "lei").join(pagerank(vertices, edges, **ranks), "lei")


def propagate_labels(vertices: DataFrame, edges: DataFrame, labels: DataFrame, max_hops: int | None = None, parts: DataFrame | None = None) -> DataFrame:
    """lei, propagated_country, confidence, hops of unlabeled nodes that a labeled one (lei, label) reaches.

    The nearest label wins, ties to the least label. Confidence is that label's share of the component's labels over 1 + hops. A search
    from all labels at once: a neighbour of a node at some distance is one nearer, as far, or one farther, so each step joins the last nodes
    found with the edges and compares with the last two steps' nodes alone. It ends where no node is left to reach, or after max_hops.
    parts: the graph's components, where they are known.
    """
    spark = vertices.sparkSession
    around, around_path = cut_lineage(undirected(edges).where("u <> v"), "propagation-edges")
    known = labels.join(vertices.select("lei"), "lei", "left_semi").select("lei", "label").distinct()
    last, path = cut_lineage(known.groupBy("lei").agg(F.min("label").alias("label")).withColumn("hops", F.lit(0)), "propagation")
    seen, steps, before = last, [path], None
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        near = last.join(around, F.col("lei") == F.col("u")).groupBy(F.col("v").alias("lei")).agg(F.min("label").alias("label"))
        for old in (last, before):
            near = near if old is None else near.join(old.select("lei"), "lei", "left_anti")
        new, path = cut_lineage(near.withColumn("hops", F.lit(hop)), "propagation")
        steps.append(path)
        if new.isEmpty():
            break
        seen, before, last = seen.unionByName(new), last, new
        if hop % 20 == 0:  # so that a plan never reads more than some twenty tables
            seen, path = cut_lineage(seen, "propagation")
            for gone in steps[:-2]:
                drop_table(spark, gone)
            steps = [*steps[-2:], path]
    seen, _ = cut_lineage(seen, "propagated")
    for gone in (*steps, around_path):
        drop_table(spark, gone)
    parts = (components(vertices, edges) if parts is None else parts).select("lei", "component")
    votes = known.groupBy("lei").agg(F.min("label").alias("label")).join(parts, "lei").groupBy("component", "label").agg(F.count("*").alias("n"))
    total = votes.withColumn("of", F.sum("n").over(W.partitionBy("component")))
    out = seen.where("hops > 0").join(parts, "lei").join(total, ["component", "label"])
    return out.select("lei", F.col("label").alias("propagated_country"), F.round(F.col("n") / F.col("of") * (1 / (1 + F.col("hops"))), 4).alias("confidence"), "hops")
