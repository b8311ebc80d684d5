"""The node columns of a graph after links are taken out of it, for many sets of links at once, from those of the whole graph.

Nothing is computed anew where nothing changed. Degrees lose the links' ends. Components are searched only where a link went. PageRank is the
solution of x = alpha P'x + 1, scaled to a sum of one (dangling mass spread evenly only scales it); taking a link out leaves a residual at the
targets of its source alone, which is pushed along the links that are left until it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.components import component_labels, cut_lineage, drop_table

ALPHA, TOLERANCE, MAX_STEPS = 0.85, 1e-12, 250


def _pushed(start: DataFrame, step, keys: list[str], n: int) -> DataFrame:
    """keys and mass: the sum of start (keys, mass) and all that step() makes of it, until what is left is TOLERANCE a node or less."""
    spark = start.sparkSession
    now, path = cut_lineage(start, "push")
    total, old = now, [path]
    for turn in range(1, MAX_STEPS + 1):
        now, path = cut_lineage(step(now).groupBy(*keys).agg(F.sum("mass").alias("mass")).where("mass <> 0"), "push")
        left = now.agg(F.coalesce(F.sum(F.abs("mass")), F.lit(0.0))).first()[0]
        total = total.unionByName(now)
        old.append(path)
        if left <= TOLERANCE * max(n, 1):
            break
        if turn % 20 == 0:  # so that a plan never reads more than some twenty tables
            total, path = cut_lineage(total.groupBy(*keys).agg(F.sum("mass").alias("mass")), "push-total")
            for gone in old[:-1]:
                drop_table(spark, gone)
            old = [old[-1], path]
    else:
        raise RuntimeError(f"ranks have not settled after {MAX_STEPS} steps")
    out, _ = cut_lineage(total.groupBy(*keys).agg(F.sum("mass").alias("mass")), "pushed")
    for gone in old:
        drop_table(spark, gone)
    return out


def masses(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """lei, mass: PageRank before it is scaled. A graph without cycles is done after as many steps as its longest path."""
    nodes = vertices.select("lei").distinct()
    fan = edges.groupBy("src").agg(F.count("*").alias("fan"))
    links, path = cut_lineage(edges.join(fan, "src").select("src", "dst", "fan"), "push-links")
    out = _pushed(nodes.withColumn("mass", F.lit(1.0)), lambda now: links.join(now.withColumnRenamed("lei", "src"), "src").select(F.col("dst").alias("lei"), (ALPHA * F.col("mass") / F.col("fan")).alias("mass")), ["lei"], nodes.count())
    drop_table(vertices.sparkSession, path)
    return out


def mass_changes(mass: DataFrame, edges: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    """fold, lei, mass: what each set of links taken out (gone: fold, src, dst) changes; nodes that none of it reaches have no row."""
    fan = edges.groupBy("src").agg(F.count("*").alias("fan"))
    lost = gone.groupBy("fold", "src").agg(F.count("*").alias("lost"))
    # The links of sources that lose some: with what each gave before, and gives after.
    touched = lost.join(fan, "src").join(edges, "src").join(gone.withColumn("out", F.lit(True)), ["fold", "src", "dst"], "left").join(mass.withColumnRenamed("lei", "src"), "src")
    after = F.when(F.col("out"), 0.0).otherwise(1 / (F.col("fan") - F.col("lost")))
    start = touched.select("fold", F.col("dst").alias("lei"), (ALPHA * F.col("mass") * (after - 1 / F.col("fan"))).alias("mass")).groupBy("fold", "lei").agg(F.sum("mass").alias("mass"))

    def step(now: DataFrame) -> DataFrame:
        links = now.withColumnRenamed("lei", "src").join(edges, "src").join(gone, ["fold", "src", "dst"], "left_anti").join(fan, "src").join(lost, ["fold", "src"], "left")
        return links.select("fold", F.col("dst").alias("lei"), (ALPHA * F.col("mass") / (F.col("fan") - F.coalesce("lost", F.lit(0)))).alias("mass"))

    return _pushed(start, step, ["fold", "lei"], n)


def _key(fold: Column | str, lei: Column | str) -> Column:
    return F.concat_ws("|", F.col(fold).cast("string") if isinstance(fold, str) else fold.cast("string"), lei)


def split_components(parts: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """fold, lei, component, weakly_connected_component_size of the nodes whose component loses a link in the fold.

    parts: lei, component, as the whole graph has them.
    """
    of = gone.join(parts.select(F.col("lei").alias("src"), "component"), "src").select("fold", "component").distinct()
    own = of.join(parts, "component").select("fold", "lei")
    left = edges.join(own.withColumnRenamed("lei", "src"), "src").join(gone, ["fold", "src", "dst"], "left_anti")
    labels = component_labels(left.select(_key("fold", "src").alias("src"), _key("fold", "dst").alias("dst")))
    named = own.withColumn("node", _key("fold", "lei")).join(labels, "node", "left").select("fold", "lei", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("weakly_connected_component_size"))
    return named.join(sizes, "component").select("fold", "lei", "component", "weakly_connected_component_size")


def held_out_stats(vertices: DataFrame, edges: DataFrame, gone: DataFrame, wanted: DataFrame) -> DataFrame:
    """fold, lei, in_degree, out_degree, component, weakly_connected_component_size, pagerank of wanted (fold, lei), each once.

    gone: fold, src, dst, distinct and all in edges; folds without any have the whole graph's columns. Component names differ between folds.
    """
    gone, _ = cut_lineage(gone.select("fold", "src", "dst"), "held-out")
    mass = masses(vertices, edges)
    parts, _ = cut_lineage(graph.components(vertices, edges), "parts")
    n, whole = mass.agg(F.count("*"), F.sum("mass")).first()
    change = mass_changes(mass, edges, gone, n)
    sums = change.groupBy("fold").agg(F.sum("mass").alias("moved"))  # a row a fold
    ends = gone.select("fold", F.col("src").alias("lei"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(gone.select("fold", F.col("dst").alias("lei"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    ends = ends.groupBy("fold", "lei").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    new = split_components(parts, edges, gone).select("fold", "lei", F.col("component").alias("c"), F.col("weakly_connected_component_size").alias("s"))
    rows = wanted.join(graph.degrees(vertices, edges), "lei").join(parts, "lei").join(mass, "lei")
    rows = rows.join(ends, ["fold", "lei"], "left").join(new, ["fold", "lei"], "left").join(change.withColumnRenamed("mass", "d"), ["fold", "lei"], "left").join(F.broadcast(sums), "fold", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "fold", "lei", (F.col("in_degree") - zero("i")).alias("in_degree"), (F.col("out_degree") - zero("o")).alias("out_degree"), F.coalesce("c", _key("fold", "component")).alias("component"),
        F.coalesce("s", "weakly_connected_component_size").alias("weakly_connected_component_size"), ((F.col("mass") + zero("d")) / (F.lit(whole) + zero("moved"))).alias("pagerank"),
    )


def held_out_features(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """fold, source_lei, target_lei and PAIR_FEATURES of pairs (fold, source_lei, target_lei, each once) in their fold's graph, all in one pass."""
    wanted = pairs.select("fold", F.col("source_lei").alias("lei")).union(pairs.select("fold", "target_lei")).distinct()
    stats = held_out_stats(vertices, edges, gone, wanted).withColumn("lei", _key("fold", "lei")).drop("fold")
    folds = pairs.select("fold").distinct()  # some few
    left = edges.crossJoin(F.broadcast(folds)).join(gone.select("fold", "src", "dst"), ["fold", "src", "dst"], "left_anti")
    keyed, _ = cut_lineage(pairs.select("fold", "source_lei", "target_lei", _key("fold", "source_lei").alias("s"), _key("fold", "target_lei").alias("t")), "held-out-pairs")
    links, _ = cut_lineage(left.select(_key("fold", "src").alias("src"), _key("fold", "dst").alias("dst")), "held-out-edges")
    stats, _ = cut_lineage(stats, "held-out-stats")
    found = graph.pair_features(keyed.select(F.col("s").alias("source_lei"), F.col("t").alias("target_lei")), links, stats)
    return keyed.join(found.withColumnsRenamed({"source_lei": "s", "target_lei": "t"}), ["s", "t"]).select("fold", "source_lei", "target_lei", *graph.PAIR_FEATURES)
