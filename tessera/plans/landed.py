"""Queries of the readers, writers and drivers: files as they land are made of the canonical tables, then read by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules, schemas, text
from tessera.operators import clusters, graph, jurisdiction, ladder, links, macro, names, profile, scoring
from tessera.operators.components import WRITTEN, cut_lineage, shared_dir
from tessera.plans import pipelines
from tessera.plans.catalog import LABELS as OWN_LABELS
from tessera.plans.catalog import BRANDS, CLUSTERS, COUNTS, DEGREES, EDGES, INFERRED, INWARD, LADDER, LADDER_TABLES, MATCHED, QUEUE_COLUMNS, REACH, REVIEW, REVIEW_TABLES, SCORED, WALK, At, Shared, _assignments, _matches, _positions, _queue, _wide, query, r6
from tessera.sources import files, sinks
from tessera.streaming import incremental


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for files of a query, in the shared folder."""
    path = f"{shared_dir(spark)}/landed/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


# ---- Canonical files. ----


@query("SELECT lei, legal_name, country_legal, category FROM domestic", "domestic")
def loaded_entities(spark, sf):
    """Saved by country, then loaded by the canonical schema."""
    path = folder(spark, "entities")
    sinks.save_parquet(At(spark, sf).domestic, path, ["country_legal"])
    return files.load(spark, path, schemas.ENTITY).select("lei", "legal_name", "country_legal", "category")


@query("SELECT 'there' AS table_, count(*) AS n FROM exceptions UNION ALL SELECT 'missing', 0", "exceptions")
def optional_tables(spark, sf):
    path = folder(spark, "optional")
    sinks.save_parquet(At(spark, sf).exceptions, f"{path}/exceptions")
    count = lambda name, kind: files.load_optional(spark, f"{path}/{kind}", schemas.EXCEPTION).agg(F.lit(name).alias("table_"), F.count("*").alias("n"))
    return count("there", "exceptions").unionByName(count("missing", "nothing"))


@query("SELECT 'lei' AS kind, lei FROM domestic UNION ALL SELECT 'related_lei', lei FROM parents", "domestic", "parents")
def fallback_paths(spark, sf):
    """The entities lie under the older name, the parents in their country's partition, and under the older name is an empty table of them."""
    a, root = At(spark, sf), folder(spark, "country")
    sinks.save_parquet(a.domestic, f"{root}/malaysia_lei.parquet")
    sinks.save_parquet(a.parents, f"{root}/related_lei/country=my")
    sinks.save_parquet(a.parents.where("lei is null"), f"{root}/malaysia_related_lei.parquet")
    paths = files.country_paths(root, "MY")
    one = lambda kind: files.load_first(spark, paths[kind], schemas.ENTITY).select(F.lit(kind).alias("kind"), "lei")
    return one("lei").unionByName(one("related_lei")).unionByName(one("scored"))


@query("SELECT DISTINCT source_lei, target_lei, relationship_type FROM relationships", "relationships")
def chain_relationships(spark, sf):
    """Two countries hold the same links; each counts once."""
    a, root = At(spark, sf), folder(spark, "chain")
    for code in ("my", "sg"):
        sinks.save_parquet(a.relationships, f"{root}/relationships/country={code}")
    return files.chain_context(spark, root)[0].select("source_lei", "target_lei", "relationship_type")


@query("SELECT lei, legal_name FROM entities", "entities")
def chain_entities(spark, sf):
    a, root = At(spark, sf), folder(spark, "chain")
    sinks.save_parquet(a.domestic, f"{root}/lei/country=my")
    sinks.save_parquet(a.domestic, f"{root}/lei/country=sg")
    sinks.save_parquet(a.parents, f"{root}/related_lei/country=my")
    return files.chain_context(spark, root)[1].select("lei", "legal_name")


# ---- Rules and positions as CSV. ----

#: A rule is active by its word, and only for its host.
ACTIVE = "CASE CAST(substring(lei, 8) AS INT) % 5 WHEN 0 THEN 'yes' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '1' WHEN 3 THEN 'no' END"
HOST = "CASE WHEN CAST(substring(lei, 8) AS INT) % 7 = 0 THEN 'SG' ELSE 'my' END"
IS_ACTIVE = f"coalesce(trim({ACTIVE}), 'x') <> 'no' AND {HOST} = 'my'"


@query(f"""SELECT lei, uie_name, uie_country, coalesce(uie_source, 'manual_verified') AS uie_source, coalesce(evidence_tier, 'A_manual_verified_uie') AS evidence_tier, coalesce(try_cast(uie_confidence AS DOUBLE), 0.95) AS uie_confidence
FROM overrides WHERE {IS_ACTIVE}""", "overrides")
def override_file(spark, sf):
    path = folder(spark, "overrides")
    sinks.save_csv(At(spark, sf).overrides.withColumns({"active": F.expr(ACTIVE), "host_country": F.expr(HOST)}).drop("_ord"), path)
    return files.overrides(spark, path).select("lei", "uie_name", "uie_country", "uie_source", "evidence_tier", F.col("uie_confidence").cast("double").alias("uie_confidence"))


@query(f"SELECT lei, review_status, entity_type, review_note FROM statuses WHERE {IS_ACTIVE}", "statuses")
def status_file(spark, sf):
    path = folder(spark, "statuses")
    sinks.save_csv(At(spark, sf).statuses.withColumns({"active": F.expr(ACTIVE), "host_country": F.expr(HOST)}).drop("_ord"), path)
    return files.review_statuses(spark, path).select("lei", "review_status", "entity_type", "review_note")


@query(f"{INWARD} SELECT host, parent, round(fdi_usd_mn, 6) AS fdi_usd_mn FROM inward", "positions")
def position_file(spark, sf):
    from tessera.sources import adapter

    path = folder(spark, "positions")
    sinks.save_csv(_wide(At(spark, sf)), path, one_file=False)
    codes = {f"name {adapter.ISO[i:i + 2]}": adapter.ISO[i : i + 2] for i in range(0, 50, 2)}
    return r6(macro.positions(files.position_csv(spark, path), "Inward", {k: v for k, v in codes.items() if v in rules.HOSTS}, codes), "fdi_usd_mn")


@query("SELECT 'statuses' AS report, count(*) AS n FROM (SELECT DISTINCT entity_status FROM domestic) UNION ALL SELECT 'categories', count(*) FROM (SELECT DISTINCT category FROM domestic)", "domestic")
def csv_reports(spark, sf):
    """One CSV a table, read again."""
    a, path = At(spark, sf), folder(spark, "reports")
    sinks.save_all_csv({"statuses": profile.distribution(a.domestic, "entity_status"), "categories": profile.distribution(a.domestic, "category")}, path)
    back = lambda name: spark.read.option("header", True).csv(f"{path}/{name}").agg(F.lit(name).alias("report"), F.count("*").alias("n"))
    return back("statuses").unionByName(back("categories"))


# ---- Responses as JSON lines. ----


def _lines(df: DataFrame, path: str, page: int | None = None) -> DataFrame:
    """Rows (r: a record) as responses of one record, or of a page of them, landed as lines of text and read again."""
    if page:
        packed = df.withColumn("_page", F.floor(F.col("_ord") / page)).groupBy("_page").agg(F.sort_array(F.collect_list(F.struct("_ord", "r"))).alias("x"))
        body = packed.select(F.to_json(F.struct(F.transform("x", lambda x: x["r"]).alias("data"))).alias("value"))
    else:
        body = df.select(F.to_json(F.struct(F.col("r").alias("data"))).alias("value"))
    body.write.json(path)
    return df.sparkSession.read.schema(body.schema).json(path)


def _record(entity: dict, registration: dict | None = None, lei: str = "lei") -> F.Column:
    parts = [F.col(lei).alias("lei"), F.struct(*[v.alias(k) for k, v in entity.items()]).alias("entity")]
    if registration:
        parts.append(F.struct(*[v.alias(k) for k, v in registration.items()]).alias("registration"))
    return F.struct(F.col(lei).alias("id"), F.struct(*parts).alias("attributes"))


@query("SELECT lei, legal_name, category, legal_form, entity_status, registered_at, country_legal, city_legal, country_hq FROM domestic", "domestic")
def landed_entities(spark, sf):
    """Pages of 200 records."""
    place = lambda c, city: F.struct(F.col(c).alias("country"), city.alias("city"))
    e = {"legalName": F.struct(F.col("legal_name").alias("name")), "category": F.col("category"), "legalForm": F.struct(F.col("legal_form").alias("id")), "status": F.col("entity_status"), "legalAddress": place("country_legal", F.col("city_legal")), "headquartersAddress": place("country_hq", F.lit("X"))}
    rows = At(spark, sf).domestic.withColumn("r", _record(e, {"initialRegistrationDate": F.col("registered_at")}))
    return files.entity_records(_lines(rows, folder(spark, "entities"), 200)).select("lei", "legal_name", "category", "legal_form", "entity_status", "registered_at", "country_legal", "city_legal", "country_hq")


@query("SELECT lei, address_line1, CASE CAST(substring(lei, 8) AS INT) % 3 WHEN 1 THEN 'Level 2' WHEN 2 THEN 'Level 2 | Tower B' END AS address_line2, postal_code FROM addresses", "addresses")
def landed_addresses(spark, sf):
    """The first line, and the others joined."""
    n = F.expr("CAST(substring(lei, 8) AS INT) % 3")
    lines = F.concat(F.array("address_line1"), F.slice(F.array(F.lit("Level 2"), F.lit("Tower B")), F.lit(1), n))
    rows = At(spark, sf).addresses.withColumn("r", _record({"legalAddress": F.struct(lines.alias("addressLines"), F.col("postal_code").alias("postalCode"))}))
    return files.address_records(_lines(rows, folder(spark, "addresses"))).select("lei", "address_line1", "address_line2", "postal_code")


@query("SELECT source_lei, target_lei, relationship_type, relationship_status, 'IFRS' AS accounting_standard, CASE WHEN _ord % 2 = 0 THEN '2023-12-31' ELSE '2022-12-31' END AS period_end FROM relationships WHERE relationship_type = 'direct_parent'", "relationships")
def landed_relationships(spark, sf):
    """Of several periods the last counts."""
    return _endpoint(spark, sf, "direct_parent")


def _endpoint(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Links of one endpoint, landed as its responses and read again."""
    period = lambda y: F.struct(F.lit("IFRS").alias("accountingStandard"), F.lit(y).alias("endDate"))
    periods = F.when(F.col("_ord") % 2 == 0, F.array(period("2022-12-31"), period("2023-12-31"))).otherwise(F.array(period("2022-12-31")))
    end = lambda c: F.struct(F.col(c).alias("id"))
    link = F.struct(end("source_lei").alias("startNode"), end("target_lei").alias("endNode"), F.col("relationship_status").alias("status"), periods.alias("periods"))
    rows = At(spark, sf).relationships.where(F.col("relationship_type") == kind).withColumn("r", F.struct(F.struct(link.alias("relationship")).alias("attributes")))
    return files.relationship_records(_lines(rows, folder(spark, "links")), kind).select("source_lei", "target_lei", "relationship_type", "relationship_status", "accounting_standard", "period_end")


@query("SELECT source_lei, target_lei, relationship_type, relationship_status, 'IFRS' AS accounting_standard, CASE WHEN _ord % 2 = 0 THEN '2023-12-31' ELSE '2022-12-31' END AS period_end FROM relationships WHERE relationship_type IN ('direct_parent', 'ultimate_parent')", "relationships")
def landed_parents(spark, sf):
    """Both endpoints, each link under the kind of the endpoint that gave it."""
    return _endpoint(spark, sf, "direct_parent").union(_endpoint(spark, sf, "ultimate_parent"))


@query("SELECT lei, exception_reason FROM exceptions WHERE exception_reason <> 'NON_PUBLIC'", "exceptions")
def landed_exceptions(spark, sf):
    """Answers without a reason give no row."""
    reason = F.when(F.col("exception_reason") != "NON_PUBLIC", F.col("exception_reason"))
    rows = At(spark, sf).exceptions.withColumn("r", F.struct(F.struct(reason.alias("reason")).alias("attributes")))
    return files.exception_records(_with_lei(rows, folder(spark, "exceptions"))).select("lei", "exception_reason")


def _with_lei(rows: DataFrame, path: str) -> DataFrame:
    """Responses beside the lei that was asked for, landed in batches."""
    body = rows.select("lei", F.to_json(F.struct(F.col("r").alias("data"))).alias("value"))
    body.write.json(path)
    return rows.sparkSession.read.schema("lei string, value string").json(path)


@query("SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY _ord) AS INT) AS rank, lei, legal_name, country_legal, country_hq, CAST(7 AS INT) AS total_results FROM searches", "searches")
def landed_searches(spark, sf):
    """Candidates of one answer are ranked in their order."""
    e = {"legalName": F.struct(F.col("legal_name").alias("name")), "legalAddress": F.struct(F.col("country_legal").alias("country")), "headquartersAddress": F.struct(F.col("country_hq").alias("country"))}
    rows = At(spark, sf).searches.withColumn("r", _record(e)).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_ord", "r"))).alias("x"))
    meta = F.struct(F.struct(F.lit(7).alias("total")).alias("pagination"))
    body, path = rows.select("query", F.to_json(F.struct(meta.alias("meta"), F.transform("x", lambda x: x["r"]).alias("data"))).alias("value")), folder(spark, "searches")
    body.write.json(path)
    return files.search_records(spark.read.schema("query string, value string").json(path)).select("query", "rank", "lei", "legal_name", "country_legal", "country_hq", "total_results")


@query("SELECT cik, ticker, title FROM tickers", "tickers")
def landed_tickers(spark, sf):
    """An object of objects, numbers without leading zeros."""
    t = At(spark, sf).tickers.select("_ord", F.struct(F.regexp_replace("cik", "^0+(?=.)", "").alias("cik_str"), "ticker", "title").alias("r"))
    many = t.groupBy(F.floor(F.col("_ord") / 50)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("_ord").cast("string"), "r")))).alias("value")).select("value")
    path = folder(spark, "tickers")
    many.write.json(path)
    return files.ticker_records(spark.read.schema("value string").json(path))


@query("SELECT host || ':' || parent AS obs_key, CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR) AS value FROM positions", "positions")
def landed_observations(spark, sf):
    """The first element of each observation of the first data set."""
    p = At(spark, sf).positions.select("host", F.struct(F.concat_ws(":", "host", "parent"), F.array(F.floor("amount").cast("long").cast("string"), F.lit("0"))).alias("o"))
    sets = F.array(F.struct(F.map_from_entries(F.collect_list("o")).alias("observations")))
    return files.observations(p.groupBy("host").agg(F.to_json(F.struct(F.struct(sets.alias("dataSets")).alias("data"))).alias("value")))


@query("SELECT path, count(*) AS n, min(value) AS least FROM (SELECT 'attributes.lei' AS path, lei AS value FROM domestic UNION ALL SELECT 'attributes.entity.status', entity_status FROM domestic UNION ALL SELECT 'id', lei FROM domestic) GROUP BY 1", "domestic")
def flattened_objects(spark, sf):
    rows = At(spark, sf).domestic.select(F.to_json(_record({"status": F.col("entity_status")})).alias("value"))
    return files.flatten_objects(rows).groupBy("path").agg(F.count("*").alias("n"), F.min("value").alias("least"))


# ---- Registry pages and pulls. ----

DETAIL = "<html><body><h1>{name}</h1><p>Company Registration No. <b>{no} / 1</b> Nature of Business <i>Trade &amp; more</i> Date of Registration 2001-02-03 State <!-- x -->Selangor COMPANY DESCRIPTION none</p></body></html>"


@query("SELECT ctos_name, ctos_url, coalesce(CASE WHEN _ord % 2 = 0 THEN ctos_registration_no END, ctos_registration_no || ' / 1') AS ctos_registration_no, 'Trade & more' AS ctos_nature_of_business, '2001-02-03' AS ctos_registration_date, 'Selangor' AS ctos_state FROM registry", "registry")
def registry_pages(spark, sf):
    """Company pages fill what the directory lacks and override nothing."""
    r = At(spark, sf).registry
    page = F.lit(DETAIL)
    for mark, c in (("{name}", "ctos_name"), ("{no}", "ctos_registration_no")):
        page = F.replace(page, F.lit(mark), F.col(c))
    details = files.registry_details(r.select("ctos_url", page.alias("html")))
    known = r.select("ctos_name", "ctos_url", F.when(F.col("_ord") % 2 == 0, F.col("ctos_registration_no")).alias("ctos_registration_no"))
    return files.enrich_directory(known, details).select("ctos_name", "ctos_url", "ctos_registration_no", "ctos_nature_of_business", "ctos_registration_date", "ctos_state")


#: A page cap that some pulls pass.
# ---- Checkpoints, stages, manifests, streams. ----


@query("SELECT lei, legal_name FROM domestic WHERE CAST(substring(lei, 8) AS INT) % 4 <> 3", "domestic")
def appended_checkpoint(spark, sf):
    """Batches that overlap, one of them twice: each key once."""
    rows, path = At(spark, sf).domestic.select("lei", "legal_name").withColumn("k", F.expr("CAST(substring(lei, 8) AS INT) % 4")), folder(spark, "appended")
    for some in ("k = 0", "k <= 1", "k <= 2", "k <= 1"):
        sinks.append_new(rows.where(some).drop("k"), path, ["lei"])
    return spark.read.parquet(path)


@query("SELECT 'entities' AS role, true AS exists, (SELECT count(*) FROM domestic) AS rows, true AS dated UNION ALL SELECT 'scores', false, NULL, false", "domestic")
def file_manifest(spark, sf):
    path = folder(spark, "manifest")
    sinks.save_parquet(At(spark, sf).domestic, f"{path}/entities")
    return sinks.manifest(spark, {"entities": f"{path}/entities", "scores": f"{path}/scores"}).select("role", "exists", "rows", F.col("last_modified").isNotNull().alias("dated"))


@query("SELECT lei, exception_reason FROM exceptions WHERE exception_reason <> 'NON_PUBLIC'", "exceptions")
def resumed_scan(spark, sf):
    """Two runs of the stream over answers that land in two parts, the second part with some of the first again."""
    rows = At(spark, sf).exceptions.withColumn("r", F.struct(F.struct(F.when(F.col("exception_reason") != "NON_PUBLIC", F.col("exception_reason")).alias("reason")).alias("attributes")))
    root, half = folder(spark, "scan"), F.expr("CAST(substring(lei, 8) AS INT) % 3")
    for n, some in enumerate((half <= 1, half >= 1)):
        rows.where(some).select("lei", F.to_json(F.struct(F.col("r").alias("data"))).alias("value")).write.mode("append").json(f"{root}/landing")
        incremental.ingest(spark, f"{root}/landing", f"{root}/store", files.exception_records, ["lei"])
    return spark.read.parquet(f"{root}/store/rows").select("lei", "exception_reason")


@query("SELECT count(DISTINCT lei) AS wanted, count(DISTINCT lei) FILTER (lei NOT IN (SELECT lei FROM exceptions)) AS \"left\", count(DISTINCT lei) FILTER (lei IN (SELECT lei FROM exceptions)) AS scanned FROM domestic", "domestic", "exceptions")
def scan_progress(spark, sf):
    a = At(spark, sf)
    return incremental.scan_progress(a.domestic, a.exceptions.select("lei"))


# ---- Reports whose order counts: the first rows. ----


@query(f"{LADDER}, {SCORED}, {REVIEW} SELECT {', '.join(QUEUE_COLUMNS)} FROM queue WHERE entity_type <> 'fund_or_product_vehicle' ORDER BY CASE WHEN entity_type = 'nominee_or_custodian' THEN 1 ELSE 0 END, review_priority_score DESC, coverage_gap_priority_score DESC, legal_name, lei LIMIT {rules.REVIEW_LIMIT}", *REVIEW_TABLES)
def top_review_targets(spark, sf):
    """The main queue, a report of its first rows."""
    return r6(scoring.split_vehicles(_queue(Shared(spark, sf)))[0].select(*QUEUE_COLUMNS), "coverage_gap_priority_score")


@query(f"{EDGES}, {DEGREES}, {REACH} SELECT lei, weakly_connected_component_size, in_degree, out_degree FROM degrees JOIN comps USING (lei) ORDER BY weakly_connected_component_size DESC, in_degree DESC, out_degree DESC, lei LIMIT 50", "entities", "relationships")
def largest_nodes(spark, sf):
    a = Shared(spark, sf)
    return graph.sorted_summary(graph.graph_summary(a.entities, a.relationships, ranks=False)).limit(50).select("lei", "weakly_connected_component_size", "in_degree", "out_degree")


@query(f"{LADDER} SELECT lei, evidence_tier, uie_confidence, legal_name FROM uie ORDER BY evidence_tier, uie_confidence DESC, legal_name, lei LIMIT 300", *LADDER_TABLES)
def surest_assignments(spark, sf):
    return ladder.sorted_assignments(_assignments(Shared(spark, sf))).limit(300).select("lei", "evidence_tier", "uie_confidence", "legal_name")


# ---- Models' inputs and outputs. ----

GUESSES = f"{CLUSTERS}, {INFERRED}, guesses AS (SELECT lei AS source_lei, inferred_parent_lei AS target_lei, confidence AS link_probability FROM inferred)"


def _guesses(a: At) -> DataFrame:
    found = clusters.infer_cluster_parents(clusters.cluster_by_address(a.addresses), a.relationships)
    return found.select(F.col("lei").alias("source_lei"), F.col("inferred_parent_lei").alias("target_lei"), F.col("confidence").alias("link_probability"))


@query(f"{GUESSES} SELECT source_lei, target_lei, link_probability, row_number() OVER (ORDER BY link_probability DESC, source_lei, target_lei) AS rank FROM guesses", "addresses", "relationships")
def ranked_links(spark, sf):
    return links.ranked(_guesses(Shared(spark, sf)))


@query(f"{GUESSES} SELECT source_lei, target_lei, link_probability, p.country_legal AS predicted_parent_country FROM guesses LEFT JOIN parents p ON p.lei = target_lei", "addresses", "relationships", "parents")
def best_links(spark, sf):
    a = Shared(spark, sf)
    return links.best_links(_guesses(a), a.parents).select("source_lei", "target_lei", "link_probability", "predicted_parent_country")


@query(f"""{EDGES}, {REACH}, {GUESSES}, {OWN_LABELS}, known AS (SELECT lei, parent_country AS label FROM labels_ WHERE lei IN (SELECT lei FROM nodes)), {WALK.replace('walk AS', 'walk (lei, label, hops) USING KEY (lei) AS')},
votes AS (SELECT component, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY component) AS whole FROM known JOIN comps USING (lei) GROUP BY 1, 2),
spread AS (SELECT round(n / whole * (1.0 / (1 + hops)), 4)::DOUBLE AS confidence FROM walk JOIN comps USING (lei) JOIN votes ON votes.component = comps.component AND votes.label = walk.label WHERE hops > 0)
SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, count(*) AS link_predictions_count, round(avg(link_probability), 4) AS avg_link_probability, count(*) FILTER (link_probability >= 0.5) AS high_confidence_links,
(SELECT count(*) FROM spread) AS propagated_labels_count, (SELECT round(avg(confidence), 4) FROM spread) AS avg_propagation_confidence, (SELECT count(*) FILTER (confidence >= 0.3) FROM spread) AS propagated_high_confidence FROM guesses""", "entities", "relationships", "addresses")
def link_prediction_summary(spark, sf):
    """Of links that shared addresses suggest, beside the labels that the graph propagates."""
    a = Shared(spark, sf)
    edges = graph.edges_of(a.relationships)
    labels = jurisdiction.training_labels(a.relationships, a.parents).select("lei", F.col("parent_country").alias("label"))
    spread = graph.propagate_labels(graph.vertices_of(a.entities, edges), edges, labels)
    return links.link_summary(graph.readiness(a.domestic, a.relationships, a.entities), _guesses(a), spread).drop("graph_ready", "labeled_ratio", "n_parent_nodes")


SEED = 42


@query(f"""positive AS (SELECT DISTINCT source_lei, target_lei FROM relationships WHERE source_lei IN (SELECT lei FROM domestic) AND target_lei IN (SELECT lei FROM parents)),
sizes AS (SELECT (SELECT count(*) FROM positive) * 3 AS wanted, (SELECT count(DISTINCT lei) FROM domestic) AS n_own, (SELECT count(DISTINCT lei) FROM parents) AS n_up),
places AS (SELECT lei AS target_lei, row_number() OVER (ORDER BY md5(lei), lei) - 1 AS place FROM (SELECT DISTINCT lei FROM parents)),
draws AS (SELECT lei AS source_lei, unnest(range(1, CAST(ceil(10 * wanted / n_own::DOUBLE) AS BIGINT) + 1)) AS draw, n_up FROM (SELECT DISTINCT lei FROM domestic), sizes),
drawn AS (SELECT DISTINCT source_lei, target_lei FROM draws JOIN places ON place = CAST('0x' || substr(md5(source_lei || '|' || draw || '|{SEED}'), 1, 12) AS BIGINT) % n_up),
negative AS (SELECT source_lei, target_lei FROM (SELECT *, row_number() OVER (ORDER BY md5(source_lei || '|' || target_lei || '|{SEED}'), source_lei, target_lei) AS turn FROM drawn ANTI JOIN positive USING (source_lei, target_lei)), sizes WHERE turn <= wanted)
SELECT source_lei, target_lei, 1 AS label FROM positive UNION ALL SELECT source_lei, target_lei, 0 FROM negative""", "domestic", "parents", "relationships")
def training_pairs(spark, sf):
    a = Shared(spark, sf)
    return links.training_pairs(a.relationships, a.domestic, a.parents, seed=SEED)


REGION_OF = "CASE " + " ".join(f"WHEN c IN ({', '.join(repr(x) for x in codes)}) THEN '{r}'" for r, codes in rules.REGIONS.items()) + " ELSE 'OTHER' END"


@query(f"""{BRANDS}, {MATCHED}, own AS (SELECT lei, c FROM (SELECT r.source_lei AS lei, p.country_legal AS c, row_number() OVER (PARTITION BY r.source_lei ORDER BY r._ord) AS k FROM relationships r JOIN parents p ON p.lei = r.target_lei) WHERE k = 1),
labeled AS (SELECT * FROM own UNION ALL SELECT m.lei, p.country_legal FROM matched m JOIN parents p ON p.lei = m.matched_parent_lei WHERE match_score >= 95 AND m.lei NOT IN (SELECT lei FROM own)),
once AS (SELECT lei, c, CASE WHEN count(*) OVER (PARTITION BY c) >= 15 THEN c ELSE {REGION_OF} END AS b FROM labeled) SELECT lei, c AS parent_country, CASE WHEN count(*) OVER (PARTITION BY b) < 2 THEN 'OTHER' ELSE b END AS parent_bucket FROM once""", "domestic", "parents", "relationships")
def pseudo_labels(spark, sf):
    """Labels with those of sure name matches."""
    a = Shared(spark, sf)
    return jurisdiction.training_labels(a.relationships, a.parents, _matches(a))


@query(f"""{BRANDS}, {MATCHED}, {CLUSTERS}, {INFERRED}, all_ AS (SELECT source_lei, target_lei, relationship_type, 0 AS f, _ord FROM relationships UNION ALL SELECT lei, matched_parent_lei, 'inferred_name_match', 1, 0 FROM matched WHERE match_score >= 80 UNION ALL SELECT lei, inferred_parent_lei, 'inferred_address_cluster', 2, 0 FROM inferred)
SELECT source_lei, target_lei, min(f) AS origin FROM all_ GROUP BY 1, 2""", "domestic", "parents", "relationships", "addresses")
def enriched_edges(spark, sf):
    """Known, name and address links, each pair once, from the first source that has it."""
    a = Shared(spark, sf)
    found = clusters.infer_cluster_parents(clusters.cluster_by_address(a.addresses), a.relationships)
    kind = F.col("relationship_type")
    origin = F.when(kind == "inferred_name_match", 1).when(kind == "inferred_address_cluster", 2).otherwise(0)
    return pipelines.enriched_relationships(pipelines.Inputs(a.domestic, a.parents, a.relationships), _matches(a), found).select("source_lei", "target_lei", origin.alias("origin"))


@query(f"""{BRANDS}, {MATCHED}, {CLUSTERS}, {INFERRED}, links_ AS (SELECT source_lei, target_lei FROM relationships UNION ALL SELECT lei, matched_parent_lei FROM matched UNION ALL SELECT lei, inferred_parent_lei FROM inferred),
{EDGES.replace('FROM relationships', 'FROM links_')}, {REACH} SELECT lei, component, weakly_connected_component_size FROM comps""", "domestic", "entities", "parents", "relationships", "addresses")
def enriched_components(spark, sf):
    """Components once name and address links are in, from those of the known links and the added links alone."""
    a = Shared(spark, sf)
    known = graph.edges_of(a.relationships)
    before, _ = cut_lineage(graph.components(graph.vertices_of(a.entities, known), known).select("lei", "component"), "known-components")
    found = clusters.infer_cluster_parents(clusters.cluster_by_address(a.addresses), a.relationships)
    named = names.inferred_edges(_matches(a)).select("source_lei", "target_lei")
    added, _ = cut_lineage(graph.edges_of(named.union(found.select("lei", "inferred_parent_lei"))), "added-edges")
    return graph.components_after(graph.vertices_of(a.entities, known.union(added)), before, added)


# ---- Functions, rules and drivers. ----


@query(f"""{BRANDS}, {MATCHED} SELECT DISTINCT token, brand_token, round(raw, 6) AS score FROM rated""", "domestic", "parents", "relationships")
def sql_functions(spark, sf):
    """The word-set ratio as a SQL function, over every unlinked name and brand (a fixed product of the two short lists)."""
    a = Shared(spark, sf)
    text.register(spark)
    free = a.domestic.join(a.relationships.select(F.col("source_lei").alias("lei")), "lei", "left_anti").select(text.brand_token(text.clean_company_name("legal_name")).alias("token")).distinct()
    blocks = names.brand_tokens(a.parents).select("brand_token").withColumn("one", F.lit(1)).join(free.withColumn("one", F.lit(1)), "one")
    return blocks.selectExpr("token", "brand_token", "round(token_set_ratio(brand_token, token), 6) AS score").distinct()


@query("SELECT lei, CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN 2 ELSE 0 END AS flag FROM (SELECT lei, CAST(substring(lei, 8) AS INT) % 4 AS k FROM domestic)", "domestic")
def int_flags(spark, sf):
    """Text, decimals and what is no number."""
    said = F.element_at(F.array(F.lit("1.0"), F.lit("2"), F.lit("n/a"), F.lit(None).cast("string")), F.expr("CAST(substring(lei, 8) AS INT) % 4") + 1)
    return At(spark, sf).domestic.select("lei", scoring.int_flag(said).alias("flag"))


def _default_line() -> str:
    line = "trim(upper(coalesce(address_line1, '')))"
    for short, full in rules.DEFAULT_ABBREVIATIONS.items():
        line = f"regexp_replace({line}, '\\b{short}\\b', '{full}', 'g')"
    return f"trim(regexp_replace(regexp_replace({line}, '[^A-Z0-9\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


OFFICES = " OR ".join(f"contains(upper(key), '{m}')" for m in rules.DEFAULT_OFFICES)


@query(f"""keyed AS (SELECT lei, {_default_line()} || '|' || trim(coalesce(postal_code, 'None')) AS key FROM addresses WHERE {_default_line()} <> '')
SELECT lei, key AS cluster_address_key, count(*) OVER (PARTITION BY key) AS cluster_size, {OFFICES} AS is_office_hotel FROM keyed QUALIFY count(*) OVER (PARTITION BY key) >= 5""", "addresses")
def default_address_rules(spark, sf):
    """A country without rules of its own, clusters of five or more."""
    return clusters.cluster_by_address(At(spark, sf).addresses, 5, "ZZ").select("lei", "cluster_address_key", "cluster_size", "is_office_hotel")


@query("""SELECT country_legal AS country, count(*) AS raw_entities, coalesce(any_value(r), 0) AS relationships, coalesce(any_value(s), 0) AS related_leis, coalesce(any_value(e), 0) AS reporting_exceptions, coalesce(any_value(r), 0) AS relationship_wip_rows, coalesce(any_value(q), 0) AS relationship_scanned FROM domestic d
LEFT JOIN (SELECT country_legal, count(*) AS r, count(DISTINCT source_lei) AS q FROM relationships JOIN domestic ON lei = source_lei GROUP BY 1) USING (country_legal)
LEFT JOIN (SELECT d.country_legal, count(DISTINCT target_lei) AS s FROM relationships JOIN domestic d ON d.lei = source_lei GROUP BY 1) USING (country_legal)
LEFT JOIN (SELECT country_legal, count(*) AS e FROM exceptions JOIN domestic USING (lei) GROUP BY 1) USING (country_legal) GROUP BY 1""", "domestic", "relationships", "exceptions")
def coverage_by_country(spark, sf):
    """The six counts of each country."""
    a = Shared(spark, sf)
    own = a.domestic.select("lei", F.col("country_legal").alias("country"))
    rels = a.relationships.join(own, F.col("source_lei") == F.col("lei")).drop("lei")
    return macro.country_coverage({
        "raw_entities": own, "relationships": rels, "related_leis": rels.select("country", "target_lei").distinct(), "reporting_exceptions": a.exceptions.join(own, "lei"),
        "relationship_wip_rows": rels, "relationship_scanned": rels.select("country", "source_lei").distinct(),
    })


HOME = LADDER.replace("FROM domestic d LEFT JOIN (SELECT source_lei AS lei, arg_min(target_lei, _ord) AS direct_parent_lei", "FROM (SELECT * FROM domestic WHERE country_legal = 'MY') d LEFT JOIN (SELECT source_lei AS lei, arg_min(target_lei, _ord) AS direct_parent_lei")


@query(f"{HOME} SELECT host_country, uie_country, count(lei) AS total_entities, CAST(sum(is_known_uie) AS BIGINT) AS known_uie_entities, CAST(sum(is_inferred_uie) AS BIGINT) AS inferred_uie_entities, round(avg(CAST(uie_confidence AS DECIMAL(18, 4))), 4) AS avg_confidence FROM uie WHERE uie_country IS NOT NULL GROUP BY 1, 2", *LADDER_TABLES)
def product_summary(spark, sf):
    """The product driver end to end, for the entities of the host alone."""
    a = Shared(spark, sf)
    found = clusters.cluster_by_address(a.addresses)
    x = pipelines.Inputs(a.domestic, a.parents, a.relationships, a.exceptions, a.addresses, directory=a.registry, predictions=a.predictions, overrides=a.overrides, statuses=a.statuses)
    return pipelines.graph_and_scoring(x, _matches(a), clusters.infer_cluster_parents(found, a.relationships), found)["investor_summary"]


@query(f"{LADDER}, {COUNTS}, {INWARD} SELECT parent, CAST(sum(entity_count) AS BIGINT) AS total_entities, round(sum(entity_count) / (sum(fdi_usd_mn) / 1000) * 10, 1) AS entities_per_10bn FROM counts JOIN inward USING (host, parent) GROUP BY 1 HAVING sum(fdi_usd_mn) >= 500", *LADDER_TABLES, "positions")
def macro_report(spark, sf):
    """The macro driver over the assignments of every host."""
    a = Shared(spark, sf)
    own = _assignments(a).withColumn("host_country", F.col("entity_country")).where(F.col("host_country").isin(rules.HOSTS))
    return pipelines.macro_validation(own, _positions(a, "Inward"), _positions(a, "Outward"))["per_10bn"].select("parent", "total_entities", "entities_per_10bn")


@query("SELECT coalesce(legal_form, 'UNKNOWN') AS legal_form, count(*) AS count FROM domestic GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "domestic")
def analysis_report(spark, sf):
    """The analysis driver; of its parts, the legal forms."""
    a = At(spark, sf)
    return pipelines.entity_analysis(pipelines.Inputs(a.domestic, a.parents, a.relationships))["legal_form_distribution"].select("legal_form", "count")


@query(f"{CLUSTERS}, {INFERRED} SELECT 'clustered' AS what, count(*) AS n FROM clusters UNION ALL SELECT 'inferred', count(*) FROM inferred", "addresses", "relationships")
def address_phase(spark, sf):
    """The address driver."""
    a = Shared(spark, sf)
    out = pipelines.address_clustering(pipelines.Inputs(a.domestic, a.parents, a.relationships, addresses=a.addresses))
    return out["clusters"].agg(F.lit("clustered").alias("what"), F.count("*").alias("n")).unionByName(out["inferred"].agg(F.lit("inferred").alias("what"), F.count("*").alias("n")))


@query(f"{BRANDS}, {MATCHED} SELECT 'brands' AS what, count(*) AS n FROM brands UNION ALL SELECT 'matches', count(*) FROM matched UNION ALL SELECT 'edges', count(*) FROM matched WHERE match_score >= 80", "domestic", "parents", "relationships")
def name_phase(spark, sf):
    """The name driver."""
    a = Shared(spark, sf)
    out = pipelines.name_inference(pipelines.Inputs(a.domestic, a.parents, a.relationships))
    one = lambda what: out[what].agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return one("brands").unionByName(one("matches")).unionByName(one("edges"))
