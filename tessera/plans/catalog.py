"""Every query over the adapter's canonical tables, beside SQL with the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules, text
from tessera.operators import clusters, graph, jurisdiction, ladder, links, macro, names, profile, scoring
from tessera.operators.components import cut_lineage, spread
from tessera.plans import pipelines
from tessera.sources import adapter, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
RANKS = 10  # PageRank steps of the queries with SQL, which must fix their number


def query(sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Register a query; its SQL comes after WITH clauses for the named canonical tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = adapter.with_tables(*tables) if tables else ""
            SQL[f.__name__] = (head.replace("WITH ", "WITH RECURSIVE ", 1) + ("," if head and not sql.lstrip().upper().startswith("SELECT") else "")) + "\n" + sql
        return f

    return add


class At:
    """Canonical tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return adapter.canonical(self._spark, self._dir, name)


class Shared(At):
    """The same, for queries that read a table many times: what costs a join of large tables is written once, in the shared folder."""

    WRITTEN = ("domestic", "parents", "relationships")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        given = {n: getattr(self, n) for n in adapter.NEEDS.get(name, [])}
        df = adapter.canonical(self._spark, self._dir, name, given)
        if name in self.WRITTEN:
            df, _ = cut_lineage(df if name == "relationships" else spread(df), name)  # relationships come out of a shuffle
        setattr(self, name, df)
        return df


def kept(a: At, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several parts of a query read: written once by those that share their tables, else built anew."""
    if not isinstance(a, Shared):
        return build()
    if name not in a.__dict__:
        a.__dict__[name] = cut_lineage(build(), name)[0]
    return a.__dict__[name]


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places, so that the order of sums does not show."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


# ---- Profiles. ----

PCT = "CASE WHEN {n} > 0 THEN round({x} * 100.0 / {n}, 1) ELSE 0.0 END"
TITLE = "array_to_string(list_transform(regexp_extract_all(lower(trim(city_legal)), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '')"


@query("""SELECT count(*) AS total_records, count(DISTINCT lei) AS unique_leis, count(*) FILTER (entity_status = 'ACTIVE') AS active_entities,
count(DISTINCT country_legal) AS countries_legal, count(DISTINCT country_hq) AS countries_hq, count(DISTINCT city_legal) AS cities_legal, count(DISTINCT category) AS categories,
count(DISTINCT legal_form) AS legal_forms, min(registered_at) AS earliest_registration, max(registered_at) AS latest_registration,
count(*) - count(DISTINCT lei) AS duplicates_removed, count(*) - count(*) FILTER (entity_status = 'ACTIVE') AS inactive_entities FROM domestic""", "domestic")
def entity_discovery_summary(spark, sf):
    return profile.discovery_summary(At(spark, sf).domestic)


@query(f"""SELECT city_legal, country_legal, n AS count, round(n * 100.0 / whole, 1) AS pct FROM (SELECT city_legal, country_legal, count(*) AS n FROM (SELECT {TITLE} AS city_legal, country_legal FROM domestic) GROUP BY ALL), (SELECT count(*) AS whole FROM domestic)
ORDER BY n DESC, city_legal NULLS LAST, country_legal LIMIT 20""", "domestic")
def geographic_concentration(spark, sf):
    return profile.geographic_concentration(At(spark, sf).domestic)


@query("SELECT lei, legal_name, country_legal, country_hq FROM domestic WHERE country_legal <> country_hq", "domestic")
def hq_legal_mismatch(spark, sf):
    return profile.hq_mismatch(At(spark, sf).domestic)


def _distribution(column: str, top: str = "") -> str:
    return f"SELECT {column}, n AS count, round(n * 100.0 / whole, 1) AS pct FROM (SELECT coalesce({column}, 'UNKNOWN') AS {column}, count(*) AS n FROM domestic GROUP BY 1), (SELECT count(*) AS whole FROM domestic) ORDER BY n DESC, 1 {top}"


@query(_distribution("legal_form", "LIMIT 20"), "domestic")
def legal_form_distribution(spark, sf):
    return profile.distribution(At(spark, sf).domestic, "legal_form", 20)


@query(_distribution("category"), "domestic")
def category_distribution(spark, sf):
    return profile.distribution(At(spark, sf).domestic, "category")


@query(_distribution("entity_status"), "domestic")
def entity_status_distribution(spark, sf):
    return profile.distribution(At(spark, sf).domestic, "entity_status")


@query("SELECT CAST(year(try_cast(registered_at AS DATE)) AS VARCHAR) AS period, count(*) AS count FROM domestic WHERE try_cast(registered_at AS DATE) IS NOT NULL GROUP BY 1", "domestic")
def registration_timeline(spark, sf):
    return profile.registration_timeline(At(spark, sf).domestic)


@query(f"""SELECT d.country, total_entities, {PCT.format(x='active', n='total_entities')} AS active_pct, n_cities, top_city, {PCT.format(x='top_n', n='total_entities')} AS top_city_concentration_pct,
n_legal_forms, hq_mismatch_count, {PCT.format(x='hq_mismatch_count', n='total_entities')} AS hq_mismatch_pct, {PCT.format(x='g', n='total_entities')} AS pct_general, {PCT.format(x='f', n='total_entities')} AS pct_fund,
{PCT.format(x='b', n='total_entities')} AS pct_branch, {PCT.format(x='s', n='total_entities')} AS pct_sole_proprietor
FROM (SELECT country_legal AS country, count(*) AS total_entities, count(*) FILTER (entity_status = 'ACTIVE') AS active, count(DISTINCT city_legal) AS n_cities, count(DISTINCT legal_form) AS n_legal_forms, count(*) FILTER (country_hq <> country_legal) AS hq_mismatch_count,
 count(*) FILTER (category = 'GENERAL') AS g, count(*) FILTER (category = 'FUND') AS f, count(*) FILTER (category = 'BRANCH') AS b, count(*) FILTER (category = 'SOLE_PROPRIETOR') AS s FROM domestic GROUP BY 1) d
JOIN (SELECT country, top_city, n AS top_n FROM (SELECT country_legal AS country, {TITLE} AS top_city, count(*) AS n, row_number() OVER (PARTITION BY country_legal ORDER BY count(*) DESC, {TITLE} NULLS LAST) AS k FROM domestic GROUP BY 1, 2) WHERE k = 1) t USING (country)""", "domestic")
def country_profiles(spark, sf):
    return profile.country_profiles(At(spark, sf).domestic)


# ---- Graph. ----

EDGES = "edges AS (SELECT DISTINCT source_lei AS src, target_lei AS dst FROM relationships WHERE source_lei IS NOT NULL AND target_lei IS NOT NULL), nodes AS (SELECT lei FROM entities UNION SELECT src FROM edges UNION SELECT dst FROM edges), und AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges)"
DEGREES = "degrees AS (SELECT lei, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree FROM nodes LEFT JOIN (SELECT dst AS lei, count(*) AS i FROM edges GROUP BY 1) USING (lei) LEFT JOIN (SELECT src AS lei, count(*) AS o FROM edges GROUP BY 1) USING (lei))"
REACH = "reach AS (SELECT lei, lei AS other FROM nodes UNION SELECT reach.lei, und.v FROM reach JOIN und ON reach.other = und.u), comps AS (SELECT lei, min(other) AS component, count(*) AS weakly_connected_component_size FROM reach GROUP BY 1)"


def pagerank_sql(steps: int) -> str:
    """pr0 to pr<steps>: the ranks after each step."""
    out = ["fan AS (SELECT src, count(*) AS fan FROM edges GROUP BY 1)", "pr0 AS MATERIALIZED (SELECT lei, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for k in range(steps):
        out.append(f"pr{k + 1} AS MATERIALIZED (SELECT p.lei, 0.85 * (coalesce(g.given, 0) + (SELECT coalesce(sum(r), 0) FROM pr{k} WHERE lei NOT IN (SELECT src FROM fan)) / (SELECT count(*) FROM nodes)) + 0.15 / (SELECT count(*) FROM nodes) AS r FROM pr{k} p LEFT JOIN (SELECT dst AS lei, sum(r / fan) AS given FROM edges JOIN fan USING (src) JOIN pr{k} q ON q.lei = edges.src GROUP BY 1) g USING (lei))")
    return ", ".join(out)


PAGERANK = pagerank_sql(RANKS)
CENTRALITY = "centrality AS (SELECT lei, coalesce(d, 0)::DOUBLE / ((SELECT count(*) FROM nodes) - 1) AS degree_centrality FROM nodes LEFT JOIN (SELECT u AS lei, sum(CASE WHEN u = v THEN 2 ELSE 1 END) AS d FROM und GROUP BY 1) USING (lei))"
FLAGS = "flags AS (SELECT source_lei AS lei, CAST(max(CASE WHEN relationship_type = 'direct_parent' THEN 1 ELSE 0 END) AS INT) AS has_parent_link, CAST(max(CASE WHEN relationship_type = 'ultimate_parent' THEN 1 ELSE 0 END) AS INT) AS has_ultimate_link FROM relationships WHERE relationship_type IN ('direct_parent', 'ultimate_parent') GROUP BY 1)"
FOREIGN = "foreign_flags AS (SELECT DISTINCT source_lei AS lei, 1 AS foreign_parent FROM relationships JOIN entities e ON e.lei = target_lei WHERE relationship_type IN ('direct_parent', 'ultimate_parent') AND country_legal <> 'MY')"


def _graph(a: At) -> tuple[DataFrame, DataFrame]:
    edges = graph.edges_of(a.relationships)
    return graph.vertices_of(a.entities, edges), edges


@query(FLAGS + " SELECT * FROM flags", "relationships")
def parent_flags(spark, sf):
    return graph.parent_flags(At(spark, sf).relationships)


@query(FOREIGN + " SELECT * FROM foreign_flags", "entities", "relationships")
def foreign_parent_flags(spark, sf):
    a = At(spark, sf)
    return graph.foreign_parents(a.relationships, a.entities)


UPSTREAM = "upstream AS (SELECT source_lei AS direct_parent_lei, target_lei AS chain_parent_lei, relationship_type AS chain_parent_relationship_type FROM (SELECT *, row_number() OVER (PARTITION BY source_lei ORDER BY CASE relationship_type WHEN 'ultimate_parent' THEN 0 ELSE 1 END, _ord) AS k FROM relationships WHERE relationship_type IN ('ultimate_parent', 'direct_parent')) WHERE k = 1)"


@query(UPSTREAM + " SELECT * FROM upstream", "relationships")
def preferred_upstream(spark, sf):
    return ladder.preferred_upstream(At(spark, sf).relationships)


@query("SELECT lei, legal_name, category, country_legal FROM domestic UNION ALL SELECT lei, legal_name, category, country_legal FROM parents", "domestic", "parents")
def combined_entities(spark, sf):
    a = At(spark, sf)
    return ladder.combine_entities(a.domestic, a.parents, a.domestic).select("lei", "legal_name", "category", "country_legal")


@query(f"{EDGES}, {DEGREES} SELECT * FROM degrees", "entities", "relationships")
def graph_degrees(spark, sf):
    return graph.degrees(*_graph(Shared(spark, sf)))


@query(f"{EDGES}, {REACH} SELECT lei, component, weakly_connected_component_size FROM comps", "entities", "relationships")
def component_sizes(spark, sf):
    return graph.components(*_graph(Shared(spark, sf)))


@query(f"{EDGES}, {PAGERANK} SELECT lei, round(r, 6) AS pagerank FROM pr{RANKS}", "entities", "relationships")
def pagerank(spark, sf):
    return r6(graph.pagerank(*_graph(Shared(spark, sf)), max_iter=RANKS, tol=0), "pagerank")


STEPS, TOLERANCE = 100, 1e-6  # graph.pagerank's own limits
MOVES = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT sum(abs(a.r - b.r)) FROM pr{k} a JOIN pr{k - 1} b USING (lei)) AS moved" for k in range(1, STEPS + 1))
EVERY = " UNION ALL ".join(f"SELECT {k} AS k, lei, r FROM pr{k}" for k in range(1, STEPS + 1))


@query(f"{EDGES}, {pagerank_sql(STEPS)}, moves AS ({MOVES}), stop AS (SELECT coalesce(min(k) FILTER (moved < (SELECT count(*) FROM nodes) * {TOLERANCE}), {STEPS}) AS k FROM moves) SELECT lei, round(r, 6) AS pagerank FROM ({EVERY}) JOIN stop USING (k)", "entities", "relationships")
def pagerank_settled(spark, sf):
    """Ranks of the first step whose change is small enough, as the operator finds it."""
    return r6(graph.pagerank(*_graph(Shared(spark, sf)), max_iter=STEPS, tol=TOLERANCE), "pagerank")


@query(f"{EDGES}, {CENTRALITY} SELECT lei, round(degree_centrality, 6) AS degree_centrality FROM centrality", "entities", "relationships")
def degree_centrality(spark, sf):
    return r6(graph.degree_centrality(*_graph(Shared(spark, sf))), "degree_centrality")


SUMMARY = f"{EDGES}, {DEGREES}, {REACH}, {PAGERANK}, {CENTRALITY}, summary AS (SELECT n.lei, legal_name, category, legal_form, country_legal AS country, city_legal AS city, in_degree, out_degree, weakly_connected_component_size, r AS pagerank, degree_centrality, in_degree + out_degree + weakly_connected_component_size + r * 1000 + degree_centrality * 100 AS size_proxy FROM nodes n LEFT JOIN entities USING (lei) JOIN degrees USING (lei) JOIN comps USING (lei) JOIN pr{RANKS} USING (lei) JOIN centrality USING (lei))"


def _summary(a: At) -> DataFrame:
    out = graph.graph_summary(a.entities, a.relationships, pagerank_iterations=RANKS, tol=0)
    return graph.size_proxy(out.withColumnsRenamed({"country_legal": "country", "city_legal": "city"}))


@query(f"{SUMMARY} SELECT lei, legal_name, category, legal_form, country, city, in_degree, out_degree, weakly_connected_component_size FROM summary", "entities", "relationships")
def graph_summary(spark, sf):
    a = Shared(spark, sf)
    out = graph.sorted_summary(graph.graph_summary(a.entities, a.relationships, ranks=False))
    return out.withColumnsRenamed({"country_legal": "country", "city_legal": "city"})


@query(f"{SUMMARY} SELECT lei, round(size_proxy, 4) AS size_proxy FROM summary", "entities", "relationships")
def size_proxy(spark, sf):
    return _summary(Shared(spark, sf)).select("lei", F.round("size_proxy", 4).alias("size_proxy"))


EXC = "exc AS (SELECT lei, exception_reason FROM (SELECT *, row_number() OVER (PARTITION BY lei ORDER BY _ord) AS k FROM exceptions) WHERE k = 1)"


@query(f"{EXC} SELECT lei, CAST(coalesce(exception_reason = 'NON_CONSOLIDATING', false) AS INT) AS is_non_consolidating, CAST(exception_reason IS NOT NULL AS INT) AS has_exception_filed FROM domestic LEFT JOIN exc USING (lei)", "domestic", "exceptions")
def exception_flags(spark, sf):
    a = At(spark, sf)
    return profile.with_exception_flags(a.domestic.select("lei"), a.exceptions)


@query("SELECT exception_reason, count(*) AS n FROM exceptions GROUP BY 1", "exceptions")
def exception_histogram(spark, sf):
    return pipelines.reporting_exceptions(pipelines.Inputs(At(spark, sf).domestic, At(spark, sf).parents, At(spark, sf).relationships, At(spark, sf).exceptions))["histogram"]


@query("SELECT lei FROM domestic WHERE lei NOT IN (SELECT source_lei FROM relationships)", "domestic", "relationships")
def exceptions_to_scan(spark, sf):
    a = At(spark, sf)
    return pipelines.reporting_exceptions(pipelines.Inputs(a.domestic, a.parents, a.relationships, a.exceptions))["to_scan"]


@query("SELECT CAST(greatest(1, least(30, CASE WHEN hi = lo THEN 1 ELSE floor((out_degree - lo) / ((hi - lo) / 30.0)) + 1 END)) AS INT) AS bin, count(*) AS n FROM degrees, (SELECT min(out_degree) AS lo, max(out_degree) AS hi FROM degrees) GROUP BY 1".join([f"{EDGES}, {DEGREES} ", ""]), "entities", "relationships")
def out_degree_histogram(spark, sf):
    return profile.out_degree_histogram(graph.degrees(*_graph(Shared(spark, sf))))


# ---- Names. ----


def clean_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim(upper(coalesce({x}, ''))), '[^A-Z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')"


def brand_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({clean_sql(x)}, '{text.suffix_pattern('MY')}', '', 'g'), '\\s+', ' ', 'g'))"


GENERIC = ", ".join(f"'{w}'" for w in rules.GENERIC_WORDS)
BRANDS = f"""brands AS (SELECT parent_lei, parent_name, brand_token, _ord FROM (SELECT lei AS parent_lei, legal_name AS parent_name, _ord, {brand_sql('legal_name')} AS brand_token, row_number() OVER (PARTITION BY {brand_sql('legal_name')} ORDER BY _ord) AS k FROM parents)
WHERE k = 1 AND length(brand_token) >= 4 AND length(array_to_string(list_filter(string_split(brand_token, ' '), lambda w: w <> '' AND w NOT IN ({GENERIC})), ' ')) >= 4)"""


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of up to 120 characters: one bit vector, folded over the other's characters."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = c THEN 1::HUGEINT << i ELSE 0::HUGEINT END))::HUGEINT)"
    return f"(length({a}) - bit_count(list_reduce(list_concat([{full}], {masks}), lambda s, m: (((s + (s & m)) | (s - (s & m))) & {full}))))"


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * {lcs_sql(a, b)} / (length({a}) + length({b})) END"


def words_sql(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def matched_sql(threshold: int = 90) -> str:
    """Every unlinked entity's name against every brand; the best of threshold or more."""
    return f"""cand AS (SELECT DISTINCT {clean_sql('legal_name')} AS name FROM domestic WHERE lei NOT IN (SELECT source_lei FROM relationships) AND {clean_sql('legal_name')} <> ''),
tokens AS (SELECT DISTINCT {brand_sql('name')} AS token FROM cand),
sets AS (SELECT token, brand_token, parent_lei, _ord, list_sort(list_distinct({words_sql('brand_token')})) AS x, list_sort(list_distinct({words_sql('token')})) AS y FROM tokens CROSS JOIN brands),
parts AS (SELECT *, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS common_, array_to_string(list_filter(x, lambda w: NOT list_contains(y, w)), ' ') AS only_a, array_to_string(list_filter(y, lambda w: NOT list_contains(x, w)), ' ') AS only_b FROM sets),
wholes AS (SELECT *, trim(common_ || ' ' || only_a) AS wa, trim(common_ || ' ' || only_b) AS wb FROM parts),
rated AS (SELECT token, brand_token, parent_lei, _ord, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN common_ <> '' AND (only_a = '' OR only_b = '') THEN 100.0
 ELSE greatest({ratio_sql('wa', 'wb')}, CASE WHEN common_ = '' THEN 0.0 ELSE 200.0::DOUBLE * length(common_) / (length(common_) + length(wa)) END, CASE WHEN common_ = '' THEN 0.0 ELSE 200.0::DOUBLE * length(common_) / (length(common_) + length(wb)) END) END AS raw FROM wholes),
scored AS (SELECT name, parent_lei, brand_token, _ord, CASE WHEN contains(' ' || name || ' ', ' ' || brand_token || ' ') THEN 100.0::DOUBLE WHEN raw >= {threshold} AND NOT list_has_any(list_filter({words_sql('brand_token')}, lambda w: w NOT IN ({GENERIC})), {words_sql('name')}) THEN greatest(raw - {rules.MISSING_BRAND_PENALTY}, 0) ELSE raw END AS score
 FROM cand JOIN rated ON token = {brand_sql('name')}),
best_names AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, _ord) AS k FROM scored WHERE score >= {threshold}) WHERE k = 1),
matched AS (SELECT lei, parent_lei AS matched_parent_lei, brand_token, score AS match_score, 'legal_name' AS match_field FROM domestic JOIN best_names ON name = {clean_sql('legal_name')} WHERE lei NOT IN (SELECT source_lei FROM relationships))"""


MATCHED = matched_sql()


@query(f"SELECT lei, {clean_sql('legal_name')} AS legal_name_clean FROM entities", "entities")
def clean_names(spark, sf):
    return At(spark, sf).entities.select("lei", text.clean_company_name("legal_name").alias("legal_name_clean"))


@query(f"{BRANDS} SELECT parent_lei, parent_name, brand_token FROM brands", "parents")
def brand_tokens(spark, sf):
    return names.brand_tokens(At(spark, sf).parents).select("parent_lei", "parent_name", "brand_token")


def _matches(a: At, threshold: int = 90) -> DataFrame:
    return names.match_names(a.domestic, names.brand_tokens(a.parents), a.relationships.select(F.col("source_lei").alias("lei")), threshold)


@query(f"{BRANDS}, {matched_sql(100)} SELECT * FROM matched", "domestic", "parents", "relationships")
def name_match_exact(spark, sf):
    return _matches(Shared(spark, sf), 100)


@query(f"{BRANDS}, {MATCHED} SELECT lei, matched_parent_lei, brand_token, round(match_score, 6) AS match_score, match_field FROM matched", "domestic", "parents", "relationships")
def name_match_fuzzy(spark, sf):
    return r6(_matches(Shared(spark, sf)), "match_score")


@query(f"{BRANDS}, {matched_sql(80)} SELECT lei, matched_parent_lei, brand_token, round(match_score, 6) AS match_score, match_field FROM matched", "domestic", "parents", "relationships")
def name_match_loose(spark, sf):
    """At 80, where a brand may match without a distinctive word of its own."""
    return r6(_matches(Shared(spark, sf), 80), "match_score")


@query(f"{BRANDS}, {MATCHED} SELECT lei AS source_lei, matched_parent_lei AS target_lei, 'inferred_name_match' AS relationship_type, 'INFERRED' AS relationship_status, round(match_score, 6) AS inference_score FROM matched WHERE match_score >= 95", "domestic", "parents", "relationships")
def inferred_name_edges(spark, sf):
    return r6(names.inferred_edges(_matches(At(spark, sf)), 95).select("source_lei", "target_lei", "relationship_type", "relationship_status", "inference_score"), "inference_score")


SPREAD = ("mean_score", "std_score", "min_score", "p25_score", "p50_score", "p75_score", "max_score")


@query(f"""{BRANDS}, {matched_sql(80)} SELECT count(*) AS total_matches, count(*) FILTER (match_score >= 90) AS high_confidence, count(*) FILTER (match_score >= 80 AND match_score < 90) AS medium_confidence, count(DISTINCT brand_token) AS unique_brands, count(DISTINCT matched_parent_lei) AS unique_parents,
round(avg(match_score), 6) AS mean_score, round(stddev(match_score), 6) AS std_score, round(min(match_score), 6) AS min_score, round(quantile_cont(match_score, 0.25), 6) AS p25_score, round(quantile_cont(match_score, 0.5), 6) AS p50_score, round(quantile_cont(match_score, 0.75), 6) AS p75_score, round(max(match_score), 6) AS max_score FROM matched""", "domestic", "parents", "relationships")
def name_match_summary(spark, sf):
    return r6(names.match_summary(_matches(At(spark, sf), 80)), *SPREAD)


@query(f"SELECT e.lei, cik, ticker, title, CAST(cik IS NOT NULL AS INT) AS appears_in_edgar FROM entities e LEFT JOIN tickers t ON {clean_sql('e.legal_name')} = {clean_sql('t.title')}", "entities", "tickers")
def edgar_match(spark, sf):
    a = At(spark, sf)
    return names.match_tickers(a.entities, a.tickers).select("lei", "cik", "ticker", "title", "appears_in_edgar")


def registry_sql(x: str) -> str:
    out = clean_sql(x)
    for p, to in rules.REGISTRY_REPLACEMENTS:
        out = f"regexp_replace({out}, '{p}', '{to}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"SELECT ctos_name, {registry_sql('ctos_name')} AS ctos_name_norm FROM registry", "registry")
def registry_names(spark, sf):
    return At(spark, sf).registry.select("ctos_name", text.registry_name("ctos_name").alias("ctos_name_norm"))


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def registry_matches_sql(threshold: int = 95) -> str:
    """Every name against every registry name that its length admits; the best, if it is safe."""
    t = threshold / 100
    sort = lambda x: f"array_to_string(list_sort({words_sql(x)}), ' ')"
    tokens = lambda x: f"list_filter({words_sql(x)}, lambda w: length(w) > 1 AND w NOT IN ({_listed(rules.REGISTRY_GENERIC)}))"
    return f"""firsts AS (SELECT ctos_name, ctos_url, ctos_registration_no, norm, _ord AS choice FROM (SELECT *, {registry_sql('ctos_name')} AS norm, row_number() OVER (PARTITION BY {registry_sql('ctos_name')} ORDER BY _ord) AS k FROM registry) WHERE k = 1),
owns AS (SELECT lei, legal_name, {registry_sql('legal_name')} AS own FROM domestic WHERE {registry_sql('legal_name')} <> ''),
probes AS (SELECT own, {sort('own')} AS oa FROM (SELECT DISTINCT own FROM owns) WHERE own NOT IN (SELECT norm FROM firsts)), sorted_ AS (SELECT *, {sort('norm')} AS ob FROM firsts),
tried AS (SELECT own, norm, choice, ctos_name, ctos_url, ctos_registration_no, {ratio_sql('oa', 'ob')} AS score FROM probes JOIN sorted_ ON length(oa) <= length(ob) * {(2 - t) / t} + 1 AND length(ob) <= length(oa) * {(2 - t) / t} + 1),
tops AS (SELECT *, {tokens('own')} AS ta, {tokens('norm')} AS tb FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, choice) AS k FROM tried WHERE score >= {threshold}) WHERE k = 1),
strong AS (SELECT *, len(list_filter(list_distinct(list_intersect(ta, tb)), lambda w: w NOT IN ({_listed(rules.REGISTRY_WEAK)}))) AS n, ta[1] AS fa, tb[1] AS fb FROM tops WHERE len(ta) > 0 AND len(tb) > 0),
reg AS (SELECT lei, legal_name, ctos_name, ctos_url, ctos_registration_no, 100.0::DOUBLE AS ctos_match_score, 'exact' AS ctos_match_method FROM owns JOIN firsts ON norm = own
 UNION ALL SELECT lei, legal_name, ctos_name, ctos_url, ctos_registration_no, round(score, 4), 'fuzzy' FROM owns JOIN (SELECT * FROM strong WHERE n > 0 AND (fa = fb OR n >= 2 OR {ratio_sql('fa', 'fb')} >= {rules.REGISTRY_FIRST_TOKEN_RATIO})) USING (own))"""


REGISTRY = registry_matches_sql()


@query(f"{REGISTRY} SELECT *, 1 AS ctos_registered_malaysia FROM reg WHERE ctos_match_method = 'exact'", "domestic", "registry")
def registry_match_exact(spark, sf):
    a = At(spark, sf)
    return names.match_registry(a.domestic, a.registry).where("ctos_match_method = 'exact'")


@query(f"{REGISTRY} SELECT *, 1 AS ctos_registered_malaysia FROM reg", "domestic", "registry")
def registry_match(spark, sf):
    a = At(spark, sf)
    return names.match_registry(a.domestic, a.registry)


@query(f"{registry_matches_sql(85)} SELECT *, 1 AS ctos_registered_malaysia FROM reg", "domestic", "registry")
def registry_match_loose(spark, sf):
    a = At(spark, sf)
    return names.match_registry(a.domestic, a.registry, 85)


# ---- Addresses. ----


def _address_sql() -> str:
    line = "trim(upper(coalesce(address_line1, '')))"
    for short, full in rules.country_rules("MY").abbreviations.items():
        line = f"regexp_replace({line}, '\\b{short}\\b', '{full}', 'g')"
    line = f"trim(regexp_replace(regexp_replace({line}, '[^A-Z0-9\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"keyed AS (SELECT lei, {line} || '|' || trim(coalesce(postal_code, 'None')) AS cluster_address_key FROM addresses WHERE {line} <> '')"


CLUSTERS = f"""{_address_sql()}, sizes AS (SELECT cluster_address_key, count(*) AS cluster_size, row_number() OVER (ORDER BY count(*) DESC, cluster_address_key) - 1 AS address_cluster_id FROM keyed GROUP BY 1 HAVING count(*) >= 3),
clusters AS (SELECT lei, address_cluster_id, cluster_size, cluster_address_key, contains(cluster_address_key, 'LABUAN') AS is_office_hotel FROM keyed JOIN sizes USING (cluster_address_key))"""
INFERRED = """anchors AS (SELECT c.address_cluster_id, c.lei, r.target_lei, r._ord FROM clusters c JOIN relationships r ON r.source_lei = c.lei),
given AS (SELECT address_cluster_id, arg_min(target_lei, _ord) AS inferred_parent_lei, count(DISTINCT lei) AS anchors FROM anchors GROUP BY 1),
inferred AS (SELECT lei, inferred_parent_lei, 'address_cluster' AS inference_source,
 round(greatest(0.2, least(0.8, CASE WHEN cluster_size <= 5 THEN 0.70 WHEN cluster_size <= 20 THEN 0.55 WHEN cluster_size <= 100 THEN 0.40 ELSE 0.30 END - CASE WHEN is_office_hotel THEN 0.1 ELSE 0 END + CASE WHEN anchors > 1 THEN least(0.1, 0.03 * (anchors - 1)) ELSE 0 END)), 4)::DOUBLE AS confidence,
 CASE WHEN cluster_size <= 5 THEN 'small_shared_address' WHEN cluster_size <= 20 THEN 'medium_shared_address' WHEN cluster_size <= 100 THEN 'large_registered_address' ELSE 'very_large_registered_address' END || CASE WHEN is_office_hotel THEN '_office_hotel_discount' ELSE '' END || CASE WHEN anchors > 1 THEN '_multi_anchor' ELSE '' END AS confidence_basis,
 cluster_size, is_office_hotel FROM clusters JOIN given USING (address_cluster_id) WHERE lei NOT IN (SELECT source_lei FROM relationships))"""


@query(f"{CLUSTERS} SELECT * FROM clusters", "addresses")
def address_clusters(spark, sf):
    return clusters.cluster_by_address(At(spark, sf).addresses)


@query(f"{CLUSTERS}, {INFERRED} SELECT * FROM inferred", "addresses", "relationships")
def address_inferred_parents(spark, sf):
    a = Shared(spark, sf)
    return clusters.infer_cluster_parents(clusters.cluster_by_address(a.addresses), a.relationships)


@query(f"{CLUSTERS} SELECT count(*) AS total_clustered_entities, count(DISTINCT address_cluster_id) AS num_clusters, max(cluster_size) AS largest_cluster, CAST(sum(is_office_hotel::INT) AS BIGINT) AS office_hotel_entities, round(count(*) * 1.0 / count(DISTINCT address_cluster_id), 1) AS avg_cluster_size FROM clusters", "addresses")
def address_cluster_summary(spark, sf):
    return clusters.cluster_summary(clusters.cluster_by_address(At(spark, sf).addresses))


# ---- The ladder. ----

FIRST = "SELECT source_lei AS lei, arg_min(target_lei, _ord) AS {kind}_lei FROM relationships WHERE relationship_type = '{kind}' GROUP BY 1"
KNOWN = ", ".join(f"'{s}'" for s in rules.KNOWN_SOURCES)
GUESSED = ", ".join(f"'{s}'" for s in rules.INFERRED_SOURCES)


def _rung(name: str) -> str:
    """One output column of the ladder, rung by rung."""
    up = "chain_type = 'ultimate_parent'"
    rungs = [
        ("o.uie_country IS NOT NULL", {"lei": "o.uie_lei", "name": "o.uie_name", "country": "o.uie_country", "source": "coalesce(o.uie_source, 'manual_verified')", "tier": "coalesce(o.evidence_tier, 'A_manual_verified_uie')", "confidence": "round(coalesce(try_cast(o.uie_confidence AS DOUBLE), 0.95), 4)"}),
        ("ue.country_legal IS NOT NULL", {"lei": "ultimate_parent_lei", "name": "ue.legal_name", "country": "ue.country_legal", "source": "'gleif_ultimate_parent'", "tier": "'A_known_ultimate_parent'", "confidence": "1.0"}),
        ("chain_country IS NOT NULL", {"lei": "chain_lei", "name": "chain_name", "country": "chain_country", "source": f"CASE WHEN {up} THEN 'gleif_upstream_ultimate_parent' ELSE 'gleif_upstream_direct_parent' END", "tier": f"CASE WHEN {up} THEN 'A_known_upstream_ultimate_parent' ELSE 'B_known_upstream_direct_parent' END", "confidence": f"CASE WHEN {up} THEN 0.97 ELSE 0.9 END"}),
        ("de.country_legal IS NOT NULL", {"lei": "direct_parent_lei", "name": "de.legal_name", "country": "de.country_legal", "source": "'gleif_direct_parent'", "tier": "'B_known_direct_parent'", "confidence": "0.85"}),
        ("me.country_legal IS NOT NULL", {"lei": "m.matched_parent_lei", "name": "me.legal_name", "country": "me.country_legal", "source": "'phase1_name_match'", "tier": "CASE WHEN match_score / 100 >= 0.9 THEN 'C_name_match_high' ELSE 'D_name_match_medium' END", "confidence": "round(match_score / 100, 4)"}),
        ("ae.country_legal IS NOT NULL", {"lei": "i.inferred_parent_lei", "name": "ae.legal_name", "country": "ae.country_legal", "source": "'phase2_address_cluster'", "tier": "'D_address_cluster'", "confidence": "round(confidence, 4)"}),
        ("p.predicted_parent_country IS NOT NULL", {"lei": "NULL", "name": "NULL", "country": "p.predicted_parent_country", "source": "'phase3_jurisdiction_model'", "tier": "'E_model_predicted_jurisdiction'", "confidence": "round(p.prediction_probability, 4)"}),
        ("exception_reason = 'NON_CONSOLIDATING'", {"lei": "NULL", "name": "NULL", "country": "NULL", "source": "'reporting_exception_no_country'", "tier": "'B_subsidiary_signal_no_uie'", "confidence": "0.7"}),
        ("true", {"lei": "NULL", "name": "NULL", "country": "NULL", "source": "'unassigned'", "tier": "'U_unassigned'", "confidence": "0.0"}),
    ]
    return "CASE " + " ".join(f"WHEN {when} THEN {out[name]}" for when, out in rungs) + " END"


LADDER = f"""{EXC}, {UPSTREAM}, {BRANDS}, {MATCHED}, {CLUSTERS}, {INFERRED}, {REGISTRY},
climbed AS (SELECT d.*, dp.direct_parent_lei, up.ultimate_parent_lei, CASE WHEN u.chain_parent_lei NOT IN (dp.direct_parent_lei, d.lei) THEN u.chain_parent_lei END AS chain_lei, u.chain_parent_relationship_type AS raw_type
 FROM domestic d LEFT JOIN ({FIRST.format(kind='direct_parent')}) dp USING (lei) LEFT JOIN ({FIRST.format(kind='ultimate_parent')}) up USING (lei) LEFT JOIN upstream u ON u.direct_parent_lei = dp.direct_parent_lei),
chained AS (SELECT c.*, e.legal_name AS chain_name, e.country_legal AS chain_country, CASE WHEN chain_lei IS NOT NULL THEN raw_type END AS chain_type FROM climbed c LEFT JOIN entities e ON e.lei = chain_lei),
uie AS (SELECT 'MY' AS host_country, x.lei, x.legal_name, x.country_legal AS entity_country, x.direct_parent_lei, de.legal_name AS direct_parent_name, de.country_legal AS direct_parent_country, x.ultimate_parent_lei, ue.legal_name AS ultimate_parent_name, ue.country_legal AS ultimate_parent_country,
 chain_lei AS chain_parent_lei, chain_name AS chain_parent_name, chain_country AS chain_parent_country, chain_type AS chain_parent_relationship_type, {_rung('lei')} AS uie_lei, {_rung('name')} AS uie_name, {_rung('country')} AS uie_country, {_rung('source')} AS uie_source, {_rung('tier')} AS evidence_tier, CAST({_rung('confidence')} AS DOUBLE) AS uie_confidence,
 CAST({_rung('source')} IN ({KNOWN}) AS INT) AS is_known_uie, CAST({_rung('source')} IN ({GUESSED}) AS INT) AS is_inferred_uie, CAST(coalesce(exception_reason = 'NON_CONSOLIDATING', false) AS INT) AS is_non_consolidating, exception_reason,
 m.matched_parent_lei, me.legal_name AS matched_parent_name, me.country_legal AS matched_parent_country, m.brand_token, m.match_score, i.inferred_parent_lei, ae.legal_name AS address_parent_name, ae.country_legal AS address_parent_country, i.confidence,
 p.predicted_parent_country, p.prediction_probability, p.confidence_gap, p.top3_countries, p.top3_probabilities, CAST(g.ctos_name IS NOT NULL AS INT) AS ctos_registered_malaysia, g.ctos_name, g.ctos_registration_no, g.ctos_match_score, g.ctos_match_method, g.ctos_url,
 o.override_reason, o.source_url, o.source_note
 FROM chained x LEFT JOIN entities de ON de.lei = x.direct_parent_lei LEFT JOIN entities ue ON ue.lei = x.ultimate_parent_lei LEFT JOIN exc ON exc.lei = x.lei LEFT JOIN matched m ON m.lei = x.lei LEFT JOIN entities me ON me.lei = m.matched_parent_lei
 LEFT JOIN inferred i ON i.lei = x.lei LEFT JOIN entities ae ON ae.lei = i.inferred_parent_lei LEFT JOIN predictions p ON p.lei = x.lei LEFT JOIN reg g ON g.lei = x.lei LEFT JOIN overrides o ON o.lei = x.lei)"""
LADDER_TABLES = ("entities", "relationships", "exceptions", "addresses", "predictions", "overrides", "registry")


def _evidence(a: At) -> tuple[DataFrame, DataFrame]:
    """Name matches and address clusters, which both the ladder and the score read."""
    return kept(a, "name-matches", lambda: _matches(a)), kept(a, "address-clusters", lambda: clusters.cluster_by_address(a.addresses))


def _assignments(a: At) -> DataFrame:
    """All customers as domestic entities of MY, with every kind of evidence at the operators' own thresholds."""
    matches, found = _evidence(a)
    inferred = clusters.infer_cluster_parents(found, a.relationships)
    registry = names.match_registry(a.domestic, a.registry)
    return ladder.build_uie_assignments(a.domestic, a.relationships, a.entities, exceptions=a.exceptions, name_matches=matches, address_inferred=inferred, jurisdiction_predictions=a.predictions, registry_matches=registry, overrides=a.overrides, host_scope=False)


@query(f"{LADDER} SELECT * FROM uie", *LADDER_TABLES)
def uie_assignments(spark, sf):
    return ladder.sorted_assignments(_assignments(Shared(spark, sf)))


@query("SELECT lei, legal_name, country_legal FROM domestic WHERE country_legal = 'SG'", "domestic")
def domestic_scope(spark, sf):
    return ladder.domestic_scope(At(spark, sf).domestic, "SG").select("lei", "legal_name", "country_legal")


@query("SELECT lei, legal_name, country_legal FROM domestic WHERE country_legal = 'ZZ' OR NOT EXISTS (SELECT 1 FROM domestic WHERE country_legal = 'ZZ')", "domestic")
def domestic_scope_without_host(spark, sf):
    """No entity of the host country: all of them are in scope."""
    return ladder.domestic_scope(At(spark, sf).domestic, "ZZ").select("lei", "legal_name", "country_legal")


@query(f"{LADDER} SELECT host_country, uie_country, count(lei) AS total_entities, CAST(sum(is_known_uie) AS BIGINT) AS known_uie_entities, CAST(sum(is_inferred_uie) AS BIGINT) AS inferred_uie_entities, round(avg(CAST(uie_confidence AS DECIMAL(18, 4))), 4) AS avg_confidence FROM uie WHERE uie_country IS NOT NULL GROUP BY 1, 2", *LADDER_TABLES)
def investor_economy_summary(spark, sf):
    return ladder.investor_summary(_assignments(Shared(spark, sf)))


MIX = """mix AS (SELECT host_country AS country, count(*) AS uie_rows, count(*) FILTER (uie_country <> host_country) AS foreign_uie_count, CAST(sum(is_known_uie) AS BIGINT) AS known_uie_count, count(*) FILTER (uie_source = 'phase3_jurisdiction_model') AS model_fallback_count,
count(*) FILTER (uie_source = 'gleif_ultimate_parent') AS gleif_ultimate, count(*) FILTER (uie_source = 'gleif_direct_parent') AS gleif_direct, count(*) FILTER (uie_source = 'phase2_address_cluster') AS address_cluster, count(*) FILTER (uie_source = 'phase1_name_match') AS name_match,
count(*) FILTER (uie_source = 'manual_verified') AS manual_verified, count(*) FILTER (uie_source = 'unassigned') AS unassigned, round(sum(is_known_uie) * 100.0 / count(*), 1) AS known_uie_share_pct, round(count(*) FILTER (uie_source = 'phase3_jurisdiction_model') * 100.0 / count(*), 1) AS model_fallback_share_pct FROM uie GROUP BY 1)"""


@query(f"{LADDER}, {MIX} SELECT * FROM mix", *LADDER_TABLES)
def uie_source_mix(spark, sf):
    return macro.uie_mix(_assignments(Shared(spark, sf)))


# ---- Score and review. ----

SCORED = f"""{SUMMARY}, {FLAGS}, {FOREIGN}, flagged AS (SELECT s.*, coalesce(has_parent_link, 0) AS has_parent_link, coalesce(has_ultimate_link, 0) AS has_ultimate_link, coalesce(foreign_parent, 0) AS foreign_parent, CAST(coalesce(exception_reason = 'NON_CONSOLIDATING', false) AS INT) AS is_non_consolidating, CAST(exception_reason IS NOT NULL AS INT) AS has_exception_filed,
 CAST(matched.lei IS NOT NULL AS INT) AS has_inferred_parent, CAST(c.lei IS NOT NULL AS INT) AS in_address_cluster, CAST(filers.lei IS NOT NULL AS INT) AS appears_in_edgar
 FROM summary s LEFT JOIN flags USING (lei) LEFT JOIN foreign_flags USING (lei) LEFT JOIN exc ON exc.lei = s.lei LEFT JOIN matched ON matched.lei = s.lei LEFT JOIN (SELECT DISTINCT lei FROM clusters) c ON c.lei = s.lei
 LEFT JOIN (SELECT DISTINCT e.lei FROM entities e JOIN tickers t ON {clean_sql('e.legal_name')} = {clean_sql('t.title')}) filers ON filers.lei = s.lei),
scaled AS (SELECT *, ln(1 + size_proxy) / greatest((SELECT max(ln(1 + size_proxy)) FROM flagged), 1.0) AS size_scaled FROM flagged),
scored_rows AS (SELECT *, 0.25 * size_scaled + 0.15 * appears_in_edgar + 0.15 * foreign_parent + 0.1 * has_inferred_parent + 0.05 * in_address_cluster + 0.05 * is_non_consolidating + 0.15 * (1 - has_parent_link) + 0.1 * (1 - has_ultimate_link) AS score,
 concat_ws(';', CASE WHEN size_scaled > 0.6 THEN 'large_network_presence' END, CASE WHEN appears_in_edgar = 1 THEN 'us_filing_presence' END, CASE WHEN foreign_parent = 1 THEN 'foreign_parent_signal' END, CASE WHEN has_inferred_parent = 1 THEN 'inferred_parent_match' END, CASE WHEN in_address_cluster = 1 THEN 'shared_address_cluster' END, CASE WHEN is_non_consolidating = 1 THEN 'non_consolidating_entity' END, CASE WHEN has_parent_link = 0 THEN 'missing_direct_parent' END, CASE WHEN has_ultimate_link = 0 THEN 'missing_ultimate_parent' END) AS reason_flags FROM scaled)"""
SCORE_TABLES = (*LADDER_TABLES, "tickers")


def _scored(a: At) -> DataFrame:
    out = _summary(a).join(graph.parent_flags(a.relationships), "lei", "left").join(graph.foreign_parents(a.relationships, a.entities), "lei", "left")
    out = profile.with_exception_flags(out, a.exceptions)
    filers = names.match_tickers(a.entities, a.tickers).where("appears_in_edgar = 1")
    matches, found = _evidence(a)
    for t, flag in ((matches, "has_inferred_parent"), (found, "in_address_cluster"), (filers, "appears_in_edgar")):
        out = out.join(t.select("lei").distinct().withColumn(flag, F.lit(1)), "lei", "left")
    return scoring.coverage_score(out)


@query(f"{LADDER}, {SCORED} SELECT lei, round(size_scaled, 6) AS size_scaled, round(score, 6) AS coverage_gap_score FROM scored_rows", *SCORE_TABLES)
def coverage_score(spark, sf):
    return r6(_scored(Shared(spark, sf)).select("lei", "size_scaled", "coverage_gap_score"), "size_scaled", "coverage_gap_score")


@query(f"{LADDER}, {SCORED} SELECT lei, reason_flags FROM scored_rows", *SCORE_TABLES)
def reason_flags(spark, sf):
    return _scored(Shared(spark, sf)).select("lei", "reason_flags")


def _any(column: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in markers) + ")"


FUND = "(" + _any("' ' || replace(upper(legal_name), '.', ' ') || ' '", rules.FUND_MARKERS) + " OR " + " OR ".join(f"starts_with(trim(regexp_replace(replace(upper(legal_name), '.', ' '), '\\s+', ' ', 'g')), '{p}')" for p in rules.FUND_PREFIXES) + ")"
TYPE = f"CASE WHEN trim(coalesce(given_type, '')) <> '' THEN given_type WHEN {_any('upper(legal_name)', rules.NOMINEE_MARKERS)} THEN 'nominee_or_custodian' WHEN {FUND} THEN 'fund_or_product_vehicle' WHEN uie_source = 'manual_verified' THEN 'manual_verified_entity' WHEN contains(upper(legal_name), 'BANK') THEN 'financial_institution' ELSE 'operating_or_holding_company' END"
PENALTY = "CASE uie_source " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in rules.SOURCE_PENALTY.items()) + f" ELSE {rules.OTHER_PENALTY} END"
WEAK = ", ".join(f"'{s}'" for s in rules.WEAK_SOURCES)
SOURCE_REASON = " ".join(f"WHEN uie_source = '{s}' THEN '{r}'" for s, r in rules.SOURCE_REASONS.items())
REVIEW = f"""typed AS (SELECT s.lei, s.legal_name, round(s.score, 6) AS coverage_gap_priority_score, s.score, s.reason_flags, u.uie_country, u.uie_source, u.ctos_registered_malaysia, t.review_status AS given_status, t.review_note, {TYPE.replace('legal_name', 's.legal_name').replace('given_type', 't.entity_type').replace('uie_source', 'u.uie_source')} AS entity_type
 FROM scored_rows s JOIN uie u ON u.lei = s.lei LEFT JOIN statuses t ON t.lei = s.lei),
queue AS (SELECT lei, legal_name, entity_type, coverage_gap_priority_score, reason_flags, uie_country, uie_source, review_note, round(greatest(0, least(1, score + {PENALTY} + ctos_registered_malaysia * 0.02 - CASE WHEN entity_type = 'fund_or_product_vehicle' THEN 0.2 ELSE 0 END - CASE WHEN entity_type = 'nominee_or_custodian' THEN 0.12 ELSE 0 END)), 4) AS review_priority_score,
 CASE WHEN entity_type = 'fund_or_product_vehicle' THEN 'fund_product_vehicle_rule_applied' WHEN entity_type = 'nominee_or_custodian' THEN 'nominee_or_custodian_rule_applied' {SOURCE_REASON} WHEN score >= 0.4 THEN 'known_uie_but_high_coverage_gap' ELSE 'lower_priority_known_uie' END AS review_reason,
 CASE WHEN trim(coalesce(given_status, '')) <> '' THEN given_status WHEN uie_source = 'manual_verified' THEN 'verified' WHEN entity_type = 'fund_or_product_vehicle' THEN 'product_vehicle_rule_applied' WHEN entity_type = 'nominee_or_custodian' THEN 'nominee_or_custodian_rule_applied' ELSE 'todo' END AS review_status
 FROM typed WHERE uie_source IN ({WEAK}) OR score >= 0.4)"""
QUEUE_COLUMNS = ["lei", "legal_name", "review_priority_score", "review_reason", "review_status", "entity_type", "review_note", "coverage_gap_priority_score", "reason_flags", "uie_country", "uie_source"]
REVIEW_TABLES = (*SCORE_TABLES, "statuses")


def _queue(a: At, limit: int | None = None) -> DataFrame:
    scored = _scored(a).join(a.domestic.select("lei"), "lei", "left_semi")
    return scoring.review_targets(scored, kept(a, "assignments", lambda: _assignments(a)), a.statuses, limit)


@query(f"{LADDER}, {SCORED}, {REVIEW} SELECT {', '.join(QUEUE_COLUMNS)} FROM queue", *REVIEW_TABLES)
def review_targets(spark, sf):
    return r6(_queue(Shared(spark, sf)).select(*QUEUE_COLUMNS), "coverage_gap_priority_score")


@query(f"{LADDER}, {SCORED}, {REVIEW} SELECT lei, legal_name, review_status FROM queue WHERE entity_type = 'fund_or_product_vehicle'", *REVIEW_TABLES)
def product_vehicle_targets(spark, sf):
    return scoring.split_vehicles(_queue(Shared(spark, sf)))[1].select("lei", "legal_name", "review_status")


@query(f"SELECT lei, {TYPE.replace('given_type', 'NULL').replace('uie_source', 'NULL')} AS entity_type FROM entities", "entities")
def entity_type_rules(spark, sf):
    null = F.lit(None).cast("string")
    return At(spark, sf).entities.select("lei", scoring.entity_type(F.col("legal_name"), null, null).alias("entity_type"))


@query("""SELECT e.lei, e.legal_name, s.lei AS gleif_candidate_lei, s.country_legal AS gleif_candidate_country, s.rank AS gleif_candidate_rank, coalesce(s.total_results, 0) AS gleif_total_results, trim(e.legal_name) AS gleif_search_query,
CASE WHEN s.lei IS NULL THEN 'no_candidate' WHEN s.lei = e.lei THEN 'self_entity_found' WHEN e.country_legal <> s.country_legal THEN 'candidate_country_differs_from_current_uie' ELSE 'candidate_for_review' END AS review_flag
FROM entities e LEFT JOIN searches s ON s.query = trim(e.legal_name)""", "entities", "searches")
def search_benchmark(spark, sf):
    a = At(spark, sf)
    null = F.lit(None).cast("string")
    targets = a.entities.select("lei", "legal_name", null.alias("review_priority_score"), null.alias("review_status"), null.alias("entity_type"), F.col("country_legal").alias("uie_country"), null.alias("uie_source"))
    return scoring.search_benchmark(targets, a.searches).select("lei", "legal_name", "gleif_candidate_lei", "gleif_candidate_country", "gleif_candidate_rank", "gleif_total_results", "gleif_search_query", "review_flag")


# ---- Macro. ----


def _wide(a: At) -> DataFrame:
    """The position table in the shape of the published file, with both directions and a row that must not count."""
    p = a.positions.select("host", "parent", F.col("amount").cast("double").alias("amount"))
    fixed = lambda d, e, v: p.select(F.concat(F.lit("name "), "host").alias("COUNTRY"), F.concat(F.lit("name "), "parent").alias("COUNTERPART_COUNTRY"), F.lit(d).alias("DI_DIRECTION"), F.lit(e).alias("DI_ENTITY"), F.lit(rules.POSITION_INSTRUMENT).alias("INSTR_ASSET"), F.lit(rules.POSITION_ENTRY[d]).alias("ACCOUNTING_ENTRY"), v.cast("string").alias("2023"))
    return fixed("Inward", "All entities", F.col("amount")).unionByName(fixed("Outward", "All entities", F.col("amount") * 2)).unionByName(fixed("Inward", "Resident SPEs", F.col("amount")))


def _positions(a: At, direction: str) -> DataFrame:
    codes = {f"name {adapter.ISO[i:i + 2]}": adapter.ISO[i : i + 2] for i in range(0, 50, 2)}
    return macro.positions(_wide(a), direction, {k: v for k, v in codes.items() if v in rules.HOSTS}, codes)


INWARD = f"inward AS (SELECT host, parent, CAST(amount AS DOUBLE) AS fdi_usd_mn FROM positions WHERE host IN ({adapter.HOST_LIST}))"
OUTWARD = f"outward AS (SELECT host, parent, CAST(amount AS DOUBLE) * 2 AS fdi_usd_mn FROM positions WHERE host IN ({adapter.HOST_LIST}))"
#: Bilateral counts with every country as a host: known parents by the entity's own country.
COUNTS = f"""counts AS (SELECT entity_country AS host, uie_country AS parent, count(*) AS entity_count FROM uie WHERE is_known_uie = 1 AND regexp_matches(uie_country, '^[A-Z]{{2}}$') AND entity_country IN ({adapter.HOST_LIST}) GROUP BY 1, 2)"""


def _counts(a: At) -> DataFrame:
    own = _assignments(a).withColumn("host_country", F.col("entity_country")).where(F.col("host_country").isin(rules.HOSTS))
    return macro.bilateral_counts(own)


@query(f"{INWARD} SELECT host, parent, round(fdi_usd_mn, 6) AS fdi_usd_mn FROM inward", "positions")
def cdis_positions(spark, sf):
    return r6(_positions(At(spark, sf), "Inward"), "fdi_usd_mn")


@query(f"{LADDER}, {COUNTS} SELECT * FROM counts", *LADDER_TABLES)
def bilateral_counts(spark, sf):
    return _counts(Shared(spark, sf))


@query(f"{LADDER}, {MIX.replace('host_country', 'entity_country')}, {INWARD} SELECT country, foreign_uie_count, round(fdi, 6) AS inward_fdi_usd_bn, round(foreign_uie_count / fdi, 6) AS inward_lei_density FROM mix LEFT JOIN (SELECT host AS country, sum(fdi_usd_mn) / 1000 AS fdi FROM inward GROUP BY 1) USING (country)", *LADDER_TABLES, "positions")
def inward_density(spark, sf):
    a = Shared(spark, sf)
    mix = macro.uie_mix(_assignments(a).withColumn("host_country", F.col("entity_country")))
    return r6(macro.inward_density(mix, _positions(a, "Inward")).select("country", "foreign_uie_count", "inward_fdi_usd_bn", "inward_lei_density"), "inward_fdi_usd_bn", "inward_lei_density")


BILATERAL = f"bilateral AS (SELECT c.parent AS source, c.host AS destination, entity_count, fdi_usd_mn, fdi_usd_mn / 1000 AS fdi_usd_bn, entity_count / (fdi_usd_mn / 1000) AS outward_lei_density FROM counts c JOIN outward o ON o.host = c.parent AND o.parent = c.host WHERE c.parent IN ({adapter.HOST_LIST}))"


@query(f"{LADDER}, {COUNTS}, {OUTWARD}, {BILATERAL} SELECT source, destination, entity_count, round(fdi_usd_mn, 6) AS fdi_usd_mn, round(fdi_usd_bn, 6) AS fdi_usd_bn, round(outward_lei_density, 6) AS outward_lei_density FROM bilateral", *LADDER_TABLES, "positions")
def outward_bilateral(spark, sf):
    a = Shared(spark, sf)
    return r6(macro.outward_bilateral(_counts(a), _positions(a, "Outward")), "fdi_usd_mn", "fdi_usd_bn", "outward_lei_density")


@query(f"{LADDER}, {COUNTS}, {OUTWARD}, {BILATERAL} SELECT source AS country, count(DISTINCT destination) AS destination_count, CAST(sum(entity_count) AS BIGINT) AS my_owned_or_source_owned_leis, round(sum(fdi_usd_mn), 6) AS outward_fdi_usd_mn, round(sum(fdi_usd_mn) / 1000, 6) AS outward_fdi_usd_bn, round(sum(entity_count) / (sum(fdi_usd_mn) / 1000), 6) AS asean_outward_lei_density FROM bilateral GROUP BY 1", *LADDER_TABLES, "positions")
def outward_source_summary(spark, sf):
    a = Shared(spark, sf)
    return r6(macro.outward_source_summary(macro.outward_bilateral(_counts(a), _positions(a, "Outward"))), "outward_fdi_usd_mn", "outward_fdi_usd_bn", "asean_outward_lei_density")


RANKED = f"""{LADDER}, {COUNTS}, {INWARD}, pairs AS (SELECT host, entity_count AS x, fdi_usd_mn AS y FROM counts JOIN inward USING (host, parent)), both_ AS (SELECT * FROM pairs UNION ALL SELECT 'ALL', x, y FROM pairs),
ranked AS (SELECT host, rank() OVER (PARTITION BY host ORDER BY x) + (count(*) OVER (PARTITION BY host, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY host ORDER BY y) + (count(*) OVER (PARTITION BY host, y) - 1) / 2.0 AS ry FROM both_),
rhos AS (SELECT host, count(*) AS n_pairs, corr(rx, ry) AS rho FROM ranked GROUP BY 1 HAVING count(*) >= 3 OR host = 'ALL')"""
#: Student's t with a whole number of degrees of freedom has a finite sum in sine and cosine of atan(t / sqrt(df)).
TAILS = """angles AS (SELECT *, n_pairs - 2 AS df, atan(abs(rho) / sqrt(1 - rho * rho)) AS a FROM rhos),
tails AS (SELECT host, n_pairs, rho, CASE WHEN n_pairs < 3 OR rho IS NULL OR isnan(rho) THEN NULL WHEN abs(rho) >= 1 THEN 0.0 WHEN df % 2 = 0 THEN 1 - sin(a) * list_sum(list_transform(range(df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * cos(a) ** (2 * k)))
 ELSE 1 - 2 / pi() * (a + coalesce(sin(a) * list_sum(list_transform(range((df - 1) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * cos(a) ** (2 * k + 1))), 0)) END AS p_value FROM angles)"""


@query(f"{RANKED} SELECT host, n_pairs, round(rho, 6) AS rho FROM rhos", *LADDER_TABLES, "positions")
def spearman_by_host(spark, sf):
    a = Shared(spark, sf)
    return r6(macro.spearman_by_host(_counts(a), _positions(a, "Inward"), with_p=False), "rho")


@query(f"{RANKED}, {TAILS} SELECT host, n_pairs, round(rho, 6) AS rho, round(p_value, 6) AS p_value, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' WHEN p_value < 0.1 THEN '.' ELSE '' END AS stars FROM tails", *LADDER_TABLES, "positions")
def spearman_significance(spark, sf):
    a = Shared(spark, sf)
    return r6(macro.spearman_by_host(_counts(a), _positions(a, "Inward")), "rho", "p_value")


@query(f"{LADDER}, {COUNTS}, {INWARD} SELECT parent, CAST(sum(entity_count) AS BIGINT) AS total_entities, round(sum(fdi_usd_mn), 6) AS total_fdi_usd_mn, count(DISTINCT host) AS n_hosts, round(sum(fdi_usd_mn) / 1000, 3) AS fdi_usd_bn, round(sum(entity_count) / (sum(fdi_usd_mn) / 1000) * 10, 1) AS entities_per_10bn FROM counts JOIN inward USING (host, parent) GROUP BY 1 HAVING sum(fdi_usd_mn) >= 500", *LADDER_TABLES, "positions")
def entities_per_10bn(spark, sf):
    a = Shared(spark, sf)
    return r6(macro.entities_per_10bn(_counts(a), _positions(a, "Inward")), "total_fdi_usd_mn").withColumn("fdi_usd_bn", F.round("fdi_usd_bn", 3))


@query("SELECT 'domestic' AS metric, count(*) AS n FROM domestic UNION ALL SELECT 'relationships', count(*) FROM relationships UNION ALL SELECT 'exceptions', count(*) FROM exceptions UNION ALL SELECT 'addresses', count(*) FROM addresses", "domestic", "relationships", "exceptions", "addresses")
def raw_coverage(spark, sf):
    a = At(spark, sf)
    return macro.raw_coverage({n: getattr(a, n) for n in ("domestic", "relationships", "exceptions", "addresses")})


# ---- Models' inputs, and models. ----

REGION = "CASE " + " ".join(f"WHEN c IN ({', '.join(repr(x) for x in codes)}) THEN '{r}'" for r, codes in rules.REGIONS.items()) + " ELSE 'OTHER' END"
LABELS = f"""labeled AS (SELECT lei, c FROM (SELECT r.source_lei AS lei, p.country_legal AS c, row_number() OVER (PARTITION BY r.source_lei ORDER BY r._ord) AS k FROM relationships r JOIN parents p ON p.lei = r.target_lei) WHERE k = 1),
once AS (SELECT lei, c, CASE WHEN count(*) OVER (PARTITION BY c) >= 15 THEN c ELSE {REGION} END AS b FROM labeled), labels_ AS (SELECT lei, c AS parent_country, CASE WHEN count(*) OVER (PARTITION BY b) < 2 THEN 'OTHER' ELSE b END AS parent_bucket FROM once)"""


@query(f"{LABELS} SELECT * FROM labels_", "relationships", "parents")
def jurisdiction_labels(spark, sf):
    a = At(spark, sf)
    return jurisdiction.training_labels(a.relationships, a.parents)


@query(f"""{SUMMARY}, {EXC} SELECT d.lei, coalesce(d.category, 'UNKNOWN') AS category_cat, CASE WHEN d.legal_form IN (SELECT legal_form FROM domestic GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) THEN d.legal_form ELSE 'OTHER' END AS legal_form_cat, coalesce(n, 0) AS city_frequency, CAST(coalesce(year(try_cast(registered_at AS DATE)), 0) AS INT) AS registration_year,
CAST(len(list_filter(string_split_regex(d.legal_name, '\\s+'), lambda w: w <> '')) AS INT) AS name_token_count, CAST(length(d.legal_name) AS INT) AS name_length, {', '.join(f"CAST(regexp_matches(upper(d.legal_name), '{p}') AS INT) AS {n}" for n, p in rules.country_rules('MY').name_features)},
CAST(coalesce(exception_reason = 'NON_CONSOLIDATING', false) AS INT) AS is_non_consolidating, CAST(exception_reason IS NOT NULL AS INT) AS has_exception,
s.in_degree::DOUBLE AS in_degree, s.out_degree::DOUBLE AS out_degree, round(s.pagerank, 6) AS pagerank, round(s.degree_centrality, 6) AS degree_centrality, s.weakly_connected_component_size::DOUBLE AS weakly_connected_component_size
FROM domestic d LEFT JOIN (SELECT city_legal, count(*) AS n FROM domestic WHERE city_legal IS NOT NULL GROUP BY 1) USING (city_legal) LEFT JOIN exc ON exc.lei = d.lei LEFT JOIN summary s ON s.lei = d.lei""", "entities", "relationships", "exceptions")
def jurisdiction_features(spark, sf):
    a = Shared(spark, sf)
    return r6(jurisdiction.features(a.domestic, _summary(a), a.exceptions), "pagerank", "degree_centrality")


def country_model(a: At, **train) -> dict:
    """The model phase as the product runs it: labels with those of sure name matches, graph columns, both kinds compared."""
    x = pipelines.Inputs(a.domestic, a.parents, a.relationships, a.exceptions)
    matches, _ = cut_lineage(pipelines.name_inference(x)["matches"], "name-matches")
    table, _ = cut_lineage(graph.graph_summary(a.entities, a.relationships), "graph-columns")
    return pipelines.jurisdiction_prediction(x, matches, table, **train)


@query()
def jurisdiction_predictions(spark, sf):
    return country_model(Shared(spark, sf))["predictions"]


def jurisdiction_model(spark, sf):
    """Not registered, as it fits what jurisdiction_predictions fits once more. The fitted country model's figures: each fold-tested kind's accuracy, the confusion counts and the importances."""
    trained = country_model(Shared(spark, sf))["model"]
    figures = [(k, "", float(trained.metrics[k])) for k in ("n_samples", "n_classes", "folds", "baseline", "accuracy", "accuracy_std", "top3_accuracy", "top3_std", "lift") if trained.metrics.get(k) is not None]
    figures += [(f"accuracy_{k}", "", v) for k, v in trained.metrics.get("all_models", {}).items()]
    rows = [("metric", *f) for f in figures] + [("importance", name, "", w) for name, w in jurisdiction.importances(trained)]
    out = spark.createDataFrame(rows, "part string, item string, other string, value double")
    if "confusion" in trained.metrics:
        out = out.unionByName(trained.metrics["confusion"].select(F.lit("confusion").alias("part"), F.col("parent_bucket").alias("item"), F.col("predicted").alias("other"), F.col("n").cast("double").alias("value")))
    return out.withColumn("value", F.round("value", 6))


#: Known links, and those that shared addresses suggest.
PAIRS = f"{CLUSTERS}, {INFERRED}, pairs AS (SELECT source_lei, target_lei FROM relationships UNION SELECT lei, inferred_parent_lei FROM inferred)"


@query(f"""{EDGES}, {DEGREES}, {REACH}, {PAGERANK}, {PAIRS}, sz AS (SELECT u AS lei, count(*) AS n, sum(CASE WHEN u = v THEN 2 ELSE 1 END) AS d FROM und GROUP BY 1),
common AS (SELECT source_lei, target_lei, count(*) FILTER (a.v NOT IN (source_lei, target_lei)) AS cn, count(*) AS meet, sum(1 / ln(sz.d)) FILTER (a.v NOT IN (source_lei, target_lei)) AS aa FROM pairs JOIN und a ON a.u = source_lei JOIN und b ON b.u = target_lei AND a.v = b.v JOIN sz ON sz.lei = a.v GROUP BY 1, 2)
SELECT source_lei, target_lei, round(coalesce(cn, 0)::DOUBLE / nullif(coalesce(s.n, 0) + coalesce(t.n, 0) - coalesce(meet, 0), 0), 6) AS jaccard_coefficient, round(coalesce(aa, 0), 6) AS adamic_adar, CAST(coalesce(s.d, 0) * coalesce(t.d, 0) AS DOUBLE) AS preferential_attachment, coalesce(cn, 0) AS common_neighbors,
CAST(sc.component = tc.component AS INT) AS same_component, sd.out_degree AS source_out_degree, td.in_degree AS target_in_degree, round(sp.r, 6) AS source_pagerank, round(tp.r, 6) AS target_pagerank, sc.weakly_connected_component_size AS source_component_size, tc.weakly_connected_component_size AS target_component_size
FROM pairs LEFT JOIN common USING (source_lei, target_lei) LEFT JOIN sz s ON s.lei = source_lei LEFT JOIN sz t ON t.lei = target_lei JOIN comps sc ON sc.lei = source_lei JOIN comps tc ON tc.lei = target_lei JOIN degrees sd ON sd.lei = source_lei JOIN degrees td ON td.lei = target_lei JOIN pr{RANKS} sp ON sp.lei = source_lei JOIN pr{RANKS} tp ON tp.lei = target_lei""", "entities", "relationships", "addresses")
def pair_features(spark, sf):
    a = Shared(spark, sf)
    nodes, edges = _graph(a)
    guessed = clusters.infer_cluster_parents(clusters.cluster_by_address(a.addresses), a.relationships)
    pairs = a.relationships.select("source_lei", "target_lei").union(guessed.select("lei", "inferred_parent_lei"))
    return r6(graph.pair_features(pairs, edges, graph.pair_stats(nodes, edges, max_iter=RANKS, tol=0)), "jaccard_coefficient", "adamic_adar", "source_pagerank", "target_pagerank")


# Nodes once each, with their distance: a node that is there already does not come again, so the search ends by itself.
WALK = "walk AS (SELECT lei, min(label) AS label, 0 AS hops FROM known GROUP BY 1 UNION SELECT und.v, min(walk.label), min(walk.hops) + 1 FROM walk JOIN und ON walk.lei = und.u WHERE und.v NOT IN (SELECT lei FROM recurring.walk) GROUP BY 1)"


@query(f"""{EDGES}, {REACH}, {LABELS}, known AS (SELECT lei, parent_country AS label FROM labels_ WHERE lei IN (SELECT lei FROM nodes)), {WALK.replace('walk AS', 'walk (lei, label, hops) USING KEY (lei) AS')},
votes AS (SELECT component, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY component) AS whole FROM known JOIN comps USING (lei) GROUP BY 1, 2)
SELECT walk.lei, walk.label AS propagated_country, round(n / whole * (1.0 / (1 + hops)), 4)::DOUBLE AS confidence, hops FROM walk JOIN comps USING (lei) JOIN votes ON votes.component = comps.component AND votes.label = walk.label WHERE hops > 0""", "entities", "relationships")
def label_propagation(spark, sf):
    a = Shared(spark, sf)
    labels = jurisdiction.training_labels(a.relationships, a.parents).select("lei", F.col("parent_country").alias("label"))
    return graph.propagate_labels(*_graph(a), labels)


@query(f"""{EDGES}, {REACH} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT lei) FROM domestic) AS n_domestic_entities, (SELECT count(DISTINCT source_lei) FROM relationships WHERE source_lei IN (SELECT lei FROM domestic)) AS n_labeled_entities,
(SELECT count(DISTINCT target_lei) FROM relationships WHERE target_lei NOT IN (SELECT lei FROM domestic)) AS n_parent_nodes, (SELECT count(DISTINCT component) FROM comps) AS n_components, (SELECT max(weakly_connected_component_size) FROM comps) AS largest_component,
(SELECT count(*) FROM edges) >= 50 AND (SELECT count(DISTINCT source_lei) FROM relationships WHERE source_lei IN (SELECT lei FROM domestic)) >= 0.05 * (SELECT count(*) FROM domestic) AND (SELECT count(DISTINCT target_lei) FROM relationships WHERE target_lei NOT IN (SELECT lei FROM domestic)) >= 10 AS ready,
round((SELECT count(*) FROM edges)::DOUBLE / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 6) AS density, round((SELECT count(DISTINCT source_lei) FROM relationships WHERE source_lei IN (SELECT lei FROM domestic))::DOUBLE / (SELECT count(*) FROM domestic), 4) AS labeled_ratio,
50 AS min_edges_threshold, 0.05::DOUBLE AS min_labeled_ratio_threshold, 10 AS min_parent_nodes_threshold""", "entities", "relationships")
def graph_readiness(spark, sf):
    a = Shared(spark, sf)
    return graph.readiness(a.domestic, a.relationships, a.entities)


@query("SELECT d.lei AS source_lei, p.lei AS target_lei FROM domestic d CROSS JOIN parents p WHERE d.lei NOT IN (SELECT source_lei FROM relationships)", "domestic", "parents", "relationships")
def link_candidates(spark, sf):
    a = At(spark, sf)
    return links.candidates(a.domestic, a.relationships, a.parents)


@query()
def link_predictions(spark, sf):
    a = Shared(spark, sf)
    nodes, edges = (cut_lineage(df, "graph")[0] for df in _graph(a))
    pairs, _ = cut_lineage(links.training_pairs(a.relationships, a.domestic, a.parents), "training-pairs")
    trained = links.train(nodes, edges, pairs)
    return links.ranked(links.predicted(trained, a.domestic, a.relationships, a.parents, nodes, edges))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1)) AS u, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2)) AS t FROM pages)
SELECT DISTINCT trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS ctos_name, 'https://example.org' || '/single-report/malaysia-company/' || page_id || u AS ctos_url FROM l WHERE trim(t) <> ''""")
def html_listing_links(spark, sf):
    """Menu links of the page table, put under the registry's path so that the listing parser sees them."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    moved = pages.select(F.regexp_replace("html", F.lit('<a href="/'), F.concat(F.lit(f'<a href="{rules.REGISTRY_LINK}'), F.col("page_id"), F.lit("/"))).alias("html"))
    return files.registry_listing(moved, "https://example.org")


@query("SELECT count(*) AS total_predictions, round(avg(prediction_probability), 4) AS avg_confidence, count(*) FILTER (prediction_probability >= 0.5) AS high_confidence_predictions, (SELECT predicted_parent_country FROM predictions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_predicted_country FROM predictions", "predictions")
def prediction_summary(spark, sf):
    return jurisdiction.prediction_summary(At(spark, sf).predictions)


@query("SELECT predicted_parent_country, count(*) AS n FROM predictions GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", "predictions")
def prediction_histogram(spark, sf):
    return jurisdiction.histogram(At(spark, sf).predictions, "predicted_parent_country")


@query(f"{LADDER}, {SCORED}, {REVIEW} SELECT count(*) AS domestic_entities, count(uie_country) AS assigned_uie, CAST(sum(is_known_uie) AS BIGINT) AS known_uie, CAST(sum(is_inferred_uie) AS BIGINT) AS inferred_uie, (SELECT count(*) FROM queue) AS review_targets FROM uie", *REVIEW_TABLES)
def headline_metrics(spark, sf):
    a = Shared(spark, sf)
    return ladder.headline_metrics(kept(a, "assignments", lambda: _assignments(a)), _queue(a))


@query(f"{LADDER} SELECT lei, uie_country, uie_source FROM uie WHERE uie_source IN ('gleif_direct_parent', 'gleif_ultimate_parent') AND uie_country IN ('US', 'SG')", *LADDER_TABLES)
def filtered_assignments(spark, sf):
    return ladder.only(_assignments(Shared(spark, sf)), uie_source=["gleif_direct_parent", "gleif_ultimate_parent"], uie_country=["US", "SG"], evidence_tier=[]).select("lei", "uie_country", "uie_source")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
