"""Canonical tables out of the TPC-H-like test tables: one SQL text for each, which Spark and DuckDB read alike (see ON_SPARK).

Customers are domestic entities C…, suppliers are parents S…; parent links come from revenue, exceptions from events, positions from orders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.rules import HOSTS

#: ISO codes by key, two letters each.
ISO = "MYSGTHIDPHVNKHBNLAMMTLUSGBDEJPCNHKFRNLCHAUKYVGLUIN"


def _iso(key: str) -> str:
    return f"substring('{ISO}', CAST(2 * ({key}) + 1 AS INT), 2)"


def _id(letter: str, key: str) -> str:
    return f"concat('{letter}', lpad(CAST({key} AS STRING), 9, '0'))"


SQL = {
    "domestic": f"""
SELECT {_id('C', 'c_custkey')} AS lei,
  concat(upper(p_name), CASE WHEN c_custkey % 11 = 0 THEN 'S' ELSE '' END, CASE c_custkey % 6 WHEN 0 THEN ' Sdn. Bhd.' WHEN 1 THEN ' Berhad' WHEN 2 THEN ' Global Income Fund' WHEN 3 THEN ' Nominees Sdn Bhd' WHEN 4 THEN ' Bank Ltd' ELSE ' Pte. Ltd.' END) AS legal_name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'GENERAL' WHEN 'BUILDING' THEN 'FUND' WHEN 'FURNITURE' THEN 'BRANCH' WHEN 'HOUSEHOLD' THEN 'SOLE_PROPRIETOR' END AS category,
  p_type AS legal_form, CASE WHEN c_custkey % 9 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS entity_status,
  registered_at, {_iso('c_nationkey')} AS country_legal,
  CASE c_custkey % 5 WHEN 0 THEN 'KUALA-LUMPUR' WHEN 1 THEN concat(' ', lower(r_name), ' city ') WHEN 2 THEN concat('port (', r_name, ')') WHEN 3 THEN 'george town' END AS city_legal,
  {_iso('(c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END) % 25')} AS country_hq, c_custkey AS _ord
FROM customer JOIN part ON p_partkey = c_custkey % 100 JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT o_custkey, CAST(CAST(min(o_orderdate) AS DATE) AS STRING) AS registered_at FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""",
    "parents": f"""
SELECT {_id('S', 's_suppkey')} AS lei, concat(upper(p_name), ' Holdings PLC') AS legal_name, 'GENERAL' AS category, p_type AS legal_form,
  'ACTIVE' AS entity_status, '2001-01-01' AS registered_at, {_iso('s_nationkey')} AS country_legal, 'KUALA-LUMPUR' AS city_legal,
  {_iso('s_nationkey')} AS country_hq, s_suppkey AS _ord
FROM supplier JOIN part ON p_partkey = (s_suppkey * 3) % 40""",
    "relationships": f"""
SELECT {_id('C', 'c')} AS source_lei, {_id('S', 's')} AS target_lei, CASE k WHEN 1 THEN 'direct_parent' ELSE 'ultimate_parent' END AS relationship_type,
  CASE WHEN c % 4 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS relationship_status, 2 * c + k AS _ord
FROM (SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY revenue DESC, s) AS k
  FROM (SELECT o_custkey AS c, l_suppkey AS s, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey) r) t
WHERE (k = 1 AND c % 3 = 0) OR (k = 2 AND c % 5 = 0)
UNION ALL
SELECT {_id('S', 's_suppkey')}, {_id('S', '(s_suppkey + 1) % n')}, 'ultimate_parent', 'ACTIVE', 1000000000 + s_suppkey
FROM supplier CROSS JOIN (SELECT count(*) AS n FROM supplier) AS many WHERE s_suppkey % 2 = 0""",
    "exceptions": f"""
SELECT {_id('C', 'user_id')} AS lei, CASE event_type WHEN 'error' THEN 'NON_CONSOLIDATING' WHEN 'click' THEN 'NATURAL_PERSONS' WHEN 'view' THEN 'NO_LEI' WHEN 'signup' THEN 'NO_KNOWN_PERSON' ELSE 'NON_PUBLIC' END AS exception_reason,
  CAST(NULL AS STRING) AS exception_reference, event_id AS _ord
FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) e WHERE k = 1""",
    "addresses": f"""
SELECT {_id('C', 'c_custkey')} AS lei, concat('No. ', CAST((7 * c_custkey) % 12 AS STRING), ', Jln. Raja', CASE WHEN (7 * c_custkey) % 12 < 2 THEN ' Labuan' ELSE '' END) AS address_line1,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(50000 + c_nationkey % 5 AS STRING) END AS postal_code, c_custkey AS _ord
FROM customer""",
    "positions": f"""
SELECT {_iso('c_nationkey')} AS host, {_iso('s_nationkey')} AS parent, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) / 1000 AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
GROUP BY c_nationkey, s_nationkey""",
    "predictions": f"""
SELECT {_id('C', 'c_custkey')} AS lei, {_iso('(c_nationkey + 7) % 25')} AS predicted_parent_country, CAST(c_custkey % 100 AS DOUBLE) / 100 AS prediction_probability,
  CAST(c_custkey % 7 AS DOUBLE) / 10 AS confidence_gap, 'US;GB;DE' AS top3_countries, '0.5;0.3;0.2' AS top3_probabilities, c_custkey AS _ord
FROM customer WHERE c_custkey % 4 = 1""",
    "overrides": f"""
SELECT {_id('C', 'c_custkey')} AS lei, CAST(NULL AS STRING) AS uie_lei, 'BOARD DECISION' AS uie_name, 'MY' AS uie_country, CASE WHEN c_custkey % 2 = 0 THEN 'manual_verified' ELSE 'desk_research' END AS uie_source,
  CAST(NULL AS STRING) AS evidence_tier, CASE WHEN c_custkey % 3 = 0 THEN '0.99' END AS uie_confidence, 'annual report' AS override_reason, 'https://example.org' AS source_url, CAST(NULL AS STRING) AS source_note, c_custkey AS _ord
FROM customer WHERE c_custkey % 97 = 5""",
    "statuses": f"""
SELECT {_id('C', 'c_custkey')} AS lei, CASE WHEN c_custkey % 2 = 0 THEN 'in_progress' END AS review_status, CASE WHEN c_custkey % 3 = 0 THEN 'state_owned_entity' END AS entity_type, 'noted' AS review_note, c_custkey AS _ord
FROM customer WHERE c_custkey % 83 = 7""",
    "tickers": """
SELECT lpad(CAST(min(p_partkey) AS STRING), 10, '0') AS cik, concat(upper(substring(p_name, 1, 4)), substring(p_type, 1, 1)) AS ticker, concat(upper(p_name), CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN ' Holdings PLC' ELSE ', Bank Ltd' END) AS title, min(p_partkey) AS _ord
FROM part GROUP BY p_name, p_type""",
    "registry": """
SELECT concat(p_name, CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN ' Sendirian Berhad' WHEN p_type IN ('MEDIUM', 'PROMO') THEN ' Sdn Bhd' ELSE ' Private Limited' END) AS ctos_name, concat('https://example.org/', CAST(min(p_partkey) AS STRING)) AS ctos_url,
  CAST(min(p_partkey) * 1000 + 7 AS STRING) AS ctos_registration_no, min(p_partkey) AS _ord
FROM part GROUP BY p_name, p_type""",
    "searches": f"""
SELECT trim(upper(p_name)) || ' Holdings PLC' AS query, CAST(s_suppkey % 3 + 1 AS INT) AS rank, {_id('S', 's_suppkey')} AS lei, concat(upper(p_name), ' Holdings PLC') AS legal_name, {_iso('s_nationkey')} AS country_legal, {_iso('(s_nationkey + 1) % 25')} AS country_hq, 3 AS total_results, s_suppkey AS _ord
FROM (SELECT p_name, min(s_suppkey) AS first FROM supplier JOIN part ON p_partkey = (s_suppkey * 3) % 40 GROUP BY p_name) f JOIN supplier ON s_suppkey = first
UNION ALL
SELECT trim(concat(upper(p_name), ' Bank Ltd')), 1, {_id('C', 'c_custkey')}, concat(upper(p_name), ' Bank Ltd'), {_iso('c_nationkey')}, {_iso('c_nationkey')}, 1, 1000000000 + c_custkey
FROM (SELECT p_name, min(c_custkey) AS first FROM customer JOIN part ON p_partkey = c_custkey % 100 WHERE c_custkey % 6 = 4 GROUP BY p_name) f JOIN customer ON c_custkey = first""",
}
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SQL["entities"] = "SELECT * FROM domestic UNION ALL SELECT lei, legal_name, category, legal_form, entity_status, registered_at, country_legal, city_legal, country_hq, 1000000000 + _ord FROM parents"
#: Where an adapter table reads others of this list.
NEEDS = {"entities": ["domestic", "parents"]}

#: The parts that a name rule can meet: a remainder tells them, so they are few whatever the size of the table.
_FEW = "JOIN (SELECT p_partkey, p_name, p_type FROM part WHERE p_partkey BETWEEN {low} AND {high}) AS few ON"
#: The same rows as in SQL, in the order of work that suits large tables: the condition on a link's customer holds before lines are joined and
#: added up, and the few parts that names come from are picked before entities meet them.
ON_SPARK = SQL | {
    "domestic": SQL["domestic"].replace("SELECT", "SELECT /*+ BROADCAST(few) */", 1).replace("JOIN part ON", _FEW.format(low=-99, high=99)),
    "parents": SQL["parents"].replace("SELECT", "SELECT /*+ BROADCAST(few) */", 1).replace("JOIN part ON", _FEW.format(low=-39, high=39)),
    "relationships": SQL["relationships"].replace("FROM lineitem JOIN orders ON", "FROM lineitem JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 3 = 0 OR o_custkey % 5 = 0) AS o ON"),
}


def canonical(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """One canonical table over the Parquet tables of sf_dir; nothing is read before it is used. given: canonical tables to build on."""
    reads = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\b{t}\b", SQL[name])}
    reads |= {t: (given or {}).get(t) or canonical(spark, sf_dir, t) for t in NEEDS.get(name, [])}
    text = ON_SPARK[name]
    for t in sorted(reads, key=len, reverse=True):
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **reads)


def with_tables(*names: str) -> str:
    """`WITH name AS (…), …` for DuckDB, with what the names need first."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)


#: Hosts that the macro queries know.
HOST_LIST = ", ".join(f"'{h}'" for h in HOSTS)
