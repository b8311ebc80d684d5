"""Reading landed files: canonical Parquet with fallbacks, CSV rules, JSON records, registry HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import rules
from tessera.functions.dedupe import first_by
from tessera.functions.schemas import ADDRESS, ENTITY, EXCEPTION, OVERRIDE, RELATIONSHIP, SEARCH, STATUS, conform, empty


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) has anything, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; an error if there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    return df if schema is None else conform(df, schema)


def load_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of that schema."""
    return load(spark, path, schema) if exists(spark, path) else empty(spark, schema)


def load_first(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first path that exists, else an empty table."""
    return next((load(spark, p, schema) for p in paths if exists(spark, p)), empty(spark, schema))


KINDS = ["lei", "relationships", "related_lei", "reporting_exceptions", "addresses", "scored"]


def country_paths(root: str, country: str) -> dict[str, list[str]]:
    """Where each kind of table of a country lies: its own partition, then (for MY) the older name without a country."""
    code = country.lower()
    return {k: [f"{root}/{k}/country={code}", *([f"{root}/malaysia_{k}.parquet"] if code == "my" else [])] for k in KINDS}


def chain_context(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(relationships, entities) of all countries for upstream links: edges once each by ends and type, entities once by lei.

    Unreadable files are skipped, as partitions of other countries may be half written.
    """

    def read(names: list[str], schema: T.StructType) -> DataFrame:
        out = empty(spark, schema)
        for n in names:
            if exists(spark, f"{root}/{n}"):
                out = out.unionByName(conform(spark.read.option("ignoreCorruptFiles", True).parquet(f"{root}/{n}"), schema), allowMissingColumns=True)
        return out

    rels = first_by(read(["relationships"], RELATIONSHIP), ["source_lei", "target_lei", "relationship_type"])
    return rels, first_by(read(["lei", "related_lei"], ENTITY).where("lei is not null"), "lei")


def _active(df: DataFrame, host: str) -> DataFrame:
    on = F.lower(F.trim(F.coalesce("active", F.lit("1")))).isin("1", "true", "yes", "y")
    return df.where(on & (F.upper(F.trim("host_country")) == host.upper()))


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By header names, whatever their order; a byte-order mark before the first is taken off."""
    if not exists(spark, path):
        return empty(spark, schema)
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return conform(df.toDF(*[c.lstrip("﻿") for c in df.columns]), schema)


def overrides(spark: SparkSession, path: str, country: str = "MY") -> DataFrame:
    """Active override rows of a host with their defaults, the first of each lei in file order."""
    rows = _active(_csv(spark, path, OVERRIDE), country).withColumn("_ord", F.monotonically_increasing_id())
    filled = rows.withColumns({"uie_source": F.coalesce("uie_source", F.lit("manual_verified")), "evidence_tier": F.coalesce("evidence_tier", F.lit("A_manual_verified_uie")), "uie_confidence": F.coalesce(F.col("uie_confidence").try_cast("double"), F.lit(0.95)).cast("string")})
    return first_by(filled.where("lei is not null"), "lei")


def review_statuses(spark: SparkSession, path: str, country: str = "MY") -> DataFrame:
    rows = _active(_csv(spark, path, STATUS), country).withColumn("_ord", F.monotonically_increasing_id())
    return first_by(rows.where("lei is not null"), "lei")


def position_csv(spark: SparkSession, path: str) -> DataFrame:
    """The wide position file; columns that a query does not name are not parsed."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


# ---- JSON records as landed: one response a line. ----

RECORD_DDL = "struct<id: string, attributes: struct<lei: string, entity: struct<legalName: struct<name: string>, otherNames: string, transliteratedOtherNames: string, category: string, legalForm: struct<id: string>, status: string, legalAddress: struct<country: string, city: string, region: string, postalCode: string, addressLines: array<string>>, headquartersAddress: struct<country: string, city: string>>, registration: struct<initialRegistrationDate: string, lastUpdateDate: string, status: string>>>"


def _records(lines: DataFrame, column: str, many: bool, shape: str = RECORD_DDL) -> DataFrame:
    """One row a record of responses {"data": record or [records]}; null where a text is no such thing."""
    if many:
        return lines.select("*", F.posexplode_outer(F.from_json(column, f"struct<data: array<{shape}>>")["data"]).alias("_at", "_r"))
    return lines.select("*", F.lit(0).alias("_at"), F.from_json(column, f"struct<data: {shape}>")["data"].alias("_r"))


def entity_records(lines: DataFrame, column: str = "value", many: bool = True) -> DataFrame:
    """ENTITY rows of record responses, the first of each lei; missing fields are null."""
    e = F.col("_r.attributes.entity")
    rows = _records(lines, column, many).select(
        F.coalesce("_r.attributes.lei", "_r.id").alias("lei"), e["legalName"]["name"].alias("legal_name"), e["otherNames"].alias("other_names"), e["transliteratedOtherNames"].alias("transliterated_other_names"), e["category"].alias("category"), e["legalForm"]["id"].alias("legal_form"),
        e["status"].alias("entity_status"), F.col("_r.attributes.registration.initialRegistrationDate").alias("registered_at"), F.col("_r.attributes.registration.lastUpdateDate").alias("last_update_at"),
        e["legalAddress"]["country"].alias("country_legal"), e["legalAddress"]["city"].alias("city_legal"), e["headquartersAddress"]["country"].alias("country_hq"), e["headquartersAddress"]["city"].alias("city_hq"), F.col("_at").cast("long").alias("_ord"),
    )
    return first_by(rows.where("lei is not null"), "lei")


def address_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """ADDRESS rows: the first address line, and the others joined by ` | `."""
    a = F.col("_r.attributes.entity.legalAddress")
    rest = F.array_join(F.slice(a["addressLines"], F.lit(2), F.greatest(F.size(a["addressLines"]) - 1, F.lit(0))), " | ")
    return _records(lines, column, False).where("_r is not null").select(F.coalesce("_r.attributes.lei", "_r.id").alias("lei"), F.get(a["addressLines"], F.lit(0)).alias("address_line1"), F.when(F.size(a["addressLines"]) > 1, rest).alias("address_line2"), a["city"].alias("city"), a["region"].alias("region"), a["postalCode"].alias("postal_code"), a["country"].alias("country")).select(*ADDRESS.names)


LINK_DDL = "struct<attributes: struct<validFrom: string, validTo: string, relationship: struct<startNode: struct<id: string>, endNode: struct<id: string>, status: string, periods: array<struct<accountingStandard: string, endDate: string>>>>>"


def relationship_records(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """RELATIONSHIP rows of one endpoint (kind: direct_parent or ultimate_parent); of several periods the last counts."""
    rel = F.col("_r.attributes.relationship")
    last = F.when(F.size(rel["periods"]) > 0, F.element_at(rel["periods"], -1))
    rows = _records(lines, column, False, LINK_DDL).where("_r is not null")
    fixed = {"source_lei": rel["startNode"]["id"], "target_lei": rel["endNode"]["id"], "relationship_type": F.lit(kind), "relationship_status": rel["status"], "accounting_standard": last["accountingStandard"], "period_end": last["endDate"], "valid_from": F.col("_r.attributes.validFrom"), "valid_to": F.col("_r.attributes.validTo")}
    return rows.select(*[fixed[f.name].alias(f.name) for f in RELATIONSHIP])


def exception_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """EXCEPTION rows that name a reason; lines: lei (the one asked for) and the response."""
    shape = "struct<attributes: struct<reason: string, reference: string>>"
    rows = _records(lines, column, False, shape).where("_r.attributes.reason is not null")
    return rows.select("lei", F.col("_r.attributes.reason").alias("exception_reason"), F.col("_r.attributes.reference").alias("exception_reference")).select(*EXCEPTION.names)


def search_records(lines: DataFrame, query: str = "query", column: str = "value") -> DataFrame:
    """SEARCH rows: candidates of each full-text answer, ranked from 1, with the answer's total."""
    total = F.get_json_object(column, "$.meta.pagination.total").try_cast("int")
    rows = _records(lines.withColumn("_total", total), column, True).where("_r is not null")
    e = F.col("_r.attributes.entity")
    fixed = {"query": F.col(query), "rank": F.col("_at") + 1, "lei": F.coalesce("_r.attributes.lei", "_r.id"), "legal_name": e["legalName"]["name"], "country_legal": e["legalAddress"]["country"], "country_hq": e["headquartersAddress"]["country"], "category": e["category"], "entity_status": e["status"], "registration_status": F.col("_r.attributes.registration.status"), "total_results": F.coalesce("_total", F.lit(0))}
    return rows.select(*[fixed[f.name].cast(f.dataType).alias(f.name) for f in SEARCH])


def ticker_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """cik (ten digits), ticker, title of an object of objects."""
    shape = "map<string, struct<cik_str: string, ticker: string, title: string>>"
    t = F.explode(F.map_values(F.from_json(column, shape)))
    return lines.select(t.alias("t")).select(F.lpad("t.cik_str", 10, "0").alias("cik"), F.col("t.ticker").alias("ticker"), F.col("t.title").alias("title"))


def observations(lines: DataFrame, column: str = "value") -> DataFrame:
    """obs_key, value of the first data set's observations: the first element of each; null where there is none."""
    shape = "struct<data: struct<dataSets: array<struct<observations: map<string, array<string>>>>>>"
    first = F.get(F.from_json(column, shape)["data"]["dataSets"], F.lit(0))["observations"]
    return lines.select(F.explode(first).alias("obs_key", "o")).select("obs_key", F.get("o", F.lit(0)).alias("value"))


def flatten_objects(lines: DataFrame, column: str = "value", depth: int = 3) -> DataFrame:
    """path (dotted), value of nested JSON objects, down to a depth; what lies deeper stays JSON text."""
    out = lines.select(F.lit("").alias("path"), F.col(column).alias("value"), F.lit(True).alias("_open"))
    for _ in range(depth):
        parsed = F.when(F.col("_open") & F.trim("value").startswith("{"), F.from_json("value", "map<string, string>"))
        opened = out.withColumn("_m", parsed)
        inner = opened.where("_m is not null").select("path", F.explode("_m").alias("k", "value")).select(F.when(F.col("path") == "", F.col("k")).otherwise(F.concat_ws(".", "path", "k")).alias("path"), "value", F.lit(True).alias("_open"))
        out = opened.where("_m is null and path <> ''").select("path", "value", F.lit(False).alias("_open")).unionByName(inner)
    return out.select("path", "value")


# ---- Registry pages. ----


class _Page(HTMLParser):
    """Text and links of a page. Attributes may come in any order and quoting; tags inside a link part its words; scripts and styles are no text."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.words: list[str] = []
        self.links: list[tuple[str, list[str]]] = []
        self._open = self._hidden = False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":  # a link ends where the next begins
            href = dict(reversed(attrs)).get("href")
            self._open = href is not None
            if self._open:
                self.links.append((href.strip(), []))
        self._hidden = tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self._hidden = False
        if tag == "a":
            self._open = False

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self.words += data.split()
            if self._open:
                self.links[-1][1].extend(data.split())


@F.udtf(returnType="href string, words string")
class page_links:
    """href and text (white space as one space) of each link of a page that has both, in page order; a null page has none."""

    def eval(self, page: str) -> Iterator[tuple[str, str]]:
        for href, words in _Page(page or "").links:
            if href and words:
                yield href, " ".join(words)


@F.pandas_udf(T.StringType())
def page_text(page: pd.Series) -> pd.Series:
    """A page's text, white space as one space; null: empty."""
    return page.map(lambda x: " ".join(_Page(x or "").words))


def registry_listing(pages: DataFrame, base: str = "", column: str = "html") -> DataFrame:
    """ctos_name, ctos_url of the company links of listing pages, each pair once; relative links get the base."""
    found = pages.select(F.col(column).alias("_page")).lateralJoin(page_links(F.col("_page").outer())).where(F.col("href").contains(rules.REGISTRY_LINK))
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(base), F.col("href"))).otherwise(F.col("href"))
    return found.select(F.col("words").alias("ctos_name"), url.alias("ctos_url")).distinct()


# Labels of a company page.
DETAIL_FIELDS = {
    "ctos_registration_no": r"(?i)Company Registration No\.\s*([^ ]+\s*/\s*\d+)", "ctos_nature_of_business": r"(?i)Nature of Business\s*(.*?)\s*Date of Registration",
    "ctos_registration_date": r"(?i)Date of Registration\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", "ctos_state": r"(?i)State\s*(.*?)\s*COMPANY DESCRIPTION",
}


def _field(value: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(value, "<!--|-->", " "), r"\s+-\s*$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^[ -]+|[ -]+$", "")
    return F.when((c != "") & (F.lower(c) != "null"), c)


def registry_details(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with the four fields of a company page; null where a page has none."""
    return pages.withColumn("_text", page_text(column)).withColumns({n: _field(F.regexp_extract("_text", p, 1)) for n, p in DETAIL_FIELDS.items()}).drop("_text")


def enrich_directory(directory: DataFrame, details: DataFrame) -> DataFrame:
    """Directory rows with their details; a detail fills what is missing and overrides nothing."""
    d = first_by(details.select("ctos_url", *[F.col(n).alias(f"_{n}") for n in DETAIL_FIELDS]), "ctos_url")
    out = directory.join(d, "ctos_url", "left")
    return out.withColumns({n: F.coalesce(n, f"_{n}") if n in directory.columns else F.col(f"_{n}") for n in DETAIL_FIELDS}).drop(*[f"_{n}" for n in DETAIL_FIELDS])
