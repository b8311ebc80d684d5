"""Command line: phases over a folder of canonical Parquet tables, results beside them; and the resumable batch over many countries."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import schemas
from tessera.functions.rules import HOSTS
from tessera.operators import names, scoring
from tessera.operators.components import scratch
from tessera.operators.jurisdiction import Trained
from tessera.operators.links import LinkModel
from tessera.plans import pipelines
from tessera.sources import files, sinks

STAGES = ("inference", "scoring")
TICKERS, DIRECTORY = schemas.columns("cik:s ticker:s title:s"), schemas.columns("ctos_name:s ctos_url:s ctos_registration_no:s")


def inputs(spark: SparkSession, root: str, country: str) -> pipelines.Inputs:
    """Tables of one country under root: root/<kind>/country=<code>, rules as CSV at root/rules, tickers and the registry for all countries."""
    paths = files.country_paths(root, country)
    read = lambda kind, schema: files.load_first(spark, paths[kind], schema)
    given = lambda path, schema: files.load(spark, path, schema) if files.exists(spark, path) else None
    chain, _ = files.chain_context(spark, root)
    return pipelines.Inputs(
        read("lei", schemas.ENTITY), read("related_lei", schemas.ENTITY), read("relationships", schemas.RELATIONSHIP), read("reporting_exceptions", schemas.EXCEPTION), read("addresses", schemas.ADDRESS),
        tickers=given(f"{root}/tickers", TICKERS), directory=given(f"{root}/registry/country={country.lower()}", DIRECTORY),
        overrides=files.overrides(spark, f"{root}/rules/overrides.csv", country), statuses=files.review_statuses(spark, f"{root}/rules/statuses.csv", country), chain=chain, country=country.upper(),
    )


def run_pull(spark: SparkSession, root: str, country: str) -> list[str]:
    """Canonical tables of a country from its landed responses: root/landing/country=<code>/<kind> as JSON lines (value; lei for exceptions,
    kind of link for relationships). Kinds that have not landed are left as they are."""
    code, out = country.lower(), []
    landed = f"{root}/landing/country={code}"
    read = lambda kind, more="": spark.read.schema(f"{more}value string").json(f"{landed}/{kind}")

    def links_of() -> DataFrame:
        rows = read("relationships", "kind string, ")
        one = lambda kind: files.relationship_records(rows.where(F.col("kind") == kind), kind)
        return one("direct_parent").unionByName(one("ultimate_parent"))

    parse = {
        "lei": lambda: files.entity_records(read("lei")), "related_lei": lambda: files.entity_records(read("related_lei"), many=False), "relationships": links_of,
        "reporting_exceptions": lambda: files.exception_records(read("reporting_exceptions", "lei string, ")), "addresses": lambda: files.address_records(read("addresses")),
    }
    for kind, make in parse.items():
        if files.exists(spark, f"{landed}/{kind}"):
            sinks.save_parquet(make(), f"{root}/{kind}/country={code}")
            out.append(f"{root}/{kind}/country={code}")
    return out


def run_registry(spark: SparkSession, root: str, country: str, threshold: int = 95) -> list[str]:
    """The directory from landed listing and company pages (root/landing/registry/listing and details), and the country's matches."""
    code, landed = country.lower(), f"{root}/landing/registry"
    directory = files.registry_listing(spark.read.schema("html string").json(f"{landed}/listing"))
    if files.exists(spark, f"{landed}/details"):
        directory = files.enrich_directory(directory, files.registry_details(spark.read.schema("ctos_url string, html string").json(f"{landed}/details")))
    at = f"{root}/registry/country={code}"
    sinks.save_parquet(pipelines.conform(directory, DIRECTORY), at)
    matches = names.match_registry(inputs(spark, root, country).domestic, files.load(spark, at, DIRECTORY), threshold)
    return [at, *save({"matches": matches}, f"{root}/registry_matches/country={code}")]


def run_tickers(spark: SparkSession, root: str, country: str) -> list[str]:
    """The ticker table from its landed object, and the country's entities beside it."""
    sinks.save_parquet(files.ticker_records(spark.read.schema("value string").json(f"{root}/landing/tickers")), f"{root}/tickers")
    x = inputs(spark, root, country)
    return [f"{root}/tickers", *save({"matches": names.match_tickers(x.domestic, x.tickers)}, f"{root}/ticker_matches/country={country.lower()}")]


def run_benchmark(spark: SparkSession, root: str, country: str, limit: int = 50) -> list[str]:
    """The first review targets against landed search answers (query, value)."""
    code = country.lower()
    targets = files.load(spark, f"{root}/processed/country={code}/review").orderBy(F.desc("review_priority_score"), "lei").limit(limit)
    answers = files.search_records(spark.read.schema("query string, value string").json(f"{root}/landing/searches"))
    return save({"benchmark": scoring.search_benchmark(targets, answers)}, f"{root}/benchmark/country={code}")


def save(results: dict, root: str) -> list[str]:
    """Tables of a result to Parquet under root; nested results to folders. Returns what was written."""
    out = []
    for name, x in results.items():
        if isinstance(x, DataFrame):
            sinks.save_parquet(x, f"{root}/{name}")
            out.append(f"{root}/{name}")
        elif isinstance(x, dict):
            out += save(x, f"{root}/{name}")
        elif isinstance(x, Trained):
            sinks.save_model(x, f"{root}/{name}", next(v for v in results.values() if isinstance(v, DataFrame)).sparkSession)
            out.append(f"{root}/{name}")
        elif isinstance(x, LinkModel) and x.model is not None:
            x.model.write().overwrite().save(f"{root}/{name}")
            out.append(f"{root}/{name}")
    return out


def run_inference(spark: SparkSession, root: str, country: str, threshold: int = 90, min_size: int = 3, trees: int = 200, folds: int | None = None) -> list[str]:
    """All phases, exceptions to links. The tables that loops wrote on the way are deleted once the results are stored."""
    with scratch(spark):
        return save(pipelines.full_inference(inputs(spark, root, country), threshold, min_size, trees, folds), f"{root}/inference/country={country.lower()}")


def run_scoring(spark: SparkSession, root: str, country: str, iterations: int = 100) -> list[str]:
    """Scores and assignments, with what inference stored before (nothing, if it did not run)."""
    x, at = inputs(spark, root, country), f"{root}/inference/country={country.lower()}"
    matches, inferred = files.load_optional(spark, f"{at}/names/matches", schemas.NAME_MATCH), files.load_optional(spark, f"{at}/addresses/inferred", schemas.ADDRESS_INFERRED)
    found = files.load_optional(spark, f"{at}/addresses/clusters", schemas.CLUSTER)
    x.predictions = files.load_optional(spark, f"{at}/jurisdiction/predictions", schemas.PREDICTION)
    with scratch(spark):
        return save(pipelines.graph_and_scoring(x, matches, inferred, found, pagerank_iterations=iterations), f"{root}/processed/country={country.lower()}")


def run_batch(spark: SparkSession, root: str, countries: list[str] | None = None, reset: bool = False, inference: dict | None = None, **scoring) -> DataFrame:
    """Every stage of every country that has entities, skipping what earlier runs finished; a failed stage is noted, and the others go on."""
    states = sinks.StageStates(spark, f"{root}/_stages")
    for country in countries or HOSTS:
        if reset:
            states.reset(country)
        if not any(files.exists(spark, p) for p in files.country_paths(root, country)["lei"]):
            continue
        for stage, run in zip(STAGES, (lambda *a: run_inference(*a, **(inference or {})), lambda *a: run_scoring(*a, **scoring))):
            if states.is_done(country, stage):
                continue
            states.mark(country, stage, "running")
            try:
                states.mark(country, stage, "done", f"{len(run(spark, root, country))} tables")
            except Exception as e:  # noqa: BLE001  one country's bad table must not stop the batch
                states.mark(country, stage, "failed", str(e)[:200])
                break
    return states.table()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Ownership analytics over canonical tables")
    p.add_argument("command", choices=["profile", "compare", "exceptions", "names", "addresses", "model", "links", "inference", "score", "batch", "pull", "registry", "tickers", "benchmark", "mock"])
    p.add_argument("--root", default=".", help="folder of canonical tables")
    p.add_argument("--country", default="MY", help="ISO-2 code, or several by commas for batch")
    p.add_argument("--threshold", type=int, default=90, help="least name score")
    p.add_argument("--min-size", type=int, default=3, help="least address cluster")
    p.add_argument("--trees", type=int, default=200, help="trees of the models")
    p.add_argument("--folds", type=int, default=None, help="folds of the models' cross-validation")
    p.add_argument("--limit", type=int, default=50, help="benchmark: review targets")
    p.add_argument("--reset", action="store_true", help="batch: run finished stages again")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    country = a.country.upper()
    if a.command == "mock":
        pipelines.mock_pipeline(spark).show()
    elif a.command == "batch":
        run_batch(spark, a.root, country.split(","), a.reset, {"threshold": a.threshold, "min_size": a.min_size, "trees": a.trees, "folds": a.folds}).show(truncate=False)
    elif a.command == "inference":
        print("\n".join(run_inference(spark, a.root, country, a.threshold, a.min_size, a.trees, a.folds)))
    elif a.command in ("pull", "registry", "tickers"):
        print("\n".join({"pull": run_pull, "registry": run_registry, "tickers": run_tickers}[a.command](spark, a.root, country)))
    elif a.command == "benchmark":
        print("\n".join(run_benchmark(spark, a.root, country, a.limit)))
    elif a.command == "score":
        print("\n".join(run_scoring(spark, a.root, country)))
    else:
        x = inputs(spark, a.root, country)
        fitted = {"trees": a.trees} | ({} if a.folds is None else {"folds": a.folds})
        run = {
            "profile": lambda: pipelines.entity_analysis(x), "compare": lambda: {"countries": pipelines.comparative_analysis(x)}, "exceptions": lambda: pipelines.reporting_exceptions(x), "names": lambda: pipelines.name_inference(x, a.threshold),
            "addresses": lambda: pipelines.address_clustering(x, a.min_size), "model": lambda: pipelines.jurisdiction_prediction(x, *pipelines.model_inputs(x, a.threshold), **fitted), "links": lambda: pipelines.graph_prediction(x, pipelines.name_inference(x, a.threshold)["matches"], **fitted),
        }[a.command]()
        print("\n".join(save(run, f"{a.root}/{a.command}/country={country.lower()}")))
    return 0
