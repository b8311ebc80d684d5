"""Name matching: brands of parents in entity names, tickers by cleaned name, and the public registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.dedupe import first_by
from tessera.functions.schemas import NAME_MATCH, ORDINAL, RELATIONSHIP
from tessera.functions.text import brand_token, clean_company_name, distinctive_words, is_generic, ratio_udf, registry_name, registry_tokens, token_set_ratio_udf, token_sort_ratio_udf, words
from tessera.operators.components import cut_lineage


def brand_tokens(parents: DataFrame, country: str = "MY") -> DataFrame:
    """parent_lei, parent_name, brand_token: names without suffixes, long and distinctive enough; the first parent of each token."""
    rows = parents.where("lei is not null and lei <> '' and legal_name is not null and legal_name <> ''")
    out = rows.select(F.col("lei").alias("parent_lei"), F.col("legal_name").alias("parent_name"), brand_token("legal_name", country).alias("brand_token"), *([ORDINAL] if ORDINAL in rows.columns else []))
    out = out.where((F.length("brand_token") >= rules.MIN_BRAND_LENGTH) & ~is_generic(F.col("brand_token")))
    return first_by(out, "brand_token", keep_ordinal=True)


def _whole_word(brand: Column, name: Column) -> Column:
    """Brand and name hold A-Z, 0-9 and single blanks only, so a whole-word match is a match between blanks."""
    return F.concat(F.lit(" "), name, F.lit(" ")).contains(F.concat(F.lit(" "), brand, F.lit(" ")))


def match_names(entities: DataFrame, brands: DataFrame, known: DataFrame | None = None, threshold: int = 90, country: str = "MY") -> DataFrame:
    """NAME_MATCH: the best brand of each entity, ties to the first brand.

    A whole-word hit scores 100, else the word-set ratio, less 15 without a shared distinctive word. Above 85 a match must share one,
    so entities and brands meet by distinctive words alone and nothing is lost. At 85 or below, those that share none must score
    threshold + 15 or more: they meet by parts of their texts (see text_blocks) or, where only generic words are shared, by these.
    known: lei of entities that are left out. Equal names are cleaned once, and entities with equal cleaned names are scored once.
    """
    rows = entities.where("lei is not null and lei <> '' and legal_name is not null").select("lei", "legal_name")
    if known is not None:
        rows = rows.join(known.select("lei").where("lei is not null").distinct(), "lei", "left_anti")
    # Read by each way of meeting below. Empty names go after that: their filter would be made part of the scan, and clean every row's name.
    cleaned = cut_lineage(rows.select("legal_name").distinct().withColumn("name", clean_company_name("legal_name")), "clean-names")[0].where("name <> ''")
    names = cleaned.select("name").distinct().select("name", words(F.col("name")).alias("entity_words"), brand_token(F.col("name"), country).alias("entity_token"))
    b = brands.select("brand_token", "parent_lei", F.col(ORDINAL).alias("_brand") if ORDINAL in brands.columns else F.col("brand_token").alias("_brand")).withColumn("brand_words", distinctive_words(F.col("brand_token")))
    left = names.withColumn("word", F.explode(F.array_distinct("entity_words")))
    pairs = left.join(b.withColumn("word", F.explode(F.array_distinct("brand_words"))), "word").drop("word")
    if threshold + rules.MISSING_BRAND_PENALTY <= 100:
        # Shared generic words, or none: with none, the scorer's ratio is that of the sorted words.
        generic = left.join(b.withColumn("word", F.explode(F.array_distinct(words(F.col("brand_token"))))), "word").drop("word")
        t = threshold + rules.MISSING_BRAND_PENALTY
        once = lambda c: sorted_words(F.array_distinct(words(F.col(c))))
        met = text_blocks(names.select("name", once("entity_token").alias("probe")), b.select("brand_token", once("brand_token").alias("text")), "name", "brand_token", t)
        alike = met.join(names, "name").join(b, "brand_token").select(*pairs.columns)
        pairs = pairs.unionByName(generic).unionByName(alike)
    pairs = pairs.dropDuplicates(["name", "brand_token"])
    hit = _whole_word(F.col("brand_token"), F.col("name"))
    # The scorer runs on pairs without a whole-word hit.
    sure = pairs.where(hit).withColumn("score", F.lit(100.0))
    fuzzy = pairs.where(~hit).withColumn("score", token_set_ratio_udf("brand_token", "entity_token"))
    fuzzy = fuzzy.withColumn("score", F.when((F.col("score") >= threshold) & ~F.arrays_overlap("brand_words", "entity_words"), F.greatest(F.col("score") - rules.MISSING_BRAND_PENALTY, F.lit(0.0))).otherwise(F.col("score")))
    scored = sure.unionByName(fuzzy).where(F.col("score") >= threshold).select("name", "brand_token", "parent_lei", "score", "_brand")
    best = first_by(scored, "name", F.desc("score"), F.col("_brand"))
    out = rows.join(cleaned.join(best, "name"), "legal_name").select("lei", F.col("parent_lei").alias("matched_parent_lei"), "brand_token", F.col("score").alias("match_score"), F.lit("legal_name").alias("match_field"))
    return first_by(out, "lei", F.desc("match_score")).select(*NAME_MATCH.names)


def inferred_edges(matches: DataFrame, min_score: float = 80) -> DataFrame:
    """Matches of at least min_score as relationship rows, with their source and score."""
    rows = matches.where(F.col("match_score") >= min_score)
    fixed = {"source_lei": F.col("lei"), "target_lei": F.col("matched_parent_lei"), "relationship_type": F.lit("inferred_name_match"), "relationship_status": F.lit("INFERRED")}
    return rows.select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RELATIONSHIP], F.lit("phase1_name_match").alias("inference_source"), F.col("match_score").alias("inference_score"))


def match_summary(matches: DataFrame) -> DataFrame:
    """One row: matches, bands above and up to 90, distinct brands and parents, mean, spread and quartiles of scores."""
    s = F.col("match_score")
    return matches.agg(F.count("*").alias("total_matches"), F.count_if(s >= 90).alias("high_confidence"), F.count_if((s >= 80) & (s < 90)).alias("medium_confidence"), F.count_distinct("brand_token").alias("unique_brands"), F.count_distinct("matched_parent_lei").alias("unique_parents"), F.avg(s).alias("mean_score"), F.stddev(s).alias("std_score"), F.min(s).alias("min_score"), *[F.percentile(s, p).alias(f"p{int(p * 100)}_score") for p in (0.25, 0.5, 0.75)], F.max(s).alias("max_score"))


def match_tickers(entities: DataFrame, tickers: DataFrame) -> DataFrame:
    """entities with cik, ticker, title, both cleaned names and appears_in_edgar; several tickers of one title give several rows."""
    left = entities.withColumn("legal_name_clean", clean_company_name("legal_name"))
    right = tickers.select("cik", "ticker", "title", clean_company_name("title").alias("title_clean"))
    return left.join(right, left["legal_name_clean"] == right["title_clean"], "left").withColumn("appears_in_edgar", F.col("cik").isNotNull().cast("int"))


def sorted_words(found: Column) -> Column:
    return F.array_join(F.sort_array(found), " ")


def text_blocks(probes: DataFrame, texts: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """Distinct (a, b) that may have a ratio of threshold (above 67) or more; no such pair is missing.

    probes: a, probe; texts: b, text. Two texts of lengths m and n with a ratio of t differ by at most (1 - t)(m + n) insertions and
    deletions, so m <= n(2 - t)/t, and they differ by d = 2(1 - t)n/t or fewer. Of d + 1 parts of a text one is therefore untouched:
    it stands in the probe, moved by d places at most. Texts meet probes by the length, the number and the letters of such a part.
    """
    t = threshold / 100
    if t <= 2 / 3:
        raise ValueError("texts have parts for ratios above 67 only")

    def parts(n: Column) -> Column:
        return F.floor(2 * (1 - t) * n / t + 1e-9).cast("int") + 1

    def start(n: Column, k: Column, part: Column) -> Column:
        """Where a part begins: all have n / k letters, rounded down or up."""
        return F.floor(n * part / k).cast("int")

    kept = texts.where("text <> ''").select(b, "text", F.length("text").alias("n"))
    cut = kept.withColumn("k", parts(F.col("n"))).select(b, "text", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    left, right = start(F.col("n"), F.col("k"), F.col("part")), start(F.col("n"), F.col("k"), F.col("part") + 1)
    index = cut.select(b, "n", "part", F.substring("text", left + 1, right - left).alias("letters"))
    # The lengths that a probe can meet, the parts of such texts, and the places where each may stand.
    m = F.length("probe")
    low, high = F.greatest(F.ceil(m * t / (2 - t) - 1e-9).cast("int"), F.lit(1)), F.floor(m * (2 - t) / t + 1e-9).cast("int")
    asked = probes.where("probe <> ''").select(a, "probe", m.alias("m"), F.explode(F.sequence(low, F.greatest(low, high))).alias("n")).withColumn("k", parts(F.col("n")))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    first, size = start(F.col("n"), F.col("k"), F.col("part")), start(F.col("n"), F.col("k"), F.col("part") + 1) - start(F.col("n"), F.col("k"), F.col("part"))
    asked = asked.withColumns({"size": size, "from": F.greatest(first - F.col("k") + 1, F.lit(0)), "to": F.least(first + F.col("k") - 1, F.col("m") - size)}).where("from <= to")
    asked = asked.select(a, "n", "part", F.explode(F.array_distinct(F.transform(F.sequence("from", "to"), lambda at: F.substring("probe", at + 1, F.col("size"))))).alias("letters"))
    return asked.join(index, ["n", "part", "letters"]).select(a, b).distinct()


def match_registry(entities: DataFrame, directory: DataFrame, threshold: float = 95) -> DataFrame:
    """Registry matches: an equal normalised name (100), else the best word-sorted ratio of at least threshold that is safe.

    Names meet by parts of their sorted words (see text_blocks), which loses no pair of the threshold; the best candidate is chosen first
    (ties to the first of the directory) and only it is checked for safety. Entities with equal names are normalised and matched once.
    """
    order = [ORDINAL] if ORDINAL in directory.columns else []
    d = first_by(directory.select("ctos_name", "ctos_url", "ctos_registration_no", registry_name("ctos_name").alias("norm"), *order), "norm", keep_ordinal=True)
    # Both sides are written before a filter or join on a normalised name, which would be made part of their scans.
    d, _ = cut_lineage(d.withColumnRenamed(ORDINAL, "_choice") if order else d.withColumn("_choice", F.col("norm")), "registry-names")
    e = cut_lineage(entities.select("legal_name").distinct().withColumn("own", registry_name("legal_name")), "registry-probes")[0].where("own <> ''")
    exact = e.join(d, e["own"] == d["norm"]).select("legal_name", "ctos_name", "ctos_url", "ctos_registration_no", F.lit(100.0).alias("score"), F.lit("exact").alias("method"))
    names = e.select("own").distinct().join(d.select(F.col("norm").alias("own")), "own", "left_anti")
    met = text_blocks(names.select("own", sorted_words(words(F.col("own"))).alias("probe")), d.select("norm", sorted_words(words(F.col("norm"))).alias("text")), "own", "norm", threshold)
    pairs = met.join(d, "norm").withColumn("score", token_sort_ratio_udf("own", "norm")).where(F.col("score") >= threshold)
    best = first_by(pairs.select("own", "norm", "score", "_choice", "ctos_name", "ctos_url", "ctos_registration_no"), "own", F.desc("score"), F.col("_choice"))
    a, b = registry_tokens(F.col("own")), registry_tokens(F.col("norm"))
    best = best.withColumns({"a": a, "b": b}).where((F.size("a") > 0) & (F.size("b") > 0)).withColumn("strong", F.size(F.array_except(F.array_intersect("a", "b"), F.array(*[F.lit(x) for x in rules.REGISTRY_WEAK]))))
    best = best.where("strong > 0").withColumns({"a1": F.element_at("a", 1), "b1": F.element_at("b", 1)}).withColumn("first", ratio_udf("a1", "b1"))
    safe = best.where((F.col("a1") == F.col("b1")) | (F.col("first") >= rules.REGISTRY_FIRST_TOKEN_RATIO) | (F.col("strong") >= 2))
    fuzzy = e.join(safe, "own").select("legal_name", "ctos_name", "ctos_url", "ctos_registration_no", F.round("score", 4).alias("score"), F.lit("fuzzy").alias("method"))
    # A name is in one part at most, and there once.
    found = exact.unionByName(fuzzy)
    return entities.select("lei", "legal_name").join(found, "legal_name").select("lei", "legal_name", "ctos_name", "ctos_url", "ctos_registration_no", F.col("score").alias("ctos_match_score"), F.col("method").alias("ctos_match_method"), F.lit(1).alias("ctos_registered_malaysia"))
