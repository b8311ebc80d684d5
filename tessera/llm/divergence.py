"""How the sources of a language differ in their words: a systolic audit of term distributions.

Each language keeps the terms of at least LEAST of its documents. Its terms are dealt into shards by hash, so that no vector is larger than
a shard, and each source (a group) has a compressed vector of counts in every shard. These vectors stay in their partitions; in the rounds of
a round-robin tournament every group meets every other once, where the one's vector travels to the other's partition and both directions of the
divergence are summed. Terms that neither counts add a constant each, so vectors hold only counted terms. What a group has more of than its
language is ranked in a heap beside each vector, and the heaps are merged.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise, small_batches, table

#: Documents that a kept term needs, the scale of p, and the terms that are reported for a group.
LEAST, SCALE, RANKS = 3, 1_000_000_000, 200
#: Documented parameters: counted terms of a shard, aimed at; rounds of one job, whose vectors travel at once; entries that a task counts
#: before it passes them on; meetings of one output batch.
SHARD, WAVE, HELD, MEETINGS = 16_384, 32, 200_000, 512

#: A-Z to a-z, other ASCII letters and bytes of longer characters as they are, all other bytes to a blank.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), with a null term once or more for each group; summed in each task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, dict[bytes, int]] = {}
        held: dict[tuple, dict[bytes, int]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys = [k for k, own in n.items() for _ in range(len(own) + 1)]
            terms = [t for own in n.values() for t in (None, *own)]
            ns = [x for own in n.values() for x in (0, *own.values())]
            ds = [x for k, own in n.items() for x in (0, *map(held[k].__getitem__, own))]
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64()), pa.array(ds, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                key = lang or "", source or ""
                if key not in n:
                    n[key], held[key], size = {}, {}, size + 1
                own, docs = n[key], held[key]
                before = len(own)
                for t, x in Counter((text or "").encode().translate(WORDS).split()).items():
                    own[t] = own.get(t, 0) + x
                    docs[t] = docs.get(t, 0) + 1
                size += len(own) - before
                if size > HELD:
                    yield out()
                    n, held, size = {}, {}, 0
        if n:
            yield out()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p = 1 + floor(SCALE * (count + 1) / (total + terms)), by long division in thousands, so that no product leaves 64 bits."""
    rest, whole, d = counts.astype(np.int64) + 1, np.zeros(len(counts), np.int64), max(1, total + terms)
    whole, rest = rest // d, rest % d
    for _ in range(3):  # SCALE is a thousand thrice
        whole, rest = whole * 1000 + rest * 1000 // d, rest * 1000 % d
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f = floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


def compressed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted term numbers as steps, and their counts."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + counts.astype("<u8").tobytes(), 1)


def expanded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n)).astype(np.int64), np.frombuffer(raw, "<u8", n, 4 * n).astype(np.int64)


def meeting(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], na: int, nb: int, terms: int) -> tuple[int, int, int]:
    """Terms that either counts, and over them the sums of a against b and of b against a."""
    ids = np.union1d(a[0], b[0])
    x, y = np.zeros((2, len(ids)), np.int64)
    x[np.searchsorted(ids, a[0])], y[np.searchsorted(ids, b[0])] = a[1], b[1]
    p, q = shares(x, na, terms), shares(y, nb, terms)
    return len(ids), int(apart(p, q).sum()), int(apart(q, p).sum())


def partner(seat: Column, r: Column, seats: Column) -> Column:
    """Whom a seat meets in round r of 0 to seats - 2 (seats even): the circle method, in which the last seat stays and the others turn."""
    turn = seats - 1
    other = F.pmod(2 * r - seat, turn)
    return F.when(seat == turn, r).when(other == seat, turn).otherwise(other)


def _seated(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n, terms, lang_n, shards, seat, seats (even), groups: a row for each group, of as many as there are sources."""
    of = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("first").cast("long")).alias("terms"), F.ceil(F.count(F.lit(1)) / SHARD).alias("shards"))
    own = counts.select("lang", "source").distinct().join(of, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    many = F.count(F.lit(1)).over(W.partitionBy("lang"))
    placed = own.withColumns({"seat": F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1, "groups": many.cast("int")})
    return placed.withColumn("seats", F.col("groups") + F.col("groups") % 2)


def _vectors(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, shard, seat, vector, top: of each group in each shard, its compressed counts and its RANKS most excessive terms."""
    names = groups.select("lang", "source", "n", "terms", "lang_n", "shards", "seat", "groups")
    rows = kept.withColumnRenamed("n", "count").withColumnRenamed("lang_n", "lang_count").join(names, ["lang", "source"])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        lang, shard, terms, lang_n, most = (rows[c].iloc[0] for c in ("lang", "shard", "terms", "lang_n", "groups"))
        rows = rows.assign(id=pd.factorize(rows["term"], sort=True)[0]).sort_values(["seat", "id"])
        own = dict(iter(rows.groupby("seat")))
        out = []
        for seat in range(most):
            if seat not in own:
                out.append((lang, shard, seat, compressed(np.zeros(0, np.int64), np.zeros(0, np.int64)), []))
                continue
            g = own[seat]
            p, q = shares(g["count"].to_numpy(), int(g["n"].iloc[0]), int(terms)), shares(g["lang_count"].to_numpy(), int(lang_n), int(terms))
            f, more, names = apart(p, q), np.flatnonzero(p > q), g["term"].to_numpy()
            top = heapq.nsmallest(RANKS, ((-int(f[i]), names[i]) for i in more))
            out.append((lang, shard, seat, compressed(g["id"].to_numpy(), g["count"].to_numpy()), [{"item": t, "value": -v} for v, t in top]))
        return pd.DataFrame(out, columns=["lang", "shard", "seat", "vector", "top"])

    schema = "lang string, shard long, seat int, vector binary, top array<struct<item: string, value: long>>"
    return rows.groupBy("lang", "shard").applyInPandas(pack, schema)


def _sums(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, counted, value: for each ordered pair of seats that meet, summed over its shards."""
    spark = vectors.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seated = vectors.select("lang", "shard", "seat", "vector").join(groups.select("lang", "seat", "seats", "n", "terms"), ["lang", "seat"])
    # The residents stay where they are, round after round; a lost executor's are read again from the written vectors.
    resident = seated.repartition(n, "lang", "shard", "seat").persist()
    most = groups.agg(F.max("seats")).first()[0] or 0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MEETINGS):
                lang, a, b, na, nb, terms, va, vb = (c.to_pylist() for c in batch.slice(at, MEETINGS).columns)
                got = [meeting(expanded(x), expanded(y), p, q, v) for x, y, p, q, v in zip(va, vb, na, nb, terms)]
                both = [pa.array([*a, *b], pa.int32()), pa.array([*b, *a], pa.int32()), pa.array([g[0] for g in got] * 2, pa.int64()), pa.array([g[1] for g in got] + [g[2] for g in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(lang * 2, pa.string()), *both], ["lang", "a", "b", "counted", "value"])

    waves = []
    for start in range(0, most - 1, WAVE):
        r = F.explode(F.sequence(F.lit(start), F.least(F.lit(start + WAVE - 1), F.col("seats") - 2)))
        travel = seated.where(F.col("seats") - 2 >= start).select("*", r.alias("r")).withColumn("host", partner(F.col("seat"), F.col("r"), F.col("seats")))
        # Of a pair one travels: in even rounds the higher seat, in odd ones the lower, so that hosts change.
        travel = travel.where((F.col("seat") > F.col("host")) == (F.col("r") % 2 == 0)).select("lang", "shard", F.col("host").alias("seat"), F.col("seat").alias("guest"), F.col("n").alias("guest_n"), F.col("vector").alias("guest_vector"))
        # The residents' rows are not counted on to be few or small: no side is sent to all workers.
        met = resident.hint("shuffle_hash").join(travel, ["lang", "shard", "seat"])
        part = met.select("lang", "seat", "guest", "n", "guest_n", "terms", "vector", "guest_vector").mapInArrow(meet, "lang string, a int, b int, counted long, value long")
        waves.append(materialise(part.groupBy("lang", "a", "b").agg(F.sum("counted").alias("counted"), F.sum("value").alias("value")), "divergence-wave"))
    resident.unpersist()
    out = waves[0] if waves else spark.createDataFrame([], "lang string, a int, b int, counted long, value long")
    for more in waves[1:]:
        out = out.unionByName(more)
    return out


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: each group against its peers (`pair`: the other sources) and its language (`term`).

    docs: lang, source, text (others ignored); nulls are read as ''. Every row is a document, repeated ones too. Terms are runs of ASCII letters
    and of characters beyond ASCII, only A-Z lowered; a language keeps those in at least three documents. A pair's value sums, over all kept
    terms, how far the group's shares lie from the peer's, and is 0 where a language keeps none; a language of one source has no pair. A term's
    value is its own, for terms that the group has more of than its language, to rank RANKS. Equal values go by the item's bytes. Texts are
    counted whole; a text's own terms and HELD counts are what a task holds. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    raw = term_counts(docs)
    counts = materialise(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    word = W.partitionBy("lang", "term")
    of = counts.where("term is not null").withColumns({"lang_docs": F.sum("docs").over(word), "lang_n": F.sum("n").over(word), "first": F.row_number().over(word.orderBy("source")) == 1})
    kept = materialise(of.where(F.col("lang_docs") >= LEAST).select("lang", "source", "term", "n", "lang_n", "first"), "divergence-terms")
    groups = materialise(_seated(counts, kept), "divergence-groups")
    vectors = materialise(_vectors(kept.drop("first"), groups), "divergence-vectors")
    sums = _sums(vectors, groups)
    least = F.expr(f"1L + {SCALE} div greatest(n + terms, 1)")  # p of a count of 0
    # Every pair, from the tournament's own schedule.
    rounds = F.explode(F.sequence(F.lit(0), F.col("seats") - 2))
    pairs = groups.where("groups > 1").select("lang", F.col("source").alias("source"), F.col("seat").alias("a"), "terms", "seats", least.alias("p"), rounds.alias("r"))
    pairs = pairs.withColumn("b", partner(F.col("a"), F.col("r"), F.col("seats")))
    peers = groups.select("lang", F.col("seat").alias("b"), F.col("source").alias("item"), least.alias("q"))
    full = pairs.join(peers, ["lang", "b"]).join(sums, ["lang", "a", "b"], "left")
    rest = (F.col("terms") - F.coalesce("counted", F.lit(0))) * F.expr("(p - q) * (p - q) div q")
    pair = full.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("terms") == 0, 0).otherwise(F.coalesce("value", F.lit(0)) + rest).cast("long").alias("value"))
    tops = vectors.select("lang", "seat", F.inline("top")).join(groups.select("lang", "seat", "source"), ["lang", "seat"])
    term = tops.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda df: df.withColumn("rank", place.cast("int"))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= RANKS))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {
    "op13_source_divergence": r"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), words AS MATERIALIZED (SELECT lang, source, term, d, count(*) AS n FROM (SELECT lang, source, d, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM words GROUP BY ALL HAVING count(*) >= 3),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
counted AS MATERIALIZED (SELECT w.lang, source, w.term, CAST(sum(w.n) AS BIGINT) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY 1),
of AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY ALL),
grid AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(o.n, 0) + t.v) AS p
    FROM groups g JOIN kept k USING (lang) JOIN totals t USING (lang) LEFT JOIN of o ON o.lang = g.lang AND o.source = g.source
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), met AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
), over AS (
    SELECT g.lang, g.source, g.term AS item, p, 1 + (1000000000 * (k.n + 1)) // (t.n + t.v) AS q
    FROM grid g JOIN kept k ON k.lang = g.lang AND k.term = g.term JOIN totals t ON t.lang = g.lang WHERE g.n > 0
), terms AS (SELECT lang, source, item, ((p - q) * (p - q)) // q AS value FROM over WHERE p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200"""
}
