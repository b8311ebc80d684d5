"""SimHash near-duplicates with pivot distance tables.

Distinct fingerprints meet in buckets that any two within RADIUS bits must share (two of four quarters are equal, when at most two
bits differ). A bucket that grows past HOT members is dealt again by two of four eighths of its other half, which two bits cannot
all touch either. In a bucket, each fingerprint has a table of distances to PIVOTS reference fingerprints; by the triangle
inequality a pair whose tables differ by more than RADIUS anywhere is no link and is discarded; survivors are verified by XOR.
Only links that join two trees of the bucket leave it, so a group of copies gives as many rows as members, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.common import materialise, rows_of, small_batches, table
from tessera.operators.components import WRITTEN, component_labels, cut_lineage, drop_table

RADIUS, PIVOTS, HOT, SHINGLE = 2, 16, 4096, 3
#: keep_one() marks the rows to drop in bitmaps of BITS rows of a file, and sends so many of them (4 KB each) to the executors at once.
BITS, BITMAPS = 32_768, 16_384
#: Shingle hashes that are held at once.
PART = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits; bit i is set if it is set in over half of the shingle hashes. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        spans = zip(starts[at : min(at + PART, n)].tolist(), ends[at + k - 1 : min(at + PART, n) + k - 1].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.dtype("<u8"))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), and more columns of docs, which must be long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in rows_of(iter([batch])):
                rest = [batch.column(c).slice(at, len(ids)) for c in more]
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_signed(fingerprint(t)) for t in texts], pa.int64()), *rest], ["doc_id", "fp", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(run, ", ".join(f"`{c}` long" for c in ("doc_id", "fp", *more)))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: any fixed, spread values serve."""
    return np.random.default_rng(8).integers(0, 1 << 64, n, np.uint64)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64))


def links_in_bucket(fps: np.ndarray, refs: np.ndarray) -> list[tuple[int, int]]:
    """Links within RADIUS that make a spanning forest of the bucket's link graph (fps: distinct, uint64)."""
    tables = np.stack([popcount(fps ^ p) for p in refs], axis=1).astype(np.int8)
    order = np.lexsort((tables[:, 1], tables[:, 0]))
    fps, tables = fps[order], tables[order]
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    out = []
    first = tables[:, 0]
    # Sorted by the first coordinate: a partner stands at most RADIUS further, the rest is discarded unseen.
    upto = np.searchsorted(first, first + RADIUS, "right")
    for i in range(len(fps)):
        near = np.arange(i + 1, upto[i])
        if len(near):
            near = near[(np.abs(tables[near] - tables[i]) <= RADIUS).all(axis=1)]
            for j in near[popcount(fps[near] ^ fps[i]) <= RADIUS]:
                a, b = find(i), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(fps[i]), int(fps[j])))
    return out


def _choices(fp: Column, parts: list[tuple[int, int]], choose: int, tag: Column | None = None) -> Column:
    """An array of (bucket) keys: for each choice of parts (shift, width), its number, those bits, and the caller's tag."""
    keys = []
    for n, some in enumerate(combinations(parts, choose)):
        bits = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in some]
        fields = [F.lit(n), *bits] + ([tag] if tag is not None else [])
        keys.append(F.xxhash64(*fields))
    return F.array(*keys)


QUARTERS = [(0, 16), (16, 16), (32, 16), (48, 16)]
EIGHTHS = [(s, 8) for s in range(0, 64, 8)]


def bucket_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): equal keys may also come from a hash collision, which only adds pairs that are then discarded."""
    keyed = fps.select("fp", F.explode(_choices(F.col("fp"), QUARTERS, RADIUS)).alias("key"))
    sizes = keyed.groupBy("key").count()
    hot = sizes.where(F.col("count") > HOT).select("key")
    # Singles go: nothing can meet there.
    shared = sizes.where(F.col("count").between(2, HOT)).select("key")
    # Of eight eighths, two bits touch two at most: six are equal. The 28 choices of six split a hot bucket by 48 bits.
    again = keyed.join(hot, "key", "left_semi").select(F.explode(_choices(F.col("fp"), EIGHTHS, 8 - RADIUS, F.col("key"))).alias("key"), "fp")
    return keyed.join(shared, "key", "left_semi").select("key", "fp").unionByName(again)


def links(fps: DataFrame) -> DataFrame:
    """(src, dst) for distinct fingerprints in fps (column fp): enough links for the components, never all pairs of a group."""
    spark = fps.sparkSession
    refs = pivots()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.int64)

        def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(key)) + 1
            out = [x for part in np.split(fp, cuts) if len(part) > 1 for x in links_in_bucket(np.unique(part).view(np.uint64), refs)]
            flat = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["src", "dst"])

        for b in batches:
            key, fp = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([fp, b.column(1).to_numpy()])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on in the next batch
            if last:
                yield found(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield found(key, fp)

    return bucket_keys(fps).repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the smallest doc_id that links of RADIUS bits or fewer reach, itself included.

    docs: doc_id, text (others ignored). Null and wordless texts have fingerprint zero and link like any other. Repeated rows give
    repeated results; a null doc_id keeps its row and never is a component_id unless all its component's ids are null. An empty
    table gives no rows. Documents with equal fingerprints are one vertex, so large groups of copies cost nothing beyond their rows.
    """
    fps = materialise(fingerprints(docs), "simhash")
    whole = _least(fps, F.col("doc_id")).withColumnRenamed("least", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(whole, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _least(fps: DataFrame, key: Column) -> DataFrame:
    """(fp, least): for each distinct fp, the least key of its component's rows."""
    distinct = fps.groupBy("fp").agg(F.min(key).alias("first"))
    edges = materialise(links(distinct.select("fp")), "simhash-links")
    # Only vertices with a link go through the components; the others are their own.
    labels = component_labels(edges)
    firsts = labels.join(distinct, labels["node"] == distinct["fp"]).groupBy("component").agg(F.min("first").alias("least"))
    of = labels.join(firsts, "component").select(F.col("node").alias("fp"), "least")
    return distinct.join(of, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))


def _file_seed(docs: DataFrame) -> int:
    """A seed for which the hashes of all files' paths differ: almost surely the first. Only files' names and row counts are read."""
    paths = docs.select(F.col("_metadata.file_path").alias("p")).distinct()
    for seed in range(42, 52):
        n, different = paths.agg(F.count(F.lit(1)), F.count_distinct(F.xxhash64("p", F.lit(seed)))).first()
        if n == different:
            return seed
    raise RuntimeError("files' paths cannot be told apart")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, all columns: the row with the smallest doc_id, null ids last, then the first row by place.

    Rows are told apart by their place (file and row number), so repeated ids and null ids leave one row as well. docs: doc_id, text and
    any others, whose names may clash; if it is not read from Parquet it is written first. Null and wordless texts make one group. An
    empty table stays empty. Only places and ids are shuffled: the rows to drop become bits of their files, an eighth of a byte for each
    row whatever their number, and texts pass a filter where they are read. Files are dealt into parts of BITMAPS bitmaps or so, one part
    for half a thousand million rows, and each part's bitmaps go to the tasks that read its files.
    """
    spark = docs.sparkSession
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialise(docs, "documents")
    names: list[str] = []
    for name in ("file", "row", "bucket", "bits"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    file, row, bucket, bits = names
    before = set(WRITTEN)
    placed = docs.select("*", F.xxhash64("_metadata.file_path", F.lit(_file_seed(docs))).alias(file), F.col("_metadata.row_index").alias(row))
    fps = materialise(fingerprints(placed, (file, row)), "simhash")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col(file), F.col(row))
    joined = fps.join(_least(fps, key), "fp")
    extra = joined.where((F.col(file) != F.col("least")[file]) | (F.col(row) != F.col("least")[row])).select(file, row)
    at = (F.col(row) / BITS).cast("long").alias(bucket)
    marked, path = cut_lineage(extra.groupBy(file, at).agg(F.bitmap_construct_agg(F.col(row) % BITS).alias(bits)), "simhash-extra")
    for old in [p for p in WRITTEN if p not in before and p != path]:
        drop_table(spark, old)
    parts = max(1, -(-marked.count() // BITMAPS))
    # Of a bitmap, the byte that holds the row's bit.
    place = F.col(row) % BITS
    byte = F.conv(F.hex(F.substring(F.col(bits), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    gone = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place % 8).cast("int") + 1)) != 0, F.lit(False))
    out = None
    for part in range(parts):
        own = lambda df: df.where(F.pmod(F.col(file), F.lit(parts)) == part) if parts > 1 else df  # noqa: B023, E731
        some = own(placed).withColumn(bucket, (F.col(row) / BITS).cast("long")).join(F.broadcast(own(marked)), [file, bucket], "left").where(~gone).select(docs.columns)
        out = some if out is None else out.unionByName(some)
    return out


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
