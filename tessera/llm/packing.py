"""Harmonic packing of token sequences.

A document's tokens are cut into whole sequences of CAPACITY and a rest. A rest of r tokens goes to the reciprocal class k with
CAPACITY/(k+1) < r <= CAPACITY/k; if its slot CAPACITY//k would waste more than SLACK of it, a piece that fills a slot of class k+1
exactly is cut off first, and what is left is classed again. Each bin of class k takes exactly k pieces, so bins are
filled independently: a piece's bin follows from its rank in its class, and ranks come from counts per class and hash shard. The
fewer than k pieces left over in each class, at most CLASSES * CLASSES / 2 in all, are packed together by first fit decreasing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import materialise, rows_of, small_batches, table

CAPACITY, CLASSES, SLACK, END_ID = 4096, 256, 0.01, 2
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words whose ids a Python worker keeps.
CACHE = 500_000
# The tokenizer's own splits, and the characters beyond which Python's classes may differ from its.
SPLIT = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|(?:[^\\w\\s]|_)+")  # of lower-cased plain texts
NOT_PLAIN = re.compile("[^\\x00-\u017f]|[\\x1c-\\x1f\\x85\\xa0\u00b2\u00b3\u00b9\u00bc-\u00be\u0130]|<\\|(?:start|end)oftext\\|>")

_encoders: dict[str, "WordEncoder"] = {}


class Kept(dict):
    """Values found once by a function of the key."""

    def __init__(self, find: Callable):
        self.find = find

    def __missing__(self, key):
        value = self[key] = self.find(key)
        return value


class WordEncoder:
    """Ids of whole texts by way of their words.

    This tokenizer lower-cases, drops white space and splits texts into runs of letters, digits and other characters before its
    merges, so a text's ids are those of its splits, one after the other; a split is merged once and kept. Where all characters are
    Latin ones for which Python's case and classes are the tokenizer's own (PLAIN), Python makes the splits and the merges run alone.
    Any other text is parted at ASCII white space, which the tokenizer never merges across, and its words go through all of it.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.splits, self.words = self.tokenizer.model, Kept(self._merged), {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}  # byte-level alphabet

    def _merged(self, split: str) -> bytes:
        return np.array([t.id for t in self.merges.tokenize(split.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if NOT_PLAIN.search(text):
            return self._encode_words([w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()])
        if len(self.splits) > CACHE:
            self.splits.clear()
        return b"".join(map(self.splits.__getitem__, SPLIT.findall(text.lower())))

    def _encode_words(self, words: list[str]) -> bytes:
        known = self.words
        if len(known) > CACHE:
            known.clear()
        new = list(set(words).difference(known))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        return b"".join(map(known.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(total: int) -> list[tuple[int, int]]:
    """(class, length) of a document's pieces in order; the last class takes what is too short for any other."""
    out = [(1, CAPACITY)] * (total // CAPACITY)
    rest = total % CAPACITY
    while rest:
        k = min(CAPACITY // rest, CLASSES)
        if k == CLASSES or CAPACITY // k - rest <= SLACK * rest:
            out.append((k, rest))
            break
        out.append((k + 1, CAPACITY // (k + 1)))
        rest -= CAPACITY // (k + 1)
    return out


PIECES = "doc_id long, part int, start long, length long, ids_crc32 long, doc_tokens long, class int"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of each document (its ids, then END_ID): see PIECES. Null texts are empty: END_ID alone."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int32())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for ids, texts in rows_of(batches):
            rows = []
            for doc, text in zip(ids, texts):
                raw = enc.encode(text or "") + end
                n, at = len(raw) // 4, 0
                for i, (k, size) in enumerate(cut(n)):
                    rows.append((doc, i, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n, k))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


#: A sequence_id is class * STRIDE + the number of the bin in the class; class 0 holds the mixed bins.
STRIDE = 1 << 40


def _mixed(rows: pd.DataFrame) -> pd.DataFrame:
    """First fit decreasing of the leftover pieces: a set whose size CLASSES bounds."""
    rows = rows.sort_values(["length", "doc_id", "part", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
    free, bins, at = np.zeros(0, np.int64), [], []
    for n in rows["length"]:
        fits = np.flatnonzero(free >= n)
        if not len(fits):
            free = np.append(free, CAPACITY)
            fits = [len(free) - 1]
        bins.append(int(fits[0]))
        at.append(CAPACITY - int(free[fits[0]]))
        free[fits[0]] -= n
    return rows.assign(sequence_id=np.array(bins, np.int64), offset=np.array(at, np.int64)).drop(columns=["part", "class", "pool"])


def pack(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    docs: doc_id, text (others ignored). Null and empty texts give one piece, END_ID. Repeated rows are packed each on their own; a
    null doc_id keeps its rows. An empty table gives no rows. Shards of a class are dealt by a hash of the whole piece, so one
    document or class with a third of all rows spreads over all of them.
    """
    spark = docs.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = materialise(pieces(docs, vocabulary).withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", "doc_tokens", "ids_crc32"), F.lit(shards)).cast("int")), "pieces")
    # At most CLASSES * shards counts: running totals of a class give each shard its first rank.
    sizes = cuts.groupBy("class", "shard").count()
    before = F.sum("count").over(W.partitionBy("class").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    firsts = sizes.select("class", "shard", F.coalesce(before, F.lit(0)).alias("first"), F.sum("count").over(W.partitionBy("class")).alias("of_class"))
    rank = F.row_number().over(W.partitionBy("class", "shard").orderBy("doc_id", "part", "ids_crc32")) - 1
    ranked = cuts.withColumn("rank", rank).join(F.broadcast(firsts), ["class", "shard"]).withColumn("rank", F.col("rank") + F.col("first"))
    full = F.expr("of_class - of_class % class")
    bins = ranked.withColumn("bin", F.expr("rank div class"))
    # Pieces of a bin differ in length by SLACK at most, so offsets are running sums over at most CLASSES rows.
    offset = F.coalesce(F.sum("length").over(W.partitionBy("class", "bin").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    filled = bins.where(F.col("rank") < full).select(*names, (F.col("class").cast("long") * F.lit(STRIDE) + F.col("bin")).alias("sequence_id"), offset.alias("offset"))
    left = ranked.where(F.col("rank") >= full).select(*names, "part", "class", F.lit(0).alias("pool"))
    mixed = left.groupBy("pool").applyInPandas(_mixed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return filled.unionByName(mixed)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
