"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted calibrated votes.

Terms are the words of the lower-cased whole text; every word of the examples is a term. A word's weight is (1 + ln tf) * idf * telling:
telling is the log-likelihood ratio of the two classes for the word plus FLOOR, because plain TF-IDF looks for texts on the same subject,
not of the same tone (figures in the README). Examples are a bounded sample of labelled rows (MAX_EXAMPLES of each class). Their lists
are cut in blocks of BLOCK examples, each with its highest weight; a search adds up the blocks' bounds first and reads the postings of a
block only if its bound can reach the K-th best cosine so far, so its result is that of comparing all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, label_sample, rows_of, small_batches, table
from tessera.llm.quality import platt

#: Documented parameters: labelled rows of each class, neighbours, examples of a block, blocks that the first passes read at most.
MAX_EXAMPLES, K, BLOCK, PASSES, SEED = 1500, 25, 64, (4, 12), 3
FOLDS, HELD_OUT = 5, 0
#: A vote's weight is cosine to this power; the least telling of a word.
SHARP, FLOOR = 4, 0.05
WORD = re.compile(r"\w+")
#: Words of longer texts are counted one by one, not gathered in a list.
PART = 1 << 20


def bag(text: str) -> Counter:
    """The words of a text in lower case, with their counts."""
    text = text.lower()
    return Counter(WORD.findall(text)) if len(text) < PART else Counter(m[0] for m in WORD.finditer(text))


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, size), one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _llr(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio (G squared) of words in a of n1 and in b of n0 texts against one common rate."""
    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    rate = (a + b) / (n1 + n0)
    return np.maximum(2 * (part(a, n1 * rate) + part(b, n0 * rate) + part(n1 - a, n1 * (1 - rate)) + part(n0 - b, n0 * (1 - rate))), 0.0)


class Index:
    """TF-IDF vectors of the examples as block-max inverted lists, and the calibration of votes."""

    def __init__(self, bags: list[dict[str, int]], labels: np.ndarray, ids: np.ndarray, digests: np.ndarray, prior: float):
        """prior: the share of label 1 outside the sample."""
        self.prior, self.n = prior, len(bags)
        self.n1, self.n0 = int(labels.sum()), int((1 - labels).sum())
        self.terms: dict[str, int] = {}
        term = np.array([self.terms.setdefault(w, len(self.terms)) for b in bags for w in b], np.int64)
        tf = np.array([c for b in bags for c in b.values()], float)
        owner = np.repeat(np.arange(self.n), [len(b) for b in bags]) if self.n else np.zeros(0, np.int64)
        df = np.bincount(term, minlength=len(self.terms)).astype(float)
        df1 = np.bincount(term, labels[owner] if self.n else None, len(self.terms))
        self.weight_of = (np.log((1 + self.n) / (1 + df)) + 1) * (_llr(df1, df - df1, max(self.n1, 1), max(self.n0, 1)) + FLOOR)
        w = (1 + np.log(tf)) * self.weight_of[term]
        w /= np.sqrt(np.bincount(owner, w * w, self.n))[owner] if self.n else 1.0
        # Like examples in one block: by class, then by their commonest word (which tells the language), then by size.
        common = np.full(self.n, -1)
        by = np.lexsort((term, df[term], owner))
        common[owner[by]] = term[by]
        sizes = np.bincount(owner, minlength=self.n)
        place = np.lexsort((ids, sizes, common, labels)) if self.n else np.zeros(0, np.int64)
        self.ids, self.labels = ids[place], labels[place]
        at = np.empty(self.n, np.int64)
        at[place] = np.arange(self.n)
        self.blocks = -(-self.n // BLOCK)
        self.same: dict[int, list[int]] = {}
        for i, d in enumerate(digests[place].tolist()):
            self.same.setdefault(d, []).append(i)
        # Postings by term, then example; a block's part of a list is an entry.
        order = np.lexsort((at[owner], term))
        self.at, self.weight = at[owner][order].astype(np.int32), w[order]
        key = term[order] * max(self.blocks, 1) + self.at // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.start, self.size = first, np.diff(first, append=len(key))
        self.block = (key[first] % max(self.blocks, 1)).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entry = np.searchsorted(key[first], np.arange(len(self.terms) + 1) * max(self.blocks, 1))
        self.entries = np.diff(self.entry)
        bare = sizes == 0
        one, zero = (labels[bare].sum() / max(self.n1, 1) + 0.01) * prior, ((1 - labels[bare]).sum() / max(self.n0, 1) + 0.01) * (1 - prior)
        self.bare_score, self.slope, self.offset = float(one / (one + zero)), 1.0, 0.0
        #: Blocks that held a word of a query, and those whose postings were read.
        self.met = self.read = 0

    def vector(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights of a text. Words of no example take no part."""
        t = np.array([self.terms.get(w, -1) for w in words], np.int64)
        n = np.fromiter(words.values(), float, len(words))[t >= 0]
        t = t[t >= 0]
        if not len(t):
            return t, n
        w = (1 + np.log(n)) * self.weight_of[t]
        return t, w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K, skip: list[int] | tuple = ()) -> list[tuple[float, int]]:
        """The k best (cosine, example), highest first, ties to the smaller id of an example; those of skip are left out."""
        if not len(terms) or not self.n:
            return []
        size = self.entries[terms]
        entries, weight = _ranges(self.entry[terms], size), np.repeat(weights, size)
        block = self.block[entries]
        bound = np.bincount(block, weight * self.top[entries], self.blocks)
        waiting = np.argsort(-bound, kind="stable")
        waiting = waiting[bound[waiting] > 0]
        self.met += len(waiting)
        rows, cosines, floor = np.zeros(0, np.int64), np.zeros(0), -1.0
        for take in (*PASSES, len(waiting)):
            some = waiting[:take]
            some = some[bound[some] >= floor - 1e-9]
            if not len(some):
                break
            waiting = waiting[take:]
            self.read += len(some)
            use = np.zeros(self.blocks, bool)
            use[some] = True
            mine = use[block]
            own = entries[mine]
            size = self.size[own]
            postings = _ranges(self.start[own], size)
            score = np.bincount(self.at[postings], np.repeat(weight[mine], size) * self.weight[postings], self.n)
            if len(skip):
                score[skip] = 0
            found = np.flatnonzero(score)
            rows, cosines = np.concatenate([rows, found]), np.concatenate([cosines, score[found]])
            if len(rows) > k:
                floor = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
                rows, cosines = rows[cosines >= floor], cosines[cosines >= floor]
        order = np.lexsort((self.ids[rows], -cosines))[:k]
        return [(float(cosines[i]), int(rows[i])) for i in order]

    def raw(self, found: list[tuple[float, int]]) -> float:
        """Log odds of the weighted votes, each class's votes by its size in the sample."""
        votes = [1e-3, 1e-3]
        for s, i in found:
            votes[int(self.labels[i])] += s**SHARP
        return float(np.log(votes[1] / max(self.n1, 1)) - np.log(votes[0] / max(self.n0, 1)))

    def calibrate(self, bags: list[dict[str, int]], labels: np.ndarray, digests: np.ndarray) -> None:
        """Slope and offset of the votes, by leaving each example's text out in turn; then shifted from the sample's balance to the prior's."""
        some = [i for i, b in enumerate(bags) if b]
        raw = np.array([self.raw(self.nearest(*self.vector(bags[i]), skip=self.same[int(digests[i])])) for i in some])
        y = labels[some] if some else np.zeros(0)
        if len(set(y.tolist())) == 2:
            self.slope, self.offset = platt(raw, y)
            self.offset += float(np.log(self.prior / (1 - self.prior)) - np.log(self.n1 / self.n0))
        self.met = self.read = 0

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """The score, and its evidence: (doc_id, cosine, label) of the nearest examples of another text."""
        found = self.nearest(*self.vector(bag(text)), skip=self.same.get(digest(text), ())) if text else []
        if not found:
            return self.bare_score, []
        z = self.slope * self.raw(found) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40)))), [(int(self.ids[i]), s, int(self.labels[i])) for s, i in found]


def train(docs: DataFrame, labels: DataFrame) -> Index:
    """From at most 2 * MAX_EXAMPLES labelled rows outside the held-out fold: their bags of words, not their texts, reach the driver.

    All of them calibrate the votes, each without examples of its own text. Without examples of both classes there is no index.
    """
    able = labels.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    rate = able.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    sample = label_sample(able, "toxic", docs, MAX_EXAMPLES, SEED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            bags = [bag(t) for t in texts]
            tf = pa.array([list(x.items()) for x in bags], pa.map_(pa.string(), pa.int32()))
            hashes = pa.array([digest(t) - (1 << 63) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), hashes, tf], ["doc_id", "y", "digest", "bag"])

    got = sample.select("doc_id", "y", "text").mapInArrow(count, "doc_id long, y int, digest long, bag map<string,int>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["digest"]))
    y = np.array([r["y"] for r in got], int)
    if len(set(y.tolist())) < 2:
        none = np.zeros(0, np.int64)
        return Index([], none, none, none, (int(y.sum()) + 1) / (len(y) + 2))
    bags = [dict(sorted(r["bag"].items())) for r in got]
    digests = np.array([r["digest"] + (1 << 63) for r in got], np.uint64)
    index = Index(bags, y, np.array([r["doc_id"] for r in got], np.int64), digests, min(max(float(rate), 1e-3), 1 - 1e-3))
    index.calibrate(bags, y, digests)
    return index


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, nearest long, nearest_cosine double, n_votes int"


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the evidence: nearest example's doc_id, its cosine, and how many examples voted.

    docs: doc_id, text; labels: doc_id, toxic (others ignored). A text without a word of any example (null and empty ones too) gets the
    rate of label 1 among such examples, and no evidence. Examples of the very same text never vote, so a labelled row's score does not
    rest on its own label. Rows are scored one by one, so repeated rows repeat; equal cosines go to the smaller doc_id. Without labels
    of both classes every score is the smoothed label rate. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kinds = (pa.int64(), pa.bool_(), pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = iter(batch.column("held_out").to_pylist())
            for ids, texts in rows_of(iter([batch])):
                out = [shared.value.score(t) for t in texts]
                cols = [ids, [next(held) for _ in ids], [s for s, _ in out], [int(s >= 0.5) for s, _ in out], [e[0][0] if e else None for _, e in out], [e[0][1] if e else None for _, e in out], [len(e) for _, e in out]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "held_out", "score", "predicted", "nearest", "nearest_cosine", "n_votes"])

    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, SCHEMA)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE: dict[str, str] = {}
