"""Language ID by interpolated Kneser-Ney character models.

A model reads a word as `` word `` in lower case: its characters and the closing blank are predicted from up to ORDER - 1 characters
before them. Texts are scored whole; since a word's log probability depends on the word alone, a worker computes it once per word.
All languages share sorted hash arrays of n-grams and contexts, beside matrices with one column per language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, materialise, rows_of, small_batches, table

#: Documented parameters: longest n-gram; training documents of a language; one document in DEV calibrates, LEAST_DEV at least where a quarter has them; folds; words that a worker keeps.
ORDER, MAX_DOCS, DEV, LEAST_DEV, FOLDS, HELD_OUT, CACHE, SEED = 4, 1500, 25, 20, 4, 2, 250_000, 7
#: Values of the hash that draws the training documents.
DRAW = 1 << 40
#: A text is rejected when its cross-entropy (bits a character) passes this quantile of its language's held-back texts plus the margin.
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 0.75
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
_B = np.uint64(0x100000001B3)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each predicted character of `` word `` (0 where it would start before the word), and of their contexts."""
    joined = "".join(f" {w} " for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    place = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = np.zeros(len(c), np.uint64)
    ctx = np.full(len(c), n, np.uint64)
    for j in range(n - 1, 0, -1):
        ctx = ctx * _B + np.concatenate([np.zeros(min(j, len(c)), np.uint64), c[:-j]])[: len(c)] + np.uint64(1)
    h = _finish(ctx * _B + c + np.uint64(1))
    ok = (place >= max(n - 1, 1))
    use = place >= 1
    return np.where(ok, h, 0)[use], np.where(ok, _finish(ctx), 0)[use]


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)


class Model:
    """languages; per order the sorted hashes of grams with discounted probabilities, and of contexts with back-off weights."""

    def __init__(self, counts: dict[str, Counter]):
        """counts: raw_grams of each language."""
        self.languages = sorted(counts)
        self.uniform = 1 / (len({g for grams in counts.values() for g in grams if len(g) == 1} - {" "}) + 2)
        grams = [[] for _ in range(ORDER)]
        contexts = [[] for _ in range(ORDER)]
        for lang in self.languages:  # one language's dictionaries at a time
            for n, found in enumerate(count_orders(counts[lang]), 1):
                c = np.fromiter(found.values(), float, len(found))
                chars = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                d = (c == 1).sum() / ((c == 1).sum() + 2 * (c == 2).sum()) if (c == 1).any() else 0.5
                before, place = np.unique(_hash(chars[:, :-1], n), return_inverse=True)
                total, kinds = np.bincount(place, c), np.bincount(place)
                grams[n - 1].append((_hash(chars, n), np.maximum(c - d, 0) / total[place]))
                contexts[n - 1].append((before, d * kinds / total))
        self.orders = [(*_merged(g, 0.0), *_merged(c, 1.0)) for g, c in zip(grams, contexts)]

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Sum of log2 probabilities of each word's characters, by language (float64, words x languages)."""
        sizes = np.array([len(w) + 1 for w in words])
        p = np.full((sizes.sum(), len(self.languages)), self.uniform)
        for n, (grams, probs, contexts, backs) in enumerate(self.orders, 1):
            h, ctx = _grams(words, n)
            at, there = _look(grams, h)
            k, known = _look(contexts, ctx)
            p *= np.where(known[:, None], backs[k], 1.0)
            p += np.where(there[:, None], probs[at], 0.0)
        return np.add.reduceat(np.log2(np.maximum(p, 1e-12)), np.cumsum(sizes) - sizes, axis=0)


def _look(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def _hash(chars: np.ndarray, n: int) -> np.ndarray:
    """The hashes that _grams gives to n-grams, or to the contexts of n-grams: one row of chars each."""
    h = np.full(len(chars), n, np.uint64)
    for j in range(chars.shape[1]):
        h = h * _B + chars[:, j] + np.uint64(1)
    return _finish(h)


def _merged(tables: list[tuple[np.ndarray, np.ndarray]], absent: float) -> tuple[np.ndarray, np.ndarray]:
    """All languages' hashes in order, and a matrix of values beside them with a column for each."""
    keys = np.unique(np.concatenate([h for h, _ in tables] or [np.zeros(0, np.uint64)]))
    out = np.full((len(keys), len(tables)), absent)
    for k, (h, v) in enumerate(tables):
        out[np.searchsorted(keys, h), k] = v
    return keys, out


def raw_grams(words: dict[str, int]) -> Counter:
    """Occurrences of the n-grams of orders 1 to ORDER that end at a predicted character of `` word ``. Those of more words add up."""
    out: Counter = Counter()
    for w, c in words.items():
        s = f" {w} "
        for n in range(1, ORDER + 1):
            for i in range(max(n - 1, 1), len(s)):
                out[s[i - n + 1 : i + 1]] += c
    return out


def count_orders(grams: dict[str, int]) -> list[Counter]:
    """Counts for orders 1 to ORDER: of occurrences for the longest and for those that start a word, else of kinds of preceding characters."""
    raw = [Counter() for _ in range(ORDER)]
    for g, c in grams.items():
        raw[len(g) - 1][g] = c
    out = [Counter() for _ in range(ORDER)]
    out[-1] = raw[-1]
    for n in range(ORDER - 1, 0, -1):
        for g in raw[n]:
            out[n - 1][g[1:]] += 1
        # An n-gram at the start of a word has nothing before it: its occurrences count.
        for g, c in raw[n - 1].items():
            if g[0] == " " and n > 1:
                out[n - 1][g] = max(out[n - 1][g], c)
    return out


_caches: dict[int, tuple[dict, list]] = {}


def cross_entropies(model: Model, key: int, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bits a character by language (texts x languages; zero for texts without words), and the characters scored."""
    if key not in _caches:
        _caches.clear()
        _caches[key] = ({}, [np.zeros((0, len(model.languages) + 1), np.float32)])
    known, store = _caches[key]
    if len(known) > CACHE:
        known.clear()
        store[0] = store[0][:0]
    split = [words_of(t) if t else [] for t in texts]
    new = list(set().union(*split) - known.keys())
    if new:
        part = [np.column_stack([-model.log_probs(new[at : at + 20_000]), [len(w) + 1 for w in new[at : at + 20_000]]]) for at in range(0, len(new), 20_000)]
        known.update(zip(new, range(len(store[0]), len(store[0]) + len(new))))
        store[0] = np.concatenate([store[0], *part]).astype(np.float32)
    sums = np.zeros((len(texts), len(model.languages) + 1))
    for i, words in enumerate(split):
        if words:
            sums[i] = store[0][np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1), sums[:, -1]


class Identifier:
    """A model with its calibration: a sharpness for scores, and the highest cross-entropy that each language accepts."""

    def __init__(self, model: Model, sharpness: float, limits: np.ndarray, key: int):
        self.model, self.sharpness, self.limits, self.key = model, sharpness, limits, key

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """(language, score, rejected, bits a character) of each text; ties go to the first language by name."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0, True, None)] * len(texts)
        h, n = cross_entropies(self.model, self.key, texts)
        out = []
        for i, t in enumerate(texts):
            if not t or not has_letter(t):
                out.append((UNKNOWN, 0.0, True, None))
                continue
            k = int(h[i].argmin())
            score = 1 / np.exp(-self.sharpness * np.minimum(h[i] - h[i, k], 50) * min(n[i], 1000)).sum()
            out.append((self.model.languages[k], float(score), bool(h[i, k] > self.limits[k]), float(h[i, k])))
        return out


def _sample(docs: DataFrame) -> DataFrame:
    """At most MAX_DOCS documents of each language, by a hash of doc_id: (lang, text, dev, doc_id).

    A threshold on the hash, from each language's count, leaves about twice as many where they are read (the chance of too few is below
    1e-100); only those are ranked, so no language's ids meet in one task. The counts are one row a language, as the model is.
    """
    from pyspark.sql import Window as W

    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(DRAW))
    most = able.groupBy("lang").agg(F.least(F.lit(DRAW).cast("double"), F.lit(2.0 * DRAW * MAX_DOCS) / F.count(F.lit(1))).alias("most"))
    few = able.select("doc_id", "lang", draw.alias("draw")).join(F.broadcast(most), "lang").where(F.col("draw") < F.col("most"))
    order = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id"))
    own = few.withColumn("place", order).where(F.col("place") <= MAX_DOCS).withColumn("n", F.count("*").over(W.partitionBy("lang")))
    held = F.col("place") <= F.greatest(F.least(F.lit(LEAST_DEV), F.floor(F.col("n") / 4)), F.ceil(F.col("n") / DEV), F.least(F.lit(1), F.col("n") - 1))
    ids = own.groupBy("doc_id", "lang").agg(F.max(held).alias("dev"))
    return able.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])


def limits_of(h: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The highest accepted cross-entropy of each of n languages, from held-back texts' cross-entropies h (texts x languages) under their languages y.

    A language with LEAST_DEV texts has its own quantile. One with fewer has its mean and the spread that all languages' texts have
    about their means, more for fewer texts, and never less than its own texts need; one without takes the highest limit of the others.
    """
    own = [h[y == k, k] for k in range(n)]
    about = [(x - x.mean()) * np.sqrt(len(x) / (len(x) - 1)) for x in own if len(x) > 1]
    spread = max(float(np.quantile(np.concatenate(about), REJECT_QUANTILE)), 0.0) if about else 0.0
    limits = np.full(n, np.nan)
    for k, x in enumerate(own):
        if len(x) >= LEAST_DEV:
            limits[k] = np.quantile(x, REJECT_QUANTILE) + REJECT_MARGIN
        elif len(x):
            limits[k] = max(x.max(), x.mean() + spread * (1 + 1 / np.sqrt(len(x)))) + REJECT_MARGIN
    return np.where(np.isnan(limits), np.nanmax(limits) if len(y) else np.inf, limits)


def train(docs: DataFrame) -> Identifier:
    """Fitted on the n-gram counts of the bounded sample, but for held-back documents that calibrate: one in DEV of a language, or more (a
    quarter at most, but one of two or three) where that is under LEAST_DEV. Only where no language has two documents is there no limit.
    Texts are counted and scored in workers; n-gram counts (which an alphabet bounds, not the texts' lengths) reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = materialise(_sample(docs), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang in [k for k, v in words.items() if len(v) > CACHE]:
                yield grams(lang, words.pop(lang))
        for lang, own in words.items():
            yield grams(lang, own)

    def grams(lang: str, words: Counter) -> pa.RecordBatch:
        got = raw_grams(words)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["lang", "gram", "n"])

    counted = sample.where("not dev").select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {}
    for batch in counted.to_batches(max_chunksize=50_000):
        for lang, gram, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts.setdefault(lang, Counter())[gram] = n
    del counted
    model = Model(counts)
    key = hash(tuple(sorted((k, len(v), v.total()) for k, v in counts.items())))
    n = len(model.languages)
    limits, sharpness = np.full(n, np.inf), 0.1
    if not n:
        return Identifier(model, sharpness, limits, key)
    at = {lang: i for i, lang in enumerate(model.languages)}
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, size = cross_entropies(shared.value, key, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("doc_id"), pa.array(list(h), pa.list_(pa.float64())), pa.array(size, pa.float64())], ["lang", "doc_id", "bits", "chars"])

    dev = sample.where("dev").select("lang", "doc_id", "text").mapInArrow(weigh, "lang string, doc_id long, bits array<double>, chars double").collect()
    dev = sorted((r for r in dev if r["lang"] in at and r["chars"]), key=lambda r: (r["lang"], r["doc_id"], r["bits"]))
    if dev:
        h, y, size = np.array([r["bits"] for r in dev]), np.array([at[r["lang"]] for r in dev]), np.minimum([r["chars"] for r in dev], 1000)
        limits = limits_of(h, y, n)
        gaps = (h - h.min(axis=1, keepdims=True)) * size[:, None]
        grid = np.geomspace(0.001, 1, 25)
        loss = [(s * gaps[np.arange(len(y)), y] + np.log(np.exp(-s * gaps).sum(axis=1))).mean() for s in grid]
        sharpness = float(grid[int(np.argmin(loss))])
    return Identifier(model, sharpness, limits, key)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, bits double"


def identify(docs: DataFrame, trained_on: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, bits for each document.

    docs: doc_id, text (and lang, unless trained_on has it; other columns are ignored, and no prediction uses more than text). Null
    texts and texts without a letter are `und`, rejected, score 0. Rows are scored one by one, so repeated rows repeat. Of equal
    cross-entropies the first language by name wins. Without any training text all rows are `und`; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs if trained_on is None else trained_on))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = shared.value
        for batch in batches:
            held = iter(batch.column("held_out").to_pylist())
            for ids, texts in rows_of(iter([batch])):
                out = who.identify(texts)
                cols = [ids, [next(held) for _ in ids], *zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.bool_(), pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "rejected", "bits"])

    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose language is neither `und` nor rejected: filtered where they are read, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, texts in rows_of(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(place)], ["i", "t"])])):
                keep += [not rejected for _, _, rejected, _ in shared.value.identify(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
