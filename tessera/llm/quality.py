"""Quality rules: word and line counts, and a calibrated logistic regression on hashed word and character n-grams.

The model is fitted on a bounded sample of labelled rows (MAX_ROWS of each class) whose features, not texts, reach the driver; all
rows are then scored in Arrow batches against the fixed threshold.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import label_sample, rows_of, small_batches, table

#: Documented parameters: labelled rows of each class, hash space, character n-gram lengths, training steps, threshold.
MAX_ROWS, DIMS, CHAR_NS, STEPS, KEEP_AT, SEED = 1000, 1 << 16, (2, 4), 100, 0.5, 5
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: Characters that one numpy pass takes: longer texts go through in overlapping parts.
PART = 1 << 20


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in some 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    if n < 256:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        found = np.fromiter((times[w] > 1 for w in windows), bool, n - 2)
    else:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        _, place, times = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        found = times[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= found
    return int(covered.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else ()
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _mix(h: np.ndarray, family: int) -> np.ndarray:
    h = (h ^ np.uint64(family * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(40)).astype(np.int64) & (DIMS - 1)


def hashed(text: str, words: list[bytes]) -> Iterator[np.ndarray]:
    """For each family (words, word pairs, character n-grams) arrays of hashed places; a long text gives several of a family."""
    if words:
        h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        yield 0, _mix(h, 1)
        if len(words) > 1:
            yield 1, _mix(h[:-1] * np.uint64(0x100000001B3) + h[1:], 2)
    for k, n in enumerate(CHAR_NS):
        for at in range(0, max(len(text) - n + 1, 0), PART):
            c = np.frombuffer(text[at : at + PART + n - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            h = c[: len(c) - n + 1].astype(np.uint64)
            for j in range(1, n):
                h = h * np.uint64(0x100000001B3) + c[j : len(c) - n + 1 + j]
            yield 2 + k, _mix(h, 3 + k)


FAMILIES = 2 + len(CHAR_NS)


def features(text: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector: places, and each one's share of its family's n-grams."""
    total, per = np.zeros(DIMS), [[] for _ in range(FAMILIES)]
    for k, places in hashed(text, words):
        per[k].append(places)
    for parts in per:
        if parts:
            size = sum(map(len, parts))
            for p in parts:
                total += np.bincount(p, minlength=DIMS) / size
    at = np.flatnonzero(total)
    return at, total[at]


def margin(text: str, words: list[bytes], weights: np.ndarray, bias: float) -> float:
    """The same product as weights @ features, without building the vector."""
    sums, sizes = np.zeros(FAMILIES), np.zeros(FAMILIES)
    for k, places in hashed(text, words):
        sums[k] += weights[places].sum(dtype=np.float64)
        sizes[k] += len(places)
    return bias + float((sums / np.maximum(sizes, 1)).sum())


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [features(t, t.encode("utf-8", "surrogatepass").split()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("fold"), pa.array([a.astype(np.int32).tobytes() for a, _ in out], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in out], pa.binary())], ["doc_id", "y", "fold", "at", "v"])


def fit_sparse(rows: list[tuple[int, int, np.ndarray, np.ndarray]], dims: int, steps: int, scale: float = 30.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on all rows at once, classes weighted alike; calibrated by a slope and an offset on fold 0.

    Returns weights and bias that already hold the calibration; with one class or no rows, zeros and the smoothed rate's logit.
    """
    ys = np.array([r[0] for r in rows], float)
    if len(set(ys)) < 2:
        rate = (ys.sum() + 1) / (len(ys) + 2)
        return np.zeros(dims, np.float32), float(np.log(rate / (1 - rate)))
    held = np.array([r[1] == 0 for r in rows])
    if len(set(ys[~held])) < 2 or len(set(ys[held])) < 2:
        held[:] = False
    size = np.array([len(r[2]) for r in rows])
    row, col = np.repeat(np.arange(len(rows), dtype=np.int32), size), np.concatenate([r[2] for r in rows])
    val = np.concatenate([r[3] for r in rows]) * np.float32(scale)
    share = np.where(ys == 1, 0.5 / max(ys[~held].sum(), 1), 0.5 / max((1 - ys[~held]).sum(), 1)) * ~held  # held rows weigh nothing
    w, b, m, s = np.zeros(dims), 0.0, np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w.astype(np.float32)[col] * val, len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - ys) * share
        grad = np.append(np.bincount(col, g.astype(np.float32)[row] * val, dims) + 1e-4 * w, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    z = np.bincount(row, w.astype(np.float32)[col] * val, len(rows)) + b
    slope, offset = platt(z[held], ys[held]) if held.any() else (1.0, 0.0)
    return (w * scale * slope).astype(np.float32), float(b * slope + offset)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope > 0 and offset that make sigmoid(slope * z + offset) a probability; smoothed targets, Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    sd = z.std() or 1.0
    x, a, b = z / sd, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        q = p * (1 - p) + 1e-9
        ga, gb = ((p - target) * x).sum() + 1e-3 * a, (p - target).sum()
        haa, hab, hbb = (q * x * x).sum() + 1e-3, (q * x).sum(), q.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return max(float(a), 1e-3) / sd, float(b)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the weights and the bias fitted on all feature rows, which MAX_ROWS bounds."""
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "fold", "at", "v")))]
    rows.sort(key=lambda r: r[:2])
    weights, bias = fit_sparse([(y, fold, np.frombuffer(at, np.int32), np.frombuffer(v, np.float32)) for _, y, fold, at, v in rows], DIMS, STEPS)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fitted in one task on the feature vectors of at most 2 * MAX_ROWS labelled documents; quality 1 is the positive class."""
    sample = label_sample(labels, "quality", docs, MAX_ROWS, SEED).select("y", "fold", "text", "doc_id")
    vectors = sample.mapInArrow(_featurise, "doc_id long, y int, fold int, at binary, v binary")
    got = vectors.repartition(1).mapInArrow(_fit, "weights binary, bias double").first()
    return np.frombuffer(got["weights"], np.float32), got["bias"]


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"
ARROW = pa.schema([("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("p_good", pa.float64())])


def judge(text: str | None, weights: np.ndarray, bias: float) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    counts = base_counts(text, words)
    failed = base_failed(counts[0], counts[4])
    p = None if failed else 1 / (1 + float(np.exp(-np.clip(margin(text, words, weights, bias), -40, 40))))
    return *counts, failed, not failed and p >= KEEP_AT, p


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base rules and verdict of each document: see SCHEMA. p_good is the calibrated probability (null if base_failed).

    docs: doc_id, text (others ignored); labels: doc_id, quality. A null text has no words, so base_failed. Rows are judged one by
    one, so repeated rows give repeated, equal results. Without labels of both classes the verdict follows the smoothed label rate
    (0.5 without labels: kept). An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for ids, texts in rows_of(batches):
            out = [judge(t, weights, bias) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *zip(*out)], ARROW)], schema=ARROW)

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that quality() keeps: filtered where they are read, without a shuffle."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            yield batch.filter(pa.array([judge(t, weights, bias)[6] for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE: dict[str, str] = {}
