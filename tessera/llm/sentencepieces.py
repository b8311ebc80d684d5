"""SentencePiece encoding and decoding by a max-plus parallel scan.

An encoding is the segmentation of highest total piece score (Viterbi). Seen at a cut of the text, a segmentation has one of MAX states:
how many characters beyond the cut its piece at the cut reaches. So a chunk is a matrix of best scores from entry to exit state,
chunks combine by the (max, +) product, which is associative, and once the scan has fixed both states of each chunk its best path is
traced back in the chunk alone. Short texts are one chunk; giant documents are many, spread over all workers.

Words: in this kind of vocabulary a blank only stands at the start of a piece (runs of blanks aside, which are one word here), and
letters, digits and other characters do not mix, so every path passes between them, and a word's best path is found once and kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from tessera.llm.common import materialise, rows_of, small_batches, table

#: Code points of a chunk, words that a worker keeps.
CHUNK, CACHE = 65_536, 400_000
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
#: What an unknown character costs beside the worst ordinary piece.
UNKNOWN_PENALTY = 10.0
NONE = -np.inf


def word_pattern(pieces: list[str]) -> re.Pattern:
    """Words that no piece passes. Characters that stand side by side in a piece are of one kind; a word is blanks, then a run of a kind.

    Kinds are the two largest sets so connected (letters and marks, in practice) and all other characters together.
    """
    root: dict[str, str] = {}

    def find(c: str) -> str:
        root.setdefault(c, c)
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for p in pieces:
        plain = p.lstrip(BLANK)
        if BLANK in plain:  # no place is safe: a text is one word
            return re.compile("(?s).+")
        for a, b in zip(plain, plain[1:]):
            root[find(a)] = find(b)
    sets: dict[str, list[str]] = {}
    for c in list(root):
        sets.setdefault(find(c), []).append(c)
    first, second = ("".join(re.escape(c) for c in sorted(x)) for x in [*sorted(sets.values(), key=len, reverse=True), [], []][:2])
    runs = [f"[{first}]+", f"[{second}]+"] if second else []
    return re.compile(f"{BLANK}*(?:{'|'.join([*runs, f'[^{BLANK}{first}{second}]+'])})|{BLANK}+")


class Vocabulary:
    """Pieces with scores. Runs of blanks that a model marks as never to be chosen (scores of -1e9) cost their number of blanks."""

    def __init__(self, path: str):
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces = [p.piece for p in proto.pieces]
        ordinary = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        worst = min(s for _, s in ordinary.values() if s > -1e8)
        self.score = {p: (i, s if s > -1e8 else worst) for p, (i, s) in ordinary.items()}
        self.unknown = worst - UNKNOWN_PENALTY
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.bytes = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.score))
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.prefixes: dict[str, tuple] = {p[:k]: () for p in self.score for k in range(1, len(p))} | self.score
        self.words = word_pattern(list(self.score)).findall
        self.shown = [chr(self.bytes[i]) if self.bytes.get(i, 128) < 128 else p for i, p in enumerate(self.pieces)]
        self.high = np.array([self.bytes.get(i, 0) >= 128 for i in range(len(self.pieces))])
        self.known: dict[str, bytes] = {}
        self.scores: dict[str, float] = {}

    def normalise(self, text: str) -> str:
        """Blanks become BLANK, and one stands before the text (none before an empty one). Other characters stay."""
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def forward(self, text: str, start: int, stop: int) -> tuple[list, list]:
        """Best scores and back pointers of the places reached from start by pieces that begin before stop; pieces may pass stop.

        A character that is no piece by itself may also be passed as unknown. prefixes says when no longer piece can follow.
        """
        n, prefixes, unknown = len(text), self.prefixes, self.unknown
        best: list[float] = [NONE] * (n + 1)
        back: list = [None] * (n + 1)
        best[start] = 0.0
        for i in range(start, stop):
            b = best[i]
            if b == NONE:
                continue
            j, alone = i + 1, False
            while j <= n:
                e = prefixes.get(text[i:j])
                if e is None:
                    break
                if e:
                    alone = alone or j == i + 1
                    if b + e[1] > best[j]:
                        best[j], back[j] = b + e[1], (i, e[0])
                j += 1
            if not alone and i < n and b + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = b + unknown, (i, -1)
        return best, back

    def ids(self, text: str, path: list[tuple[int, int, int]]) -> bytes:
        out: list[int] = []
        for i, j, k in path:
            if k >= 0:
                out.append(k)
            else:
                out += [self.byte[b] for b in text[i:j].encode("utf-8", "surrogatepass")]
        return np.array(out, "<u4").tobytes()

    def trace(self, text: str, start: int, end: int, back: list) -> bytes:
        path = []
        while end > start:
            i, k = back[end]
            path.append((i, end, k))
            end = i
        return self.ids(text, path[::-1])

    def learn(self, words: list[str]) -> None:
        """Find the best paths of new words (all paths pass a word's ends); a worker keeps their ids and scores."""
        if len(self.known) > CACHE:
            self.known.clear()
            self.scores.clear()
        for w in set(words).difference(self.known):
            best, back = self.forward(w, 0, len(w))
            self.known[w], self.scores[w] = self.trace(w, 0, len(w), back), best[-1]

    def encode(self, text: str) -> bytes:
        """Ids of a whole normalised text, little-endian unsigned 32-bit."""
        words = self.words(text)
        self.learn(words)
        return b"".join(map(self.known.__getitem__, words))

    def total(self, text: str) -> float:
        """The score of encode(text)."""
        words = self.words(text)
        self.learn(words)
        return sum(map(self.scores.__getitem__, words))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the inverse of normalise() after encode(), but that BLANK itself comes back as a blank."""
        if not self.high[ids].any():  # a byte below 128 is a character by itself
            text = "".join(map(self.shown.__getitem__, ids.tolist())).replace(BLANK, " ")
            return text[1:] if self.prefix and text[:1] == " " else text
        out, run = [], bytearray()
        for i in ids.tolist():
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "surrogatepass"))
                run = bytearray()
            out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "surrogatepass"))
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


CUT = re.compile(f"(?<=[^{BLANK}]){BLANK}")


def cuts(text: str, least: int, stop: int) -> tuple[int, int]:
    """The first place from `least` on and the last below `stop` that every path passes (a character, then a blank), or (-1, -1)."""
    first = CUT.search(text, least, stop)
    if not first:
        return -1, -1
    last = stop - 1
    while text[last] != BLANK or text[last - 1] == BLANK:
        last -= 1
    return first.start(), last


def transfer(v: Vocabulary, text: str, size: int) -> np.ndarray:
    """The chunk's matrix: entry state (characters of it that a piece from before takes) to exit state (characters beyond size).

    text: the chunk and the v.longest - 1 characters after it, as far as there are any.
    """
    n = v.longest
    out = np.full((n, n), NONE)
    first, last = cuts(text, n, size)
    if first >= 0:
        # All paths pass first and last: head[s] + middle + tail[t].
        head, middle = np.full(n, NONE), v.total(text[first:last])
        for s in range(n):
            head[s] = v.forward(text[:first], s, first)[0][first]
        tail = np.array(v.forward(text[last:], 0, size - last)[0][size - last : size - last + n])
        out[:, : len(tail)] = (head + middle)[:, None] + tail[None, :]
        return out
    for s in range(min(n, size + 1)):
        best = v.forward(text, s, size)[0][size : size + n]
        out[s, : len(best)] = best
    for s in range(size + 1, n):
        if s - size < n and s <= len(text):
            out[s, s - size] = 0  # a piece from before passes the whole chunk
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[int]:
    """States at the chunks' cuts, first to last, of the best path that enters and leaves in state 0: prefixes pairwise (associative), then back."""
    prefixes = prefix_products(matrices)
    states, t = [0], 0
    for k in range(len(matrices) - 1, 0, -1):
        t = int((prefixes[k - 1][0] + matrices[k][:, t]).argmax())
        states.append(t)
    return [0, *states[:0:-1], 0] if len(matrices) > 1 else [0, 0]


def prefix_products(m: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices by the pairwise scan."""
    if len(m) < 2:
        return list(m)
    pairs = prefix_products([product(a, b) for a, b in zip(m[::2], m[1::2])])
    out = [m[0]]
    for i in range(1, len(m)):
        out.append(pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], m[i]))
    return out


def chunks_of(text: str, size: int, beyond: int, slack: int = 4096) -> Iterator[tuple[int, int, str]]:
    """(number, characters, those and the next `beyond`): cut at a word's start if one lies in the last `slack` characters, else anywhere."""
    at = k = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for p in range(end, max(at, end - slack), -1):
                if text[p] == BLANK and text[p - 1] != BLANK:
                    end = p
                    break
        yield k, end - at, text[at : end + beyond]
        at, k = end, k + 1


def trace_chunk(v: Vocabulary, text: str, size: int, enter: int, leave: int) -> bytes:
    """The best path of a chunk between two states."""
    end = size + leave
    if enter >= end:
        return b""
    first, last = cuts(text, v.longest, size)
    if first >= 0:
        back1, back2 = v.forward(text[:first], enter, first)[1], v.forward(text[last:end], 0, size - last)[1]
        return v.trace(text, enter, first, back1) + v.encode(text[first:last]) + v.trace(text[last:end], 0, end - last, back2)
    return v.trace(text, enter, end, v.forward(text[:end], enter, size)[1])


SCHEMA = "doc_id long, n_chars long, n_ids long, ids binary"


def encode(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_ids, ids: the ids of each whole text, little-endian unsigned 32-bit, in one binary.

    docs: doc_id, text (others ignored). Null and empty texts have no ids. Texts of up to `chunk` code points are encoded where they are
    read; longer ones go through the scan: their chunks' matrices (one document has at most 2^31 / chunk of them, as a string
    holds 2^31 bytes at most) meet in one task without any text, and the states go back to the chunks. Of equal scores, the path
    whose last piece is longest wins in a word; where a run of over 4096 characters without a blank is cut, another path of that score may. Repeated rows repeat; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # A row's key lets repeated and null ids through the scan.
    giant = F.length(F.coalesce("text", F.lit(""))) >= chunk
    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for ids, texts in rows_of(batches):
            out = [v.encode(v.normalise(t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([len(o) // 4 for o in out], pa.int64()), pa.array(out, pa.binary())], schema=kinds)

    parts = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("k", pa.int32()), ("size", pa.int32()), ("n_chars", pa.int64()), ("chunk", pa.string()), ("matrix", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for row, doc, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                for k, size, own in chunks_of(v.normalise(text), chunk, v.longest - 1):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "k": k, "size": size, "n_chars": len(text), "chunk": own, "matrix": b""}], schema=parts)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            out = [transfer(v, t, n).tobytes() for t, n in zip(b.column("chunk").to_pylist(), b.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(out, pa.binary())], schema=parts)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        n = int(len(rows["matrix"].iloc[0]) / 8) ** 0.5
        states = scan([np.frombuffer(m).reshape(round(n), -1) for m in rows["matrix"]])
        return pd.DataFrame({"row": rows["row"], "k": rows["k"], "enter": np.array(states[:-1], np.int32), "leave": np.array(states[1:], np.int32)})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("chunk", "size", "enter", "leave")]
            out = [trace_chunk(v, *x) for x in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "k", "n_chars")), pa.array(out, pa.binary())], ["row", "doc_id", "k", "n_chars", "ids"])

    short = docs.where(~giant).select("doc_id", "text").mapInArrow(whole, SCHEMA)
    keyed = docs.where(giant).select(F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id()).alias("row"), "doc_id", "text")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    types = "row string, doc_id long, k int, size int, n_chars long, chunk string, matrix binary"
    # Chunks are dealt out evenly before any work on them, so a giant document's chunks run everywhere; written once, used twice.
    held = materialise(keyed.mapInArrow(split, types).repartition(n, "row", "k").mapInArrow(matrices, types), "chunks")
    states = held.select("row", "k", "matrix").groupBy("row").applyInPandas(solve, "row string, k int, enter int, leave int")
    paths = held.drop("matrix").join(states, ["row", "k"]).mapInArrow(traced, "row string, doc_id long, k int, n_chars long, ids binary")
    joined = paths.groupBy("row", "doc_id", "n_chars").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    long = joined.select("doc_id", "n_chars", ids.alias("ids")).select("doc_id", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), "ids")
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text of encode()'s rows: the texts themselves, but for BLANK characters, which come back as blanks. Null ids: null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            out = [None if x is None else v.decode(np.frombuffer(x, "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digest(batches: Iterator[pa.RecordBatch], path: str = VOCABULARY) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for b in batches:
        ids = b.column("ids").to_pylist()
        back = [v.decode(np.frombuffer(x, "<u4")).encode("utf-8", "surrogatepass") for x in ids]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_chars", "n_ids")), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(map(zlib.crc32, back), pa.int64())], ["doc_id", "n_chars", "n_ids", "ids_crc32", "text_crc32"])


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: lengths, a checksum of the ids, and one of the decoded text's UTF-8."""
    return encode(table(spark, sf_dir, "documents")).mapInArrow(_digest, "doc_id long, n_chars long, n_ids long, ids_crc32 long, text_crc32 long")


ORACLE: dict[str, str] = {}
