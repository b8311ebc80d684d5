"""Secrets in texts: fixed patterns, and strings that a tokenizer's vocabulary cannot shorten.

A byte-pair vocabulary stores words and names in long tokens, so ordinary strings have several characters a token; random strings have
hardly more than one. A long run of key characters whose characters a token are MAX_RATIO or fewer is reported as `random`, unless it is a
digest or an identifier of a known form, or lies inside a span that a pattern reports already. Each document is scanned whole, where it is
read: nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import rows_of, small_batches, table

#: Documented parameters: the vocabulary's file; shortest run that is tested, characters a token that are still random, and the length of
#: letters and digits without a break that a random string has somewhere (versions, dates, addresses and names in parts have less).
VOCABULARY, MIN_CHARS, MAX_RATIO, MIN_PART = "byte_bpe_50k.tiktoken", 20, 1.75, 12
#: Kinds in the order that equal starts have.
KINDS = ("assign", "access", "hex", "random")

#: The base patterns. The first letter stands alone, so that a search leaps to it; a run of 32 digits or more from its first
#: digit is what `[0-9a-f]+` gives where that is long enough. The others' least lengths are of group 1, or of the match.
ASSIGN = re.compile(
    r"""[aApPsStT](?:(?<=[pP])(?i:assword|asswd)|(?<=[sS])(?i:ecret)|(?<=[tT])(?i:oken)|(?<=[aA])(?i:pi_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16}

#: A whole run of key characters; padding signs may end it.
RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{%d,}={0,2}" % MIN_CHARS)
#: Digests: MD5, SHA-1 and SHA-2 in hexadecimal, or named. Identifiers: UUIDs, 24-digit object ids, numbers.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z|(?i:md5|sha1|sha224|sha256|sha384|sha512)[-_.]")
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z|[0-9a-fA-F]{24}\Z|[0-9+/_.=-]+\Z")
NAMED = re.compile(r"(?i:md5|sha1|sha224|sha256|sha384|sha512)\W{1,3}\Z", re.ASCII)
PARTS = re.compile(r"[A-Za-z0-9+/]+")


@cache
def encoding(name: str = VOCABULARY) -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ratio(run: str, name: str = VOCABULARY) -> float:
    """Characters a token."""
    return len(run) / max(1, len(encoding(name).encode_ordinary(run)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed patterns, leftmost and not overlapping within a kind; too short matches are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def random_runs(text: str, name: str = VOCABULARY) -> Iterator[tuple[int, int, float]]:
    """(start, end, ratio) of runs that the vocabulary cannot shorten and that are no digest or identifier of a known form."""
    for m in RUN.finditer(text):
        a, b = m.span()
        # A run beside a letter of another script is part of a word; beside an at sign, of an address.
        if (a and (text[a - 1].isalnum() or text[a - 1] == "@")) or (b < len(text) and (text[b].isalnum() or text[b] == "@")):
            continue
        while a < b and text[a] in "./_-+":
            a += 1
        while b > a and text[b - 1] in "./_-":
            b -= 1
        run = text[a:b]
        if b - a < MIN_CHARS or DIGEST.match(run) or IDENTIFIER.match(run) or NAMED.search(text, max(0, a - 10), a) or max(map(len, PARTS.findall(run)), default=0) < MIN_PART:
            continue
        r = ratio(run, name)
        if r <= MAX_RATIO:
            yield a, b, r


def spans(text: str | None, name: str = VOCABULARY) -> list[tuple[str, int, int, str, float | None]]:
    """(kind, start, end, text, ratio) by start, then kind: code points, end exclusive; ratio for `random` alone."""
    text = text or ""
    base = base_spans(text)
    found = [(a, k, b, None) for a, k, b in base]
    reach, i = 0, 0
    base.sort()
    for a, b, r in random_runs(text, name):
        # Base spans that begin at or before a: one of them covers the run if the furthest end reaches b.
        while i < len(base) and base[i][0] <= a:
            reach, i = max(reach, base[i][2]), i + 1
        if reach < b:
            found.append((a, 3, b, r))
    return [(KINDS[k], a, b, text[a:b], r) for a, k, b, r in sorted(found, key=lambda x: x[:2])]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("ratio", pa.float64())])


def find_secrets(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, text, ratio), for each row of docs (doc_id, text; others ignored).

    Null and empty texts have no spans. Texts are scanned whole, however long. Rows are never compared, so repeated rows, repeated ids and
    null ids each keep their row. Spans of equal start come in the order of KINDS; no kind overlaps itself. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            got = [[dict(zip(("kind", "start", "end", "text", "ratio"), s)) for s in spans(t, name)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.list_(SPAN))], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, text: string, ratio: double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _joined(some: Column) -> Column:
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(of, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


ORACLE: dict[str, str] = {}
