"""Pulling responses into the landing folder: retries, page caps that split a pull, directory crawls. Clients are passed in as functions."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tessera.sources.files import exists


class PullError(RuntimeError):
    """A request that failed for good."""


@dataclass(frozen=True)
class Policy:
    """When to ask again: after 429, 5xx and lost connections, with waits of min(2^n * 3 + 5, longest) seconds before try n + 2."""

    tries: int = 8
    longest: float = 120
    pause: float = 0.35
    missing_is_empty: bool = False

    def wait(self, n: int) -> float:
        return min(2**n * 3 + 5, self.longest)


def ask(request: Callable[[], tuple[int, str]], policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON of a request (status, body), under a policy; {} for a 404 where missing_is_empty."""
    said = ""
    for n in range(policy.tries):
        try:
            status, body = request()
        except OSError as e:
            status, body, said = 0, "", str(e)
        if status == 404 and policy.missing_is_empty:
            return {}
        if 200 <= status < 300:
            sleep(policy.pause)
            return json.loads(body)
        said = said or f"status {status}"
        if status and status != 429 and status < 500:
            break
        if n + 1 < policy.tries:
            sleep(policy.wait(n))
    raise PullError(said)


# What a country's pull is split by when a page cap cuts it off.
SPLITS = [("filter[entity.status]", ["ACTIVE", "INACTIVE"]), ("filter[entity.category]", ["FUND", "BRANCH", "SOLE_PROPRIETOR", "GENERAL"])]


def split_pull(pull: Callable[[dict], tuple[list, bool]], filters: dict, splits: list[tuple[str, list[str]]] = SPLITS) -> Iterator[tuple[dict, list, bool]]:
    """(filters, records, whether some may be missing) of the pulls that cover filters: a pull that the cap cut off gives way to its parts."""
    records, cut = pull(filters)
    if not cut or not splits:
        yield filters, records, cut
        return
    (name, values), *rest = splits
    for v in values:
        yield from split_pull(pull, filters | {name: v}, rest)


def paged(page: Callable[[int], list], max_pages: int = 50, page_size: int = 200) -> tuple[list, bool]:
    """All records of numbered pages, and whether the last allowed page was full. A page beyond the service's range raises PullError."""
    out: list = []
    for n in range(1, max_pages + 1):
        try:
            got = page(n)
        except PullError:
            return out, True
        out += got
        if not got:
            return out, False
    return out, len(got) == page_size


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def crawl(fetch: Callable[[str, int], str], has_rows: Callable[[str], bool], letters: Iterable[str] = LETTERS, pages: int = 1, seen: Iterable[tuple[str, int]] = (), failures: int = 5) -> Iterator[tuple[str, int, str]]:
    """(letter, page, html) of listing pages not seen before. A page that fails is left for a later run; a letter ends at a page without rows, or after so many failures in a row."""
    done = {(a.upper(), n) for a, n in seen}
    for letter in (x.upper() for x in letters):
        lost = 0
        for n in range(1, pages + 1):
            if (letter, n) in done:
                continue
            try:
                body = fetch(letter, n)
            except (PullError, OSError):
                lost += 1
                if lost >= max(failures, 1):
                    break
                continue
            if not has_rows(body):
                break
            lost = 0
            yield letter, n, body


def land(spark: SparkSession, rows: Iterable[tuple], schema: str, path: str, every: int = 500) -> int:
    """Append rows as JSON lines in batches of `every`, so that a broken-off pull keeps what it has. Returns their number."""
    batch: list[tuple] = []
    total = 0

    def flush() -> None:
        nonlocal total
        if batch:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(path)
            total += len(batch)
            batch.clear()

    for r in rows:
        batch.append(r)
        if len(batch) >= every:
            flush()
    flush()
    return total


def use_cached(spark: SparkSession, path: str, force: bool = False) -> bool:
    """Whether a landed table is there with data in it, and no refresh is asked for."""
    if force or not exists(spark, path):
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() > 0
