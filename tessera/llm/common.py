"""What the training-data operators share: reading, bounded label samples, cutting lineage, Arrow batch limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.components import cut_lineage

#: A batch that goes to Python holds at most so many rows and about so many bytes (or one row, as whole texts stay whole).
ARROW_ROWS, ARROW_BYTES = 1024, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits, so that batches of long texts stay small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the session's shared folder and read it again; drop_written() of the components module deletes such tables."""
    return cut_lineage(df, label)[0]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n: the folds of the labelled operators."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def label_sample(labels: DataFrame, label: str, docs: DataFrame, per_class: int, seed: int) -> DataFrame:
    """At most per_class rows of each value of a 0/1 label, chosen by a hash of doc_id: (doc_id, y, text, fold).

    The ids are a bounded table of at most 2 * per_class rows, so the join broadcasts it. fold (0 to 9) is another hash, to
    hold some rows out for calibration. Rows whose label or text is null take no part; of a repeated doc_id, one label row.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null")
    ids = None
    for y in (0, 1):
        # A repeated id would be repeated in the sample; distinct runs over the few columns of the label table.
        part = rows.where(F.col("y") == y).distinct().orderBy(order, "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.select("doc_id", "text").where("text is not null")
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(10)).cast("int")
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text", fold.alias("fold"))


def rows_of(batches: Iterator[pa.RecordBatch], max_chars: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) in parts of about max_chars characters at most, or one text if that is longer."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        sizes = [len(x) if x is not None else 0 for x in texts.to_pylist()] if batch.nbytes > max_chars else None
        if sizes is None:
            yield ids, texts.to_pylist()
            continue
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_chars:
                yield ids[start:i], texts.slice(start, i - start).to_pylist()
                start, total = i, 0
            total += n
        if start < len(ids):
            yield ids[start:], texts.slice(start).to_pylist()
