"""Token ids as Parquet: list columns, dictionary and delta encoding, small row groups, page indexes.

Rows lie in ascending document order over the files, nulls first; equal ids are ordered by text.
``ids`` is dictionary encoded (a vocabulary fits a dictionary page); the ascending columns
``doc_id``, ``seq`` and ``shard_start`` are delta encoded. Row groups and pages are small and
carry column indexes, so a range of documents, or the counts alone, can be read without the rest.

Each shard is one range of documents, sorted and encoded as a stream by one task. Where a shard
begins in the whole is a sum over the shards' totals, one row each.

Defined cases: a null text is empty and has only the end id; repeated rows are written each;
further columns are not written. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.bpe import encoder
from fieldmark.llm.common import documents, settings, slices, small_batches, store
from fieldmark.session import scratch_path

SCHEMA = "doc_id long, shard int, seq long, shard_start long, n_tokens long, ids array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#seq": "false",
    "parquet.enable.dictionary#shard_start": "false",
}


def encoded(docs: DataFrame, end_id: int = 1, vocabulary: str | None = None, literal: bool = False) -> DataFrame:
    """Rows of the files, in document order within and across partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary, literal)
        shard, seq, start = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, "text", 8 << 20):
            ids, offs = words.encode(batch.column("text"), end_id)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(n, shard, np.int32)),
                    pa.array(np.arange(seq, seq + n)),
                    pa.array(start + offs[:-1]),
                    pa.array(np.diff(offs)),
                    pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids)),
                ],
                names=["doc_id", "shard", "seq", "shard_start", "n_tokens", "ids"],
            )
            seq += n
            start += int(offs[-1])

    rows = documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return rows.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, vocabulary: str | None = None, literal: bool = False) -> str:
    """Encode every text, append ``end_id`` to each, and write the files under ``path``."""
    with settings(
        docs.sparkSession,
        spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
        spark__sql__execution__arrow__maxBytesPerBatch=str(8 << 20),
    ):
        encoded(docs, end_id, vocabulary, literal).write.options(**LAYOUT).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, if asked for, ids."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("begin"))
    # broadcast at every size: a shard is a task of the writer, so there are no more rows than shuffle partitions
    found = rows.join(F.broadcast(begins), "shard").withColumn("start", F.col("begin") + F.col("shard_start"))
    return found.select("doc_id", "start", "n_tokens", *["ids"] * ids)


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), all from ``ids`` as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offs = lists.offsets.to_numpy()
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offs).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = tokens.select("doc_id", "start", "ids")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """Write the token files to the shared folder and describe each document from what they hold."""
    spark = docs.sparkSession
    path = write_tokens(docs, scratch_path(spark, "llm-tokens"), end_id, vocabulary)
    with settings(spark, **small_batches()):
        return store(checksums(read_tokens(spark, path)), "token-sums")
