"""Token counts per document from flat token files that carry no index.

A flat file is nothing but token ids of fixed width, documents following one another, each ended
by the end-of-document id. Files are scanned in blocks, any block by any task: one vectorised
comparison finds the separators. A block knows the counts of the documents that lie inside it,
what stands before its first separator, and what follows its last one. Documents that cross
blocks are stitched by a prefix scan over one small summary row per block.

Defined cases: an empty document counts 0; ids after a file's last separator are an unfinished
document, reported with ``ended`` false; a file without ids has no documents; blocks may be of
any size, and repeated texts are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.bpe import encoder
from fieldmark.llm.common import documents, settings, slices, store
from fieldmark.session import scratch_path

END_OF_TEXT = 49407
FLAT = "kind string, file long, block long, content binary, doc_ids array<long>"


def write_flat(
    docs: DataFrame, path: str, separator: int = END_OF_TEXT, vocabulary: str | None = None, block_tokens: int = 1 << 18
) -> str:
    """One flat stream of 16-bit ids per input partition, cut into blocks that ignore documents.

    The names of special tokens are read as ordinary text, so the separator ends documents only.
    Rows of kind ``name`` list the documents' ids in stream order; the scan does not use them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary, literal=True)
        file, block, held, size, seen = TaskContext.get().partitionId(), 0, [], 0, 0

        def row(kind, number, content, names):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind]),
                    pa.array([file], pa.int64()),
                    pa.array([number], pa.int64()),
                    pa.array([content], pa.binary()),
                    pa.array([names], pa.list_(pa.int64())),
                ],
                names=["kind", "file", "block", "content", "doc_ids"],
            )

        for batch in slices(batches, "text", 8 << 20):
            ids, _ = words.encode(batch.column("text"), separator)
            held.append(ids.astype("<u2"))
            size += len(ids)
            yield row("name", seen, None, batch.column("doc_id").to_pylist())
            seen += batch.num_rows
            if size >= block_tokens:
                stream = np.concatenate(held)
                whole = len(stream) // block_tokens * block_tokens
                for at in range(0, whole, block_tokens):
                    yield row("block", block, stream[at : at + block_tokens].tobytes(), None)
                    block += 1
                held, size = [stream[whole:]], len(stream) - whole
        if size:
            yield row("block", block, np.concatenate(held).tobytes(), None)

    rows = documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch=str(8 << 20)):
        rows.mapInArrow(run, FLAT).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


def flat_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, content) of files written by ``write_flat``."""
    return spark.read.schema(FLAT).parquet(path).filter("kind = 'block'").select("file", "block", "content")


def opened(path: str):
    """A file for reading at any place; the path as Spark names it, in a store that Arrow or the machine's file system reaches."""
    if path.startswith("file:") or ":" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store_, inside = fs.FileSystem.from_uri(path)
    return store_.open_input_file(inside)


def binary_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = 1 << 18) -> DataFrame:
    """(file, block, content) of plain binary files of any size: Spark lists them, each task reads its blocks' byte ranges."""
    step = width * block_tokens
    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("file"), "length")
    last = F.greatest(F.lit(0), F.floor((F.col("length") - 1) / step)).cast("long")
    numbered = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, file, block, length in zip(*(c.to_pylist() for c in batch.columns)):
                size = min(step, length - block * step)
                with opened(name) as source:
                    content = source.read_at(size, block * step)
                if len(content) != size:
                    raise OSError(f"{name}: {len(content)} of {size} bytes at {block * step}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([content], pa.binary())], names=["file", "block", "content"]
                )

    return numbered.select("path", "file", "block", "length").mapInArrow(run, "file long, block long, content binary")


def count_tokens(blocks: DataFrame, separator: int = END_OF_TEXT, width: int = 2) -> DataFrame:
    """file, ordinal (of the document in its file, from 0), n_tokens (without the end id), ended."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column("content"):
                ids = np.frombuffer(content.as_buffer(), f"<u{width}") if content.is_valid else np.zeros(0, "<u2")
                at = np.flatnonzero(ids == separator)
                some = len(at) > 0
                out.append((len(at), at[0] if some else len(ids), len(ids) - 1 - at[-1] if some else len(ids), np.diff(at) - 1))
            seps, head, tail, inner = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), *(pa.array(x, pa.int64()) for x in (seps, head, tail)), pa.array(inner, pa.list_(pa.int64()))],
                names=["file", "block", "seps", "head", "tail", "inner"],
            )

    parts = blocks.select("file", "block", "content").mapInArrow(scan, "file long, block long, seps long, head long, tail long, inner array<long>")
    parts = store(parts, "scanned")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = parts.select("file", "block", "seps", "tail")
    sums = sums.withColumn("c", F.coalesce(F.sum("tail").over(earlier), zero)).withColumn("first", F.coalesce(F.sum("seps").over(earlier), zero))
    sums = sums.withColumn("since", F.coalesce(F.max(F.when(F.col("seps") > 0, F.col("c"))).over(earlier), zero))
    sums = sums.select("file", "block", "first", (F.col("c") - F.col("since")).alias("carry"))
    joined = parts.join(sums, ["file", "block"])
    whole = joined.filter("seps > 0").select(
        "file", "first", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("k", "n_tokens")
    )
    whole = whole.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = joined.groupBy("file").agg(
        F.sum("seps").alias("ordinal"),
        F.max_by(F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")), "block").alias("n_tokens"),
    )
    return whole.union(rest.filter("n_tokens > 0").withColumn("ended", F.lit(False)))


def count_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document: flat files written, scanned without an index, and named."""
    spark = docs.sparkSession
    path = write_flat(docs, scratch_path(spark, "llm-flat"), END_OF_TEXT, vocabulary)
    names = spark.read.schema(FLAT).parquet(path).filter("kind = 'name'")
    names = names.select("file", "block", F.posexplode("doc_ids").alias("k", "doc_id"))
    names = names.select("file", (F.col("block") + F.col("k")).alias("ordinal"), "doc_id")
    counts = count_tokens(flat_blocks(spark, path))
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
