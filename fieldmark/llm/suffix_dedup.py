"""Repeated substrings: suffixes in buckets, long ties settled by a difference cover.

Every byte is removed that lies in a string of ``length`` bytes which also starts anywhere else,
in another text or the same one. Two suffixes that tie over ``length`` bytes do so at every
offset, and for some offset below the cover's modulus v both positions are in the cover, a
perfect difference set modulo v. So the ties are settled in two rounds:

1. Cover samples, (q + 1) of every v = q^2 + q + 1 positions, are ordered by their next
   ``length - v + 1`` bytes, one bucket of suffixes at a time. Samples that tie with none are done
   with, and with them every suffix that has no tied sample within v bytes.
2. The suffixes left over are ordered by their ``length`` bytes, again one bucket at a time; those
   that tie are the repeats, and their windows are removed.

Only ties matter here, so buckets order suffixes by hashes of those bytes rather than by the
bytes themselves. A tie is equality of two independent hashes of 96 bits together.

A bucket holds packed arrays, not rows, and buckets grow in number with the text, not in size.
Copies within one batch of texts are tied there at once; one of them stands for the batch in its
bucket, so a string repeated any number of times puts one entry per batch there. Equal texts
are one text with a count. Texts meet their suffixes again in blocks of a few texts.

Defined cases: null texts are empty; texts under ``length`` bytes keep all; equal texts of at
least ``length`` bytes lose all; repeated rows are documents of their own; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import RollingHash, documents, slices, store, text_bytes

FIRST_HASH, SECOND_HASH = 7101, 7102
ORDER = 11  # of the cover: 12 samples in 133 positions
BLOCK_BITS = 9  # 512 texts meet their suffixes again in one group
CHUNK_ENTRIES, BUCKET_BYTES, ENTRY_BYTES = 1 << 20, 64 << 20, 24
ENTRIES = "bucket int, tied boolean, hashes binary, checks binary, gids binary, places binary"
TIES = "block long, n long, gids binary, places binary"


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(v, cover) with v = q^2 + q + 1 for a prime q: every difference modulo v occurs exactly once.

    Powers of a primitive element of the field of q^3 elements that lie in one plane.
    """
    v, order = q * q + q + 1, q**3 - 1
    for code in range(q**3):
        a, b, c = code % q, code // q % q, code // q // q
        x, seen, cover = (1, 0, 0), 0, []
        while True:  # x becomes x * t, where t^3 = a + b t + c t^2
            if x[2] == 0 and seen < v:
                cover.append(seen)
            top = x[2]
            x = (top * a % q, (x[0] + top * b) % q, (x[1] + top * c) % q)
            seen += 1
            if x in ((1, 0, 0), (0, 0, 0)) or seen > order:
                break
        if seen == order and x == (1, 0, 0):
            return v, np.array(cover)
    raise ValueError(f"{q} is not prime")


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which the shuffle's compression shortens."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(data: list[bytes], dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    parts = [np.frombuffer(d, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel() for d in data]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def tied(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each run of equal entries, whether the entry's run has others), over sorted entries."""
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    alone = new.copy()
    alone[:-1] &= new[1:]
    return order, new, ~alone


def entries(hashes, checks, gids, places, bits: int) -> pa.Table | pa.RecordBatch:
    """One batch's entries as rows: by bucket one of each run; and those tied within the batch."""
    order, new, many = tied(hashes, checks)
    rows: dict[str, list] = {k: [] for k in ("bucket", "tied", "hashes", "checks", "gids", "places")}

    def add(bucket, is_tied, at):
        rows["bucket"].append(bucket)
        rows["tied"].append(is_tied)
        rows["hashes"].append(None if is_tied else pack(hashes[at]))
        rows["checks"].append(None if is_tied else pack(checks[at]))
        rows["gids"].append(pack(gids[at]))
        rows["places"].append(pack(places[at]))

    one = order[new]
    bucket = (hashes[one] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 62))
    for a, b in zip(edges[:-1], edges[1:]):
        add(int(bucket[a]), False, one[a:b])
    here = order[many]
    spread = len(hashes)
    for at in range(0, len(here), 1 << 17):  # they need no bucket, so they go anywhere
        add((spread + at * 7919) % (1 << bits), True, here[at : at + (1 << 17)])
    return pa.RecordBatch.from_arrays(
        [pa.array(rows["bucket"], pa.int32()), pa.array(rows["tied"], pa.bool_()), *(pa.array(rows[k], pa.binary()) for k in ("hashes", "checks", "gids", "places"))],
        names=list(rows),
    )


def ties_of_bucket(table: pa.Table) -> pa.Table:
    """The entries of one bucket that tie with another, by block of texts."""
    rows = table.to_pylist()
    keyed = [r for r in rows if not r["tied"]]
    hashes = unpack([r["hashes"] for r in keyed], np.uint64)
    checks = unpack([r["checks"] for r in keyed], np.uint32)
    gids = unpack([r["gids"] for r in keyed], np.int64)
    places = unpack([r["places"] for r in keyed], np.uint32)
    order, _, many = tied(hashes, checks)
    order = order[many]
    known = [r for r in rows if r["tied"]]
    gids = np.concatenate([gids[order], unpack([r["gids"] for r in known], np.int64)])
    places = np.concatenate([places[order], unpack([r["places"] for r in known], np.uint32)])
    order = np.lexsort((places, gids))
    gids, places = gids[order], places[order]
    block = gids >> BLOCK_BITS
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=1 << 62))
    spans = list(zip(edges[:-1], edges[1:]))
    return pa.table(
        {
            "block": pa.array([int(block[a]) for a, _ in spans], pa.int64()),
            "n": pa.array([int(b - a) for a, b in spans], pa.int64()),
            "gids": pa.array([pack(gids[a:b]) for a, b in spans], pa.binary()),
            "places": pa.array([pack(places[a:b]) for a, b in spans], pa.binary()),
        }
    )


def cover_entries(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Cover samples of every text, hashed over the bytes that any tie through them must share."""
    v, cover = difference_cover(ORDER)
    core = length - v + 1
    inside = np.zeros(v, bool)
    inside[cover] = True
    first, second = RollingHash(FIRST_HASH), RollingHash(SECOND_HASH)
    held: list[tuple] = []
    size = 0
    for batch in slices(batches, "text", 1 << 20):
        data, offs = text_bytes(batch.column("text"))
        n = np.diff(offs)
        place = np.arange(len(data)) - np.repeat(offs[:-1], n)
        at = np.flatnonzero(inside[place % v] & (place + core <= np.repeat(n, n)))
        of = np.searchsorted(offs, at, side="right") - 1
        gids = batch.column("gid").to_numpy()[of]
        held.append((first.spans(data, at, at + core), (second.spans(data, at, at + core) >> np.uint64(32)).astype(np.uint32), gids, place[at].astype(np.uint32)))
        size += len(at)
        if size >= CHUNK_ENTRIES:
            yield entries(*map(np.concatenate, zip(*held)), bits)
            held, size = [], 0
    if size:
        yield entries(*map(np.concatenate, zip(*held)), bits)


def places_by_gid(ties: pa.Table) -> dict[int, np.ndarray]:
    if not ties.num_rows:
        return {}
    gids = unpack(ties.column("gids").to_pylist(), np.int64)
    places = unpack(ties.column("places").to_pylist(), np.uint32).astype(np.int64)
    order = np.argsort(gids, kind="stable")
    gids, places = gids[order], places[order]
    edges = np.flatnonzero(np.diff(gids, prepend=-1, append=1 << 62))
    return {int(gids[a]): np.unique(places[a:b]) for a, b in zip(edges[:-1], edges[1:])}


def repeats(texts: DataFrame, length: int, total_bytes: int) -> DataFrame:
    """(block, n, gids, places): every position of ``texts(gid, text)`` whose ``length`` bytes start elsewhere too."""
    spark = texts.sparkSession
    v, cover = difference_cover(ORDER)
    least = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def bits_for(count: int) -> int:
        return max(1, max(least, -(-count * ENTRY_BYTES // BUCKET_BYTES)) - 1).bit_length()

    sample_bits = bits_for(total_bytes * len(cover) // v)
    sampled = texts.select("gid", "text").mapInArrow(lambda b: cover_entries(b, length, sample_bits), ENTRIES)
    samples = store(sampled.groupBy("bucket").applyInArrow(ties_of_bucket, TIES), "samples")
    count = samples.agg(F.sum("n")).first()[0] or 0
    bits = bits_for(min(total_bytes, count * v))

    def window_entries(left: pa.Table, right: pa.Table) -> pa.Table:
        first, second = RollingHash(FIRST_HASH), RollingHash(SECOND_HASH)
        found, out = places_by_gid(right), []
        for gid, text in zip(left.column("gid").to_pylist(), left.column("text")):
            if gid not in found:
                continue
            data = np.frombuffer(text.as_buffer(), np.uint8)
            last = len(data) - length
            marks = np.zeros(last + 2, np.int32)  # a sample at s leaves the suffixes from s - v + 1 to s
            np.add.at(marks, np.minimum(np.maximum(found[gid] - v + 1, 0), last + 1), 1)
            np.add.at(marks, np.minimum(found[gid], last) + 1, -1)
            at = np.flatnonzero(np.cumsum(marks[: last + 1]) > 0)
            out.append((first.spans(data, at, at + length), (second.spans(data, at, at + length) >> np.uint64(32)).astype(np.uint32), np.full(len(at), gid, np.int64), at.astype(np.uint32)))
        if not out:
            return pa.Table.from_batches([], ENTRY_SCHEMA)
        return pa.Table.from_batches([entries(*map(np.concatenate, zip(*out)), bits)])

    blocks = texts.withColumn("block", F.shiftright("gid", BLOCK_BITS)).select("block", "gid", "text")
    windows = blocks.groupBy("block").cogroup(samples.groupBy("block")).applyInArrow(window_entries, ENTRIES)
    return store(windows.groupBy("bucket").applyInArrow(ties_of_bucket, TIES), "repeats")


ENTRY_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("tied", pa.bool_()), *((k, pa.binary()) for k in ("hashes", "checks", "gids", "places"))]
)
REMOVED = "gid long, n_removed long, span_starts array<long>, span_ends array<long>, kept_sha256 string"


def removed_spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by windows of ``length`` at sorted ``starts``."""
    new = np.ones(len(starts), bool)
    new[1:] = np.diff(starts) > length
    last = np.ones(len(starts), bool)
    last[:-1] = new[1:]
    return starts[new], starts[last] + length


def cut_texts(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """For each text with repeats, the spans removed and the digest of what is left."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        places, rows = places_by_gid(right), []
        for gid, text in zip(left.column("gid").to_pylist(), left.column("text")):
            if gid in places:
                data = memoryview(text.as_buffer())
                starts, ends = removed_spans(places[gid], length)
                kept = hashlib.sha256()
                for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]):
                    kept.update(data[a:b])
                rows.append((gid, int((ends - starts).sum()), starts.tolist(), ends.tolist(), kept.hexdigest()))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(["gid", "n_removed", "span_starts", "span_ends", "kept_sha256"], columns, kinds)})

    blocks = texts.withColumn("block", F.shiftright("gid", BLOCK_BITS)).select("block", "gid", "text")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, REMOVED)


def repeated_substrings(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, span_starts, span_ends (byte spans removed), kept_sha256."""
    rows = documents(docs, id_column, text_column).toDF("doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("key", F.sha2("text", 256)).withColumn("n_bytes", F.octet_length("text").cast("long"))
    texts = rows.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = store(texts.withColumn("gid", F.monotonically_increasing_id()).withColumn("n_bytes", F.octet_length("text").cast("long")), "texts")
    total = texts.agg(F.sum("n_bytes")).first()[0] or 0
    cut = store(cut_texts(texts, repeats(texts, length, total), length), "cut")
    each = texts.select("key", "copies", "gid", F.col("n_bytes").alias("n")).join(cut, "gid", "left")
    whole, none = F.col("copies") > 1, F.sha2(F.lit(b""), 256)
    empty = F.array().cast("array<long>")
    zero = F.lit(0).cast("long")
    each = each.select(
        "key",
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.array(zero)).otherwise(F.coalesce("span_starts", empty)).alias("span_starts"),
        F.when(whole, F.array("n")).otherwise(F.coalesce("span_ends", empty)).alias("span_ends"),
        F.when(whole, none).otherwise(F.coalesce("kept_sha256", F.col("key"))).alias("kept_sha256"),
    )
    each = store(each.filter("n_removed > 0"), "results")
    out = rows.select("doc_id", "key", "n_bytes").join(each, "key", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("span_starts", empty).alias("span_starts"),
        F.coalesce("span_ends", empty).alias("span_ends"),
        F.coalesce("kept_sha256", "key").alias("kept_sha256"),
    )
