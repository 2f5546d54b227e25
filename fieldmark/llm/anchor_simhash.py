"""SimHash near duplicates by anchor points: fingerprints meet at the words of a covering code.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Every n-word shingle, repeats included, is
hashed with XXH64; a bit of the fingerprint is set where over half of the hashes have it set.

1. Equal fingerprints are one node at once, so copies are never compared with one another.
2. Two fingerprints that differ in at most t bits differ in at most one bit of one of
   t // 2 + 1 blocks. For every block the anchors are a covering code: a perfect Hamming code on the
   largest 2^m - 1 bits that fit, and all values of the few bits beyond them. Its covering
   radius is 1, the threshold within the block is 1.
3. A fingerprint goes to every anchor within covering radius plus threshold, 2, of its block: its own
   anchor, the (2^m - 2) / 2 others two bits away, and one for each bit beyond. The partner of a link
   is then at the anchor of the other, whichever of the two blocks they agree in.
4. Per anchor all fingerprints are compared by the population count of their XOR. What is already linked
   there is not compared again, and links go out as stars, at most one a member, not as all pairs.
   An anchor with very many members is dealt to many tasks, one for each pair of parts of it.
5. Components grow by minimum labels over the links.

Exact: no link between fingerprints is missed, and none is made up.

Defined cases: null or empty texts and texts of white space have the fingerprint zero and are linked like
any other. Fewer than n words make one shingle. Rows without an id get a fingerprint but are never
linked: their component is null. Repeated rows share fingerprint and component. Texts are hashed in
pieces, so a very long one needs no more memory than a piece. Empty tables give no rows.
Further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import SPACE, documents, slices, store, text_bytes
from fieldmark.llm.odd_sketch import components
from fieldmark.session import discard

SEED, BITS = 42, 64
#: bytes of text hashed at once
PIECE = 1 << 20
#: fingerprints of one anchor compared in one task
MOST = 1 << 16


def _pieces(raw: np.ndarray, size: int) -> Iterator[bytes]:
    """A text in pieces that end where a word ends."""
    at = 0
    while at < len(raw):
        to = at + size
        while to < len(raw):
            gaps = np.flatnonzero(SPACE[raw[to : to + size]])
            if len(gaps):
                to += int(gaps[0])
                break
            to += size
        yield raw[at:to].tobytes()
        at = to


def bit_fingerprint(raw: np.ndarray, n: int, size: int = PIECE) -> int:
    """SimHash of a text's UTF-8 bytes."""
    total, counts, words = 0, np.zeros(BITS, np.int64), []
    digest = xxhash.xxh64_intdigest

    def add(shingles: Iterator[bytes]) -> int:
        hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        for at in range(0, len(hashes), 1 << 15):
            bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[:] += bits.sum(axis=0, dtype=np.int64)
        return len(hashes)

    for piece in _pieces(raw, size):
        words += piece.lower().split()
        if len(words) >= n:
            total += add(map(b" ".join, zip(*[words[k:] for k in range(n)])))
            words = words[len(words) - n + 1 :]
    if not total and words:
        total = add(iter([b" ".join(words)]))
    return int((1 << np.flatnonzero(2 * counts > total).astype(object)).sum()) if total else 0


def fingerprints(docs: DataFrame, n: int, id_column: str, text_column: str) -> DataFrame:
    """(id, print) of every row, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offs = text_bytes(batch.column("text"))
            found = np.array([bit_fingerprint(data[a:b], n) for a, b in zip(offs[:-1], offs[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "print"])

    rows = documents(docs, id_column, text_column).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(run, "id long, print long")


def _blocks(threshold: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the blocks, of which one holds at most one of the differing bits."""
    count = threshold // 2 + 1
    edges = [BITS * k // count for k in range(count + 1)]
    return list(zip(edges, np.diff(edges).tolist()))


def _anchors(value: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, anchors, whether they are the rows' own) within 2 bits of each block value.

    The code: a perfect Hamming code on the lowest 2^m - 1 bits, times all values of the bits beyond.
    """
    n = 2 ** ((width + 1).bit_length() - 1) - 1
    one, every = np.uint64(1), np.arange(len(value))
    bit = lambda p: np.where(p > 0, one << np.maximum(p, 1).astype(np.uint64) - one, np.uint64(0))
    syndrome = np.zeros(len(value), np.int64)
    for p in range(1, n + 1):
        syndrome ^= np.where(value >> np.uint64(p - 1) & one, p, 0)
    home = value ^ bit(syndrome)
    yield every, home, True
    for b in range(n, width):
        yield every, home ^ (one << np.uint64(b)), False
    for p in range(1, n + 1):
        at = np.flatnonzero((syndrome > 0) & (syndrome ^ p > p))  # the other position that gives this syndrome
        yield at, value[at] ^ bit(np.full(len(at), p)) ^ bit(syndrome[at] ^ p), False


def at_anchors(prints: DataFrame, threshold: int) -> DataFrame:
    """(block, anchor, home, print): every fingerprint at every anchor near it; ``home`` marks its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["print"].to_numpy().view(np.uint64)
            for k, (low, width) in enumerate(_blocks(threshold)):
                value = own >> np.uint64(low) & np.uint64((1 << width) - 1)
                for at, anchor, home in _anchors(value, width):
                    columns = [np.full(len(at), k), anchor.view(np.int64), np.full(len(at), home), own[at].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "anchor", "home", "print"])

    return prints.select("print").mapInArrow(run, "block long, anchor long, home boolean, print long")


def _near(prints: np.ndarray, threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of one anchor as stars: members reached are taken out, so nothing linked is compared again."""
    rest, us, vs = prints, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            own = queue.pop()
            hit = np.bitwise_count(rest ^ own) <= threshold
            if hit.any():
                us.append(np.full(int(hit.sum()), own))
                vs.append(rest[hit])
                queue.extend(rest[hit])
                rest = rest[~hit]
    return us, vs


def _compare(threshold: int, small: int = 8):
    """Links among rows sorted by ``key``; a key's rows may span batches."""

    def links(keys: np.ndarray, prints: np.ndarray, home: np.ndarray):
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        size = np.diff(np.append(first, len(keys)))
        own = np.add.reduceat(home.astype(np.int64), first) > 0  # a link is found at the home of one side
        us, vs = [], []
        few = own & (size > 1) & (size <= small)
        inside = np.repeat(np.where(few, first + size, 0), size)  # end of the row's group
        for k in range(1, small):
            at = np.flatnonzero(inside > np.arange(len(keys)) + k)
            hit = at[np.bitwise_count(prints[at] ^ prints[at + k]) <= threshold]
            us.append(prints[hit])
            vs.append(prints[hit + k])
        for a, n in zip(first[own & (size > small)], size[own & (size > small)]):
            more = _near(prints[a : a + n], threshold)
            us += more[0]
            vs += more[1]
        u, v = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("block", "anchor", "a", "b")], axis=1)
            rows = keys, batch["print"].to_numpy().view(np.uint64), batch["home"].to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if last or held and (held[-1][0][-1] != keys[0]).any():
                cut = [np.concatenate(x) for x in zip(*held, [x[:last] for x in rows])]
                if len(cut[0]):
                    yield links(*cut)
                held = []
            held.append(tuple(x[last:] for x in rows))
        if held:
            yield links(*[np.concatenate(x) for x in zip(*held)])

    return run


def near_links(prints: DataFrame, threshold: int, most: int = MOST) -> DataFrame:
    """(u, v) of distinct ``prints(print)`` whose components are those of all pairs within ``threshold`` bits."""
    spread = at_anchors(prints, threshold)
    large = spread.groupBy("block", "anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    large = store(large.select("block", "anchor", F.ceil(F.col("n") / most).cast("int").alias("parts")), "simhash-large")
    dealt = spread.join(large, ["block", "anchor"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("print"), "parts").cast("int")
    dealt = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("block", "anchor", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "home", "print")
    key = ["block", "anchor", "a", "b"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "print").mapInArrow(_compare(threshold), "u long, v long")


def near_duplicates(
    docs: DataFrame, words: int = 3, threshold: int = 3, id_column: str = "doc_id", text_column: str = "text", most: int = MOST
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links, itself included)."""
    signed = store(fingerprints(docs, words, id_column, text_column), "simhash")
    prints = store(signed.filter("id is not null").groupBy("print").agg(F.min("id").alias("low")), "simhash-prints")
    links = store(near_links(prints.select("print"), threshold, most).distinct(), "simhash-links")
    labels = components(links, "simhash-stars")
    named = prints.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    named = store(named, "simhash-named")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = store(named.join(lowest, "component").select("print", "component_id"), "simhash-components")
    discard(prints, links)
    return signed.join(named, "print", "left").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
