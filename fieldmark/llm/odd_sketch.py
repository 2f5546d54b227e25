"""Near-duplicate documents: banded MinHash, odd sketches to sift candidates, full sets to confirm.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document is the set of its distinct
n-word shingles (fewer words: the whole sequence as one shingle; no words: no set). Documents
with equal sets form one class at once, so copies are never compared with one another.

1. Each class gets k MinHash values. Groups of them form bands, and equal bands make candidates.
   The parity of the values' hashed positions is folded into a bitmap, the odd sketch: the
   population count of the XOR of two bitmaps tells how many values differ, which is the
   more precise the more similar the two are.
2. Of the classes in buckets, those drop out whose set has too many shingles of its own, which
   no other candidate has: they cannot reach the threshold with any.
3. In each bucket every class is paired with the one that has the fewest of its own, the centre of
   its group. Pairs whose sketches are too far apart go; the others are confirmed on the full sets
   and become links.
4. Buckets that still hold several components compare the classes outside their largest
   component with all others, by odd sketches of the whole sets. Each differing bit stands for at least one
   shingle that only one of the two has, so what differs in too many bits has no link for certain.
   No pair of one component is made.
5. Components grow by repeated minimum labels over the links, in joins and sums.

A band is missed with probability (1 - t^rows)^bands: 5e-11 at t = 0.85, 5e-8 at t = 0.8. A
sketch rejects a true link with about the same probability.

Defined cases: null or empty texts and texts of white space have no shingles and stand alone.
Rows without an id are never linked: their component is null and they are kept. Repeated rows
share class and component. Further columns of any name are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import GOLDEN, RollingHash, documents, mix, passing, settings, shingles, slices, store, text_bytes, word_hashes

BANDS, ROWS, SKETCH_BITS, WHOLE_BITS = 32, 4, 512, 2048
WORD_HASH = 7001
SIGNATURE = "id long, hash long, n long, digest binary, bands array<long>, sketch array<long>"


def _sets(batch: pa.RecordBatch, text: str, n: int, hasher: RollingHash) -> Iterator[np.ndarray]:
    data, offs = text_bytes(batch.column(text))
    words, first = word_hashes(data, offs, hasher)
    for k in range(batch.num_rows):
        yield shingles(words[first[k] : first[k + 1]], n)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """One row per document: hash of its text, size and digest of its set, band hashes and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash(WORD_HASH, fold_case=True)
        rng = np.random.default_rng(11)
        k = BANDS * ROWS
        factor = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(1, 2**63, k, dtype=np.uint64)
        salt = np.arange(k, dtype=np.uint64) * GOLDEN
        for batch in slices(batches, "text"):
            sizes, digests, bands, sketches = [], [], [], []
            for found in _sets(batch, "text", n, hasher):
                sizes.append(len(found))
                digests.append(_digest(found))
                if not len(found):
                    bands.append(None)
                    sketches.append(None)
                    continue
                low = np.full(k, np.uint64(2**64 - 1))
                for at in range(0, len(found), 512):
                    part = found[at : at + 512]
                    np.minimum(low, (part[:, None] * factor + shift).min(axis=0), out=low)
                values = mix(low + salt)
                rows = values.reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64) * GOLDEN
                for r in range(ROWS):
                    key = mix(key + rows[:, r])
                bands.append(key.view(np.int64))
                odd = np.bincount((values % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("hash"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["id", "hash", "n", "digest", "bands", "sketch"],
            )

    rows = documents(docs, id_column, text_column).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    return rows.withColumn("hash", F.xxhash64("text")).mapInArrow(run, SIGNATURE)


def most_bits(threshold: float, slack: float = 5.5) -> int:
    """Differing sketch bits that a pair of the threshold's similarity exceeds with a chance of about 1e-8.

    ``slack`` counts standard deviations, of the MinHash sample and of the bitmap's collisions.
    """
    k, n = BANDS * ROWS, SKETCH_BITS
    mean = k * (1 - threshold)
    differing = 2 * min(k, mean + slack * math.sqrt(k * threshold * (1 - threshold)))
    expected = n / 2 * (1 - math.exp(-2 * differing / n))
    return math.ceil(expected + slack * math.sqrt(expected * (1 - expected / n) / 4))


def _far(a: str, b: str, bits: int = SKETCH_BITS):
    """Population count of the XOR of two sketches."""
    words = range(bits // 64)
    return sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in words)


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of ``links(u, v)``: the smallest node reachable.

    Large-star and small-star steps alternate until the links stop changing; each is one sum per
    node and one join, so a node with many links is combined before the shuffle.
    """
    edges = store(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    state = mark(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = store(small.filter("u <> v").distinct(), name)
        before, state = state, mark(edges)
        if before == state:
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(ends.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))


def full_sets(nodes: DataFrame, classes: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(nid, found) with the whole set of each class of ``nodes(nid)``, made anew from one text of it; stored."""
    wanted = store(nodes.join(classes.select("nid", "rep", "digest"), "nid"), "wanted")

    def run(batches):
        hasher = RollingHash(WORD_HASH, fold_case=True)
        for batch in slices(batches, "text"):
            nids, sets = [], []
            for nid, digest, found in zip(batch["nid"], batch["digest"], _sets(batch, "text", n, hasher)):
                if _digest(found) == digest.as_py():  # a repeated id may have other texts
                    nids.append(nid.as_py())
                    sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["nid", "found"]
            )

    # few texts are wanted: Spark drops the others by a Bloom filter of the ids before the exchange
    chosen = wanted.withColumnRenamed("rep", "id").filter("nid >= 0").hint("merge")
    joined = rows.join(chosen, "id").select("nid", "digest", "text")
    with settings(rows.sparkSession, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"):
        return store(joined.mapInArrow(run, "nid long, found array<long>").dropDuplicates(["nid"]), "sets")


def linkable(sets: DataFrame, percent: int) -> DataFrame:
    """Classes whose set is not too much their own: shingles that no other of ``sets`` has cannot be shared.

    A similarity is at most the share of a set that others have too, so what falls below has no link.
    ``own`` is the share in thousandths; a set with few of its own is central in its group. ``size``
    counts the set and ``common`` those of its shingles that some other of ``sets`` has.
    """
    each = sets.select("nid", F.explode("found").alias("shingle"))
    own = each.groupBy("shingle").agg(F.count("*").alias("k"), F.min("nid").alias("nid")).filter("k = 1")
    own = own.groupBy("nid").agg(F.count("*").alias("own"))
    sizes = sets.select("nid", F.size("found").cast("long").alias("n"))
    shares = sizes.join(own, "nid", "left").filter(f"100 * (n - coalesce(own, 0)) >= {percent} * n")
    own = F.coalesce("own", F.lit(0))
    return shares.select("nid", F.expr("1000 * coalesce(own, 0) div n").alias("own"), F.col("n").alias("size"), (F.col("n") - own).alias("common"))


def reachable(u: str, v: str, percent: int):
    """Whether two sets could be similar enough: they share at most what the one with fewer has in common with any."""
    both = F.least(f"common_{u}", f"common_{v}")
    return 100 * both >= percent * (F.col(f"size_{u}") + F.col(f"size_{v}") - both)


def whole_sketches(sets: DataFrame) -> DataFrame:
    """(nid, whole): the odd sketch of all shingles of a set, not of a sample."""

    def run(batches):
        for batch in batches:
            whole = []
            for found in batch["found"]:
                places = (found.values.to_numpy().view(np.uint64) >> np.uint64(64 - WHOLE_BITS.bit_length() + 1)).astype(np.int64)
                odd = np.bincount(places, minlength=WHOLE_BITS) & 1
                whole.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["nid"], pa.array(whole, pa.list_(pa.int64()))], names=["nid", "whole"])

    return sets.select("nid", "found").mapInArrow(run, "nid long, whole array<long>")


def within(u: str, v: str, percent: int):
    """Whether two sets could be similar enough: they differ in at least as many shingles as their whole sketches in bits.

    With s the sum of the sizes and d the shingles that one of the two has, the similarity is (s - d) / (s + d). Exact: no
    link is turned away, however the hashes fall.
    """
    size = F.col(f"size_{u}") + F.col(f"size_{v}")
    return (100 + percent) * _far(f"whole_{u}", f"whole_{v}", WHOLE_BITS) <= (100 - percent) * size


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` whose full sets share ``percent`` percent of their union; stored."""

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            for u, v, a, b in zip(batch["u"], batch["v"], batch["found_u"], batch["found_v"]):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (a, b))
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    us.append(u.as_py())
                    vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    joined = pairs.join(sets.toDF("u", "found_u"), "u").join(sets.toDF("v", "found_v"), "v")
    return store(joined.select("u", "v", "found_u", "found_v").mapInArrow(compare, "u long, v long"), "confirmed")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is that id)."""
    with passing() as keep:
        return _judged(docs, words, percent, id_column, text_column, keep).drop("hash")


def _judged(docs: DataFrame, words: int, percent: int, id_column: str, text_column: str, keep) -> DataFrame:
    """``near_duplicates`` with the hash of each text; ``keep`` is told which stored tables it reads."""
    signed = keep(store(signatures(docs, id_column, text_column, words), "signatures"))
    rows = documents(docs, id_column, text_column).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    classes = (
        signed.filter("n > 0 and id is not null")
        .groupBy("digest")
        .agg(F.min(F.struct("id", "bands", "sketch")).alias("first"))
        .select(F.monotonically_increasing_id().alias("nid"), F.col("first.id").alias("rep"), "digest", "first.bands", "first.sketch")
    )
    classes = store(classes, "classes")
    allowed = most_bits(percent / 100)
    known = classes.select("nid", "sketch", F.size("sketch").alias("size"), F.size("sketch").alias("common"))

    def sides(u: str, v: str):
        base = known.select("nid", "sketch", "size", "common")
        return base.toDF(u, f"s{u}", f"size_{u}", f"common_{u}"), base.toDF(v, f"s{v}", f"size_{v}", f"common_{v}")

    def near(pairs: DataFrame) -> DataFrame:
        left, right = sides("u", "v")
        with_both = pairs.join(left, "u").join(right, "v")
        return with_both.filter(reachable("u", "v", percent) & (_far("su", "sv") <= allowed)).select("u", "v", "own")

    def headed(keys: DataFrame) -> DataFrame:
        heads = keys.groupBy("bucket").agg(F.min(F.struct("own", "nid")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        return keys.join(heads.select("bucket", "n", F.col("first.nid").alias("head"), F.col("first.own").alias("head_own")), "bucket")

    def to_head(members: DataFrame) -> DataFrame:
        pairs = members.filter("nid <> head").groupBy(F.col("nid").alias("u"), F.col("head").alias("v")).agg(F.min("head_own").alias("own"))
        return near(pairs)

    keys = classes.select("nid", F.posexplode("bands").alias("b", "band"))
    keys = keys.select("nid", F.xxhash64("b", "band").alias("bucket"), F.lit(0).cast("long").alias("own"))
    members = store(headed(keys), "buckets")
    twos = to_head(members.filter("n = 2")).select(F.explode(F.array("u", "v")).alias("nid"))
    nodes = twos.union(members.filter("n > 2").select("nid")).distinct()
    sets = full_sets(nodes, classes, rows, words)
    able = store(linkable(sets, percent), "linkable")
    members = store(headed(members.select("nid", "bucket").join(able.select("nid", "own"), "nid")), "buckets")
    known = classes.select("nid", "sketch").join(able.select("nid", "size", "common"), "nid")
    known = store(known.join(whole_sketches(sets), "nid"), "sketches")

    pairs = store(to_head(members), "pairs")
    nearest = pairs.groupBy("u").agg(F.min(F.struct("own", "v")).alias("head")).select("u", "head.v")
    links = confirmed(nearest, sets, percent)
    labels = store(components(links), "labels")

    def labelled(df: DataFrame, node: str, label: str) -> DataFrame:
        own = labels.select(F.col("node").alias(node), F.col("component").alias(label))
        return df.join(own, node, "left").withColumn(label, F.coalesce(label, node))

    def merged(links: DataFrame) -> DataFrame:
        """Labels after further links: only the components they touch are joined, not the nodes again."""
        between = labelled(labelled(links, "u", "cu"), "v", "cv").filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        more = store(components(between, "merged"), "merged")
        moved = labels.join(more.toDF("component", "low"), "component", "left").select("node", F.coalesce("low", "component").alias("component"))
        return store(moved.union(more.join(labels, "node", "left_anti")), "labels")

    others = pairs.join(nearest, ["u", "v"], "left_anti")
    others = labelled(labelled(others, "u", "cu"), "v", "cv").filter("cu <> cv").select("u", "v")
    labels = merged(confirmed(others, sets, percent))

    # buckets of three or more that still hold several components: all but the largest against the rest
    spread = labelled(members.filter("n > 2"), "nid", "c")
    parts = spread.groupBy("bucket", "c").agg(F.count("*").alias("size"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("size", F.col("c").alias("main"))).alias("top"), F.count("*").alias("k"))
    main = main.filter("k > 1").select("bucket", "top.main")
    torn = store(spread.join(main, "bucket").select("bucket", "nid", "head", "c", "main").join(known.drop("sketch"), "nid"), "torn")
    own = ["whole", "size", "common"]
    left = torn.filter("c <> main").select("bucket", "head", *[F.col(x).alias(y) for x, y in zip(["nid", "c", *own], ["u", "cu", "whole_u", "size_u", "common_u"])])
    right = torn.select("bucket", "main", *[F.col(x).alias(y) for x, y in zip(["nid", "c", *own], ["v", "cv", "whole_v", "size_v", "common_v"])])
    across = left.join(right, "bucket").filter(
        (F.col("cu") != F.col("cv"))
        & (F.col("u") != F.col("head"))
        & (F.col("v") != F.col("head"))
        & ((F.col("cv") == F.col("main")) | (F.col("u") < F.col("v")))
        & reachable("u", "v", percent)
        & within("u", "v", percent)
    )
    labels = merged(confirmed(across.select("u", "v").distinct(), sets, percent))

    named = labelled(classes.select("nid", "rep", "digest"), "nid", "c")
    lowest = labels.join(classes.select(F.col("nid").alias("node"), "rep"), "node")
    lowest = lowest.groupBy("component").agg(F.min("rep").alias("lowest"))
    named = named.join(lowest.withColumnRenamed("component", "c"), "c", "left")
    named = keep(store(named.select("digest", F.coalesce("lowest", "rep").alias("component_id")), "named"))
    alone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return (
        signed.select("id", "hash", "n", "digest")
        .join(named, "digest", "left")
        .select(
            "hash",
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), alone).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are near duplicates of a kept one; columns unchanged.

    Rows that share an id and the text count as one document. Rows that share an id with different texts are
    judged each by its own: of those in the group the id stands for one stays, and of the others those
    that have no words.
    """
    act, own = "act", "own"
    while {act, own} & set(docs.columns):
        act, own = act + "_", own + "_"
    with passing() as keep:
        rows = _judged(docs, words, percent, "doc_id", "text", lambda table: table).filter("doc_id is not null")
        stays = F.col("kept") & (F.col("n_shingles") > 0)
        each = rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.max(~F.col("kept")).alias("gone"), F.min(F.when(stays, F.col("hash"))).alias(own))
        each = each.filter("k > 1 or gone").select("doc_id", F.when(F.col("k") > 1, "many").otherwise("drop").alias(act), own)
        acts = keep(store(each, "acts"))
    marked = docs.join(acts.hint("shuffle_hash"), "doc_id", "left")  # texts pass by, and are not sorted
    single = marked.filter(F.col(act).isNull()).select(*docs.columns)
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    many = marked.filter((F.col(act) == "many") & (wordless | (F.xxhash64("text") == F.col(own))))
    return single.unionByName(many.dropDuplicates(["doc_id", "text"]).select(*docs.columns))
