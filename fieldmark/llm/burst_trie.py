"""Prefix trie of conversations, grown as a burst trie: containers of suffixes under trie heads.

A turn's id is a digest of role and text. Every conversation is a row of turn ids; all begin in the
container of the root.

1. Bursting: a container with more than ``most`` turns is no longer kept whole. Its members agree up to
   some depth, found by a count, a smallest and a largest turn id per position; that stretch becomes
   nodes as it is, and from its end the members go on into one container for each next turn id. One
   round bursts every oversized container, so the rounds follow the branchings of the trie, not its depth.
2. A container of one conversation is a plain path; its nodes come straight from its turns, whatever their
   number. The other containers hold at most ``most`` turns: each is sorted by turn ids and swept once,
   with a stack of the open nodes.
3. Totals of subtrees go up from the containers to the heads, one sum for each round, last first.

Rows are turns throughout, so no conversation and no group of equal ones is ever held in one place
unless it is small. The list of conversations that end in a node is hashed in order as a stream, fed
by pieces that many tasks have joined. A stretch of agreeing turns is summed by a window over
one row for each of its positions.

Defined cases: turns are ordered by ``turn`` (null first), equal ones by the digest of role and text;
null roles and texts count as empty. Rows without a conversation id belong to no conversation and are
left out. Repeated rows are repeated turns. A conversation without turns ends in the root. Without any
conversation there is no node. Texts of any length are reduced to digest and word count where they are
read. Further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import documents, store
from fieldmark.llm.ordered import positions
from fieldmark.session import discard

#: turns of a container that is kept whole
MOST = 10_000
#: characters of one piece of a list of ids
PIECE = 1 << 16
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SINGLE, SMALL, LARGE = 1, 2, 3


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, position, size, tid, words): every turn with its place; texts are reduced to digests."""
    rows = documents(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    tid = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    rows = store(rows.select(F.col("conv_id").cast("long").alias("conv"), "turn", tid.alias("tid"), words.alias("words")), "turns")
    placed = store(positions(rows, ["conv"], ["turn", "tid"], "turns"), "turns")
    discard(rows)
    return placed


def rebuilt(placed: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each begins with the first crc32(id) % (most + 1) turns of its group's first.

    turns: conv, pos (from 1), tid, words, len. conversations: conv, len.
    """
    each = placed.filter("position = 1").select("conv", "size")
    ids = each.select("conv", "size", F.expr(f"crc32(cast(conv as string)) % {most + 1}").alias("h"), F.expr(f"conv - conv % {group}").alias("base"))
    sizes = each.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    ids = ids.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    ids = store(ids.withColumn("len", F.expr("taken + greatest(size - h, 0)")), "conversations")
    first = placed.filter(F.col("position") <= most).select(F.col("conv").alias("base"), F.col("position").alias("pos"), "tid", "words")
    taken = ids.select("conv", "len", "h", "base").join(first, "base").filter("pos <= h")
    own = placed.drop("size").join(ids.select("conv", "len", "h", "taken"), "conv").filter("position > h")
    columns = ["conv", "pos", "tid", "words", "len"]
    turns = taken.select(*columns).unionByName(own.withColumn("pos", F.expr("position - h + taken")).select(*columns))
    return store(turns, "rebuilt"), ids.select("conv", "len")


def _sweep(sequences: list[tuple[tuple, int, list]], start: int, up: int | None) -> list[list]:
    """Nodes of one container from its sorted suffixes (turn ids, conversation, words)."""
    done: list[list] = []  # [depth, low, parent's place, n, children, leaves, saved, ends]
    stack: list[list] = []
    words: list[int] = []

    def close() -> None:
        node = stack.pop()
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * words.pop()
        if stack:
            above = stack[-1]
            above[1] = min(above[1], node[1])
            for k in (3, 5, 6):
                above[k] += node[k]
            above[4] += 1

    before: tuple = ()
    for ids, conv, counts in sequences:
        same = 0
        while same < min(len(ids), len(before)) and ids[same] == before[same]:
            same += 1
        while len(stack) > same:
            close()
        for k in range(same, len(ids)):
            node = [start + k, conv, stack[-1] if stack else None, 0, 0, 0, 0, []]
            stack.append(node)
            done.append(node)
            words.append(counts[k])
        end = stack[-1]
        end[1], end[3] = min(end[1], conv), end[3] + 1
        end[7].append(conv)
        before = ids
    while stack:
        close()
    for node in done:
        ends = ",".join(map(str, sorted(node[7])))
        node[7] = hashlib.sha256(ends.encode()).hexdigest()
    return [[n[1], n[0], n[2][1] if n[2] else up, *n[3:]] for n in done]


def swept(rows: DataFrame) -> DataFrame:
    """Nodes of containers kept whole, with ``head`` and ``top`` (the container's first node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def nodes() -> pa.RecordBatch:
            suffixes: dict[int, tuple[list, list]] = {}
            for row in held:
                ids, counts = suffixes.setdefault(row["conv"], ([], []))
                ids.append(row["tid"])
                counts.append(row["words"])
            start, up, head = held[0]["d0"], held[0]["up"], held[0]["head"]
            ordered = sorted((tuple(ids), conv, counts) for conv, (ids, counts) in suffixes.items())
            found = [[*node, head, node[1] == start] for node in _sweep(ordered, start, up)]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)], names=names)

        kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.bool_()]
        names = [c.split()[0] for c in NODE.split(", ")] + ["head", "top"]
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["head"] != row["head"]:
                    yield nodes()
                    held = []
                held.append(row)
        if held:
            yield nodes()

    own = rows.select("head", "d0", "up", "conv", "pos", "tid", "words")
    return own.repartition("head").sortWithinPartitions("head", "conv", "pos").mapInArrow(run, f"{NODE}, head binary, top boolean")


def ends_digest(ended: DataFrame) -> DataFrame:
    """(head, ends_sha256): SHA-256 of the ascending ids of ``ended(head, conv)``, joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for key, conv in zip(batch["head"].to_pylist(), batch["conv"].to_pylist()):
                if ids and (key != head or size > PIECE):
                    out.append((head, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    head, first = key, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["head", "first", "piece"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (head, first, ",".join(ids))], names=["head", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state = None, None
        for batch in batches:
            out = []
            for key, piece in zip(batch["head"].to_pylist(), batch["piece"].to_pylist()):
                if state is None or key != head:
                    if state is not None:
                        out.append((head, state.hexdigest()))
                    head, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["head", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([head]), pa.array([state.hexdigest()])], names=["head", "ends_sha256"])

    ranged = ended.repartitionByRange("head", "conv").sortWithinPartitions("head", "conv")
    pieces = ranged.mapInArrow(join, "head binary, first long, piece string")
    return pieces.repartition("head").sortWithinPartitions("head", "first").mapInArrow(digest, "head binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, most: int = MOST) -> DataFrame:
    """Every node of the trie over ``turns(conv, pos, tid, words, len)`` and ``convs(conv, len)``."""
    root = F.lit(bytearray())
    rows = turns.withColumns({"head": root, "kind": F.lit(LARGE)})
    heads = convs.agg(F.count("*").alias("n"), F.min("conv").alias("low")).filter("n > 0")
    heads = heads.select(root.alias("head"), F.lit(0).cast("long").alias("d0"), "n", "low", F.lit(None).cast("long").alias("up"))
    rounds, ends = [], [convs.filter("len = 0").select(root.alias("head"), "conv")]
    while True:
        # how far the members of each container agree
        runs = rows.groupBy("head", "pos").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.count("*").alias("at"), F.min("words").alias("words"))
        runs = store(runs, "trie-runs")
        parted = F.when((F.col("lo") != F.col("hi")) | (F.col("at") < F.col("n")), F.col("pos"))
        points = heads.join(runs, "head", "left").groupBy(*heads.columns).agg(F.min(parted).alias("parted"), F.max("pos").alias("last"))
        heads = store(points.withColumn("q", F.coalesce(F.col("parted") - 1, "last", "d0")).drop("parted", "last"), "trie-heads")
        # members that end there, and the containers of the others by their next turn
        at = rows.join(heads.select("head", "q"), "head")
        ends.append(at.filter("pos = q and len = q").select("head", "conv"))
        step = at.filter("pos = q + 1").select("conv", F.col("head").alias("parent"), F.unhex(F.md5(F.concat("head", "tid"))).alias("head"), (F.col("len") - F.col("q")).alias("size"), (F.col("q") + 1).alias("d0"))
        step = store(step, "trie-step")
        kinds = step.groupBy("head", "parent", "d0").agg(F.count("*").alias("n"), F.min("conv").alias("low"), F.sum("size").alias("size"))
        kinds = kinds.join(heads.select(F.col("head").alias("parent"), F.col("low").alias("up")), "parent")
        kind = F.when(F.col("n") == 1, SINGLE).when(F.col("size") <= most, SMALL).otherwise(LARGE)
        kinds = store(kinds.withColumn("kind", kind), "trie-kinds")
        going = step.select("conv", "head").join(kinds.select("head", "kind", "up", "d0"), "head")
        rows = store(rows.select("conv", "pos", "tid", "words", "len").join(going, "conv").filter("pos >= d0"), "trie-rows")
        rounds.append((heads, runs, kinds, rows))
        heads = kinds.filter(F.col("kind") == LARGE).select(*heads.columns[:-1])
        if heads.isEmpty():
            break
        rows = rows.filter(F.col("kind") == LARGE)

    union = lambda frames: reduce(DataFrame.unionByName, frames)
    kept = union([r[3] for r in rounds])
    columns = [c.split()[0] for c in NODE.split(", ")]
    small = store(swept(kept.filter(F.col("kind") == SMALL)), "trie-swept")
    digests = store(ends_digest(union(ends)), "trie-ends")
    last = F.col("pos") == F.col("len")
    alone = kept.filter(F.col("kind") == SINGLE).select(
        F.col("conv").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.when(F.col("pos") == F.col("d0"), F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        (~last).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(NONE).alias("ends_sha256"),
    )
    totals = small.filter("top").select("head", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    nodes = []
    for heads, runs, kinds, _ in reversed(rounds):
        below = kinds.select("parent", "head").join(totals, "head", "left")
        below = below.groupBy(F.col("parent").alias("head")).agg(F.count("*").alias("children"), F.sum(F.coalesce("leaves", F.lit(1))).alias("leaves"), F.sum(F.coalesce("saved", F.lit(0))).alias("under"))
        known = heads.join(below, "head", "left").fillna({"children": 0, "leaves": 1, "under": 0}).join(digests, "head", "left")
        stretch = known.join(runs.select("head", "pos", "words"), "head").filter("pos <= q")
        stretch = stretch.unionByName(known.filter("d0 = 0").withColumns({"pos": F.lit(0).cast("long"), "words": F.lit(0).cast("long")}))
        down = Window.partitionBy("head").orderBy(F.desc("pos"))
        saved = F.col("under") + (F.col("n") - 1) * F.sum("words").over(down)
        end = F.col("pos") == F.col("q")
        found = stretch.select(
            F.col("low").alias("conv_id"),
            F.col("pos").alias("depth"),
            F.when(F.col("pos") == F.col("d0"), F.col("up")).otherwise(F.col("low")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(end, F.col("children")).otherwise(1).alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            saved.alias("saved_tokens"),
            F.when(end, F.coalesce("ends_sha256", F.lit(NONE))).otherwise(NONE).alias("ends_sha256"),
            "head",
            (F.col("pos") == F.col("d0")).alias("top"),
        )
        found = store(found, "trie-nodes")
        nodes.append(found.select(*columns))
        more = found.filter("top").select("head", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        totals = totals.unionByName(more)
    return union([small.select(*columns), alone, *nodes])


def conversation_trie(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    placed = turns_of(conversations)
    return trie(*rebuilt(placed), most)
