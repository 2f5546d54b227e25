"""Merkle manifest of a dataset, with a proof per row made by pointer jumping.

A row's leaf is the SHA-256 of its fields. Leaves of one source in ascending id form a tree whose
runs of three become one node each, up to the source's root; the roots of the sources, in
order of their names, form a tree in the same way, up to the root of the dataset.

1. Leaves are numbered in their source by sort ranges (``ordered.positions``), so that a source
   that holds a third of all rows is dealt to many tasks. Levels are sums over runs of three.
2. Every node points to its parent and holds one segment: the digests left and right of it in its run.
3. Pointer jumping: leaves and inner nodes are joined with the node they point to, take over its
   pointer and append its segments. The distance doubles each round, so the whole proof is there
   after log2(height) rounds; nodes too low to be met again drop out, which
   leaves about a ninth of the leaves after the first round, then an 81st, and so on.

Folding a leaf with its segments gives the root, so a changed row is found without its neighbours.

Defined cases: a null field counts as ``-``; a null id comes first and is never tampered with; a null
source is a source of its own and comes first. Rows with equal ids are ordered by their leaves, and
repeated rows are leaves of their own. A lone leaf is its source's root, a lone source's root is the
dataset's. Empty tables give no rows. Further columns of any name are ignored. Texts of any length are
hashed where they are read, and only digests move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import documents, store
from fieldmark.llm.ordered import positions
from fieldmark.session import discard

RUN = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: the tree over the sources' roots
TOP = -1
SEGMENT = "array<struct<l:binary,r:binary>>"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its UTF-8 byte count, a colon and its value, or ``-`` where it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (f.cast("string") for f in fields)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _joined(digests: Column) -> Column:
    """Hex text of an array of digests, laid end to end."""
    return F.lower(F.hex(F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))))


def _node(tree, level, index) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), index.cast("long").alias("index"))


def _up(level: int) -> Column:
    """The parent of a run of ``level``; a source's root is a leaf of the top tree."""
    ends = (F.col("n") <= RUN) & (F.col("tree") != TOP)
    return F.when(ends, _node(F.lit(TOP), F.lit(0), F.col("tree"))).otherwise(_node(F.col("tree"), F.lit(level + 1), F.col("run")))


def _members(runs: DataFrame, level: int) -> DataFrame:
    """One row per node of ``level``: itself, its parent, its segment, and whatever it carries."""
    each = runs.select("*", F.posexplode("members").alias("at", "own"))
    left = F.expr("slice(digests, 1, at)")
    right = F.expr(f"slice(digests, at + 2, {RUN})")
    cut = [F.aggregate(d, F.lit(b""), lambda a, x: F.concat(a, x)) for d in (left, right)]
    each = each.withColumn("digests", F.transform("members", lambda m: m["digest"]))
    segment = F.array(F.struct(cut[0].alias("l"), cut[1].alias("r"))).cast(SEGMENT)
    return each.select(_node(F.col("tree"), F.lit(level), F.col("own.index")).alias("node"), _up(level).alias("up"), segment.alias("path"), "tree", "own.carried", "own.digest")


def _tree(leaves: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level, and the roots.

    ``leaves``: tree, index, n (leaves of the tree), digest, carried. ``most``: leaves of the largest tree.
    """
    levels, roots, at = [], [leaves.filter("n = 1").select("tree", "digest")], leaves.filter("n > 1")
    while most > 1:
        own = F.struct("index", "digest", "carried")
        runs = at.groupBy("tree", F.floor(F.col("index") / RUN).cast("long").alias("run"), "n").agg(F.sort_array(F.collect_list(own)).alias("members"))
        runs = store(runs, f"{name}-runs")
        levels.append(runs)
        digest = F.unhex(F.sha2(_joined(F.transform("members", lambda m: m["digest"])), 256))
        above = runs.select("tree", F.col("run").alias("index"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), digest.alias("digest"), F.lit(None).cast("string").alias("carried"))
        roots.append(above.filter("n = 1").select("tree", "digest"))
        at = above.filter("n > 1")
        most = -(-most // RUN)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, found


def _jump(rows: DataFrame, nodes: DataFrame, root: Column) -> DataFrame:
    """Rows that point below the root take over the pointer they point to, and append its segments."""
    far = nodes.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("rest"))
    others = [c for c in rows.columns if c not in ("up", "path")]
    moved = rows.filter(F.col("up") != root).join(far, "up").select(*others, F.col("next").alias("up"), F.concat("path", "rest").alias("path"))
    return rows.filter(F.col("up") == root).select(*others, "up", "path").unionByName(moved)


def proofs(leaves: DataFrame, scratch: str = "merkle") -> DataFrame:
    """(tree, digest, carried, path, subroot, root) per leaf of ``leaves(source, digest, order, carried)``.

    ``path`` is the list of digests left and right of the leaf and of each node above it, up to the root.
    ``order`` (long) gives the leaf's place in its source, then the digest; ``carried`` (string) comes along.
    """
    names = store(leaves.select(F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none")).distinct(), scratch)
    names = positions(names.withColumn("rank", (~F.col("none")).cast("int")), [], ["rank", "key"], scratch)
    sources = store(names.select("key", "none", (F.col("position") - 1).alias("tree")), f"{scratch}-sources")
    keyed = leaves.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    placed = positions(keyed.join(sources, ["key", "none"]).select("tree", "order", "digest", "carried"), ["tree"], ["order", "digest"], scratch)
    at = store(placed.select("tree", (F.col("position") - 1).alias("index"), F.col("size").alias("n"), "digest", "carried"), f"{scratch}-leaves")

    count = sources.count()
    most = at.agg(F.max("n")).first()[0] or 0
    levels, roots = _tree(at, most, scratch)
    roots = store(roots, f"{scratch}-roots")
    over = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(count).cast("long").alias("n"), "digest", F.lit(None).cast("string").alias("carried"))
    above, top = _tree(over, count, scratch)
    height = len(above)
    root = _node(F.lit(TOP), F.lit(height), F.lit(0))

    columns = ["tree", "digest", "carried", "up", "path"]
    lone = at.filter("n = 1").select("tree", "digest", "carried", _node(F.lit(TOP), F.lit(0), F.col("tree")).alias("up"), F.array().cast(SEGMENT).alias("path"))
    paths = lone if not levels else lone.unionByName(_members(levels[0], 0).select(*columns))
    nodes = None
    for level, runs in [*list(enumerate(levels))[1:], *enumerate(above)]:
        some = _members(runs, level).select("node", "up", "path")
        nodes = some if nodes is None else nodes.unionByName(some)
    tall, reach = max(len(levels), 1) + height, 1  # a lone leaf starts at its own node, one level behind
    if nodes is not None:
        nodes = store(nodes, f"{scratch}-nodes")
    done = []
    while reach < tall:
        before = [nodes, *done]
        paths = store(_jump(paths, nodes, root), f"{scratch}-paths")
        nodes = store(_jump(nodes, nodes, root).filter((F.col("node.tree") == TOP) | (F.col("node.level") >= 2 * reach)), f"{scratch}-nodes")
        discard(*before)
        done = [paths]
        reach *= 2
    digest = top.first()
    named = paths.join(roots.select("tree", F.col("digest").alias("subroot")), "tree")
    return named.drop("up").withColumn("root", F.lit(bytes(digest[1]) if digest else b""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hex digest gives with its path."""
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.concat(F.lower(F.hex(s["l"])), a, F.lower(F.hex(s["r"]))), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Every second id's text loses its line ends before folding, so that proofs are seen to fail.
    """
    rows = documents(docs, *FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    changed = leaf_digest([F.col(c) for c in FIELDS[:-1]] + [F.regexp_replace("text", "\n", "")])
    carried = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(hit, F.lower(F.hex(changed))))
    leaves = store(rows.select("source", F.col("doc_id").alias("order"), leaf_digest([F.col(c) for c in FIELDS]).alias("digest"), carried.alias("carried")), "merkle-digests")
    found = proofs(leaves)
    parts = F.split("carried", ",")
    leaf = F.lower(F.hex("digest"))
    siblings = F.aggregate("path", F.lit(b""), lambda a, s: F.concat(a, s["l"], s["r"]))
    root = F.lower(F.hex("root"))
    out = found.select(
        F.when(parts[0] != "-", parts[0].cast("long")).alias("doc_id"),
        leaf.alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(F.lower(F.hex(siblings)), 256).alias("proof_sha256"),
        fold(F.coalesce(F.get(parts, F.lit(1)), leaf), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
