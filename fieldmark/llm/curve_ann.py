"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are put into bands of like length. Each of several curves projects a band's vectors to a few
random directions, cuts each projection into cells at its quantiles (of a sample), shifted by a random
offset, and orders the vectors by the Hilbert index of their cell; a cell's vectors are in random order,
another on every curve. Spark sorts the keys by range, so every vector
gets its rank on every curve. In each band a query meets the candidates whose rank lies within a window of its
own; the windows of all curves are merged and ranked by the true inner product, in doubles.

A curve is cut into blocks of equal ranks, whatever the keys, so vectors crowded in one place
are spread over blocks. A window is a share of the band (``window``), so what it finds does not
change with size; high-dimensional vectors without structure need wide ones. Many queries on one
block are split into groups of ``QUERIES``.

Equal vectors are one vector with a list of its smallest ids: a query needs at most ``k`` of them.
The largest inner product is the smallest distance once vectors are padded to equal length, so
curves order candidates with the length they lack to the band's longest as one more coordinate, and
queries, brought to the band's length, with zero there.

Defined cases: vectors that are null, empty, of another size than the most common one, zero, or hold
null, NaN or infinite numbers take no part, nor do rows without an id; a repeated id with the
same vector counts once; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import GOLDEN, documents, mix, store

CURVES, DIMENSIONS, BITS = 16, 8, 4
BLOCK, QUERIES, LEAST_WINDOW = 2048, 2048, 512
#: longest to shortest vector of a band; vectors of a band behind its cells' bounds
BAND, SAMPLE = 1.25, 4096


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points in a grid of 2^bits per axis (cells: points x axes)."""
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    step = top
    while step > 1:  # undo rotations, high bits first
        low = step - 1
        for axis in x:
            turn = (axis & step) != 0
            swap = np.where(turn, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(turn, low, swap)
            axis ^= swap
        step >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    step = top
    while step > 1:
        flip ^= np.where((x[-1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


class Curves:
    """Random directions and shifts, the same for every task; ``lengths`` has each band's longest."""

    def __init__(self, size: int, lengths: list[float], seed: int = 21):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(CURVES, size + 1, DIMENSIONS))
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        shift = 0.9 * (rng.random((CURVES, DIMENSIONS, 1)) - 0.5)
        #: share of a band below each bound of a cell
        self.levels = np.clip((np.arange(1, 1 << BITS) - 0.5 + shift) / ((1 << BITS) - 1), 0, 1)
        self.lengths = lengths
        self.bounds: dict[int, np.ndarray] = {}  # of each band: curves x dimensions x bounds

    def whole(self, vectors: np.ndarray, band: int, query: bool) -> np.ndarray:
        squares = (vectors**2).sum(axis=1)
        if query:
            return np.concatenate([vectors * (self.lengths[band] / np.sqrt(squares))[:, None], np.zeros((len(vectors), 1))], axis=1)
        return np.concatenate([vectors, np.sqrt(np.maximum(0, self.lengths[band] ** 2 - squares))[:, None]], axis=1)

    def cut(self, vectors: np.ndarray, band: int) -> np.ndarray:
        """Bounds of the cells of a band, from some of its vectors."""
        at = [self.whole(vectors, band, False) @ d for d in self.directions]
        return np.array([[np.quantile(x, level) for x, level in zip(a.T, levels)] for a, levels in zip(at, self.levels)])

    def keys(self, vectors: np.ndarray, band: int, query: bool) -> np.ndarray:
        """keys[curve, vector] of vectors of one band, or of queries to it."""
        whole, out = self.whole(vectors, band, query), []
        for directions, bounds in zip(self.directions, self.bounds[band]):
            cells = [np.searchsorted(b, x, side="right") for b, x in zip(bounds, (whole @ directions).T)]
            out.append(hilbert_index(np.array(cells).T.reshape(len(vectors), DIMENSIONS), BITS))
        return np.array(out).reshape(CURVES, len(vectors))


def of_band(values: list, band: str = "band"):
    """The value of a row's band."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(band) + 1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<f8").reshape(len(column), -1)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) with v the vector's doubles as bytes, for vectors that can take part."""
    rows = documents(vectors, id_column, vector_column).toDF("vec_id", "e")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("e").cast("array<double>").alias("e"))
    good = "vec_id is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)"
    rows = rows.filter(good)
    sizes = rows.groupBy(F.size("e").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.filter(F.size("e") == (sizes["size"] if sizes else 0))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("e")
            offs = e.offsets.to_numpy()
            flat = e.values.to_numpy(zero_copy_only=False) + 0.0  # no negative zero
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([flat[a:b].astype("<f8").tobytes() for a, b in zip(offs[:-1], offs[1:])], pa.binary())],
                names=["vec_id", "v"],
            )

    return rows.mapInArrow(raw, "vec_id long, v binary")


def smallest(ids: DataFrame, k: int, n: int) -> DataFrame:
    """(v, ids): the k smallest ids of each vector, cut to k in lists of a few thousand at a time."""
    salts = -(-n // 4096)
    lists = ids.distinct().select("v", F.array("vec_id").alias("ids"), F.xxhash64("vec_id").alias("h"))
    while True:
        lists = lists.groupBy("v", F.pmod("h", F.lit(max(1, salts))).alias("h")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))
        if salts <= 1:
            return lists.select("v", "ids")
        salts = -(-salts // 128)


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, window: float = 0.1, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for ids divisible by ``every``, the k other ids of largest inner product found."""
    spark = vectors.sparkSession
    ids = store(usable(vectors, id_column, vector_column), "vectors")
    answer = "query_id long, rank int, vec_id long, score double"
    groups = smallest(ids, k + 1, ids.count()).withColumn("gid", F.monotonically_increasing_id())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length = np.sqrt((matrix(batch.column("v")) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], names=["gid", "v", "ids", "length"])

    groups = store(groups.select("gid", "v", "ids").mapInArrow(measured, "gid long, v binary, ids array<long>, length double"), "groups")
    n, width, longest = groups.agg(F.count("*"), F.max(F.length("v")), F.max("length")).first()
    if not n:
        return spark.createDataFrame([], answer)
    # bands of like length, the longest first; neighbours that a window covers whole are one band
    bin_ = F.floor(F.log(F.lit(longest) / F.col("length")) / float(np.log(BAND))).cast("int")
    starts, sizes, lengths = [], [], []
    for r in groups.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.max("length").alias("length")).orderBy("bin").collect():
        if starts and sizes[-1] + r.n <= LEAST_WINDOW:
            sizes[-1] += r.n
        else:
            starts.append(r.bin)
            sizes.append(r.n)
            lengths.append(r.length)
    reach = [max(LEAST_WINDOW, int(np.ceil(m * window / 2))) for m in sizes]
    band = F.size(F.filter(F.array(*[F.lit(x) for x in starts]), lambda x: x <= bin_)) - 1
    groups = groups.withColumn("band", band)
    curves = Curves(width // 8, lengths)
    some = groups.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < of_band([min(1 << 20, SAMPLE * (1 << 20) // m + 1) for m in sizes]))

    def bounds(table: pa.Table) -> pa.Table:
        b = table.column("band")[0].as_py()
        return pa.table({"band": pa.array([b], pa.int32()), "bounds": pa.array([curves.cut(matrix(table.column("v")), b).astype("<f8").tobytes()])})

    cells = {r.band: r.bounds for r in some.select("band", "v").groupBy("band").applyInArrow(bounds, "band int, bounds binary").collect()}
    for b in range(len(sizes)):  # a band without a sampled vector is one cell
        raw = np.frombuffer(bytes(cells[b]), "<f8") if b in cells else np.zeros(curves.levels.size)
        curves.bounds[b] = raw.reshape(curves.levels.shape)
    asking = ids.filter(F.pmod("vec_id", F.lit(every)) == 0)

    def keyed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, own = matrix(batch.column("v")), batch.column(0).to_numpy()
                bands = None if query else batch.column("band").to_numpy()
                for b in range(len(sizes)) if query else np.unique(bands).tolist():
                    at = np.arange(len(x)) if query else np.flatnonzero(bands == b)
                    keys = curves.keys(x[at], b, query)
                    for c in range(CURVES):
                        salt = mix(own[at].astype(np.uint64) + np.uint64(c + 1) * GOLDEN).view(np.int64)
                        same = [pa.array(np.full(len(at), v, np.int32)) for v in (c, b)]
                        yield pa.RecordBatch.from_arrays(
                            [*same, pa.array(keys[c]), pa.array(salt), pa.array(own[at]), pa.array(np.full(len(at), query))],
                            names=["curve", "band", "key", "salt", "id", "query"],
                        )

        return run

    shape = "curve int, band int, key long, salt long, id long, query boolean"
    points = groups.select("gid", "v", "band").mapInArrow(keyed(False), shape)
    points = points.union(asking.select("vec_id", "v").mapInArrow(keyed(True), shape))
    # ranks: rows sorted over range partitions, then counted in two levels
    order = ["curve", "band", "key", "salt", "query", "id"]
    ordered = points.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = store(ordered.withColumn("mid", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("mid", 33)
    runs = ordered.groupBy("curve", "band", part.alias("part")).agg(F.min("mid").alias("low"), F.sum(F.when(F.col("query"), 0).otherwise(1)).alias("k"))
    before = Window.partitionBy("curve", "band").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("begin", F.coalesce(F.sum("k").over(before), F.lit(0)))
    inside = Window.partitionBy("curve", "band", "part").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ordered.withColumn("part", part).join(runs, ["curve", "band", "part"])
    ranked = ranked.withColumn("rank", F.col("begin") + F.coalesce(F.sum(F.when(F.col("query"), 0).otherwise(1)).over(inside), F.lit(0)))
    ranked = store(ranked.select("curve", "band", "id", "query", "rank"), "ranked")

    data = ranked.filter("not query").select("curve", "band", F.expr(f"rank div {BLOCK}").alias("block"), F.col("id").alias("gid"), "rank")
    n_asking = asking.count()
    chunks = [max(1, int(np.ceil(n_asking * min(1.0, (2 * r + BLOCK) / m) / QUERIES))) for r, m in zip(reach, sizes)]
    data = data.join(groups.select("gid", "v", "ids"), "gid").withColumn("chunk", F.explode(F.sequence(F.lit(0), of_band(chunks) - 1)))
    asked = ranked.filter("query").select("curve", "band", F.col("id").alias("query_id"), "rank")
    asked = asked.join(asking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).dropDuplicates(["query_id", "qv"]), "query_id")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), of_band(chunks)).cast("int")).withColumn("reach", of_band(reach))
    blocks = F.sequence(F.expr(f"greatest(rank - reach, 0) div {BLOCK}"), F.expr(f"least(rank + reach, size - 1) div {BLOCK}"))
    asked = asked.withColumn("size", of_band(sizes)).withColumn("block", F.explode(blocks))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "ids": [], "scores": []}
        if left.num_rows and right.num_rows:
            x, rank = matrix(left.column("v")), left.column("rank").to_numpy()
            own = left.column("ids").to_pylist()
            q = matrix(right.column("qv"))
            at, far = right.column("at").to_numpy(), right.column("reach").to_numpy()
            for i in range(0, len(q), 256):
                scores = q[i : i + 256] @ x.T
                scores[np.abs(at[i : i + 256, None] - rank[None, :]) > far[i : i + 256, None]] = -np.inf
                take = min(k + 1, scores.shape[1])  # the query itself may be among them
                top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
                for row in range(len(top)):
                    cut = scores[row, top[row]].min()  # all that tie with the last stay
                    some = np.flatnonzero((scores[row] >= cut) & (scores[row] > -np.inf))
                    query = right.column("query_id")[i + row].as_py()
                    exact = (x[some] * q[i + row]).sum(axis=1)  # the same for a pair wherever it meets
                    found = sorted(((-s, v) for s, j in zip(exact.tolist(), some) for v in own[j] if v != query))[:k]
                    out["query_id"].append(query)
                    out["ids"].append([v for _, v in found])
                    out["scores"].append([-s for s, _ in found])
        kinds = {"query_id": pa.int64(), "ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float64())}
        return pa.table({c: pa.array(out[c], t) for c, t in kinds.items()})

    keys = ["curve", "band", "block", "chunk"]
    asked = asked.select("query_id", "qv", F.col("rank").alias("at"), "reach", *[F.col(c).alias(f"q_{c}") for c in keys])
    found = data.groupBy(*keys).cogroup(asked.groupBy(*[f"q_{c}" for c in keys])).applyInArrow(best, "query_id long, ids array<long>, scores array<double>")

    def merge(table: pa.Table) -> pa.Table:
        query = table.column("query_id")[0].as_py()
        pairs: dict[int, float] = {}
        for ids_, scores in zip(table.column("ids").to_pylist(), table.column("scores").to_pylist()):
            pairs.update(zip(ids_, scores))
        top = sorted(((-s, v) for v, s in pairs.items()))[:k]
        return pa.table(
            {
                "query_id": pa.array([query] * len(top), pa.int64()),
                "rank": pa.array(range(1, len(top) + 1), pa.int32()),
                "vec_id": pa.array([v for _, v in top], pa.int64()),
                "score": pa.array([-s for s, _ in top], pa.float64()),
            }
        )

    return found.groupBy("query_id").applyInArrow(merge, answer)
