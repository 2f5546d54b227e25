"""Helpers the operators share: stored intermediate tables, Arrow text buffers, vectorised hashes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.session import discard, materialise

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for the length of one block; names use ``__`` for ``.``."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches() -> dict[str, str]:
    """Settings under which texts or token lists are read and given to Python in pieces of a few megabytes.

    A reader's batch is one array on the heap, made anew in twice the size until it fits; at the default of 4,096
    rows of texts that is tens of megabytes a task, for which the heap grows although little of it is in use.
    """
    return {"spark__sql__parquet__columnarReaderBatchSize": "256", "spark__sql__execution__arrow__maxBytesPerBatch": str(8 << 20)}


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back; its shuffle files go when it is written.

    Arrow batches are bounded in bytes, so a run of very long texts does not fill a worker.
    """
    with settings(
        df.sparkSession,
        spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
        spark__sql__execution__arrow__maxBytesPerBatch=str(8 << 20),
        spark__sql__parquet__compression__codec="zstd",
    ):
        stored = materialise(df, f"llm-{name}")
    if _passing:
        _passing[-1].append(stored)
    return stored


_passing: list[list[DataFrame]] = []


@contextmanager
def passing():
    """Tables stored inside the block are deleted at its end, but for those given to the function it yields.

    What a block returns may read only tables it has kept.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _passing.append(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _passing.pop()
        discard(*[t for t in made if not any(t is k for k in kept)])
        if _passing:
            _passing[-1].extend(kept)


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that further columns of any name cannot clash with an operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


# ---------------------------------------------------------------- Arrow buffers


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).fill_null("").cast(kind)
    else:
        column = column.cast(kind).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column holds at most ``max_bytes`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


# ---------------------------------------------------------------- hashes

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """64-bit polynomial hashes of byte strings, with a random value per byte.

    ``spans(data, starts, ends)`` gives the hash of every span in a few vector operations.
    """

    def __init__(self, seed: int, fold_case: bool = False):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64)
        if fold_case:
            self.table[65:91] = self.table[97:123]
        self.base = np.uint64(int(rng.integers(1, 2**62)) * 4 + 3)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.power = self.unpower = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(2 * len(self.power), n + 1)
            for name, by in (("power", self.base), ("unpower", self.inverse)):
                values = np.full(size, by, np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p = self.prefix(data)
        h = (p[ends] - p[starts]) * self.unpower[starts]
        return mix(h + (ends - starts).astype(np.uint64) * GOLDEN)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offs: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end; none crosses a text."""
    starts, ends = [], []
    for at in range(0, len(data), piece):
        to = min(at + piece, len(data))
        inside = np.zeros(to - at + 2, bool)
        inside[1:-1] = ~SPACE[data[at:to]]
        inside[0] = at > 0 and not SPACE[data[at - 1]]
        inside[-1] = to < len(data) and not SPACE[data[to]]
        edge = np.zeros(to - at + 1, bool)  # a text ends before this byte
        lo, hi = np.searchsorted(offs, [at, to], side="left")
        cut = offs[lo:hi] - at
        edge[cut] = True
        here, before, after = inside[1:-1], inside[:-2], inside[2:]
        first = here & (~before | edge[:-1])
        edge[-1] = bool(np.any(offs[np.searchsorted(offs, to) :][:1] == to))
        last = here & (~after | edge[1:])
        starts.append(np.flatnonzero(first) + at)
        ends.append(np.flatnonzero(last) + at + 1)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


MARKS = np.zeros(256, bool)
MARKS[np.frombuffer(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""", np.uint8)] = True


def without_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without punctuation at either end; a span of punctuation only stays."""
    mark = MARKS[data]
    two = np.flatnonzero((data[:-1] == 0xC2) & np.isin(data[1:], [0xA1, 0xAB, 0xBB, 0xBF]))
    general = (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x90)  # dashes, quotes, dots
    three = np.flatnonzero(general | (data[:-2] == 0xE3) & (data[1:-1] == 0x80) & np.isin(data[2:], [0x81, 0x82]))
    for at, n in ((two, 2), (three, 3)):
        for k in range(n):
            mark[at + k] = True
    inner = np.append(np.flatnonzero(~mark), len(data))
    first, last = np.searchsorted(inner, starts), np.searchsorted(inner, ends) - 1
    some = last >= first
    return np.where(some, inner[first], starts), np.where(some, inner[last] + 1, ends)


def word_hashes(
    data: np.ndarray, offs: np.ndarray, hasher: RollingHash, piece: int = 1 << 18, marks: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of the first word of each text, with one more at the end).

    Without ``marks``, words are taken without punctuation at either end.
    """
    starts, ends = word_spans(data, offs)
    if not marks:
        starts, ends = without_marks(data, starts, ends)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, side="right")))
        base = starts[at]
        out[at:to] = hasher.spans(data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base)
        at = to
    return out, np.searchsorted(starts, offs)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct sorted hashes of the n-word shingles of one text; the whole of a shorter one, none of an empty one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64) * GOLDEN
    for k in range(width):
        total = mix(total + words[k : len(words) - width + 1 + k])
    return np.unique(total)
