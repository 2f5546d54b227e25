"""Text quality: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model.

A text is the set of its n-grams: words, word pairs, the shapes of words and of word pairs (runs
of upper, lower, digit, mark and other), and whether a word repeats one just before it. Each
is hashed to one of ``FEATURES`` places. A place weighs the logarithm of the ratio of its shares
in good and in bad texts, counted over every labelled row; texts are scaled to length 1. The
hinge-loss model is fitted by dual coordinate descent on a sample of about ``sample_rows``
labelled rows, chosen by a hash of the id; a fifth of the sample turns margins into probabilities.

Every row is scored where it is read, from its whole text alone.

Defined cases: null texts are empty, and empty texts are scored by the model's bias; rows without
a 0 or 1 label are not learned from, several labels of a document each count; with no labels the
score is 0.5, with one class it is that class's smoothed share; repeated rows are scored each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import GOLDEN, RollingHash, documents, mix, slices, store, text_bytes, word_hashes, word_spans

FEATURES, PART = 1 << 18, 1 << 13
WORD_HASH, SHAPE_HASH = 7201, 7202
UPPER, LOWER, DIGIT, MARK, OTHER = range(1, 6)
SHAPE = np.full(256, OTHER, np.uint8)
SHAPE[:128] = MARK
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58] = UPPER, LOWER, DIGIT


def shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: RollingHash, piece: int = 1 << 18) -> np.ndarray:
    """Hash of each word's sequence of character kinds, repeats taken once."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, side="right")))
        base = starts[at]
        kinds = SHAPE[data[base : ends[to - 1]]]
        change = np.ones(len(kinds), bool)
        change[1:] = kinds[1:] != kinds[:-1]
        change[starts[at:to] - base] = True
        before = np.concatenate([[0], np.cumsum(change)])
        out[at:to] = hasher.spans(kinds[change], before[starts[at:to] - base], before[ends[at:to] - base])
        at = to
    return out


@dataclass
class Grams:
    """Distinct (text, place) pairs of a batch, by text."""

    text: np.ndarray
    place: np.ndarray
    first: np.ndarray


def grams(column: pa.Array) -> Grams:
    data, offs = text_bytes(column)
    starts, ends = word_spans(data, offs)
    words, first = word_hashes(data, offs, RollingHash(WORD_HASH))
    shapes = shape_hashes(data, starts, ends, RollingHash(SHAPE_HASH))
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = [(texts, mix(words + GOLDEN)), (texts, mix(shapes ^ GOLDEN))]
    for back, kinds in ((1, ((words, 3), (shapes, 4))), (2, ())):
        same = texts[back:] == texts[:-back] if len(texts) > back else np.zeros(0, bool)
        if not same.any():
            continue
        here = np.flatnonzero(same) + back
        for values, salt in kinds:
            found.append((texts[here], mix(mix(values[here - back] + np.uint64(salt)) + values[here])))
        again = here[words[here] == words[here - back]]
        found.append((texts[again], np.full(len(again), 100 + back, np.uint64) * GOLDEN))
    key = np.unique(np.concatenate([t * FEATURES + (h >> np.uint64(46)).astype(np.int64) for t, h in found]))
    text = key // FEATURES
    return Grams(text, key % FEATURES, np.searchsorted(text, np.arange(len(first))))


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """(weights, bias) of the hinge-loss model on scaled indicators, by dual coordinate descent.

    The rarer class costs as much as the other one in all.
    """
    rng = np.random.default_rng(seed)
    y = np.where(labels > 0, 1.0, -1.0)
    bound = cost * len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))
    values = [ratio[r] / max(1e-12, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows]
    alpha, w, bias = np.zeros(len(y)), np.zeros(len(ratio)), 0.0
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / ((v @ v) + 1.0), 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets."""
    pos, neg = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


@dataclass
class QualityModel:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, found: Grams, n: int) -> np.ndarray:
        r = self.ratio[found.place]
        length = np.sqrt(np.bincount(found.text, r * r, minlength=n))
        total = np.bincount(found.text, r * self.weight[found.place], minlength=n)
        return total / np.maximum(length, 1e-12) + self.bias

    def scores(self, found: Grams, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(found, n) + self.shift, -30, 30)))


def fit(labelled: DataFrame, n_rows: int, sample_rows: int = 8000, smooth: float = 1.0) -> QualityModel | None:
    """Model from ``labelled(id, text, label)``, of which there are ``n_rows``."""
    share = min(1.0, sample_rows / max(1, n_rows))
    picked = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1_000_000)) < int(share * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        kinds = [("part", pa.int32()), ("counts", pa.binary()), ("label", pa.int32()), ("places", pa.list_(pa.int32()))]

        def rows(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

        for batch in slices(batches, "text"):
            found = grams(batch.column("text"))
            label = batch.column("label").to_numpy()
            for c in (0, 1):
                counts[c] += np.bincount(found.place[label[found.text] == c], minlength=FEATURES)
                sizes[c] += int((label == c).sum())
            take = np.flatnonzero(batch.column("picked").to_numpy(zero_copy_only=False))
            lists = [found.place[found.first[k] : found.first[k + 1]].astype(np.int32) for k in take]
            yield rows([None] * len(take), [None] * len(take), label[take], lists)
        if sizes.sum():
            parts = range(FEATURES // PART)
            blobs = [counts[:, k * PART : (k + 1) * PART].tobytes() for k in parts] + [sizes.tobytes()]
            yield rows([*parts, len(parts)], blobs, [None] * len(blobs), [None] * len(blobs))

    marked = labelled.select("text", F.col("label").cast("int").alias("label"), picked.alias("picked"))
    made = store(marked.mapInArrow(run, "part int, counts binary, label int, places array<int>"), "labelled")

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in table.column("counts"))
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    sums = made.filter("part is not null").select("part", "counts").groupBy("part").applyInArrow(added, "part int, counts binary")
    parts = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in sums.toArrow().to_pylist()}
    if not parts:
        return None
    sizes = parts.pop(FEATURES // PART)
    if not sizes.all():
        p = (sizes[1] + 1) / (sizes.sum() + 2)
        zero = np.zeros(FEATURES)
        return QualityModel(zero, zero, 0.0, 1.0, float(np.log(p / (1 - p))))
    counts = np.concatenate([parts[k].reshape(2, PART) for k in range(FEATURES // PART)], axis=1) + smooth
    shares = counts / counts.sum(axis=1)[:, None]
    ratio = np.log(shares[1] / shares[0])
    sample = made.filter("part is null").select("label", "places").toArrow()
    labels = sample.column("label").to_numpy()
    lists = [x.values.to_numpy() for x in sample.column("places")]
    order = np.random.default_rng(3).permutation(len(lists))
    kept, held = order[len(order) // 5 :], order[: len(order) // 5]
    weight, bias = fit_hinge([lists[i] for i in kept], labels[kept], ratio)
    model = QualityModel(ratio, weight, bias, 1.0, 0.0)
    judged = held if len(set(labels[held].tolist())) == 2 else order
    at = np.concatenate([[0], np.cumsum([len(lists[i]) for i in judged])]).astype(np.int64)
    place = np.concatenate([lists[i] for i in judged]) if len(judged) else np.zeros(0, np.int64)
    found = Grams(np.repeat(np.arange(len(judged)), np.diff(at)), place, at)
    model.slope, model.shift = sigmoid_fit(model.margins(found, len(judged)), labels[judged])
    return model


def predict(docs: DataFrame, model: QualityModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: the good class likelier)."""
    rows = documents(docs, id_column, text_column).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in slices(batches, "text"):
            n = batch.num_rows
            scores = found.scores(grams(batch.column("text")), n) if found else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(column: str):
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the labelled documents that are not held out."""
    marks = documents(labels, "doc_id", "quality").toDF("id", "label").filter("label in (0, 1)")
    marks = marks.withColumn("id", F.col("id").cast("long")).filter(~held_out("id"))
    rows = documents(docs, "doc_id", "text").toDF("id", "text").withColumn("id", F.col("id").cast("long")).filter(~held_out("id"))
    # both sides grow with the data, so the join is the same at every size
    model = fit(rows.join(marks.hint("merge"), "id"), marks.count(), sample_rows)
    found = predict(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
