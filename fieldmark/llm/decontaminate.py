"""Benchmark decontamination: BM25 over the test items, block-max pruning, overlap of question and answer.

The test items are indexed: each word's postings carry its BM25 weight as a share of the item's
score against itself. Every passage of every training document is a query (windows of twice the
longest item's words, moved by its length, so an item's copy lies whole in one of them), and the
passages with at least ``retrieve`` of an item's own score are retrieved, all of them.

Most passages are ruled out by bounds. Items are cut into blocks, and a block keeps the largest
weight of each word. A block's weakest words, which together stay below the threshold, can
never retrieve an item alone, so only its other words are looked up in a passage; a block is opened
if what they reach, plus all the weak ones, could pass the threshold. Only then are its items scored.

What is retrieved is verified on five-word shingles: ``overlap`` of those of question and answer
together must stand in the passage, some of the question's, and half of the answer's words, taken
without punctuation at either end. An answer shorter than a shingle takes in words before it.

The items are indexed in shards of bounded bytes; each shard's index is sent to the executors and
every document is read once per shard. Word counts over items are made over all of them.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Defined cases: null or empty texts hold
nothing; items of fewer than ``LEAST_WORDS`` words are no evidence and are skipped; repeated items
are reported each under its id; repeated documents are reported each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import RollingHash, documents, shingles, slices, store, text_bytes, word_hashes

WORD_HASH, SHINGLE, LEAST_WORDS, BLOCK_ITEMS = 7003, 5, 5, 2
SHARD_BYTES = 8 << 20
#: of the threshold, what a block's weak words may reach together; less makes bounds tighter and postings longer
WEAK_SHARE = 0.6
K1, B = 1.2, 0.75
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's text in two: the last sentence is the answer, or of one sentence its last third of words.

    The last sentence takes in words before it up to a shingle's, or half of a short item's.
    """
    sentences = re.split(r"(?<=[.!?])\s+", text.strip())
    words = text.split()
    if len(sentences) > 1:
        least = min(SHINGLE, len(words) // 2)
        if len(sentences[-1].split()) < least:
            return " ".join(words[:-least]), " ".join(words[-least:])
        return " ".join(sentences[:-1]), sentences[-1]
    cut = len(words) - len(words) // 3
    return " ".join(words[:cut]), " ".join(words[cut:])


def hashed_words(texts: list[str], hasher: RollingHash, marks: bool = True) -> list[np.ndarray]:
    data, offs = text_bytes(pa.array(texts, pa.large_string()))
    words, first = word_hashes(data, offs, hasher, marks=marks)
    return [words[a:b] for a, b in zip(first[:-1], first[1:])]


@dataclass
class Index:
    """One shard's postings. Terms are numbered by sorted hash."""

    terms: np.ndarray
    item_ids: np.ndarray
    passage: int  # words of the longest item
    item_words: list[np.ndarray]  # term numbers of each item
    item_weights: list[np.ndarray]
    question: list[np.ndarray]
    answer: list[np.ndarray]
    answer_words: list[np.ndarray]  # without outer punctuation
    widths: list[tuple[int, int]]  # words in a shingle of question and answer
    strong_at: np.ndarray  # of each term, where its strong postings begin
    strong_block: np.ndarray
    strong_weight: np.ndarray
    weak_sum: np.ndarray  # of each block


def build_index(items: list[tuple[int, str]], n_items: int, mean_words: float, frequency: dict[int, int], retrieve: float) -> Index | None:
    """Index of some items; ``frequency`` has each word hash's number of items among all ``n_items``."""
    hasher = RollingHash(WORD_HASH, fold_case=True)
    parts = [question_and_answer(text) for _, text in items]
    questions = hashed_words([q for q, _ in parts], hasher)
    answers = hashed_words([a for _, a in parts], hasher)
    bare = hashed_words([a for _, a in parts], hasher, marks=False)
    whole = [np.concatenate([q, a]) for q, a in zip(questions, answers)]
    order = [i for i in np.argsort([len(w) for w in whole], kind="stable") if len(whole[i]) >= LEAST_WORDS]
    if not order:
        return None
    terms = np.unique(np.concatenate([whole[i] for i in order]))
    idf = {t: math.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) for t in terms.tolist()}
    words, weights = [], []
    for i in order:
        counts = Counter(whole[i].tolist())
        norm = K1 * (1 - B + B * len(whole[i]) / mean_words)
        w = np.array([idf[t] * n * (K1 + 1) / (n + norm) for t, n in counts.items()])
        words.append(np.searchsorted(terms, np.array(list(counts), np.uint64)))
        weights.append(w / w.sum())
    postings, weak = [], []
    for block in range(-(-len(order) // BLOCK_ITEMS)):
        largest: dict[int, float] = {}
        for k in range(block * BLOCK_ITEMS, min(len(order), (block + 1) * BLOCK_ITEMS)):
            for t, w in zip(words[k].tolist(), weights[k].tolist()):
                largest[t] = max(w, largest.get(t, 0))
        total = 0.0
        # common words first: the words that rule out most passages are those that few items have
        for t, w in sorted(largest.items(), key=lambda x: idf[int(terms[x[0]])]):
            if total + w < retrieve * WEAK_SHARE:
                total += w
            else:
                postings.append((t, block, w))
        weak.append(total)
    postings.sort()
    own = np.array([t for t, _, _ in postings], np.int64)
    return Index(
        terms,
        np.array([items[i][0] for i in order], np.int64),
        max(len(whole[i]) for i in order),
        words,
        weights,
        [shingles(questions[i], SHINGLE) for i in order],
        [shingles(answers[i], SHINGLE) for i in order],
        [np.unique(bare[i]) for i in order],
        [(min(SHINGLE, max(1, len(questions[i]))), min(SHINGLE, max(1, len(answers[i])))) for i in order],
        np.searchsorted(own, np.arange(len(terms) + 1)),
        np.array([b for _, b, _ in postings], np.int64),
        np.array([w for _, _, w in postings]),
        np.array(weak),
    )


def windows(n_words: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of the passages of a document: twice the length, moved by the length."""
    count = max(1, -(-n_words // length) - 1) if n_words else 0
    return [(k * length, min(n_words, (k + 2) * length)) for k in range(count)]


def open_blocks(index: Index, words: np.ndarray, first: np.ndarray, retrieve: float) -> Iterator[tuple[int, int, int]]:
    """(text, window, block) whose bound reaches the threshold."""
    blocks = len(index.weak_sum)
    place = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    at = np.flatnonzero(index.terms[place] == words)
    begin, end = index.strong_at[place[at]], index.strong_at[place[at] + 1]
    some = end > begin
    at, begin, end = at[some], begin[some], end[some]
    n = end - begin
    posting = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    at = np.repeat(at, n)
    text = np.searchsorted(first, at, side="right") - 1
    count = np.maximum(1, -(-np.diff(first) // index.passage) - 1)
    base = np.concatenate([[0], np.cumsum(count)])
    last = np.minimum((at - first[text]) // index.passage, count[text] - 1)
    # a word lies in the window that begins in its stretch and in the one before
    key = np.concatenate([base[text] + last, base[text] + np.maximum(0, (at - first[text]) // index.passage - 1)])
    posting = np.concatenate([posting, posting])
    cell = key * blocks + index.strong_block[posting]
    size = max(1, len(index.strong_block))
    once = np.unique(cell * size + posting)  # a word counts once in a passage
    cells, inverse = np.unique(once // size, return_inverse=True)
    bound = np.bincount(inverse, index.strong_weight[once % size], minlength=len(cells)) + index.weak_sum[cells % blocks]
    for cell in cells[bound >= retrieve * 0.999]:
        window = int(cell // blocks)
        t = int(np.searchsorted(base, window, side="right")) - 1
        yield t, window - int(base[t]), int(cell % blocks)


def verified(index: Index, k: int, window: np.ndarray, bare: np.ndarray, overlap: float) -> tuple[float, float] | None:
    """Shares of an item's question and answer shingles in a passage, if they make it a copy; ``bare`` has its words without outer punctuation."""
    hits, sizes = [], []
    for part, width in ((index.question[k], index.widths[k][0]), (index.answer[k], index.widths[k][1])):
        hits.append(int(np.isin(part, shingles(window, width)).sum()) if len(part) else 0)
        sizes.append(len(part))
    words = np.isin(index.answer_words[k], bare).mean() if sizes[1] else 1.0
    if hits[0] and sum(hits) >= overlap * sum(sizes) and words >= 0.5:
        return hits[0] / sizes[0], hits[1] / sizes[1] if sizes[1] else 1.0
    return None


def search(index: Index, words: np.ndarray, bare: np.ndarray, first: np.ndarray, retrieve: float, overlap: float) -> dict[tuple[int, int], tuple]:
    """(text, item) -> (score, question overlap, answer overlap) of its best passage."""
    found: dict[tuple[int, int], tuple] = {}
    for text, number, block in open_blocks(index, words, first, retrieve):
        at = first[text] + number * index.passage
        here = slice(at, min(first[text + 1], at + 2 * index.passage))
        window = words[here]
        for k in range(block * BLOCK_ITEMS, min(len(index.item_words), (block + 1) * BLOCK_ITEMS)):
            score = float(index.item_weights[k][np.isin(index.terms[index.item_words[k]], window)].sum())
            if score >= retrieve:
                shares = verified(index, k, window, bare[here], overlap)
                if shares:
                    found[text, k] = max(found.get((text, k), (0.0, 0.0, 0.0)), (score, *shares))
    return found


def indexes(items: DataFrame, retrieve: float, shard_bytes: int = SHARD_BYTES) -> list:
    """The items' indexes as broadcasts, of at most about ``shard_bytes`` bytes of item text each."""
    spark = items.sparkSession
    tests = documents(items, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long")).filter("text is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash(WORD_HASH, fold_case=True)
        for batch in slices(batches, "text"):
            words = hashed_words(batch.column("text").to_pylist(), hasher)
            each = [np.unique(w).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), batch.column("text"), pa.array([len(w) for w in words], pa.int64()), pa.array(each, pa.list_(pa.int64()))],
                names=["item_id", "text", "n", "words"],
            )

    tests = store(tests.mapInArrow(counted, "item_id long, text string, n long, words array<long>").filter(f"n >= {LEAST_WORDS}"), "tests")
    n_items, mean_words, total = tests.agg(F.count("*"), F.avg("n"), F.sum(F.octet_length("text"))).first()
    frequency = tests.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    shards = -(-int(total or 0) // shard_bytes)
    tests = tests.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, shards))))
    found = []
    for shard in range(shards):
        own = tests.filter(F.col("shard") == shard)
        batch = own.select("item_id", "text").toArrow().to_pylist()
        table = own.select(F.explode("words").alias("word")).distinct().join(frequency, "word").toArrow()
        words = table.column("word").to_numpy().view(np.uint64).tolist()
        counts = dict(zip(words, table.column("df").to_pylist()))
        index = build_index([(r["item_id"], r["text"]) for r in batch], n_items, mean_words, counts, retrieve)
        if index is not None:
            found.append(spark.sparkContext.broadcast(index))
    return found


def leaks(docs: DataFrame, items: DataFrame, retrieve: float = 0.5, overlap: float = 0.8, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each test item found in a document: doc_id, item_id, score, question_overlap, answer_overlap."""
    rows = documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    for shared in indexes(items, retrieve, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher, index = RollingHash(WORD_HASH, fold_case=True), shared.value
            for batch in slices(batches, "text"):
                data, offs = text_bytes(batch.column("text"))
                words, first = word_hashes(data, offs, hasher)
                bare, _ = word_hashes(data, offs, hasher, marks=False)
                found = search(index, words, bare, first, retrieve, overlap)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([t for t, _ in found], pa.int64())),
                        pa.array([index.item_ids[k] for _, k in found], pa.int64()),
                        *(pa.array([v[j] for v in found.values()], pa.float64()) for j in range(3)),
                    ],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        out = out.union(rows.mapInArrow(run, FOUND))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, retrieve: float = 0.5, overlap: float = 0.8, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents that hold no test item, columns unchanged; judged where they are read, without a shuffle."""
    for shared in indexes(items, retrieve, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher, index = RollingHash(WORD_HASH, fold_case=True), shared.value
            for batch in slices(batches, "text"):
                data, offs = text_bytes(batch.column("text"))
                words, first = word_hashes(data, offs, hasher)
                bare, _ = word_hashes(data, offs, hasher, marks=False)
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, _ in search(index, words, bare, first, retrieve, overlap)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
