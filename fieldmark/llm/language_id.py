"""Language of a text: unigram piece models, summing over every segmentation of each word.

A language gives each piece of a fixed public vocabulary a probability. A word's probability is
the sum, over all ways to cut it into pieces, of the product of theirs; the forward algorithm
adds them up position by position, for all languages and all distinct words of a batch at once.
A text's score is the sum of its words' logarithms, and the languages' posterior at equal priors.

The probabilities are fitted by expectation-maximisation on word counts of a bounded sample of
the labelled rows (``sample_docs`` per language, chosen by a hash of the id, whole texts).
Everything else covers every row and every word.

Words are runs of letters and combining marks that hold a letter, after lower-casing. Words over
``CHUNK`` bytes are summed block by block: what a block makes of each of the sums before it is a
matrix, and the matrices are applied in turn and rescaled, so pieces across a block's edge count.
Only the fit, on its sample, takes such words in parts. Defined cases: null texts and texts without
letters are ``und`` with score 0, as is everything when no labelled row exists; rows without a label
are predicted but not learned from; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.bpe import vocabulary_path
from fieldmark.llm.common import documents, slices

UNDETERMINED = "und"
CHUNK, END = 32, 0  # bytes of a word summed at once at most; the byte that stands for a word's end
BLOCK, TOGETHER = 64, 128  # bytes of a block of a longer word; blocks in memory at a time
SCALE = 20.0  # per byte, so that products of small probabilities stay representable
NOT_LETTERS = r"[^\p{L}\p{M}]+"


def vocabulary_pieces(path: str | None = None) -> list[bytes]:
    """The byte strings of a byte-level vocabulary file; a piece that ends a word ends in ``END``."""
    with open(vocabulary_path(path), encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    out = []
    for piece in vocabulary:
        ends = piece.endswith("</w>")
        out.append(bytes(byte_of[c] for c in piece.removesuffix("</w>")) + bytes([END] * ends))
    return sorted(set(out))


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word in them, index of the first word of each text)."""
    texts = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    lists = pc.split_pattern_regex(texts, NOT_LETTERS)
    offs = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    runs = lists.flatten().dictionary_encode()
    lettered = pc.match_substring_regex(runs.dictionary, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    indices = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    some = lettered[indices]
    number = np.cumsum(lettered) - 1
    seen = np.concatenate([[0], np.cumsum(some)])
    return runs.dictionary.filter(pa.array(lettered)), number[indices[some]], seen[offs]


def parts_of(words: list[str]) -> tuple[list[bytes], np.ndarray]:
    """(byte strings to segment in a fit, index of the first part of each word)."""
    parts, first = [], [0]
    for word in words:
        raw = word.encode() + bytes([END])
        if len(raw) <= CHUNK:
            parts.append(raw)
        else:
            body = raw[:-1]
            cut = [body[i : i + CHUNK - 1] for i in range(0, len(body), CHUNK - 1)]
            cut[-1] += raw[-1:]
            parts += cut
        first.append(len(parts))
    return parts, np.array(first)


@dataclass
class Lattice:
    """All pieces that match inside a list of parts, longest part first."""

    order: np.ndarray  # part at each place
    base: np.ndarray  # its first position
    length: np.ndarray
    pieces: list[np.ndarray]  # pieces[k][position]: the piece of k + 1 bytes that begins there, or -1


@dataclass
class Pieces:
    """A trie over the pieces, as one table of next nodes."""

    symbol: np.ndarray
    child: np.ndarray
    piece: np.ndarray
    size: np.ndarray  # bytes of each piece

    @classmethod
    def build(cls, pieces: list[bytes]) -> Pieces:
        symbol = np.zeros(256, np.int32)  # 0: in no piece
        used = sorted({b for p in pieces for b in p})
        symbol[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}, {}]  # node 0 is the dead end, node 1 the root
        ends = [-1, -1]
        for number, p in enumerate(pieces):
            node = 1
            for b in p:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = number
        child = np.zeros((len(children), len(used) + 1), np.int32)
        for node, found in enumerate(children):
            for b, nxt in found.items():
                child[node, symbol[b]] = nxt
        return cls(symbol, child, np.array(ends, np.int32), np.array([len(p) for p in pieces], np.int64))

    def lattice(self, parts: list[bytes]) -> Lattice:
        length = np.array([len(p) for p in parts], np.int64)
        order = np.argsort(-length, kind="stable")
        length = length[order]
        stops = np.cumsum(length)
        base = stops - length
        data = self.symbol[np.frombuffer(b"".join([parts[i] for i in order]), np.uint8)]
        limit = np.repeat(stops, length)
        at = np.arange(len(data))
        node = np.ones(len(data), np.int32)
        pieces = []
        for k in range(int(self.size.max()) if len(self.size) else 0):
            inside = at + k < limit[at]
            at, node = at[inside], node[inside]
            node = self.child[node, data[at + k]]
            alive = node > 0
            at, node = at[alive], node[alive]
            found = np.full(len(data), -1, np.int32)
            found[at] = self.piece[node]
            pieces.append(found)
            if not len(at):
                break
        return Lattice(order, base, length, pieces)


def forward(lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """alpha[position, language]: scaled sum over segmentations of what lies before it; one more place a part."""
    n = len(lattice.base)
    at = lattice.base + np.arange(n)  # each part has a place more than bytes
    alpha = np.zeros((int(lattice.length.sum()) + n, p.shape[1]))
    alpha[at] = 1.0
    active = n
    for e in range(1, int(lattice.length[0]) + 1 if n else 1):
        while active and lattice.length[active - 1] < e:
            active -= 1
        for k in range(min(e, len(lattice.pieces))):
            found = lattice.pieces[k][lattice.base[:active] + e - 1 - k]
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                alpha[at[hit] + e] += alpha[at[hit] + e - 1 - k] * p[found[hit]]
    return alpha


def long_word_sums(lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Log of the scaled sum over all segmentations, [place, language], of words of any length.

    A block turns the sums at the positions before it, as many as the longest piece has bytes, into
    those at its end. This is linear, so blocks are worked out together, each from every such
    position alone; a word's blocks are then applied in order, and rescaled after each.
    """
    reach, languages = max(1, len(lattice.pieces)), p.shape[1]
    size = max(BLOCK, reach)
    blocks = -(-lattice.length // size)
    word = np.repeat(np.arange(len(blocks)), blocks)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = lattice.base[word] + nth * size
    length = np.minimum(size, lattice.length[word] - nth * size)
    out = np.zeros((len(blocks), languages))
    state = np.zeros((reach, languages))
    for at in range(0, len(word), TOGETHER):
        own = slice(at, at + TOGETHER)
        first, n = start[own], length[own]
        sums = np.zeros((len(first), reach + size, reach, languages))  # place reach - 1 + i: i bytes into the block
        sums[:, np.arange(reach), np.arange(reach)] = 1.0
        for e in range(1, size + 1):
            for k, piece in enumerate(lattice.pieces):
                begin = first + e - 1 - k
                found = np.where((e <= n) & (begin >= lattice.base[word[own]]), piece[np.clip(begin, 0, len(piece) - 1)], -1)
                hit = np.flatnonzero(found >= 0)
                if len(hit):
                    sums[hit, reach - 1 + e] += sums[hit, reach - 2 + e - k] * p[found[hit]][:, None]
        for i in range(len(first)):
            w = word[at + i]
            if nth[at + i] == 0:
                state = np.zeros((reach, languages))
                state[-1] = 1.0
            state = np.einsum("oij,ij->oj", sums[i, n[i] : n[i] + reach], state)
            most = np.maximum(state.max(axis=0), 1e-300)
            state /= most
            out[w] += np.log(most)
            if nth[at + i] == blocks[w] - 1:
                out[w] += np.log(np.maximum(state[-1], 1e-300))
    return out


def expected_counts(lattice: Lattice, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, by forward and backward sums; weight[part, language]: the parts' counts."""
    n, counts = len(lattice.base), np.zeros_like(p)
    if not n:
        return counts
    at = lattice.base + np.arange(n)
    alpha = forward(lattice, p)
    beta = np.zeros_like(alpha)
    beta[at + lattice.length] = weight[lattice.order] / np.maximum(alpha[at + lattice.length], 1e-300)
    for s in range(int(lattice.length[0]) - 1, -1, -1):
        active = int(np.searchsorted(-lattice.length, -s, side="left"))  # parts longer than s
        for k in range(len(lattice.pieces)):
            found = lattice.pieces[k][lattice.base[:active] + s]
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                onward = beta[at[hit] + s + k + 1] * p[found[hit]]
                beta[at[hit] + s] += onward
                for j in range(p.shape[1]):
                    counts[:, j] += np.bincount(found[hit], alpha[at[hit] + s, j] * onward[:, j], minlength=len(p))
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray  # scaled by SCALE to the piece's bytes

    def log_likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(summed log probability of each text in each language, number of words)."""
        distinct, words, first = words_of(column)
        raw = [word.encode() + bytes([END]) for word in distinct.to_pylist()]
        long = np.array([len(r) > CHUNK for r in raw], bool)
        each = np.zeros((len(raw), len(self.languages)))
        for chosen in (np.flatnonzero(~long), np.flatnonzero(long)):
            lattice = self.pieces.lattice([raw[i] for i in chosen])
            if len(chosen) and long[chosen[0]]:
                sums = long_word_sums(lattice, self.p)
            else:
                last = lattice.base + np.arange(len(chosen)) + lattice.length
                sums = np.log(np.maximum(forward(lattice, self.p)[last], 1e-300))
            each[chosen[lattice.order]] = sums - lattice.length[:, None] * np.log(SCALE)
        out = np.zeros((len(first) - 1, each.shape[1]))
        texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for j in range(each.shape[1]):
            out[:, j] = np.bincount(texts, each[words, j], minlength=len(out))
        return out, np.diff(first)


def fit(counts: dict[str, dict[str, int]], path: str | None = None, rounds: int = 4, alpha: float = 0.05) -> LanguageModel:
    """Piece probabilities from word counts per language; ``alpha`` is added to every expected count."""
    languages = sorted(counts)
    words = sorted({w for found in counts.values() for w in found})
    parts, first = parts_of(words)
    weight = np.zeros((len(parts), len(languages)))
    for j, language in enumerate(languages):
        own = np.array([counts[language].get(w, 0) for w in words], float)
        weight[:, j] = np.repeat(own, np.diff(first))
    # any text can be cut into single bytes, so they stay; other pieces stay if they occur
    every = vocabulary_pieces(path)
    singles = [p for p in every if len(p.rstrip(bytes([END]))) == 1]
    trie = Pieces.build(every)
    used = np.zeros(len(every), bool)
    for at in range(0, len(parts), 20_000):
        for found in trie.lattice(parts[at : at + 20_000]).pieces:
            used[found[found >= 0]] = True
    kept = sorted({every[i] for i in np.flatnonzero(used)} | set(singles))
    pieces = Pieces.build(kept)
    scale = SCALE ** pieces.size[:, None]
    p = np.full((len(kept), len(languages)), 1 / max(1, len(kept)))
    for _ in range(rounds):
        total = np.full_like(p, alpha)
        for at in range(0, len(parts), 20_000):
            total += expected_counts(pieces.lattice(parts[at : at + 20_000]), p * scale, weight[at : at + 20_000])
        p = total / total.sum(axis=0)
    return LanguageModel(languages, pieces, p * scale)


def fit_sample(rows: DataFrame, sample_docs: int = 400, path: str | None = None) -> LanguageModel | None:
    """Fit on about ``sample_docs`` documents of each language of ``rows(id, text, lang)``."""
    rows = rows.filter("lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000))
    # broadcast at every size: a row a language, fewer than the model's columns; texts are not dealt by language
    sample = rows.join(F.broadcast(sizes), "lang").filter(place * F.col("n") < F.lit(1_000_000 * sample_docs).cast("decimal(30,0)")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            distinct, words, first = words_of(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            of_word = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(first))
            keys, n = np.unique(of_word * max(1, len(distinct)) + words, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(keys // max(1, len(distinct)))),
                    distinct.take(pa.array(keys % max(1, len(distinct)))).cast(pa.string()),
                    pa.array(n.astype(np.int64)),
                ],
                names=["lang", "word", "n"],
            )

    found = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n"))):
        counts.setdefault(lang, {})[word] = n
    return fit(counts, path) if counts else None


def judged(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language of each text, undetermined without letters, and its posterior at equal priors."""
    likely, words = model.log_likelihoods(texts)
    best = likely.argmax(axis=1)
    share = 1 / np.exp(likely - likely.max(axis=1)[:, None]).sum(axis=1)
    return [model.languages[b] if w else UNDETERMINED for b, w in zip(best, words)], np.where(words > 0, share, 0.0)


def predict(docs: DataFrame, model: LanguageModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior of it at equal priors)."""
    rows = documents(docs, id_column, text_column).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in slices(batches, "text"):
            langs, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if found:
                langs, scores = judged(found, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
            )

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def remainder(column: str, modulus: int):
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def identify(docs: DataFrame, sample_docs: int = 400, path: str | None = None, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    rows = documents(docs, "doc_id", "text", "lang").toDF("id", "text", "lang")
    model = fit_sample(rows.filter(remainder("id", folds) != 0), sample_docs, path)
    found = predict(docs, model)
    return found.select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, sample_docs: int = 400, path: str | None = None) -> DataFrame:
    """The documents whose text has a language, columns unchanged; those undetermined are rejected. Without a labelled row, letters decide."""
    rows = documents(docs, "doc_id", "text", "lang").toDF("id", "text", "lang")
    model = fit_sample(rows.filter(remainder("id", 5) != 0), sample_docs, path)
    return reject(docs, model)


def reject(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Rows of ``docs`` that are given a language, or hold letters where no language was learned.

    Every batch is judged and filtered where it is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in slices(batches, "text"):
            if found:
                keep = np.array(judged(found, batch.column("text"))[0], object) != UNDETERMINED
            else:
                keep = np.diff(words_of(batch.column("text"))[2]) > 0
            yield batch.filter(pa.array(keep.astype(bool)))

    return docs.mapInArrow(run, docs.schema)
