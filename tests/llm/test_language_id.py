"""Forward sums against an enumeration of all segmentations; held-out accuracy; awkward rows."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fieldmark.llm import language_id as L

SF = "/root/testdata/sf0.01"


def enumerate_sum(part, table):
    """Sum over all segmentations of the product of piece probabilities."""
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(part) - 1):
        at, product = 0, 1.0
        for i in [i + 1 for i, c in enumerate(cuts) if c] + [len(part)]:
            product *= table.get(part[at:i], 0.0)
            at = i
        total += product
    return total


def test_forward_equals_enumeration():
    rng = random.Random(1)
    pieces = sorted({bytes(rng.choice(b"abc\0") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {b"a", b"b", b"c", b"a\0", b"b\0", b"c\0"})
    p = np.array([[rng.random(), rng.random()] for _ in pieces])
    parts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) + b"\0" for _ in range(30)]
    trie = L.Pieces.build(pieces)
    lattice = trie.lattice(parts)
    alpha = L.forward(lattice, p)
    last = lattice.base + np.arange(len(parts)) + lattice.length
    for place, i in enumerate(lattice.order):
        for j in range(2):
            want = enumerate_sum(parts[i], {q: p[k, j] for k, q in enumerate(pieces)})
            assert math.isclose(alpha[last[place], j], want, rel_tol=1e-9)


def test_expected_counts_equal_enumeration():
    pieces = [b"a", b"ab", b"b", b"b\0", b"ab\0", b"a\0"]
    p = np.array([[0.2], [0.1], [0.3], [0.1], [0.2], [0.1]])
    trie = L.Pieces.build(sorted(pieces))
    order = [sorted(pieces).index(q) for q in pieces]
    ps = np.zeros_like(p)
    ps[order] = p
    got = L.expected_counts(trie.lattice([b"aab\0"]), ps, np.array([[3.0]]))
    ways = {(b"a", b"a", b"b\0"): 0.2 * 0.2 * 0.1, (b"a", b"ab\0"): 0.2 * 0.2}
    z = sum(ways.values())
    want = {q: sum(3 * w / z * seg.count(q) for seg, w in ways.items()) for q in pieces}
    for q in pieces:
        assert math.isclose(got[sorted(pieces).index(q), 0], want[q], abs_tol=1e-12)


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.select("doc_id", "lang").join(L.identify(docs), "doc_id").collect()


def test_held_out_accuracy(predicted):
    held = [r for r in predicted if r.held_out]
    assert len(predicted) == 1000 and 120 < len(held) < 280
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in predicted)


def test_awkward_rows(spark):
    rows = [(i, w, lang, 1) for i, (w, lang) in enumerate([("the house of the", "en"), ("das haus und der", "de")] * 20)]
    rows += [(100, None, "en", 2), (101, "", None, 2), (102, " 12 !! \n", "de", 2), (103, "x" * 300_000, None, 2), (None, "der und", None, 2), (104, "the of", None, 2), (104, "the of", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(docs).collect()]
    assert len(got) == len(rows)
    by = dict((d, (p, s)) for d, p, s in got)
    assert by[100] == by[101] == by[102] == ("und", 0.0)
    assert by[None][0] == "de" and by[104][0] == "en" and by[103][0] in ("de", "en")
    kept = L.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in L.identify(unlabelled).collect()] == [("und", 0.0)]
    assert L.identify(unlabelled.limit(0)).count() == 0


def sum_by_position(word, table):
    """Log of the sum over all segmentations, one position after another."""
    logs = [0.0]
    for e in range(1, len(word) + 1):
        found = [logs[s] + math.log(table[word[s:e]]) for s in range(max(0, e - 40), e) if word[s:e] in table and logs[s] > -math.inf]
        top = max(found, default=-math.inf)
        logs.append(top + math.log(sum(math.exp(x - top) for x in found)) if found else -math.inf)
    return logs[-1]


def test_long_words_are_summed_whole():
    model = L.fit({"xx": {"abcab": 3, "bca": 2}, "yy": {"cab": 5, "é": 1}}, None, rounds=2)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcé") for _ in range(n)) for n in (10, 30, 31, 32, 40, 63, 64, 65, 127, 128, 200, 700)] + ["é" * 200]
    likely, n = model.log_likelihoods(pa.array([*words, " ".join(words), None]))
    assert n.tolist() == [1] * len(words) + [len(words), 0]
    every = L.vocabulary_pieces()
    kept = [q for q in every if model.pieces.lattice([q]).pieces[len(q) - 1:] and model.pieces.lattice([q]).pieces[len(q) - 1][0] >= 0]
    assert len(kept) == len(model.p)
    for j in range(2):
        table = {q: model.p[i, j] / L.SCALE ** len(q) for i, q in enumerate(kept)}
        want = [sum_by_position(w.encode() + b"\0", table) for w in words]
        assert np.allclose(likely[: len(words), j], want, rtol=1e-9)
        assert math.isclose(likely[len(words), j], sum(want), rel_tol=1e-9)


def test_marks_alone_are_no_letters(spark):
    rows = [(1, "the house", "en"), (2, "der Hund", "de"), (3, "the dog", "en"), (4, "das Haus", "de")]
    rows += [(10, "\u0301\u0302 123", None), (11, "\u0301 a\u0302", None), (12, "12 \u0301", "en")]
    got = {r.doc_id: r.lang_pred for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[10] == got[12] == "und" and got[11] in ("de", "en")


def test_texts_with_letters_stay_without_labels(spark):
    left_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    for lang in (None, "en"):  # no label, or only one in the fold left out
        rows = [(left_out, "the house", lang), (500, "der Hund", None), (501, "12 !", None), (502, None, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert {r.doc_id for r in L.with_language(docs).collect()} == {left_out, 500}
