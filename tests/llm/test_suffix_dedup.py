"""Removed bytes against a count of every window of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fieldmark.llm import suffix_dedup as S


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raw):
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows, length):
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, gid int, key string")
    got = S.repeated_substrings(docs, length).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.span_starts), r.kept_sha256) for r in got], key=repr)


@pytest.mark.parametrize("q", [2, 3, 5, 11])
def test_difference_cover(q):
    v, cover = S.difference_cover(q)
    assert len(cover) == q + 1
    assert {(a - b) % v for a in cover.tolist() for b in cover.tolist()} == set(range(v))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abé c") for _ in range(n))
    shared = [make(rng.randint(380, 1500)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [make(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 3)
            parts += [s[a : rng.randint(len(s) // 2, len(s))], make(rng.randint(0, 50))]
        rows.append((i, "".join(parts)))
    rows += [(100, "x" * 401), (101, "y" * 400), (102, "ab" * 900), (103, rows[0][1]), (104, None), (None, rows[3][1]), (105, ""), (5, rows[5][1]), (106, shared[0] * 3)]
    assert result(spark, rows, 400) == brute(rows, 400)


def test_empty_and_short(spark):
    assert result(spark, [(1, "a" * 399), (2, "a" * 399)], 400) == brute([(1, "a" * 399), (2, "a" * 399)], 400)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert S.repeated_substrings(docs.limit(0)).count() == 0
