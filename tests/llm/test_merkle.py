"""Merkle proofs against trees built and folded one leaf at a time."""

import hashlib
import random
import zlib

import pytest

from fieldmark.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string, tree string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    parts = []
    for value in (*row[:4], text):
        raw = None if value is None else str(value)
        parts.append("-" if raw is None else f"{len(raw.encode())}:{raw}")
    return sha(parts)


def climb(digests):
    """Root of a list of digests, and for each of them the (left, right) siblings of every level."""
    if len(digests) == 1:
        return digests[0], [[]]
    runs = [digests[i : i + 3] for i in range(0, len(digests), 3)]
    root, above = climb([sha(run) for run in runs])
    paths = []
    for i in range(len(digests)):
        run, j = runs[i // 3], i % 3
        paths.append([(run[:j], run[j + 1 :]), *above[i // 3]])
    return root, paths


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[4]), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda x: x[:3])
        trees[name] = climb([x[2] for x in sources[name]])
    if not names:
        return []
    root, over = climb([trees[name][0] for name in names])
    out = []
    for name, more in zip(names, over):
        for (_, _, leaf, row), path in zip(sources[name], trees[name][1]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            at = leaf_of(row, row[4].replace("\n", "")) if tampered else leaf
            whole = path + more
            for left, right in whole:
                at = sha([*left, at, *right])
            proof = sha([x for left, right in whole for x in (*left, *right)])
            out.append((row[0], leaf, trees[name][0], root, proof, at, at == root))
    return sorted(out, key=repr)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA)
    return sorted(map(tuple, manifest(frame).collect()), key=repr)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, None, None, None)],
        [(5, "a", "en", 3, "x\ny"), (6, "a", "en", 3, "x\ny"), (7, "a", "en", 3, "xy"), (8, "a", None, None, None)],
        [(1, None, None, None, None), (2, "", None, 1, "a\nb"), (2, "", None, 1, "a\nb"), (2, "", None, 1, "ab"), (None, "z", "l", 3, "q\n"), (7, "é", "x", -5, ""), (8, "Z", "-", 0, "-\n" * 200_000)],
    ],
)
def test_small_and_awkward_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_many_leaves_and_a_hot_source(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice([None, "a", "b", "ß", "c" * 40]), "en", i, f"text {i}\n" * rng.randint(0, 3)) for i in range(700)]
    rng.shuffle(rows)
    found = run(spark, rows)
    assert found == brute(rows)
    assert {row[6] for row in found} == {True, False}


def test_one_leaf_for_each_of_many_sources(spark):
    rows = [(i, f"s{i % 61}", None, None, "\n") for i in range(61)]
    assert run(spark, rows) == brute(rows)
