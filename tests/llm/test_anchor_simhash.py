"""SimHash fingerprints and their components against a plain count of bits and all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from fieldmark.llm.anchor_simhash import at_anchors, bit_fingerprint, near_duplicates, near_links
from fieldmark.llm.odd_sketch import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text, n=3):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, threshold):
    """{node: smallest node of its component} over all pairs."""
    group = {x: x for x in nodes}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= threshold:
            a, b = sorted((root(a), root(b)))
            group[b] = a
    return {x: root(x) for x in nodes}


def brute(rows, threshold=3):
    prints = [(d, plain(t)) for d, t in rows]
    group = groups({p for d, p in prints if d is not None}, threshold)
    low = {}
    for d, p in prints:
        if d is not None:
            low[group[p]] = min(d, low.get(group[p], d))
    return sorted(((d, f"{p:016x}", None if d is None else low[group[p]]) for d, p in prints), key=repr)


def run(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, home int")
    return sorted(map(tuple, near_duplicates(frame, **more).collect()), key=repr)


def texts(rng, count):
    out = []
    for _ in range(count):
        base = ["".join(rng.choice("abcdeéÉ") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 6)):
            edited = list(base)
            for _ in range(rng.randint(0, 2)):
                edited[rng.randrange(len(edited))] = rng.choice(["x", "Yz", "é"])
            out.append(rng.choice([" ", "\n", "\t "]).join(edited))
    return out


def test_documents_with_near_copies(spark):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 120)))
    rng.shuffle(rows)
    want = brute(rows)
    assert run(spark, rows) == want
    assert len({r[2] for r in want}) < len({r[1] for r in want})


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "ONE"), (None, "one"), (None, None), (6, "a b"), (6, "a b"), (6, "c d e f")],
        [(9, "w " * 300_000), (3, "W w " * 5), (2, "x" * 500_000), (-4, "w w w")],
    ],
)
def test_awkward_rows(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_a_text_in_pieces_has_the_fingerprint_of_the_whole():
    rng = random.Random(9)
    for text in [*texts(rng, 30), "a " * 50, " a\nb  c ", "x" * 300, ""]:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert {bit_fingerprint(raw, 3, size) for size in (1, 2, 7, 64, 1 << 20)} == {plain(text)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("threshold", [0, 1, 2, 3, 4, 5])
def test_links_at_and_beyond_the_threshold_in_every_place(spark, threshold):
    rng = random.Random(threshold)
    nodes = set()
    for _ in range(150):
        base = rng.getrandbits(64)
        nodes.add(base)
        for flips in (threshold, threshold, threshold + 1, 2 * threshold):
            nodes.add(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
    frame = spark.createDataFrame([(signed(x),) for x in nodes], "print long")
    links = near_links(frame, threshold).collect()
    assert all(1 <= ((u ^ v) & (2**64 - 1)).bit_count() <= threshold for u, v in links)
    found = dict(components(spark.createDataFrame(links, "u long, v long")).collect()) if links else {}
    want = groups(nodes, threshold)
    got = {}
    for x in nodes:
        got.setdefault(found.get(signed(x), signed(x)), set()).add(x)
    expected = {}
    for x, r in want.items():
        expected.setdefault(r, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_a_dense_group_is_dealt_in_parts_and_gives_stars(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    nodes = {base ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 4))) for _ in range(3000)}
    frame = spark.createDataFrame([(signed(x),) for x in nodes], "print long")
    at = at_anchors(frame, 3)
    assert at.groupBy("print").count().agg({"count": "max"}).first()[0] <= 2 * 17
    links = near_links(frame, 3, most=300).distinct()
    assert links.count() < 60 * len(nodes)  # all pairs within 3 bits would be hundreds a node
    found = dict(components(links).collect())
    assert {found.get(signed(x), signed(x)) for x in nodes} == {min(map(signed, nodes))}
