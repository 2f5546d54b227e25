"""Near duplicates against a brute-force comparison of all shingle sets."""

import itertools
import random
import re

import pytest
from pyspark.sql import types as T

from fieldmark.llm.odd_sketch import components, near_duplicates, one_of_each_group, whole_sketches, within

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent):
    sets = [(d, shingle_set(t, n)) for d, t in rows if d is not None]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            group[root(j)] = root(i)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[root(i)] = min(d, low.get(root(i), d))
    out = [(d, len(s), low[root(i)], d == low[root(i)]) for i, (d, s) in enumerate(sets)]
    out += [(None, len(shingle_set(t, n)), None, True) for d, t in rows if d is None]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n string, bands int") if rows and len(rows[0]) == 5 else spark.createDataFrame(rows, "doc_id long, text string")


def texts(rng, n):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(1, 60))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = word()
            out.append(rng.choice([" ", "\n", "\t "]).join(edited).upper() if rng.random() < 0.2 else " ".join(edited))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, n, percent):
    rng = random.Random(n)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts(rng, 60))]
    got = sorted((tuple(r) for r in near_duplicates(frame(spark, rows), n, percent).collect()), key=repr)
    assert got == brute(rows, n, percent)


def test_awkward_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (2, "one two"), (None, "one two"), (9, "one  TWO"), (9, "one  TWO"), (1, "x " * 40000), (3, "x " * 40001)]
    got = sorted((tuple(r) for r in near_duplicates(frame(spark, rows), 3, 85).collect()), key=repr)
    assert got == brute(rows, 3, 85)
    left = {r.doc_id for r in one_of_each_group(frame(spark, rows), 3, 85).collect()}
    assert left == {None, 1, 2, 5, 6, 7}


def test_repeated_rows_stay_once(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")]
    assert one_of_each_group(frame(spark, rows)).count() == 1


def test_clashing_columns_and_empty_table(spark):
    rows = [(1, "a b c d", "x", "y", 3), (2, "a b c d", "x", None, None)]
    got = near_duplicates(frame(spark, rows), 3, 85).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, True), (2, 2, 1, False)]
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert near_duplicates(empty).count() == 0 and one_of_each_group(empty).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(1000, 1001)], "u long, v long")
    got = dict(components(chain).collect())
    assert all(got[i] == 0 for i in range(41)) and got[1001] == 1000


def test_an_id_with_two_texts_keeps_the_unique_one(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta " * 3, "one two three four five six seven", "some quite other text with words of its own")
    rows = [(1, a), (5, b), (5, a), (7, c), (9, ""), (9, " "), (9, b + " eight"), (11, c), (11, "x y z"), (11, "x y z"), (None, a)]
    kept = sorted(map(tuple, one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert kept == sorted([(1, a), (5, b), (7, c), (9, ""), (9, " "), (9, b + " eight"), (11, "x y z"), (None, a)], key=repr)
    found = spark.createDataFrame([(3, a), (3, a + " more")], "doc_id long, text string")
    assert one_of_each_group(found).count() == 1


def test_whole_sketches_turn_no_link_away(spark):
    """Pairs on and around the bar, sets small and far larger than the sketch: the bitmap's bound holds for each link."""
    rng = random.Random(5)
    fresh = lambda k: [rng.getrandbits(64) - 2**63 for _ in range(k)]
    sets, pairs = [], []
    for k, size in enumerate([1, 2, 7, 20, 100, 300, 1000, 6000] * 6):
        both, apart = fresh(size), rng.choice([0, 0.05, 0.14, 0.16, 0.18, 0.3])
        extra = int(size * apart)
        cut = rng.randint(0, extra)
        sets += [(2 * k, sorted(both + fresh(cut))), (2 * k + 1, sorted(both + fresh(extra - cut)))]
        pairs.append((2 * k, 2 * k + 1))
    found = dict(sets)
    frame_of = spark.createDataFrame(sets, "nid long, found array<long>")
    known = whole_sketches(frame_of).join(frame_of.selectExpr("nid", "size(found) AS size"), "nid")
    u, v = (known.selectExpr(f"nid AS {x}", f"whole AS whole_{x}", f"size AS size_{x}") for x in "uv")
    joined = spark.createDataFrame(pairs, "u long, v long").join(u, "u").join(v, "v")
    for percent in (80, 85):
        kept = {r.u for r in joined.filter(within("u", "v", percent)).collect()}
        share = {a: len(set(found[a]) & set(found[b])) / len(set(found[a]) | set(found[b])) for a, b in pairs}
        assert {a for a, s in share.items() if 100 * s >= percent} <= kept
        # sets that fill a small part of the bitmap are told apart; large ones fill it and are left to the full sets
        clear = {a for a, s in share.items() if s < 0.78 and 100 <= len(found[a]) < 500}
        assert clear and not clear & kept


def test_a_torn_bucket_keeps_every_link(spark):
    """Copies of one text edited in many places: near one another by sketch, linked here and there, in several components."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for k in range(90):
        edited = list(base)
        for at in rng.sample(range(len(base)), rng.choice([1, 3, 5, 6, 7, 8])):
            edited[at] = f"x{rng.randrange(60)}"
        rows.append((k, " ".join(edited)))
    for n, percent in ((3, 85), (5, 80)):
        got = sorted((tuple(r) for r in near_duplicates(frame(spark, rows), n, percent).collect()), key=repr)
        assert got == brute(rows, n, percent)
