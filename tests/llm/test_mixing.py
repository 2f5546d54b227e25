"""Targets against repeated resharing, permutations as bijections, taken words against the slots."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldmark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level(sizes, weights, total):
    """Share by weight; what is over twice the size is shared again among the others."""
    target, full = {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        target = {s: 2.0 * sizes[s] for s in full} | {s: left * weights[s] / sum(weights[t] for t in open_) for s in open_}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, source string, lang string, size int")


def random_rows(seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**6), " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 30, 200, 900]))), rng.choice(["a", "b", "b", "b", "é", "Z", None])) for _ in range(n)]
    return rows + [(1, None, "empty"), (2, "", "empty"), (None, "x y z", "a"), (None, None, None), (7, "p q", "a"), (7, "p q", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = random_rows(seed)
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted([s for s in size if s is not None], key=lambda s: s.encode()) + [None]
    weights = {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}
    target = level(size, weights, 1.5 * sum(size.values()))
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
    by = Counter()
    for r in got:
        by[(r.source_size, round(r.target, 3))] += r.taken
    want = Counter()
    for s in size:
        want[(size[s], round(target[s], 3))] += target[s]
    assert set(by) == set(want)
    for k in by:
        assert abs(by[k] - want[k]) <= max(130, 0.02 * want[k])
    assert sorted(got, key=repr) == sorted(mixing.mix(frame(spark, rows).repartition(7)).collect(), key=repr)


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 63, 1000):
        df = spark.range(n).select("id", F.lit(n).cast("long").alias("n")).withColumn("keys", F.expr(mixing.round_keys("(3L + n)", "n")))
        got = [r[0] for r in df.select(F.expr(mixing.permuted("id", "keys", "n"))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or got != sorted(got)


def test_slots_are_dealt_to_shards(spark):
    docs = frame(spark, random_rows(5, 3000))
    targets = mixing.source_targets(mixing.document_sizes(docs)).cache()
    plan = mixing.slot_plan(targets)
    rows = plan.collect()
    places = sorted(r.shard * mixing.SHARD_SLOTS + r.slot for r in rows)
    assert places == list(range(len(rows)))
    used = Counter((r.source_no, r.block) for r in rows)
    assert max(used.values()) <= 2
    share = {t.source_no: t.slots / t.all_slots for t in targets.collect()}
    first = Counter(r.source_no for r in rows if r.shard == 0)
    for s, p in share.items():
        assert abs(first[s] - 1024 * p) < 6 * (1024 * p) ** 0.5 + 1


def test_mixed_documents_hold_the_taken_words(spark):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(random_rows(8))]
    docs = frame(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        words = WORD.findall(r.text)
        got[r.doc_id] += len(words)
        assert r.lang == "a" and r.size == 1 and not Counter(words) - Counter(WORD.findall(rows[r.doc_id][1]))
    assert {d: n for d, n in taken.items() if n} == dict(got)


def test_empty_table(spark):
    empty = frame(spark, [(1, "a", "b")]).limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
