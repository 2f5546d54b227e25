"""Pruned search against scoring every passage with every item; planted copies; awkward rows."""

import math
import random
import re
from collections import Counter

import pytest

from fieldmark.llm import decontaminate as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def grams(ws, n):
    n = min(n, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


def brute(docs, items, retrieve=0.5, overlap=0.8):
    items = [(i, t, words(t)) for i, t in items if t and len(words(t)) >= 5]
    df = Counter(w for _, _, ws in items for w in set(ws))
    mean = sum(len(ws) for _, _, ws in items) / len(items)
    longest = max(len(ws) for _, _, ws in items)
    out = set()
    for i, text, ws in items:
        weight = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, n in Counter(ws).items()}
        q, a = (words(x) for x in D.question_and_answer(text))
        for d, t in docs:
            tw = words(t)
            for s, e in D.windows(len(tw), longest):
                p = tw[s:e]
                if sum(w for x, w in weight.items() if x in set(p)) / sum(weight.values()) < retrieve:
                    continue
                gq, ga = grams(q, 5), grams(a, 5)
                hq, ha = len(gq & grams(p, min(5, max(1, len(q))))), len(ga & grams(p, min(5, max(1, len(a)))))
                share = len(set(a) & set(p)) / len(set(a)) if a else 1
                if hq and hq + ha >= overlap * (len(gq) + len(ga)) and share >= 0.5:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("shard_bytes", [D.SHARD_BYTES, 700])
def test_equals_brute_force(spark, shard_bytes):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.choice([1, 1, 2, 3, 4])))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(rng.randint(4, 30)) + rng.choice(["", ". " + line(rng.randint(1, 7))])) for i in range(40)]
    items += [(77, items[3][1]), (78, None), (79, "")]
    docs = [(0, None), (1, ""), (2, "a"), (None, items[5][1])]
    for d in range(3, 160):
        parts = [line(rng.randint(0, 90))]
        if rng.random() < 0.7:
            leak = words(rng.choice(items[:40])[1])
            for _ in range(rng.choice([0, 0, 1, 3])):
                leak[rng.randrange(len(leak))] = word()
            parts += [" ".join(leak[rng.choice([0, 0, 3]) :]).upper(), line(rng.randint(0, 90))]
        docs.append((d, rng.choice([" ", "\n"]).join(parts)))
    docs.append(docs[10])
    table = spark.createDataFrame([(*r, 1.0, "x") for r in docs], "doc_id long, text string, score double, item_id string")
    tests = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n int")
    found = D.leaks(table, tests, shard_bytes=shard_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(docs, items)
    bad = {d for d, _ in brute(docs, items)}
    kept = D.without_leaks(table, tests, shard_bytes=shard_bytes)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - bad


def test_test_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    tests = [tuple(r) for r in items.select("item_id", "text").collect()]
    assert got == brute(rows, tests)
    assert {(d, i) for d, t in rows for i, x in tests if x in t} <= got


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
    assert D.leaks(docs, items).count() == 1 and D.without_leaks(docs, items.limit(0)).count() == 1


def test_copies_without_or_with_another_last_word(spark):
    item = " ".join(f"word{i}" for i in range(38)) + ". Er."
    body = item.removesuffix(" Er.")
    copies = [item, body, body + " Er", body + ' Er."', body + " (Er.)", body + " «Er»"]
    docs = spark.createDataFrame([(i, "before it " + t) for i, t in enumerate(copies)] + [(9, "word0 word1 Er.")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "other words of a second item stand here. Yes.")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()} == {(i, 1) for i in range(len(copies))}
    assert [r.doc_id for r in D.without_leaks(docs, items).collect()] == [9]


def test_outer_punctuation():
    data, offs = D.text_bytes(D.pa.array(["(Er.) «er» ... a-b", "", "“ER”"]))
    words, first = D.word_hashes(data, offs, D.RollingHash(1, fold_case=True), marks=False)
    assert words[0] == words[1] == words[4] and len(set(words.tolist())) == 3 and first.tolist() == [0, 4, 4, 5]
