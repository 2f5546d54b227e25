"""Spans of the known shapes against Python's own search; random strings found, words left alone."""

import hashlib
import random
import re
from collections import Counter

import pytest

from fieldmark.llm import secret_scan as S

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 8, "access": 16, "hex": 32}


def base(text):
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if len(m.group(2 if kind == "assign" else 0)) >= LEAST[kind]:
                out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def check(rows, got):
    want = Counter()
    for d, t in rows:
        spans = base(t)
        kinds = Counter(s.split(":")[0] for s in spans)
        want[(d, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for r in got:
        spans = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert hashlib.sha256(",".join(spans).encode()).hexdigest() == r.base_sha256


def test_awkward_texts(spark):
    rng = random.Random(2)
    bits = ["password", "Token", " = ", ":", '"', "'", "x", "abcdef0123456789", "AKIA", "ABCDEFGHIJKL", "é😀", "\n", "secret=", "a1" * 9, "api_key", "APIKEY: ", "=", " ", "0" * 31, "."]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(400, None), (401, ""), (None, "token=abcdefgh"), (5, "token=abcdefgh"), (5, "token=abcdefgh"), (402, "token: secret: abcdefghij"), (403, "f" * 100_000), (404, "AKIA" * 5)]
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, rid int, base string")
    check(rows, S.report(docs).collect())
    assert S.report(docs.limit(0)).count() == 0


def test_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, S.report(docs).collect())


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    syllables = ["th", "er", "on", "an", "re", "tion", "ing", "ed", "es", "at", "is", "st"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    letters = S.UPPER + S.LOWER + S.DIGITS + "+/"
    rows, want = [], {}
    for i in range(400):
        text = " ".join(word(rng.randint(1, 14)) for _ in range(60)).capitalize()
        if i % 8 == 0:
            key = "".join(rng.choice(letters) for _ in range(60))
            want[i] = f"random:{len(text) + 1}:{len(text) + 61}"
            text += " " + key + " " + word(3)
        rows.append((i, text))
    return rows, want


def test_random_strings_are_found_and_words_left(spark, planted):
    rows, want = planted
    got = {r.doc_id: r.spans for r in S.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == s for i, s in want.items()) >= 0.9 * len(want)
    assert sum(bool(s) for i, s in got.items() if i not in want) <= 3


@pytest.mark.parametrize("size", [24, 60])
def test_many_secrets_do_not_hide_each_other(spark, size):
    rng = random.Random(8)
    syllables = ["th", "er", "on", "an", "re", "tion", "ing", "ed", "es", "at", "is", "st"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    letters = S.UPPER + S.LOWER + S.DIGITS + "+/"
    keys = [(i, "".join(rng.choice(letters) for _ in range(size))) for i in range(2000)]
    prose = [(2000 + i, " ".join(word(rng.randint(1, 6)) for _ in range(20)) + " " + word(14)) for i in range(500)]
    got = {r.doc_id: r.spans for r in S.report(spark.createDataFrame(keys + prose, "doc_id long, text string")).collect()}
    assert sum(got[i] == f"random:0:{size}" for i, _ in keys) >= 0.9 * len(keys)
    assert sum(bool(got[i]) for i, _ in prose) <= 5
