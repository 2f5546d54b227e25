"""The conversation trie against one built from dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from fieldmark.llm.burst_trie import conversation_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, head int, pos string, len string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            node = nodes.setdefault(tuple(whole[:d]), {"in": [], "ends": []})
            node["in"].append(c)
        node["ends"].append(c)
    out = []
    for path, node in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(nodes[p]["in"]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        ends = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        parent = min(nodes[path[:-1]]["in"]) if path else None
        out.append((min(node["in"]), len(path), parent, len(node["in"]), len(children), len(leaves), saved, ends))
    return sorted(out, key=repr)


def run(spark, rows, most):
    frame = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA)
    return sorted(map(tuple, conversation_trie(frame, most).collect()), key=repr)


def shared(rng, count):
    """Conversations that share prefixes, end inside others, and repeat."""
    made, rows = [[]], []
    for conv in range(count):
        base = rng.choice(made)
        turns = base[: rng.randint(0, len(base))] + [(rng.choice("ua"), "w " * rng.randint(0, 3) + rng.choice("abc")) for _ in range(rng.randint(1, 4))]
        made.append(turns)
        rows += [(conv * rng.choice([1, 1, 7]) if conv else 0, k, role, text) for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [1, 12, 10_000])
def test_containers_of_any_size_give_the_same_nodes(spark, most):
    rows = shared(random.Random(4), 90)
    assert run(spark, rows, most) == brute(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, 1, "u", "lost")],
        [(7, None, None, None)],
        [(3, 1, "u", "a"), (3, 1, "u", "a"), (3, None, None, "b c"), (3, 1, "a", None), (4, 2, "", ""), (-45, 0, "u", "x"), (-40, 0, "u", "y\n z")],
        [(20 * k, j, "u", f"turn {j}") for k in range(40) for j in range(12)] + [(20 * k + 1, 0, "u", "w " * 100_000) for k in range(5)],
    ],
)
def test_awkward_tables(spark, rows):
    assert run(spark, rows, 30) == brute(rows)
