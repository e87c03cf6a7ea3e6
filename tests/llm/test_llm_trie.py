"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from strataflow.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    key = lambda x: hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], key(x)))] for c, v in convs.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            n = nodes.setdefault(tuple(path[:d]), {"m": [], "e": []})
            n["m"].append(c)
            if d == len(path):
                n["e"].append(c)
    out = []
    for p, n in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(q) == len(b) + 1 and q[: len(b)] == b for q in below) for b in below)
        saved = sum((len(nodes[b]["m"]) - 1) * len(b[-1][1].encode()) for b in below if b)
        ends = hashlib.sha256(",".join(map(str, sorted(n["e"]))).encode()).hexdigest()
        out.append((min(n["m"]), len(p), min(nodes[p[:-1]]["m"]) if p else None, len(n["m"]), len(children), leaves, saved, ends))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "'x' AS path", "2 AS base")
    return sorted((tuple(r) for r in trie.prefixes(d, **options).collect()), key=repr)


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, 9)):
            rows.append((c - 20, t, r.choice(("user", "bot", None)), r.choice(("hi", "é", "", None, "a longer turn"))))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [200_000, 30, 4])
def test_matches_plain_prefixes(spark, limit):
    rows = conversations(limit, 90)
    assert got(spark, rows, limit=limit) == plain(rows)


@pytest.mark.parametrize("limit", [200_000, 6])
def test_many_copies_of_one_conversation(spark, monkeypatch, limit):
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(3)] + conversations(5, 20)
    rows = [r for i, r in enumerate(rows) if not (r[0] is not None and r[0] < 0)] + [(c, 0, "user", "turn 0") for c in range(300, 340)]
    assert got(spark, rows, limit=limit) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, None, "a", "b"), (5, 2, "user", "y"), (6, 0, "user", "only"), (6, 0, "user", "only")]
    rows += [(7, 10**12, "user", "z" * 100_000), (8, -1, "", ""), (12, 1, "user", "k")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


def test_long_conversations(spark):
    rows = [(c, t, "user", str(t % 7)) for c, n in ((0, 300), (1, 290), (2, 300)) for t in range(n)]
    assert got(spark, rows, limit=100) == got(spark, rows) == plain(rows)
