"""The trie held against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(whole):
        turns = tuple(whole[c])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        words = len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    out = []
    for node, cs in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(kids[node]), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.shared_prefixes(spark.createDataFrame(rows, TURNS)).collect()), key=repr)


def conversations(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(300), n):
        for turn in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b c", "", None, "x\ty"])))
    one = [(0, "user", "hello there"), (1, "assistant", "hi"), (2, "user", "what is it"), (3, "assistant", "so it is"), (4, "user", "thanks")]
    return rows + [(c, *turn) for c in (301, *range(321, 420, 2)) for turn in one]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "FEW", 20 if seed == 1 else 1000)
    rows = conversations(seed)
    assert got(spark, rows) == brute(rows)


def test_long_and_odd_conversations(spark):
    deep = [(c, t, "user", f"turn {t}" if t < 12 or c != 41 else "else") for c in (40, 41, 42) for t in range(14)]
    heavy = [(7, t, "user", "w " * (t % 5)) for t in range(3000)] + [(27, t, "user", "w " * (t % 5)) for t in range(3000)]
    odd = [(None, 1, "user", "none"), (9, 1, None, None), (9, 1, None, None), (10, None, "user", "x" * 100_000), (25, 1, "user", "short")]
    assert got(spark, deep + heavy + odd) == brute(deep + heavy + odd)
    extra = spark.createDataFrame(deep, TURNS).selectExpr("*", "1 as pos", "2 as words", "3 as rep", "4 as n")
    assert sorted((tuple(r) for r in prefix_trie.shared_prefixes(extra).collect()), key=repr) == brute(deep)
    assert got(spark, []) == []
