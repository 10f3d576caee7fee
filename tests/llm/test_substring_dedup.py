"""Substring removal held against a plain window index."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tessera.llm import queries, substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    """(id, words, removed, kept, spans) of each row, by a table of all windows."""
    least, split = {}, []
    for i, text in rows:
        w = WORD.findall((text or "").encode())
        split.append((i, w))
        if i is not None:
            for s in range(len(w) - size + 1):
                key = tuple(w[s : s + size])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - size + 1) if i is not None else ():
            if least[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        spans = [(p, next(q for q in range(p, len(w) + 1) if q not in gone)) for p in sorted(gone) if p - 1 not in gone]
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode(), tuple(spans)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def got(df):
    return ordered((r[0], r.n_words, r.n_removed, r.kept, tuple((s.first, s.stop) for s in r.spans)) for r in df.collect())


def passages(seed, n=120):
    rng = random.Random(seed)
    shared = [" ".join(rng.choices("abcdefgh", k=rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [" ".join(f"{rng.choice('stuvwxyz')}{rng.randint(0, 30)}" for _ in range(rng.randint(0, 25))) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(1, n), rng.choice([" ", "\n", " \t\x0b"]).join(parts)))
    return rows + [(i, shared[0] + " " + shared[0]) for i in range(200, 260)] + [(i, " ".join(["z"] * 40)) for i in range(300, 310)]


@pytest.mark.parametrize(("seed", "size", "limit"), [(1, 13, 1 << 18), (2, 13, 3), (3, 13, 1), (4, 5, 4), (5, 1, 2), (6, 40, 1 << 18)])
def test_windows_against_brute_force(spark, seed, size, limit):
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as batch", "2 as kept", "'x' as id")
    assert got(substring_dedup.dedup(docs, size=size, limit=limit, batch_bytes=400)) == ordered(brute(rows, size))


def test_odd_rows(spark):
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, same), (1, same), (2, same), (None, same), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, "é ß 中文 " + same), (7, same.replace("one ", "")), (8, same[:60]), (9, long), (10, "x " + long), (11, "y" * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring_dedup.dedup(docs)) == ordered(brute(rows))
    assert substring_dedup.dedup(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {r[0]: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute(rows)}
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op13_substring_dedup(spark, SF).collect()}
    assert found == want
    assert sum(x[1] for x in want.values()) > 0


def test_documents_are_dealt_once(spark):
    plan = queries.op13_substring_dedup(spark, SF)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ReusedExchange") >= 2
