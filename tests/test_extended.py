"""Near duplicates, streamed documents, late and stateful streams, sketches, stores, as-of alignment, schemas, smoothing."""

from __future__ import annotations

import gzip
import io
import json
import math
import random
import resource

import pytest
from pyspark.sql import functions as F

from tessera.functions import pyudfs, text
from tessera.operators import asof, joins, metrics, near_duplicates, selection, shape, sketches, verdicts
from tessera.plans import pipelines
from tessera.sources import batches, documents, results
from tessera.streaming import late, running

SMALL = "/root/testdata/sf0.001"


# near duplicates


def shingles(text, size=5):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_links(rows, least):
    sets = [(i, shingles(t)) for i, t in rows]
    return {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and len(x & y) >= least * len(x | y)}


def classes(rows, links):
    top = {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {i: root(i) for i in top}


def test_banding_keeps_pairs_at_the_threshold():
    for t in (0.3, 0.5, 0.8, 0.95):
        bands, rows = near_duplicates.banding(t)
        assert bands * rows <= near_duplicates.HASHES
        assert 1 - (1 - t**rows) ** bands >= near_duplicates.SURE


def test_recall_on_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = jaccard_links(rows, 0.5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kinds, sets, index = near_duplicates.indexed(docs, "doc_id", "text", 5, 0.5)
    candidates = index.join(index.select("bucket", F.col("id").alias("b")), "bucket").where("id < b").select("id", "b").distinct()
    names = {r.id: r.kind for r in kinds.collect()}
    found = {frozenset(r) for r in candidates.collect()}
    met = [names[a] == names[b] or frozenset((names[a], names[b])) in found for a, b in want]
    assert want and sum(met) >= 0.9 * len(want)
    _, links = near_duplicates.linked(index, sets, 0.5)
    known = {k: shingles(t) for (i, t) in rows for k in [names[i]] if k}
    for r in links.collect():  # every link is what its shingles say
        assert (r.shared, r.total) == (len(known[r.a] & known[r.b]), len(known[r.a] | known[r.b])) and r.shared >= 0.5 * r.total


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_large_groups_of_near_copies(spark, rounds, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CHUNK", 5)
    monkeypatch.setattr(near_duplicates, "COPIES", 7)
    rng = random.Random(rounds)
    bases = [[f"w{rng.randint(0, 999)}" for _ in range(80)] for _ in range(3)]
    rows = []
    for i in range(120):
        words = list(bases[i % 3])
        words[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kinds, sets, index = near_duplicates.indexed(docs, "doc_id", "text", 5, 0.8)
    found, links = near_duplicates.linked(index, sets, 0.8, rounds)
    names = {r.kind: r.id for r in kinds.collect()}
    got = {}
    for r in found.collect():
        got.setdefault(r["class"], set()).add(names[r.id])
    want = {}
    for i, c in classes(rows, jaccard_links(rows, 0.8)).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    if rounds == 4:
        assert links.count() < 3 * len(rows)  # not all pairs


@pytest.mark.parametrize("few", [1000, 0])
def test_sets_of_candidates_alone_are_shuffled(spark, monkeypatch, few):
    monkeypatch.setattr(near_duplicates, "FEW", few, raising=False)
    sets = spark.createDataFrame([(f"k{i}", list(range(i, i + 20))) for i in range(50)], "id string, set array<long>")
    pairs = spark.createDataFrame([("k0", "k1", 1), ("k0", "k30", 1)], "a string, b string, m long")
    found = near_duplicates.verified(pairs, sets, 0.8)
    assert [tuple(r) for r in found.collect()] == [("k0", "k1", 19, 21)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("LeftSemi, BuildRight" in plan) == (few > 0)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_pairs_that_cannot_reach_the_threshold_are_not_verified(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_duplicates, "CHUNK", chunk)
    rng, seen, verified = random.Random(5), [], near_duplicates.verified
    line = [rng.getrandbits(62) for _ in range(30)]
    sets = {i: set(line) | {rng.getrandbits(62) for _ in range(rng.choice([20, 60, 300]))} for i in range(60)}
    for i in range(60, 75):  # some at the threshold, one over it, one below
        base = sorted(sets[i - 60])
        shared = len(base) * 2 // 3 + i % 3 - 1
        sets[i] = set(base[:shared]) | {rng.getrandbits(62) for _ in range(len(base) - shared)}
    sets[75], sets[76] = {1}, {1 + 2048}  # the same bit, nothing shared
    names = {f"k{i:02}": x for i, x in sets.items()}
    given = spark.createDataFrame([(k, list(x)) for k, x in names.items()] * 2, "id string, set array<long>")  # each of them twice
    index = spark.createDataFrame([(b, k) for k in names for b in (1, 2)], "bucket long, id string")
    monkeypatch.setattr(near_duplicates, "verified", lambda pairs, *more: (seen.append(pairs.count()), verified(pairs, *more))[1])
    _, links = near_duplicates.linked(index, given, 0.5, 0)
    got = sorted((min(r.a, r.b), max(r.a, r.b), r.shared, r.total) for r in links.collect())
    want = [(a, b, len(x & y), len(x | y)) for a, x in names.items() for b, y in names.items() if a < b and len(x & y) >= 0.5 * len(x | y)]
    assert got == sorted(want) and len(want) >= 5
    assert seen[-1] < len(names) * (len(names) - 1) / 2 / 3


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text.upper()), (2, "other words " + text), (3, None), (4, ""), (5, "a b"), (6, "A  b"), (None, text), (7, "x" * 100_000), (8, " ".join(f"v{i % 777}" for i in range(20_000))), (9, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as kind", "3 as bucket", "4 as set")
    got = sorted(tuple(r) for r in near_duplicates.near_duplicates(docs, threshold=0.8).collect())
    assert got == [(1, 46, 1), (2, 46, 1), (2, 48, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 1, 7), (8, 777, 8), (9, 46, 1)]
    assert near_duplicates.near_duplicates(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 901 + i) for i in range(50)] + [(7, 7)]
    want = {i: c for i, c in classes([(i, "") for e in edges for i in e], edges).items()}
    got = {r.id: r.component for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(want[i] == c for i, c in got.items()) and {i for e in edges for i in e if e[0] != e[1]} == set(got)
    assert near_duplicates.components(spark.createDataFrame([], "a long, b long")).collect() == []


# documents, item by item


def item(i, n=2):
    return {"unique_name": f"u{i}", "prompt": 'a "{[,', "results": [{"code": f"c{k}", "passing": k == 0, "num_tokens": k, "orm_score": 0.5, "extra": {"x": []}} for k in range(n)]}


def pieces(text, size=7):
    class Slow(io.StringIO):
        def read(self, n=-1):
            return super().read(min(n, size) if n > 0 else n)

    return documents.Text(Slow(text))


def test_parser_at_every_cut():
    docs = [{"model": "m", "items": [item(1), item(2)], "n": 12345}, {}, {"items": []}, {"a": [1, {"items": [3]}], "items": [item(3)]}, {"items": {"no": "list"}}]
    text = "\n ".join(map(json.dumps, docs))
    for size in (1, 2, 5, 64, 100_000):
        got, items = [], []
        for kind, value in documents.parsed(pieces(text, size)):
            if kind == "item":
                items.append(value)
            else:
                got.append(value | ({"items": items} if items else {}))
                items = []
        assert got == [{k: v for k, v in d.items() if v != []} for d in docs]


@pytest.mark.parametrize("text", ["", "  ", "[1]", '{"items": [{"unique_name": "x"}', '{"a" 1}', '{"items": [1 2]}', '{"a": tru}', "{", '{"items": [{}],}'])
def test_broken_files_have_an_error_row(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    (tmp_path / "good.json").write_text(json.dumps({"model": "m", "items": [item(1)]}))
    rows = documents.read_items_streamed(spark, str(tmp_path)).collect()
    assert [bool(r.error) for r in rows if r.file.endswith("/b.json")][-1]
    assert [(r.unique_name, r.error) for r in rows if r.file.endswith("/good.json")] == [("u1", None), (None, None)]


def test_large_document_in_bounded_memory(spark, tmp_path):
    path = tmp_path / "large.json.gz"
    with gzip.open(path, "wt", compresslevel=1) as f:
        f.write('{"model": "m", "items": [')
        for i in range(100_000):
            f.write((", " if i else "") + json.dumps(item(i, 3)))
        f.write("]}")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(documents.Documents({}).schema() and spark.createDataFrame([], documents.SCHEMA).schema)
    with gzip.open(path, "rt") as f:
        assert sum(b.num_rows for b in documents.rows_of(f, "x", schema)) == 100_001
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000  # kB; the text has some 40 MB
    rows = documents.read_items_streamed(spark, str(path))
    a = results.attempts_of(rows.where("unique_name is not null"))
    assert tuple(a.agg(F.count("*"), F.countDistinct("item"), F.sum("num_tokens")).first()) == (300_000, 100_000, 300_000)


def test_files_are_chosen_and_frames_used_again(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.json").write_text(json.dumps({"items": [item(name), "odd", {"prompt": 3, "results": [{"passing": 1, "num_tokens": 1 << 70}, 4]}]}))
    rows = documents.read_items_streamed(spark, str(tmp_path))
    assert (rows.where(F.col("file").endswith("a.json")).count(), rows.count()) == (4, 12)
    one = documents.read_items_streamed(spark, f"{tmp_path}/[ab].json", F.col("file").endswith("a.json"))
    assert [(r.row_idx, r.unique_name, r.prompt) for r in one.collect()] == [(0, "ua", 'a "{[,'), (1, None, None), (2, None, "3"), (None, None, None)]
    odd = one.where("row_idx = 2").first().results
    assert (odd[0].passing, odd[0].num_tokens, odd[1]) == (None, None, None)
    assert documents.read_items_streamed(spark, f"{tmp_path}/none*").count() == 0


# streams


def events_at(spark, rows):
    """(event_id, seconds, user_id, passing)"""
    return spark.createDataFrame(rows, "event_id long, s long, user_id long, passing int").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "passing", F.lit(1.0).alias("value"))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    folder = str(tmp_path / "in")
    parts = [[(1, 100_000, 1, 1), (2, 100_500, 1, 0), (2, 100_500, 1, 0)], [(3, 104_000, 1, 1)], [(4, 103_400, 2, 1), (5, 103_399, 2, 1), (6, 10, 2, 1), (7, 103_600, 2, None)]]
    gone = []
    for part in parts:
        events_at(spark, part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events_at(spark, part).schema).parquet(folder)
        gone.append(late.drain(late.closed_windows(stream, "1000 seconds", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "progress")))
    assert [g.late for g in gone] == [0, 0, 3]  # 103400 is the watermark itself
    assert [g.rows for g in gone] == [3, 1, 4] and gone[1].watermark == "1970-01-02T04:43:20.000Z"
    out = spark.read.parquet(str(tmp_path / "out")).select(F.unix_seconds("start").alias("s"), "n").collect()
    assert sorted(tuple(r) for r in out) == [(100_000, 2)]  # later windows are open still


def test_running_rates_go_on_after_a_restart(spark, tmp_path):
    folder, got = str(tmp_path / "in"), []
    first = spark.createDataFrame([(1, 10, 4), (9, 1, 1)], "user_id long, n long, c long")
    for k, part in enumerate([[(1, 0, 1, 1), (2, 1, 2, 0), (3, 2, 2, 1)], [(4, 3, 2, None), (5, 4, 1, 1)], [(6, 5, 9, 0)]]):
        events_at(spark, part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events_at(spark, part).schema).parquet(folder)
        run = running.pass_rates(stream, first=first).writeStream.outputMode("update").foreachBatch(lambda b, _: got.append(sorted(tuple(r) for r in b.collect())))
        run.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert [g for g in got if g] == [[(1, 11, 5, False), (2, 2, 1, False)], [(1, 12, 6, False), (2, 3, 1, False)], [(9, 2, 1, False)]]


def test_items_close_by_timer_and_begin_anew(spark, tmp_path):
    folder, got = str(tmp_path / "in"), []
    for part in [[(1, 1000, 1, 1), (2, 1050, 1, 0), (3, 1100, 2, 1)], [(4, 1145, 2, 0)], [(5, 2000, 3, 1)], [(6, 2001, 1, 1)]]:
        events_at(spark, part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events_at(spark, part).schema).parquet(folder)
        run = running.pass_rates(stream, gap_ms=60_000, late="1 seconds").writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect()))
        run.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    closed = [g[:3] for g in got if g[3]]
    assert sorted(closed) == [(1, 2, 1), (2, 2, 1)]
    assert (1, 1, 1, False) in got  # after it was closed


# batches and verdicts


def numbers(spark, k, n=4):
    return spark.range(n).select(F.lit(k).alias("k"), F.col("id").cast("int").alias("v"))


def test_a_run_cut_before_its_commit_leaves_nothing(spark, tmp_path):
    path, made = str(tmp_path / "b"), []
    assert batches.committed(spark, path, "k int, v int").count() == 0 and batches.next_batch(spark, path) == 0

    def make(k, broken=2):
        made.append(k)
        if k == broken:
            batches.write_batch(numbers(spark, 99), path, k)
            raise RuntimeError("cut off")
        return numbers(spark, k)

    with pytest.raises(RuntimeError):
        batches.resumed(spark, path, 4, make)
    assert sorted({r.batch for r in batches.committed(spark, path, "k int, v int").collect()}) == [0, 1]
    assert batches.resumed(spark, path, 4, lambda k: make(k, None)) == [2, 3]
    assert made == [0, 1, 2, 2, 3] and batches.resumed(spark, path, 4, make) == []
    rows = batches.committed(spark, path, "k int, v int").collect()
    assert sorted((r.k, r.v, r.batch) for r in rows) == [(k, v, k) for k in range(4) for v in range(4)]


def test_a_batch_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "b")
    folders = [batches.write_batch(numbers(spark, k), path, 0) for k in (1, 2)]
    batches.commit(spark, path, 0, folders[0])
    with pytest.raises(batches.Taken):
        batches.commit(spark, path, 0, folders[1])
    assert {r.k for r in batches.committed(spark, path, "k int, v int").collect()} == {1}
    batches.commit(spark, path, 2, folders[1])
    assert batches.next_batch(spark, path) == 1 and {(r.k, r.batch) for r in batches.committed(spark, path, "k int, v int").collect()} == {(1, 0), (2, 2)}


def test_verdicts_are_computed_once(spark, tmp_path):
    path, seen = str(tmp_path / "v"), []
    rows = [(1, "a", "t"), (2, "a", "t"), (3, "b", "t"), (4, "a", "u"), (5, None, None), (6, "", "")]
    attempts = spark.createDataFrame(rows, "item int, code string, tests string")

    def execute(new, breaks=False):
        asked = sorted((r.code or "", r.tests or "") for r in new.collect())
        if breaks and seen:
            raise RuntimeError("cut off")
        seen.extend(asked)
        return new.withColumns({"passing": F.coalesce("code", F.lit("")) == "a", "output": F.concat(F.coalesce("code", F.lit("")), F.lit("!"))})

    with pytest.raises(RuntimeError):
        verdicts.with_verdicts(attempts, path, lambda n: execute(n, True), parts=7)
    first = len(seen)
    assert 0 < first < 4
    out = verdicts.with_verdicts(attempts, path, execute, parts=3).collect()
    assert sorted(seen) == sorted({(c or "", t or "") for _, c, t in rows})  # nothing twice
    assert sorted((r["item"], r.passing, r.output) for r in out) == [(i, c == "a", f"{c or ''}!") for i, c, _ in rows]
    verdicts.with_verdicts(attempts, path, lambda n: 1 / 0)
    assert verdicts.with_verdicts(attempts.limit(0), path, lambda n: 1 / 0).count() == 0


# sketches


def test_sketches_by_file_and_their_unions(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "s")
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randint(0, 20_000) if rng.random() < 0.9 else None, rng.gauss(0, 1)) for _ in range(60_000)]
    spark.createDataFrame(rows[:40_000], "g string, k long, v double").repartition(3).write.parquet(folder)
    assert sketches.refresh(spark.read.parquet(folder), store, ["g"], "k", "v") == 3
    assert sketches.refresh(spark.read.parquet(folder), store, ["g"], "k", "v") == 0
    spark.createDataFrame(rows[40_000:], "g string, k long, v double").repartition(2).write.mode("append").parquet(folder)
    scan = spark.read.parquet(folder)
    assert sketches.refresh(scan, store, ["g"], "k", "v") == 2
    by_group = sketches.rolled_up(sketches.stored(scan, store, ["g"]), ["g"])
    whole = sketches.rolled_up(by_group, [])
    for frame, groups in ((by_group, "ab"), (whole, ["ab"])):
        for r, g in zip(sorted(frame.select("*", sketches.distinct().alias("d"), *[sketches.quantile(q).alias(f"q{q}") for q in (0.05, 0.5, 0.95)]).collect(), key=lambda r: r.asDict().get("g", "")), groups, strict=True):
            mine = [x for x in rows if x[0] in g]
            assert r.n == len(mine)
            exact = len({x[1] for x in mine} - {None})
            assert abs(r.d - exact) <= 0.05 * exact
            for q in (0.05, 0.5, 0.95):
                assert abs(sum(x[2] <= r[f"q{q}"] for x in mine) / len(mine) - q) <= 0.03
    assert sketches.rolled_up(sketches.stored(scan, str(tmp_path / "none"), ["g"]), ["g"]).count() == 0


# as of


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_as_of_against_a_scan(spark, partitions):
    rng = random.Random(partitions)
    log = [(rng.choice([0, 0, 0, 1, 2, None]), rng.choice([rng.randint(0, 300), None]), rng.choice([rng.random(), None])) for _ in range(250)] + [(5, 1, 0.5)]
    rows = [(k, rng.choice([0, 0, 1, 3, None]), rng.choice([rng.randint(-20, 320), rng.randint(-20, 320), None])) for k in range(300)] + [(900 + k, 5, 7) for k in range(200)] + [(1, 0, 50), (1, 0, 50)]
    low = lambda v: (v is not None, v or 0)
    want = []
    for k, s, t in rows:
        known = [(x[1], low(x[2]), x[2]) for x in log if s is not None and t is not None and x[0] == s and x[1] is not None and x[1] <= t]
        best = max(known, default=None, key=lambda x: x[:2])
        want.append((k, s, t, best and best[0], best and best[2]))
    out = asof.last_at_or_before(spark.createDataFrame(rows, "k int, s int, t int"), spark.createDataFrame(log, "s int, t int, v double"), "s", "t", ["v"], partitions)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], "s int, t int, v double")
    assert {(r.log_step, r.v) for r in asof.last_at_or_before(spark.createDataFrame(rows, "k int, s int, t int"), empty, "s", "t", ["v"]).collect()} == {(None, None)}


# shapes and lattices


def test_inventory_of_nested_and_mixed_json(spark):
    texts = ['{"a": 1, "b": [1, "x", null, {"c": [[true]]}]}', '{"a": "s", "b": {}, "a b": 1.5}', "[]", "3", "null", '"t"', "{", "", None, '{"a": 12345678901234567890}', '{"b": []}']
    want = {}

    def walk(v, path):
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) and abs(v) < 1 << 63 else "number"
        want[path, kind] = want.get((path, kind), 0) + 1
        for k, x in v.items() if isinstance(v, dict) else []:
            walk(x, f"{path}.{k}")
        for x in v if isinstance(v, list) else []:
            walk(x, f"{path}[*]")

    for t in texts:
        if t is not None:
            try:
                walk(json.loads(t), "$")
            except ValueError:
                want["$", "broken"] = want.get(("$", "broken"), 0) + 1
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    assert {(r.path, r.type): r.n for r in shape.json_inventory(rows, "x").collect()} == want
    assert shape.json_inventory(rows.limit(0), "x").collect() == []


@pytest.mark.parametrize(("w", "h", "sigma"), [(1, 1, 1.0), (3, 2, 1.0), (9, 5, 1.7)])
def test_smoothing_against_plain_sums(spark, w, h, sigma):
    rng = random.Random(w)
    grid = {(x, y): rng.random() for x in range(w) for y in range(h)}
    weights = shape.gaussian_weights(sigma)
    r = len(weights) // 2
    assert math.isclose(sum(weights), 1)

    def mirrored(i, n):
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i

    for axis, n in ((0, w), (1, h)):
        grid = {c: sum(wt * grid[(mirrored(c[0] + k - r, n), c[1]) if axis == 0 else (c[0], mirrored(c[1] + k - r, n))] for k, wt in enumerate(weights)) for c in grid}
    rng = random.Random(w)
    cells = spark.createDataFrame([(x, y, rng.random()) for x in range(w) for y in range(h)], "x int, y int, v double")
    got = {(c.x, c.y): c.v for c in shape.smoothed(cells, "x", "y", "v", w, h, sigma).collect()}
    assert all(math.isclose(got[c], v) for c, v in grid.items()) and len(got) == len(grid)
    assert shape.smoothed(cells.where("x > 0 or y > 0"), "x", "y", "v", w, h, sigma).where("v is null").count() > 0


# weak points of the core


def test_phrases_of_all_kinds_against_a_scan(spark):
    rng = random.Random(11)
    letters = ["ab", "b", "a b", " ", "  ", "\n", "cab", "x", "the", "", "é"]
    docs = [(i, rng.choice([None, "", *["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(8)]])) for i in range(60)]
    docs += docs[:5]
    for seed in range(4):
        rng = random.Random(seed)
        phrases = ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(6)] + [None]
        phrases = [p for p in phrases if p != ""] + ([""] if seed == 3 else [])
        frames = spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame([(p,) for p in phrases], "p string")
        want = sorted(i for i, t in docs if t is not None and any(p is not None and p in t for p in phrases))
        assert sorted(r.id for r in joins.contains_any(*frames, "t", "p").collect()) == want


def test_rare_words_key_phrases_without_cross_joins(spark):
    docs = spark.createDataFrame([(i, f"common words all around w{i} here") for i in range(50)], "id int, t string")
    found = joins.contains_any(docs, spark.createDataFrame([("words all around w7 here",), ("w9 h",)], "p string"), "t", "p")
    assert sorted(r.id for r in found.collect()) == [7, 9]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan


def test_first_row_of_each_key(spark):
    rows = [("a", 2, [1]), ("a", 1, [5]), ("b", None, [1]), ("b", 1, None), (None, 3, []), (None, 4, [1])]
    frame = spark.createDataFrame(rows, "k string, o int, v array<int>")
    out = selection.first_wins(frame, "k", "o")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([("a", 1, [5]), ("b", None, [1]), (None, 3, [])], key=repr)
    assert out.columns == frame.columns and "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_encoded_rows(spark):
    rows = [(1, "b a b c"), (2, None), (3, ""), (4, "a, a"), (5, "a a a a a a"), (4, "a, a")]
    prompts = spark.createDataFrame(rows, "i int, prompt string")
    vocabulary = pipelines.word_vocabulary(prompts, "prompt", 2)
    assert sorted((r.word, r.id) for r in vocabulary.collect()) == [(",", 2), ("a", 1)]  # of two at two the first by name
    words = spark.createDataFrame([("a", 1, 11), ("b", 2, 2)], "word string, id int, n long")
    got = {r.i: (r.input_ids, r.lengths) for r in pipelines.encoded_rows(prompts, words, ["i"], 5).collect()}
    assert got == {1: ([2, 1, 2, 0], 4), 2: ([], 0), 3: ([], 0), 4: ([1, 0, 1], 3)}


@pytest.mark.parametrize(("a", "b", "same"), [("1d", "1.0", False), ("1f", "1.0", False), ("1.00001", "1", True), ("1e0", "1.0", True), ("inf", "inf", True), ("1D", "1d", True)])
def test_letters_of_types_are_no_numbers(spark, a, b, same):
    assert spark.range(1).select(text.same_output(F.lit(a), F.lit(b)).alias("v")).first().v is same


def test_figures_are_null_where_a_verdict_or_score_lacks(spark):
    rows = [(i, k, (k % 2) if (i, k) != (2, 1) else None, k % 2, float(k) if (i, k) != (1, 2) else None) for i in range(3) for k in range(1, 5)]
    a = spark.createDataFrame(rows, "item int, idx int, passing int, passing_public int, score double")
    scored = a.withColumn("passing", F.coalesce("passing", F.lit(1)))
    assert metrics.pass_at_k_curve(scored, 2).where("pass_at_k is null").count() == 0
    assert metrics.reranked_curve(scored, 2).where("accuracy is not null").count() == 0  # a score lacks
    assert metrics.expected_grid(scored, [1, 2], [2, 3]).where("accuracy is not null").count() == 0
    assert metrics.public_accuracy(a, 4).first().accuracy is None and metrics.public_accuracy(scored, 4).first().accuracy is not None


def test_pairs_of_lists_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(joins, "CHUNK", 3)
    rng = random.Random(9)
    rows = [(9, k, "same words") for k in range(4)] + [(0, k, f"a {rng.choice('bcd')} c {rng.choice('de')} e") for k in range(25)] + [(8, 100 * k, f"v {k % 3} w") for k in range(11)] + [(1, 0, "x"), (2, 0, None), (3, 0, "a b"), (3, 1, "a b"), (3, 2, None), (4, 5, ""), (4, 6, "q")]
    frame = spark.createDataFrame(rows, "item int, idx int, code string")
    blocks = joins.chunk_pairs(frame, "item", "idx", 3)
    assert blocks.groupBy("item", "__i", "__j").count().agg(F.max("count")).first()[0] < 25
    got = {r["item"]: r.bleu for r in joins.mean_pairwise(frame, "item", "idx", "code", pyudfs.bleu_sums_udf, "bleu").collect()}
    lists = {}
    for i, _, t in rows:
        lists.setdefault(i, []).append(t)
    for i, texts in lists.items():
        want = pyudfs.mean_pairwise_bleu(texts)
        assert got[i] is None if want is None else math.isclose(got[i], want)
    pairs = joins.pairs_within(frame, "item", "idx", "code").collect()
    assert sorted((r["item"], r.i, r.j) for r in pairs) == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1])
