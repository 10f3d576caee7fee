"""Removal of repeated substrings of words, by prefix-partitioned suffix trees.

Documents are dealt into batches of bounded size. Not every suffix is indexed: of each window of `size` words the
smallest hashed run of `size - REACH` words is its anchor, so equal windows have equal anchors at equal places, and the
trees hold the suffixes that start at anchors (about two of seven), with the few words before them.

1. Each batch counts its anchors' runs (prefixes) and sends them packed by hash. A prefix that occurs once in the corpus
   heads no repeat and is dropped; one that heads more than LIMIT suffixes is split by longer prefixes, the whole windows.
2. Each batch sends its distinct suffixes of the other prefixes, each with the smallest id that holds it, to the group
   of their prefix. A group sorts its suffixes to the right and the words before them to the left (suffix arrays with
   common prefix lengths: the two trees, cut at the window's depth). Internal nodes as deep as a window, crossed with as
   many words to the left as the window needs, are the repeats; their smallest id goes against each suffix's own.
3. Each batch gets a bit for each suffix and window, and merges what is repeated into maximal spans.

However often a passage occurs, a batch sends it once and hears of it once, so no key holds more rows than there are batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import buffers, mix, runs, word_hashes, words
from tessera.llm.session import ship, trim

REACH = 5  # words of a window beside its anchor's run, at most
LIMIT = 1 << 18  # suffixes under one short prefix
BATCH_BYTES = 8 << 20  # of text in a batch, on average
LEAST_BATCHES = 48
TRIM_BYTES = 1 << 20  # memory is given back after a group of this size
LOW_BITS = 40  # of a prefix's hash that are sent beside the bucket's number
SYMBOL_BITS = 40  # of a hash that stand for a word beside the run
_AS_IS = np.arange(256, dtype=np.uint8)
_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_SALT = mix(np.arange(101, 121, dtype=np.uint64)) | np.uint64(1)


def _widths(size: int) -> tuple[int, int]:
    """(words of an anchor's run, most words of a window beside it)."""
    reach = min(REACH, size - 1)
    return size - reach, reach


def _wide(values: np.ndarray, n: int = 5) -> bytes:
    """uint64 values as n-byte little-endian numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _narrow(packed: bytes, n: int = 5) -> np.ndarray:
    out = np.zeros((len(packed) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(packed, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


class Words:
    """The words of a run of texts: hashes, offsets by text, and the bytes that they span."""

    def __init__(self, column: pa.Array):
        self.data, offsets = buffers(column)
        self.start, self.end, self.by = words(self.data, offsets)
        self.hashes = word_hashes(self.data, self.start, self.end, _AS_IS)
        self.text = np.repeat(np.arange(len(column)), np.diff(self.by))

    def anchors(self, size: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word index of each anchor, hash of its run, bit o for each window that starts o words before it), of the
        texts that are `known`; of equal hashes in a window the first is the anchor."""
        run, reach = _widths(size)
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        rolled = np.zeros(n + reach, np.uint64)
        for k in range(run):
            rolled += self.hashes[k : k + n + reach] * _STEP[k % 64]
        rolled = mix(rolled)
        whole = (np.arange(n) + size <= self.by[1:][self.text[:n]]) & known[self.text[:n]]
        best, place = rolled[:n].copy(), np.zeros(n, np.uint8)
        for o in range(1, reach + 1):
            less = rolled[o : o + n] < best
            best[less] = rolled[o : o + n][less]
            place[less] = o
        bits = np.zeros(n + reach, np.uint8)
        for o in range(reach + 1):
            bits[np.flatnonzero(whole & (place == o)) + o] |= 1 << o
        at = np.flatnonzero(bits)
        return at, rolled[at], bits[at]

    def around(self, at: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
        """Symbols of the `reach` words after each anchor's run and of those before it, nearest first; 0 for words that
        none of its windows holds."""
        run, reach = _widths(size)
        symbols = (self.hashes >> np.uint64(64 - SYMBOL_BITS)) | np.uint64(1)
        out = np.zeros((len(at), 2 * reach), np.uint64)
        left, right = _extent(bits, reach)
        for j in range(reach):
            ok = np.flatnonzero(right > j)
            out[ok, j] = symbols[at[ok] + run + j]
            ok = np.flatnonzero(left > j)
            out[ok, reach + j] = symbols[at[ok] - 1 - j]
        return out


def _extent(bits: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that the windows of `bits` take before the run, and after it."""
    left, right = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for b in range(1, 1 << (reach + 1)):
        left[b] = b.bit_length() - 1
        right[b] = reach - ((b & -b).bit_length() - 1)
    return left[bits], right[bits]


def _prints(hashes: np.ndarray, bits: np.ndarray, around: np.ndarray) -> np.ndarray:
    """A 64-bit name of each suffix; names are compared inside one batch only."""
    total = hashes * _SALT[0] + bits.astype(np.uint64) * _SALT[1]
    for j in range(around.shape[1]):
        total += around[:, j] * _SALT[2 + j]
    return mix(total)


def _window_of(around: np.ndarray, o: int, reach: int) -> np.ndarray:
    """`around` with only the words of the window that starts o words before the anchor."""
    out = np.zeros_like(around)
    out[:, : reach - o] = around[:, : reach - o]
    out[:, reach : reach + o] = around[:, reach : reach + o]
    return out


def _least(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index, smallest id) of each distinct name, and the place of each row among them."""
    distinct, first, back = np.unique(names, return_index=True, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, back, ids)
    return first, least, back


def subtree_repeats(hashes: np.ndarray, around: np.ndarray, bits: np.ndarray, ids: np.ndarray, reach: int) -> np.ndarray:
    """Of each suffix, bit o where the window that starts o words before it also belongs to a smaller id.

    One sort gives the suffixes below each prefix in order, common prefix lengths give the tree's nodes at every depth,
    and likewise to the left; a window is a node to the right crossed with one to the left."""

    def nodes(columns: np.ndarray) -> np.ndarray:
        """The node of each suffix at depths 0 (the prefix) to `reach`."""
        order = np.lexsort((*columns.T[::-1], hashes))
        out = np.empty((reach + 1, len(order)), np.int64)
        apart = np.ones(len(order), bool)
        apart[1:] = hashes[order[1:]] != hashes[order[:-1]]
        for depth in range(reach + 1):
            if depth:
                apart[1:] |= columns[order[1:], depth - 1] != columns[order[:-1], depth - 1]
            out[depth, order] = np.cumsum(apart) - 1
        return out

    right, left = nodes(around[:, :reach]), nodes(around[:, reach:])
    found = np.zeros(len(hashes), np.uint8)
    for o in range(reach + 1):
        rows = np.flatnonzero(bits & (1 << o))
        if len(rows):
            _, least, back = _least(right[reach - o, rows] * len(hashes) + left[o, rows], ids[rows])
            found[rows[least[back] < ids[rows]]] |= np.uint8(1 << o)
    return found


def _sized(count: np.ndarray) -> np.ndarray:
    """The least power of two at or above each count, as its exponent."""
    return np.ceil(np.log2(count)).astype(np.uint8)


def _batch(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids = table.column("id").combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return table.column("text").combine_chunks(), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known


def _slices(table: pa.Table):
    """Runs of about a megabyte of text: (words, ids, which ids are known, rows a to b)."""
    texts, ids, known = _batch(table)
    for a, b in runs(buffers(texts)[1]):
        yield Words(texts.slice(a, b - a)), ids[a:b], known[a:b], a, b


def _parts(buckets: np.ndarray):
    """(bucket, from, to) of each run of equal numbers."""
    cut = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
    yield from zip(buckets[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _rest(table: pa.Table) -> None:
    if table.nbytes > TRIM_BYTES:
        trim()


def _blobs(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return column.to_pylist()


def dedup(docs: DataFrame, size: int = 13, id_: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES, limit: int = LIMIT) -> DataFrame:
    """(id, n_words, n_removed, kept, spans) of each row: a word goes if a window of `size` consecutive words of the row
    covers it whose words also stand, in that order, in a row with a smaller id. `kept` are the other words, joined by one
    space; `spans` the maximal removed runs as [first word, word after the last).

    Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, unchanged.
    Windows are judged on the input. A null or empty text has no words; rows of one id do not judge each other; a row
    without an id keeps all and takes from none; repeated rows come through each; extra columns take no part; an
    empty table gives an empty result. Windows are alike if the 64-bit hash of their anchor's run and 40 bits of the
    hash of each other word agree. A task holds one batch of some `batch_bytes` (or one longer text), or one bucket of suffixes.
    """
    ship(docs.sparkSession)
    run, reach = _widths(size)
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(LEAST_BATCHES, -(-total // batch_bytes))
    deep = max(5, int(total // (2 * batch_bytes)).bit_length())  # bits that number the buckets
    dealt = rows.select(F.expr(f"cast(pmod(xxhash64(id, text), {batches}) as int)").alias("batch"), "id", "text").repartition("batch")

    def code(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - deep - LOW_BITS)

    def prefixes(table: pa.Table) -> pa.Table:
        found = [w.anchors(size, known)[1] for w, _, known, _, _ in _slices(table)]
        codes, count = np.unique(code(np.concatenate(found)), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        low, exponent = _wide(codes), _sized(count).tobytes()
        parts = list(_parts((codes >> np.uint64(LOW_BITS)).astype(np.int64)))
        number = table.column("batch")[0].as_py() if table.num_rows else 0
        _rest(table)
        return pa.table({"bucket": pa.array([p[0] for p in parts], pa.int32()), "batch": pa.array([number] * len(parts), pa.int32()), "low": pa.array([low[5 * a : 5 * b] for _, a, b in parts], pa.binary()), "exponent": pa.array([exponent[a:b] for _, a, b in parts], pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        lows, exponents = [_narrow(x) for x in _blobs(table.column("low"))], [np.frombuffer(x, np.uint8) for x in _blobs(table.column("exponent"))]
        sizes = [len(x) for x in lows]
        low, exponent = np.concatenate(lows), np.concatenate(exponents)
        distinct, back, times = np.unique(low, return_inverse=True, return_counts=True)
        count = np.zeros(len(distinct))
        np.add.at(count, back, np.exp2(exponent))
        often = ((times > 1) | (count > 1))[back]
        hot = (count > limit)[back]
        out, at = [], 0
        bucket = np.uint64(table.column("bucket")[0].as_py())
        for number, n in zip(table.column("batch").to_pylist(), sizes, strict=True):
            mine = np.flatnonzero(often[at : at + n]) + at
            if len(mine):
                out.append((number, bucket.item(), _wide(low[mine]), hot[mine].astype(np.uint8).tobytes()))
            at += n
        _rest(table)
        return pa.table([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True) if out else ((),) * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["batch", "bucket", "low", "hot"])

    def suffixes(table: pa.Table, told: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "batch": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("hashes", "bits", "ids", "around")}})
        if not table.num_rows or not told.num_rows:
            return empty
        number = told.column("batch")[0].as_py()
        codes = np.concatenate([_narrow(x) | np.uint64(b << LOW_BITS) for b, x in zip(told.column("bucket").to_pylist(), _blobs(told.column("low")), strict=True)])
        hot = np.concatenate([np.frombuffer(x, np.uint8) for x in _blobs(told.column("hot"))]).astype(bool)
        order = np.argsort(codes)
        codes, hot = codes[order], hot[order]
        kept = []
        for w, ids, known, _, _ in _slices(table):
            at, hashes, bits = w.anchors(size, known)
            place = np.minimum(np.searchsorted(codes, code(hashes)), len(codes) - 1)
            mine = np.flatnonzero(codes[place] == code(hashes))
            at, hashes, bits = at[mine], hashes[mine], bits[mine]
            kept.append((hashes, bits, ids[w.text[at]], w.around(at, bits, size), hot[place[mine]]))
        hashes, bits, ids, around, long = (np.concatenate(x) for x in zip(*kept, strict=True))
        sent = []

        def send(hashes, bits, ids, around, routed=None):
            first, least, _ = _least(_prints(hashes, bits, around), ids)
            sent.append((hashes[first], bits[first], least, around[first], (hashes if routed is None else routed)[first] >> np.uint64(64 - deep)))

        short = ~long
        if short.any():
            send(hashes[short], bits[short], ids[short], around[short])
        for o in range(reach + 1):
            rows = np.flatnonzero(long & (bits & (1 << o) > 0))
            if len(rows):
                part, one = _window_of(around[rows], o, reach), np.full(len(rows), 1 << o, np.uint8)
                send(hashes[rows], one, ids[rows], part, _prints(hashes[rows], one, part))
        if not sent:
            return empty
        hashes, bits, ids, around, bucket = (np.concatenate(x) for x in zip(*sent, strict=True))
        order = np.lexsort((ids, bucket))
        bucket = bucket[order].astype(np.int64)
        parts = list(_parts(bucket))
        columns = {"hashes": (hashes[order].astype("<u8").tobytes(), 8), "bits": (bits[order].tobytes(), 1), "ids": (ids[order].astype("<i8").tobytes(), 8), "around": (_wide(around[order].ravel()), 10 * reach)}
        out = pa.table({"bucket": pa.array([p[0] for p in parts], pa.int32()), "batch": pa.array([number] * len(parts), pa.int32()), **{c: pa.array([x[n * a : n * b] for _, a, b in parts], pa.binary()) for c, (x, n) in columns.items()}})
        _rest(table)
        if not hot.any():
            return out
        mark = pa.table({"bucket": pa.array([number % (1 << deep)], pa.int32()), "batch": pa.array([number], pa.int32()), "hashes": pa.array([codes[hot].astype("<u8").tobytes()], pa.binary()), **{c: pa.array([None], pa.binary()) for c in ("bits", "ids", "around")}})
        return pa.concat_tables([out, mark])

    def trees(table: pa.Table) -> pa.Table:
        marks = table.filter(table.column("bits").is_null())
        table = table.filter(table.column("bits").is_valid())
        out = [(number, codes, None) for number, codes in zip(marks.column("batch").to_pylist(), _blobs(marks.column("hashes")), strict=True)]
        if table.num_rows:
            joined = {c: b"".join(_blobs(table.column(c))) for c in ("hashes", "bits", "ids", "around")}
            hashes, bits, ids = np.frombuffer(joined["hashes"], "<u8"), np.frombuffer(joined["bits"], np.uint8), np.frombuffer(joined["ids"], "<i8")
            around = _narrow(joined["around"]).reshape(len(hashes), 2 * reach)
            found = subtree_repeats(hashes, around, bits, ids, reach)
            names, at = _prints(hashes, bits, around), 0
            for number, x in zip(table.column("batch").to_pylist(), _blobs(table.column("bits")), strict=True):
                mine = np.flatnonzero(found[at : at + len(x)]) + at
                if len(mine):
                    out.append((number, names[mine].astype("<u8").tobytes(), found[mine].tobytes()))
                at += len(x)
        _rest(table)
        return pa.table([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True) if out else ((),) * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["batch", "names", "found"])

    def removed(table: pa.Table, told: pa.Table) -> pa.Table:
        marks, told = told.filter(told.column("found").is_null()), told.filter(told.column("found").is_valid())
        hot = np.sort(np.frombuffer(b"".join(_blobs(marks.column("names"))), "<u8"))
        names, found = np.frombuffer(b"".join(_blobs(told.column("names"))), "<u8"), np.frombuffer(b"".join(_blobs(told.column("found"))), np.uint8)
        order = np.argsort(names)
        names, found = names[order], found[order]

        def covered(own: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
            """The bits that the trees found or that a smaller id of the batch has too."""
            _, least, back = _least(own, ids)
            out = np.where(ids > least[back], bits, 0).astype(np.uint8)
            if len(names):
                place = np.minimum(np.searchsorted(names, own), len(names) - 1)
                out |= np.where(names[place] == own, found[place], 0).astype(np.uint8)
            return out & bits

        places, gathered = [], []
        for w, ids, known, a, _ in _slices(table):
            at, hashes, bits = w.anchors(size, known)
            around = w.around(at, bits, size)
            own = _prints(hashes, bits, around)
            long = np.isin(code(hashes), hot)
            gathered.append((own[~long], ids[w.text[at]][~long], bits[~long], at[~long], np.full((~long).sum(), a)))
            for o in range(reach + 1):
                rows = np.flatnonzero(long & (bits & (1 << o) > 0))
                if len(rows):
                    one = np.full(len(rows), 1 << o, np.uint8)
                    gathered.append((_prints(hashes[rows], one, _window_of(around[rows], o, reach)), ids[w.text[at[rows]]], one, at[rows], np.full(len(rows), a)))
        if gathered:
            own, ids, bits, at, piece = (np.concatenate(x) for x in zip(*gathered, strict=True))
            cover = covered(own, ids, bits)
            hit = np.flatnonzero(cover)
            hit = hit[np.argsort(piece[hit], kind="stable")]
            places = [(cover[hit], at[hit], piece[hit])]
        out = []
        for w, _, _, a, b in _slices(table):
            gone = np.zeros(len(w.hashes) + 1, np.int64)
            if places:
                cover, at, piece = places[0]
                mine = slice(*np.searchsorted(piece, [a, a + 1]))
                for o in range(reach + 1):
                    begin = at[mine][cover[mine] & (1 << o) > 0] - o
                    gone[begin] += 1
                    gone[begin + size] -= 1
            out.append(_kept(w, np.cumsum(gone[:-1]) > 0, table.column("id").combine_chunks().slice(a, b - a)))
        _rest(table)
        return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in _SCHEMA}, _SCHEMA)

    sent = dealt.groupBy("batch").applyInArrow(prefixes, "bucket int, batch int, low binary, exponent binary")
    told = sent.groupBy("bucket").applyInArrow(shared, "batch int, bucket int, low binary, hot binary")
    below = dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(suffixes, "bucket int, batch int, hashes binary, bits binary, ids binary, around binary")
    answers = below.groupBy("bucket").applyInArrow(trees, "batch int, names binary, found binary")
    done = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(removed, "id long, n_words long, n_removed long, kept string, spans array<struct<first:int,stop:int>>")
    return done.withColumnRenamed("id", id_)


_SPAN = pa.struct([pa.field("first", pa.int32()), pa.field("stop", pa.int32())])
_SCHEMA = pa.schema([pa.field("id", pa.int64()), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("kept", pa.string()), pa.field("spans", pa.list_(_SPAN))])


def _kept(w: Words, gone: np.ndarray, ids: pa.Array) -> pa.Table:
    """What is left of each text of `w`, and the runs of words that went."""
    n = len(ids)
    stay = np.flatnonzero(~gone)
    by = np.searchsorted(stay, w.by)
    long = w.end[stay] - w.start[stay] + 1  # a word and the space after it
    stop = np.cumsum(long)
    body = np.full(stop[-1] if len(stop) else 0, 32, np.uint8)
    source = np.arange(len(body)) + np.repeat(w.start[stay] - (stop - long), long)
    source[stop - 1] = 0
    np.take(w.data, source, out=body) if len(body) else None
    body[stop - 1] = 32
    edge = np.concatenate([[0], stop])[by]
    few = np.diff(by) > 0  # texts with words lose the last space
    drop = np.ones(len(body), bool)
    drop[edge[1:][few] - 1] = False
    body = body[drop]
    offsets = np.concatenate([[0], np.cumsum(np.diff(edge) - few)]).astype(np.int32)
    kept = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes()))
    before, after = np.empty_like(gone), np.empty_like(gone)
    before[:1], before[1:] = False, gone[:-1]
    after[-1:], after[:-1] = False, gone[1:]
    full = np.flatnonzero(np.diff(w.by))
    before[w.by[full]] = False
    after[w.by[full + 1] - 1] = False
    first, last = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    zero = w.by[w.text[first]]
    spans = pa.StructArray.from_arrays([pa.array((first - zero).astype(np.int32)), pa.array((last + 1 - zero).astype(np.int32))], fields=list(_SPAN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, w.by).astype(np.int32)), spans)
    total = np.concatenate([[0], np.cumsum(gone)])[w.by]
    return pa.Table.from_arrays([ids, pa.array(np.diff(w.by).astype(np.int64)), pa.array(np.diff(total).astype(np.int64)), kept, lists], schema=_SCHEMA)
