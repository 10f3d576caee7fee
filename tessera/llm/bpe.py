"""Byte-level BPE encoding and decoding.

Pre-tokenisation has no regex: an array of code-point classes (with what little look-ahead the pattern needs
folded into the class) drives a small automaton, and because its transition functions form a finite monoid,
the state before every character comes from an associative scan of function numbers through a composition
table, block by block over whole batches. The slices between boundaries are looked up in a cache of merged
pieces; those not seen yet are merged by rank, many at once in arrays of pieces of one length, a long one with a
heap, in O(n log n).
"""

from __future__ import annotations

import base64
import heapq
import itertools
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import CHUNK_BYTES, buffers, runs
from tessera.llm.session import ship, spread, tidy

# classes of characters
CUT, MID, SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE1, QUOTE2 = range(9)
# states: what the token that holds the previous character is
START, RUN, PREFIX, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_MORE, TWO_MORE, CLOSED = range(9)

CACHE = 1 << 18  # pieces kept by a worker
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]  # fixed: Unicode White_Space


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this character."""
    if kind == CUT:
        return START, True
    if kind == MID:
        return RUN, state != RUN
    if kind == SPACE:
        return PREFIX, True
    if kind == BLANK:
        return CLOSED, True
    if kind == LETTER and state in (ONE_MORE, TWO_MORE):
        return (CLOSED if state == ONE_MORE else ONE_MORE), False
    if kind == LETTER:
        return IN_LETTERS, state not in (IN_LETTERS, PREFIX)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PREFIX)
    if kind == OTHER or state in (IN_OTHER, PREFIX):
        return IN_OTHER, state not in (IN_OTHER, PREFIX)
    return (ONE_MORE if kind == QUOTE1 else TWO_MORE), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(composition table, images of the states, number of each class's function) of the transition monoid."""
    base = [tuple(_step(s, k)[0] for s in range(9)) for k in range(9)]
    found = {f: i for i, f in enumerate(dict.fromkeys(base))}
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    names = list(found)
    table = np.array([[found[tuple(g[s] for s in f)] for g in names] for f in names], dtype=np.int16)
    return table, np.array(names, dtype=np.uint8), np.array([found[f] for f in base], dtype=np.int16)


_TABLE, _IMAGE, _OF_CLASS = _monoid()
_STARTS = np.array([[_step(s, k)[1] for k in range(9)] for s in range(9)])
_class_table: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _class_table:
        names = "".join(map(unicodedata.category, map(chr, range(0x110000))))[::2]  # the first letters of two
        kinds = np.full(0x110000, OTHER, np.uint8)
        for letter, kind in (("L", LETTER), ("N", NUMBER)):
            kinds[np.frombuffer(names.encode(), np.uint8) == ord(letter)] = kind
        kinds[WHITE_SPACE] = MID
        _class_table.append(kinds)
    return _class_table[0]


def classes(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The class of each code point; `cuts` are the positions between texts."""
    kinds = class_table()[points]
    kinds[cuts] = CUT
    blank = kinds == MID
    n = len(points)
    follow = np.full(n + 2, CUT, np.uint8)
    follow[:n] = kinds
    last = blank & (follow[1 : n + 1] != MID) & (follow[1 : n + 1] != CUT)
    kinds[last] = np.where(points[last] == 0x20, SPACE, BLANK)
    quotes = np.flatnonzero(points == 0x27)
    quotes = quotes[kinds[quotes] == OTHER]
    if len(quotes):
        ahead = np.zeros(n + 2, np.uint32)
        ahead[:n] = points
        ahead[cuts] = 0
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[quotes[short]] = QUOTE1
        kinds[quotes[long]] = QUOTE2
    return kinds


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """True where a token (or a cut) starts: a blocked scan of transition functions."""
    n = len(kinds)
    if not n:
        return np.zeros(0, bool)
    wide = max(1, min(4096, n // 64))
    deep = -(-n // wide)
    padded = np.zeros(wide * deep, np.uint8)
    padded[:n] = kinds
    lanes = np.ascontiguousarray(_OF_CLASS[padded].reshape(wide, deep).T)
    flat, size = _TABLE.ravel(), len(_TABLE)
    for j in range(1, deep):
        lanes[j] = flat[lanes[j - 1].astype(np.int32) * size + lanes[j]]
    state, begin = START, np.zeros(wide, np.uint8)
    image = _IMAGE.tolist()
    for r, f in enumerate(lanes[-1].tolist()):
        begin[r] = state
        state = image[f][state]
    before = np.empty((deep, wide), np.uint8)
    before[0] = begin
    before[1:] = _IMAGE[lanes[:-1], begin[None, :]]
    return _STARTS[before.T.ravel()[:n], kinds]


_BYTES = [bytes([b]) for b in range(256)]


NEVER = 1 << 40  # in place of the id of a pair that is no token


def _place(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)).astype(np.int64)


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers; for few ids faster than an array."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encodes and decodes with merge ranks: a dict from a token's bytes to its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.two = [ranks.get(bytes((a, b)), len(self.tokens)) for a in range(256) for b in range(256)]  # where merging starts
        self.cache: dict[str, bytes] = {}
        self.pairs: tuple | None = None

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(each byte's id or -1, keys, ids, shift): an open hash table of the pairs of ids whose bytes together are a token."""
        if self.pairs is None:
            rank = self.ranks.get
            found = [(a << 32 | b, r) for token, r in self.ranks.items() for k in range(1, len(token)) if (a := rank(token[:k])) is not None and (b := rank(token[k:])) is not None]
            shift = 62 - max(1, len(found)).bit_length()  # a quarter to an eighth of the places are taken
            keys, ids = np.full((1 << 64 - shift) + 64, -1, np.int64), np.full((1 << 64 - shift) + 64, NEVER, np.int64)
            left = np.array(found, np.int64).reshape(-1, 2)
            at = _place(left[:, 0], shift)
            while len(left):
                free = keys[at] == -1
                keys[at[free]] = left[free, 0]
                ids[at[free]] = left[free, 1]
                stay = keys[at] != left[:, 0]
                ids[at[~stay]] = left[~stay, 1]  # of those that tried one place the last has it; its id goes with it
                left, at = left[stay], at[stay] + 1
            self.pairs = np.array([rank(b, -1) for b in _BYTES], np.int64), keys, ids, shift
        return self.pairs

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair of ids put together, NEVER if that is no token."""
        _, keys, ids, shift = self._table()
        wanted = left << 32 | right
        at = _place(wanted, shift)
        out = np.where(keys[at] == wanted, ids[at], NEVER)
        more = np.flatnonzero((keys[at] != wanted) & (keys[at] != -1))
        at = at[more]
        while len(more):
            at += 1
            here = keys[at]
            hit = here == wanted[more]
            out[more[hit]] = ids[at[hit]]
            go = ~hit & (here != -1)
            more, at = more[go], at[go]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """What `merge` gives for each piece, packed: pieces of like length are rows of one array, and each step merges one pair
        of every row. Long pieces, and those of bytes that are no tokens, are merged alone."""
        alphabet = self._table()[0]
        whole = list(map(self.ranks.get, pieces))
        out: list[bytes] = [b"" if known is None else packed_ids([known]) for known in whole]
        lengths = np.fromiter((len(p) if known is None else -1 for p, known in zip(pieces, whole, strict=True)), np.int64, len(pieces))
        for n in np.unique(lengths[lengths >= 0]).tolist():
            rows = np.flatnonzero(lengths == n)
            if n > 64 or n < 2 or len(rows) < 16 or (alphabet < 0).any():
                for i in rows.tolist():
                    out[i] = packed_ids(self.merge(pieces[i]))
                continue
            ids = alphabet[np.frombuffer(b"".join(map(pieces.__getitem__, rows.tolist())), np.uint8)].reshape(-1, n)
            ranked = self._ranked(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, n - 1)
            while len(rows):
                if ranked.shape[1]:
                    i = ranked.argmin(axis=1)
                    every = np.arange(len(rows))
                    best = ranked[every, i]
                    done = best == NEVER
                else:
                    done = np.ones(len(rows), bool)
                if done.any():
                    width = 4 * ids.shape[1]
                    packed = ids[done].astype("<u4").tobytes()
                    for k, row in enumerate(rows[done].tolist()):
                        out[row] = packed[k * width : (k + 1) * width]
                    rows, ids, ranked = rows[~done], ids[~done], ranked[~done]
                    if not len(rows):
                        break
                    i, best, every = i[~done], best[~done], np.arange(len(rows))
                ids[every, i] = best
                keep = np.ones(ids.shape, bool)
                keep[every, i + 1] = False
                ids = ids[keep].reshape(len(rows), -1)
                keep = np.ones(ranked.shape, bool)
                keep[every, i] = False
                ranked = ranked[keep].reshape(len(rows), -1)
                before, after = np.flatnonzero(i > 0), np.flatnonzero(i < ranked.shape[1])
                at = np.concatenate([i[before] - 1, i[after]])
                who = np.concatenate([before, after])
                ranked[who, at] = self._ranked(ids[who, at], ids[who, at + 1])
        return out

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))})

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece: the adjacent pair of lowest rank, the leftmost first, is merged until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rank, n = self.ranks.get, len(piece)
        parts: list[bytes] = list(map(_BYTES.__getitem__, piece))
        if n <= 64:
            never = len(self.tokens)
            two = self.two
            ranked = [two[a << 8 | b] for a, b in itertools.pairwise(piece)]
            while ranked and (best := min(ranked)) != never:
                i = ranked.index(best)
                parts[i] += parts.pop(i + 1)
                del ranked[i]
                if i:
                    ranked[i - 1] = rank(parts[i - 1] + parts[i], never)
                if i < len(ranked):
                    ranked[i] = rank(parts[i] + parts[i + 1], never)
            return [self.ranks[p] for p in parts]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right or not left:
                continue
            parts[i], parts[j] = left + right, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if before[i] >= 0:
                k = before[i]
                if (r := rank(parts[k] + parts[i])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[i]))
        return [self.ranks[p] for p in parts if p]

    def encode(self, texts: list[str], most: int = CACHE) -> list[bytes]:
        """Each text's ids, packed as little-endian unsigned 32-bit integers; the cache is emptied beyond `most` pieces."""
        joined = "\0".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        cuts = ends[:-1]
        kinds = classes(points, cuts)
        at = np.flatnonzero(boundaries(kinds))
        stop = np.append(at[1:], len(points))
        token = kinds[at] != CUT
        at, stop = at[token], stop[token]
        pieces = [joined[i:j] for i, j in zip(at.tolist(), stop.tolist(), strict=True)]
        cache = self.cache
        if len(cache) > most:
            cache.clear()
        packed = list(map(cache.get, pieces))
        if None in packed:
            new = list(dict.fromkeys(itertools.compress(pieces, [known is None for known in packed])))
            found = dict(zip(new, self.merge_all([p.encode() for p in new]), strict=True))
            cache.update(found if max(map(len, new)) <= 64 else {p: ids for p, ids in found.items() if len(p) <= 64})
            packed = [found[p] if known is None else known for p, known in zip(pieces, packed, strict=True)]
        by_text = np.searchsorted(at, np.concatenate([[0], ends + 1])).tolist()
        return [b"".join(packed[i:j]) for i, j in zip(by_text, by_text[1:], strict=False)]

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset at which each token ends."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec.load(path)
    return _codecs[path]


def text_runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about half a megabyte; a null is an empty text."""
    _, offsets = buffers(column)
    for a, b in runs(offsets, CHUNK_BYTES // 2):
        yield a, ["" if t is None else t for t in column.slice(a, b - a).to_pylist()]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", ends: str | None = "ends", cache: int = CACHE) -> DataFrame:
    """The columns `keep`, and for each row the ids of its whole text (binary, little-endian unsigned 32-bit
    integers) and each token's end as a byte offset into the UTF-8 text (same packing; `ends` None leaves it out).

    A null or empty text has no ids. Rows come through one to one, repeated rows too; columns outside `keep`
    are dropped, so extra columns cannot clash. One map over the scan: no shuffle, memory bounded by a run of
    about half a megabyte of text (or one longer text) and a cache of `cache` pieces. `vocabulary` is a path that workers can read.
    """
    ship(docs.sparkSession)
    part = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    names = [*keep, ids, *([ends] if ends else [])]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]), *(f"`{n}` binary" for n in names[len(keep) :])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            column = batch.column(len(keep))
            for a, texts in text_runs(column):
                packed = bpe.encode(texts, cache)
                out = [batch.column(k).slice(a, len(texts)) for k in range(len(keep))] + [pa.array(packed, pa.binary())]
                if ends:
                    out.append(pa.array([bpe.ends(np.frombuffer(p, "<u4")).astype("<u4").tobytes() for p in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names)

    return spread(part).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", ends: str | None = "ends", to: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids in column `to`. With `ends`, the retained offsets must agree with the
    decoded length, or the task fails: ids and offsets that do not belong together are an error. Null ids decode to
    null. Other columns pass through; one called like `to` is replaced."""
    ship(encoded.sparkSession)
    part = encoded.drop(to)
    names = part.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields), f"`{to}` binary"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                out = [None if i is None else bpe.decode(np.frombuffer(i, "<u4")) for i in piece.column(names.index(ids)).to_pylist()]
                if ends:
                    for body, e in zip(out, piece.column(names.index(ends)).to_pylist(), strict=True):
                        if body is not None and e is not None and len(body) != (int.from_bytes(e[-4:], "little") if e else 0):
                            raise ValueError("the retained offsets do not belong to these ids")
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, pa.binary())], [*names, to])

    return part.mapInArrow(tidy(run), schema)
