"""Alignment of two tokenizers' tokens over the same bytes.

A map over the documents encodes each text by both tokenizers and merges their cumulative token ends, as two pointers
over sorted offsets: where both end, a group closes and its last tokens are linked. Pairs of ids are counted by Spark;
each batch of documents is told the counts of the pairs that it holds, and which are the highest of their B id.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Codec, packed_ids
from tessera.llm.hashing import CHUNK_BYTES
from tessera.llm.session import ship, spread, trim

BATCH_BYTES = 8 << 20  # of text in a batch, on average
LEAST_BATCHES = 48
CACHE = 1 << 17  # stretches of text kept by a worker
LOST, LOST_ID = b"\xff" * 4, 0xFFFFFFFF  # in place of ids that do not give their text
SPACE = "▁"  # fixed: how piece vocabularies write a space
_PIECES: dict[tuple[str, str], tuple] = {}


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def byte_codec(path: str) -> Codec:
    """The encoder of a byte-level vocabulary in JSON. Ids must rise in the order of the merges; special tokens are none."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    letters, special = byte_letters(), {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): number for token, number in model["model"]["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    order = [model["model"]["vocab"][a + b] for a, b in merges]
    if order != sorted(order):
        raise ValueError("the ids of this vocabulary do not rise with its merges")
    return Codec(ranks)


class Pieces:
    """A SentencePiece model and the bytes of its pieces.

    Where no piece holds a space after anything else, no merge crosses the place before a space that follows something
    else; the stretches between such places are then encoded apart, and a stretch seen before is taken from a cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.tokens = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) for i in range(len(names))]
        whole = all(SPACE not in n.lstrip(SPACE) for n, s in zip(names, special, strict=True) if not s)
        self.apart = whole and self.model.decode(self.model.encode("  a  b ")) == "  a  b "  # and spaces are kept as they are
        self.cache: dict[str, bytes] = {}

    def _checked(self, ids: list[int], text: str) -> bytes:
        """The ids, packed, or LOST if they do not give the bytes of `text`."""
        return packed_ids(ids) if b"".join(map(self.tokens.__getitem__, ids)) == text.encode() else LOST

    def _all_checked(self, ids: list[list[int]], texts: list[str]) -> list[bytes]:
        """`_checked` of each, at once: texts whose tokens fill them and give their bytes. If any does not, each is looked at alone."""
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
        upto = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        body = [t.encode() for t in texts]
        filled = np.cumsum(self.lengths[flat])[upto - 1] == np.cumsum(np.fromiter(map(len, body), np.int64, len(body)))
        if not filled.all() or b"".join(map(self.tokens.__getitem__, flat.tolist())) != b"".join(body):
            return [self._checked(x, t) for x, t in zip(ids, texts, strict=True)]
        packed, upto = flat.astype("<u4").tobytes(), (4 * upto).tolist()
        return [packed[i:j] for i, j in zip([0, *upto], upto, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, none of them empty (the model adds a space), packed as little-endian unsigned 32-bit
        integers; LOST is among them if they do not give the bytes of a space and the text."""
        if not self.apart:
            return [self._checked(ids, " " + t) for ids, t in zip(self.model.encode(texts, num_threads=1), texts, strict=True)]
        joined = " " + "  ".join(texts)  # of two spaces between texts the first ends the one before, and is dropped below
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths + 2) - lengths - 2
        space = (points == 32) | (points == ord(SPACE))
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[begins] = True
        ends = begins + lengths + 1  # where the space between texts stands
        cut[ends[:-1]] = True
        at = np.flatnonzero(cut)
        stop = np.append(at[1:], len(points))
        inside = np.ones(len(points) + 1, bool)
        inside[ends] = False
        at, stop = at[inside[at]], stop[inside[at]]
        parts = [joined[i:j] for i, j in zip(at.tolist(), stop.tolist(), strict=True)]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        packed = list(map(cache.get, parts))
        if None in packed:
            new = list(dict.fromkeys(p for p, known in zip(parts, packed, strict=True) if known is None))
            ids = [x or [self.model.piece_to_id(SPACE)] for x in self.model.encode([p[1:] for p in new], num_threads=1)]
            found = dict(zip(new, self._all_checked(ids, new), strict=True))
            cache |= {p: ids for p, ids in found.items() if len(p) <= 64}
            packed = [found[p] if known is None else known for p, known in zip(parts, packed, strict=True)]
        by = np.append(np.searchsorted(at, begins), len(at)).tolist()
        return [b"".join(packed[i:j]) for i, j in zip(by, by[1:], strict=False)]


def _loaded(a: str, b: str) -> tuple[Codec, Pieces]:
    if (a, b) not in _PIECES:
        _PIECES[a, b] = byte_codec(a), Pieces(b)
    return _PIECES[a, b]


class Digits:
    """Decimal ids with the mark that follows them, many at once."""

    def __init__(self, most: int):
        self.size = most
        self.long = np.array([len(str(i)) + 1 for i in range(most)] * 4)
        text = [str(i) for i in range(most)]
        self.width = max(map(len, text)) + 1
        self.shown = np.zeros((4 * most, self.width), np.uint8)
        for k, mark in enumerate(",|,;"):
            joined = "".join(t + mark + "\0" * (self.width - len(t) - 1) for t in text).encode()
            self.shown[k * most : (k + 1) * most] = np.frombuffer(joined, np.uint8).reshape(most, self.width)

    def write(self, numbers: np.ndarray) -> bytes:
        """The texts of numbers, each an id plus `size` times its mark's place in ',|,;'."""
        shown = self.shown[numbers]
        return shown[shown > 0].tobytes()


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of each side that close a group, pairwise: those whose ends are the same."""
    place = np.searchsorted(ends_b, ends_a)
    both = np.flatnonzero(ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a)
    return both, place[both]


def _in_groups(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, size: int) -> np.ndarray:
    """The numbers of `Digits` that write the tokens as `a1,a2|b1;a3|b2,b3;`."""
    a, b = a.copy(), b + 2 * size
    a[last_a] += size
    b[last_b] += size
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.append(0, last_b + 1)[np.searchsorted(last_a, np.arange(len(a)))]] = a
    out[np.arange(len(b)) + (last_a + 1)[np.searchsorted(last_b, np.arange(len(b)))]] = b
    return out


def align(docs: DataFrame, path_a: str, path_b: str, id_: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., n_a, n_b, n_groups, groups, links) of each row: its tokens by A (byte-level, of space and text) and by B (pieces, of
    the text, to which the model adds a space), written group by group, and its links packed as pairs of unsigned 32-bit ids.

    A null or empty text, or one that a tokenizer does not give back byte by byte, has no tokens: zeros and ''. Rows come
    through one to one. One map over the scan; a run of about half a megabyte of text (or a longer one) is held at once."""
    ship(docs.sparkSession)
    part = spread(docs.select(F.col(id_), *keep, F.col(text).cast("string").alias("__text")))
    head = [id_, *keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]), "n_a long, n_b long, n_groups long, groups string, links binary"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, pieces = _loaded(path_a, path_b)
        digits = Digits(max(len(codec.tokens), len(pieces.tokens)))
        try:
            for frame in frames:
                sizes = frame["__text"].str.len().fillna(0).to_numpy().cumsum()
                a = 0
                while a < len(frame):
                    b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK_BYTES // 2, side="right")))
                    slice_ = frame.iloc[a:b]
                    yield slice_[head].assign(**_aligned(slice_["__text"].tolist(), codec, pieces, digits))
                    a = b
        finally:
            trim()

    return part.mapInPandas(run, schema)


def _aligned(texts: list[str | None], codec: Codec, pieces: Pieces, digits: Digits) -> dict[str, list]:
    full = [i for i, t in enumerate(texts) if t]
    out = {"n_a": [0] * len(texts), "n_b": [0] * len(texts), "n_groups": [0] * len(texts), "groups": [""] * len(texts), "links": [b""] * len(texts)}
    whole = [texts[i] for i in full]
    rows = [x for x in zip(full, codec.encode([" " + t for t in whole]), pieces.encode(whole), strict=True) if not (_ids(x[2]) == LOST_ID).any()] if full else []
    if not rows:
        return out
    at, packed_a, packed_b = zip(*rows, strict=True)
    a, b = (_ids(b"".join(p)) for p in (packed_a, packed_b))
    upto_a, upto_b = (np.cumsum([len(x) // 4 for x in p]) for p in (packed_a, packed_b))
    last_a, last_b = merged(codec.ends(a), np.cumsum(pieces.lengths[b]))  # both sides of a text have its bytes, so offsets stay level from text to text
    numbers = _in_groups(a, b, last_a, last_b, digits.size)
    shown = digits.write(numbers).decode()
    links = np.stack([a[last_a], b[last_b]], axis=1).astype("<u4").tobytes()
    letters = np.cumsum(digits.long[numbers])[upto_a + upto_b - 1].tolist()
    groups = np.searchsorted(last_a, upto_a).tolist()
    begin, first, n_a, n_b = 0, 0, np.diff(upto_a, prepend=0).tolist(), np.diff(upto_b, prepend=0).tolist()
    for k, i in enumerate(at):
        out["n_a"][i], out["n_b"][i], out["n_groups"][i] = n_a[k], n_b[k], groups[k] - first
        out["groups"][i], out["links"][i] = shown[begin : letters[k] - 1], links[8 * first : 8 * groups[k]]
        begin, first = letters[k], groups[k]
    return out


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").astype(np.int64)


def _pairs(links: list[bytes]) -> np.ndarray:
    """Each link as one number: A's id in the high half."""
    both = np.frombuffer(b"".join(links), "<u4").reshape(-1, 2).astype(np.int64)
    return both[:, 0] << 32 | both[:, 1]


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best) of partial counts (pair, n): how many links of the corpus hold it, and whether that is the
    highest count of its B id, ties included. The maxima are one row a B id, as many as the vocabulary has at most."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.expr("cast(pair & 4294967295 as int)").alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", F.expr("cast(pair & 4294967295 as int)")).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_strength(docs: DataFrame, path_a: str, path_b: str, id_: str = "doc_id", text: str = "text", groups: str = "groups", shown=F.col, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, `groups`) of each row: what `align` gives, the links whose pair's count is the
    highest of its B id, and the sum of the links' counts. `shown` is applied to the groups' text before rows are shuffled.

    Documents go to batches by a hash of id and text. A batch sends each of its pairs once, with its number, and gets
    each back once, so a pair that is everywhere makes one row a batch. An empty table gives an empty result."""
    rows = docs.select(F.col(id_), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(LEAST_BATCHES, -(-total // batch_bytes))
    dealt = rows.withColumn("batch", F.expr(f"cast(pmod(xxhash64(`{id_}`, text), {batches}) as int)"))
    aligned = align(dealt, path_a, path_b, id_, keep=("batch",)).withColumn("groups", shown("groups")).repartition("batch")
    kind = aligned.schema[0].dataType.simpleString()

    def counted(table: pa.Table) -> pa.Table:
        pair, n = np.unique(_pairs(table.column("links").to_pylist()), return_counts=True)
        return pa.table({"batch": pa.array(np.full(len(pair), table.column("batch")[0].as_py()), pa.int32()), "pair": pair, "n": n.astype(np.int64)})

    def told(table: pa.Table, known: pa.Table) -> pa.Table:
        pair, count, best = (known.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        pair, count, best = pair[order], count[order], best[order]
        links = table.column("links").to_pylist()
        n = np.array([len(x) // 8 for x in links], np.int64)
        at = np.searchsorted(pair, _pairs(links))
        cut = np.append(0, np.cumsum(n))
        sums = [np.append(0, np.cumsum(x[at]))[cut] for x in (best.astype(np.int64), count)]
        columns = [table.column(c) for c in (id_, "n_a", "n_b", "n_groups")] + [pa.array(n), *(pa.array(np.diff(s)) for s in sums), table.column("groups")]
        return pa.Table.from_arrays(columns, [id_, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", groups])

    here = aligned.groupBy("batch").applyInArrow(counted, "batch int, pair long, n long")
    known = here.select("batch", "pair").join(pair_counts(here), "pair")
    return aligned.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(told, f"`{id_}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, `{groups}` string")
