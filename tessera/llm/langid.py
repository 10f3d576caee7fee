"""Language identification by prediction by partial matching.

For every language a byte context tree of bounded depth is counted on a bounded sample of labelled texts and
frozen. A byte's probability after its context blends the orders by escape (method C: a context seen with
total t and d distinct bytes gives byte c the share n(c) / (t + d) and escapes with d / (t + d) to the next
shorter context; below order 0 all 256 bytes are alike). A text's exact code length under a language is the
sum over all its bytes; the language with the shortest code wins. As the statistics are frozen, a byte's cost
in all languages is a function of the context and the byte, so a table holds it for every n-gram seen in any
language, and n-grams not seen add the escape costs of their contexts and go on one order shorter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.session import checkpoint, ship, spread, tidy

ORDER = 3  # longest context in bytes
SAMPLE_PER_LANGUAGE = 400  # texts of a language that the statistics come from, at most; the documented bound
SAMPLE_IN_ALL = 20_000  # texts of all languages together, at most
SAMPLE_BYTES = 64 << 20  # of those texts, UTF-8 bytes in all, at most; shared evenly by the languages (one text each at least)
UNDETERMINED = "und"
_LEAD = b"\n" * ORDER  # what stands before every text


class Table:
    """An open-addressing hash table from uint64 keys to rows of costs."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(4, int(2 * max(len(keys), 1) - 1).bit_length() + 1)
        size = 1 << self.bits
        self.slots = np.full(size, -1, np.int32)
        self.keys, self.rows = keys, rows
        at, left = self._place(keys), np.arange(len(keys))
        self.reach = 0
        while len(left):
            self.reach += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several keys for a slot, one gets it
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (size - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._place(keys)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        for _ in range(self.reach):
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            now = self.slots[at[wrong]]
            found[wrong] = now
            wrong = wrong[(now >= 0) & (self.keys[now] != keys[wrong])]
        found[wrong] = -1
        return found


def grams(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each byte that belongs to a text (not to a lead), the byte and the `order` before it as one number."""
    key = np.zeros(len(data) - order if len(data) > order else 0, np.uint64)
    for k in range(order + 1):
        key = (key << np.uint64(8)) | data[k : len(data) - order + k].astype(np.uint64)
    return key


class Model:
    """Frozen statistics: languages, and per order the costs (in bits) of seen n-grams and of escapes."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages = sorted(texts)
        self.order = order
        m = len(self.languages)
        counts = []
        for language in self.languages:
            body = b"".join(b"\n" * order + t.lower() for t in texts[language])
            data = np.frombuffer(body, np.uint8)
            lead = np.zeros(len(data), bool)
            at = 0
            for t in texts[language]:
                lead[at : at + order] = True
                at += order + len(t)
            whole = grams(data, None, order)[~lead[order:]] if len(data) > order else np.zeros(0, np.uint64)
            counts.append([np.unique(whole & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(order + 1)])
        self.seen: list[Table] = []
        self.escape: list[Table] = []
        for k in range(order + 1):
            contexts = [np.unique(counts[i][k][0] >> np.uint64(8), return_inverse=True) for i in range(m)]
            all_contexts = np.unique(np.concatenate([c for c, _ in contexts])) if m else np.zeros(0, np.uint64)
            cost = np.zeros((len(all_contexts), m), np.float32)
            whole = [np.bincount(inverse, weights=counts[i][k][1]) for i, (_, inverse) in enumerate(contexts)]
            kinds = [np.bincount(inverse) for _, inverse in contexts]
            for i in range(m):
                cost[np.searchsorted(all_contexts, contexts[i][0]), i] = -np.log2(kinds[i] / (whole[i] + kinds[i]))
            self.escape.append(Table(all_contexts, cost))
            keys = np.unique(np.concatenate([counts[i][k][0] for i in range(m)])) if m else np.zeros(0, np.uint64)
            rows = np.full((len(keys), m), -1, np.float32)
            for i in range(m):
                c, n = counts[i][k]
                inverse = contexts[i][1]
                rows[np.searchsorted(keys, c), i] = -np.log2(n / (whole[i] + kinds[i])[inverse])
            for i in range(m):
                missing = np.flatnonzero(rows[:, i] < 0)
                rows[missing, i] = self._shorter(keys[missing], k)[:, i]
            self.seen.append(Table(keys, rows))

    def _shorter(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Costs of n-grams of order k that no context of order k saw: the escape and the next shorter order."""
        m = len(self.languages)
        at = self.escape[k].find(keys >> np.uint64(8))
        cost = np.where((at >= 0)[:, None], self.escape[k].rows[at] if len(self.escape[k].rows) else 0, 0).astype(np.float32) if m else np.zeros((len(keys), 0), np.float32)
        return cost + (self.costs(keys & np.uint64((1 << 8 * k) - 1), k - 1) if k else np.float32(8))

    def costs(self, keys: np.ndarray, k: int) -> np.ndarray:
        found = self.seen[k].find(keys)
        out = self.seen[k].rows[found] if len(self.seen[k].rows) else np.zeros((len(keys), len(self.languages)), np.float32)
        none = np.flatnonzero(found < 0)
        if len(none):
            out[none] = self._shorter(keys[none], k)
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in bits, by language (float64)."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        out = np.zeros((n, len(self.languages)))
        padded = np.full(len(data) + n * self.order, 10, np.uint8)
        own = np.arange(len(data)) + self.order * (np.repeat(np.arange(n), size) + 1)
        padded[own] = hashing.LOWER[data]
        if len(data):
            cost = self.costs(grams(padded, None, self.order)[own - self.order], self.order)
            full = np.flatnonzero(size)
            out[full] = np.add.reduceat(cost, offsets[full], axis=0, dtype=np.float64)
        return out


def decide(model: Model, lengths: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score: the winner's share if all languages are alike beforehand. Ties go to the first name."""
    if not model.languages:
        return [UNDETERMINED] * len(lengths), np.zeros(len(lengths))
    best = lengths.argmin(axis=1)
    gap = lengths - lengths.min(axis=1, keepdims=True)
    share = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
    named = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
    return named, np.where(lettered, share, 0.0)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE_IN_ALL, order: int = ORDER) -> Model:
    """Fit on at most `per_language` whole texts of each language, and on `most` in all (fewer a language, one at
    least, where there are many languages): those that come first in a hashed order of `key` and
    text, as far as SAMPLE_BYTES goes. Rows with a null text or language are left out; rows that share a key are taken one by
    one, those that share key and text once. The ranked and bounded sample, which no repetition makes longer, is the
    only thing collected."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    counts = checkpoint(rows.groupBy("lang", "h").count().groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")))
    languages = counts.count()
    if not languages:
        return Model({}, order)
    wanted = max(1, min(per_language, most // languages))
    # a share that leaves about twice the wanted rows, and the first row in any case; then the first of them by the hash
    share = F.col("h").cast("double") / 2.0**64 + 0.5 <= F.lit(2.0 * wanted) / F.col("n")
    near = rows.join(F.broadcast(counts) if languages <= most else counts, "lang").where(share | (F.col("h") == F.col("least")))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))  # a row that repeats sends one a task
    ahead = Window.partitionBy("lang").orderBy("h")
    ranked = once.withColumn("r", F.row_number().over(ahead)).withColumn("bytes", F.sum(F.octet_length("text")).over(ahead))
    first = ranked.where((F.col("r") <= wanted) & ((F.col("bytes") <= SAMPLE_BYTES // languages) | (F.col("r") == 1)))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(first.select("lang", "r", "text").collect()):
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return Model(texts, order)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score (0 to 1) of every whole text.

    A null text, an empty one and one without a letter get `und` and score 0, as does every text when nothing
    was learnt. ASCII letters count as lower case. Rows come through one to one; columns outside `keep` are
    dropped. One map over the scan; the model's size depends on its bounded sample alone."""
    ship(docs.sparkSession)
    part = spread(docs.select(*keep, F.col(text).cast("string").alias("__text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "lang_pred", "score"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]), "lang_pred string", "score double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            data, offsets = hashing.buffers(column)
            for a, b in hashing.runs(offsets, hashing.CHUNK_BYTES // 2):
                lengths = frozen.lengths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lettered = np.fromiter(map(has_letter, column.slice(a, b - a).to_pylist()), bool, b - a)
                named, score = decide(frozen, lengths, lettered)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), pa.array(named, pa.string()), pa.array(score, pa.float64())], names)

    return part.mapInArrow(tidy(run), schema)
