"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels come for documents; tokens are labelled from them: a token of a toxic document is toxic if one of its
features (the word, or one of its first or last characters) stands in a far larger share of toxic than of clean
documents, by a G-test corrected for the number of features tried. A two-state chain over tokens is then fitted to these
labels by gradient steps on the exact log-likelihood, with sums over all taggings by forward-backward. The
forward and backward products are 2 x 2 matrices and associative, so they are taken block by block over
whole batches, reset where a text begins. A text's score comes from its tokens' marginals (any, the likeliest, how
many, what share) by a logistic curve fitted on the documents' labels. The share ratio, the summary and the rounds were
chosen by four folds inside the training rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.session import ship, spread, tidy

SAMPLE_PER_LABEL = {1: 1200, 0: 3000}  # labelled texts that the model is fitted on, at most; the documented bound
SAMPLE_BYTES = 48 << 20  # of those texts, the first in their hashed order that have at most so many UTF-8 bytes together a label (one text at least)
TIMES = 8  # a feature that marks toxic tokens has a share of toxic documents over so many times its share of clean ones
ROUNDS = 20
THRESHOLD = 0.3  # a score from here on is toxic
SPAN = 0.5  # a token with this marginal or more is part of an offending span
_WORD = re.compile(r"[^\W_]+")
_CACHE = 1 << 17
_TOKENS_AT_ONCE = 100_000  # of the training sample, in one product


def features(word: str) -> list[str]:
    """The word and, for words long enough, its first 3 to 9 and last 4 and 5 characters."""
    out = [word]
    out += ["^" + word[:k] for k in range(3, 10) if len(word) > k]
    out += ["$" + word[-k:] for k in (4, 5) if len(word) > k]
    return out


def marginals(score: np.ndarray, first: np.ndarray, transition: np.ndarray, begin: np.ndarray, moves: bool = True) -> tuple[np.ndarray, float, np.ndarray | None]:
    """Probability that each token is toxic, the log of the sum over taggings, and (with `moves`) the expected transitions.

    `score`: each token's log-potential of being toxic (of not being: 0); `first`: True where a text begins;
    `transition[i, j]` and `begin[j]`: log-potentials."""
    n = len(score)
    if not n:
        return np.zeros(0), 0.0, np.zeros((2, 2))
    wide = max(1, min(2048, n // 32))
    deep = -(-n // wide)
    step = np.empty((wide * deep, 2, 2))
    step[n:] = np.eye(2)
    emit = np.exp(np.clip(score, -30, 30))
    step[:n] = np.exp(transition)
    step[:n][first] = np.exp(begin)
    step[:n, :, 1] *= emit[:, None]
    lanes = np.ascontiguousarray(step.reshape(wide, deep, 2, 2).transpose(1, 2, 3, 0))
    forward = np.empty_like(lanes)
    scale = np.zeros((deep, wide))

    def times(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.stack([[x[0, 0] * y[0, 0] + x[0, 1] * y[1, 0], x[0, 0] * y[0, 1] + x[0, 1] * y[1, 1]], [x[1, 0] * y[0, 0] + x[1, 1] * y[1, 0], x[1, 0] * y[0, 1] + x[1, 1] * y[1, 1]]])
        s = z.max(axis=(0, 1))
        return z / s, np.log(s)

    forward[0] = lanes[0]
    for j in range(1, deep):
        forward[j], scale[j] = times(forward[j - 1], lanes[j])
    alpha = np.empty((2, wide))
    now, log_sum = np.array([1.0, 0.0]), 0.0
    ends, lost = forward[-1].transpose(2, 0, 1), scale.sum(axis=0)
    for r in range(wide):
        alpha[:, r] = now
        now = now @ ends[r]
        total = now.sum()
        log_sum += float(np.log(total) + lost[r])
        now = now / total
    a = np.einsum("ir,dijr->djr", alpha, forward)
    a /= a.sum(axis=1, keepdims=True)
    backward = np.empty_like(lanes)  # product of the steps after a token to its lane's end
    backward[-1] = np.eye(2)[:, :, None]
    for j in range(deep - 2, -1, -1):
        backward[j], _ = times(lanes[j + 1], backward[j + 1])
    beta = np.empty((2, wide))
    now = np.array([1.0, 1.0])
    heads = times(lanes[0], backward[0])[0].transpose(2, 0, 1)
    for r in range(wide - 1, -1, -1):
        beta[:, r] = now
        now = heads[r] @ now
        now = now / now.sum()
    b = np.einsum("dijr,jr->dir", backward, beta)
    both = a * b
    flat = (both[:, 1] / both.sum(axis=1)).T.ravel()[:n]
    if not moves:
        return flat, log_sum, None
    before = a.transpose(2, 0, 1).reshape(-1, 2)[:n][:-1]
    after = b.transpose(2, 0, 1).reshape(-1, 2)[:n][1:]
    pair = before[:, :, None] * step[1:n] * after[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    inner = ~first[1:]
    return flat, log_sum, pair[inner].sum(axis=0)


class Model:
    """Weights of features and transitions, and the curve from marginals to a document's score."""

    def __init__(self, weights: dict[str, float], bias: float, transition: np.ndarray, begin: np.ndarray, curve: np.ndarray):
        self.weights, self.bias, self.transition, self.begin, self.curve = weights, bias, transition, begin, curve
        self.cache: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.weights, self.bias, self.transition, self.begin, self.curve)

    def potentials(self, words: list[str]) -> np.ndarray:
        cache, get = self.cache, self.weights.get
        if len(cache) > _CACHE:
            cache.clear()
        out = list(map(cache.get, words))
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    known = self.bias + sum(get(f, 0.0) for f in features(words[i]))
                    cache[words[i]] = out[i] = known
        return np.array(out, float)

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' marginals, and len+1 offsets of tokens by text."""
        split = [_WORD.findall(t.lower()) for t in texts]
        at = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        first = np.zeros(at[-1], bool)
        first[at[:-1][np.diff(at) > 0]] = True
        return marginals(self.potentials([w for ws in split for w in ws]), first, self.transition, self.begin, False)[0], at

    def score(self, marginal: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(marginal, at) @ self.curve, -50, 50)))


def summary(marginal: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: 1, the log-odds that any token is toxic, those of the likeliest token, and the logarithms of the
    expected number and share of toxic tokens, both smoothed."""
    rows = np.tile([1, -12, -12, -3, -6], (len(at) - 1, 1)).astype(float)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        clean = np.add.reduceat(np.log1p(-np.minimum(marginal, 1 - 1e-9)), at[full])  # log of the chance of no toxic token
        rows[full, 1] = np.clip(np.log(-np.expm1(np.minimum(clean, -1e-9))) - clean, -12, 12)
        top = np.clip(np.maximum.reduceat(marginal, at[full]), 1e-9, 1 - 1e-9)
        rows[full, 2] = np.clip(np.log(top / (1 - top)), -12, 12)
        expected = np.add.reduceat(marginal, at[full]) + 0.05
        rows[full, 3], rows[full, 4] = np.log(expected), np.log(expected / (np.diff(at)[full] + 20))
    return rows


def _g_test(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G statistic of a of n1 against b of n0; 0 where the share is not TIMES as high in the first."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (a + b) / (n1 + n0)
        terms = [np.where(o > 0, o * np.log(o / (n * q)), 0) for o, n, q in ((a, n1, p), (n1 - a, n1, 1 - p), (b, n0, p), (n0 - b, n0, 1 - p))]
    return np.where(a * n0 > TIMES * b * n1, 2 * sum(terms), 0)


def fresh(texts: list[str], most: float = 0.3) -> list[int]:
    """The texts that aren't copies or near copies of earlier ones: at most that share of a text's runs of three
    words was seen before. Copies would make every word of a toxic original look toxic."""
    seen: set[int] = set()
    out = []
    for i, t in enumerate(texts):
        w = _WORD.findall(t.lower())
        marks = [zlib.crc32(" ".join(x).encode()) for x in zip(w, w[1:], w[2:], strict=False)]  # alike in every process
        runs_ = {h for h in marks if not h % 4} or {zlib.crc32(" ".join(w).encode())}  # a quarter of the runs will do
        if sum(r in seen for r in runs_) <= most * len(runs_):
            out.append(i)
        seen |= runs_
    return out


def fit(texts: list[str], toxic: list[int], rounds: int = ROUNDS) -> Model:
    """Fit on whole texts with 0/1 labels, without copies. Without both labels, every score is the share of toxic texts."""
    chosen = fresh(texts)
    texts, toxic = [texts[i] for i in chosen], [toxic[i] for i in chosen]
    y = np.array(toxic, float)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    flat_curve = np.array([np.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -5.0, 0, 0, 0, 0])
    number: dict[str, int] = {}
    by_text = [np.fromiter((number.setdefault(w, len(number)) for w in _WORD.findall(t.lower())), np.int32) for t in texts]
    words = list(number)
    if not n1 or not n0 or not words:
        return Model({}, -10.0, np.zeros((2, 2)), np.zeros(2), flat_curve)
    tokens = np.concatenate(by_text)
    at = np.concatenate([[0], np.cumsum([len(w) for w in by_text])]).astype(np.int64)
    owner = np.repeat(np.arange(len(by_text)), np.diff(at))
    # features by hash: their texts would take most of the memory
    per_word = np.fromiter((len(features(w)) for w in words), np.int64, len(words))
    hashed, feature = np.unique(np.fromiter((xxhash.xxh64_intdigest(f) for w in words for f in features(w)), np.uint64, int(per_word.sum())), return_inverse=True)
    feature = feature.astype(np.int32)
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), per_word)
    of = np.split(feature, np.cumsum(per_word)[:-1])
    # document frequency of each feature among toxic and clean documents
    a, b = np.zeros(len(hashed)), np.zeros(len(hashed))
    for k, ws in enumerate(by_text):
        if len(ws):
            (a if y[k] else b)[np.unique(np.concatenate([of[w] for w in np.unique(ws).tolist()]))] += 1
    common = a + b >= 3
    telling = common & (_g_test(a, b, n1, n0) > 2 * np.log(2 * max(1, common.sum())))
    word_toxic = np.zeros(len(words), bool)
    word_toxic[word_of[telling[feature]]] = True
    gold = word_toxic[tokens] & (y[owner] == 1)
    first = np.zeros(len(tokens), bool)
    first[at[:-1][np.diff(at) > 0]] = True
    # features of fewer than three documents carry no weight
    used = np.cumsum(common) - 1
    of_word = common[feature]
    feature, word_of = used[feature[of_word]], word_of[of_word]
    hashed = hashed[common]
    del of
    # exact gradient of the conditional log-likelihood, with adaptive steps
    inner = ~first[1:]
    move = np.zeros((2, 2))
    np.add.at(move, (gold[:-1][inner].astype(int), gold[1:][inner].astype(int)), 1)
    start_gold = np.array([(~gold[first]).sum(), gold[first].sum()], float)
    theta = np.concatenate([np.zeros(len(hashed)), [-4.0], np.zeros(6)])  # feature weights, bias, transitions, begins
    square = np.zeros(len(theta))
    gold_words = np.bincount(tokens, weights=gold, minlength=len(words))
    cuts = np.unique(np.append(at[np.searchsorted(at, np.arange(0, at[-1], _TOKENS_AT_ONCE))], at[-1])).tolist()

    def parts(theta: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        per_word = np.bincount(word_of, weights=theta[feature], minlength=len(words)) + theta[len(hashed)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            p, _, moved = marginals(per_word[tokens[i:j]], first[i:j], theta[-6:-2].reshape(2, 2), theta[-2:])
            yield slice(i, j), p, moved

    for _ in range(rounds):
        expected, moved, started = np.zeros(len(words)), np.zeros((2, 2)), np.zeros(2)
        for part, p, m in parts(theta):
            expected += np.bincount(tokens[part], weights=p, minlength=len(words))
            moved += m
            started += [(1 - p[first[part]]).sum(), p[first[part]].sum()]
        gap = gold_words - expected
        gradient = np.concatenate([np.bincount(feature, weights=gap[word_of], minlength=len(hashed)), [gap.sum()], (move - moved).ravel(), start_gold - started])
        gradient -= np.concatenate([theta[: len(hashed)], np.zeros(1), theta[-6:]])
        square += gradient**2
        theta = theta + 0.7 * gradient / (np.sqrt(square) + 1e-6)
    weights, bias, transition, begin = theta[: len(hashed)], float(theta[len(hashed)]), theta[-6:-2].reshape(2, 2), theta[-2:]
    telling = dict(zip(hashed[np.abs(weights) > 0.02].tolist(), weights[np.abs(weights) > 0.02].tolist(), strict=True))
    model = Model({f: telling[h] for w in words for f in features(w) if (h := xxhash.xxh64_intdigest(f)) in telling}, bias, transition, begin, flat_curve)
    x = summary(np.concatenate([p for _, p, _ in parts(theta)]), at)
    curve = prior = np.array([0, 0.5, 0.5, 0, 0])
    for _ in range(100):  # Newton steps, none longer than one, with a penalty that keeps the curve finite
        q = 1 / (1 + np.exp(-np.clip(x @ curve, -50, 50)))
        step = np.linalg.solve((x.T * (q * (1 - q))) @ x + np.eye(5), x.T @ (y - q) - (curve - prior))
        curve = curve + step / max(1.0, float(np.linalg.norm(step)))
    model.curve = curve
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_label: dict[int, int] | None = None) -> Model:
    """Fit on at most `per_label` whole texts of each label, and on SAMPLE_BYTES of them: the labels that come first in
    a hashed order of `key` are drawn, and only their texts are fetched, so the documents are scanned and not
    shuffled. Labels other than 0 and 1, null keys and null texts are left out; a label given twice counts once; of
    several texts with one id, the one with the least hash is taken, so the bound holds whatever repeats. The bounded
    sample meets in one task, which fits the model; the model alone comes to the driver."""
    ship(docs.sparkSession)
    most = per_label or SAMPLE_PER_LABEL
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key), F.col(label).cast("int").alias("__y"), F.xxhash64(F.col(key)).alias("__h")).distinct()
    counts = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col(key), F.col(text).alias("__t")).where("__t is not null")
    drawn = None
    for k, n in sorted(counts.items()):
        near = rows.where((F.col("__y") == k) & ((F.col("__h").cast("double") / 2.0**64 + 0.5) <= min(1.0, 2 * most[k] / n)))
        chosen = near.orderBy("__h", key).limit(most[k])
        drawn = chosen if drawn is None else drawn.unionByName(chosen)
    if drawn is None:
        return fit([], [])
    met = texts.join(F.broadcast(drawn), key)  # at most per_label rows are broadcast
    ahead = Window.partitionBy("__y").orderBy("__h", key)
    sample = met.groupBy(key, "__y", "__h").agg(F.min(F.struct(F.xxhash64("__t").alias("h"), F.col("__t").alias("t"))).alias("x")).select(key, "__y", "__h", F.col("x.t").alias("__t"))
    # drawn rows are few; their texts are bounded here, before a task holds them
    sized = sample.withColumn("__n", F.sum(F.octet_length("__t")).over(ahead)).withColumn("__r", F.row_number().over(ahead))
    bounded = sized.where((F.col("__n") <= SAMPLE_BYTES) | (F.col("__r") == 1)).select("__y", "__h", "__t")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        held.sort(key=lambda r: (-r[0], *r[1:]))  # toxic texts first: of a toxic copy of a clean text, the toxic one counts
        model = pickle.dumps(fit([t for _, _, t in held], [y for y, _, _ in held]))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    fitted = bounded.repartition(1).mapInArrow(tidy(run), "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else fit([], [])  # none of the labels' documents is there


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of the text of each word of its lower case; a letter whose lower case is longer
    moves what stands behind it, and is mapped back."""
    low = text.lower()
    found = [m.span() for m in _WORD.finditer(low)]
    if len(low) == len(text):
        return found
    ends = np.cumsum([len(c.lower()) for c in text])
    return [(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b - 1, side="right")) + 1) for a, b in found]


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep`, score (0 to 1), predicted (1 from `threshold` on) and the offending spans, an array of
    (start, end) in code points of the text, of every whole text.

    A null or empty text, and one without a word, gets the score of a text whose tokens are all clean, and no
    spans. Rows come through one to one; columns outside `keep` are dropped. One map over the scan; the
    model's size depends on its bounded sample alone."""
    ship(docs.sparkSession)
    part = spread(docs.select(*keep, F.col(text).cast("string").alias("__text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "score", "predicted", "spans"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]), "score double, predicted int, spans array<struct<start:int,end:int>>"])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def spans(text: str, p: np.ndarray) -> list[dict]:
        return [{"start": a, "end": b} for (a, b), x in zip(word_spans(text), p.tolist(), strict=True) if x >= SPAN]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            _, offsets = hashing.buffers(column)
            for a, b in hashing.runs(offsets):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                marginal, at = frozen.tag(texts)
                value = frozen.score(marginal, at)
                marked = [spans(t, marginal[i:j]) if j > i and marginal[i:j].max() >= SPAN else [] for t, i, j in zip(texts, at.tolist(), at[1:].tolist(), strict=False)]
                out = [pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(marked, span_type)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), *out], names)

    return part.mapInArrow(tidy(run), schema)
