"""Scalar expressions of the metric algebra: pass@k, expected reranking, score shaping, verdict texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def pass_at_k(n, c, k) -> Column:
    """1 - C(n-c, k) / C(n, k): the chance that k of n attempts, c of them passing, hold a passing one.

    Null where k is over n. A product of k factors, so an item may have any number of attempts."""
    n, c, k = _c(n), _c(c), _c(k)
    miss = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), F.lit(1.0), lambda a, i: a * ((n - c - i) / (n - i)))
    return F.when(n < k, None).when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - miss)


def log_gamma(x) -> Column:
    """ln Gamma of a whole number x >= 1: from a short table, and by Stirling's series from 64 on."""
    x = _c(x).cast("int")
    table = F.array(*[F.lit(math.lgamma(max(1, v))) for v in range(64)])
    series = (x - 0.5) * F.log(x.cast("double")) - x + 0.5 * math.log(2 * math.pi) + 1.0 / (12.0 * x) - 1.0 / (360.0 * F.pow(x.cast("double"), 3.0))
    return F.when(x < 64, F.get(table, x)).otherwise(series)


def log_binomial(n, k) -> Column:
    """ln C(n, k) for 0 <= k <= n, else null."""
    n, k = _c(n), _c(k)
    return F.when((k >= 0) & (k <= n), log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1))


def draw_weight(rank, size, n) -> Column:
    """C(size - rank, n - 1) / C(size, n): the chance that the attempt of that rank (from 1) is the best of n drawn; 0
    where too few rank below."""
    rank, size, n = _c(rank), _c(size), _c(n)
    return F.when(size - rank < n - 1, 0.0).otherwise(F.exp(log_binomial(size - rank, n - 1) - log_binomial(size, n)))


def shaped_score(score, cumulative_logprob, num_tokens, shape: str | None) -> Column:
    """The reward, optionally times the likelihood: None, 'unnormalized' or 'normalized' (by length)."""
    if shape is None:
        return _c(score)
    if shape == "unnormalized":
        return _c(score) * F.exp(_c(cumulative_logprob))
    if shape == "normalized":
        return _c(score) * F.exp(F.try_divide(_c(cumulative_logprob), _c(num_tokens)))
    raise ValueError(f"unknown shape {shape!r}")


def label_at_least(negative, positive) -> Column:
    """1 unless the negative score is higher; a tie is 1."""
    return F.when(_c(negative) > _c(positive), 0).otherwise(1)


def label_above(negative, positive) -> Column:
    """True only if the positive score is higher; a tie is False."""
    return _c(positive) > _c(negative)


def positive_share(negative, positive) -> Column:
    """Softmax of two logits, the positive part."""
    return 1.0 / (1.0 + F.exp(_c(negative) - _c(positive)))


def mean_logprob(logprobs) -> Column:
    """Mean of an array of token log-probabilities; null where it is empty."""
    p = _c(logprobs)
    return F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), F.size(p))


def to_time(text, pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    """A text's time by a pattern, without a zone; null where it does not fit."""
    return F.try_to_timestamp(_c(text), F.lit(pattern)).cast("timestamp_ntz")


def error_kind(output) -> Column:
    """The kind of a failing verdict's text."""
    o = _c(output)
    return (
        F.when(o.contains("Timeout"), "Timeout")
        .when((o.contains("expected") & o.contains("but got")) | o.contains("AssertionError"), "Failed")
        .when(o.contains("Failed to execute program:"), "Error")
        .otherwise("Exception")
    )


def time_limit(limit, default: int = 30, factor: int = 2) -> Column:
    """Seconds from a text such as '2.0 seconds' or '1 - 3 seconds' (the upper end): (whole seconds + 1) * factor."""
    s = _c(limit)
    number = F.when(s.contains("-"), F.split_part(F.trim(F.split_part(s, F.lit("-"), F.lit(2))), F.lit(" "), F.lit(1))).otherwise(F.split_part(F.trim(s), F.lit(" "), F.lit(1)))
    return F.when(s.isNull(), default).otherwise(F.coalesce((F.floor(number.try_cast("double")) + 1) * factor, F.lit(default))).cast("int")


def draws(n, size, least: int = 25, most: int = 100) -> Column:
    """How many random draws of n of `size` a Monte-Carlo estimate takes, as a column (see `permutations_for`)."""
    share = F.col(n) / F.col(size)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(most * (1 - share) + 1))).cast("long")


def permutations_for(n: int | None, size: int, least: int = 25, most: int = 100) -> int:
    """How many random draws of n of `size` a Monte-Carlo estimate takes."""
    share = 1.0 if n is None else n / size
    return max(least, min(most, int(most * (1 - share) + 1)))
