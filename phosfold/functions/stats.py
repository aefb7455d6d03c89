"""Statistical column expressions, and the hypergeometric tail."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Below this the factorials are tabulated, from here on Stirling's series is exact to 1e-14.
_SMALL = 16
_FACTORIALS = np.array([math.lgamma(i + 1) for i in range(_SMALL)])


def nan_to_null(value: Column) -> Column:
    """Missing values as NULL: NaN would compare as the largest number."""
    return F.when(~F.isnan(value), value)


def log_factorials(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 1).astype(np.float64)
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    return np.where(n < _SMALL, _FACTORIALS[np.clip(n, 0, _SMALL - 1)], series)


def hypergeometric_tail(k: np.ndarray, m: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(X >= k) for n draws from m items of which g count.

    The first term comes from log factorials, the others from the ratio of neighbours. Above the
    mean the upper side is summed, below it the lower one, so the sum is always the smaller one; its
    terms fall away from there, and beyond nine standard deviations and some more they add nothing.
    """
    low, high, up = np.maximum(0, g + n - m), np.minimum(g, n), k * m > n * g
    i = np.where(up, k, k - 1)
    inside = (i >= low) & (i <= high)
    at = np.where(inside, i, low)
    f = log_factorials
    term = np.exp(f(g) - f(at) - f(g - at) + f(m - g) - f(n - at) - f(m - g - n + at) - f(m) + f(n) + f(m - n))
    term = np.where(inside, term, 0.0)
    total, share = term.copy(), g / np.maximum(m, 1)
    spread = np.sqrt(n * share * (1 - share) * (m - n) / np.maximum(m - 1, 1))
    left = np.minimum(np.where(up, high - at, at - low), np.ceil(9 * spread) + 30).astype(np.int64)
    order = np.argsort(-left, kind="stable")
    term, at, up_, g_, n_, m_, left = (x[order] for x in (term, at.astype(np.float64), up, g, n, m, left))
    sums = total[order]
    for step in range(int(left.max(initial=0))):
        many = int(np.searchsorted(-left, -step, side="left"))
        t, x, u = term[:many], at[:many], up_[:many]
        above = (g_[:many] - x) * (n_[:many] - x) / ((x + 1) * (m_[:many] - g_[:many] - n_[:many] + x + 1))
        below = x * (m_[:many] - g_[:many] - n_[:many] + x) / ((g_[:many] - x + 1) * (n_[:many] - x + 1))
        t *= np.where(u, above, below)
        x += np.where(u, 1, -1)
        sums[:many] += t
    total[order] = sums
    return np.where(k <= low, 1.0, np.where(k > high, 0.0, np.where(up, np.minimum(total, 1.0), np.maximum(1 - total, 0.0))))


def with_hypergeometric_tail(rows: DataFrame, name: str = "tail") -> DataFrame:
    """`rows` (k, m, degree, n, ...) with P(X >= k) for n draws from m items of which `degree` count.

    The sum runs over hundreds of terms whose number differs from row to row, which built-in functions
    would interpret term by term; it is done for a whole Arrow batch at a time.
    """

    def run(stream):
        for batch in stream:
            numbers = [batch.column(c).to_numpy().astype(np.int64) for c in ("k", "m", "degree", "n")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hypergeometric_tail(*numbers))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def with_largest_overlap(rows: DataFrame, name: str = "largest") -> DataFrame:
    """`rows` (m, degree, n, ...) with the largest overlap below the greatest one whose next overlap has a tail above zero, null without any.

    The tail falls with the overlap, so whole Arrow batches are bisected at once.
    """

    def run(stream):
        for batch in stream:
            m, g, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("m", "degree", "n"))
            low, high = np.zeros_like(m), np.minimum(g, n)  # the tail of `low` overlaps is above zero, that of `high` + 1 is not
            while (low < high).any():
                mid = (low + high + 1) // 2
                there = hypergeometric_tail(mid, m, g, n) > 0
                low, high = np.where(there, mid, low), np.where(there, high, mid - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low - 1, mask=low == 0)], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def erfc(x: Column) -> Column:
    """Complementary error function: a series near zero, a continued fraction in the tail."""
    square = x * x
    step = lambda a, k: F.struct((a["t"] * 2 * square / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * square / (2 * k + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("t"), x.alias("s")), step)["s"]
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * series
    size = F.greatest(F.abs(x), F.lit(1.0))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(0.0), lambda a, k: (k / 2.0) / (size + a))
    tail = F.exp(-size * size) / math.sqrt(math.pi) / (size + fraction)
    return F.when(F.abs(x) < 2, near).when(x > 0, tail).otherwise(2 - tail)


def normal_tail(z: Column) -> Column:
    """P(Z >= z) of the standard normal distribution."""
    return 0.5 * erfc(z / math.sqrt(2))


#: A sample of at most so many values without ties has an exact Mann-Whitney tail.
EXACT_UP_TO = 8


@lru_cache(64)
def _rank_sum_tails(few: int, many: int) -> np.ndarray:
    """P(U >= u) for u = 0 .. few * many, from the Gaussian binomial coefficient in whole numbers."""
    ways = np.zeros(few * many + 1, object)
    ways[0] = 1
    for i in range(1, few + 1):
        if many + i <= few * many:
            ways[many + i :] = ways[many + i :] - ways[: -(many + i)]
        for start in range(min(i, ways.size)):
            ways[start::i] = np.add.accumulate(ways[start::i])
    total = math.comb(few + many, few)
    return np.array([w / total for w in np.add.accumulate(ways[::-1])[::-1]], np.float64)


@F.pandas_udf(T.DoubleType())
def exact_rank_sum_tail(u: pd.Series, n: pd.Series, rest: pd.Series) -> pd.Series:
    """P(U >= u) of samples of n and `rest` values without ties; null for a null u."""
    out = np.full(len(u), np.nan)
    known = np.flatnonzero(u.notna().to_numpy())
    sides = np.sort(np.stack([n.to_numpy()[known], rest.to_numpy()[known]], axis=1).astype(np.int64), axis=1)
    values = u.to_numpy()[known].astype(np.int64)
    for few, many in np.unique(sides, axis=0):
        these = (sides == (few, many)).all(axis=1)
        out[known[these]] = _rank_sum_tails(int(few), int(many))[values[these]]
    return pd.Series(out)


def minus_log10(p: Column) -> Column:
    """-log10(p), infinite for 0."""
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log10(p))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
