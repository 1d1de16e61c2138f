"""Theil-Sen fits of large groups as a grouped aggregate.

The median of all pairwise slopes without listing the pairs: a slope m splits the pairs
by the order of y - m * x, so the number of slopes up to m is a number of inversions, which
is counted level by level as in a merge sort. An interval around the median, first guessed from
a sample of pairs, is halved until few enough slopes are left in it; these alone are listed.
O(n log n) for each halving, O(n) memory. Equal to the pairwise median but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Slopes that are listed at the end, for each sample, at least and at most; sampled pairs of the first guess; elements of a merge step in memory at once.
LISTED, LEAST_LISTED, MOST_LISTED, GUESSES, STEP = 4, 200_000, 2_000_000, 4_096, 1 << 20
#: Groups up to this size are fitted many at once.
SMALL, SMALL_PAIRS = 48, 2_000_000


def _merge_levels(rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A merge sort of rank (a permutation), level by level in steps: left elements in block order, for each right element the first and last place of greater lefts in its block, and the right elements."""
    n, width = len(rank), 1
    a = rank.astype(np.int32 if n < 2**31 else np.int64)
    while width < n:
        block = 2 * width
        span = block * max(1, STEP // block)
        for begin in range(0, n, span):
            end = min(n, begin + span)
            if span == block:  # one block: its halves are sorted
                lefts = a[begin : begin + width]
                for at in range(begin + width, end, STEP):
                    rights = a[at : min(end, at + STEP)]
                    yield lefts, np.searchsorted(lefts, rights), np.full(len(rights), len(lefts)), rights
                a[begin:end].sort(kind="stable")
                continue
            place = np.arange(end - begin)
            keys = place // block * n + a[begin:end]
            is_left = place % block < width
            lefts, rights = keys[is_left], keys[~is_left]
            high = np.minimum((rights // n + 1) * width, len(lefts))
            yield lefts % n, np.searchsorted(lefts, rights), high, rights % n
            keys.sort(kind="stable")
            a[begin:end] = keys % n
        width = block


def _inversions(rank: np.ndarray) -> int:
    return sum(int((high - low).sum()) for _, low, high, _ in _merge_levels(rank))


def _ranks(r: np.ndarray) -> np.ndarray:
    """Places in the order of r; of equal ones the later sample comes first."""
    n = len(r)
    out = np.empty(n, np.int32 if n < 2**31 else np.int64)
    out[n - 1 - np.argsort(r[::-1], kind="stable")] = np.arange(n, dtype=out.dtype)
    return out


def _pairs_within(starts: np.ndarray, n: int) -> int:
    """Pairs inside the runs that begin at starts."""
    runs = np.diff(np.append(np.flatnonzero(starts), n))
    return int((runs.astype(object) * (runs.astype(object) - 1) // 2).sum()) if len(runs) < 1000 else sum(int(k) * (int(k) - 1) // 2 * int(c) for k, c in zip(*np.unique(runs, return_counts=True)))


def median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """Median of (y_j - y_i) / (x_j - x_i) over the pairs of different x; 0 without one."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    order = np.lexsort((y, x))
    x, y = x[order] - (x[order[0]] if len(x) else 0), y[order]
    n = len(x)
    new_x = np.append(True, x[1:] != x[:-1])[:n]
    pairs = n * (n - 1) // 2 - _pairs_within(new_x, n)
    if not pairs:
        return 0.0
    repeats = _pairs_within(new_x | np.append(True, y[1:] != y[:-1])[:n], n)
    del order, new_x
    k1, k2 = (pairs - 1) // 2, pairs // 2
    if n * (n - 1) // 2 <= LEAST_LISTED:
        i, j = np.triu_indices(n, 1)
        keep = x[i] < x[j]
        return float(np.median((y[j] - y[i])[keep] / (x[j] - x[i])[keep]))

    def up_to(m: float) -> int:
        return _inversions(_ranks(y - m * x)) - repeats

    rng = np.random.default_rng(7)
    i, j = rng.integers(0, n, (2, 4 * GUESSES))
    i, j = np.minimum(i, j), np.maximum(i, j)
    keep = x[i] < x[j]
    guess = np.sort((y[j] - y[i])[keep] / (x[j] - x[i])[keep])
    lo, hi = (float(guess[len(guess) * 48 // 100]), float(guess[min(len(guess) - 1, len(guess) * 52 // 100)])) if len(guess) else (0.0, 0.0)
    step = max(hi - lo, abs(lo) * 1e-9, 1e-12)
    below, within = up_to(lo), 0
    while below > k1:
        lo, step = lo - step, 2 * step
        below = up_to(lo)
    above = up_to(hi)
    while above <= k2:
        hi, step = hi + step, 2 * step
        above = up_to(hi)
    within = above - below
    while within > max(min(LISTED * n, MOST_LISTED), LEAST_LISTED):
        middle = lo + (hi - lo) / 2
        if not lo < middle < hi:
            return hi  # all that are left are equal
        count = up_to(middle)
        if count <= k1:
            lo, below = middle, count
        elif count > k2:
            hi = middle
        else:  # the two middle slopes lie on both sides
            return (_extreme(x, y, lo, middle, max) + _extreme(x, y, middle, hi, min)) / 2
        within = up_to(hi) - below
    slopes = np.sort(_slopes_between(x, y, lo, hi))
    return float((slopes[k1 - below] + slopes[k2 - below]) / 2)


def _slopes_between(x: np.ndarray, y: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The slopes above lo and up to hi: pairs whose order by y - m * x turns between both."""
    first = np.argsort(_ranks(y - lo * x))
    later = _ranks(y - hi * x)
    who = np.argsort(later)
    out = []
    for lefts, low, high, rights in _merge_levels(later[first]):
        n = high - low
        if not n.any():
            continue
        a = who[lefts[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
        b = who[np.repeat(rights, n)]
        keep = x[a] != x[b]
        out.append((y[b] - y[a])[keep] / (x[b] - x[a])[keep])
    return np.concatenate(out) if out else np.zeros(0)


def _extreme(x: np.ndarray, y: np.ndarray, lo: float, hi: float, which: type(max)) -> float:
    """The largest or least slope above lo and up to hi; the interval is halved towards it until its slopes can be listed."""
    def count(a: float, b: float) -> int:
        return _inversions(_ranks(y - b * x)) - _inversions(_ranks(y - a * x))

    while count(lo, hi) > max(min(LISTED * len(x), MOST_LISTED), LEAST_LISTED):
        middle = lo + (hi - lo) / 2
        if not lo < middle < hi:
            return hi
        upper = count(middle, hi) > 0 if which is max else count(lo, middle) == 0
        lo, hi = (middle, hi) if upper else (lo, middle)
    return float(which(_slopes_between(x, y, lo, hi)))


def fit_line(x: pd.Series, y: pd.Series) -> list[float]:
    """Slope, intercept (median of y - slope * x) and number of samples; those with a null or NaN are left out."""
    both = x.notna() & y.notna()
    a, b = x[both].to_numpy(np.float64), y[both].to_numpy(np.float64)
    if not len(a):
        return [0.0, float("nan"), 0.0]
    slope = median_slope(a, b)
    return [slope, float(np.median(b - slope * a)), float(len(a))]


def theil_sen(x: Column, y: Column) -> Column:
    """Aggregate: array of slope, intercept and number of samples. One group's samples are in one task: 16 bytes each."""

    @F.pandas_udf("array<double>")
    def fit(x: pd.Series, y: pd.Series) -> list:
        return fit_line(x, y)

    return fit(x.cast("double"), y.cast("double"))


def _fit_equal(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and intercepts of groups of one size, a row each, all finite."""
    i, j = np.triu_indices(x.shape[1], 1)
    dx = x[:, j] - x[:, i]
    slopes = np.sort(np.divide(y[:, j] - y[:, i], dx, out=np.full(dx.shape, np.nan), where=dx != 0), axis=1)
    count, at = (dx != 0).sum(axis=1), np.arange(len(x))
    slope = np.zeros(len(x))
    some = count > 0
    k, rows = count[some], at[some]
    slope[some] = (slopes[rows, (k - 1) // 2] + slopes[rows, k // 2]) / 2
    return slope, np.median(y - slope[:, None] * x, axis=1)


def fit_groups(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept and number of samples of the groups that begin at starts; the small ones of a size are fitted together."""
    sizes = np.diff(np.append(starts, len(x)))
    out = np.zeros((3, len(starts)))
    fine = np.minimum.reduceat(np.isfinite(x) & np.isfinite(y), starts) if len(starts) else np.zeros(0, bool)
    small = fine & (sizes <= SMALL)
    for size in np.unique(sizes[small]):
        which = np.flatnonzero(small & (sizes == size))
        step = max(1, SMALL_PAIRS // (size * size))
        for g in (which[k : k + step] for k in range(0, len(which), step)):
            rows = starts[g][:, None] + np.arange(size)
            out[0, g], out[1, g] = _fit_equal(x[rows], y[rows])
            out[2, g] = size
    for g in np.flatnonzero(~small):
        at = slice(starts[g], starts[g] + sizes[g])
        out[:, g] = fit_line(pd.Series(x[at]), pd.Series(y[at]))
    return out[0], out[1], out[2].astype(np.int64)


def fit_by_key(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, slope, intercept. One sort by key; a task streams its groups and holds one batch, or the samples (16 bytes each) of a group that is larger."""
    keys = list(keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("__x"))
    rows = points.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x is not null and __y is not null").withColumn("__new", number == 1)
    schema = StructType([*(points.schema[k] for k in keys), StructField("n", LongType()), StructField("slope", DoubleType()), StructField("intercept", DoubleType())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, xs, ys = None, [], []

        def done(key: pa.RecordBatch, x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            slope, intercept, n = fit_groups(x, y, starts)
            return pa.RecordBatch.from_arrays([*key.columns, pa.array(n), pa.array(slope), pa.array(intercept)], names=[*keys, "n", "slope", "intercept"])

        for b in batches:
            a, c = b.column("__x").to_numpy(), b.column("__y").to_numpy()
            starts = np.flatnonzero(b.column("__new").to_numpy(zero_copy_only=False))
            if not len(starts):
                xs.append(a)
                ys.append(c)
                continue
            if open_key is not None:
                xs.append(a[: starts[0]])
                ys.append(c[: starts[0]])
                yield done(open_key, np.concatenate(xs), np.concatenate(ys), np.zeros(1, int))
            head, last = b.select(keys), starts[-1]
            if len(starts) > 1:
                yield done(head.take(pa.array(starts[:-1])), a[starts[0] : last], c[starts[0] : last], starts[:-1] - starts[0])
            open_key, xs, ys = head.take(pa.array(starts[-1:])), [a[last:]], [c[last:]]
        if open_key is not None:
            yield done(open_key, np.concatenate(xs), np.concatenate(ys), np.zeros(1, int))

    return rows.mapInArrow(fit, schema)
