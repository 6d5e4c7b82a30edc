"""Probabilities and quantiles applied to summary rows (one row per fit or test)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

__all__ = ["f_upper_tail", "t_quantile", "normal_quantile", "rank_sum_p"]


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the regularised incomplete beta, modified Lentz."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            total = total * delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    return total


def beta_regularised(x, a, b) -> np.ndarray:
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    lg = np.vectorize(math.lgamma, otypes=[float])
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    flip = inside > (a + 1.0) / (a + b + 2.0)
    xx = np.where(flip, 1.0 - inside, inside)
    aa, bb = np.where(flip, b, a), np.where(flip, a, b)
    front = np.exp(lg(aa + bb) - lg(aa) - lg(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
    part = front * _beta_fraction(xx, aa, bb)
    out = np.where(flip, 1.0 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _f_tail(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return beta_regularised(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def _t_quantile(p, df) -> np.ndarray:
    """Positive-side quantile by bisection on the two-sided tail, then refined by halving."""
    p, df = np.broadcast_arrays(np.asarray(p, dtype=float), np.asarray(df, dtype=float))
    tail = 2.0 * (1.0 - p)
    lo, hi = np.zeros_like(df), np.full_like(df, 1e6)
    for _ in range(200):
        mid = (lo + hi) / 2.0
        above = _f_tail(mid * mid, np.ones_like(df), df) > tail
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2.0


@F.pandas_udf(DoubleType())
def _f_tail_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    ok = f.notna() & d1.notna() & d2.notna() & (d1 > 0) & (d2 > 0) & (f >= 0)
    out = pd.Series(np.nan, index=f.index)
    if ok.any():
        out[ok] = _f_tail(f[ok], d1[ok], d2[ok])
    return out.astype(object).where(ok, None)


@F.pandas_udf(DoubleType())
def _t_quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    ok = p.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=p.index)
    if ok.any():
        out[ok] = _t_quantile(p[ok], df[ok])
    return out.astype(object).where(ok, None)


def f_upper_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) with (d1, d2) degrees of freedom."""
    return _f_tail_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def t_quantile(p: float, df: Column) -> Column:
    """Student t quantile for p >= 0.5."""
    return _t_quantile_udf(F.lit(float(p)), df.cast("double"))


# Coefficients of Wichura's algorithm AS 241 (1988), numerator and
# denominator, highest power first.
AS241_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
     45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
     133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061,
     21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
     42.313330701600911252, 1.0),
)
AS241_MIDDLE = (
    (0.00077454501427834140764, 0.0227238449892691845833, 0.24178072517745061177,
     1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
     4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 0.0005475938084995344946, 0.0151986665636164571966,
     0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
     2.05319162663775882187, 1.0),
)
AS241_TAIL = (
    (2.01033439929228813265e-7, 0.0000271155556874348757815, 0.0012426609473880784386,
     0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
     5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 0.000018463183175100546818,
     0.0007868691311456132591, 0.0148753612908506148525, 0.13692988092273580531,
     0.59983220655588793769, 1.0),
)


def _ratio_of_polynomials(r: Column, tables) -> Column:
    sides = []
    for table in tables:
        acc = F.lit(table[0])
        for c in table[1:]:
            acc = acc * r + F.lit(c)
        sides.append(acc)
    return sides[0] / sides[1]


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile as a plain column expression; NULL outside (0, 1)."""
    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    tail = F.when(q < 0, p).otherwise(1.0 - p)
    r = F.sqrt(-F.log(tail))
    outer = F.when(r <= 5.0, _ratio_of_polynomials(r - 1.6, AS241_MIDDLE)).otherwise(
        _ratio_of_polynomials(r - 5.0, AS241_TAIL)
    )
    value = F.when(F.abs(q) <= 0.425, q * _ratio_of_polynomials(r0, AS241_CENTRE)).otherwise(
        F.when(q < 0, -outer).otherwise(outer)
    )
    return F.when((p > 0) & (p < 1), value)


def _rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """Number of ways to reach each rank-sum statistic 0..n1*n2 without ties."""
    ways = [np.zeros(n1 * n2 + 1) for _ in range(n1 + 1)]
    ways[0][0] = 1.0
    for rank in range(1, n1 + n2 + 1):
        for taken in range(min(rank, n1), 0, -1):
            # the taken-th smallest picked at this rank adds rank - taken to the statistic
            shift = rank - taken
            if shift <= n1 * n2:
                moved = np.zeros(n1 * n2 + 1)
                moved[shift:] = ways[taken - 1][: n1 * n2 + 1 - shift]
                ways[taken] = ways[taken] + moved
    return ways[n1]


def _exact_rank_sum_p(w: float, n1: int, n2: int) -> float:
    counts = _rank_sum_counts(n1, n2)
    total = counts.sum()
    at = int(round(w))
    tail = counts[at:].sum() if w > n1 * n2 / 2.0 else counts[: at + 1].sum()
    return min(2.0 * tail / total, 1.0)


@F.pandas_udf(DoubleType())
def _exact_rank_sum_udf(w: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    out = []
    for a, b, c in zip(w, n1, n2):
        out.append(None if pd.isna(a) else _exact_rank_sum_p(a, int(b), int(c)))
    return pd.Series(out, dtype=object)


def rank_sum_p(w: Column, n1: Column, n2: Column, tie_sum: Column, exact_below: int = 50) -> Column:
    """Two-sided p of the rank-sum statistic.

    Exact when both groups have fewer than ``exact_below`` rows and there are no
    ties, else the normal approximation with continuity and tie correction.
    ``tie_sum`` is the sum of t^3 - t over tied runs.
    """
    exact = (n1 < exact_below) & (n2 < exact_below) & (tie_sum == 0)
    n = (n1 + n2).cast("double")
    centred = w - n1 * n2 / 2.0
    sigma = F.sqrt((n1 * n2 / 12.0) * ((n + 1) - F.try_divide(tie_sum.cast("double"), n * (n - 1))))
    z = F.try_divide(F.abs(centred) - F.when(centred == 0, 0.0).otherwise(0.5), sigma)
    normal = 2.0 * _normal_upper_tail_udf(z)
    both = (n1 > 0) & (n2 > 0)
    return F.when(
        both,
        F.when(exact, _exact_rank_sum_udf(F.when(exact, w), n1, n2)).otherwise(F.least(normal, F.lit(1.0))),
    )


@F.pandas_udf(DoubleType())
def _normal_upper_tail_udf(z: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2.0)) for v in z], dtype=object
    )
