"""Student-t and binomial functions as columns.

Spark has no t distribution, so quantile and tail are Arrow batches over an
incomplete-beta routine.  They run on result tables: each distinct pair of
arguments in a batch is computed once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _beta_fraction(a, b, x, steps=400):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def _both_tails(t, df):
    """P(|T| > |t|)."""
    a, b = df / 2, np.full_like(df, 0.5)
    x = df / (df + t * t)
    log_b = np.array([math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q) for p, q in zip(a, b)])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - log_b)
        low = front * _beta_fraction(a, b, x) / a
        high = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return np.where(t == 0, 1.0, np.where(x < (a + 1) / (a + b + 2), low, high))


def _quantile(p, df):
    goal = 2 * np.minimum(p, 1 - p)
    lo, hi = np.zeros_like(p), np.full_like(p, 1e6)
    for _ in range(80):
        mid = (lo + hi) / 2
        far = _both_tails(mid, df) < goal
        hi, lo = np.where(far, mid, hi), np.where(far, lo, mid)
    q = (lo + hi) / 2
    return np.where(p >= 0.5, q, -q)


def _batched(fn, x: pd.Series, y: pd.Series) -> pd.Series:
    """``fn`` on the distinct pairs of a batch; NULL in, NULL out."""
    d = pd.DataFrame({"x": x.astype(float).to_numpy(), "y": y.astype(float).to_numpy()})
    u = d.dropna().drop_duplicates()
    if not len(u):
        return pd.Series(np.full(len(d), np.nan))
    u = u.assign(v=fn(u["x"].to_numpy(), u["y"].to_numpy()))
    return d.merge(u, on=["x", "y"], how="left")["v"]


@F.pandas_udf(T.DoubleType())
def _tails_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _batched(_both_tails, t, df)


@F.pandas_udf(T.DoubleType())
def _quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _batched(_quantile, p, df)


def t_two_sided(t, df) -> Column:
    """P(|T| > |t|)."""
    return _tails_udf(F.abs(_c(t).cast("double")), _c(df).cast("double"))


@F.pandas_udf(T.DoubleType())
def _normal_udf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(x / math.sqrt(2)), na_action="ignore").astype("float64")


def normal_two_sided(z) -> Column:
    """P(|Z| > |z|) of the standard normal distribution."""
    return _normal_udf(F.abs(_c(z).cast("double")))


def t_sf(t, df) -> Column:
    """P(T > t)."""
    half = t_two_sided(t, df) / 2
    return F.when(_c(t) >= 0, half).otherwise(F.lit(1.0) - half)


def t_ppf(p, df) -> Column:
    """Quantile."""
    return _quantile_udf(_c(p).cast("double"), _c(df).cast("double"))


def sign_p(k, n) -> Column:
    """Two-sided binomial test of ``k`` successes in ``n`` fair trials."""
    k, n = _c(k).cast("int"), _c(n).cast("int")
    low = F.least(k, n - k)
    idx = F.when(low >= 1, F.sequence(F.lit(1), F.greatest(low, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    unit = F.pow(F.lit(0.5), n.cast("double"))

    def add(acc, i):
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(idx, F.struct(unit.alias("term"), unit.alias("total")), add)["total"]
    return F.least(F.lit(1.0), 2 * total)
