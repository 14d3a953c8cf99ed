"""Distributions and their inverses. Closed forms are Columns; special functions run as vectorized pandas UDFs over
numpy arrays: the incomplete gamma and beta functions by series and continued fractions, inverses by bisection."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.value import NUM, Val, as_bool, as_number, errors, finite, function, lift


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(x)


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: math.lgamma(v) if v > 0 else math.nan, otypes=[float])(x)


def once_each(f: Callable[..., np.ndarray], xs: list[np.ndarray]) -> np.ndarray:
    """f of rows, called with each different row once."""
    varied = [x.view(np.int64) for x in map(np.ascontiguousarray, xs) if len(x) and np.any(x.view(np.int64) != x.view(np.int64)[0])]
    if not len(xs[0]):
        return np.asarray(f(*xs), float)
    rows = np.zeros(len(xs[0]), np.int64)  # the number of a row among the different ones
    for x in varied:
        values, number = np.unique(x, return_inverse=True)
        rows = np.unique(rows * len(values) + number, return_inverse=True)[1]
    _, first, back = np.unique(rows, return_index=True, return_inverse=True)
    return np.asarray(f(*(x[first] for x in xs)), float)[back]


def vectorized(f: Callable[..., np.ndarray]) -> Callable[..., Column]:
    """A Column function from one over numpy arrays; a null argument gives a null."""

    def apply(*cols: Column) -> Column:
        @F.pandas_udf("double")
        def run(*parts: pd.Series) -> pd.Series:
            xs = [p.to_numpy(float, na_value=np.nan) for p in parts]
            with np.errstate(all="ignore"):
                return pd.Series(once_each(f, xs))

        out = run(*(c.cast("double") for c in cols))
        return F.when(F.isnan(out), F.lit(None)).otherwise(out)

    return apply


def special(f: Callable[[float], float]) -> Callable[[Column], Column]:
    """A Column function from one of one float."""
    many = np.vectorize(lambda x: f(x) if x == x else math.nan, otypes=[float])
    return vectorized(many)


def settled(now: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Whether a series or fraction no longer changes but for its last bits; what is not a number never will."""
    return ~(np.abs(change) > np.abs(now) * 4e-16)


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularized lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    fine = (a > 0) & (x >= 0)
    low, high = fine & (x < a + 1), fine & (x >= a + 1)
    front = lambda a, x: np.exp(np.where(x > 0, a * np.log(np.maximum(x, 1e-300)) - x - _lgamma(a), -np.inf))
    out[low] = np.clip(gamma_series(a[low], x[low]) * front(a[low], x[low]), 0, 1)
    out[high] = np.clip(1 - front(a[high], x[high]) * gamma_fraction(a[high], x[high]), 0, 1)
    return out


def gamma_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    done, at = np.empty(len(a)), np.arange(len(a))
    term, total, n = 1 / a, 1 / a, a
    for _ in range(1000):
        if not len(at):
            break
        n = n + 1
        term = term * x / n
        total = total + term
        done[at] = total
        go = ~settled(total, term)
        if not go.all():
            at, term, total, n, x = at[go], term[go], total[go], n[go], x[go]
    return done


def gamma_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    done, at = np.empty(len(a)), np.arange(len(a))
    b = x + 1 - a
    c, d = np.full(a.shape, 1e300), 1 / b
    h = d
    done[:] = h
    for i in range(1, 1000):
        if not len(at):
            break
        an = -i * (i - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
        h, was = h * d * c, h
        done[at] = h
        go = ~settled(h, h - was)
        if not go.all():
            at, a, b, c, d, h = at[go], a[go], b[go], c[go], d[go], h[go]
    return done


def beta_i(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularized incomplete beta function."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    fine = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    x, a, b = np.where(fine, x, 0.5), np.where(fine, a, 1.0), np.where(fine, b, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    inner = (y > 0) & (y < 1)
    z = np.where(inner, y, 0.5)
    front = np.exp(p * np.log(z) + q * np.log1p(-z) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) / p
    h = beta_fraction(z.ravel(), p.ravel(), q.ravel()).reshape(z.shape)
    value = np.where(inner, front * h, np.where(y <= 0, 0.0, 1.0))
    return np.where(fine, np.clip(np.where(flip, 1 - value, value), 0, 1), np.nan)


def beta_fraction(z: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    done, at, tiny = np.empty(len(z)), np.arange(len(z)), 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 500):
        if not len(at):
            break
        was = h
        for n in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + n * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + n / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        done[at] = h
        go = ~settled(h, h - was)
        if not go.all():
            at, z, p, q, c, d, h = at[go], z[go], p[go], q[go], c[go], d[go], h[go]
    return done


def normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def halved(below: Callable, low: np.ndarray, high: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Ends that close in on where ``below`` (of middles) turns false, until no number lies between them."""
    for _ in range(steps):
        mid = (low + high) / 2
        if np.all(~((low < mid) & (mid < high))):
            break
        under = below(mid)
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return low, high


def bisected(cdf: Callable, low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Where a rising cdf reaches p; an upper end that is too low is doubled."""
    low, high = low.astype(float).copy(), high.astype(float).copy()
    for _ in range(200):
        short = cdf(high) < p
        if not np.any(short):
            break
        high = np.where(short, high * 2, high)
    low, high = halved(lambda mid: cdf(mid) < p, low, high)
    return (low + high) / 2


def normal_inverse(p: np.ndarray) -> np.ndarray:
    tail = np.minimum(p, 1 - p)
    z = bisected(lambda x: normal(x) - 0.5, np.zeros(len(p)), np.full(len(p), 8.0), 0.5 - tail)
    for _ in range(2):  # Newton steps on the tail, which keeps its digits
        z = z + (normal(-z) - tail) / (np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    return np.where(p < 0.5, -z, z)


def log_choose(n, k):
    return _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1)


def student(x, df):
    tail = 0.5 * beta_i(df / (df + x * x), df / 2, np.full(np.shape(df), 0.5))
    return np.where(x > 0, 1 - tail, tail)


def f_cdf(x, a, b):
    return beta_i(np.where(x > 0, a * x / (a * x + b), 0.0), a / 2, b / 2)


def binomial(k, n, p):
    pmf = np.exp(log_choose(n, k) + np.where(k > 0, k * np.log(np.maximum(p, 1e-300)), 0) + np.where(n > k, (n - k) * np.log1p(-np.minimum(p, 1 - 1e-16)), 0))
    return np.where(p <= 0, (k == 0) * 1.0, np.where(p >= 1, (k == n) * 1.0, pmf))


def binomial_cdf(k, n, p):
    return np.where(k >= n, 1.0, np.where(k < 0, 0.0, beta_i(1 - p, np.maximum(n - k, 1e-9), k + 1)))


def binomial_inverse(n, p, a):
    """The least k whose cumulated probability reaches a, by halving the range of k."""
    fine = (n >= 0) & (p >= 0) & (p <= 1) & (a == a)
    n, p, a = np.where(fine, np.floor(n), 0.0), np.where(fine, p, 0.5), np.where(fine, a, 0.5)
    low, high = np.full(len(n), -1.0), n.copy()  # short below, reached at n
    while np.any(high - low > 1):
        mid = np.floor((low + high) / 2)
        short = (binomial_cdf(mid, n, p) < a) & (mid > low)
        low, high = np.where(short, mid, low), np.where(short | (mid <= low), high, mid)
    return np.where(fine & (a <= 1), high, np.nan)


#: Terms of sums that are held at once.
TERMS = 1_000_000


def summed(pmf: Callable, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of pmf(place, row) from low to high; as many rows at once as ``TERMS`` terms hold."""
    out = np.full(len(low), np.nan)
    count = high - low + 1
    rows = np.flatnonzero(count < 10_000_001)
    out[rows] = 0.0
    rows = rows[count[rows] > 0]
    part = np.cumsum(count[rows]) // TERMS
    for one in np.split(rows, np.flatnonzero(np.diff(part)) + 1) if len(rows) else []:
        n = np.ceil(count[one]).astype(int)
        start = np.cumsum(n) - n
        row = np.repeat(one, n)
        out[one] = np.add.reduceat(pmf(low[row] + np.arange(len(row)) - np.repeat(start, n), row), start)
    return out


def hypergeometric(k, n, successes, size):
    return np.exp(log_choose(successes, k) + log_choose(size - successes, n - k) - log_choose(size, n))


def made(names: str, f, bad, least: int, most: int | None = None, flag: int | None = None, whole: tuple = (), fill: tuple = ()) -> None:
    """Register a distribution. ``flag`` is the place of the cumulative argument (given to f as 0 or 1), ``whole`` those
    that lose their fractions, ``fill`` the values of arguments left out; ``bad`` says where the outcome is #NUM!."""

    @function(*names.split(), least=least, most=most or least)
    def apply(*args):
        args = [*args, *(lift(x) for x in fill[len(args) - least :])] if fill else list(args)
        vals = [Val(as_bool(a).col.cast("double"), "number", as_bool(a).err) if i == flag else as_number(a) for i, a in enumerate(args)]
        cols = [F.when(v.col >= 0, F.floor(v.col)).otherwise(F.ceil(v.col)).cast("double") if i in whole else v.col for i, v in enumerate(vals)]
        out = vectorized(f)(*cols)
        own = F.when(F.coalesce(bad(*cols), F.lit(False)) | out.isNull(), NUM)
        return finite(out, errors(*vals, own=own))


no = lambda *_: F.lit(False)
either = lambda c, cdf, pdf: np.where(c != 0, cdf, pdf)
made("GAMMALN GAMMALN.PRECISE", lambda x: _lgamma(x), lambda x: x <= 0, 1)
made("GAMMA", np.vectorize(lambda x: math.gamma(x) if x == x and not (x <= 0 and x == math.floor(x)) and x < 171.7 else math.nan, otypes=[float]), no, 1)
made("NORM.DIST NORMDIST", lambda x, m, s, c: either(c, normal((x - m) / s), np.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi))), lambda x, m, s, c: s <= 0, 4, flag=3)
made("NORM.INV NORMINV", lambda p, m, s: m + s * normal_inverse(p), lambda p, m, s: (p <= 0) | (p >= 1) | (s <= 0), 3)
made("NORM.S.DIST", lambda z, c: either(c, normal(z), np.exp(-z * z / 2) / math.sqrt(2 * math.pi)), no, 2, flag=1)
made("NORMSDIST", lambda z: normal(z), no, 1)
made("NORM.S.INV NORMSINV", normal_inverse, lambda p: (p <= 0) | (p >= 1), 1)
made("GAUSS", lambda z: normal(z) - 0.5, no, 1)
made("LOGNORM.DIST", lambda x, m, s, c: either(c, normal((np.log(x) - m) / s), np.exp(-(((np.log(x) - m) / s) ** 2) / 2) / (x * s * math.sqrt(2 * math.pi))), lambda x, m, s, c: (x <= 0) | (s <= 0), 4, flag=3)
made("LOGNORMDIST", lambda x, m, s: normal((np.log(x) - m) / s), lambda x, m, s: (x <= 0) | (s <= 0), 3)
made("LOGNORM.INV LOGINV", lambda p, m, s: np.exp(m + s * normal_inverse(p)), lambda p, m, s: (p <= 0) | (p >= 1) | (s <= 0), 3)
bad_binomial = lambda k, n, p, *_: (k < 0) | (k > n) | (p < 0) | (p > 1)
made("BINOM.DIST BINOMDIST", lambda k, n, p, c: either(c, binomial_cdf(k, n, p), binomial(k, n, p)), bad_binomial, 4, flag=3, whole=(0, 1))
made("BINOM.DIST.RANGE", lambda n, p, a, b: binomial_cdf(np.where(b != b, a, b), n, p) - binomial_cdf(a - 1, n, p), lambda n, p, a, b: (p < 0) | (p > 1) | (a < 0) | (a > n), 3, 4, whole=(0, 2, 3), fill=(float("nan"),))
made("BINOM.INV CRITBINOM", binomial_inverse, lambda n, p, a: (n < 0) | (p < 0) | (p > 1) | (a <= 0) | (a >= 1), 3, whole=(0,))
negative = lambda f, r, p: np.exp(log_choose(f + r - 1, f) + r * np.log(p) + f * np.log1p(-p))
made("NEGBINOM.DIST", lambda f, r, p, c: either(c, beta_i(p, r, f + 1), negative(f, r, p)), lambda f, r, p, c: (f < 0) | (r < 1) | (p <= 0) | (p >= 1), 4, flag=3, whole=(0, 1))
made("NEGBINOMDIST", negative, lambda f, r, p: (f < 0) | (r < 1) | (p <= 0) | (p >= 1), 3, whole=(0, 1))
bad_hyper = lambda k, n, s, t, *_: (k < 0) | (k > n) | (k > s) | (n > t) | (s > t) | (n - k > t - s)
made("HYPGEOM.DIST", lambda k, n, s, t, c: either(c, summed(lambda j, i: np.nan_to_num(hypergeometric(j, n[i], s[i], t[i])), np.maximum(0, n + s - t), k), hypergeometric(k, n, s, t)), bad_hyper, 5, flag=4, whole=(0, 1, 2, 3))
made("HYPGEOMDIST", hypergeometric, bad_hyper, 4, whole=(0, 1, 2, 3))
made("POISSON.DIST POISSON", lambda k, m, c: either(c, np.where(m == 0, 1.0, 1 - gamma_p(k + 1, m)), np.where(m == 0, (k == 0) * 1.0, np.exp(k * np.log(np.maximum(m, 1e-300)) - m - _lgamma(k + 1)))), lambda k, m, c: (k < 0) | (m < 0), 3, flag=2, whole=(0,))
made("GAMMA.DIST GAMMADIST", lambda x, a, b, c: either(c, gamma_p(a, x / b), np.exp((a - 1) * np.log(np.maximum(x, 1e-300)) - x / b - a * np.log(b) - _lgamma(a))), lambda x, a, b, c: (x < 0) | (a <= 0) | (b <= 0), 4, flag=3)
made("GAMMA.INV GAMMAINV", lambda p, a, b: b * bisected(lambda x: gamma_p(a, x), np.zeros(len(p)), np.maximum(a * 2, 1), p), lambda p, a, b: (p < 0) | (p >= 1) | (a <= 0) | (b <= 0), 3)
beta_pdf = lambda y, a, b, w: np.exp((a - 1) * np.log(y) + (b - 1) * np.log1p(-y) + _lgamma(a + b) - _lgamma(a) - _lgamma(b)) / w
made("BETA.DIST", lambda x, a, b, c, lo, hi: either(c, beta_i((x - lo) / (hi - lo), a, b), beta_pdf((x - lo) / (hi - lo), a, b, hi - lo)), lambda x, a, b, c, lo, hi: (a <= 0) | (b <= 0) | (x < lo) | (x > hi) | (lo >= hi), 4, 6, flag=3, fill=(0.0, 1.0))
made("BETADIST", lambda x, a, b, lo, hi: beta_i((x - lo) / (hi - lo), a, b), lambda x, a, b, lo, hi: (a <= 0) | (b <= 0) | (x < lo) | (x > hi) | (lo >= hi), 3, 5, fill=(0.0, 1.0))
made("BETA.INV BETAINV", lambda p, a, b, lo, hi: lo + (hi - lo) * bisected(lambda x: beta_i(np.minimum(x, 1), a, b), np.zeros(len(p)), np.ones(len(p)), p), lambda p, a, b, lo, hi: (p <= 0) | (p >= 1) | (a <= 0) | (b <= 0) | (lo >= hi), 3, 5, fill=(0.0, 1.0))
bad_chi = lambda x, d, *_: (x < 0) | (d < 1)
chi_inverse = lambda p, d: 2 * bisected(lambda x: gamma_p(d / 2, x), np.zeros(len(p)), np.maximum(d, 1), p)
made("CHISQ.DIST", lambda x, d, c: either(c, gamma_p(d / 2, x / 2), np.exp((d / 2 - 1) * np.log(np.maximum(x, 1e-300)) - x / 2 - d / 2 * math.log(2) - _lgamma(d / 2))), bad_chi, 3, flag=2, whole=(1,))
made("CHISQ.DIST.RT CHIDIST", lambda x, d: 1 - gamma_p(d / 2, x / 2), bad_chi, 2, whole=(1,))
made("CHISQ.INV", chi_inverse, lambda p, d: (p < 0) | (p >= 1) | (d < 1), 2, whole=(1,))
made("CHISQ.INV.RT CHIINV", lambda p, d: chi_inverse(1 - p, d), lambda p, d: (p <= 0) | (p > 1) | (d < 1), 2, whole=(1,))
bad_f = lambda x, a, b, *_: (x < 0) | (a < 1) | (b < 1)
f_pdf = lambda x, a, b: np.exp(a / 2 * np.log(a) + b / 2 * np.log(b) + (a / 2 - 1) * np.log(np.maximum(x, 1e-300)) - (a + b) / 2 * np.log(a * x + b) - (_lgamma(a / 2) + _lgamma(b / 2) - _lgamma((a + b) / 2)))
f_inverse = lambda p, a, b: bisected(lambda x: f_cdf(x, a, b), np.zeros(len(p)), np.ones(len(p)), p)
made("F.DIST", lambda x, a, b, c: either(c, f_cdf(x, a, b), f_pdf(x, a, b)), bad_f, 4, flag=3, whole=(1, 2))
made("F.DIST.RT FDIST", lambda x, a, b: 1 - f_cdf(x, a, b), bad_f, 3, whole=(1, 2))
made("F.INV", f_inverse, lambda p, a, b: (p < 0) | (p >= 1) | (a < 1) | (b < 1), 3, whole=(1, 2))
made("F.INV.RT FINV", lambda p, a, b: f_inverse(1 - p, a, b), lambda p, a, b: (p <= 0) | (p > 1) | (a < 1) | (b < 1), 3, whole=(1, 2))
t_pdf = lambda x, d: np.exp(_lgamma((d + 1) / 2) - _lgamma(d / 2)) / np.sqrt(d * math.pi) * (1 + x * x / d) ** (-(d + 1) / 2)


def t_inverse(p, d):
    upper = np.maximum(p, 1 - p)
    x = bisected(lambda t: student(t, d), np.zeros(len(p)), np.ones(len(p)), upper)
    return np.where(p < 0.5, -x, x)


made("T.DIST", lambda x, d, c: either(c, student(x, d), t_pdf(x, d)), lambda x, d, c: d < 1, 3, flag=2, whole=(1,))
made("T.DIST.RT", lambda x, d: 1 - student(x, d), lambda x, d: d < 1, 2, whole=(1,))
made("T.DIST.2T", lambda x, d: 2 * (1 - student(x, d)), lambda x, d: (d < 1) | (x < 0), 2, whole=(1,))
made("TDIST", lambda x, d, t: t * (1 - student(x, d)), lambda x, d, t: (d < 1) | (x < 0) | ~t.isin(1.0, 2.0), 3, whole=(1, 2))
made("T.INV", t_inverse, lambda p, d: (p <= 0) | (p >= 1) | (d < 1), 2, whole=(1,))
made("T.INV.2T TINV", lambda p, d: t_inverse(1 - p / 2, d), lambda p, d: (p <= 0) | (p > 1) | (d < 1), 2, whole=(1,))
bad_confidence = lambda a, s, n: (a <= 0) | (a >= 1) | (s <= 0) | (n < 1)
made("CONFIDENCE.NORM CONFIDENCE", lambda a, s, n: normal_inverse(1 - a / 2) * s / np.sqrt(n), bad_confidence, 3, whole=(2,))
made("CONFIDENCE.T", lambda a, s, n: t_inverse(1 - a / 2, n - 1) * s / np.sqrt(n), lambda a, s, n: bad_confidence(a, s, n) | (n < 2), 3, whole=(2,))


def closed(names: str, f, bad, count: int, flag: int | None = None) -> None:
    """A distribution that is a Column expression."""

    @function(*names.split(), least=count, most=count)
    def apply(*args):
        vals = [as_bool(a) if i == flag else as_number(a) for i, a in enumerate(args)]
        cols = [v.col for v in vals]
        wrong = bad(*cols)
        return finite(F.when(~wrong, f(*cols)), errors(*vals, own=F.when(wrong, NUM)))


closed("PHI", lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi), lambda z: F.lit(False), 1)
closed("EXPON.DIST EXPONDIST", lambda x, r, c: F.when(c, 1 - F.exp(-r * x)).otherwise(r * F.exp(-r * x)), lambda x, r, c: (x < 0) | (r <= 0), 3, 2)
closed("WEIBULL.DIST WEIBULL", lambda x, a, b, c: F.when(c, 1 - F.exp(-F.pow(x / b, a))).otherwise(a / F.pow(b, a) * F.pow(x, a - 1) * F.exp(-F.pow(x / b, a))), lambda x, a, b, c: (x < 0) | (a <= 0) | (b <= 0), 4, 3)
closed("STANDARDIZE", lambda x, m, s: (x - m) / F.when(s > 0, s), lambda x, m, s: s <= 0, 3)
closed("FISHER", lambda x: F.atanh(F.when(F.abs(x) < 1, x)), lambda x: F.abs(x) >= 1, 1)
closed("FISHERINV", lambda y: (F.exp(2 * y) - 1) / (F.exp(2 * y) + 1), lambda y: y > 354, 1)
