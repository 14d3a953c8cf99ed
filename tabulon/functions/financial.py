"""Financial functions: closed forms as Columns; root finding and depreciation schedules vectorized."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.dates import valid, year_fraction
from tabulon.functions.distributions import halved, vectorized
from tabulon.functions.value import DIV0, NUM, as_number, bind, errors, finite, function, lift


def money(names: str, f, bad=None, least: int = 3, most: int | None = None, fill: tuple = (), code: str = NUM) -> None:
    """Register a function of numbers; ``fill`` holds the values of arguments left out."""

    @function(*names.split(), least=least, most=most or least)
    def apply(*args):
        args = [*args, *(lift(x) for x in fill[len(args) - least :])] if fill else args
        vals = [as_number(a) for a in args]
        cols = [v.col for v in vals]
        wrong = F.lit(False) if bad is None else F.coalesce(bad(*cols), F.lit(False))
        out = f(*cols)
        return finite(F.when(~wrong, out), errors(*vals, own=F.when(wrong, code).when(out.isNull(), NUM)))


def growth(r: Column, n: Column) -> Column:
    return F.pow(1 + r, n)


def nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def fv(r, n, pmt, pv, due):
    g = growth(r, n)
    return F.when(r == 0, -(pv + pmt * n)).otherwise(-(pv * g + pmt * (1 + r * due) * (g - 1) / nonzero(r)))


def pmt(r, n, pv, fv_, due):
    g = growth(r, n)
    return F.when(r == 0, -(pv + fv_) / nonzero(n)).otherwise(-(pv * g + fv_) * r / nonzero((1 + r * due) * (g - 1)))


def ipmt(r, per, n, pv, fv_, due):
    return interest_of(r, per, pmt(r, n, pv, fv_, due), pv, due)


def interest_of(r, per, paid, pv, due):
    interest = fv(r, per - 1, paid, pv, due) * r
    return F.when((due != 0) & (per == 1), 0.0).when(due != 0, (fv(r, per - 2, paid, pv, due) - paid) * r).otherwise(interest)


money("FV", fv, None, 3, 5, (0.0, 0.0))
money("PV", lambda r, n, p, f, d: F.when(r == 0, -(f + p * n)).otherwise(-(f + p * (1 + r * d) * (growth(r, n) - 1) / nonzero(r)) / nonzero(growth(r, n))), None, 3, 5, (0.0, 0.0))
money("PMT", pmt, lambda r, n, *_: n == 0, 3, 5, (0.0, 0.0))
money("IPMT", ipmt, lambda r, per, n, *_: (per < 1) | (per > n), 4, 6, (0.0, 0.0))
money("PPMT", lambda r, per, n, pv, f, d: pmt(r, n, pv, f, d) - ipmt(r, per, n, pv, f, d), lambda r, per, n, *_: (per < 1) | (per > n), 4, 6, (0.0, 0.0))


def nper(r, p, pv, f, due):
    a = p * (1 + r * due) / nonzero(r)
    ratio = (a - f) / nonzero(a + pv)
    return F.when(r == 0, -(pv + f) / nonzero(p)).otherwise(F.ln(F.when(ratio > 0, ratio)) / F.ln(F.when((r > -1) & (r != 0), 1 + r)))


money("NPER", nper, None, 3, 5, (0.0, 0.0))
money("ISPMT", lambda r, per, n, pv: pv * r * (per / nonzero(n) - 1), lambda r, per, n, pv: n == 0, 4, code=DIV0)


def cumulated(f):
    """The sum of f(interest, payment) over periods; the payment is made out once."""

    def total(r, n, pv, start, end, due):
        steps = F.sequence(F.ceil(start).cast("int"), F.greatest(F.floor(end), F.ceil(start)).cast("int"))
        row = F.struct(r.alias("r"), pv.alias("pv"), due.alias("due"), steps.alias("steps"), n.alias("n"))
        paid = lambda w: bind(pmt(w["r"], w["n"], w["pv"], F.lit(0.0), w["due"]), lambda p: added(w, p))
        added = lambda w, p: F.aggregate(w["steps"], F.lit(0.0), lambda a, k: a + f(interest_of(w["r"], k.cast("double"), p, w["pv"], w["due"]), p))
        return bind(row, paid)

    return total


bad_cumulated = lambda r, n, pv, s, e, d: (r <= 0) | (n <= 0) | (pv <= 0) | (s < 1) | (e < s) | (e > n) | ~d.isin(0.0, 1.0)
money("CUMIPMT", cumulated(lambda interest, paid: interest), bad_cumulated, 6)
money("CUMPRINC", cumulated(lambda interest, paid: paid - interest), bad_cumulated, 6)
money("SLN", lambda c, s, n: (c - s) / nonzero(n), lambda c, s, n: n == 0, 3, code=DIV0)
money("SYD", lambda c, s, n, k: (c - s) * (n - k + 1) * 2 / nonzero(n * (n + 1)), lambda c, s, n, k: (n <= 0) | (k < 1) | (k > n), 4)
money("EFFECT", lambda r, n: F.pow(1 + r / F.floor(n), F.floor(n)) - 1, lambda r, n: (r <= 0) | (n < 1), 2)
money("NOMINAL", lambda r, n: (F.pow(1 + r, 1 / F.floor(n)) - 1) * F.floor(n), lambda r, n: (r <= 0) | (n < 1), 2)
money("RRI", lambda n, a, b: F.pow(b / nonzero(a), 1 / nonzero(n)) - 1, lambda n, a, b: (n <= 0) | (a == 0), 3)
money("PDURATION", lambda r, a, b: (F.ln(F.when(b > 0, b)) - F.ln(F.when(a > 0, a))) / F.ln(F.when(r > 0, 1 + r)), lambda r, a, b: (r <= 0) | (a <= 0) | (b <= 0), 3)


def places(fraction):
    return F.pow(F.lit(10.0), F.ceil(F.log10(F.when(fraction >= 1, F.floor(fraction)))))


cut = lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
money("DOLLARDE", lambda x, f: cut(x) + (x - cut(x)) * places(f) / F.when(f >= 1, F.floor(f)), lambda x, f: f < 1, 2)
money("DOLLARFR", lambda x, f: cut(x) + (x - cut(x)) * F.floor(f) / places(f), lambda x, f: f < 1, 2)


def dated(names: str, f, bad) -> None:
    """Settlement, maturity, two amounts and a basis."""
    wrong = lambda s, m, a, b, k: ~valid(s) | ~valid(m) | (s >= m) | (k < 0) | (k >= 5) | bad(a, b)
    money(names, lambda s, m, a, b, k: f(a, b, nonzero(year_fraction(s, m, F.floor(k)))), wrong, 4, 5, (0.0,))


positive = lambda a, b: (a <= 0) | (b <= 0)
dated("DISC", lambda price, redemption, y: (redemption - price) / redemption / y, positive)
dated("INTRATE", lambda invested, redemption, y: (redemption - invested) / invested / y, positive)
dated("RECEIVED", lambda invested, rate, y: invested / nonzero(1 - rate * y), positive)
dated("PRICEDISC", lambda rate, redemption, y: redemption * (1 - rate * y), positive)
dated("YIELDDISC", lambda price, redemption, y: (redemption - price) / price / y, positive)
dated("ACCRINTM", lambda rate, par, y: rate * par * y, positive)
bad_bill = lambda s, m, x: ~valid(s) | ~valid(m) | (m <= s) | (m - s > 366) | (x <= 0)
money("TBILLPRICE", lambda s, m, x: 100 * (1 - x * (F.floor(m) - F.floor(s)) / 360), bad_bill)
money("TBILLYIELD", lambda s, m, x: (100 - x) / x * 360 / nonzero(F.floor(m) - F.floor(s)), bad_bill)
money("TBILLEQ", lambda s, m, x: 365 * x / nonzero(360 - x * (F.floor(m) - F.floor(s))), bad_bill)


def root(f, low: np.ndarray, high: np.ndarray, steps: int = 200) -> np.ndarray:
    """Bisection where f changes its sign between the ends, which widen upwards at first; nan elsewhere."""
    low, high = low.astype(float).copy(), high.astype(float).copy()
    at_low = f(low)
    for _ in range(60):
        same = np.sign(f(high)) == np.sign(at_low)
        if not np.any(same):
            break
        high = np.where(same, high * 2, high)
    good = np.sign(f(high)) != np.sign(at_low)
    low, high = halved(lambda mid: np.sign(f(mid)) == np.sign(at_low), low, high, steps)
    return np.where(good, (low + high) / 2, np.nan)


def rate(n, p, pv, f, due, _):
    def balance(r):
        g = (1 + r) ** n
        flat = np.abs(r) < 1e-12
        return np.where(flat, pv + p * n + f, pv * g + p * (1 + r * due) * (g - 1) / np.where(flat, 1, r) + f)

    return root(balance, np.full(len(n), -0.999999), np.full(len(n), 10.0))


money("RATE", vectorized(rate), lambda n, *_: n <= 0, 3, 6, (0.0, 0.0, 0.1))


def ddb(cost, salvage, life, period, factor):
    before = cost * np.maximum(1 - factor / life, 0) ** (period - 1)
    before = np.maximum(before, np.minimum(salvage, cost))
    return np.maximum(np.minimum(before * np.minimum(factor / life, 1), before - salvage), 0)


money("DDB", vectorized(ddb), lambda c, s, n, k, f: (c < 0) | (s < 0) | (n <= 0) | (k < 1) | (k > n) | (f <= 0), 4, 5, (2.0,))


def db(cost, salvage, life, period, month):
    r = np.round(1 - (salvage / np.where(cost > 0, cost, 1)) ** (1 / life), 3)
    first = cost * r * month / 12
    left = (cost - first) * (1 - r) ** np.maximum(period - 2, 0)
    return np.where(cost <= 0, 0.0, np.where(period < 2, first, np.where(period > life, left * r * (12 - month) / 12, left * r)))


money("DB", vectorized(db), lambda c, s, n, k, m: (c < 0) | (s < 0) | (n <= 0) | (k < 1) | (m < 1) | (m > 12) | (k > n + F.when(m < 12, 1).otherwise(0)), 4, 5, (12.0,))


def vdb(cost, salvage, life, start, end, factor, straight):
    fine = ~np.isnan([cost, salvage, life, start, end, factor, straight]).any(axis=0)
    last = np.where(fine, np.minimum(np.ceil(end), np.ceil(life)), 0)
    book, out, at = cost.astype(float).copy(), np.where(fine, 0.0, np.nan), np.arange(len(cost))
    for k in itertools.count():
        at = at[last[at] > k]
        if not len(at):
            return out
        left, rest = np.maximum(book[at] - salvage[at], 0), life[at] - k
        declining = np.minimum(book[at] * factor[at] / life[at], left)
        line = np.where(rest > 0, left / np.where(rest > 0, rest, 1), 0)
        used = np.where((straight[at] != 0) | (declining >= line), declining, line)
        out[at] += used * np.maximum(0.0, np.minimum(end[at], k + 1) - np.maximum(start[at], k))
        book[at] -= used


money("VDB", vectorized(vdb), lambda c, s, n, a, b, f, x: (c < 0) | (s < 0) | (n <= 0) | (a < 0) | (b < a) | (b > n) | (f <= 0), 5, 7, (2.0, 0.0))
