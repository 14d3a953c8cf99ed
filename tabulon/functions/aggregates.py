"""Aggregates over a column of numbers, as Columns for ``agg``: texts, bools and blanks of a range do not count.

``aggregate(df, {...}, by)`` gives a row a group. An aggregate that has no value there is null; ``codes`` says which error
that stands for. Means, moments and sums combine map-side; order statistics use Spark's exact percentile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.value import DIV0, NUM

X = Callable[[Column], Column]



def spread(f) -> X:
    return lambda x: F.when(F.count(x) > 1, f(x))


def moment(f) -> X:
    """Null where all values are equal, before a division by zero."""
    return lambda x: F.when(F.max(x) > F.min(x), f(x))


n = F.count
skew_p = moment(F.skewness)
AGGREGATES: dict[str, tuple[X, str | None]] = {
    "SUM": (lambda x: F.coalesce(F.sum(x), F.lit(0.0)), None),
    "SUMSQ": (lambda x: F.coalesce(F.sum(x * x), F.lit(0.0)), None),
    "PRODUCT": (lambda x: F.coalesce(F.product(x), F.lit(0.0)), None),
    "COUNT": (n, None),
    "AVERAGE": (F.avg, DIV0),
    "MAX": (lambda x: F.coalesce(F.max(x), F.lit(0.0)), None),
    "MIN": (lambda x: F.coalesce(F.min(x), F.lit(0.0)), None),
    "MEDIAN": (F.median, NUM),
    "VAR.S": (spread(F.var_samp), DIV0),
    "VAR.P": (F.var_pop, DIV0),
    "STDEV.S": (spread(F.stddev_samp), DIV0),
    "STDEV.P": (F.stddev_pop, DIV0),
    "DEVSQ": (lambda x: F.var_pop(x) * n(x), NUM),
    "SKEW.P": (skew_p, DIV0),
    "SKEW": (lambda x: F.when(n(x) > 2, skew_p(x) * F.sqrt(n(x) * (n(x) - 1)) / (n(x) - 2)), DIV0),
    "KURT": (lambda x: F.when(n(x) > 3, moment(F.kurtosis)(x) * ((n(x) + 1) * (n(x) - 1) / ((n(x) - 2) * (n(x) - 3))) + 6 * (n(x) - 1) / ((n(x) - 2) * (n(x) - 3))), DIV0),
    "GEOMEAN": (lambda x: F.when(F.min(x) > 0, F.exp(F.avg(F.ln(F.when(x > 0, x))))), NUM),
    "HARMEAN": (lambda x: F.when(F.min(x) > 0, n(x) / F.sum(1 / F.when(x > 0, x))), NUM),
}
for _old, _new in {"VAR": "VAR.S", "VARP": "VAR.P", "STDEV": "STDEV.S", "STDEVP": "STDEV.P"}.items():
    AGGREGATES[_old] = AGGREGATES[_new]
#: Aggregates that take texts as 0 and bools as 0 or 1.
A_KINDS = {"AVERAGEA": "AVERAGE", "MAXA": "MAX", "MINA": "MIN", "VARA": "VAR.S", "VARPA": "VAR.P", "STDEVA": "STDEV.S", "STDEVPA": "STDEV.P"}
codes = {name: code for name, (_, code) in AGGREGATES.items()}


def agg(name: str, col: Column | str) -> Column:
    """An aggregate by name over a numeric column."""
    x = F.col(col) if isinstance(col, str) else col
    if name in A_KINDS:
        return AGGREGATES[A_KINDS[name]][0](F.when(x.isNotNull(), F.coalesce(x.try_cast("double"), F.lit(0.0))))
    return AGGREGATES[name][0](x.cast("double"))


def counta(col: Column | str) -> Column:
    return F.count(col)


def countblank(col: Column) -> Column:
    return F.count_if(col.isNull() | (col.cast("string") == ""))


def percentile_inc(x: Column, k: float) -> Column:
    return F.percentile(x, F.lit(k))


def percentile_exc(df: DataFrame, col: str, k: float, by: list[str] = ()) -> DataFrame:
    """Position k (n + 1) among the sorted values, interpolated; null outside of them. From counts of distinct values: a group
    is never held as one array."""
    counts = df.groupBy(*by, col).agg(F.count(col).alias("count"))
    group = Window.partitionBy(*by)
    at = F.lit(k) * (F.sum("count").over(group) + 1)
    end = F.sum("count").over(group.orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumns({"n": F.sum("count").over(group), "end": end, "at": at}).withColumn("low", F.floor("at"))
    value = lambda place: F.max(F.when((F.col("end") - F.col("count") < place) & (place <= F.col("end")), F.col(col)))
    a, b = value(F.col("low")), value(F.least(F.col("low") + 1, F.col("n")))
    inside = (F.max("at") >= 1) & (F.max("at") <= F.max("n"))
    return rows.groupBy(*by).agg(F.when(inside, a + (b - a) * (F.max("at") - F.max("low"))).alias("value"))


def quartile_inc(x: Column, q: int) -> Column:
    return percentile_inc(x, int(q) / 4)


def mode_sngl(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    """The most frequent value that occurs twice or more, the least of several; null (#N/A) if none does."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).count()
    best = F.max(F.when(F.col("count") > 1, F.struct("count", (-F.col(col)).alias("v"))))
    return counts.groupBy(*by).agg((-best["v"]).alias("mode"))


def mode_mult(df: DataFrame, col: str) -> DataFrame:
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).count()
    most = counts.agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), F.col("count") == F.col("most")).filter("most > 1").select(col)


def kth(df: DataFrame, col: str, k: int, largest: bool, by: list[str] = ()) -> DataFrame:
    """LARGE and SMALL: the k-th value. A top-k a group, pruned before the shuffle's sort; null (#NUM!) beyond the last."""
    order = F.col(col).desc() if largest else F.col(col).asc()
    if not by:
        top = df.select(col).filter(F.col(col).isNotNull()).orderBy(order).limit(k)
        return top.agg(F.when(F.count(col) == k, F.min(col) if largest else F.max(col)).alias("value"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.filter(F.col(col).isNotNull()).withColumn("_k", rank).filter(F.col("_k") == k).select(*by, F.col(col).alias("value"))


def avedev(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    """Mean distance from the group's mean: means first, then one pass over the rows."""
    means = df.groupBy(*by).agg(F.avg(col).alias("_mean"))
    joined = df.join(means, list(by)) if by else with_scalar(df, means)
    return joined.groupBy(*by).agg(F.avg(F.abs(F.col(col) - F.col("_mean"))).alias("avedev"))


def with_scalar(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a one-row table beside every row."""
    row = one.first()
    return df.withColumns({c: F.lit(row[c]) for c in one.columns})


def trimmean(df: DataFrame, col: str, share: float, by: list[str] = ()) -> DataFrame:
    """The mean without floor(n * share / 2) values at either end, from counts of distinct values: no group is sorted whole."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).count()
    order = Window.partitionBy(*by).orderBy(col)
    total = F.sum("count").over(Window.partitionBy(*by))
    end = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0))
    off = F.floor(F.col("n") * share / 2)
    kept = F.least(F.col("end"), F.col("n") - off) - F.greatest(F.col("end") - F.col("count"), off)
    rows = counts.withColumns({"n": total, "end": end}).withColumn("kept", F.greatest(kept, F.lit(0)))
    return rows.groupBy(*by).agg((F.sum(F.col(col) * F.col("kept")) / F.sum("kept")).alias("trimmean"))


def paired(x: Column, y: Column) -> dict[str, Column]:
    """Statistics of pairs (y depends on x); rows in which either is missing do not count."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    varied = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    r = F.when(varied, F.covar_pop(x, y) / F.when(sx * sy > 0, sx * sy))
    slope = F.when(F.max(x) > F.min(x), F.covar_pop(x, y) / F.when(F.var_pop(x) > 0, F.var_pop(x)))
    intercept = F.avg(y) - slope * F.avg(x)
    rest = F.var_pop(y) * F.count(y) - slope * F.covar_pop(x, y) * F.count(y)
    return {
        "CORREL": r, "PEARSON": r, "RSQ": r * r, "COVARIANCE.P": F.covar_pop(x, y), "COVAR": F.covar_pop(x, y), "COVARIANCE.S": F.when(F.count(x) > 1, F.covar_samp(x, y)),
        "SLOPE": slope, "INTERCEPT": intercept, "STEYX": F.when(F.count(x) > 2, F.sqrt(F.greatest(rest, F.lit(0.0)) / (F.count(x) - 2))),
        "SUMPRODUCT": F.coalesce(F.sum(x * y), F.lit(0.0)), "SUMX2MY2": F.sum(x * x - y * y), "SUMX2PY2": F.sum(x * x + y * y), "SUMXMY2": F.sum((x - y) * (x - y)),
    }


def forecast(at: float, x: Column, y: Column) -> Column:
    p = paired(x, y)
    return p["INTERCEPT"] + p["SLOPE"] * at


def npv(rate: float, value: Column, place: Column) -> Column:
    """Net present value of flows with their places from 1."""
    return F.sum(value / F.pow(F.lit(1.0 + rate), place))


def mirr(value: Column, place: Column, count: Column, finance: float, reinvest: float) -> Column:
    """From flows with places from 0 and their number; null without both signs."""
    last = F.max(count) - 1
    gains = F.sum(F.when(value > 0, value * F.pow(F.lit(1 + reinvest), count - 1 - place)))
    costs = F.sum(F.when(value < 0, -value / F.pow(F.lit(1 + finance), place)))
    return F.pow(gains / costs, 1 / last) - 1


def seriessum(at: float, first: float, step: float, coefficient: Column, place: Column) -> Column:
    return F.sum(coefficient * F.pow(F.lit(at), F.lit(first) + place * step))


