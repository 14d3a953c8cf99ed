"""Hypothesis tests as one aggregation and one special function, and internal rates of return of groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.distributions import _erfc
from tabulon.functions.financial import root
from tabulon.functions.value import call, number


def t_test(df: DataFrame, x: str, y: str, tails: int, kind: int, by: list[str] = ()) -> DataFrame:
    """T.TEST of two columns: kind 1 pairs, 2 equal variances, 3 unequal ones. Null where a sample is too small or does not vary."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    if kind == 1:
        d = a - b
        sums = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.var_samp(d).alias("v"))
        t, freedom = F.col("m") / F.sqrt(F.when(F.col("v") > 0, F.col("v")) / F.col("n")), F.col("n") - 1
    else:
        sums = df.groupBy(*by).agg(*(f(c).alias(f"{name}{side}") for side, c in (("a", a), ("b", b)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
        na, nb, va, vb = (F.col(c) for c in ("na", "nb", "va", "vb"))
        if kind == 2:
            freedom = na + nb - 2
            spread = ((na - 1) * va + (nb - 1) * vb) / freedom * (1 / na + 1 / nb)
        else:
            spread = va / na + vb / nb
            freedom = spread * spread / (F.pow(va / na, 2) / (na - 1) + F.pow(vb / nb, 2) / (nb - 1))
        enough = (na > 1) & (nb > 1)
        t = F.when(enough, (F.col("ma") - F.col("mb")) / F.sqrt(F.when(spread > 0, spread)))
        freedom = F.when(enough, freedom)
    stage = sums.select(*by, F.abs(t).alias("t"), freedom.cast("double").alias("freedom"))
    from tabulon.functions.distributions import student, vectorized

    return stage.select(*by, (tails * (1 - vectorized(student)(F.col("t"), F.col("freedom")))).alias("p"))


def f_test(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """F.TEST: the two-tailed probability that the variances are equal."""
    sums = df.groupBy(*by).agg(*(f(c).alias(f"{name}_{c}") for c in (x, y) for name, f in (("n", F.count), ("v", F.var_samp))))
    ratio = F.col(f"v_{x}") / F.when(F.col(f"v_{y}") > 0, F.col(f"v_{y}"))
    stage = sums.select(*by, ratio.alias("r"), (F.col(f"n_{x}") - 1).alias("a"), (F.col(f"n_{y}") - 1).alias("b"))
    tail = stage.select(*by, call("F.DIST.RT", number("r"), number("a"), number("b")).named("tail"))
    return tail.select(*by, (2 * F.least("tail", 1 - F.col("tail"))).alias("p"))


def chisq_test(df: DataFrame, observed: str, expected: str, freedom: int) -> DataFrame:
    """CHISQ.TEST of observed and expected counts, a row a cell."""
    o, e = F.col(observed), F.when(F.col(expected) != 0, F.col(expected))
    total = df.agg(F.sum((o - e) * (o - e) / e).alias("x"))
    return total.select(call("CHISQ.DIST.RT", number("x"), freedom).named("p"))


def z_test(df: DataFrame, x: str, mean: float, sigma: float | None = None, by: list[str] = ()) -> DataFrame:
    """Z.TEST: the one-tailed probability of a mean above the sample's."""
    spread = F.stddev_samp(x) if sigma is None else F.lit(sigma)
    stage = df.groupBy(*by).agg(((F.avg(x) - mean) / (F.when(spread > 0, spread) / F.sqrt(F.count(x)))).alias("z"))

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return pd.Series(0.5 * _erfc(z.to_numpy(float) / np.sqrt(2)))

    return stage.select(*by, tail("z").alias("p"))


def irr(flows: DataFrame, by: str, order: list[str], value: str, days: str | None = None) -> DataFrame:
    """IRR (or, with ``days``, XIRR from the first row's day) of each group's flows; null without a change of sign. A group
    is one investment: its flows fit one task."""
    schema = T.StructType([T.StructField(by, flows.schema[by].dataType), T.StructField("rate", T.DoubleType())])
    first = [c for o in order for c in (F.col(o).isNull().alias(f"_no_{o}"), F.col(o).alias(f"_{o}"))]  # nulls come last
    read = F.struct(F.col(value).cast("double").alias("v"), F.lit(None).cast("double").alias("d") if days is None else F.col(days).cast("double").alias("d"))
    rows = F.sort_array(F.collect_list(F.struct(*first, read.alias("flow"))))
    groups = flows.groupBy(by).agg(F.transform(rows, lambda x: x["flow"]).alias("flows"))
    parts = groups.select(by, F.transform("flows", lambda x: x["v"]).alias("v"), *([] if days is None else [F.transform("flows", lambda x: x["d"]).alias("d")]))

    def solve(batches):
        for batch in batches:
            lists = {c: batch.column(c) for c in batch.schema.names if c in ("v", "d")}
            sizes = np.diff(lists["v"].offsets.to_numpy())
            flat = {c: x.flatten().to_numpy(zero_copy_only=False).astype(float) for c, x in lists.items()}
            rates = rates_of(flat["v"], sizes, flat.get("d"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rates, pa.float64(), mask=np.isnan(rates))], names=[by, "rate"])

    return parts.mapInArrow(solve, schema)


#: Flows whose groups are solved at once.
FLOWS = 200_000


def rates_of(v: np.ndarray, sizes: np.ndarray, days: np.ndarray | None = None) -> np.ndarray:
    """The rate of each group of flows; the groups of ``sizes`` flows stand one behind the other, and none is empty."""
    out = np.full(len(sizes), np.nan)
    start = np.cumsum(sizes) - sizes
    if not len(sizes):
        return out
    at = np.arange(len(v)) - np.repeat(start, sizes) if days is None else (days - np.repeat(days[start], sizes)) / 365
    chosen = np.flatnonzero((sizes > 1) & (np.minimum.reduceat(v, start) < 0) & (np.maximum.reduceat(v, start) > 0))
    part = np.cumsum(sizes[chosen]) // FLOWS
    for some in np.split(chosen, np.flatnonzero(np.diff(part)) + 1) if len(chosen) else []:
        n = sizes[some]
        begin = np.cumsum(n) - n
        rows = np.repeat(start[some] - begin, n) + np.arange(n.sum())
        flow, place = v[rows], at[rows].astype(float)
        value = lambda r: np.add.reduceat(flow / np.repeat(1 + r, n) ** place, begin)  # noqa: B023, E731
        with np.errstate(all="ignore"):
            out[some] = root(value, np.full(len(some), -0.999999), np.full(len(some), 10.0))
    return out
