"""Lookups as joins: exact with wildcards, approximate (as-of), by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.ordering import with_places


def lookup_exact(left: DataFrame, target: str, right: DataFrame, key: str, value: str, order: str, missing=None, name: str = "found") -> DataFrame:
    """XLOOKUP and VLOOKUP with exact match: the value of the first row (by ``order``) whose key is the target, without
    case for texts; ``missing`` where there is none. The right side is one row a key before the join."""
    norm = lambda t, c: F.lower(F.col(c)) if dict(t.dtypes)[c] == "string" else F.col(c)
    first = right.filter(F.col(key).isNotNull()).groupBy(norm(right, key).alias("_key")).agg(F.min_by(value, order).alias(name))
    joined = left.withColumn("_key", norm(left, target)).join(first, "_key", "left").drop("_key")
    return joined if missing is None else joined.withColumn(name, F.coalesce(name, F.lit(missing)))


def lookup_wildcard(left: DataFrame, pattern: str, right: DataFrame, key: str, value: str, order: str, name: str = "found") -> DataFrame:
    """MATCH and VLOOKUP with wildcards in the target; literal targets should use ``lookup_exact``. The patterns' distinct
    values are matched against the keys once."""
    escaped = F.regexp_replace(F.col(pattern), r"([\\.\[\]{}()+^$|])", r"\\$1")
    regex = F.concat(F.lit("(?is)^"), F.regexp_replace(F.regexp_replace(escaped, r"(?<!~)\*", ".*"), r"(?<!~)\?", "."), F.lit("$"))
    patterns = left.select(pattern).distinct().withColumn("_regex", F.regexp_replace(regex, r"~([*?])", r"\\$1"))
    hits = right.alias("r").join(patterns.hint("broadcast"), F.expr(f"`{key}` rlike _regex"))
    first = hits.groupBy(pattern).agg(F.min_by(value, order).alias(name))
    return left.join(first, pattern, "left")


def lookup_sorted(left: DataFrame, target: str, right: DataFrame, key: str, value: str, descending: bool = False, by: list[str] = (), buckets: int = 1, name: str = "found") -> DataFrame:
    """Approximate lookup: the value of the greatest key that is not above the target (descending: the least not below).

    Both sides are merged in one order and the last key's value carried forward, so that each row is shuffled once and no
    pair of rows is formed. Without ``by``, rows are spread over ranges of the target and each range gets the keys of its
    own and the last one before it, so that no single task sees all rows; ``buckets`` is their number.
    """
    kinds = dict(right.dtypes)
    keys = right.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.max(value).alias("_value") if descending else F.max_by(value, value).alias("_value"))
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if not by and buckets > 1:
        edges = [r[0] for r in left.filter(F.col(target).isNotNull()).select(F.percentile_approx(target, [i / buckets for i in range(1, buckets)]).alias("q")).select(F.explode("q")).distinct().collect()]
        edges = sorted(edges)
        bucket = lambda c: sum((F.when(F.col(c) > e, 1).otherwise(0) for e in edges), F.lit(0))
        carried = keys.withColumn("_bucket", bucket(key))
        last = carried.groupBy("_bucket").agg((F.min if descending else F.max)(F.struct(F.col(key).alias("k"), F.col("_value").alias("v"))).alias("last"))
        every = last.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))))
        later = every.filter(F.col("_to") < F.col("_bucket") if descending else F.col("_to") > F.col("_bucket"))
        near = later.groupBy(F.col("_to").alias("_bucket")).agg((F.min if descending else F.max)("last").alias("last"))
        keys = carried.unionByName(near.select(F.col("last.k").alias(key), F.col("last.v").alias("_value"), "_bucket"))
        left, by = left.withColumn("_bucket", bucket(target)), ["_bucket"]
    columns = [c for c in left.columns]
    merged = left.withColumns({"_at": F.col(target), "_value": F.lit(None).cast(kinds[value]), "_row": F.lit(1)}).unionByName(
        keys.select(*by, F.col(key).cast(dict(left.dtypes)[target]).alias("_at"), "_value", F.lit(0).alias("_row")), allowMissingColumns=True
    )
    order = Window.partitionBy(*by).orderBy(way("_at"), "_row").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn(name, F.when(F.col("_at").isNotNull(), F.last("_value", ignorenulls=True).over(order)))
    return found.filter("_row = 1").select(*(c for c in columns if c != "_bucket"), name)


def index_rows(left: DataFrame, place: str, right: DataFrame, order: str, value: str, name: str = "found") -> DataFrame:
    """INDEX: the value of the right table's n-th row (from 1) in the given order."""
    numbered = with_places(right.select(F.col(order).alias("_order"), F.col(value).alias(name)), "_order", name="_place").drop("_order")
    return left.join(numbered, F.floor(F.col(place)) == F.col("_place"), "left").drop("_place")


def match_positions(left: DataFrame, target: str, right: DataFrame, key: str, order: str, name: str = "position") -> DataFrame:
    """MATCH with exact match: the place (from 1) of the first row of the right table, in the given order, with the target."""
    numbered = with_places(right.select(F.col(order).alias("_order"), F.col(key).alias("_key")), "_order", name="_place")
    first = numbered.groupBy("_key").agg(F.min("_place").alias(name))
    return left.join(first, F.col(target) == F.col("_key"), "left").drop("_key")
