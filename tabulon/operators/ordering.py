"""Sorting, paging, search and distinct values of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.criteria import all_of, grid_condition
from tabulon.session import stage


def natural(col: Column) -> Column:
    """A key that orders item9 before item10: every run of digits in 20 places."""
    parts = F.regexp_extract_all(F.lower(col), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def sort_order(*keys: tuple[str, str], text: tuple[str, ...] = (), tie: str | None = None) -> list[Column]:
    """The order of several keys, each ("asc" or "desc"); blanks come last either way; ``tie`` keeps ties in their order."""
    order = []
    for name, way in keys:
        x = natural(F.col(name)) if name in text else F.col(name)
        blank = F.col(name).isNull() | (F.col(name).cast("string") == "")
        order += [blank.asc(), x.desc() if way == "desc" else x.asc()]
    return [*order, *([F.col(tie)] if tie else [])]


def sort_rows(df: DataFrame, *keys: tuple[str, str], text: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """Rows by several keys, as ``sort_order`` has them."""
    return df.orderBy(*sort_order(*keys, text=text, tie=tie))


def with_places(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in the given order. Ranges of the order are sorted by tasks of their own and written;
    a row's place is its place in its range after the rows of the ranges before, of which only the counts are collected."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = stage(placed, "places")  # ranges are sampled anew in each run
    part, before, total = F.shiftright("_id", 33), [], 0
    for p, n in sorted(placed.groupBy(part.cast("int")).count().collect()):  # a row a range
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    both = placed.join(F.broadcast(offsets), part.cast("int") == F.col("_part"))
    return both.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "_before")


def page(df: DataFrame, number: int, size: int = 10) -> DataFrame:
    """A page of an ordered table; a page past the end is the last one, one before the first the first."""
    total = df.count()
    last = max(1, -(-total // size))
    return df.offset((min(max(1, number), last) - 1) * size).limit(size)


def fetch_rows(df: DataFrame, number: int, size: int, sort: tuple[str, str] | None = None, filters: dict[str, list[tuple]] | None = None, tie: str | None = None) -> tuple[DataFrame, int]:
    """The server-side query of a grid: filters (all of them), then one sort key, then a page; with the number of rows.

    A page below the first is the first; one behind the last has no rows: only a caller that knows the number can clamp."""
    types = dict(df.dtypes)
    tests = [grid_condition(F.col(c), name, *args, text=types[c] == "string") for c, conditions in (filters or {}).items() for name, *args in conditions]
    found = df.filter(all_of(F.lit(True), *tests))
    ordered = sort_rows(found, sort, tie=tie) if sort else found.orderBy(tie) if tie else found
    return ordered.offset((max(1, number) - 1) * size).limit(size), found.count()


def search(df: DataFrame, query: str, key: str, columns: list[str]) -> DataFrame:
    """(key, column, text) of the cells whose text holds the query, whatever the case; an empty query finds nothing."""
    cells = df.select(F.col(key).cast("string").alias("key"), *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("key", columns, "column", "text")
    return cells.filter(F.contains(F.lower("text"), F.lit(query.lower())) & F.lit(query != ""))


def distinct_values(df: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct texts without case, each as its first row has it."""
    return df.filter(F.col(col).isNotNull()).groupBy(F.lower(col).alias("key")).agg(F.min_by(col, order).alias("value"))


def summary_row(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """A column summary: name=(aggregate, column) for sum, min, max, count and average."""
    made = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "average": F.avg}
    return df.agg(*(made[kind](col).alias(name) for name, (kind, col) in columns.items()))


def running(df: DataFrame, col: str, order: list[str], by: list[str] = (), size: int | None = None) -> Column:
    """A window of an expanding (or, with ``size``, sliding) range that ends at the row."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding if size is None else 1 - size, 0)


def descendants(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(ancestor, node, level) of nested rows, level 1 for children: a node below an ancestor once, at its least level, so
    that a cycle ends. A join a level; each level is written, so that a round starts from the last one alone."""
    front = stage(edges.filter(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(parent).alias("ancestor"), F.col(child).alias("node")).distinct().withColumn("level", F.lit(1)), "nested")
    found, level = front, 1
    links = edges.select(F.col(parent).alias("node"), F.col(child).alias("next")).filter("node is not null and next is not null")
    while True:
        level += 1
        below = front.join(links, "node").select("ancestor", F.col("next").alias("node")).distinct()
        front = stage(below.join(found, ["ancestor", "node"], "left_anti").withColumn("level", F.lit(level)), "nested")
        if front.isEmpty():
            return found
        found = found.union(front)
