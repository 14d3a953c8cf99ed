"""Keyed reconciliation of two tables: matched, diff, only_left, only_right, ambiguous."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.value import bind
from tabulon.operators.criteria import lenient_number
from tabulon.session import discard, stage

#: Characters of a key that meet texts in an equi-join at most.
LONGEST = 64
#: Shapes of keys that are compared with those of texts at most; of more all substrings of the keys' lengths meet.
SHAPES = 1000
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def transformed(key: Column, how: str = "none") -> Column:
    s = key.cast("string")
    return {"none": s, "trim": F.trim(s), "digits": F.regexp_replace(s, "[^0-9]", ""), "alnum": F.upper(F.regexp_replace(s, "[^A-Za-z0-9]", ""))}[how]


def duplicate_keys(df: DataFrame, key: str, how: str = "none") -> DataFrame:
    return df.groupBy(transformed(F.col(key), how).alias("key")).count().filter("count > 1")


def compared_columns(left: DataFrame, right: DataFrame, key: str, named: list[str] | None = None) -> list[str]:
    """The columns to compare: those named, or every column of the left table but the key; the right table must have them."""
    names = [c for c in left.columns if c != key] if named is None else list(named)
    missing = [c for c in names if c not in left.columns or c not in right.columns]
    if missing:
        raise ValueError(f"no such column on both sides: {', '.join(missing)}")
    return names


def compared(both: DataFrame, compare: list[str], kinds: dict[str, str], tolerance: float) -> DataFrame:
    """The delta_ columns of joined rows, and whether they differ and differ beyond the tolerance.

    Numbers differ if their delta is not 0; a tolerance only excuses them. Texts differ by any character, which no
    tolerance excuses."""
    differs = outside = F.lit(False)
    for c in compare:
        a, b = F.col(f"left_{c}"), F.col(f"right_{c}")
        x, y = (lenient_number(v) if kinds[c] == "string" else v.cast("double") for v in (a, b))
        numeric = x.isNotNull() & y.isNotNull()
        both = both.withColumn(f"delta_{c}", F.when(numeric, y - x))
        differs = differs | F.when(numeric, y - x != 0).otherwise(~a.eqNullSafe(b))
        outside = outside | F.when(numeric, F.abs(y - x) > tolerance).otherwise(~a.eqNullSafe(b))
    return both.withColumns({"_differs": differs, "_outside": outside})


def reconcile(left: DataFrame, right: DataFrame, key: str, compare: list[str] | None = None, tolerance: float = 0.0, how: str = "none") -> DataFrame:
    """(key, status, material, n_left, n_right, one left_, right_ and delta_ column a compared one) by an outer join on the
    transformed key; without ``compare`` all columns of the left table but the key are compared.

    A pair with any difference is a diff; it is material if a difference is beyond the tolerance, as are all keys of one
    side and ambiguous ones. Keys that either side has more than once are ambiguous: such a key is counted, not joined, so
    that no group of copies is multiplied with another; the least of its rows is shown.
    """
    compare = compared_columns(left, right, key, compare)
    sides = []
    for df, name in ((left, "left"), (right, "right")):
        k = transformed(F.col(key), how).alias("key")
        least = [F.min(F.struct(*compare)).alias("_least")] if compare else []
        made = df.groupBy(k).agg(F.count("*").alias(f"n_{name}"), *least)
        sides.append(made.select("key", f"n_{name}", *(F.col(f"_least.{c}").alias(f"{name}_{c}") for c in compare)))
    both = compared(sides[0].join(sides[1], "key", "full_outer"), compare, dict(left.dtypes), tolerance)
    status = (
        F.when(F.col("n_right").isNull(), "only_left")
        .when(F.col("n_left").isNull(), "only_right")
        .when((F.col("n_left") > 1) | (F.col("n_right") > 1), "ambiguous")
        .when(F.col("_differs"), "diff")
        .otherwise("matched")
    )
    return settled(both.withColumn("status", status))


def settled(rows: DataFrame) -> DataFrame:
    """With the column material: rows of one side, ambiguous ones, and differences beyond the tolerance."""
    missing = F.col("status").isin("only_left", "only_right", "ambiguous")
    return rows.withColumn("material", missing | ((F.col("status") == "diff") & F.col("_outside"))).drop("_differs", "_outside")


def is_material(reconciled: DataFrame, strict: bool = False) -> bool:
    """Whether a reconciliation should fail a build; ``strict`` counts differences within the tolerance too."""
    return not reconciled.filter(F.col("status") != "matched" if strict else F.col("material")).isEmpty()


def summary(reconciled: DataFrame) -> DataFrame:
    """Counts by status; matched includes those that differ."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    outside = F.count_if((F.col("status") == "diff") & F.col("material")).alias("diff_outside_tolerance")
    return reconciled.agg(count("matched", "diff").alias("matched"), count("diff").alias("diff"), outside, count("only_left").alias("only_left"), count("only_right").alias("only_right"), count("ambiguous").alias("ambiguous"))


def column_diffs(reconciled: DataFrame, compare: list[str], tolerance: float = 0.0) -> DataFrame:
    """A row for each compared column that differs in a matched pair: (key, column, left, right, delta, within_tolerance),
    both values as texts; a text has no delta and is never within the tolerance."""
    rows = reconciled.filter(F.col("status") == "diff")
    text = lambda side, c: F.col(f"{side}_{c}").cast("string").alias(side)
    pieces = F.array(*(F.struct(F.lit(c).alias("column"), text("left", c), text("right", c), F.col(f"delta_{c}").alias("delta")) for c in compare))
    found = rows.select("key", F.explode(pieces).alias("d")).select("key", "d.*")
    different = F.when(F.col("delta").isNotNull(), F.col("delta") != 0).otherwise(~F.col("left").eqNullSafe(F.col("right")))
    return found.filter(different).withColumn("within_tolerance", F.coalesce(F.abs("delta") <= tolerance, F.lit(False)))


def shaped(text: Column, letters: bool) -> Column:
    """A text with every digit as 0 and, if ``letters``, every letter of a to z as a."""
    return F.translate(text, "123456789" + LETTERS * letters, "0" * 9 + "a" * 26 * letters)


def shapes(heads: DataFrame) -> tuple[bool, list[str]] | None:
    """The shapes of the column gram: with their letters, else without; None if there are over ``SHAPES`` of either."""
    for letters in (False, True):
        found = [r[0] for r in heads.select(shaped(F.col("gram"), letters)).distinct().limit(SHAPES + 1).collect()]
        if len(found) <= SHAPES:
            return letters, found
    return None


def grams(heads: DataFrame, texts: DataFrame) -> DataFrame:
    """(right_row, text, gram) of the substrings of texts that may equal a gram of ``heads``: those of the same length and, if
    these are few, the same shape. The text is there beside grams of ``LONGEST`` characters only."""
    known = shapes(heads)
    sizes = {len(s) for s in known[1]} if known else {r[0] for r in heads.select(F.length("gram")).distinct().collect()}  # at most LONGEST
    t = F.lower("text")

    def pieces(text: Column, shape: Column | None, n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(text) - n + 1)
        if known:
            alike = [s for s in known[1] if len(s) == n]
            at = F.filter(at, lambda i: F.substring(shape, i, F.lit(n)).isin(*alike))
        cut = F.transform(at, lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    if not sizes:
        return texts.select("right_row", "text", F.lit("").alias("gram")).limit(0)
    every = lambda r: F.array_distinct(F.flatten(F.array(*(pieces(r["text"], r["shape"], n) for n in sorted(sizes)))))
    row = F.struct(t.alias("text"), (shaped(t, known[0]) if known else F.lit("")).alias("shape"))
    found = texts.select("right_row", "text", F.explode(bind(row, every)).alias("gram"))
    return found.withColumn("text", F.when(F.length("gram") == LONGEST, F.lower("text")))


def candidates(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(left_row, right_row) of keys (left_row, key) that stand in texts (right_row, text), whatever the case; an empty key
    is in no text. Keys meet the substrings of texts of their own length and shape in an equi-join, so that only pairs that
    match are formed; of keys over ``LONGEST`` characters the first ones meet, and the pairs are tested."""
    lowered = keys.select("left_row", F.lower("key").alias("key")).filter(F.length("key") > 0)
    heads = lowered.select("left_row", F.substring("key", 1, LONGEST).alias("gram"), F.when(F.length("key") > LONGEST, F.col("key")).alias("key"))
    met = heads.join(grams(heads, texts), "gram")
    return met.filter(F.col("key").isNull() | F.contains("text", "key")).select("left_row", "right_row")


def claims(edges: DataFrame) -> DataFrame:
    """(left_row, right_row, n_candidates): what every left row finds if they come in order and a left row with one candidate
    claims it. A round decides all left rows that no earlier open one shares a candidate with; rounds end with the edges.
    A round deals the edges twice, by right rows and by left rows; a third time only what it leaves open."""
    edges, decided = stage(edges, "edges"), []
    first, own = F.min("left_row").over(Window.partitionBy("right_row")), Window.partitionBy("left_row")
    while not edges.isEmpty():
        marked = edges.select("left_row", "right_row", (F.col("left_row") == first).alias("mine"))
        state = stage(marked.select("left_row", "right_row", F.count("*").over(own).alias("n_candidates"), F.min("mine").over(own).alias("free")), "decided")
        discard(edges)
        now, edges = state.filter("free").drop("free"), state.filter("not free").select("left_row", "right_row")
        decided.append(now)
        if not edges.isEmpty():
            edges = stage(edges.join(now.filter("n_candidates = 1").select("right_row"), "right_row", "left_anti"), "edges")
    return reduce(DataFrame.union, decided) if decided else edges.withColumn("n_candidates", F.lit(0).cast("long"))


def numbered(found: DataFrame) -> DataFrame:
    """The claims of ambiguous left rows with candidate_index, in the order of right rows."""
    turn = F.row_number().over(Window.partitionBy("left_row").orderBy("right_row")) - 1
    return found.filter("n_candidates > 1").withColumn("candidate_index", turn)


def reconcile_contains(left: DataFrame, right: DataFrame, key: str, text: str, left_row: str, right_row: str, compare: list[str] = (), tolerance: float = 0.0, how: str = "none") -> DataFrame:
    """Left keys that stand in right texts: (left_row, right_row, key, status, material, n_candidates, candidate_index, one
    left_, right_ and delta_ column a compared one).

    ``left_row`` and ``right_row`` name columns that number the rows; left rows come in that order. One with a single
    candidate is matched (or a diff) and claims it, so that later ones do not see it; one with several is ambiguous,
    claims none and has a row for each; right rows that nothing claims are only_right."""
    compare = compared_columns(left, right, key, compare)
    own = left.select(F.col(left_row).alias("left_row"), transformed(F.col(key), how).alias("key"), *(F.col(c).alias(f"left_{c}") for c in compare))
    other = right.select(F.col(right_row).alias("right_row"), transformed(F.col(text), how).alias("text"), *(F.col(c).alias(f"right_{c}") for c in compare))
    found = claims(candidates(own.select("left_row", "key"), other.select("right_row", "text")))
    claimed = found.filter("n_candidates = 1").select("right_row")
    placed = found.filter("n_candidates = 1").withColumn("candidate_index", F.lit(0)).unionByName(numbered(found))
    mine = own.join(placed, "left_row", "left").join(other.drop("text"), "right_row", "left")
    theirs = other.join(claimed, "right_row", "left_anti").withColumn("key", F.col("text")).drop("text")
    both = compared(mine.unionByName(theirs, allowMissingColumns=True), compare, dict(left.dtypes), tolerance)
    status = F.when(F.col("left_row").isNull(), "only_right").when(F.col("n_candidates").isNull(), "only_left").when(F.col("n_candidates") > 1, "ambiguous").when(F.col("_differs"), "diff").otherwise("matched")
    return settled(both.withColumns({"status": status, "n_candidates": F.coalesce("n_candidates", F.lit(0)), "candidate_index": F.coalesce("candidate_index", F.lit(0))}))


def exported(outcomes: DataFrame, left: DataFrame, right: DataFrame, status: str, side: str, left_row: str, right_row: str) -> DataFrame:
    """The rows behind the outcomes of one status of ``reconcile_contains``: those of the left or right table, or of both
    with _status, _key, right_ columns, _candidate_count and _candidate_index (a row for each candidate of an ambiguous key).
    Outcomes of one side have that side's rows, whatever is asked for."""
    side = {"only_left": "left", "only_right": "right"}.get(status, side)
    chosen = outcomes.filter(F.col("status") == status)
    if side == "left":
        return left.join(chosen.select(F.col("left_row").alias(left_row)).distinct(), left_row, "left_semi")
    if side == "right":
        one = chosen.filter(F.col("status") != "ambiguous")
        return right.join(one.select(F.col("right_row").alias(right_row)), right_row, "left_semi")
    head = chosen.select(F.col("status").alias("_status"), F.col("key").alias("_key"), F.col("left_row").alias("_left"), F.col("right_row").alias("_right"), F.greatest("n_candidates", F.lit(1)).alias("_candidate_count"), F.col("candidate_index").alias("_candidate_index"))
    named = right.select(*(F.col(c).alias(f"right_{c}") for c in right.columns))
    joined = head.join(left, F.col("_left") == F.col(left_row), "left").join(named, F.col("_right") == F.col(f"right_{right_row}"), "left")
    return joined.select("_status", "_key", *left.columns, *named.columns, "_candidate_count", "_candidate_index")


def exported_ambiguous(left: DataFrame, right: DataFrame, key: str, text: str, left_row: str, right_row: str, how: str = "none") -> DataFrame:
    """What ``exported`` gives of both sides of the ambiguous keys of ``reconcile_contains``. Their outcomes need neither
    values to compare nor the keys that are not ambiguous: the claims meet each table once."""
    keys = left.select(F.col(left_row).alias("left_row"), transformed(F.col(key), how).alias("key"))
    texts = right.select(F.col(right_row).alias("right_row"), transformed(F.col(text), how).alias("text"))
    several = numbered(claims(candidates(keys, texts)))
    head = several.select(F.lit("ambiguous").alias("_status"), F.col("left_row").alias("_left"), F.col("right_row").alias("_right"), F.col("n_candidates").alias("_candidate_count"), F.col("candidate_index").alias("_candidate_index"))
    mine = head.join(left, F.col("_left") == F.col(left_row)).select("_status", transformed(F.col(key), how).alias("_key"), *left.columns, "_right", "_candidate_count", "_candidate_index")
    named = right.select(*(F.col(c).alias(f"right_{c}") for c in right.columns))
    joined = mine.join(named, F.col("_right") == F.col(f"right_{right_row}"))
    return joined.select("_status", "_key", *left.columns, *named.columns, "_candidate_count", "_candidate_index")


def contained(left: DataFrame, right: DataFrame, key: str, text: str, how: str = "alnum") -> DataFrame:
    """(left_key, n_candidates): right rows whose transformed text holds the left key, whatever the case."""
    keys = left.select(F.upper(transformed(F.col(key), how)).alias("left_key")).filter(F.length("left_key") > 0)
    texts = right.select(transformed(F.col(text), how).alias("text")).groupBy("text").count()  # equal texts meet once
    pairs = candidates(keys.select(F.col("left_key").alias("left_row"), F.col("left_key").alias("key")).distinct(), texts.select(F.col("text").alias("right_row"), "text"))
    found = pairs.join(texts, F.col("right_row") == F.col("text")).groupBy(F.col("left_row").alias("left_key")).agg(F.sum("count").alias("n_candidates"))
    return keys.join(found, "left_key", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
