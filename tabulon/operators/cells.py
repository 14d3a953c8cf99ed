"""Cell mode: a workbook as rows (sheet, row, col, formula, kind, value), and what keeps it whole: fingerprints,
verification, diffs, the edit journal and its replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.ordering import with_places

CELL = ["sheet", "row", "col", "formula", "kind", "value"]
#: Rows of a block in which cells meet ranges.
BLOCK_ROWS = 4096


def to_cells(df: DataFrame, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """The cells of a table; rows are numbered from 0 in the given order, blanks have no cell."""
    kinds = {c: "text" if t == "string" else "bool" if t == "boolean" else "number" for c, t in df.dtypes}
    numbered = with_places(df.select(F.col(order).alias("_order"), *columns), "_order", name="_row")
    cells = F.array(*(F.struct(F.lit(i).alias("col"), F.lit(kinds[c]).alias("kind"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    return numbered.select(F.lit(sheet).alias("sheet"), (F.col("_row") - 1).cast("long").alias("row"), F.explode(cells).alias("c")).select("sheet", "row", "c.col", F.lit(None).cast("string").alias("formula"), "c.kind", "c.value").filter("value is not null")


def from_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    """The table of one sheet's cells: a row a sheet row, texts."""
    return cells.groupBy("row").agg(*(F.max(F.when(F.col("col") == i, F.col("value"))).alias(c) for i, c in enumerate(columns)))


def cell_digest():
    """A digest of a cell: every part with its length before it, so that no two cells share their bytes."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("row", "col", "formula", "kind", "value")]
    return F.sha2(F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p))), 256)


def fingerprint(cells: DataFrame) -> DataFrame:
    """(sheet, n_cells, digest), whatever the order of rows: cells' digests are added up modulo 2^31 in four words, which
    combines map-side, and the sums are digested."""
    words = [F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = cells.withColumn("d", cell_digest()).groupBy("sheet").agg(F.count("*").alias("n_cells"), *(F.sum(w).alias(f"w{i}") for i, w in enumerate(words)))
    return sums.select("sheet", "n_cells", F.sha2(F.concat_ws(":", "sheet", "n_cells", *(F.col(f"w{i}").cast("string") for i in range(8))), 256).alias("digest"))


def diff_cells(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sheet, row, col, change, old, new) of cells that were added, removed or changed, by address."""
    a = old.select("sheet", "row", "col", F.coalesce("formula", "value").alias("old"))
    b = new.select("sheet", "row", "col", F.coalesce("formula", "value").alias("new"))
    both = a.join(b, ["sheet", "row", "col"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", change)


def diff_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sheet, digest, old_row, new_row, change): rows aligned by the digests of their contents, equal ones in their order;
    unmatched rows at one place are changed, others removed or inserted."""
    order = Window.partitionBy("sheet", "digest").orderBy("row")

    def rows(cells: DataFrame, name: str) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("formula", "value").alias("v")))), lambda c: F.concat_ws("=", c["col"].cast("string"), c["v"])), "\x1f")
        made = cells.groupBy("sheet", "row").agg(F.sha2(text, 256).alias("digest"))
        return made.withColumn("turn", F.row_number().over(order)).withColumnRenamed("row", f"{name}_row")

    both = rows(old, "old").join(rows(new, "new"), ["sheet", "digest", "turn"], "full_outer").drop("turn")
    gone = both.filter("new_row is null").select("sheet", F.col("old_row").alias("row"), "old_row")
    come = both.filter("old_row is null").select("sheet", F.col("new_row").alias("row"), "new_row")
    pairs = gone.join(come, ["sheet", "row"], "full_outer")
    return pairs.select("sheet", "old_row", "new_row", F.when(F.col("old_row").isNull(), "inserted").when(F.col("new_row").isNull(), "removed").otherwise("changed").alias("change"))


def insert_rows(cells: DataFrame, sheet: str, at: int, n: int) -> DataFrame:
    """Rows from ``at`` on move down by n (or, if n is negative, -n rows go and the rest moves up)."""
    here = F.col("sheet") == sheet
    kept = cells if n > 0 else cells.filter(~(here & F.col("row").between(at, at - n - 1)))
    return kept.withColumn("row", F.when(here & (F.col("row") >= at), F.col("row") + n).otherwise(F.col("row")))


def insert_columns(cells: DataFrame, sheet: str, at: int, n: int) -> DataFrame:
    """Columns from ``at`` on move right by n (or, if n is negative, -n columns go and the rest moves left)."""
    here = F.col("sheet") == sheet
    kept = cells if n > 0 else cells.filter(~(here & F.col("col").between(at, at - n - 1)))
    return kept.withColumn("col", F.when(here & (F.col("col") >= at), F.col("col") + n).otherwise(F.col("col")))


def fill(cells: DataFrame, table: DataFrame, sheet: str, top: int, left: int, clear: bool = False) -> DataFrame:
    """The cells of a template with a table's (``to_cells``) written at a corner: cells it meets are replaced; with
    ``clear`` all literals of the sheet go first, formulas stay. Formulas of the table are stored as texts."""
    here = F.col("sheet") == sheet
    kept = cells.filter(~here | F.col("formula").isNotNull()) if clear else cells
    text = F.col("formula").isNotNull()
    come = table.select(F.lit(sheet).alias("sheet"), (F.col("row") + top).alias("row"), (F.col("col") + left).alias("col"), F.lit(None).cast("string").alias("formula"), F.when(text, "text").otherwise(F.col("kind")).alias("kind"), F.coalesce("formula", "value").alias("value"))
    return kept.select(*CELL).join(come, ["sheet", "row", "col"], "left_anti").select(*CELL).unionByName(come)


def column_letters(col) -> Column:
    """A, B, ..., Z, AA, ... of a column's number from 0 to 18277."""
    n = F.col(col) if isinstance(col, str) else col
    letter = lambda x: F.char(F.lit(65) + F.pmod(x, F.lit(26)))
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(n >= 702, letter(three)).otherwise(""), F.when(n >= 26, letter(two)).otherwise(""), letter(n))


def cell_json(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, json) of a workbook's export: cell, formula (if there is one) and value, which is a JSON number or
    boolean where the cell holds one."""
    name = F.concat(column_letters("col"), (F.col("row") + 1).cast("string"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    number = F.col("value").try_cast("double")
    value = F.when(F.col("value").isNull(), "null").when((F.col("kind") == "number") & number.isNotNull(), quoted(number)).when(F.col("kind") == "bool", F.lower("value")).otherwise(quoted(F.col("value")))
    formula = F.when(F.col("formula").isNotNull(), F.concat(F.lit(',"formula":'), quoted(F.concat(F.lit("="), F.col("formula"))))).otherwise("")
    return cells.select("sheet", "row", "col", F.concat(F.lit('{"cell":'), quoted(name), formula, F.lit(',"value":'), value, F.lit("}")).alias("json"))


def verify(cells: DataFrame, expectations: DataFrame) -> DataFrame:
    """(label, passed) of expectations (label, sheet, row, col, check, number, text, tolerance): equals, approx, error,
    no_error, formula."""
    found = expectations.join(cells, ["sheet", "row", "col"], "left")
    n, v = F.col("value").try_cast("double"), F.coalesce("value", F.lit(""))
    tests = {
        "equals": F.when(F.col("number").isNotNull(), n == F.col("number")).otherwise(v == F.col("text")),
        "approx": F.abs(n - F.col("number")) <= F.coalesce("tolerance", F.lit(1e-9)),
        "error": (F.col("kind") == "error") & (v == F.col("text")),
        "no_error": ~F.coalesce(F.col("kind") == "error", F.lit(False)),
        "formula": F.col("formula") == F.col("text"),
    }
    passed = reduce(lambda w, kv: w.when(F.col("check") == kv[0], kv[1]), list(tests.items())[1:], F.when(F.col("check") == "equals", tests["equals"]))
    return found.select("label", F.coalesce(passed, F.lit(False)).alias("passed"))


def verify_ranges(cells: DataFrame, expectations: DataFrame) -> DataFrame:
    """(label, passed) of expectations (label, sheet, top, left, bottom, right, check, number, tolerance) of ranges, bounds
    included: sum or count of their numbers, no_error. Equal expectations are answered once. Cells meet ranges by blocks of
    rows, and the sums of a range combine before they are shuffled."""
    keys = ["label", "sheet", "top", "left", "bottom", "right", "check", "number", "tolerance"]
    block = lambda c: F.floor(F.col(c) / BLOCK_ROWS)
    dealt = expectations.select(*keys, F.explode(F.sequence(block("top"), block("bottom"))).alias("_block"))
    number = F.when(F.col("kind") == "number", F.col("value").try_cast("double"))
    own = cells.select(F.col("sheet").alias("_sheet"), "row", "col", "kind", number.alias("x"), block("row").alias("_own"))
    inside = F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))
    met = dealt.join(own, (F.col("sheet") == F.col("_sheet")) & (F.col("_block") == F.col("_own")) & inside, "left")
    found = met.groupBy(*keys).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"), F.count("x").alias("numbers"), F.count_if(F.col("kind") == "error").alias("errors"))
    close = F.abs(F.col("total") - F.col("number")) <= F.coalesce("tolerance", F.lit(1e-9))
    passed = F.when(F.col("check") == "sum", close).when(F.col("check") == "count", F.col("numbers") == F.col("number")).when(F.col("check") == "no_error", F.col("errors") == 0)
    return found.select("label", F.coalesce(passed, F.lit(False)).alias("passed"))


def replay(ops: DataFrame, upto: int | None = None) -> DataFrame:
    """The cells that a journal of writes (revision, seq, sheet, row, col, value, undone) leads to: the last write of each
    cell that is not undone; a null value clears the cell."""
    live = ops.filter("not undone") if upto is None else ops.filter("not undone").filter(F.col("revision") <= upto)
    last = live.groupBy("sheet", "row", "col").agg(F.max_by("value", F.struct("revision", "seq")).alias("value"))
    return last.filter("value is not null")


def last_actors(ops: DataFrame) -> DataFrame:
    """(sheet, row, col, actor, revision) of the last write of each cell that is not undone."""
    return ops.filter("not undone").groupBy("sheet", "row", "col").agg(F.max_by("actor", F.struct("revision", "seq")).alias("actor"), F.max("revision").alias("revision"))


def history(ops: DataFrame, sheet: str, row: int, col: int) -> DataFrame:
    return ops.filter((F.col("sheet") == sheet) & (F.col("row") == row) & (F.col("col") == col))


def undo_counts(ops: DataFrame) -> DataFrame:
    """Commits of each actor that can still be undone, and that are undone."""
    commits = ops.groupBy("actor", "revision").agg(F.bool_and("undone").alias("undone"))
    return commits.groupBy("actor").agg(F.count_if(~F.col("undone")).alias("open"), F.count_if("undone").alias("undone"))
