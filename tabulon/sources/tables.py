"""Text tables: CSV, TSV, JSON and lines. A field is the text that was there; nothing is inferred."""

from __future__ import annotations

import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".json": "json", ".txt": "lines", ".xlsx": "xlsx"}
DELIMITERS = {"tab": "\t", "comma": ",", "pipe": "|", "semicolon": ";"}


def format_of(path: str) -> str:
    kind = FORMATS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ValueError(f"unknown kind of file: {path}")
    return kind


def read_table(spark: SparkSession, path: str, kind: str | None = None, headers: bool = True, delimiter: str | None = None, columns: list[str] | None = None, multiline: bool | None = None) -> DataFrame:
    """A file or folder as texts; a delimited field that is empty or lacking is null. ``columns`` names the columns of a table without
    headers, or the keys of a JSON file (else one pass finds them)."""
    kind = kind or format_of(path)
    if kind == "lines":
        return spark.read.text(path)
    if kind == "json":
        return read_json(spark, path, columns)
    if kind == "xlsx":
        from tabulon.sources.xlsx import XlsxSource

        spark.dataSource.register(XlsxSource)
        return spark.read.format("xlsx_cells").load(path)
    return read_delimited(spark, path, DELIMITERS.get(delimiter or "", delimiter) or ("\t" if kind == "tsv" else ","), headers, columns, multiline)


def column_names(found: list[str], width: int) -> list[str]:
    """Names of ``width`` columns: the given ones, _c and the place for those without; repeated ones get their place."""
    names = [(found[i] if i < len(found) else "") or f"_c{i}" for i in range(width)]
    lower = [n.lower() for n in names]
    return [f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_delimited(spark: SparkSession, path: str, sep: str, headers: bool = True, columns: list[str] | None = None, multiline: bool | None = None) -> DataFrame:
    """Delimited text. Fields beyond the header become columns ``_c`` and their place, a blank line is a row of nulls,
    and in a folder each file's header goes.

    Files are split by lines and read in parallel where no quoted field holds a line break; one pass looks for lines with
    an odd number of quotes, which tell (``multiline`` decides without it). With such fields a file is read by one task,
    blank lines are left out, and a row has up to four times the fields of the widest line."""
    lines = spark.read.text(path)
    held = lambda c: F.length("value") - F.length(F.replace("value", F.lit(c), F.lit("")))
    odd, most = lines.agg(F.max(held('"') % 2), F.max(held(sep))).first()
    if most is None:  # no line at all
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns or ["_c0"]))
    multiline = odd == 1 if multiline is None else multiline
    options = {"sep": sep, "quote": '"', "escape": '"', "maxColumns": str(4 * most + 8)}
    head = []
    if headers and not columns:
        top = spark.read.options(**options, multiLine=True, header=False, inferSchema=False).csv(path).first() if multiline else None
        first = lines.first()["value"]
        head = [c or "" for c in top] if top is not None else next(csv.reader([first], delimiter=sep), [""])
        head[0] = head[0].removeprefix("\ufeff")
    known = len(columns or head)
    width = max(known, 4 * most + 4 if multiline else most + 1)
    fields = [f"_{i}" for i in range(width)]
    schema = ", ".join(f"{c} string" for c in fields)
    if multiline:
        rows = spark.read.options(**options, multiLine=True, header=headers).schema(schema).csv(path)
    else:
        if headers:
            lines = without_headers(lines)
        parsed = F.from_csv("value", F.lit(schema), options)
        rows = lines.select(F.when(F.col("value") != "", parsed).alias("r")).select(*(F.col("r")[c].alias(c) for c in fields))
    if width > known:  # quoted separators widen the bound: keep columns that hold something
        used = rows.agg(F.max(F.greatest(F.lit(0), F.lit(0), *(F.when(F.col(c).isNotNull(), i + 1) for i, c in enumerate(fields))))).first()[0]
        width = max(known, used or 0, 1)
    names = column_names(columns or head, width)
    return rows.select(*(F.col(c).alias(n) for c, n in zip(fields, names)))


def without_headers(lines: DataFrame) -> DataFrame:
    """Lines without each file's first one that is the table's first line; equal lines further down are data."""
    head = lines.first()["value"]
    numbered = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    tops = numbered.filter((F.col("_start") == 0) & (F.col("value") == head)).groupBy("_file").agg(F.min("_line").alias("_line"))
    return numbered.join(tops.select("_line"), "_line", "left_anti").select("value")


def read_json(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An array of objects, an array of arrays (columns _c0, _c1, ...), or an object a line, which is split over tasks; an
    array is read by one task a file. Keys keep the order in which they are first seen, keys that an object lacks are
    empty, nested values stay JSON text; text that is not JSON is an error."""
    strict = {"mode": "FAILFAST"}
    lines = spark.read.text(path)
    first = lines.filter(F.trim("value") != "").first()
    if first is None:
        raise ValueError(f"not JSON: {path}")
    if first["value"].lstrip("\ufeff \t").startswith("["):
        items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>", strict)).alias("_at", "item"))
    else:
        items = lines.filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("_at"), F.col("value").alias("item"))
    nested = items.agg(F.bool_and(F.startswith("item", F.lit("["))), F.bool_and(F.startswith(F.ltrim("item"), F.lit("{")))).first()
    if nested[0]:
        arrays = items.select(F.from_json("item", "array<string>", strict).alias("r"))
        width = arrays.agg(F.max(F.size("r"))).first()[0] or 0
        return arrays.select(*(F.coalesce(F.try_element_at("r", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(column_names(columns or [], max(width, len(columns or []))))))
    if nested[1] is False:
        raise ValueError(f"neither objects nor arrays: {path}")
    objects = items.select("_at", F.from_json("item", "map<string,string>", strict).alias("r"))
    if columns is None:
        seen = objects.select("_at", F.posexplode(F.map_keys("r")).alias("_place", "k")).groupBy("k").agg(F.min(F.struct("_at", "_place")).alias("first"))
        columns = [r["k"] for r in seen.orderBy("first").select("k").collect()]
    return objects.select(*(F.coalesce(F.try_element_at("r", F.lit(k)), F.lit("")).alias(k) for k in columns))


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """Part files in a folder; quotes only where needed. JSON is an object a line, keys in the order of the columns."""
    texts = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))
    if kind in ("csv", "tsv"):
        texts.write.option("sep", "\t" if kind == "tsv" else ",").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "json":
        texts.write.json(path)
    elif kind == "lines":
        texts.select(texts.columns[0]).write.text(path)
    else:
        raise ValueError(f"no writer for {kind}")


def parsed_input(col: Column) -> Column:
    """What typing a text into a cell makes of it: kind (formula, empty, bool, text, number) and value."""
    from tabulon.functions.value import NUMERIC

    upper = F.upper(col)
    kind = F.when(col.isNull() | (col == ""), "empty").when(F.startswith(col, F.lit("=")), "formula").when(upper.isin("TRUE", "FALSE"), "bool").when(F.startswith(col, F.lit("'")), "text").when(col.rlike(NUMERIC) & (F.trim(col) == col), "number").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind == "bool", upper).when(F.startswith(col, F.lit("'")), F.substring(col, 2, 32767)).otherwise(col).alias("value"))


def safe_export(col: Column) -> Column:
    """A text that a spreadsheet does not take for a formula."""
    return F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)


def strict_number(col: Column) -> Column:
    """A number only if it is written plainly: no leading zero, at most 15 digits, none or two decimals."""
    good = col.rlike(r"^-?(0|[1-9]\d{0,14})(\.\d{2})?$") & (F.length(F.regexp_replace(col, r"[-.]", "")) <= 15)
    return F.when(good, col).try_cast("double")


def shape(df: DataFrame) -> dict:
    return {"rows": df.count(), "columns": len(df.columns), "names": df.columns}


def peek(df: DataFrame, limit: int = 5000) -> DataFrame:
    return df.limit(min(limit, 200_000, 10_000_000 // max(1, len(df.columns))))
