"""Predicates: criteria strings, where clauses, grid filter conditions and validators, all compiled to Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.value import NUMERIC

OPERATORS = ("<>", ">=", "<=", ">", "<", "=")


def wildcard(pattern: str) -> str:
    """A regular expression for ``*`` and ``?``, which a tilde makes ordinary; case does not count."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?is)^{out}$"


def criterion(col: Column | str, wanted, kind: str = "number") -> Column:
    """Whether a cell meets a criterion such as 5, "x*", ">=3" or "<>"; blank cells only meet a blank criterion or a <>."""
    x = F.col(col) if isinstance(col, str) else col
    blank = x.isNull() | ((x == "") if kind == "text" else F.lit(False))
    if isinstance(wanted, bool):
        return F.coalesce(x == wanted, F.lit(False)) if kind == "bool" else F.lit(False)
    if not isinstance(wanted, str):
        return F.coalesce(x == wanted, F.lit(False)) if kind == "number" else F.lit(False)
    op = next((o for o in OPERATORS if wanted.startswith(o)), "=")
    rest = wanted.removeprefix(op) if wanted.startswith(op) else wanted
    if rest == "":
        return {"=": blank, "<>": ~blank}.get(op, F.lit(False))
    number = float(rest) if re.match(NUMERIC, rest) else None
    if number is not None:
        if kind != "number":
            same = F.coalesce(F.trim(x) == rest, F.lit(False)) if kind == "text" else F.lit(False)
            return ~same if op == "<>" else same if op == "=" else F.lit(False)
        y = F.lit(number)
    elif kind == "text":
        if op in ("=", "<>"):
            hit = F.coalesce(F.lower(x).rlike(wildcard(rest)) if re.search(r"[*?~]", rest) else F.lower(x) == rest.lower(), F.lit(False)) & ~blank
            return ~hit if op == "<>" else hit
        x, y = F.lower(x), F.lit(rest.lower())
    else:
        return F.lit(op == "<>")
    made = {"=": x == y, "<>": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]
    return F.coalesce(made, F.lit(op == "<>"))


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def lenient_number(col: Column) -> Column:
    """A number in a text, with dollar signs, thousands' commas and (500) for -500; null if it is none."""
    bare = F.regexp_replace(F.trim(col), r"[$,]", "")
    plain = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return F.when(plain.rlike(NUMERIC), F.trim(plain)).try_cast("double")


def parse_where(clause: str) -> tuple[str, str, str]:
    """(column, operator, value) of ``Status=Paid``, ``Amount>100``, ``Vendor~stripe`` or a != clause."""
    for op in ("!=", "=", "<", ">", "~"):
        if op in clause:
            name, value = clause.split(op, 1)
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            return name.strip(), op, value
    raise ValueError(f"no operator in {clause!r}")


def resolve(df: DataFrame, name: str) -> str:
    """A column by its name, whatever the case and outer spaces; unknown and ambiguous names are errors."""
    found = [c for c in df.columns if c.strip().lower() == name.strip().lower()]
    if len(found) != 1:
        raise ValueError(f"{'ambiguous' if found else 'unknown'} column {name!r}; there are {', '.join(df.columns)}")
    return found[0]


def column_at(df: DataFrame, wanted: str) -> str:
    """A column by its name, by its number (from 1) or by its letter, in this order."""
    try:
        return resolve(df, wanted)
    except ValueError as unknown:
        text = wanted.strip()
        place = int(text) if text.isascii() and text.isdigit() else reduce(lambda n, c: n * 26 + ord(c) - 64, text.upper(), 0) if re.fullmatch("[A-Za-z]{1,3}", text) else 0
        if not 1 <= place <= len(df.columns):
            raise unknown
        return df.columns[place - 1]


def where(df: DataFrame, *clauses: str) -> DataFrame:
    """Rows that meet all clauses: numeric where the value is a number, else trimmed and without case."""

    def test(clause: str) -> Column:
        name, op, value = parse_where(clause)
        x = F.col(f"`{resolve(df, name)}`").cast("string")
        if op == "~":
            return F.contains(F.lower(x), F.lit(value.lower()))
        n = re.sub(r"^\((.*)\)$", r"-\1", re.sub(r"[$,]", "", value.strip()))
        if re.match(NUMERIC, n):
            a, b = lenient_number(x), F.lit(float(n))
        elif op in ("=", "!="):
            a, b = F.lower(F.trim(x)), F.lit(value.strip().lower())
        else:
            raise ValueError(f"{op} needs a number, not {value!r}")
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b}[op]

    return df.filter(all_of(*(test(c) for c in clauses)))


def rename(df: DataFrame, **names: str) -> DataFrame:
    """Rename columns in one step, by their names before it."""
    to = {resolve(df, old): new for old, new in names.items()}
    return df.select(*(F.col(f"`{c}`").alias(to.get(c, c)) for c in df.columns))


def select(df: DataFrame, *names: str) -> DataFrame:
    found = [resolve(df, n) for n in names]
    if len(set(found)) < len(found):
        raise ValueError("a column is asked for twice")
    return df.select(*(F.col(f"`{c}`") for c in found))


def grid_condition(col: Column, name: str, *args, text: bool = False) -> Column:
    """One of the sixteen conditions of a grid's filter menu, on a number or text column."""
    s = F.lower(F.coalesce(col.cast("string"), F.lit("")))
    n = F.when(F.trim(s) == "", F.when(col.isNotNull(), 0.0)).otherwise(F.trim(s).try_cast("double")) if text else col.cast("double")
    low = [str(a).lower() for a in args]
    tests = {
        "none": lambda: F.lit(True),
        "empty": lambda: s == "",
        "not_empty": lambda: s != "",
        "eq": lambda: s == low[0] if text else n == float(args[0]),
        "neq": lambda: s != low[0] if text else ~F.coalesce(n == float(args[0]), F.lit(False)),
        "begins_with": lambda: F.startswith(s, F.lit(low[0])),
        "ends_with": lambda: F.endswith(s, F.lit(low[0])),
        "contains": lambda: F.contains(s, F.lit(low[0])),
        "not_contains": lambda: ~F.contains(s, F.lit(low[0])),
        "gt": lambda: n > float(args[0]),
        "gte": lambda: n >= float(args[0]),
        "lt": lambda: n < float(args[0]),
        "lte": lambda: n <= float(args[0]),
        "between": lambda: n.between(min(map(float, args)), max(map(float, args))),
        "not_between": lambda: ~F.coalesce(n.between(min(map(float, args)), max(map(float, args))), F.lit(False)),
        "by_value": lambda: s.isin(*low),
    }
    return F.coalesce(tests[name](), F.lit(False))


def validate(col: Column, rule: str, *, choices: tuple[str, ...] = (), allow_empty: bool = True) -> Column:
    """Whether a cell is valid: text, numeric, date, time, list (one of the choices) or multiselect (comma-joined ones)."""
    s = F.coalesce(col.cast("string"), F.lit(""))
    tests = {
        "text": lambda: F.lit(True),
        "numeric": lambda: s.rlike(NUMERIC),
        "date": lambda: s.rlike(r"^\d{4}-\d{2}-\d{2}$") & s.try_cast("date").isNotNull(),
        "time": lambda: s.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"),
        "list": lambda: s.isin(*choices),
        "multiselect": lambda: F.forall(F.transform(F.split(s, ","), F.trim), lambda x: x.isin(*choices)),
    }
    return F.when(s == "", F.lit(allow_empty)).otherwise(tests[rule]())


def database(df: DataFrame, rows: list[dict[str, object]], kinds: dict[str, str]) -> DataFrame:
    """The records that D-functions take: rows of criteria are alternatives, columns of one row must all hold; a row
    without criteria takes every record."""
    tests = [all_of(F.lit(True), *(criterion(f"`{resolve(df, c)}`", w, kinds.get(c, "text")) for c, w in row.items() if w is not None)) for row in rows]
    return df.filter(any_of(F.lit(False), *tests))


def dget(df: DataFrame, col: str) -> DataFrame:
    """(value, error): the value of exactly one record; none is #VALUE!, several are #NUM!. Two records are read at most a task."""
    two = df.select(F.col(col).alias("v")).limit(2)
    return two.agg(F.when(F.count("*") == 1, F.max("v")).alias("value"), F.when(F.count("*") == 0, "#VALUE!").when(F.count("*") > 1, "#NUM!").alias("error"))
