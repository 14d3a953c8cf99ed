"""Values with errors, at plan level.

A ``Val`` is a pair of Columns: the value, and an error code that is null where there is none. Functions combine pairs
into pairs, so that a whole formula is one Catalyst expression: no Python runs per row. Kinds are known when the plan is
made: number (double), text or bool; null is a blank. Errors travel from the first argument that has one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DIV0, NA, NAME, NUM, REF, VALUE = "#DIV/0!", "#N/A", "#NAME?", "#NUM!", "#REF!", "#VALUE!"
CALC, SPILL, CYCLE, NULL = "#CALC!", "#SPILL!", "#CYCLE!", "#NULL!"
#: Numbers of error codes.
ERROR_TYPES = {NULL: 1, DIV0: 2, VALUE: 3, REF: 4, NAME: 5, NUM: 6, NA: 7, SPILL: 9, CALC: 14, CYCLE: 20}
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


@dataclass
class Val:
    col: Column
    kind: str = "number"
    err: Column | None = None
    #: The struct (value, err) that both come from, where they are evaluated at once; its value is null beside an error.
    whole: Column | None = None

    def both(self) -> Column:
        """The value and its error as one struct."""
        if self.whole is not None:
            return self.whole
        return F.struct(self.col.alias("value"), (F.lit(None).cast("string") if self.err is None else self.err).alias("err"))

    def named(self, name: str) -> Column:
        """The value where there is no error, as a column."""
        return (self.col if self.whole is not None or self.err is None else F.when(self.err.isNull(), self.col)).alias(name)

    def error(self, name: str) -> Column:
        return (F.lit(None).cast("string") if self.err is None else self.err).alias(name)

    def shown(self, name: str) -> Column:
        """Display text: the value, or its error code."""
        text = as_text(self).col
        return (text if self.err is None else F.coalesce(self.err, text)).alias(name)

    def __add__(self, o):
        return arithmetic(self, o, lambda x, y: x + y)

    def __radd__(self, o):
        return lift(o) + self

    def __sub__(self, o):
        return arithmetic(self, o, lambda x, y: x - y)

    def __rsub__(self, o):
        return lift(o) - self

    def __mul__(self, o):
        return arithmetic(self, o, lambda x, y: x * y)

    def __rmul__(self, o):
        return lift(o) * self

    def __truediv__(self, o):
        return arithmetic(self, o, lambda x, y: x / F.nullif(y, F.lit(0.0)), lambda x, y: F.when(y == 0, DIV0))

    def __rtruediv__(self, o):
        return lift(o) / self

    def __pow__(self, o):
        return arithmetic(self, o, F.pow)

    def __neg__(self):
        return arithmetic(self, 0.0, lambda x, _: -x)

    def percent(self):
        return self / 100.0

    def __and__(self, o):
        """Concatenation of texts."""
        x, y = as_text(self), as_text(lift(o))
        return Val(F.concat(x.col, y.col), "text", errors(x, y))

    def __eq__(self, o):
        return compared(self, o, lambda c: c == 0)

    def __ne__(self, o):
        return compared(self, o, lambda c: c != 0)

    def __lt__(self, o):
        return compared(self, o, lambda c: c < 0)

    def __le__(self, o):
        return compared(self, o, lambda c: c <= 0)

    def __gt__(self, o):
        return compared(self, o, lambda c: c > 0)

    def __ge__(self, o):
        return compared(self, o, lambda c: c >= 0)

    __hash__ = None


def number(col: Column | str) -> Val:
    return Val((F.col(col) if isinstance(col, str) else col).cast("double"))


def string(col: Column | str) -> Val:
    return Val((F.col(col) if isinstance(col, str) else col).cast("string"), "text")


def boolean(col: Column | str) -> Val:
    return Val((F.col(col) if isinstance(col, str) else col).cast("boolean"), "bool")


def at_once(whole: Column, kind: str) -> Val:
    """A value and its error from the struct (value, err), whose value is null beside an error."""
    return Val(whole["value"], kind, whole["err"], whole)


def failed(code: str) -> Val:
    return Val(F.lit(None).cast("double"), "number", F.lit(code))


def lift(x) -> Val:
    """Python literals become values; None is a blank."""
    if isinstance(x, Val):
        return x
    if isinstance(x, bool):
        return Val(F.lit(x), "bool")
    if x is None or isinstance(x, (int, float)):
        return Val(F.lit(x).cast("double"))
    if isinstance(x, str):
        return Val(F.lit(x), "text")
    raise TypeError(f"a column needs its kind: number(), string() or boolean(), not {type(x)}")


def errors(*vals: Val, own: Column | None = None) -> Column | None:
    """The first argument's error, else the function's own."""
    found = [v.err for v in vals if v.err is not None] + ([own] if own is not None else [])
    return F.coalesce(*found) if len(found) > 1 else found[0] if found else None


def as_number(v: Val) -> Val:
    """Blank is 0, a bool 0 or 1; text counts only if all of it is a number, or one and a percent sign."""
    if v.kind == "number":
        return filled(v, lambda c: F.coalesce(c, F.lit(0.0)))
    if v.kind == "bool":
        return Val(F.coalesce(v.col.cast("double"), F.lit(0.0)), "number", v.err)
    plain = F.regexp_replace(v.col, r"%\s*$", "")
    good = plain.rlike(NUMERIC)
    x = F.when(good, F.trim(plain).try_cast("double")) / F.when(v.col.rlike(r"%\s*$"), 100.0).otherwise(1.0)
    return Val(F.when(v.col.isNull(), 0.0).otherwise(x), "number", errors(v, own=F.when(v.col.isNotNull() & x.isNull(), VALUE)))


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f holds it: plans stay as long as what is written."""
    return F.get(F.transform(F.array(x), lambda y: f(y)), F.lit(0))


def number_text(x: Column) -> Column:
    """15 significant digits; powers of ten outside [1e-10, 1e21)."""
    return bind(x, _number_text)


def _number_text(x: Column) -> Column:
    size = F.abs(x)
    digits = (F.lit(14) - F.floor(F.log10(F.when(size > 0, size).otherwise(1.0)))).cast("int")
    whole = (x == F.floor(x)) & (size < 1e15)
    fixed = F.round(F.when((size >= 1e-10) & (size < 1e15), x).cast("decimal(38,18)"), 18).cast("string")
    cut = lambda scale: bind(fixed, lambda d: F.substring(d, F.lit(1), F.instr(d, ".") + scale))
    rounded = bind(F.greatest(F.lit(0), F.least(digits, F.lit(18))), lambda scale: F.when(scale < 18, _round_text(x, scale)).otherwise(cut(scale)))
    trimmed = F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    sci = F.regexp_replace(x.cast("string"), r"\.0E|E", "E")
    sci = F.regexp_replace(F.regexp_replace(sci, r"E(\d)", "E+$1"), r"E([+-])(\d)$", "E$10$2")
    return F.when(whole, x.cast("long").cast("string")).when((size >= 1e-10) & (size < 1e15), trimmed).when((size >= 1e15) & (size < 1e21), x.cast("decimal(38,0)").cast("string")).otherwise(sci)


def _round_text(x: Column, scale: Column) -> Column:
    """A number of 15 significant digits with as many decimal places as its row has."""
    units = F.round(F.abs(x) * F.pow(F.lit(10.0), scale.cast("double"))).cast("long").cast("string")

    def pointed(digits: Column) -> Column:
        cut = F.length(digits) - scale
        return F.concat(F.when(x < 0, "-").otherwise(""), digits.substr(F.lit(1), cut), F.lit("."), digits.substr(cut + 1, scale))

    return bind(bind(units, lambda u: F.lpad(u, F.greatest(scale + 1, F.length(u)), F.lit("0"))), pointed)


def filled(v: Val, f: Callable[[Column], Column]) -> Val:
    """f of the value, of the same kind."""
    if v.whole is None:
        return Val(f(v.col), v.kind, v.err)
    return at_once(bind(v.whole, lambda w: F.struct(F.when(w["err"].isNull(), f(w["value"])).alias("value"), w["err"].alias("err"))), v.kind)


def as_text(v: Val) -> Val:
    if v.kind == "text":
        return filled(v, lambda c: F.coalesce(c, F.lit("")))
    if v.kind == "bool":
        return Val(F.coalesce(F.upper(v.col.cast("string")), F.lit("")), "text", v.err)
    return Val(F.coalesce(number_text(v.col), F.lit("")), "text", v.err)


def as_bool(v: Val) -> Val:
    if v.kind == "bool":
        return Val(F.coalesce(v.col, F.lit(False)), "bool", v.err)
    if v.kind == "number":
        return Val(F.coalesce(v.col != 0, F.lit(False)), "bool", v.err)
    upper = F.upper(v.col)
    known = F.when(v.col.isNull() | (upper == "FALSE"), False).when(upper == "TRUE", True)
    return Val(known, "bool", errors(v, own=F.when(known.isNull(), VALUE)))


def finite(x: Column, err: Column | None) -> Val:
    """A number; what is not one, or not finite, is #NUM!."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return Val(x, "number", errors(Val(x, "number", err), own=F.when(bad, NUM)))


def numeric(f: Callable[..., Column], own: Callable[..., Column | None] | None = None) -> Callable[..., Val]:
    """A function of numbers; ``own`` gives the function's own error code or null."""

    def apply(*args) -> Val:
        vals = [as_number(lift(a)) for a in args]
        cols = [v.col for v in vals]
        return finite(f(*cols), errors(*vals, own=None if own is None else own(*cols)))

    return apply


def arithmetic(a, b, f, own=None) -> Val:
    return numeric(f, own)(a, b)


def compared(a, b, test) -> Val:
    """Numbers come before texts and texts before bools; texts compare in lower case; a blank equals 0, "" and FALSE."""
    a, b = lift(a), lift(b)
    rank = {"number": 0, "text": 1, "bool": 2}
    if a.kind == b.kind:
        empty = {"number": 0.0, "text": "", "bool": False}[a.kind]
        x, y = (F.coalesce(F.lower(v.col) if a.kind == "text" else v.col, F.lit(empty)) for v in (a, b))
        order = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    else:
        blank = lambda v, other: v.col.isNull() & {"number": other.col == 0, "text": F.length(other.col.cast("string")) == 0, "bool": F.lower(other.col.cast("string")) == "false"}[other.kind]
        order = F.when(blank(a, b) | blank(b, a), 0).otherwise(-1 if rank[a.kind] < rank[b.kind] else 1)
    return Val(test(order), "bool", errors(a, b))


#: Every scalar function by its name.
FUNCTIONS: dict[str, Callable[..., Val]] = {}


def function(*names: str, least: int = 0, most: int | None = None):
    """Register a function; a wrong number of arguments gives #VALUE!."""

    def register(f):
        def checked(*args) -> Val:
            if len(args) < least or most is not None and len(args) > most:
                return failed(VALUE)
            return f(*[lift(a) for a in args])

        for name in names:
            FUNCTIONS[name] = checked
        return f

    return register


def call(name: str, *args) -> Val:
    """A function by name, in any case and with or without a vendor prefix; an unknown one gives #NAME?."""
    key = name.upper()
    for prefix in ("_XLFN.", "_XLUDF."):
        key = key.removeprefix(prefix)
    return FUNCTIONS[key](*args) if key in FUNCTIONS else failed(NAME)


def fold(f, items):
    return reduce(f, items)
