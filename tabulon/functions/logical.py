"""Logical and information functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.value import ERROR_TYPES, NA, VALUE, Val, as_bool, as_number, compared, errors, failed, function, lift


def unified(vals: list[Val]) -> tuple[list, str]:
    """The columns of several values in one kind: their own if they agree, else text."""
    from tabulon.functions.value import as_text

    kinds = {v.kind for v in vals}
    if len(kinds) == 1:
        return [v.col for v in vals], kinds.pop()
    return [as_text(v).col for v in vals], "text"


def branched(conditions: list[Val], results: list[Val], default: Val) -> Val:
    cols, kind = unified([*results, default])
    value, err = cols[-1], default.err if default.err is not None else F.lit(None).cast("string")
    for c, r, col in reversed(list(zip(conditions, results, cols))):
        good = F.coalesce(c.col, F.lit(False))
        value = F.when(good, col).otherwise(value)
        err = F.when(good, r.err if r.err is not None else F.lit(None).cast("string")).otherwise(err)
        if c.err is not None:
            err = F.coalesce(c.err, err)
    return Val(value, kind, err)


@function("IF", least=2, most=3)
def _if(test, yes, no=None):
    return branched([as_bool(test)], [yes], lift(False) if no is None else no)


@function("IFS", least=2)
def _ifs(*args):
    if len(args) % 2:
        args = args[:-1]
    return branched([as_bool(a) for a in args[::2]], list(args[1::2]), failed(NA))


@function("SWITCH", least=3)
def _switch(x, *args):
    default = args[-1] if len(args) % 2 else failed(NA)
    pairs = args[:-1] if len(args) % 2 else args
    return branched([compared(x, a, lambda c: c == 0) for a in pairs[::2]], list(pairs[1::2]), default)


@function("CHOOSE", least=2)
def _choose(index, *args):
    i = as_number(index)
    return branched([Val(F.floor(i.col) == k, "bool", i.err) for k in range(1, len(args) + 1)], list(args), failed(VALUE))


def on_error(test):
    def apply(x, other):
        bad = F.lit(False) if x.err is None else F.coalesce(test(x.err), F.lit(False))
        cols, kind = unified([x, other])
        none = F.lit(None).cast("string")
        return Val(F.when(bad, cols[1]).otherwise(cols[0]), kind, F.when(bad, none if other.err is None else other.err).otherwise(none if x.err is None else x.err))

    return apply


function("IFERROR", least=2, most=2)(on_error(lambda e: e.isNotNull()))
function("IFNA", least=2, most=2)(on_error(lambda e: e == NA))


def all_of(name: str, combine) -> None:
    @function(name, least=1)
    def apply(*args):
        vals = [as_bool(a) for a in args]
        return Val(combine([v.col for v in vals]), "bool", errors(*vals))


def _fold(op):
    def apply(cols):
        total = cols[0]
        for c in cols[1:]:
            total = op(total, c)
        return total

    return apply


all_of("AND", _fold(lambda a, b: a & b))
all_of("OR", _fold(lambda a, b: a | b))
all_of("XOR", _fold(lambda a, b: a != b))


@function("NOT", least=1, most=1)
def _not(x):
    v = as_bool(x)
    return Val(~v.col, "bool", v.err)


function("TRUE", most=0)(lambda: lift(True))
function("FALSE", most=0)(lambda: lift(False))
function("NA", most=0)(lambda: failed(NA))


def has_error(v: Val, test=lambda e: e.isNotNull()):
    return F.lit(False) if v.err is None else F.coalesce(test(v.err), F.lit(False))


def asked(name: str, f) -> None:
    function(name, least=1, most=1)(lambda v: Val(f(v), "bool"))


fine = lambda v: ~has_error(v) & v.col.isNotNull()
asked("ISBLANK", lambda v: ~has_error(v) & v.col.isNull())
asked("ISERROR", has_error)
asked("ISERR", lambda v: has_error(v, lambda e: e.isNotNull() & (e != NA)))
asked("ISNA", lambda v: has_error(v, lambda e: e == NA))
asked("ISNUMBER", lambda v: fine(v) & F.lit(v.kind == "number"))
asked("ISTEXT", lambda v: fine(v) & F.lit(v.kind == "text"))
asked("ISNONTEXT", lambda v: ~(fine(v) & F.lit(v.kind == "text")))
asked("ISLOGICAL", lambda v: fine(v) & F.lit(v.kind == "bool"))
asked("ISREF", lambda v: F.lit(False))


def parity(name: str, odd: bool) -> None:
    @function(name, least=1, most=1)
    def apply(x):
        v = as_number(x)
        whole = F.when(v.col >= 0, F.floor(v.col)).otherwise(F.ceil(v.col))
        return Val((whole % 2 != 0) == F.lit(odd), "bool", v.err)


parity("ISEVEN", False)
parity("ISODD", True)


@function("N", least=1, most=1)
def _n(v):
    return Val(F.lit(0.0) if v.kind == "text" else as_number(v).col, "number", v.err)


@function("TYPE", least=1, most=1)
def _type(v):
    own = F.when(v.col.isNull(), 1.0).otherwise({"number": 1.0, "text": 2.0, "bool": 4.0}[v.kind])
    return Val(F.when(has_error(v), 16.0).otherwise(own))


@function("ERROR.TYPE", least=1, most=1)
def _error_type(v):
    if v.err is None:
        return failed(NA)
    numbers = F.create_map(*(F.lit(x) for code, n in ERROR_TYPES.items() for x in (code, float(n))))
    return Val(numbers[v.err], "number", F.when(v.err.isNull(), NA))


