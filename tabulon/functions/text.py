"""Text functions. Positions and lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.value import NUMERIC, VALUE, Val, as_bool, as_number, as_text, errors, function, lift

LONGEST = 32767


def texts(name: str, f) -> None:
    @function(name, least=1, most=1)
    def apply(x):
        v = as_text(x)
        return Val(f(v.col), "text", v.err)


def whole(v: Val) -> Column:
    return F.when(F.abs(v.col) < 2**31, F.when(v.col >= 0, F.floor(v.col)).otherwise(F.ceil(v.col))).otherwise(2**31 - 1).cast("int")


texts("LOWER", F.lower)
texts("UPPER", F.upper)
texts("TRIM", lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
texts("CLEAN", lambda s: F.regexp_replace(s, r"\p{Cc}", ""))
#: A letter after anything but a letter is a capital; other letters are not.
texts("PROPER", lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), 1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, LONGEST)))), ""))


@function("LEN", least=1, most=1)
def _len(x):
    v = as_text(x)
    return Val(F.length(v.col).cast("double"), "number", v.err)


def side(name: str, f) -> None:
    @function(name, least=1, most=2)
    def apply(x, n=None):
        v, k = as_text(x), as_number(lift(1 if n is None else n))
        return Val(f(v.col, F.greatest(whole(k), F.lit(0))), "text", errors(v, k, own=F.when(k.col < 0, VALUE)))


side("LEFT", lambda s, n: s.substr(F.lit(1), n))
side("RIGHT", lambda s, n: s.substr(F.greatest(F.length(s) - n + 1, F.lit(1)), F.least(n, F.length(s))))


@function("MID", least=3, most=3)
def _mid(x, start, n):
    v, a, k = as_text(x), as_number(start), as_number(n)
    return Val(v.col.substr(F.greatest(whole(a), F.lit(1)), F.greatest(whole(k), F.lit(0))), "text", errors(v, a, k, own=F.when((a.col < 1) | (k.col < 0), VALUE)))


@function("REPT", least=2, most=2)
def _rept(x, n):
    v, k = as_text(x), as_number(n)
    bad = (k.col < 0) | (F.length(v.col) * F.floor(k.col) > LONGEST)
    return Val(F.repeat(v.col, F.when(bad, 0).otherwise(whole(k))), "text", errors(v, k, own=F.when(bad, VALUE)))


@function("CONCATENATE", "CONCAT", least=1)
def _concat(*args):
    vals = [as_text(a) for a in args]
    return Val(F.concat(*(v.col for v in vals)), "text", errors(*vals))


@function("TEXTJOIN", least=3)
def _textjoin(separator, skip, *args):
    s, k, vals = as_text(separator), as_bool(skip), [as_text(a) for a in args]
    joined = F.array_join(F.filter(F.array(*(v.col for v in vals)), lambda x: ~k.col | (x != "")), "\x00")
    return Val(F.replace(joined, F.lit("\x00"), s.col), "text", errors(s, k, *vals))


@function("EXACT", least=2, most=2)
def _exact(a, b):
    x, y = as_text(a), as_text(b)
    return Val(x.col == y.col, "bool", errors(x, y))


def finder(name: str, f) -> None:
    @function(name, least=2, most=3)
    def apply(needle, hay, start=None):
        n, h, s = as_text(needle), as_text(hay), as_number(lift(1 if start is None else start))
        at = F.position(f(n.col), f(h.col), F.greatest(whole(s), F.lit(1)))
        bad = (s.col < 1) | (s.col > F.length(h.col) + 1) | (at == 0)
        return Val(at.cast("double"), "number", errors(n, h, s, own=F.when(bad, VALUE)))


finder("FIND", lambda c: c)
finder("SEARCH", F.lower)


@function("SUBSTITUTE", least=3, most=4)
def _substitute(x, old, new, nth=None):
    v, o, w = as_text(x), as_text(old), as_text(new)
    if nth is None:
        return Val(F.when(o.col == "", v.col).otherwise(F.replace(v.col, o.col, w.col)), "text", errors(v, o, w))
    k = as_number(nth)
    i = whole(k)
    before = nth_part(v.col, o.col, i)
    found = F.length(before) < F.length(v.col)
    changed = F.concat(before, w.col, v.col.substr(F.length(before) + F.length(o.col) + 1, F.lit(LONGEST)))
    return Val(F.when((o.col == "") | ~found, v.col).otherwise(changed), "text", errors(v, o, w, k, own=F.when(k.col < 1, VALUE)))


def nth_part(text: Column, mark: Column, n: Column) -> Column:
    """What stands before the n-th place of a mark; the whole text where there are fewer."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), F.when(mark == "", "\x00").otherwise(mark), F.lit(r"\E")))
    return F.when(F.size(parts) <= n, text).otherwise(joined(F.slice(parts, F.lit(1), F.greatest(n, F.lit(1))), mark))


def joined(parts: Column, mark: Column) -> Column:
    return F.replace(F.array_join(parts, "\x00"), F.lit("\x00"), mark)


@function("REPLACE", least=4, most=4)
def _replace(x, start, n, new):
    v, a, k, w = as_text(x), as_number(start), as_number(n), as_text(new)
    i, m = F.greatest(whole(a), F.lit(1)), F.greatest(whole(k), F.lit(0))
    made = F.concat(v.col.substr(F.lit(1), i - 1), w.col, v.col.substr(i + F.least(m, F.lit(LONGEST)), F.lit(LONGEST)))
    return Val(made, "text", errors(v, a, k, w, own=F.when((a.col < 1) | (k.col < 0), VALUE)))


@function("T", least=1, most=1)
def _t(v):
    return Val(v.col if v.kind == "text" else F.lit(""), "text", v.err)


@function("VALUE", least=1, most=1)
def _value(x):
    v = as_text(x)
    n = as_number(Val(F.when(v.col == "", F.lit("?")).otherwise(v.col), "text", v.err)) if x.kind == "text" else as_number(x)
    return n


@function("NUMBERVALUE", least=1, most=3)
def _numbervalue(x, decimal=None, group=None):
    v, d, g = as_text(x), as_text(lift("." if decimal is None else decimal)), as_text(lift("," if group is None else group))
    bare = F.replace(F.regexp_replace(v.col, r"\s", ""), g.col, F.lit(""))
    plain = F.replace(bare, d.col, F.lit("."))
    percent = F.length(F.regexp_extract(plain, "(%*)$", 1)).cast("double")
    body = F.regexp_replace(plain, "%+$", "")
    good = body.rlike(NUMERIC) | (body == "")
    n = F.when(body == "", 0.0).otherwise(F.when(good, body).try_cast("double")) / F.pow(F.lit(100.0), percent)
    return Val(n, "number", errors(v, d, g, own=F.when(~good, VALUE)))


@function("CHAR", least=1, most=1)
def _char(n):
    v = as_number(n)
    bad = (v.col < 1) | (v.col >= 256)
    return Val(F.char(F.when(bad, 63).otherwise(F.floor(v.col)).cast("int")), "text", errors(v, own=F.when(bad, VALUE)))


@function("UNICHAR", least=1, most=1)
def _unichar(n):
    v = as_number(n)
    x = F.floor(v.col)
    bad = (x < 1) | (x > 0x10FFFF) | ((x >= 0xD800) & (x < 0xE000))
    k = F.when(bad, 63).otherwise(x).cast("int")
    low = lambda shift: F.shiftright(k, shift).bitwiseAND(63)
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    two = F.concat(byte(F.shiftright(k, 6) + 0xC0), byte(low(0) + 0x80))
    three = F.concat(byte(F.shiftright(k, 12) + 0xE0), byte(low(6) + 0x80), byte(low(0) + 0x80))
    four = F.concat(byte(F.shiftright(k, 18) + 0xF0), byte(low(12) + 0x80), byte(low(6) + 0x80), byte(low(0) + 0x80))
    encoded = F.when(k < 0x80, byte(k)).when(k < 0x800, two).when(k < 0x10000, three).otherwise(four)
    return Val(F.decode(F.unhex(encoded), "UTF-8"), "text", errors(v, own=F.when(bad, VALUE)))


@function("CODE", "UNICODE", least=1, most=1)
def _code(x):
    v = as_text(x)
    return Val(F.ascii(F.substring(v.col, 1, 1)).cast("double"), "number", errors(v, own=F.when(v.col == "", VALUE)))
