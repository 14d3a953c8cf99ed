"""Mathematics and trigonometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.value import DIV0, FUNCTIONS, NUM, VALUE, Val, as_number, as_text, errors, finite, function, lift, numeric

SAFE = float(2**53)


def simple(name: str, f, own=None, least: int = 1, most: int | None = None) -> None:
    made = numeric(f, own)
    function(name, least=least, most=most or least)(made)


def outside(test, code: str = NUM):
    return lambda *x: F.when(test(*x), code)


def ok(test, x: Column, otherwise=None) -> Column:
    """x where the test holds, so that ANSI mode never sees the rest."""
    return F.when(test, x)


def trunc(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def sign(x: Column) -> Column:
    return F.signum(x)


def scaled(x: Column, d: Column, f) -> Column:
    """f of the absolute value at d decimal places; 15 digits are significant."""
    p = F.pow(F.lit(10.0), F.abs(trunc(d)))
    up = F.when(d >= 0, F.abs(x) * p).otherwise(F.abs(x) / p)
    y = f(up)
    return sign(x) * F.when(d >= 0, y / p).otherwise(y * p)


def tidy(x: Column) -> Column:
    """x, moved onto the nearest whole number if it is one to 15 digits."""
    near = F.round(x)
    return F.when(F.abs(x - near) <= F.abs(x) * 1e-15 + 1e-12, near).otherwise(x)


half_up = lambda u: F.floor(tidy(u * 2) / 2 + 0.5).cast("double")
down = lambda u: F.floor(tidy(u)).cast("double")
up = lambda u: F.ceil(u).cast("double")

for name, f in {"ABS": F.abs, "SIGN": F.signum, "EXP": F.exp, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ATAN": F.atan, "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "ASINH": F.asinh, "DEGREES": F.degrees, "RADIANS": F.radians}.items():
    simple(name, f)
simple("INT", lambda x: F.floor(x).cast("double"))
simple("SQRT", lambda x: F.sqrt(ok(x >= 0, x)), outside(lambda x: x < 0))
simple("SQRTPI", lambda x: F.sqrt(ok(x >= 0, x) * math.pi), outside(lambda x: x < 0))
simple("LN", lambda x: F.ln(ok(x > 0, x)), outside(lambda x: x <= 0))
simple("LOG10", lambda x: F.log10(ok(x > 0, x)), outside(lambda x: x <= 0))
simple("SEC", lambda x: 1 / F.cos(x))
simple("SECH", lambda x: 1 / F.cosh(x))
simple("COT", lambda x: 1 / F.tan(ok(x != 0, x)), outside(lambda x: x == 0, DIV0))
simple("CSC", lambda x: 1 / F.sin(ok(x != 0, x)), outside(lambda x: x == 0, DIV0))
simple("COTH", lambda x: 1 / F.tanh(ok(x != 0, x)), outside(lambda x: x == 0, DIV0))
simple("CSCH", lambda x: 1 / F.sinh(ok(x != 0, x)), outside(lambda x: x == 0, DIV0))
simple("ASIN", lambda x: F.asin(x), outside(lambda x: F.abs(x) > 1))
simple("ACOS", lambda x: F.acos(x), outside(lambda x: F.abs(x) > 1))
simple("ACOT", lambda x: math.pi / 2 - F.atan(x))
simple("ACOSH", lambda x: F.acosh(ok(x >= 1, x)), outside(lambda x: x < 1))
simple("ATANH", lambda x: F.atanh(ok(F.abs(x) < 1, x)), outside(lambda x: F.abs(x) >= 1))
simple("ACOTH", lambda x: F.atanh(1 / ok(F.abs(x) > 1, x)), outside(lambda x: F.abs(x) <= 1))
simple("ATAN2", lambda x, y: F.atan2(y, x), outside(lambda x, y: (x == 0) & (y == 0), DIV0), 2)
simple("POWER", F.pow, None, 2)
simple("MOD", lambda n, d: n - ok(d != 0, d) * F.floor(n / ok(d != 0, d)), outside(lambda n, d: d == 0, DIV0), 2)
simple("QUOTIENT", lambda n, d: trunc(n / ok(d != 0, d)), outside(lambda n, d: d == 0, DIV0), 2)
simple("EVEN", lambda n: sign(n) * F.ceil(F.abs(n) / 2) * 2.0)
simple("ODD", lambda n: F.when(n == 0, 1.0).otherwise(sign(n) * (F.ceil((F.abs(n) + 1) / 2) * 2.0 - 1)))
simple("ROUND", lambda x, d: scaled(x, d, half_up), None, 2)
simple("ROUNDUP", lambda x, d: scaled(x, d, up), None, 2)
simple("ROUNDDOWN", lambda x, d: scaled(x, d, down), None, 2)
simple("MROUND", lambda n, m: F.when(m == 0, 0.0).otherwise(sign(n / ok(m != 0, m)) * F.floor(F.abs(n / ok(m != 0, m)) + 0.5) * m), outside(lambda n, m: (n != 0) & (n * m < 0)), 2)


@function("TRUNC", least=1, most=2)
def _trunc(x, d=None):
    return FUNCTIONS["ROUNDDOWN"](x, 0 if d is None else d)


@function("LOG", least=1, most=2)
def _log(x, base=None):
    return numeric(lambda x, b: F.ln(ok(x > 0, x)) / F.ln(ok((b > 0) & (b != 1), b)), lambda x, b: F.when((x <= 0) | (b <= 0), NUM).when(b == 1, DIV0))(x, 10.0 if base is None else base)


def stepped(name: str, kind, zero, guard: bool) -> None:
    """Multiples of a significance: ``kind`` rounds, ``zero`` is the outcome for a significance of 0."""

    @function(name, least=1, most=2)
    def f(n, s=None):
        step = lambda s: s if guard else F.abs(s)
        value = lambda n, s: F.when(s == 0, F.lit(0.0)).otherwise(kind(n / step(ok(s != 0, s))) * step(s))
        return numeric(value, lambda n, s: F.when((n > 0) & (s < 0) if guard else F.lit(False), NUM).when((s == 0) if zero else F.lit(False), zero))(n, 1.0 if s is None else s)


stepped("CEILING", F.ceil, None, True)
stepped("FLOOR", F.floor, DIV0, True)
stepped("CEILING.PRECISE", F.ceil, None, False)
stepped("FLOOR.PRECISE", F.floor, None, False)


def with_mode(name: str, toward, away) -> None:
    @function(name, least=1, most=3)
    def f(n, s=None, mode=None):
        def value(n, s, m):
            q = n / F.abs(ok(s != 0, s))
            return F.when(s == 0, 0.0).otherwise(F.when((n < 0) & (m != 0), away(q)).otherwise(toward(q)) * F.abs(s))

        return numeric(value)(n, 1.0 if s is None else s, 0.0 if mode is None else mode)


with_mode("CEILING.MATH", F.ceil, F.floor)
with_mode("FLOOR.MATH", F.floor, F.ceil)

def factorials() -> Column:
    return F.array(*(F.lit(float(math.factorial(n))) for n in range(171)))


simple("FACT", lambda n: F.element_at(factorials(), F.when((n >= 0) & (n < 171), F.floor(n)).otherwise(0).cast("int") + 1), outside(lambda n: (n < 0) | (n >= 171)))


def product_of(count: Column, term) -> Column:
    """Product of term(i) for i in 0 .. count - 1."""
    steps = F.sequence(F.lit(0), F.greatest(count.cast("int") - 1, F.lit(0)))
    return F.when(count < 1, 1.0).otherwise(F.aggregate(steps, F.lit(1.0), lambda a, i: a * term(i.cast("double"))))


simple("FACTDOUBLE", lambda n: product_of(F.ceil(F.least(trunc(n), F.lit(400.0)) / 2), lambda i: F.greatest(trunc(n) - 2 * i, F.lit(1.0))), outside(lambda n: n < -1))


def choose(n: Column, k: Column) -> Column:
    k = F.least(k, n - k)
    return F.round(product_of(F.when((k >= 0) & (k < 1e6), k).otherwise(0), lambda i: (n - i) / (i + 1)) * 1.0)


bad_pair = lambda n, k: (trunc(n) < 0) | (trunc(k) < 0) | (trunc(k) > trunc(n))
simple("COMBIN", lambda n, k: choose(trunc(n), trunc(k)), outside(bad_pair), 2)
simple("COMBINA", lambda n, k: F.when((trunc(n) == 0) & (trunc(k) == 0), 1.0).otherwise(choose(trunc(n) + trunc(k) - 1, trunc(k))), outside(lambda n, k: (n < 0) | (k < 0)), 2)
simple("PERMUT", lambda n, k: product_of(F.when(bad_pair(n, k), 0).otherwise(trunc(k)), lambda i: trunc(n) - i), outside(bad_pair), 2)
simple("PERMUTATIONA", lambda n, k: F.pow(trunc(n), trunc(k)), outside(lambda n, k: (n < 0) | (k < 0)), 2)


def euclid(a: Column, b: Column) -> Column:
    """Greatest common divisor: 80 steps reach any pair below 2^53."""
    state = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] - s["b"] * F.floor(s["a"] / F.when(s["b"] != 0, s["b"]))).alias("b"))))
    return state["a"]


def folded(name: str, f) -> None:
    @function(name, least=1)
    def apply(*args):
        vals = [as_number(a) for a in args]
        bad = F.greatest(*(F.when((v.col < 0) | (v.col >= SAFE), 1).otherwise(0) for v in [*vals, vals[0]])) == 1
        total = F.when(~bad, trunc(vals[0].col))
        for v in vals[1:]:
            total = f(total, F.when(~bad, trunc(v.col)))
        return finite(total, errors(*vals, own=F.when(bad, NUM)))


folded("GCD", euclid)
folded("LCM", lambda a, b: F.when((a == 0) | (b == 0), 0.0).otherwise(a / euclid(a, b) * b))


@function("MULTINOMIAL", least=1)
def _multinomial(*args):
    vals = [as_number(a) for a in args]
    fact = lambda x: F.element_at(factorials(), F.when((x >= 0) & (x < 171), F.floor(x)).otherwise(0).cast("int") + 1)
    total = vals[0].col
    below = fact(vals[0].col)
    for v in vals[1:]:
        total, below = total + v.col, below * fact(v.col)
    bad = F.least(*(v.col for v in [*vals, vals[0]])) < 0
    return finite(fact(total) / below, errors(*vals, own=F.when(bad | (total >= 171), VALUE)))


@function("PI", most=0)
def _pi():
    return lift(math.pi)


@function("BASE", least=2, most=3)
def _base(n, radix, width=None):
    n, r, w = as_number(n), as_number(radix), as_number(lift(0 if width is None else width))
    bad = (n.col < 0) | (n.col >= SAFE) | (r.col < 2) | (r.col >= 37)
    text = by_radix(F.when(~bad, F.floor(n.col)).cast("string"), F.lit(10), r.col)
    return Val(F.when(F.length(text) < w.col, F.lpad(text, 255, "0").substr(F.lit(256) - w.col.cast("int"), w.col.cast("int"))).otherwise(text), "text", errors(n, r, w, own=F.when(bad, NUM)))


def by_radix(text: Column, of, to) -> Column:
    """conv() needs literal radixes; a row's radix picks one of 35."""
    pick = lambda x, made: F.coalesce(*(F.when(x == k, made(k)) for k in range(2, 37)))
    if isinstance(to, Column):
        return pick(F.floor(to), lambda k: F.conv(text, 10, k))
    return pick(F.floor(of), lambda k: F.conv(text, k, 10))


@function("DECIMAL", least=2, most=2)
def _decimal(text, radix):
    t, r = as_text(text), as_number(radix)
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    s = F.upper(F.trim(t.col))
    good = F.coalesce(*(F.when(F.floor(r.col) == k, s.rlike(f"^[{digits[:k]}]+$")) for k in range(2, 37)), F.lit(False)) & (F.length(s) <= 12)
    return Val(by_radix(F.when(good, s), r.col, None).cast("double"), "number", errors(t, r, own=F.when(~good, NUM)))


#: Roman numerals of thousands, hundreds, tens and ones.
ROMANS = (["", "M", "MM", "MMM"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])


@function("ROMAN", least=1, most=2)
def _roman(n, form=None):
    v = as_number(n)
    bad = (v.col < 0) | (v.col >= 4000)
    x = F.when(~bad, F.floor(v.col)).cast("int")
    parts = [F.element_at(F.array(*map(F.lit, names)), (F.floor(x / 10**p) % 10).cast("int") + 1) for p, names in zip((3, 2, 1, 0), ROMANS)]
    return Val(F.concat(*parts), "text", errors(v, own=F.when(bad, VALUE)))


@function("ARABIC", least=1, most=1)
def _arabic(text):
    t = as_text(text)
    s = F.upper(F.trim(t.col))
    body = F.regexp_replace(s, "^-", "")
    good = body.rlike("^[MDCLXVI]*$")
    worth = F.create_map(*(F.lit(x) for pair in zip("IVXLCDM", (1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1000.0)) for x in pair))
    digits = F.filter(F.split(F.when(good, body), ""), lambda c: c != "")
    # from the right: a digit below the largest seen so far counts against the total
    state = F.aggregate(F.reverse(digits), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("most")), lambda a, c: F.struct((a["sum"] + F.when(worth[c] < a["most"], -worth[c]).otherwise(worth[c])).alias("sum"), F.greatest(a["most"], worth[c]).alias("most")))
    return Val(state["sum"] * F.when(s.startswith("-"), -1.0).otherwise(1.0), "number", errors(t, own=F.when(~good, VALUE)))


def mixed_bits(x: Column) -> Column:
    """An even spread of a key's bits, as a number in [0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(x), 11).cast("double")) / float(1 << 53)


def rand(key: Column, seed: int = 0) -> Val:
    """RAND for a row key: the same for the same key and seed."""
    return Val(mixed_bits(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))))


def randbetween(low, high, key: Column, seed: int = 0) -> Val:
    a, b = as_number(lift(low)), as_number(lift(high))
    lo, hi = F.ceil(a.col), F.floor(b.col)
    return Val((lo + F.floor(rand(key, seed).col * (hi - lo + 1))).cast("double"), "number", errors(a, b, own=F.when(lo > hi, NUM)))
