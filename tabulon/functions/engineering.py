"""Number bases, bits, units and complex numbers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.distributions import special
from tabulon.functions.value import NA, NUM, VALUE, Val, as_number, as_text, at_once, bind, errors, finite, function, lift, number_text, numeric

#: Name, radix, bits and digits of the bases.
BASES = {"BIN": (2, 10), "OCT": (8, 30), "HEX": (16, 40)}


def to_decimal(text: Column, radix: int, bits: int) -> tuple[Column, Column]:
    """The number that a two's complement text stands for, and whether it is one."""
    s = F.upper(F.trim(text))
    good = s.rlike(f"^[{'0123456789ABCDEF'[:radix]}]{{0,10}}$")
    n = F.conv(F.when(good, F.when(s == "", "0").otherwise(s)), radix, 10).cast("double")
    return F.when(n >= float(1 << bits - 1), n - float(1 << bits)).otherwise(n), ~good


def from_decimal(n: Column, radix: int, bits: int, places: Column | None) -> tuple[Column, Column]:
    """A two's complement text; places pads numbers that are not negative."""
    whole = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("double")
    bad = (whole < -float(1 << bits - 1)) | (whole >= float(1 << bits - 1))
    text = F.conv(F.when(~bad, F.when(whole < 0, whole + float(1 << bits)).otherwise(whole)).cast("long").cast("string"), 10, radix)
    if places is None:
        return text, bad
    width = F.floor(places).cast("int")
    short = (whole >= 0) & ((width < F.length(text)) | (width > 10))
    return F.when(whole < 0, text).otherwise(F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(text), F.lit(0))), text)), bad | short


def bases(name: str, source: str | None, target: str | None) -> None:
    @function(name, least=1, most=1 if target is None else 2)
    def apply(x, places=None):
        if source is None:
            v = as_number(x)
            n, bad = v.col, F.lit(False)
        else:
            v = as_text(x)
            n, bad = to_decimal(v.col, *BASES[source])
        if target is None:
            return Val(n, "number", errors(v, own=F.when(bad, NUM)))
        p = None if places is None else as_number(places)
        text, wrong = from_decimal(n, *BASES[target], None if p is None else p.col)
        return Val(text, "text", errors(v, *([p] if p else []), own=F.when(bad | wrong, NUM)))


for one in BASES:
    bases(f"{one}2DEC", one, None)
    bases(f"DEC2{one}", None, one)
    for other in BASES:
        if other != one:
            bases(f"{one}2{other}", one, other)

LIMIT = float(1 << 48)


def bits(name: str, f) -> None:
    bad = lambda x, y: (x < 0) | (y < 0) | (x >= LIMIT) | (y >= LIMIT) | (x != F.floor(x)) | (y != F.floor(y))
    safe = lambda x: F.when((x >= 0) & (x < LIMIT), x).cast("long")
    function(name, least=2, most=2)(numeric(lambda x, y: f(safe(x), safe(y)).cast("double"), lambda x, y: F.when(bad(x, y), NUM)))


bits("BITAND", lambda x, y: x.bitwiseAND(y))
bits("BITOR", lambda x, y: x.bitwiseOR(y))
bits("BITXOR", lambda x, y: x.bitwiseXOR(y))


def shift(name: str, way: int) -> None:
    def value(x, n):
        return F.floor(x * F.pow(F.lit(2.0), way * F.floor(n))).cast("double")

    bad = lambda x, n: (x < 0) | (x >= LIMIT) | (x != F.floor(x)) | (F.abs(n) > 53) | (x * F.pow(F.lit(2.0), way * F.floor(n)) >= LIMIT)
    function(name, least=2, most=2)(numeric(lambda x, n: F.when(~bad(x, n), value(x, n)), lambda x, n: F.when(bad(x, n), NUM)))


shift("BITLSHIFT", 1)
shift("BITRSHIFT", -1)


@function("DELTA", least=1, most=2)
def _delta(x, y=None):
    return numeric(lambda a, b: (a == b).cast("double"))(x, 0 if y is None else y)


@function("GESTEP", least=1, most=2)
def _gestep(x, y=None):
    return numeric(lambda a, b: (a >= b).cast("double"))(x, 0 if y is None else y)


@function("ERF", least=1, most=2)
def _erf(a, b=None):
    f = special(math.erf)
    return numeric(lambda x: f(x))(a) if b is None else numeric(lambda x, y: f(y) - f(x))(a, b)


function("ERF.PRECISE", least=1, most=1)(numeric(lambda x: special(math.erf)(x)))
function("ERFC", "ERFC.PRECISE", least=1, most=1)(numeric(lambda x: special(math.erfc)(x)))

#: Units of each quantity and their sizes in its base unit.
UNITS = {
    "mass": {"g": 1.0, "sg": 14593.9029372064, "lbm": 453.59237, "u": 1.660538782e-24, "ozm": 28.349523125, "grain": 0.06479891, "cwt": 45359.237, "uk_cwt": 50802.34544, "stone": 6350.29318, "ton": 907184.74, "uk_ton": 1016046.9088},
    "length": {"m": 1.0, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9460730472580800.0, "pc": 3.0856775813066e16, "Picapt": 0.0254 / 72, "pica": 0.0254 / 6, "survey_mi": 1609.3472186944},
    "time": {"yr": 31557600.0, "day": 86400.0, "d": 86400.0, "hr": 3600.0, "mn": 60.0, "min": 60.0, "sec": 1.0, "s": 1.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.75729316836, "Torr": 101325.0 / 760},
    "force": {"N": 1.0, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176487e-19, "ev": 1.602176487e-19, "HPh": 2684519.537696173, "hh": 2684519.537696173, "Wh": 3600.0, "wh": 3600.0, "flb": 1.3558179483314004, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"HP": 745.69987158227, "h": 745.69987158227, "W": 1.0, "w": 1.0, "PS": 735.49875},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"l": 1.0, "L": 1.0, "lt": 1.0, "tsp": 0.004928921594, "tbs": 0.014786764781, "oz": 0.029573529562, "cup": 0.2365882365, "pt": 0.473176473, "us_pt": 0.473176473, "uk_pt": 0.56826125, "qt": 0.946352946, "gal": 3.785411784, "uk_gal": 4.54609, "m3": 1000.0, "ft3": 28.316846592, "in3": 0.016387064},
    "area": {"m2": 1.0, "ha": 10000.0, "us_acre": 4046.872609874252, "uk_acre": 4046.8564224, "ft2": 0.09290304, "in2": 0.00064516, "yd2": 0.83612736, "mi2": 2589988.110336},
    "information": {"bit": 1.0, "byte": 8.0},
    "speed": {"m/s": 1.0, "m/h": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600, "admkn": 0.5147733333333333},
}
PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "e": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24}
PREFIXED = {"g", "m", "s", "sec", "Pa", "N", "J", "W", "l", "L", "T", "eV", "cal", "bit", "byte", "Wh", "e", "dyn"}


def unit_size(name: str) -> tuple[str, float] | None:
    for quantity, units in UNITS.items():
        if name in units:
            return quantity, units[name]
    for prefix, size in PREFIXES.items():
        rest = name.removeprefix(prefix)
        if rest != name and rest in PREFIXED:
            quantity, base = unit_size(rest)
            return quantity, base * size
    return None


def known_units() -> dict[str, tuple[str, float]]:
    names = {u for units in UNITS.values() for u in units}
    return {n: unit_size(n) for n in [*names, *(p + u for p in PREFIXES for u in PREFIXED if p + u not in names)]}


@function("CONVERT", least=3, most=3)
def _convert(x, a, b):
    v, s, t = as_number(x), as_text(a), as_text(b)
    table = known_units()
    size = F.create_map(*(F.lit(y) for n, (_, f) in table.items() for y in (n, f)))
    kind = F.create_map(*(F.lit(y) for n, (q, _) in table.items() for y in (n, q)))
    good = F.coalesce(kind[s.col] == kind[t.col], F.lit(False))
    return finite(F.when(good, v.col * F.try_element_at(size, s.col) / F.try_element_at(size, t.col)), errors(v, s, t, own=F.when(~good, NA)))


# Complex numbers: text a+bi outside, a struct (re, im, suffix, err) inside.

UNSIGNED = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
COMPLEX = rf"^\s*([+-]?{UNSIGNED}(?![\d.eE]*[ij]))?(?:([+-]?(?:{UNSIGNED})?)([ij]))?\s*$"


def parsed(x: Val) -> Column:
    """The struct of a complex number: re, im, suffix, err."""

    def split(v: Column) -> Column:
        part = [F.regexp_extract(v["value"], COMPLEX, i).alias(f"p{i}") for i in (1, 2, 3)]
        good = (v["value"].rlike(COMPLEX) & (F.trim(v["value"]) != "")).alias("good")
        return bind(F.struct(*part, good, v["err"].alias("err")), made)

    def made(p: Column) -> Column:
        n = F.when(p["p2"].isin("", "+", "-"), F.concat(p["p2"], F.lit("1"))).otherwise(p["p2"]).try_cast("double")
        re, im = F.when(p["p1"] == "", 0.0).otherwise(p["p1"].try_cast("double")), F.when(p["p3"] == "", 0.0).otherwise(n)
        err = F.coalesce(p["err"], F.when(~p["good"], NUM))
        return F.struct(re.alias("re"), im.alias("im"), F.when(p["p3"] == "", "i").otherwise(p["p3"]).alias("suffix"), err.alias("err"))

    return bind(as_text(x).both(), split)


def written(re: Column, im: Column, suffix: Column, err: Column) -> Column:
    """The struct (value, err) of a complex number's text."""

    def made(z: Column) -> Column:
        bad = F.isnan(z["re"]) | F.isnan(z["im"]) | (F.abs(z["re"]) == float("inf")) | (F.abs(z["im"]) == float("inf"))
        return bind(F.struct(z["re"].alias("re"), z["im"].alias("im"), F.coalesce(err, F.when(bad, NUM)).alias("err")), shown)

    def shown(z: Column) -> Column:
        imaginary = bind(number_text(F.abs(z["im"])), lambda b: F.concat(F.when(b == "1", "").otherwise(b), suffix))
        minus, a = F.when(z["im"] < 0, "-"), number_text(z["re"])
        text = F.when(z["im"] == 0, a).when(z["re"] == 0, F.concat(minus.otherwise(""), imaginary)).otherwise(F.concat(a, minus.otherwise("+"), imaginary))
        return F.struct(F.when(z["err"].isNull(), text).alias("value"), z["err"].alias("err"))

    return bind(F.struct(re.alias("re"), im.alias("im")), made)


def computed(f, *texts: Val, numbers: tuple = (), own=None) -> Val:
    """f of complex numbers (structs) and numbers (Columns) gives (re, im); each text is parsed once, and the value and its
    error are one struct. ``own`` gives the function's own error, the suffix is the first number's."""
    row = F.struct(*(parsed(x).alias(f"z{i}") for i, x in enumerate(texts)), *(x.both().alias(f"n{i}") for i, x in enumerate(numbers)))

    def made(r: Column) -> Column:
        zs, ns = [r[f"z{i}"] for i in range(len(texts))], [r[f"n{i}"] for i in range(len(numbers))]
        err = F.coalesce(*(x["err"] for x in zs + ns), F.lit(None).cast("string") if own is None else own(*zs, *(n["value"] for n in ns)))
        return written(*f(*zs, *(n["value"] for n in ns)), zs[0]["suffix"], err)

    return at_once(bind(row, made), "text")


@function("COMPLEX", least=2, most=3)
def _complex(a, b, suffix=None):
    x, y, s = as_number(a), as_number(b), as_text(lift("i" if suffix is None else suffix))
    row = F.struct(x.both().alias("x"), y.both().alias("y"), s.both().alias("s"))

    def made(r: Column) -> Column:
        err = F.coalesce(r["x"]["err"], r["y"]["err"], r["s"]["err"], F.when(~r["s"]["value"].isin("i", "j"), VALUE))
        return written(r["x"]["value"], r["y"]["value"], r["s"]["value"], err)

    return at_once(bind(row, made), "text")


def part_of(name: str, f) -> None:
    @function(name, least=1, most=1)
    def apply(x):
        def made(z: Column) -> Column:
            return bind(F.struct(f(z).alias("v"), z["err"].alias("err")), checked)

        def checked(r: Column) -> Column:
            v = r["v"]
            err = F.coalesce(r["err"], F.when(F.isnan(v) | (F.abs(v) == float("inf")), NUM))
            return F.struct(F.when(err.isNull(), v).alias("value"), err.alias("err"))

        return at_once(bind(parsed(x), made), "number")


part_of("IMREAL", lambda z: z["re"])
part_of("IMAGINARY", lambda z: z["im"])
part_of("IMABS", lambda z: F.hypot(z["re"], z["im"]))
part_of("IMARGUMENT", lambda z: F.atan2(z["im"], z["re"]))


def divided(a, b):
    """(re, im) of a / b and whether b is zero."""
    size = b[0] * b[0] + b[1] * b[1]
    size = F.when(size != 0, size)
    return (a[0] * b[0] + a[1] * b[1]) / size, (a[1] * b[0] - a[0] * b[1]) / size


def powered(re, im, n):
    r, angle = F.pow(F.hypot(re, im), n), F.atan2(im, re) * n
    return r * F.cos(angle), r * F.sin(angle)


sin_ = lambda a, b: (F.sin(a) * F.cosh(b), F.cos(a) * F.sinh(b))
cos_ = lambda a, b: (F.cos(a) * F.cosh(b), -F.sin(a) * F.sinh(b))
sinh_ = lambda a, b: (F.sinh(a) * F.cos(b), F.cosh(a) * F.sin(b))
cosh_ = lambda a, b: (F.cosh(a) * F.cos(b), F.sinh(a) * F.sin(b))


def log_(a, b, base=1.0):
    size = F.hypot(a, b)
    return F.ln(F.when(size > 0, size)) / base, F.atan2(b, a) / base


is_zero = lambda z: (z["re"] == 0) & (z["im"] == 0)


def unary(name: str, f, zero: bool = False) -> None:
    @function(name, least=1, most=1)
    def apply(x):
        return computed(lambda z: f(z["re"], z["im"]), x, own=(lambda z: F.when(is_zero(z), NUM)) if zero else None)


one = lambda: (F.lit(1.0), F.lit(0.0))
unary("IMCONJUGATE", lambda a, b: (a, -b))
unary("IMSQRT", lambda a, b: powered(a, b, F.lit(0.5)))
unary("IMEXP", lambda a, b: (F.exp(a) * F.cos(b), F.exp(a) * F.sin(b)))
unary("IMLN", log_, True)
unary("IMLOG10", lambda a, b: log_(a, b, math.log(10)), True)
unary("IMLOG2", lambda a, b: log_(a, b, math.log(2)), True)
unary("IMSIN", sin_)
unary("IMCOS", cos_)
unary("IMTAN", lambda a, b: divided(sin_(a, b), cos_(a, b)))
unary("IMSINH", sinh_)
unary("IMCOSH", cosh_)
unary("IMSEC", lambda a, b: divided(one(), cos_(a, b)))
unary("IMCSC", lambda a, b: divided(one(), sin_(a, b)), True)
unary("IMCOT", lambda a, b: divided(cos_(a, b), sin_(a, b)), True)
unary("IMSECH", lambda a, b: divided(one(), cosh_(a, b)))
unary("IMCSCH", lambda a, b: divided(one(), sinh_(a, b)), True)


@function("IMSUB", least=2, most=2)
def _imsub(x, y):
    return computed(lambda a, b: (a["re"] - b["re"], a["im"] - b["im"]), x, y)


@function("IMDIV", least=2, most=2)
def _imdiv(x, y):
    return computed(lambda a, b: divided((a["re"], a["im"]), (b["re"], b["im"])), x, y, own=lambda a, b: F.when(is_zero(b), NUM))


@function("IMPOWER", least=2, most=2)
def _impower(x, n):
    return computed(lambda a, k: powered(a["re"], a["im"], k), x, numbers=(as_number(n),))


@function("IMSUM", least=1)
def _imsum(*args):
    return computed(lambda *zs: tuple(reduce(lambda x, y: x + y, (z[part] for z in zs)) for part in ("re", "im")), *args)


@function("IMPRODUCT", least=1)
def _improduct(*args):
    def product(*zs: Column) -> tuple[Column, Column]:
        times = lambda p, z: F.struct((p["re"] * z["re"] - p["im"] * z["im"]).alias("re"), (p["re"] * z["im"] + p["im"] * z["re"]).alias("im"))
        pairs = F.array(*(F.struct(z["re"].alias("re"), z["im"].alias("im")) for z in zs[1:]))
        first = F.struct(zs[0]["re"].alias("re"), zs[0]["im"].alias("im"))
        whole = F.aggregate(pairs, first, times) if zs[1:] else first
        return whole["re"], whole["im"]

    return computed(product, *args)
