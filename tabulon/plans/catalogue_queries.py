"""The rest of the function catalogue over whole tables, held against closed forms and series in SQL."""

from __future__ import annotations

from tabulon.functions import call as made_call
from tabulon.functions import number, string
from tabulon.plans.registry import query, r4
from tabulon.session import spread, stage


class Later:
    """A value that is made with the plan; there is no session yet when queries are registered."""

    def __init__(self, make):
        self.make = make

    def __add__(self, other):
        return Later(lambda: self.make() + now(other))

    def __sub__(self, other):
        return Later(lambda: self.make() - now(other))

    def __mul__(self, other):
        return Later(lambda: self.make() * now(other))

    def __rtruediv__(self, other):
        return Later(lambda: other / self.make())

    def __truediv__(self, other):
        return Later(lambda: self.make() / now(other))

    def __neg__(self):
        return Later(lambda: -self.make())

    def __gt__(self, other):
        return Later(lambda: self.make() > now(other))

    def __lt__(self, other):
        return Later(lambda: self.make() < now(other))


def now(x):
    return x.make() if isinstance(x, Later) else x


class Call(Later):
    """A function of the catalogue."""

    def __init__(self, name: str, args: tuple):
        super().__init__(lambda: made_call(name, *map(now, args)))
        self.name, self.args = name, args


def call(name: str, *args) -> Call:
    return Call(name, args)


def same(x):
    """What equal calls have in common: names and arguments; other values are the same only as one object."""
    return (x.name, *map(same, x.args)) if isinstance(x, Call) else (type(x).__name__, id(x) if isinstance(x, Later) else x)


def stepwise(df, values: list):
    """The table with the functions inside other functions as columns of their own, and the values over those. Equal ones
    are one column."""
    steps, found, known = {}, [], {}
    for v in values:
        if isinstance(v, Call):
            args = []
            for a in v.args:
                if isinstance(a, Call):
                    if same(a) not in known:
                        made, name = now(a), f"step{len(steps)}"
                        steps[name] = made.named(name)
                        known[same(a)] = (number if made.kind == "number" else string)(name)
                    a = known[same(a)]
                args.append(a)
            v = call(v.name, *args)
        found.append(v)
    return (stage(df.select("*", *steps.values()), "steps") if steps else df), found  # written: a plan that holds both grows too long


def field(kind, name: str) -> Later:
    return Later(lambda: kind(name))


S, Z = field(number, "p_size"), field(string, "z")
#: Functions whose outcome is no number.
OTHERS = {"IF", "OR", "NOT", "TRUE", "FALSE", "NA", "T", "CLEAN", "CONCATENATE", "CHAR", "UNICHAR", "DEC2OCT", "BIN2OCT", "BIN2HEX", "OCT2BIN", "OCT2HEX", "HEX2BIN", "HEX2OCT"}


def columns(name: str, rows: list[tuple], table: str = "part", key: str = "p_partkey", digits: int = 6, made=None) -> None:
    """A query with a column for each (function, value, SQL); numbers are rounded, other kinds compared as they are."""
    plain = lambda n: n.lower().replace(".", "_")
    exact = lambda n: n in OTHERS or n.startswith("IS") and n != "ISPMT"
    shown = ", ".join(f"{sql} as {plain(n)}" if exact(n) else f"round(({sql})::double, {digits}) as {plain(n)}" for n, _, sql in rows)

    @query(f"select {key}, {shown} from {table}", name)
    def f(t):
        df = spread(getattr(t, table))
        df, values = stepwise(made(df) if made else df, [v for _, v, _ in rows])
        return df.select(key, *(now(v).named(plain(n)) if exact(n) else r4(now(v).named("v"), plain(n), digits) for (n, _, _), v in zip(rows, values)))


def one(name: str, sql: str, *args) -> tuple:
    return name, call(name, *args), sql


choose = lambda n, k: f"(gamma({n} + 1.0) / gamma({k} + 1.0) / gamma({n} - {k} + 1.0))"
columns("combinatorics", [
    one("FACTDOUBLE", "list_product(list_transform(range(0, 1 + (p_size % 15) // 2), lambda i: greatest(p_size % 15 - 2 * i, 1)::double))", call("MOD", S, 15)), one("COMBIN", choose("(p_size + 2)", "3"), S + 2, 3),
    one("COMBINA", choose("(p_size + 2)", "3"), S, 3), one("PERMUT", "(p_size + 1) * p_size", S + 1, 2), one("PERMUTATIONA", "p_size ** 3", S, 3), one("MULTINOMIAL", "gamma(p_size % 5 + 6.0) / (12 * gamma(p_size % 5 + 1.0))", 2, 3, call("MOD", S, 5)),
], digits=2)
columns("more_mathematics", [
    one("SQRTPI", "sqrt(pi() * p_size)", S), one("LOG", "ln(p_size) / ln(3)", S, 3), one("CEILING.PRECISE", "ceil(p_size / 5.0) * 5", S, 5), one("CEILING.MATH", "ceil(-p_size / 5.0) * 5", -S, 5), one("FLOOR.PRECISE", "floor(-p_size / 5.0) * 5", -S, 5),
    one("DECIMAL", "p_size", call("BASE", S, 7), 7), one("PI", "pi()"), one("RADIANS", "radians(p_size)", S), one("TAN", "tan(p_size)", S), one("COT", "cot(p_size)", S), one("SEC", "1 / cos(p_size)", S), one("CSC", "1 / sin(p_size)", S),
    one("ASIN", "asin(p_size / 60.0)", S / 60), one("ACOS", "acos(p_size / 60.0)", S / 60), one("ACOT", "pi() / 2 - atan(p_size)", S), one("SINH", "sinh(p_size / 10.0)", S / 10), one("COSH", "cosh(p_size / 10.0)", S / 10), one("TANH", "tanh(p_size / 10.0)", S / 10),
    one("COTH", "1 / tanh(p_size / 10.0)", S / 10), one("SECH", "1 / cosh(p_size / 10.0)", S / 10), one("CSCH", "1 / sinh(p_size / 10.0)", S / 10), one("ASINH", "asinh(p_size)", S), one("ACOSH", "acosh(p_size)", S), one("ATANH", "atanh(p_size / 60.0)", S / 60), one("ACOTH", "atanh(1.0 / (p_size + 1))", S + 1),
])

N = field(number, "c_nationkey")
E = 100.0 / (N - 3)
columns("logic_and_information", [
    one("IF", "case when c_nationkey > 5 then 'more' else 'less' end", N > 5, "more", "less"), one("IFNA", "c_nationkey", call("IFNA", N, -1), -2), one("OR", "c_nationkey > 20 or c_nationkey < 2", N > 20, N < 2), one("NOT", "c_nationkey <= 5", N > 5), one("TRUE", "true"), one("FALSE", "false"),
    one("ISBLANK", "c_nationkey is null", N), one("ISERR", "c_nationkey = 3", E), one("ISNA", "false", E), one("ISNUMBER", "c_nationkey <> 3", E), one("ISTEXT", "true", field(string, "c_name")), one("ISNONTEXT", "false", field(string, "c_name")), one("ISLOGICAL", "true", N > 5), one("ISREF", "false", N),
    ("NA", Later(lambda: made_call("ISNA", made_call("NA"))), "true"), one("N", "c_nationkey", N), one("TYPE", "2", field(string, "c_name")), one("T", "c_name", field(string, "c_name")), one("CLEAN", "c_name", call("CONCATENATE", field(string, "c_name"), call("CHAR", 7))),
    one("CONCATENATE", "c_name || '-' || c_mktsegment", field(string, "c_name"), "-", field(string, "c_mktsegment")), one("CHAR", "chr(65 + c_nationkey)", N + 65), one("UNICHAR", "chr(945 + c_nationkey)", N + 945), one("UNICODE", "ascii(c_name)", field(string, "c_name")),
], "customer", "c_custkey")


T_ = call("TIME", N, 7, 30)
D_ = call("DATE", 2020, 1, N + 1)
columns("times", [
    one("TIME", "(c_nationkey % 24 * 3600 + 450) / 86400.0", N, 7, 30), one("HOUR", "c_nationkey % 24", T_), one("MINUTE", "7", T_), one("SECOND", "30", T_), one("DATEVALUE", "43831 + c_nationkey", call("CONCATENATE", "2020-01-", call("RIGHT", call("CONCATENATE", "0", N + 1), 2))), one("TIMEVALUE", "(c_nationkey % 24) / 24.0", call("CONCATENATE", call("MOD", N, 24), ":00")),
    one("NETWORKDAYS.INTL", "(select count(*) from range(date '2020-01-01' + c_nationkey, date '2020-02-01' + c_nationkey, interval 1 day) as r(d) where isodow(d) <> 7)", D_, D_ + 30, 11),
    one("WORKDAY.INTL", "date_diff('day', date '1899-12-30', (select d from (select d::date as d, row_number() over (order by d) as k from range(date '2020-01-02' + c_nationkey, date '2020-03-01' + c_nationkey, interval 1 day) as r(d) where isodow(d) <> 7) where k = 9))", D_, 9, 11),
], "customer", "c_custkey", digits=8)

base = lambda b: f"to_base(p_size, {b})"
BIN, OCT, HEX = (call(f"DEC2{x}", S) for x in ("BIN", "OCT", "HEX"))
columns("bases", [
    one("BIN2DEC", "p_size", BIN), one("OCT2DEC", "p_size", OCT), one("DEC2OCT", base(8), S), one("BIN2OCT", base(8), BIN), one("BIN2HEX", base(16), BIN), one("OCT2BIN", base(2), OCT), one("OCT2HEX", base(16), OCT), one("HEX2BIN", base(2), HEX), one("HEX2OCT", base(8), HEX),
    one("DELTA", "(p_size % 2 = 1)::int", call("MOD", S, 2), 1), one("GESTEP", "(p_size >= 25)::int", S, 25),
])

# Distributions: finite sums where parameters are whole, the error function by its series.
erf = lambda x: f"(2 / sqrt(pi()) * list_sum(list_transform(range(0, 70), lambda n: pow(-1.0, n) * pow({x}, 2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1)))))"
norm = lambda z: f"(0.5 + 0.5 * {erf(f'(({z}) / sqrt(2))')})"
total = lambda n, term: f"list_sum(list_transform(range(0, ({n})::int), lambda i: {term}))"
poisson = lambda k, m: total(f"{k} + 1", f"exp(-{m}) * pow({m}, i) / gamma(i + 1.0)")
binomial = lambda k, n, p: total(f"{k} + 1", f"{choose(n, 'i')} * pow({p}, i) * pow(1 - {p}, {n} - i)")
beta = lambda x, a, b: f"(1 - {binomial(a - 1, f'{a + b - 1}.0', x)})"
x = "(p_size / 20.0)"
X = S / 20
columns("normal_distributions", [
    one("NORM.DIST", norm(f"({x} - 1) / 1.5"), X, 1, 1.5, True), one("NORMDIST", f"exp(-pow(({x} - 1) / 1.5, 2) / 2) / (1.5 * sqrt(2 * pi()))", X, 1, 1.5, False), one("NORM.S.DIST", norm(x), X, True), one("NORMSDIST", norm(f"-{x}"), -X), one("GAUSS", f"{norm(x)} - 0.5", X),
    one("LOGNORM.DIST", norm(f"(ln({x}) - 0.2) / 1.1"), X, 0.2, 1.1, True), one("LOGNORMDIST", norm(f"(ln({x}) - 0.2) / 1.1"), X, 0.2, 1.1), one("ERF", erf(x), X), one("ERF.PRECISE", erf(x), X), one("ERFC", f"1 - {erf(x)}", X), one("ERFC.PRECISE", f"1 - {erf(x)}", X),
    one("GAMMALN", f"lgamma({x})", X), one("GAMMALN.PRECISE", f"lgamma({x})", X), one("GAMMA", f"gamma({x})", X), one("FISHERINV", f"tanh({x})", X), one("CONFIDENCE.NORM", "1.959963984540054 * p_size / 3", 0.05, S, 9), one("CONFIDENCE", "1.959963984540054 * p_size / 3", 0.05, S, 9), one("CONFIDENCE.T", "2.262157162798205 * p_size / sqrt(10)", 0.05, S, 10),
])
columns("discrete_distributions", [
    one("BINOM.DIST", binomial("p_size", "60.0", "0.3"), S, 60, 0.3, True), one("BINOMDIST", f"{choose('60.0', 'p_size')} * pow(0.3, p_size) * pow(0.7, 60 - p_size)", S, 60, 0.3, False), one("BINOM.DIST.RANGE", f"{binomial('p_size + 5', '60.0', '0.3')} - {binomial('p_size - 1', '60.0', '0.3')}", 60, 0.3, S, S + 5),
    one("BINOM.INV", f"len(list_filter(range(0, 61), lambda k: {binomial('k', '60.0', '0.3')} < p_size / 51.0))", 60, 0.3, S / 51), one("CRITBINOM", f"len(list_filter(range(0, 61), lambda k: {binomial('k', '60.0', '0.3')} < p_size / 51.0))", 60, 0.3, S / 51),
    one("NEGBINOM.DIST", total("p_size + 1", f"{choose('(i + 3.0)', 'i')} * pow(0.2, 4) * pow(0.8, i)"), S, 4, 0.2, True), one("NEGBINOMDIST", f"{choose('(p_size + 3.0)', 'p_size')} * pow(0.2, 4) * pow(0.8, p_size)", S, 4, 0.2),
    one("HYPGEOM.DIST", total("p_size // 5 + 1", f"{choose('20.0', 'i')} * {choose('40.0', '(12 - i)')} / {choose('60.0', '12')}"), call("QUOTIENT", S, 5), 12, 20, 60, True), one("HYPGEOMDIST", f"{choose('20.0', '(p_size // 5)')} * {choose('40.0', '(12 - p_size // 5)')} / {choose('60.0', '12')}", call("QUOTIENT", S, 5), 12, 20, 60),
    one("POISSON.DIST", poisson("p_size", "9.5"), S, 9.5, True), one("POISSON", "exp(-9.5) * pow(9.5, p_size) / gamma(p_size + 1.0)", S, 9.5, False),
], digits=8)
f = "(4 * p_size / 20.0 / (4 * p_size / 20.0 + 6))"
t2 = f"(0.5 + {x} / (2 * sqrt(2 + {x} * {x})))"
columns("continuous_distributions", [
    one("EXPONDIST", f"0.7 * exp(-0.7 * {x})", X, 0.7, False), one("WEIBULL", f"1 - exp(-pow({x} / 2, 1.5))", X, 1.5, 2, True), one("GAMMA.DIST", f"1 - exp(-{x} / 1.5) * (1 + {x} / 1.5)", X, 2, 1.5, True), one("GAMMADIST", f"{x} * exp(-{x} / 1.5) / 2.25", X, 2, 1.5, False),
    one("BETA.DIST", beta("(p_size / 51.0)", 3, 4), S / 51, 3, 4, True), one("BETADIST", beta("(p_size / 51.0)", 3, 4), S / 51, 3, 4), one("CHISQ.DIST", f"1 - exp(-{x} / 2) * (1 + {x} / 2)", X, 4, True), one("CHISQ.DIST.RT", f"exp(-{x} / 2) * (1 + {x} / 2)", X, 4), one("CHIDIST", f"exp(-{x} / 2) * (1 + {x} / 2)", X, 4),
    one("F.DIST", beta(f, 2, 3), X, 4, 6, True), one("F.DIST.RT", f"1 - {beta(f, 2, 3)}", X, 4, 6), one("FDIST", f"1 - {beta(f, 2, 3)}", X, 4, 6), one("T.DIST", t2, X, 2, True), one("T.DIST.RT", f"1 - {t2}", X, 2), one("T.DIST.2T", f"2 * (1 - {t2})", X, 2), one("TDIST", f"1 - {t2}", X, 2, 1),
])
# Inverses: of what the distributions above gave.
columns("inverse_distributions", [
    one("NORM.INV", x, call("NORM.DIST", X, 1, 1.5, True), 1, 1.5), one("NORMINV", x, call("NORM.DIST", X, 1, 1.5, True), 1, 1.5), one("NORM.S.INV", x, call("NORM.S.DIST", X, True)), one("NORMSINV", x, call("NORM.S.DIST", X, True)), one("LOGNORM.INV", x, call("LOGNORM.DIST", X, 0.2, 1.1, True), 0.2, 1.1), one("LOGINV", x, call("LOGNORM.DIST", X, 0.2, 1.1, True), 0.2, 1.1),
], digits=5)
columns("inverse_gamma_and_beta", [
    one("GAMMA.INV", x, call("GAMMA.DIST", X, 2, 1.5, True), 2, 1.5), one("GAMMAINV", x, call("GAMMA.DIST", X, 2, 1.5, True), 2, 1.5), one("BETA.INV", "p_size / 51.0", call("BETA.DIST", S / 51, 3, 4, True), 3, 4), one("BETAINV", "p_size / 51.0", call("BETA.DIST", S / 51, 3, 4, True), 3, 4),
], digits=5)
# Complex numbers a + bi.
A, B = "(p_size / 50.0)", "((p_size + 1) / 50.0)"
SIN, COS = (f"sin({A}) * cosh({B})", f"cos({A}) * sinh({B})"), (f"cos({A}) * cosh({B})", f"-sin({A}) * sinh({B})")
SINH, COSH = (f"sinh({A}) * cos({B})", f"cosh({A}) * sin({B})"), (f"cosh({A}) * cos({B})", f"sinh({A}) * sin({B})")
TAN = (f"sin(2 * {A}) / (cos(2 * {A}) + cosh(2 * {B}))", f"sinh(2 * {B}) / (cos(2 * {A}) + cosh(2 * {B}))")
SIZE, ARG = f"sqrt({A} * {A} + {B} * {B})", f"atan2({B}, {A})"
COMPLEX = {
    "IMCONJUGATE": ((A, f"-{B}"),), "IMSUM": ((f"{A} + 1", f"{B} + 2"), "1+2i"), "IMPRODUCT": ((f"{A} - 2 * {B}", f"2 * {A} + {B}"), "1+2i"), "IMDIV": ((f"({A} + 2 * {B}) / 5", f"({B} - 2 * {A}) / 5"), "1+2i"), "IMPOWER": ((f"{A} * {A} - {B} * {B}", f"2 * {A} * {B}"), 2),
    "IMSQRT": ((f"sqrt(({SIZE} + {A}) / 2)", f"sqrt(({SIZE} - {A}) / 2)"),), "IMEXP": ((f"exp({A}) * cos({B})", f"exp({A}) * sin({B})"),), "IMLN": ((f"ln({SIZE})", ARG),), "IMLOG10": ((f"ln({SIZE}) / ln(10)", f"{ARG} / ln(10)"),), "IMLOG2": ((f"ln({SIZE}) / ln(2)", f"{ARG} / ln(2)"),),
    "IMSIN": (SIN,), "IMCOS": (COS,), "IMTAN": (TAN,), "IMSINH": (SINH,), "IMCOSH": (COSH,),
}
made_complex = lambda df: df.select("p_partkey", now(call("COMPLEX", S / 50, (S + 1) / 50)).named("z"))
both_parts = lambda names: [(f"{n}_{part}", call(f, call(n, Z, *COMPLEX[n][1:])), sql) for n in names for part, f, sql in zip(("re", "im"), ("IMREAL", "IMAGINARY"), COMPLEX[n][0])]
FAMILIES = ("complex_arithmetic", "complex_logarithms", "complex_trigonometry")  # five functions each
for _at, _name in enumerate(FAMILIES):
    columns(_name, ([("IMARGUMENT", call("IMARGUMENT", Z), ARG)] if not _at else []) + both_parts([*COMPLEX][5 * _at : 5 * _at + 5]), made=made_complex)

# Finance.
R, P = "(p_size / 1007.0)", "p_retailprice"
RATE, PRICE = S / 1007, field(number, "p_retailprice")
paid = f"({P} * {R} / (1 - pow(1 + {R}, -24)))"  # each period
owed = lambda k: f"({P} * pow(1 + {R}, {k}) - {paid} * (pow(1 + {R}, {k}) - 1) / {R})"
columns("loans", [
    one("PPMT", f"-({owed(4)} - {owed(5)})", RATE, 5, 24, PRICE), one("ISPMT", f"{P} * {R} * (5 / 24.0 - 1)", RATE, 5, 24, PRICE), one("CUMPRINC", f"-({owed(2)} - {owed(9)})", RATE, 24, PRICE, 3, 9, 0), one("CUMIPMT", f"{owed(2)} - {owed(9)} - 7 * {paid}", RATE, 24, PRICE, 3, 9, 0),
    one("RATE", R, 24, call("PMT", RATE, 24, PRICE), PRICE), one("NOMINAL", f"12 * (pow(1 + {R}, 1 / 12.0) - 1)", RATE, 12), one("PDURATION", f"ln(2000 / 1000.0) / ln(1 + {R})", RATE, 1000, 2000), one("DOLLARDE", "1 + p_size / 16.0", S / 100 + 1, 16), one("DOLLARFR", "1 + p_size / 64.0 * 0.16", S / 64 + 1, 16),
    one("DDB", f"{P} * 0.8 * 0.8 * 0.2", PRICE, 1, 10, 3), one("DB", f"{P} * pow(1 - round(1 - pow(100 / {P}, 0.1), 3), 2) * round(1 - pow(100 / {P}, 0.1), 3)", PRICE, 100, 10, 3), one("VDB", f"{P} * (1 - 0.64)", PRICE, 1, 10, 0, 2),
], digits=4)
Y = "(5 * p_size / 365.0)"
TERM = (45000, S * 5 + 45000)
columns("bills_and_discounts", [
    one("DISC", f"(100 - 97) / 100.0 / {Y}", *TERM, 97, 100, 3), one("INTRATE", f"(105 - 97) / 97.0 / {Y}", *TERM, 97, 105, 3), one("RECEIVED", f"97 / (1 - 0.05 * {Y})", *TERM, 97, 0.05, 3), one("PRICEDISC", f"100 * (1 - 0.05 * {Y})", *TERM, 0.05, 100, 3), one("YIELDDISC", f"(100 - 97) / 97.0 / {Y}", *TERM, 97, 100, 3),
    one("ACCRINTM", f"0.05 * 1000 * {Y}", *TERM, 0.05, 1000, 3), one("TBILLPRICE", "100 * (1 - 0.05 * 5 * p_size / 360)", *TERM, 0.05), one("TBILLYIELD", "(100 - 97) / 97.0 * 360 / (5 * p_size)", *TERM, 97), one("TBILLEQ", "365 * 0.05 / (360 - 0.05 * 5 * p_size)", *TERM, 0.05),
], digits=5)
