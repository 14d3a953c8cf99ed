"""Scalar functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import call, dates, number, string
from tabulon.plans.registry import query, r4


def ints(v, name):
    return v.named(name).cast("long").alias(name)


def round_columns(rows):
    x, q = number("l_extendedprice"), number("l_quantity")
    return rows.select("l_orderkey", "l_linenumber", call("ROUND", x, 1).named("round1"), r4(call("ROUNDUP", call("ROUND", x, 4), 1).named("u"), "roundup1", 1), r4(call("ROUNDDOWN", x, 1).named("d"), "rounddown1", 1), call("TRUNC", x).named("trunc0"), call("CEILING", q, 5).named("ceiling5"), call("FLOOR", q, 5).named("floor5"), call("MROUND", q, 4).named("mround4"), call("EVEN", q).named("even"), call("ODD", q).named("odd"))


ROUND_FAMILY_ALL_SQL = """select l_orderkey, l_linenumber, round(l_extendedprice, 1) as round1, ceil(round(l_extendedprice * 10, 4)) / 10 as roundup1, floor(round(l_extendedprice * 10, 4)) / 10 as rounddown1, trunc(l_extendedprice) as trunc0,
       ceil(l_quantity / 5) * 5 as ceiling5, floor(l_quantity / 5) * 5 as floor5, floor(l_quantity / 4 + 0.5) * 4 as mround4, ceil(l_quantity / 2) * 2 as even, ceil((l_quantity + 1) / 2) * 2 - 1 as odd from lineitem"""


@query(ROUND_FAMILY_ALL_SQL, "round_family")
@query(ROUND_FAMILY_ALL_SQL)
def round_family_all(t):
    return round_columns(t.lineitem)


@query("select p_partkey, p_size - (-7) * floor(p_size / -7.0) as mod7, trunc(p_size / 7.0)::bigint as quotient, gcd(p_size, 36)::bigint as gcd, lcm(p_size, 36)::bigint as lcm, sign(25 - p_size)::bigint as sign, abs(25 - p_size)::bigint as abs from part")
def mod_sign(t):
    s = number("p_size")
    return t.part.select("p_partkey", call("MOD", s, -7).named("mod7"), ints(call("QUOTIENT", s, 7), "quotient"), ints(call("GCD", s, 36), "gcd"), ints(call("LCM", s, 36), "lcm"), ints(call("SIGN", 25 - s), "sign"), ints(call("ABS", 25 - s), "abs"))


@query("select p_partkey, round(sqrt(p_size), 6) as sqrt, round(ln(p_size), 6) as ln, round(log10(p_size), 6) as log10, round(pow(p_size, 1.5), 4) as power, round(exp(p_size / 10.0), 4) as exp, round(sin(p_size), 6) as sin, round(cos(p_size), 6) as cos, round(atan(p_size), 6) as atan, round(degrees(p_size), 4) as degrees, round(atan2(2, p_size), 6) as atan2, factorial(p_size % 15)::double as fact from part")
def power_trigonometry(t):
    s = number("p_size")
    made = {"SQRT": 6, "LN": 6, "LOG10": 6, "SIN": 6, "COS": 6, "ATAN": 6, "DEGREES": 4}
    return t.part.select("p_partkey", *(r4(call(n, s).named("v"), n.lower(), d) for n, d in made.items()), r4(call("POWER", s, 1.5).named("v"), "power"), r4(call("EXP", s / 10).named("v"), "exp"), r4(call("ATAN2", s, 2).named("v"), "atan2", 6), call("FACT", call("MOD", s, 15)).named("fact"))


@query("select p_partkey, bin(p_size) as bin, hex(p_size) as hex, to_base(p_size, 7) as base7, p_size::double as back, (p_size & 25)::bigint as bitand, (p_size | 25)::bigint as bitor, xor(p_size, 25)::bigint as bitxor, (p_size << 3)::bigint as lshift, (p_size >> 1)::bigint as rshift from part")
def base_convert(t):
    s = number("p_size")
    return t.part.select("p_partkey", call("DEC2BIN", s).named("bin"), call("DEC2HEX", s).named("hex"), call("BASE", s, 7).named("base7"), call("HEX2DEC", call("DEC2HEX", s)).named("back"), *(ints(call(n, s, 25), n.lower()) for n in ("BITAND", "BITOR", "BITXOR")), ints(call("BITLSHIFT", s, 3), "lshift"), ints(call("BITRSHIFT", s, 1), "rshift"))


@query("select p_partkey, ['', 'X', 'XX', 'XXX', 'XL', 'L'][p_size // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_size % 10 + 1] as roman, p_size::double as arabic from part")
def roman_numerals(t):
    roman = call("ROMAN", number("p_size"))
    return t.part.select("p_partkey", roman.named("roman"), call("ARABIC", roman).named("arabic"))


@query(
    """select p_partkey, left(p_name, 3) as l3, right(p_name, 4) as r4, substring(p_name, 2, 5) as mid, length(p_name)::bigint as len, upper(p_name) as up, strpos(p_name, 'e')::bigint as find, strpos(lower(p_brand), 'b')::bigint as search,
       replace(p_name, 'e', 'E') as sub, p_name || '-' || p_size as joined, repeat('ab', p_size % 4) as rept, left(p_name, 1) || '#' || substring(p_name, 4) as repl, unicode(p_name)::bigint as code, p_name = lower(p_name) as exact from part"""
)
def text_functions(t):
    n, b, s = string("p_name"), string("p_brand"), number("p_size")
    return t.part.select(
        "p_partkey", call("LEFT", n, 3).named("l3"), call("RIGHT", n, 4).named("r4"), call("MID", n, 2, 5).named("mid"), ints(call("LEN", n), "len"), call("UPPER", n).named("up"), F.coalesce(ints(call("FIND", "e", n), "find"), F.lit(0)).alias("find"), F.coalesce(ints(call("SEARCH", "B", b), "search"), F.lit(0)).alias("search"),
        call("SUBSTITUTE", n, "e", "E").named("sub"), call("TEXTJOIN", "-", True, n, s).named("joined"), call("REPT", "ab", call("MOD", s, 4)).named("rept"), call("REPLACE", n, 2, 2, "#").named("repl"), ints(call("CODE", n), "code"), call("EXACT", n, call("LOWER", n)).named("exact"),
    )


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as proper, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) as trimmed, p_size / 100.0 as percent, p_size + 0.5 as numbervalue from part")
def text_values(t):
    n = string("p_name")
    return t.part.select("p_partkey", call("PROPER", n).named("proper"), call("TRIM", n & "  ").named("trimmed"), call("VALUE", call("CONCAT", number("p_size"), "%")).named("percent"), call("NUMBERVALUE", call("CONCAT", number("p_size"), ",5"), ",", ".").named("numbervalue"))


@query("select c_custkey, case when c_acctbal > 5000 then 'high' when c_acctbal > 0 then 'low' else 'debt' end as ifs, case when c_nationkey = 3 then 'three' else 'other' end as switch, coalesce(case when c_nationkey < 3 then ['a', 'b', 'c'][c_nationkey + 1] end, 'none') as choose, (c_acctbal > 0 and c_nationkey > 5) as \"and\", (c_acctbal > 0) <> (c_nationkey > 5) as \"xor\", case when c_acctbal >= 0 then round(sqrt(c_acctbal), 4) else -1 end as safe, c_nationkey % 2 = 0 as even from customer")
def logical_functions(t):
    a, n = number("c_acctbal"), number("c_nationkey")
    ifs = call("IFS", a > 5000, "high", a > 0, "low", True, "debt")
    return t.customer.select("c_custkey", ifs.named("ifs"), call("SWITCH", n, 3, "three", "other").named("switch"), call("IFERROR", call("CHOOSE", n + 1, "a", "b", "c"), "none").named("choose"), call("AND", a > 0, n > 5).named("and"), call("XOR", a > 0, n > 5).named("xor"), call("IFERROR", call("ROUND", call("SQRT", a), 4), -1).named("safe"), call("ISEVEN", n).named("even"))


@query("select c_custkey, case when c_nationkey = 3 then '#DIV/0!' end as code, c_nationkey = 3 as is_error, case when c_nationkey = 3 then 2.0 end as error_type, case when c_nationkey = 3 then '#DIV/0!' else cast(floor(100.0 / (c_nationkey - 3))::bigint as varchar) end as shown from customer")
def errors_as_values(t):
    x = 100.0 / (number("c_nationkey") - 3)
    return t.customer.select("c_custkey", x.error("code"), call("ISERROR", x).named("is_error"), call("ERROR.TYPE", x).named("error_type"), F.when(F.col("c_nationkey") == 3, x.shown("s")).otherwise(call("FLOOR.MATH", x).shown("s")).alias("shown"))


@query("select p_partkey, p_size & 1 = 1 as odd, (p_size > 25) as gt, (p_name < 'm') as lt, true as text_above_number, '' || p_size || 'x' as joined, -p_size * 2.0 / 100 as percent from part")
def formula_operators(t):
    s, n = number("p_size"), string("p_name")
    return t.part.select("p_partkey", call("ISODD", s).named("odd"), (s > 25).named("gt"), (n < "M").named("lt"), (n > s).named("text_above_number"), (s & "x").named("joined"), (-s * 2).percent().named("percent"))


def serials(t):
    """Orders with the serial number of their date; a step of its own, so that later expressions hold it once."""
    return t.orders.select("o_orderkey", dates.serial(F.col("o_orderdate")).named("s"), call("DATE", 2002, 1, 1).named("e"))


@query(
    """select o_orderkey, date_diff('day', date '1899-12-30', o_orderdate::date)::double as serial, year(o_orderdate)::double as year, month(o_orderdate)::double as month, day(o_orderdate)::double as day, (dayofweek(o_orderdate) + 1)::double as weekday1, isodow(o_orderdate)::double as weekday2,
       weekofyear(o_orderdate)::double as isoweek, floor((dayofyear(o_orderdate) - 1 + dayofweek(date_trunc('year', o_orderdate))) / 7) + 1 as weeknum from orders"""
)
def date_parts(t):
    s = number("s")
    return serials(t).select("o_orderkey", call("INT", s).named("serial"), call("YEAR", s).named("year"), call("MONTH", s).named("month"), call("DAY", s).named("day"), call("WEEKDAY", s).named("weekday1"), call("WEEKDAY", s, 2).named("weekday2"), call("ISOWEEKNUM", s).named("isoweek"), call("WEEKNUM", s).named("weeknum"))


@query(
    """select o_orderkey, date_diff('day', date '1899-12-30', (o_orderdate::date + interval 3 month)::date)::double as edate, date_diff('day', date '1899-12-30', last_day(o_orderdate::date - interval 1 month))::double as eomonth, date_diff('day', o_orderdate::date, date '2002-01-01')::double as days,
       date_diff('day', o_orderdate::date, date '2002-01-01') / 365.0 as yearfrac3, (date_part('year', age(date '2002-01-01', o_orderdate::date)) * 12 + date_part('month', age(date '2002-01-01', o_orderdate::date)))::double as datedif_m from orders"""
)
def date_shifts(t):
    s, end = number("s"), number("e")
    return serials(t).select("o_orderkey", call("EDATE", s, 3).named("edate"), call("EOMONTH", s, -1).named("eomonth"), call("DAYS", end, s).named("days"), call("YEARFRAC", s, end, 3).named("yearfrac3"), call("DATEDIF", s, end, "M").named("datedif_m"))


@query("select o_orderkey, (2002 - year(o_orderdate)) * 360 + (1 - month(o_orderdate)) * 30 + 1 - least(day(o_orderdate), 30)::double as days360, round(((2002 - year(o_orderdate)) * 360 + (1 - month(o_orderdate)) * 30 + 1 - least(day(o_orderdate), 30)) / 360.0, 6) as yearfrac from orders")
def days360(t):
    s, end = number("s"), number("e")
    return serials(t).select("o_orderkey", call("DAYS360", s, end).named("days360"), r4(call("YEARFRAC", s, end).named("v"), "yearfrac", 6))


NETWORKDAYS_ALL_SQL = "select o_orderkey, (select count(*) from range(o_orderdate::date, o_orderdate::date + interval 30 day, interval 1 day) as r(d) where isodow(d) < 6)::double as networkdays from orders"


@query(NETWORKDAYS_ALL_SQL, "networkdays")
@query(NETWORKDAYS_ALL_SQL)
def networkdays_all(t):
    s = number("s")
    return serials(t).select("o_orderkey", dates.networkdays(s, s + 29).named("networkdays"))


WORKDAY_ALL_SQL = "select o_orderkey, date_diff('day', date '1899-12-30', (select d from (select d::date as d, row_number() over (order by d) as k from range(o_orderdate::date + interval 1 day, o_orderdate::date + interval 40 day, interval 1 day) as r(d) where isodow(d) < 6) where k = 10))::double as workday from orders"


@query(WORKDAY_ALL_SQL, "workday")
@query(WORKDAY_ALL_SQL)
def workday_all(t):
    return serials(t).select("o_orderkey", dates.workday(number("s"), 10).named("workday"))


LOAN = "0.06 / 12 as r, 12.0 * (1 + o_orderkey % 30) as n, o_totalprice as pv"


@query(
    f"""with l as (select o_orderkey, {LOAN} from orders), p as (select *, -(pv * pow(1 + r, n)) * r / (pow(1 + r, n) - 1) as pmt from l)
       select o_orderkey, round(pmt, 4) as pmt, round(-(pv * pow(1 + r, 5) + 100 * (pow(1 + r, 5) - 1) / r), 4) as fv, round(-(1000 + 100 * (pow(1 + r, n) - 1) / r) / pow(1 + r, n), 4) as pv, round(-(pv * pow(1 + r, 2) + pmt * (pow(1 + r, 2) - 1) / r) * r, 4) as ipmt,
       round(ln(-pmt / r / (-pmt / r - pv)) / ln(1 + r), 4) as nper from p"""
)
def annuities(t):
    loan = t.orders.select("o_orderkey", F.lit(0.06 / 12).alias("r"), (12.0 * (1 + F.col("o_orderkey") % 30)).alias("n"), F.col("o_totalprice").alias("pv"))
    r, n, pv = number("r"), number("n"), number("pv")
    paid = call("PMT", r, n, pv)
    interest = call("IPMT", r, 3, n, pv)
    return loan.select("o_orderkey", r4(paid.named("v"), "pmt"), r4(call("FV", r, 5, 100, pv).named("v"), "fv"), r4(call("PV", r, n, 100, 1000).named("v"), "pv"), r4(interest.named("v"), "ipmt"), r4(call("NPER", r, paid, pv).named("v"), "nper"))


@query("select p_partkey, round((p_retailprice - 100) / 10, 4) as sln, round((p_retailprice - 100) * (10 - 3 + 1) * 2 / 110.0, 4) as syd, round(pow(1 + 0.05 / (1 + p_size), 1 + p_size) - 1, 6) as effect, round(pow(p_retailprice / 500, 1 / 7.0) - 1, 6) as rri from part")
def depreciation(t):
    c, s = number("p_retailprice"), number("p_size")
    return t.part.select("p_partkey", r4(call("SLN", c, 100, 10).named("v"), "sln"), r4(call("SYD", c, 100, 10, 3).named("v"), "syd"), r4(call("EFFECT", 0.05, s + 1).named("v"), "effect", 6), r4(call("RRI", 7, 500, c).named("v"), "rri", 6))


@query("select p_partkey, round(p_size * 1609.344 / 1000, 6) as km, round(p_size * 453.59237, 4) as grams, round(p_size * 3600.0, 4) as seconds, case when p_size > 0 then '#N/A' end as bad from part")
def unit_conversion(t):
    s = number("p_size")
    return t.part.select("p_partkey", r4(call("CONVERT", s, "mi", "km").named("v"), "km", 6), r4(call("CONVERT", s, "lbm", "g").named("v"), "grams"), r4(call("CONVERT", s, "hr", "sec").named("v"), "seconds"), call("CONVERT", s, "mi", "kg").error("bad"))


def complex_columns(rows):
    made = rows.select("p_partkey", call("COMPLEX", number("p_size"), number("p_size") + 1).named("z"))
    z = string("z")
    return made.select("p_partkey", "z", call("IMREAL", z).named("re"), call("IMAGINARY", z).named("im"), r4(call("IMABS", z).named("v"), "size", 6), call("IMSUB", z, "-2+i").named("difference"))


COMPLEX_NUMBERS_ALL_SQL = "select p_partkey, p_size || '+' || (p_size + 1) || 'i' as z, p_size::double as re, (p_size + 1)::double as im, round(sqrt(p_size * p_size + (p_size + 1) * (p_size + 1)), 6) as size, (p_size + 2) || '+' || case when p_size = 1 then '' else p_size::varchar end || 'i' as difference from part"


@query(COMPLEX_NUMBERS_ALL_SQL, "complex_numbers")
@query(COMPLEX_NUMBERS_ALL_SQL)
def complex_numbers_all(t):
    return complex_columns(t.part)


# Without SQL for the special functions: held against published values in the tests.


@query()
def distribution_functions(t):
    z = (number("c_acctbal") - 4500) / 3000
    p = call("NORM.S.DIST", z, True)
    return t.customer.select("c_custkey", p.named("norm"), call("NORM.S.INV", p).named("z"), call("T.DIST.2T", call("ABS", z), 12).named("t"), call("CHISQ.DIST.RT", call("ABS", z), 3).named("chisq"), call("F.DIST.RT", call("ABS", z), 4, 9).named("f"), call("GAMMA.DIST", call("ABS", z), 2, 1.5, True).named("gamma"), call("POISSON.DIST", number("c_nationkey"), 9, True).named("poisson"), call("BINOM.DIST", number("c_nationkey"), 30, 0.3, False).named("binom"))


@query("select p_partkey, round(1 - exp(-0.1 * p_size), 6) as expon, round(1 - exp(-pow(p_size / 20.0, 1.5)), 6) as weibull, round(exp(-p_size * p_size / 200.0) / sqrt(2 * pi()), 6) as phi, round((p_size - 25) / 12.5, 6) as standard, round(atanh(p_size / 60.0), 6) as fisher from part")
def closed_distributions(t):
    s = number("p_size")
    made = {"expon": call("EXPON.DIST", s, 0.1, True), "weibull": call("WEIBULL.DIST", s, 1.5, 20, True), "phi": call("PHI", s / 10), "standard": call("STANDARDIZE", s, 25, 12.5), "fisher": call("FISHER", s / 60)}
    return t.part.select("p_partkey", *(r4(v.named("v"), k, 6) for k, v in made.items()))


@query()
def rates_and_schedules(t):
    c, life = number("p_retailprice"), number("p_size") + 2
    return t.part.select("p_partkey", call("RATE", life * 12, -(c / 12), c * life * 0.8).named("rate"), call("DDB", c, 100, life, 2).named("ddb"), call("DB", c, 100, life, 2).named("db"), call("VDB", c, 100, life, 0.5, 2).named("vdb"), call("CUMIPMT", 0.01, life * 12, c, 1, 12, 0).named("cumipmt"))
