"""Dates and times as serial numbers: day 1 is 1900-01-01, serial 60 the day that never was (1900-02-29)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.value import FUNCTIONS, NA, NUM, VALUE, Val, as_number, as_text, bind, errors, failed, finite, function, lift

LAST = 2958466.0  # the first serial after year 9999
EPOCH = "1899-12-30"
#: Weekend masks by code, Monday first.
WEEKENDS = {1: "0000011", 2: "1000001", 3: "1100000", 4: "0110000", 5: "0011000", 6: "0001100", 7: "0000110", 11: "0000001", 12: "1000000", 13: "0100000", 14: "0010000", 15: "0001000", 16: "0000100", 17: "0000010"}


def valid(s: Column) -> Column:
    return (s >= 0) & (s < LAST)


def date_of(serial: Column) -> Column:
    """The date of a serial; below 60 the calendar is a day ahead of the epoch's."""
    day = F.when(valid(serial), F.floor(serial)).cast("int")
    return F.date_add(F.lit(EPOCH).cast("date"), day + F.when(day < 60, 1).otherwise(0))


def serial_of(date: Column) -> Column:
    days = F.datediff(date, F.lit(EPOCH).cast("date"))
    return (days - F.when(days <= 60, 1).otherwise(0)).cast("double")


def serial(timestamp: Column) -> Val:
    """The serial number of a date or timestamp column, with the time of day."""
    seconds = F.hour(timestamp) * 3600 + F.minute(timestamp) * 60 + F.second(timestamp)
    return Val(serial_of(F.to_date(timestamp)) + seconds / 86400.0)


def dated(names, f, least=1, most=1) -> None:
    """A function whose first argument is a serial; f gets its Column and the others as numbers."""

    @function(names, least=least, most=most)
    def apply(*args):
        vals = [as_number(a) for a in args]
        return finite(f(*(v.col for v in vals)).cast("double"), errors(*vals, own=F.when(~valid(vals[0].col), NUM)))


def seconds_of(s: Column) -> Column:
    return F.round((s - F.floor(s)) * 86400) % 86400


dated("YEAR", lambda s: F.year(date_of(s)))
dated("MONTH", lambda s: F.when(F.floor(s) == 60, 2).otherwise(F.month(date_of(s))))
dated("DAY", lambda s: F.when(F.floor(s) == 60, 29).when(F.floor(s) == 0, 0).otherwise(F.dayofmonth(date_of(s))))
dated("HOUR", lambda s: F.floor(seconds_of(s) / 3600))
dated("MINUTE", lambda s: F.floor(seconds_of(s) / 60) % 60)
dated("SECOND", lambda s: seconds_of(s) % 60)
dated("ISOWEEKNUM", lambda s: F.weekofyear(date_of(s)))


def weekday0(s: Column) -> Column:
    """Monday is 0."""
    return F.pmod(F.floor(s) + 5, F.lit(7)).cast("int")


@function("WEEKDAY", least=1, most=2)
def _weekday(s, kind=None):
    v, k = as_number(s), as_number(lift(1 if kind is None else kind))
    w, code = weekday0(v.col), F.floor(k.col).cast("int")
    value = F.when(code == 1, (w + 1) % 7 + 1).when(code == 2, w + 1).when(code == 3, w).when(code.between(11, 17), (w + 7 - (code - 11)) % 7 + 1)
    return Val(value.cast("double"), "number", errors(v, k, own=F.when(~valid(v.col) | value.isNull(), NUM)))


@function("WEEKNUM", least=1, most=2)
def _weeknum(s, kind=None):
    v, k = as_number(s), as_number(lift(1 if kind is None else kind))
    d, code = date_of(v.col), F.floor(k.col).cast("int")
    first = F.when(code == 1, 6).when(code == 2, 0).when(code.between(11, 17), code - 11)  # the weekday that starts a week, Monday 0
    start = (F.weekday(F.trunc(d, "year")) - first + 7) % 7
    value = F.when(code == 21, F.weekofyear(d)).otherwise(F.floor((F.dayofyear(d) - 1 + start) / 7) + 1)
    return Val(value.cast("double"), "number", errors(v, k, own=F.when(~valid(v.col) | value.isNull(), NUM)))


@function("DATE", least=3, most=3)
def _date(y, m, d):
    a, b, c = as_number(y), as_number(m), as_number(d)
    year = F.floor(a.col) + F.when(a.col < 1900, 1900).otherwise(0)
    months = year * 12 + F.floor(b.col) - 1
    fine = (a.col >= 0) & (a.col < 10000) & (months >= 1899 * 12) & (months < 10000 * 12) & (F.abs(c.col) < 3e6)
    first = F.make_date(F.when(fine, F.floor(months / 12)).cast("int"), F.when(fine, months % 12 + 1).cast("int"), F.lit(1))
    value = serial_of(first) + F.floor(c.col) - 1
    return Val(value, "number", errors(a, b, c, own=F.when(~fine | ~valid(value), NUM)))


@function("TIME", least=3, most=3)
def _time(h, m, s):
    a, b, c = as_number(h), as_number(m), as_number(s)
    total = F.floor(a.col) * 3600 + F.floor(b.col) * 60 + F.floor(c.col)
    return Val((total % 86400) / 86400.0, "number", errors(a, b, c, own=F.when(total < 0, NUM)))


def today(clock=None) -> Val:
    """TODAY with an injected clock (a serial); without one #N/A."""
    return failed(NA) if clock is None else Val(F.floor(lift(clock).col).cast("double"))


def now(clock=None) -> Val:
    return failed(NA) if clock is None else lift(clock)


def shifted(name: str, f) -> None:
    @function(name, least=2, most=2)
    def apply(s, n):
        v, k = as_number(s), as_number(n)
        fine = valid(v.col) & (F.abs(k.col) < 120000)
        months = F.when(fine, F.when(k.col >= 0, F.floor(k.col)).otherwise(F.ceil(k.col))).cast("int")
        value = serial_of(f(date_of(F.when(fine, v.col)), months))
        return Val(value, "number", errors(v, k, own=F.when(~fine | ~valid(value), NUM)))


shifted("EDATE", lambda d, n: F.add_months(d, n))
shifted("EOMONTH", lambda d, n: F.last_day(F.add_months(F.trunc(d, "month"), n)))


@function("DAYS", least=2, most=2)
def _days(end, start):
    a, b = as_number(end), as_number(start)
    return finite((F.floor(a.col) - F.floor(b.col)).cast("double"), errors(a, b))


def with_dates(s: Column, e: Column, f) -> Column:
    """f of the dates of two serials, each evaluated once."""
    return bind(F.struct(date_of(s).alias("a"), date_of(e).alias("b")), lambda d: f(d["a"], d["b"]))


def days360(s: Column, e: Column, european: Column) -> Column:
    return with_dates(s, e, lambda a, b: _days360_of(a, b, european))


def _days360_of(a: Column, b: Column, european: Column) -> Column:
    d1 = F.least(F.dayofmonth(a), F.lit(30))
    d2 = F.when(european | (d1 == 30), F.least(F.dayofmonth(b), F.lit(30))).otherwise(F.dayofmonth(b))
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + d2 - d1


@function("DAYS360", least=2, most=3)
def _days360(start, end, method=None):
    from tabulon.functions.value import as_bool

    a, b, m = as_number(start), as_number(end), as_bool(lift(False if method is None else method))
    return Val(days360(a.col, b.col, m.col).cast("double"), "number", errors(a, b, m, own=F.when(~valid(a.col) | ~valid(b.col), NUM)))


def year_fraction(s: Column, e: Column, basis: Column) -> Column:
    lo, hi = F.least(s, e), F.greatest(s, e)
    days = F.floor(hi) - F.floor(lo)

    def mean_year(a: Column, b: Column) -> Column:
        return F.datediff(F.make_date(F.year(b) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(a), F.lit(1), F.lit(1))) / (F.year(b) - F.year(a) + 1)

    length = with_dates(lo, hi, mean_year)
    return F.when(basis == 0, days360(lo, hi, F.lit(False)) / 360).when(basis == 1, days / length).when(basis == 2, days / 360).when(basis == 3, days / 365).when(basis == 4, days360(lo, hi, F.lit(True)) / 360)


@function("YEARFRAC", least=2, most=3)
def _yearfrac(start, end, basis=None):
    a, b, k = as_number(start), as_number(end), as_number(lift(0 if basis is None else basis))
    value = year_fraction(a.col, b.col, F.floor(k.col))
    return Val(value, "number", errors(a, b, k, own=F.when(~valid(a.col) | ~valid(b.col) | value.isNull(), NUM)))


@function("DATEDIF", least=3, most=3)
def _datedif(start, end, unit):
    a, b, u = as_number(start), as_number(end), as_text(unit)
    code = F.upper(u.col)

    def counted(d1: Column, d2: Column) -> Column:
        short = F.when(F.dayofmonth(d2) < F.dayofmonth(d1), 1).otherwise(0)
        months = (F.year(d2) - F.year(d1)) * 12 + F.month(d2) - F.month(d1) - short
        return (
            F.when(code == "D", F.datediff(d2, d1))
            .when(code == "M", months)
            .when(code == "Y", F.floor(months / 12))
            .when(code == "YM", months % 12)
            .when(code == "MD", F.datediff(d2, F.add_months(d1, months)))
            .when(code == "YD", F.datediff(d2, F.add_months(d1, F.floor(months / 12).cast("int") * 12)))
        )

    value = F.when(code == "D", F.floor(b.col) - F.floor(a.col)).otherwise(with_dates(a.col, b.col, counted))
    return Val(value.cast("double"), "number", errors(a, b, u, own=F.when((b.col < a.col) | ~valid(a.col) | ~valid(b.col) | value.isNull(), NUM)))


def mask_of(weekend) -> str | None:
    """Seven signs, Monday first, 1 for days off; None if the code is unknown or no day is left."""
    mask = weekend if isinstance(weekend, str) else WEEKENDS.get(int(weekend))
    return mask if mask and len(mask) == 7 and set(mask) <= {"0", "1"} and mask != "1111111" else None


def working_days(first: Column, last: Column, mask: str, holidays: list[float]) -> Column:
    """Working days of [first, last], by whole weeks and one lookup; holidays are a short literal list."""
    total = last - first + 1
    weeks = F.floor(total / 7)
    open_days = mask.count("0")
    tails = [[sum(mask[(w + i) % 7] == "0" for i in range(n)) for n in range(7)] for w in range(7)]
    table = F.array(*(F.lit(x) for row in tails for x in row))
    rest = F.element_at(table, (weekday0(first) * 7 + F.pmod(total, F.lit(7))).cast("int") + 1)
    off = [h for h in sorted(set(holidays)) if mask[int(h + 5) % 7] == "0"]
    taken = sum((F.when(F.lit(float(int(h))).between(first, last), 1).otherwise(0) for h in off), F.lit(0))
    return weeks * open_days + rest - taken


def networkdays(start, end, holidays: list[float] = (), weekend: int | str = 1) -> Val:
    """NETWORKDAYS and NETWORKDAYS.INTL: both ends count; negative where the dates are reversed."""
    a, b, mask = as_number(lift(start)), as_number(lift(end)), mask_of(weekend)
    if mask is None:
        return failed(VALUE)
    s, e = F.floor(a.col), F.floor(b.col)
    n = working_days(F.least(s, e), F.greatest(s, e), mask, list(holidays))
    return Val(F.when(s > e, -n).otherwise(n).cast("double"), "number", errors(a, b, own=F.when(~valid(a.col) | ~valid(b.col), NUM)))


def workday(start, days, holidays: list[float] = (), weekend: int | str = 1) -> Val:
    """WORKDAY and WORKDAY.INTL: whole weeks at once, then at most two weeks and the holidays day by day."""
    a, k, mask = as_number(lift(start)), as_number(lift(days)), mask_of(weekend)
    if mask is None:
        return failed(VALUE)
    off = sorted({float(int(h)) for h in holidays if mask[int(h + 5) % 7] == "0"})
    open_days = mask.count("0")
    s, n = F.floor(a.col), F.when(k.col >= 0, F.floor(k.col)).otherwise(F.ceil(k.col))
    way = F.signum(n)
    weeks = F.floor(F.abs(n) / open_days) - 1
    jump = F.when(weeks > 0, weeks).otherwise(0)
    at = s + way * jump * 7
    skipped = sum((F.when((F.lit(h) > F.least(s, at)) & (F.lit(h) <= F.greatest(s, at)) & (way > 0) | (F.lit(h) >= F.least(s, at)) & (F.lit(h) < F.greatest(s, at)) & (way < 0), 1).otherwise(0) for h in off), F.lit(0))
    left = F.abs(n) - jump * open_days + skipped
    free = F.array(*(F.lit(c == "0") for c in mask))
    steps = F.sequence(F.lit(1), F.lit(28 + 7 * len(off)))

    def walk(state, _):
        day = state["day"] + way
        works = F.element_at(free, weekday0(day) + 1)
        if off:
            works = works & ~day.isin(off)
        moved = F.struct(day.alias("day"), (state["left"] - F.when(works, 1).otherwise(0)).cast("double").alias("left"))
        return F.when(state["left"] <= 0, state).otherwise(moved)

    end = F.aggregate(steps, F.struct(at.cast("double").alias("day"), left.cast("double").alias("left")), walk)["day"]
    return Val(end, "number", errors(a, k, own=F.when(~valid(a.col) | ~valid(end), NUM)))


@function("DATEVALUE", least=1, most=1)
def _datevalue(x):
    v = as_text(x)
    part = [F.regexp_extract(v.col, r"^\s*(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})\s*$", i) for i in (1, 2, 3)]
    p = [F.when(c != "", c).cast("int") for c in part]
    first = p[0] > 31
    short = p[2] + F.when(p[2] < 30, 2000).when(p[2] < 100, 1900).otherwise(0)
    year, month, day = F.when(first, p[0]).otherwise(short), F.when(first, p[1]).otherwise(p[0]), F.when(first, p[2]).otherwise(p[1])
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")
    value = F.when(date >= "1900-01-01", serial_of(date))
    return Val(value, "number", errors(v, own=F.when(value.isNull(), VALUE)))


@function("TIMEVALUE", least=1, most=1)
def _timevalue(x):
    v = as_text(x)
    part = [F.regexp_extract(v.col, r"(?i)^\s*(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?\s*(AM|PM)?\s*$", i) for i in (1, 2, 3, 4)]
    h, m, s = (F.when(c != "", c).cast("int") for c in part[:3])
    hour = h + F.when((F.upper(part[3]) == "PM") & (h < 12), 12).otherwise(0)
    total = hour * 3600 + m * 60 + F.coalesce(s, F.lit(0))
    good = (hour < 24) & (m < 60) & (F.coalesce(s, F.lit(0)) < 60)
    return Val(F.when(good, total / 86400.0), "number", errors(v, own=F.when(~F.coalesce(good, F.lit(False)), VALUE)))


# With holidays last and the weekend before them where a name has it.
FUNCTIONS["NETWORKDAYS"] = networkdays
FUNCTIONS["WORKDAY"] = workday
FUNCTIONS["NETWORKDAYS.INTL"] = lambda start, end, weekend=1, holidays=(): networkdays(start, end, holidays, weekend)
FUNCTIONS["WORKDAY.INTL"] = lambda start, days, weekend=1, holidays=(): workday(start, days, holidays, weekend)
FUNCTIONS["TODAY"] = today
FUNCTIONS["NOW"] = now
