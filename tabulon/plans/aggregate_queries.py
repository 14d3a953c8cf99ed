"""Aggregates, conditional aggregates, order statistics, ranks and D-functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions import aggregates as A
from tabulon.functions import tests_of_samples as S
from tabulon.operators.criteria import all_of, criterion, database, dget
from tabulon.plans.registry import query, r4

BY = "l_returnflag"
#: Name, aggregate and oracle expression over l_extendedprice (x).
BASIC = [
    ("sum_col", "SUM", "sum(x)"), ("average_col", "AVERAGE", "avg(x)"), ("min_col", "MIN", "min(x)"), ("max_col", "MAX", "max(x)"), ("sumsq", "SUMSQ", "sum(x / 1000 * x / 1000)"),
    ("var_s", "VAR.S", "var_samp(x / 1000)"), ("var_p", "VAR.P", "var_pop(x / 1000)"), ("stdev_s", "STDEV.S", "stddev_samp(x / 1000)"), ("stdev_p", "STDEV.P", "stddev_pop(x / 1000)"), ("devsq", "DEVSQ", "var_pop(x / 1000) * count(x)"),
    ("geomean", "GEOMEAN", "exp(avg(ln(x / 1000)))"), ("harmean", "HARMEAN", "count(x) / sum(1000 / x)"), ("median", "MEDIAN", "quantile_cont(x, 0.5)"),
    ("skew_p", "SKEW.P", "sum(z * z * z) / count(z)"), ("kurt_pop_check", "KURT", "(count(z) + 1) * (count(z) - 1) / ((count(z) - 2.0) * (count(z) - 3)) * (sum(z * z * z * z) / count(z) - 3) + 6.0 * (count(z) - 1) / ((count(z) - 2.0) * (count(z) - 3))"),
    ("skew", "SKEW", "sum(z * z * z) / count(z) * sqrt(count(z) * (count(z) - 1.0)) / (count(z) - 2)"),
]


def basic(name: str, kind: str, expression: str) -> None:
    scaled = "/ 1000" in expression or "z" in expression or "1000 /" in expression
    digits = 2 if kind in ("SUM", "SUMSQ", "DEVSQ") else 4
    moments = "z" in expression
    inner = "(select l_returnflag, l_extendedprice as x, (l_extendedprice - avg(l_extendedprice) over w) / stddev_pop(l_extendedprice) over w as z from lineitem window w as (partition by l_returnflag))" if moments else "(select l_returnflag, l_extendedprice as x from lineitem)"

    @query(f"select l_returnflag, round({expression}, {digits}) as value from {inner} group by l_returnflag", name)
    def f(t):
        x = F.col("l_extendedprice") / 1000 if scaled else F.col("l_extendedprice")
        return t.lineitem.groupBy(BY).agg(r4(A.agg(kind, x), "value", digits))


for _row in BASIC:
    basic(*_row)


@query("select count(l_quantity) as n, count(l_returnflag) as n_a, count(*) filter (l_returnflag is null or l_returnflag = '') as n_blank from lineitem")
def count_columns(t):
    return t.lineitem.agg(A.agg("COUNT", "l_quantity").alias("n"), A.counta("l_returnflag").alias("n_a"), A.countblank(F.col("l_returnflag")).alias("n_blank"))


PRODUCT_BY_ORDER_SQL = "select l_orderkey, round(exp(sum(ln(1 + l_tax))), 4) as value from lineitem group by 1"


@query(PRODUCT_BY_ORDER_SQL, "product_small")
@query(PRODUCT_BY_ORDER_SQL)
def product_by_order(t):
    return t.lineitem.groupBy("l_orderkey").agg(r4(A.agg("PRODUCT", 1 + F.col("l_tax")), "value"))


@query("select avg(coalesce(try_cast(p_name as double), 0)) as average, max(coalesce(try_cast(p_name as double), 0)) as most, round(stddev_pop(coalesce(try_cast(p_name as double), 0)), 4) as spread from part")
def a_kinds(t):
    return t.part.agg(A.agg("AVERAGEA", "p_name").alias("average"), A.agg("MAXA", "p_name").alias("most"), r4(A.agg("STDEVPA", "p_name"), "spread"))


BIG = "l_returnflag = 'R' and l_quantity > 25"


def big():
    return all_of(criterion("l_returnflag", "R", "text"), criterion("l_quantity", ">25"))


@query(
    f"select round(sum(l_extendedprice) filter ({BIG}), 2) as sumifs, count(*) filter ({BIG}) as countifs, round(avg(l_extendedprice) filter ({BIG}), 4) as averageifs, max(l_extendedprice) filter ({BIG}) as maxifs, min(l_extendedprice) filter ({BIG}) as minifs from lineitem"
)
def sumifs(t):
    x = F.when(big(), F.col("l_extendedprice"))
    return t.lineitem.agg(r4(A.agg("SUM", x), "sumifs", 2), F.count_if(big()).alias("countifs"), r4(A.agg("AVERAGE", x), "averageifs"), A.agg("MAX", x).alias("maxifs"), A.agg("MIN", x).alias("minifs"))


@query("select l_linestatus, round(sum(l_extendedprice) filter (l_quantity > 25), 2) as sumif, count(*) filter (l_quantity > 25) as countif, round(avg(l_extendedprice) filter (l_quantity > 25), 4) as averageif from lineitem group by l_linestatus")
def sumif_by(t):
    x = F.when(criterion("l_quantity", ">25"), F.col("l_extendedprice"))
    return t.lineitem.groupBy("l_linestatus").agg(r4(A.agg("SUM", x), "sumif", 2), A.agg("COUNT", x).alias("countif"), r4(A.agg("AVERAGE", x), "averageif"))


@query("select count(*) filter (p_name ilike 'red%') as starts, count(*) filter (p_name ilike '%e_ %') as inside, count(*) filter (lower(p_brand) <> 'brand#11') as other, count(*) filter (p_size >= 10) as big, 0::bigint as blank from part")
def criteria_wildcard(t):
    c = lambda *a: F.count_if(criterion(*a))
    return t.part.agg(c("p_name", "red*", "text").alias("starts"), c("p_name", "*e? *", "text").alias("inside"), c("p_brand", "<>brand#11", "text").alias("other"), c("p_size", ">=10").alias("big"), c("p_name", "", "text").alias("blank"))


@query("select l_returnflag, quantile_cont(l_quantity, 0.9) as p90, quantile_cont(l_quantity, 0.25) as q1, median(l_quantity) as q2 from lineitem group by l_returnflag")
def percentile_inc(t):
    x = F.col("l_quantity")
    return t.lineitem.groupBy(BY).agg(A.percentile_inc(x, 0.9).alias("p90"), A.quartile_inc(x, 1).alias("q1"), A.quartile_inc(x, 2).alias("q2"))


@query(
    """with s as (select p_brand, p_retailprice as x, row_number() over (partition by p_brand order by p_retailprice) as k, count(*) over (partition by p_brand) as n from part),
       p as (select p_brand, x, k, 0.25 * (n + 1) as pos from s)
       select p_brand, round(max(case when k = floor(pos) then x end) + (max(case when k = floor(pos) + 1 then x end) - max(case when k = floor(pos) then x end)) * (max(pos) - floor(max(pos))), 4) as value from p group by p_brand"""
)
def percentile_exc(t):
    return A.percentile_exc(t.part, "p_retailprice", 0.25, ["p_brand"]).withColumn("value", r4("value"))


@query("select c_nationkey, c_acctbal as value from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc) as k from customer) where k = 3")
def large_by(t):
    return A.kth(t.customer, "c_acctbal", 3, True, ["c_nationkey"])


@query("select c_acctbal as value from customer order by c_acctbal limit 1 offset 4")
def small_k(t):
    return A.kth(t.customer, "c_acctbal", 5, False)


@query("select mode from (select p_size as mode, count(*) as n from part group by 1 having n > 1 order by n desc, mode limit 1)")
def mode_sngl(t):
    return A.mode_sngl(t.part, "p_size")


@query("with c as (select p_size, count(*) as n from part group by 1) select p_size from c where n = (select max(n) from c) and n > 1")
def mode_mult(t):
    return A.mode_mult(t.part, "p_size")


@query("select l_returnflag, round(avg(abs(l_quantity - m)), 4) as avedev from (select *, avg(l_quantity) over (partition by l_returnflag) as m from lineitem) group by l_returnflag")
def avedev(t):
    return A.avedev(t.lineitem, "l_quantity", [BY]).withColumn("avedev", r4("avedev"))


@query("select l_returnflag, round(avg(l_quantity), 4) as trimmean from (select *, row_number() over w as k, count(*) over (partition by l_returnflag) as n from lineitem window w as (partition by l_returnflag order by l_quantity)) where k > floor(n * 0.2 / 2) and k <= n - floor(n * 0.2 / 2) group by l_returnflag")
def trimmean(t):
    return A.trimmean(t.lineitem, "l_quantity", 0.2, [BY]).withColumn("trimmean", r4("trimmean"))


@query(
    """select l_returnflag, round(corr(y, x), 4) as correl, round(corr(y, x) * corr(y, x), 4) as rsq, round(covar_pop(y, x), 2) as covariance_p, round(covar_samp(y, x), 2) as covariance_s,
       round(regr_slope(y, x), 4) as slope, round(regr_intercept(y, x), 2) as intercept, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2)), 2) as steyx,
       round(regr_intercept(y, x) + regr_slope(y, x) * 30, 2) as forecast from (select l_returnflag, l_quantity as x, l_extendedprice as y from lineitem) group by l_returnflag"""
)
def paired_statistics(t):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    p = A.paired(x, y)
    return t.lineitem.groupBy(BY).agg(
        r4(p["CORREL"], "correl"), r4(p["RSQ"], "rsq"), r4(p["COVARIANCE.P"], "covariance_p", 2), r4(p["COVARIANCE.S"], "covariance_s", 2), r4(p["SLOPE"], "slope"), r4(p["INTERCEPT"], "intercept", 2), r4(p["STEYX"], "steyx", 2), r4(A.forecast(30, x, y), "forecast", 2),
    )


@query("select round(sum(l_quantity * l_tax), 2) as sumproduct, round(sum(l_quantity * l_quantity - l_tax * l_tax), 2) as sumx2my2, round(sum(l_quantity * l_quantity + l_tax * l_tax), 2) as sumx2py2, round(sum((l_quantity - l_tax) * (l_quantity - l_tax)), 2) as sumxmy2 from lineitem")
def sumproduct(t):
    p = A.paired(F.col("l_quantity"), F.col("l_tax"))
    return t.lineitem.agg(*(r4(p[k], k.lower(), 2) for k in ("SUMPRODUCT", "SUMX2MY2", "SUMX2PY2", "SUMXMY2")))




@query(
    """select c_custkey, rank() over d as rank_eq, rank() over d + (count(*) over (partition by c_nationkey, c_acctbal) - 1) / 2.0 as rank_avg,
       floor(round(percent_rank() over (partition by c_nationkey order by c_acctbal) * 1000, 6)) / 1000 as percentrank from customer window d as (partition by c_nationkey order by c_acctbal desc)"""
)
def rank_kinds(t):
    down = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    up = Window.partitionBy("c_nationkey").orderBy("c_acctbal")
    ties = F.count("*").over(Window.partitionBy("c_nationkey", "c_acctbal"))
    rank = F.rank().over(down)
    return t.customer.select("c_custkey", rank.cast("long").alias("rank_eq"), (rank + (ties - 1) / 2.0).alias("rank_avg"), (F.floor(F.round(F.percent_rank().over(up) * 1000, 6)) / 1000).alias("percentrank"))


CRITERIA = [{"o_orderstatus": "F", "o_totalprice": ">100000"}, {"o_orderpriority": "1*"}]
KINDS = {"o_totalprice": "number"}
WANTED = "(o_orderstatus = 'F' and o_totalprice > 100000) or o_orderpriority like '1%'"


@query(f"select round(sum(o_totalprice), 2) as dsum, count(o_totalprice) as dcount, count(o_orderstatus) as dcounta, round(avg(o_totalprice), 4) as daverage, max(o_totalprice) as dmax, min(o_totalprice) as dmin, round(var_samp(o_totalprice / 1000), 4) as dvar, round(stddev_pop(o_totalprice / 1000), 4) as dstdevp from orders where {WANTED}")
def d_functions(t):
    x = F.col("o_totalprice")
    names = [("SUM", x, "dsum", 2), ("AVERAGE", x, "daverage", 4), ("MAX", x, "dmax", 4), ("MIN", x, "dmin", 4), ("VAR.S", x / 1000, "dvar", 4), ("STDEV.P", x / 1000, "dstdevp", 4)]
    return database(t.orders, CRITERIA, KINDS).agg(*(r4(A.agg(k, c), n, d) for k, c, n, d in names), F.count(x).alias("dcount"), F.count("o_orderstatus").alias("dcounta"))


@query("select c_name as value, null::varchar as error from customer where c_custkey = 7")
def dget_one(t):
    return dget(database(t.customer, [{"c_custkey": 7}], {"c_custkey": "number"}), "c_name")


@query("select null::varchar as value, '#NUM!' as error")
def dget_several(t):
    return dget(database(t.customer, [{"c_custkey": "<5"}], {"c_custkey": "number"}), "c_name")


@query("select user_id, round(sum(value / pow(1.1, k)), 4) as npv from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as k from events) group by user_id")
def npv_by(t):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("k", place).groupBy("user_id").agg(r4(A.npv(0.1, F.col("value"), F.col("k")), "npv"))


@query("select user_id, round(sum(value / pow(1.1, date_diff('day', first, ts::date) / 365.0)), 4) as xnpv from (select *, min(ts::date) over (partition by user_id) as first from events) group by user_id")
def xnpv_by(t):
    first = F.min(F.to_date("ts")).over(Window.partitionBy("user_id"))
    days = F.datediff(F.to_date("ts"), F.col("first"))
    return t.events.withColumn("first", first).groupBy("user_id").agg(r4(F.sum(F.col("value") / F.pow(F.lit(1.1), days / 365.0)), "xnpv"))


@query(
    """with f as (select user_id, case when k = 0 then -50 * n else value end as v, k, n from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as k, count(*) over (partition by user_id) as n from events))
       select user_id, round(pow(sum(case when v > 0 then v * pow(1.12, n - 1 - k) end) / sum(case when v < 0 then -v / pow(1.1, k) end), 1.0 / (max(n) - 1)) - 1, 4) as mirr from f group by user_id having max(n) > 1"""
)
def mirr_by(t):
    w = Window.partitionBy("user_id")
    flows = t.events.select("user_id", "value", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("k"), F.count("*").over(w).alias("n")).filter("n > 1")
    v = F.when(F.col("k") == 0, -50.0 * F.col("n")).otherwise(F.col("value"))
    return flows.groupBy("user_id").agg(r4(A.mirr(v, F.col("k"), F.col("n"), 0.1, 0.12), "mirr"))


@query("select p_brand, round(sum(p_size * pow(0.9, 1 + 2 * (k - 1))), 4) as value from (select p_brand, p_size, row_number() over (partition by p_brand order by p_partkey) as k from part) group by p_brand")
def seriessum(t):
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return t.part.withColumn("k", place).groupBy("p_brand").agg(r4(A.seriessum(0.9, 1, 2, F.col("p_size"), F.col("k")), "value"))


@query("select o_orderpriority, round(1000 * exp(sum(ln(1 + (o_orderkey % 7) / 1e6))), 4) as value from orders group by 1")
def fvschedule(t):
    return t.orders.groupBy("o_orderpriority").agg(r4(1000 * F.product(1 + (F.col("o_orderkey") % 7) / 1e6), "value"))


@query("select round(sum(case when l_quantity between 10 and 20 then 1.0 / n end), 6) as prob from (select l_quantity, count(*) over () as n from lineitem)")
def prob(t):
    inside = F.sum(F.when(F.col("l_quantity").between(10, 20), 1.0))
    return t.lineitem.agg(r4(inside / F.count("*"), "prob", 6))


# Without SQL for tails and roots: held against published values in the tests.


@query()
def sample_tests(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("x"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("y"))
    p = S.t_test(rows, "x", "y", 2, 3, ["l_returnflag"]).withColumnRenamed("p", "t_test")
    return p.join(S.f_test(rows, "x", "y", ["l_returnflag"]).withColumnRenamed("p", "f_test"), "l_returnflag").join(S.z_test(t.lineitem, "l_quantity", 25.5, by=["l_returnflag"]).withColumnRenamed("p", "z_test"), "l_returnflag")


@query()
def irr_by_customer(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    flows = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k"), "o_totalprice")
    signed = flows.withColumn("flow", F.when(F.col("k") == 1, -2 * F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 2))
    return S.irr(signed, "o_custkey", ["k"], "flow")
