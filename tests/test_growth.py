"""Work that must not grow faster than the input."""

import numpy as np
import pytest

from tabulon.functions import call, distributions, financial, number, string, tests_of_samples
from tabulon.operators import reconcile
from tabulon.plans import QUERIES, catalogue_queries


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["IMTAN", "IMCOS", "IMSQRT", "IMLN", "IMCONJUGATE"])
def test_complex_text_is_parsed_once(spark, name):
    df = spark.createDataFrame([("3+4i",), ("x",), ("0",), (None,), ("-2.5j",)], "z string")
    made = df.select(call(name, string("z")).named("v"))
    assert planned(made).count("regexp_extract(") <= 3
    assert made.collect()[1].v is None


def test_complex_of_complex_keeps_errors(spark):
    df = spark.createDataFrame([("3+4i",), ("x",), ("0",)], "z string")
    v = call("IMREAL", call("IMPRODUCT", call("IMDIV", "1", string("z")), string("z"), "2"))
    rows = df.select(v.named("v"), v.error("e"), v.shown("s")).collect()
    assert round(rows[0].v, 12) == 2 and rows[0].e is None
    assert [(r.v, r.e, r.s) for r in rows[1:]] == [(None, "#NUM!", "#NUM!")] * 2


def test_equal_steps_are_one_column(spark):
    z = catalogue_queries.Z
    values = [catalogue_queries.call(f, catalogue_queries.call("IMPOWER", z, 2)) for f in ("IMREAL", "IMAGINARY")]
    df, _ = catalogue_queries.stepwise(spark.createDataFrame([("1+i",)], "z string"), values)
    assert df.columns == ["z", "step0"]


def counted(monkeypatch, module, name: str) -> list:
    """The sizes of the arrays that a function is called with."""
    real, sizes = getattr(module, name), []

    def seen(*args):
        sizes.append(np.size(args[0]))
        return real(*args)

    monkeypatch.setattr(module, name, seen)
    return sizes


def test_each_different_row_is_computed_once(monkeypatch):
    sizes = counted(monkeypatch, distributions, "beta_i")
    x, n = np.tile([0.1, 0.5, np.nan], 1000), np.full(3000, 4.0)
    out = distributions.once_each(lambda x, n: distributions.beta_i(x, n, n), [x, n])
    assert sizes == [3] and len(out) == 3000 and np.isnan(out[2::3]).all() and np.allclose(out[1::3], 0.5)
    assert len(distributions.once_each(lambda x: x, [x[:0]])) == 0


def test_binomial_inverse_halves_the_range(monkeypatch):
    sizes = counted(monkeypatch, distributions, "binomial_cdf")
    n, p, a = np.arange(2000.0), np.full(2000, 0.3), np.linspace(0.01, 0.99, 2000)
    k = distributions.binomial_inverse(n, p, a)
    assert len(sizes) < 20
    assert np.all(distributions.binomial_cdf(k, n, p) >= a) and np.all(distributions.binomial_cdf(k - 1, n, p) < a)


def test_series_and_bisection_end_when_they_stand(monkeypatch):
    sizes = counted(monkeypatch, distributions, "settled")
    distributions.gamma_p(np.full(9, 2.0), np.linspace(0.01, 60, 9))
    distributions.beta_i(np.linspace(0.01, 0.99, 9), np.full(9, 3.0), np.full(9, 4.0))
    assert len(sizes) < 250
    calls = []
    found = distributions.bisected(lambda x: calls.append(1) or x / 4, np.zeros(3), np.ones(3), np.array([0.2, 0.3, 0.9]))
    assert len(calls) < 80 and np.allclose(found, [0.8, 1.2, 3.6], rtol=1e-15)


def test_sums_take_many_rows_at_once():
    calls = []
    out = distributions.summed(lambda j, i: calls.append(1) or j + i, np.array([0.0, 2, 5, np.nan]), np.array([3.0, 2, 4, 9]))
    assert calls == [1] and out[:3].tolist() == [6.0, 3.0, 0.0] and np.isnan(out[3])


def test_groups_of_flows_are_solved_together(monkeypatch):
    sizes = counted(monkeypatch, tests_of_samples, "rates_of") + counted(monkeypatch, tests_of_samples, "root")
    roots = counted(monkeypatch, financial, "halved")
    n = np.array([2, 1, 3, 2] * 500)
    v = np.tile([-100.0, 110, -5, -100, 60, 60, 1, np.nan], 500)
    rates = tests_of_samples.rates_of(v, n).reshape(-1, 4)
    assert len(roots) == 1 and sizes == []
    assert np.allclose(rates[:, 0], 0.1) and np.allclose(rates[:, 2], 0.130662386) and np.isnan(rates[:, [1, 3]]).all()


def test_irr_orders_rows_and_takes_days(spark):
    rows = [("a", 3, 60.0, 730.0), ("a", 1, -100.0, 0.0), ("a", 2, 60.0, 365.0), ("b", 1, -1.0, 0.0), (None, 2, 2.2, 365.0), (None, 1, -2.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, o int, v double, d double")
    for days in (None, "d"):
        got = {r.k: r.rate for r in tests_of_samples.irr(df, "k", ["o"], "v", days).collect()}
        assert got["b"] is None and abs(got["a"] - 0.130662386) < 1e-8 and abs(got[None] - 0.1) < 1e-12


def test_declining_balances_of_many_rows():
    rows = np.array([[1000.0, 0, 10, 0, 2, 2, 0], [1000, 100, 5, 0.5, 4.5, 1.5, 0], [1000, 100, 5, 1, 5, 2, 1], [1000, 100, 5, 0, np.nan, 2, 0], [0, 0, 3, 0, 3, 2, 0]])
    out = financial.vdb(*rows.T)
    assert np.isnan(out[3]) and abs(out[0] - 360) < 1e-9 and out[4] == 0
    assert abs(out[2] - (240 + 144 + 86.4 + 29.6)) < 1e-9


def test_payment_stands_outside_the_periods_of_cumulated_sums(spark):
    df = spark.createDataFrame([(0.01,)], "r double")
    assert planned(df.select(call("CUMPRINC", number("r"), 24, 1000, 3, 9, 0).named("v"))).count("POWER(") <= 30


@pytest.mark.parametrize("most", [1000, 3, 0])  # shapes of letters and digits, of classes of characters, and none
def test_keys_meet_texts_of_their_shape(spark, monkeypatch, most):
    monkeypatch.setattr(reconcile, "SHAPES", most)
    keys = [(1, "Order 12;"), (2, "order 123;"), (3, "é7"), (4, "x" * 70), (5, ""), (6, None), (7, "order 12;")]
    texts = [(1, "paid ORDER 12; and order 123; twice: order 12;"), (2, "É7é8"), (3, "y" + "X" * 69), (4, "z" + "X" * 71), (5, None), (6, "7"), (7, "order 1234567;")]
    left, right = spark.createDataFrame(keys, "left_row int, key string"), spark.createDataFrame(texts, "right_row int, text string")
    got = sorted(map(tuple, reconcile.candidates(left, right).collect()))
    assert got == sorted((i, j) for i, k in keys for j, t in texts if k and t and k.lower() in t.lower())


def test_only_substrings_of_a_shape_of_keys_are_sent(spark):
    keys = spark.range(200).selectExpr("concat('order ', id, ';') as gram")
    texts = spark.range(200).selectExpr("id as right_row", "concat('paid for ORDER ', id, '; thanks') as text")
    sent = reconcile.grams(keys, texts)
    assert sent.count() == 200 and sent.filter("text is not null").count() == 0


def test_ambiguous_export_meets_each_table_once(spark):
    assert planned(QUERIES["reconcile_export_both"](spark, "/root/testdata/sf0.001")).count("Join") == 2
    keys = [(i, f"k{i % 7};") for i in range(9)] + [(9, "none"), (10, None)]
    texts = [(i, f"{'again ' * (i % 2)}K{i % 9};" + " k3;" * (i == 5)) for i in range(14)] + [(14, None)]
    left, right = spark.createDataFrame(keys, "l int, key string"), spark.createDataFrame(texts, "r int, text string")
    whole = reconcile.exported(reconcile.reconcile_contains(left, right, "key", "text", "l", "r"), left, right, "ambiguous", "both", "l", "r")
    short = reconcile.exported_ambiguous(left, right, "key", "text", "l", "r")
    assert short.dtypes == whole.dtypes
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, whole.collect())) != []


def test_claims_of_one_round_need_no_join(spark, monkeypatch):
    plans, real = [], reconcile.stage
    monkeypatch.setattr(reconcile, "stage", lambda df, name: plans.append(planned(df)) or real(df, name))
    edges = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (4, 3), (5, 4), (6, 4)], "left_row long, right_row long")
    assert sorted(map(tuple, reconcile.claims(edges).collect())) == [(1, 1, 1), (2, 2, 2), (2, 3, 2), (4, 3, 1), (5, 4, 1)]
    assert len(plans) == 4 and "Join" not in plans[1]  # the edges, a round, what it leaves open and a round that decides it
