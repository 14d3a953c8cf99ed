"""Published values of hypothesis tests and rates of return."""

import pytest

from tabulon.functions import tests_of_samples as S


def test_samples(spark):
    rows = list(zip(map(float, (3, 4, 5, 8, 9, 1, 2, 4, 5)), map(float, (6, 19, 3, 2, 14, 4, 5, 17, 1))))
    df = spark.createDataFrame(rows, "x double, y double")
    assert S.t_test(df, "x", "y", 2, 1).first()[0] == pytest.approx(0.196016, abs=1e-6)
    assert S.t_test(df, "x", "y", 2, 2).first()[0] == pytest.approx(0.191996, abs=1e-5)
    assert S.t_test(df, "x", "y", 2, 3).first()[0] == pytest.approx(0.202294, abs=1e-5)
    f = spark.createDataFrame([(6.0, 20.0), (7.0, 28.0), (9.0, 31.0), (15.0, 38.0), (21.0, 40.0)], "x double, y double")
    assert S.f_test(f, "x", "y").first()[0] == pytest.approx(0.648318, abs=1e-6)
    c = spark.createDataFrame([(58.0, 45.35), (11.0, 17.56), (10.0, 16.09), (35.0, 47.65), (25.0, 18.44), (23.0, 16.91)], "o double, e double")
    assert S.chisq_test(c, "o", "e", 2).first()[0] == pytest.approx(0.000308, abs=1e-6)
    z = spark.createDataFrame([(float(v),) for v in (3, 6, 7, 8, 6, 5, 4, 2, 1, 9)], "x double")
    assert S.z_test(z, "x", 4).first()[0] == pytest.approx(0.090574, abs=1e-6)


def test_rates(spark):
    flows = spark.createDataFrame([(1, k, v, d) for k, (v, d) in enumerate([(-70000.0, 0), (12000.0, 60), (15000.0, 303), (18000.0, 411), (21000.0, 456), (26000.0, 500)])] + [(2, 0, 5.0, 0)], "g int, k int, v double, d int")
    got = {r["g"]: r["rate"] for r in S.irr(flows, "g", ["k"], "v").collect()}
    assert got[1] == pytest.approx(0.086630948, abs=1e-8) and got[2] is None
    dated = spark.createDataFrame([(1, 39448, -10000.0), (1, 39508, 2750.0), (1, 39751, 4250.0), (1, 39859, 3250.0), (1, 39904, 2750.0)], "g int, d int, v double")
    assert S.irr(dated, "g", ["d"], "v", "d").first()["rate"] == pytest.approx(0.373362535, abs=1e-8)
