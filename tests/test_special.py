import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigspark.functions import special

# (z, p) pairs as published; z is printed to six decimals.
GOLDEN = [(-22.803411, 4.241373e-115), (-19.965293, 1.103790e-88), (-18.128515, 1.898161e-73), (-10.068479, 7.614675e-24), (-8.977134, 2.779122e-19)]


def test_erfc_in_both_engines(spark):
    xs = [-6.0, -1.0, -0.46875, -0.3, 0.0, 1e-9, 0.46, 0.5, 1.0, 3.99, 4.0, 4.01, 10.0, 16.12, 26.0]
    sql = special.erfc_sql("x")
    duck = [r[0] for r in duckdb.sql(f"select {sql} from (values {','.join(f'({x!r}::double, {i})' for i, x in enumerate(xs))}) t(x, i) order by i").fetchall()]
    own = [r[0] for r in spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "x double, i int").orderBy("i").select(F.expr(sql)).collect()]
    for x, a, b in zip(xs, duck, own, strict=True):
        assert a == pytest.approx(math.erfc(x), rel=1e-13) and b == pytest.approx(math.erfc(x), rel=1e-13)


@pytest.mark.parametrize("z,p", GOLDEN)
def test_two_sided_p_reaches_the_far_tail(spark, z, p):
    got = spark.createDataFrame([(z,)], "z double").select(F.expr(special.norm_two_sided_sql("z"))).first()[0]
    assert got == pytest.approx(p, rel=2e-5)


@settings(max_examples=50, deadline=None)
@given(st.floats(0.001, 500))
def test_gamma_functions(x):
    assert special.lgamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)
    h = 1e-4 * max(x, 0.01)
    slope = (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
    assert special.digamma(np.array([x]))[0] == pytest.approx(slope, rel=1e-3, abs=1e-4)


def test_digamma_near_zero():
    assert special.digamma(np.array([0.001]))[0] - special.digamma(np.array([0.002]))[0] == pytest.approx(-500.00164, abs=1e-4)


def test_student():
    got = special.student_two_sided(np.array([2.048407, 6.186170732447338, 0.0, np.nan]), np.array([28, 28, 5, 5]))
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] == pytest.approx(1.1106072e-06, rel=1e-6) and got[2] == pytest.approx(1) and np.isnan(got[3])


def test_rint_rounds_half_to_even(spark):
    rows = [(x,) for x in (0.25, 0.35, 2.45, 100.05, 1.15, 100.525)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(special.rint(F.col("x"), 1)).collect()]
    assert got == [0.2, 0.4, 2.4, 100.0, 1.2, 100.5]


def test_student_in_sql_equals_numpy(spark):
    """Over small and large t and degrees of freedom, both sides of the fraction's turning point, and undefined values."""
    dfs = [1, 2, 3, 5, 10, 30, 97, 1000, 19_998, 1_000_000]
    ts = [0.0, 1e-9, 1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0, 20.0, 100.0, 1e6]
    cases = [(float(sign * t), d) for d in dfs for t in ts for sign in (1, -1)]
    frame = spark.createDataFrame(cases, "t double, df long")
    got = frame.select("t", "df", special.student_two_sided_column("t", "df").alias("p")).toPandas()
    want = special.student_two_sided(got["t"].to_numpy(), got["df"].to_numpy())
    # Numpy's difference of log-gammas has 8 digits at a million degrees of freedom.
    assert np.allclose(got["p"], want, rtol=np.where(got["df"] < 100_000, 1e-9, 1e-7), atol=1e-300)
    odd = spark.createDataFrame([(None, 5), (1.0, None), (1.0, 0), (float("nan"), 5), (float("inf"), 5), (float("-inf"), 5)], "t double, df long")
    p = [r.p for r in odd.select(special.student_two_sided_column("t", "df").alias("p")).collect()]
    assert p[:3] == [None] * 3 and np.isnan(p[3]) and p[4:] == [0.0, 0.0]
