"""Special functions against closed forms and published values."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from sparkprofile.functions import normal as nm, special as s


def test_student_t_tail():
    # two-sided p of r=0.5, n=10: t=1.633, 8 degrees of freedom
    assert s.correlation_p(0.5, 10) == pytest.approx(0.14111328125, abs=1e-12)
    assert s.correlation_p(1.0, 10) == 0.0
    assert s.correlation_p(0.3, 2) == 1.0
    # one degree of freedom: t is Cauchy
    r = 0.6
    t = r / math.sqrt(1 - r * r)
    assert s.correlation_p(r, 3) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-12)
    # many degrees of freedom: close to the normal
    r, n = 0.01, 1_000_000
    assert s.correlation_p(r, n) == pytest.approx(math.erfc(r * math.sqrt(n) / math.sqrt(2)), rel=1e-3)


def test_kolmogorov():
    assert s.kolmogorov_exact(10, 0.274) == pytest.approx(0.6284796154565, abs=1e-12)  # Marsaglia et al.
    assert s.kolmogorov_tail(1.0) == pytest.approx(0.2699996716, abs=1e-9)
    assert s.kolmogorov_tail(0.9999999) == pytest.approx(s.kolmogorov_tail(1.0000001), abs=1e-6)
    assert s.ks_p(0.1, 140) == pytest.approx(s.ks_p(0.1, 141), abs=0.01)
    for n in (500, 501, 1000, 5000):  # the series equals the exact distribution
        for x in (0.3, 0.45, 0.6, 0.85, 1.0, 1.36, 1.7, 2.2):
            d = x / math.sqrt(n)
            assert s.pelz_good(n, x) == pytest.approx(s.kolmogorov_exact(n, d), abs=1e-6), (n, x)
    assert s.pelz_good(10**12, 1.36) == pytest.approx(1 - s.kolmogorov_tail(1.36), abs=1e-5)
    assert s.ks_p(3.9999 / 100, 10_000) == pytest.approx(s.ks_p(4.0001 / 100, 10_000), abs=1e-13)
    assert s.ks_p(1e-9, 10_000) == 1.0 and 0 < s.ks_p(0.05, 10_000) < 1e-20


def test_gamma_functions():
    x = np.array([0.0, 0.5, 1.0, 2.0, 5.0, 10.0])
    assert s.gamma_lower(2.0, x) == pytest.approx(1 - np.exp(-x) * (1 + x), abs=1e-13)
    assert s.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert s.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-12)
    rng = np.random.default_rng(1)
    data = rng.gamma(3.0, 2.0, 20_000)
    assert s.gamma_shape(data.mean(), np.log(data).mean()) == pytest.approx(3.0, rel=0.05)


def test_shapiro_published_example():
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    w, p = s.shapiro_from_sums(n, m[0], m[1], (m**2).sum(), (m * x).sum(), x[0], x[1], x[-2], x[-1], ((x - x.mean()) ** 2).sum())
    assert w == pytest.approx(0.78888, abs=1e-4)
    assert p == pytest.approx(0.006704, abs=1e-5)


def test_normal_columns(spark):
    points = [-40.0, -12.0, -7.1, -7.0, -3.0, -1.0, -0.3, 0.0, 0.2, 0.67, 1.96, 5.0, 7.0, 7.2, 9.0]
    df = nm.with_normal_tail(spark.createDataFrame([(z,) for z in points], "z double"), "z")
    for r in df.select(
        "z", nm.normal_cdf("z").alias("p"), nm.log_normal_tail("z").alias("lower"),
        nm.log_normal_tail("z", upper=True).alias("upper"),
    ).collect():
        exact = 0.5 * math.erfc(-r.z / math.sqrt(2))
        assert r.p == pytest.approx(exact, abs=1e-14)
        if exact > 0:
            assert r.lower == pytest.approx(math.log(exact), rel=1e-9, abs=1e-14)
        if exact < 1:
            assert r.upper == pytest.approx(math.log(0.5 * math.erfc(r.z / math.sqrt(2))), rel=1e-9, abs=1e-14)
    assert df.where("z = -40").select(nm.log_normal_tail("z")).first()[0] == pytest.approx(-804.608442, rel=1e-8)


def test_normal_quantile(spark):
    levels = [1e-30, 1e-12, 1e-5, 0.01, 0.074, 0.076, 0.2, 0.5, 0.7, 0.95, 0.999]
    df = spark.createDataFrame([(p,) for p in levels], "p double").select("p", nm.normal_quantile("p").alias("z"))
    for r in df.collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-12)


def test_dagostino_on_known_moments(spark):
    from sparkprofile.operators.distributions import with_dagostino

    rows = [(8, 0.0, -1.0, 1.0), (7, 0.0, -1.0, 1.0), (100, 0.5, 0.3, 2.0), (100, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "n long, skewness double, kurtosis double, sd_pop double")
    out = {(r.n, r.skewness): (r.dp_statistic, r.dp_p) for r in with_dagostino(df).collect()}
    assert out[7, 0.0] == (None, None)
    assert out[100, 0.0] == (None, None)  # no spread
    k2, p = out[100, 0.5]
    assert p == pytest.approx(math.exp(-k2 / 2))
    assert 0.01 < p < 0.2
