"""The three-parameter gamma fit against a search over locations on the collected column."""

import math

import numpy as np
import pytest

import sparkprofile as sp
from sparkprofile.functions import special as s


def likelihood(x, shape, location, scale):
    y = (x - location) / scale
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(y > 0, np.log(y), 0.0 if shape == 1 else -math.inf)
    return float(((shape - 1) * logs - y).mean() - math.lgamma(shape) - math.log(scale))


def searched(x):
    """The largest likelihood over 4 000 locations, shapes of at least one."""
    best = -1 - math.log(x.mean() - x.min())
    for distance in np.exp(np.linspace(math.log(1e-6), math.log(300), 4000)) * x.std():
        y = x - x.min() + distance
        shape = s.gamma_shape(y.mean(), np.log(y).mean())
        if shape >= 1:
            best = max(best, s.gamma_likelihood(shape, y.mean(), np.log(y).mean()))
    return best


def columns():
    rng = np.random.default_rng(8)
    return {
        "shifted": rng.gamma(3.0, 2.0, 3000) + 100,
        "negative": rng.gamma(8.0, 0.5, 3000) - 50,
        "exponential": rng.exponential(5.0, 3000) + 2,
        "peaked": rng.gamma(0.4, 3.0, 3000),  # shape below one: location zero
        "left": 10 - rng.gamma(2.0, 1.0, 3000),  # no gamma distribution leans to this side
        "small": rng.gamma(4.0, 1e-9, 3000),
        "tied": np.round(rng.gamma(3.0, 2.0, 3000)),
    }


def test_gamma_fit_is_not_below_a_search(spark):
    data = columns()
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*data.values())], list(data))
    out = {r.column: r for r in sp.fit_distribution(df, list(data), "gamma").collect()}
    assert sorted(out) == sorted(data)
    for name, x in data.items():
        fit = out[name]
        assert likelihood(x, fit["shape"], fit.location, fit.scale) >= searched(x) - 1e-9, name
        values, counts = np.unique(x, return_counts=True)
        up = counts.cumsum() / len(x)
        cdf = s.gamma_lower(fit["shape"], (values - fit.location) / fit.scale)
        gap = max(np.abs(up - cdf).max(), np.abs(cdf - (up - counts / len(x))).max())
        assert fit.ks_statistic == pytest.approx(gap, abs=1e-9), name
        assert fit.ks_p_value == pytest.approx(s.ks_p(gap, len(x)), abs=1e-9)
    assert out["shifted"].location == pytest.approx(100, abs=1) and out["shifted"]["shape"] == pytest.approx(3, rel=0.3)
    assert out["peaked"].location == 0 and out["peaked"]["shape"] == pytest.approx(0.4, rel=0.1)
    assert out["exponential"].location == pytest.approx(2, abs=0.1)


def test_gamma_fit_of_odd_columns(spark):
    rows = [(float(i), 5.0, None if i > 4 else 1.0 * i, float("nan") if i == 3 else 1.0, 0.0 if i < 15 else 7.0) for i in range(20)]
    df = spark.createDataFrame(rows, "line double, constant double, few double, nan double, two double")
    out = {r.column: r for r in sp.fit_distribution(df, df.columns, "gamma").collect()}
    assert sorted(out) == ["line", "two"]
    assert out["two"].location <= 0 and out["two"].scale > 0 and out["two"]["shape"] >= 1
    assert sp.fit_distribution(df.limit(0), df.columns, "gamma").count() == 0
