"""Distribution tails that need iteration: small numpy functions and their Arrow UDFs.

All but :func:`gamma_cdf` run on result tables of one row per column or column pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_EPS = 1e-15
_TINY = 1e-300


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return h


def incomplete_beta(a: float, b: float, x: float, complement: float | None = None) -> float:
    """Regularised ``I_x(a, b)``; ``complement`` is 1-x when known without cancellation."""
    y = 1.0 - x if complement is None else complement
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    # lgamma(a+b) - lgamma(a) cancels for large a; Stirling's series keeps the digits.
    front = math.exp(_log_gamma_ratio(a, b) - math.lgamma(b) + a * math.log(x) + b * math.log(y))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, y) / b


def _log_gamma_ratio(a: float, b: float) -> float:
    """``lgamma(a + b) - lgamma(a)``."""
    if a < 1e3:
        return math.lgamma(a + b) - math.lgamma(a)

    def tail(z: float) -> float:
        return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)

    return (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + tail(a + b) - tail(a)


def correlation_p(r: float, n: float) -> float:
    """Two-sided p-value of a correlation coefficient: Student t with n-2 degrees of freedom."""
    if r is None or n is None or math.isnan(r) or n < 2:
        return math.nan
    if n == 2:
        return 1.0
    rest = (1.0 - r) * (1.0 + r)
    if rest <= 0.0:
        return 0.0
    # P(|T| > t) = I_{df/(df+t^2)}(df/2, 1/2), and df/(df+t^2) is 1-r^2.
    return incomplete_beta((n - 2) / 2.0, 0.5, rest, complement=r * r)


def kolmogorov_tail(x: float) -> float:
    """Limit distribution of sqrt(n) D: P(K > x)."""
    if x <= 0:
        return 1.0
    if x < 1.0:
        # theta-function form, fast for small x
        y = math.exp(-(math.pi**2) / (8 * x * x))
        total = sum(y ** ((2 * k - 1) ** 2) for k in range(1, 6))
        return 1.0 - math.sqrt(2 * math.pi) / x * total
    return max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 12)))


# Up to this many values the exact matrix power is used; beyond, the series is within 1e-6 of it (at 140 values within 3e-6).
KS_EXACT = 500


def ks_p(d: float, n: float) -> float:
    """p-value of the one-sample statistic: exact, or the expansion of the same distribution in 1 / sqrt(n)."""
    if d is None or n is None or math.isnan(d) or n < 1:
        return math.nan
    if d >= 1.0:
        return 0.0
    if n <= KS_EXACT:
        return min(1.0, max(0.0, 1.0 - kolmogorov_exact(int(n), d)))
    x = math.sqrt(n) * d
    if x >= 4.0:  # below 3e-14, where one minus the series has no digits left
        return kolmogorov_tail(x)
    return min(1.0, max(0.0, 1.0 - pelz_good(n, x)))


def pelz_good(n: float, x: float) -> float:
    """P(sqrt(n) D < x) up to the term in n^(-3/2) (Pelz and Good, J. R. Stat. Soc. B 38, 1976), for x below 4."""
    if x < 0.04:
        return 0.0  # every term is below exp(-700)
    half = (np.pi * (np.arange(-16, 16) + 0.5)) ** 2
    whole = (np.pi * np.arange(-16, 17)) ** 2
    x2 = x * x
    at_half, at_whole = np.exp(-half / (2 * x2)), np.exp(-whole / (2 * x2))
    k0 = at_half.sum() / x
    k1 = ((half - x2) * at_half).sum() / (6 * x**4)
    k2 = (
        ((6 * x2**3 + 2 * x2**2 + (2 * x2**2 - 5 * x2) * half + (1 - 2 * x2) * half**2) * at_half).sum() / (72 * x**7)
        - (whole * at_whole).sum() / (36 * x**3)
    )
    cubic = (5 - 30 * x2) * half**3 + (212 * x2**2 - 60 * x2) * half**2 + (135 * x2**2 - 96 * x2**3) * half - 30 * x2**3 - 90 * x2**4
    k3 = (cubic * at_half).sum() / (6480 * x**10) + ((3 * x2 * whole - whole**2) * at_whole).sum() / (216 * x**6)
    root = math.sqrt(n)
    return float(math.sqrt(math.pi / 2) * (k0 + k1 / root + k2 / n + k3 / (n * root)))


def kolmogorov_exact(n: int, d: float) -> float:
    """P(D_n < d) by the matrix power of Marsaglia, Tsang and Wang (J. Stat. Softw. 8, 2003)."""
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    matrix = np.tri(m, m, 1)
    steps = np.arange(1, m + 1)
    matrix[:, 0] -= h**steps
    matrix[m - 1, :] -= h ** steps[::-1]
    if 2 * h - 1 > 0:
        matrix[m - 1, 0] += (2 * h - 1) ** m
    i, j = np.indices((m, m))
    with np.errstate(over="ignore"):  # one over an infinite factorial is the zero it should be
        factorial = np.cumprod(np.concatenate(([1.0], np.arange(1, m + 2, dtype=float))))
    matrix /= factorial[np.clip(i - j + 1, 0, None)]
    # each of the n factors takes its share of n!/n^n: nothing overflows or underflows
    power = np.linalg.matrix_power(matrix * (math.exp(math.lgamma(n + 1) / n) / n), n)
    return float(power[k - 1, k - 1])


def gamma_lower(shape: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function for one shape and many x."""
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    positive = x > 0
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        front = np.where(positive, np.exp(shape * np.log(np.where(positive, x, 1.0)) - x - math.lgamma(shape)), 0.0)
    low = positive & (x < shape + 1.0)
    if low.any():
        v = x[low]
        term = np.full_like(v, 1.0 / shape)
        total = term.copy()
        a = shape
        for _ in range(10_000):
            a += 1.0
            term = term * v / a
            total += term
            if np.all(term < total * _EPS):
                break
        out[low] = front[low] * total
    high = positive & ~low
    if high.any():
        v = x[high]
        b = v + 1.0 - shape
        c = np.full_like(v, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - shape)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h *= step
            if np.all(np.abs(step - 1.0) < _EPS):
                break
        out[high] = 1.0 - front[high] * h
    return out


def digamma(x: float) -> float:
    shift = 0.0
    while x < 10.0:
        shift -= 1.0 / x
        x += 1.0
    y = 1.0 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    shift = 0.0
    while x < 10.0:
        shift += 1.0 / (x * x)
        x += 1.0
    y = 1.0 / (x * x)
    return shift + 1.0 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def gamma_shape(mean: float, mean_log: float) -> float:
    """Maximum-likelihood shape of a gamma distribution with location zero (Newton)."""
    if mean is None or mean_log is None or not mean > 0 or not math.isfinite(mean_log):
        return math.nan
    s = math.log(mean) - mean_log
    if s <= 0:
        return math.nan
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(100):
        step = (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        new = k - step
        k = new if new > 0 else k / 2
        if abs(step) < 1e-14 * k:
            break
    return k


def gamma_likelihood(shape: float, mean: float, mean_log: float) -> float:
    """Mean log-likelihood at this shape and the best scale, by the means of the distances and of their logarithms."""
    return (shape - 1.0) * mean_log - shape - shape * math.log(mean / shape) - math.lgamma(shape)


class GammaProfile:
    """The likelihood of one column as a function of the location: what is known of it, and which one to try next.

    Locations are distances below the smallest value, in deviations of the column.  ``trial`` is None when nothing is left to try.
    """

    def __init__(self, mean: float, low: float, unit: float):
        self.mean, self.low, self.unit = mean, low, unit
        self.above = (mean - low) / unit  # the mean's distance from the smallest value
        self.trial: float | None = None
        # the limit of shape one and location at the smallest value
        self.found = [(-1.0 - math.log(mean - low), 1.0, low, mean - low)] if mean > low else []

    def _keep(self, distance: float, mean_log: float) -> float:
        """Note the fit at this distance; its likelihood, or minus infinity below shape one."""
        mean = self.above + distance
        shape = gamma_shape(mean, mean_log)
        if math.isnan(shape) or shape < 1.0:
            return -math.inf
        value = gamma_likelihood(shape, mean, mean_log)
        fit = (value - math.log(self.unit), shape, self.low - distance * self.unit, mean / shape * self.unit)
        self.found.append(fit)
        return value

    def start(self, distances: list[float], mean_logs: list[float], zero_log: float | None) -> None:
        """Use the first pass: the mean logarithms at these distances, and of the values themselves if all are positive."""
        shape = gamma_shape(self.mean, zero_log) if zero_log is not None else math.nan
        if not math.isnan(shape):
            self.found.append((gamma_likelihood(shape, self.mean, zero_log), shape, 0.0, self.mean / shape))
        values = [self._keep(d, m) for d, m in zip(distances, mean_logs)]
        best = max(range(len(values)), key=values.__getitem__)
        if values[best] > -math.inf:
            self.left, self.right = (math.log(distances[j]) for j in (max(best - 1, 0), min(best + 1, len(distances) - 1)))
            self.trial = distances[best]

    def step(self, mean_log: float, inverse: float, square: float) -> None:
        """Use the means at ``trial``: a Newton step in its logarithm, halving when that leaves the bracket."""
        distance, mean = self.trial, self.above + self.trial
        self._keep(distance, mean_log)
        shape, here = gamma_shape(mean, mean_log), math.log(distance)
        if math.isnan(shape):
            self.trial = None
            return
        slope = (shape - 1.0) * inverse - shape / mean  # of the likelihood as the distance grows
        shape_slope = (1.0 / mean - inverse) / (1.0 / shape - trigamma(shape))
        bend = shape_slope * (inverse - 1.0 / mean) - (shape - 1.0) * square + shape / (mean * mean)
        if slope > 0 or shape < 1.0:
            self.left = here
        else:
            self.right = here
        first, second = slope * distance, bend * distance * distance + slope * distance  # by the logarithm
        following = here - first / second if second < 0 else math.nan
        if not self.left < following < self.right:
            following = (self.left + self.right) / 2
        self.trial = None if abs(following - here) < 1e-9 else math.exp(following)

    def best(self) -> tuple[float, float, float]:
        """Shape, location and scale of the largest likelihood found."""
        return max(self.found)[1:]


# Royston's polynomials (Applied Statistics 44, 1995, algorithm R94), lowest power first.
R94_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
R94_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
R94_MEAN_SMALL = (0.544, -0.39978, 0.025054, -6.714e-4)
R94_SIGMA_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
R94_MEAN_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915)
R94_SIGMA_LARGE = (-0.4803, -0.082676, 0.0030302)
R94_GAMMA = (-2.273, 0.459)


def _power_series(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(coefficients))


def shapiro_from_sums(
    n: float, m_first: float, m_second: float, sum_m2: float, sum_mx: float,
    x1: float, x2: float, xm: float, xn: float, ssq: float,
) -> tuple[float, float]:
    """W and its p-value from per-column sums over the order statistics.

    ``m`` are the expected normal scores, ``sum_mx`` is the sum of score times value over all
    order statistics, ``x1, x2, xm, xn`` the two smallest and two largest values and ``ssq`` the
    centred sum of squares.
    """
    if not n >= 3 or not ssq > 0:
        return math.nan, math.nan
    n = int(n)
    if n == 3:
        w = 0.5 * (xn - x1) ** 2 / ssq
        w = max(w, 0.75)
        p = 6.0 / math.pi * (math.asin(math.sqrt(min(w, 1.0))) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    u = 1.0 / math.sqrt(n)
    top, second = -m_first, -m_second  # the scores are symmetric; the largest is minus the smallest
    root = math.sqrt(sum_m2)
    a_n = top / root + _power_series(R94_LAST, u)
    if n > 5:
        a_m = second / root + _power_series(R94_SECOND, u)
        phi = (sum_m2 - 2 * top**2 - 2 * second**2) / (1 - 2 * a_n**2 - 2 * a_m**2)
        middle = sum_mx - top * (xn - x1) - second * (xm - x2)
        b = a_n * (xn - x1) + a_m * (xm - x2) + middle / math.sqrt(phi)
    else:
        phi = (sum_m2 - 2 * top**2) / (1 - 2 * a_n**2)
        middle = sum_mx - top * (xn - x1)
        b = a_n * (xn - x1) + middle / math.sqrt(phi)
    w = min(b * b / ssq, 1.0)
    if w >= 1.0:
        return 1.0, 1.0
    log_n = math.log(n)
    y = math.log1p(-w)
    if n <= 11:
        gamma = _power_series(R94_GAMMA, float(n))
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mean = _power_series(R94_MEAN_SMALL, float(n))
        sigma = math.exp(_power_series(R94_SIGMA_SMALL, float(n)))
    else:
        mean = _power_series(R94_MEAN_LARGE, log_n)
        sigma = math.exp(_power_series(R94_SIGMA_LARGE, log_n))
    return w, 0.5 * math.erfc((y - mean) / sigma / math.sqrt(2.0))


def _rowwise(function, *series: pd.Series) -> pd.Series:
    return pd.Series([function(*cells) for cells in zip(*series)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return _rowwise(correlation_p, r, n)


@F.pandas_udf(T.DoubleType())
def ks_p_value(d: pd.Series, n: pd.Series) -> pd.Series:
    return _rowwise(ks_p, d, n)


@F.pandas_udf(T.DoubleType())
def gamma_cdf(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    """Gamma distribution function, vectorised per parameter pair of the batch."""
    out = np.full(len(x), np.nan)
    z = (x / scale).to_numpy()
    for k in shape.dropna().unique():
        rows = (shape == k).to_numpy()
        out[rows] = gamma_lower(float(k), z[rows])
    return pd.Series(out)


@F.pandas_udf(
    T.StructType([T.StructField("statistic", T.DoubleType()), T.StructField("p_value", T.DoubleType())])
)
def shapiro_test(
    n: pd.Series, m_first: pd.Series, m_second: pd.Series, sum_m2: pd.Series, sum_mx: pd.Series,
    x1: pd.Series, x2: pd.Series, xm: pd.Series, xn: pd.Series, ssq: pd.Series,
) -> pd.DataFrame:
    pairs = [shapiro_from_sums(*cells) for cells in zip(n, m_first, m_second, sum_m2, sum_mx, x1, x2, xm, xn, ssq)]
    return pd.DataFrame(pairs, columns=["statistic", "p_value"])
