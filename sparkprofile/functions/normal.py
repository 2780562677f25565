"""The standard normal distribution as JVM column expressions.

Spark has no ``erf`` and no normal quantile; published rational approximations give both to double
precision from plain arithmetic, so the tests over a whole rank table stay inside the JVM.  The
formulas are SQL text over the name of a column.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, functions as F

# Hart's rational approximation of the upper tail (Computer Approximations, 1968, 5666),
# lowest power first: P(Z > a) = exp(-a^2 / 2) * P(a) / Q(a) for 0 <= a < 7.07.
TAIL_P = (
    220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688,
    0.0352624965998911,
)
TAIL_Q = (
    440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207,
    1.75566716318264, 0.0883883476483184,
)
TAIL_LIMIT = 7.07


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    """Horner form, lowest power first."""
    text = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r}D)"
    return text


def with_normal_tail(df: DataFrame, z: str) -> DataFrame:
    """``df`` with ``_tail``, where P(Z > |z|) = exp(-z^2 / 2) * _tail for the column ``z``.

    A column of its own: the functions below use it several times, and Spark keeps a projection
    that is used more than once apart instead of repeating its formula.
    """
    a = "_size"
    # beyond the limit: the first terms of the continued fraction
    fraction = f"1D / ({a} + 1D / ({a} + 2D / ({a} + 3D / ({a} + 4D / ({a} + 0.65D))))) / {math.sqrt(2 * math.pi)!r}D"
    return df.withColumn(a, F.abs(F.col(z))).withColumn(
        "_tail", F.expr(f"CASE WHEN {a} < {TAIL_LIMIT}D THEN {_poly(TAIL_P, a)} / {_poly(TAIL_Q, a)} ELSE {fraction} END")
    )


def normal_cdf(z: str) -> Column:
    """P(Z <= z) for the column ``z`` of :func:`with_normal_tail`."""
    tail = f"exp(-`{z}` * `{z}` / 2) * _tail"
    return F.expr(f"CASE WHEN `{z}` > 0 THEN 1 - {tail} ELSE {tail} END")


def log_normal_tail(z: str, upper: bool = False) -> Column:
    """``ln P(Z <= z)``, or ``ln P(Z > z)``, for the same column; finite far into the tails."""
    far, near = f"ln(_tail) - `{z}` * `{z}` / 2", f"ln(1 - exp(-`{z}` * `{z}` / 2) * _tail)"
    outside = f"`{z}` > 0" if upper else f"`{z}` < 0"
    return F.expr(f"CASE WHEN {outside} THEN {far} ELSE {near} END")


# Wichura's coefficients (Applied Statistics 37, 1988, algorithm AS 241), lowest power first.
# Centre: q * A(r) / B(r) with q = p - 1/2, r = 0.180625 - q^2, for |q| <= 0.425
INV_A = (
    3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
    45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727,
)
INV_B = (
    1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
    21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610,
)
# Shoulder: C(r) / D(r) with r = sqrt(-ln min(p, 1-p)) - 1.6, up to r = 5
INV_C = (
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4,
)
INV_D = (
    1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
    0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
# Tail: E(r) / F(r) with r = sqrt(-ln min(p, 1-p)) - 5
INV_E = (
    6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
    0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
INV_F = (
    1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)


def with_normal_quantile(df: DataFrame, p: str, name: str) -> DataFrame:
    """``df`` with column ``name``, the inverse of :func:`normal_cdf` for the column ``p``, 0 < p < 1.

    The polynomials' argument is a column of its own, so that its logarithm is taken once a row and not once a coefficient.
    """
    q, r = "_centre", "_argument"
    centre = f"{q} * {_poly(INV_A, r)} / {_poly(INV_B, r)}"
    shoulder = f"{_poly(INV_C, f'({r} - 1.6D)')} / {_poly(INV_D, f'({r} - 1.6D)')}"
    tail = f"{_poly(INV_E, f'({r} - 5D)')} / {_poly(INV_F, f'({r} - 5D)')}"
    outer = f"sign({q}) * CASE WHEN {r} <= 5D THEN {shoulder} ELSE {tail} END"
    return (
        df.withColumn(q, F.col(p) - 0.5)
        .withColumn(r, F.expr(f"CASE WHEN abs({q}) <= 0.425D THEN 0.180625D - {q} * {q} ELSE sqrt(-ln(least(`{p}`, 1D - `{p}`))) END"))
        .withColumn(name, F.expr(f"CASE WHEN abs({q}) <= 0.425D THEN {centre} ELSE {outer} END"))
        .drop(q, r)
    )


def normal_quantile(p: str) -> Column:
    """Inverse of :func:`normal_cdf` for the column ``p``, 0 < p < 1."""
    q = f"(`{p}` - 0.5D)"
    near = f"(0.180625D - {q} * {q})"
    far = f"sqrt(-ln(least(`{p}`, 1D - `{p}`)))"
    centre = f"{q} * {_poly(INV_A, near)} / {_poly(INV_B, near)}"
    shoulder = f"{_poly(INV_C, f'({far} - 1.6D)')} / {_poly(INV_D, f'({far} - 1.6D)')}"
    tail = f"{_poly(INV_E, f'({far} - 5D)')} / {_poly(INV_F, f'({far} - 5D)')}"
    outer = f"sign({q}) * CASE WHEN {far} <= 5D THEN {shoulder} ELSE {tail} END"
    return F.expr(f"CASE WHEN abs({q}) <= 0.425D THEN {centre} ELSE {outer} END")
