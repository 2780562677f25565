"""Whitening of embeddings: leading principal components by Chebyshev-filtered subspace iteration (Zhou and Saad, 2007)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from math import acosh, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop_tables, made_tables, materialize
from .vectors import dense, doubles, widest

SCALE, SHIFT = 1024, 100_000
GUARD = 24  # columns of the subspace beside the wanted ones
CERTIFIED = 2e-14  # residual of a component, relative to the largest eigenvalue
ROUNDING = 1e-11  # residuals that have stopped falling are accepted below this
CONTRAST = 1e9  # most that a filter may magnify the first component over the last wanted one
ROUNDS = 80
LARGEST = float(1 << 62)
LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """The fit: exact sums, leading eigenpairs of the covariance and how well they are certified."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    residuals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    passes: int = 0
    identity_error: float = 0.0

    def base(self) -> np.ndarray:
        """The whole part of the mean of each dimension."""
        return np.array([s // self.n for s in self.sums], np.int64)

    def rest(self) -> np.ndarray:
        """``n`` times what the mean has beyond its whole part."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean, to the last bit of a double: whole parts are subtracted as integers first."""
        return (x - self.base()) - self.rest() / self.n


def quantized(v: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """``floor(scale * v) + shift`` as longs; beyond 2**62 it stays there."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * scale), -LARGEST, LARGEST).astype(np.int64) + shift


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a binary column of little-endian longs."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), width)


def _sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension; halves of 32 bits cannot overflow within a batch."""
    def run(batches):
        n, total = 0, [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + b for t, h, b in zip(total, high, low, strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(-1, width), pa.int32()), "s": pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0)),
            })

    found = {r["i"]: int(r["s"]) for r in rows.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def _products(rows: DataFrame, width: int, columns: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part`` (a matrix of ``columns`` columns), added up in each task and then by one shuffle.

    Every task sends one row per number of its matrix; the driver gets one matrix, whatever the number of tasks.
    """
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0), width))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int64)), pa.array(total.ravel())], names=["i", "part"])

    table = rows.select("x").mapInArrow(run, "i bigint, part double").groupBy("i").agg(F.sum("part").alias("part")).toArrow()
    out = np.zeros(table.num_rows)
    out[table["i"].to_numpy()] = table["part"].to_numpy()
    return out.reshape(-1, columns)


def _degree(values: np.ndarray, wanted: int, bound: float) -> int:
    """The degree at which the first component is magnified ``CONTRAST`` times as much as the last wanted one."""
    first, last = (acosh(max(1.0, 2 * v / bound - 1)) for v in (values[0], values[wanted - 1]))
    return int(np.clip(log(CONTRAST) / max(first - last, 1e-6), 3, 16))


def eigenpairs(multiply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, guard: int = GUARD, seed: int = 0):
    """``(values, vectors, residuals, passes)`` of the ``wanted`` largest eigenpairs of the operator behind ``multiply``.

    A round damps the spectrum below the smallest Ritz value of the subspace by a scaled Chebyshev polynomial, one multiplication per degree,
    then orthogonalises (QR) and solves the projected problem (Rayleigh-Ritz).  It ends when every wanted residual is
    below ``CERTIFIED``, or has stopped falling below ``ROUNDING``; a fit that reaches neither is an error, not a result.
    """
    columns = min(width, wanted + guard)
    wanted = min(wanted, width)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, columns)))[0]
    w, passes, before = multiply(q), 1, np.inf
    for _ in range(ROUNDS):
        small = q.T @ w
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        residuals = np.linalg.norm(w - q * values, axis=0)[:wanted] / max(values[0], np.finfo(float).tiny)
        worst = residuals.max()
        if values[0] <= 0 or worst <= CERTIFIED or (worst <= ROUNDING and worst > 0.5 * before):
            return values[:wanted], q[:, :wanted], residuals, passes
        before = worst
        bound = max(values[-1], 1e-8 * values[0])
        half = bound / 2
        sigma = half / (values[0] - half)
        slope = 2 / sigma
        older, newer = q, (w - half * q) * (sigma / half)
        for _ in range(_degree(values, wanted, bound) - 1):
            sigma_next = 1 / (slope - sigma)
            older, newer = newer, (multiply(newer) - half * newer) * (2 * sigma_next / half) - sigma * sigma_next * older
            sigma = sigma_next
            passes += 1
        q = np.linalg.qr(newer)[0]
        w = multiply(q)
        passes += 1
    raise RuntimeError("the components could not be certified")


def _fitted(rows: DataFrame, width: int, components: int, guard: int) -> Whitening:
    n, sums = _sums(rows, width)
    fit = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    if not n or not width:
        return fit
    fit.trace = float(_products(rows, width, 1, lambda x: np.array([[np.square(fit.centred(x)).sum()]]))[0, 0]) / n

    def multiply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = fit.centred(x)
            return y.T @ (y @ q)

        return _products(rows, width, q.shape[1], part) / n

    if fit.trace > 0:
        values, axes, residuals, fit.passes = eigenpairs(multiply, width, components, guard)
        real = values > max(CERTIFIED * width, 1e-13) * values[0]
        fit.values, fit.axes, fit.residuals = values[real], axes[:, real], residuals[real]
        turn = fit.axes / np.sqrt(fit.values)

        def moments(x: np.ndarray) -> np.ndarray:
            z = fit.centred(x) @ turn
            return np.concatenate([z.T @ z, z.sum(0)[None]])

        found = _products(rows, width, len(fit.values), moments) / n
        spread = found[:-1] - np.outer(found[-1], found[-1])
        fit.identity_error = float(np.abs(spread - np.eye(len(fit.values))).max())
    return fit


def _deviations(x: np.ndarray, fit: Whitening) -> list[int | None]:
    """The sum over dimensions of ``(n * x - S)**2`` as an exact integer; None where no long can hold it."""
    shifted = x - fit.base()
    bound = (int(np.abs(shifted).max(initial=0)) + 1) * fit.n
    if bound * bound * max(1, x.shape[1]) <= LONG:
        return np.square(shifted * fit.n - fit.rest()).sum(1).tolist()
    rest = [s % fit.n for s in fit.sums]
    exact = (sum((int(c) * fit.n - r) ** 2 for c, r in zip(row, rest, strict=True)) for row in shifted.tolist())
    return [d if d <= LONG else None for d in exact]


def whiten(
    df: DataFrame, id_column: str, vector: str, components: int = 8, scale: int = SCALE, shift: int = SHIFT, guard: int = GUARD
) -> DataFrame:
    """``(id_column, component, n, deviation, whitened, explained, identity_error)``: one row per usable row and component.

    Rows whose vector is null or holds a null or non-finite entry are left out; all others are fitted.  An entry c is the long
    ``floor(scale * c) + shift`` (kept within 2**62); shorter vectors are filled up with zeros, so that tables of mixed
    widths have a result too.  ``n`` is the number of fitted rows, S their exact sum; the covariance has divisor n.
    Components are numbered from 1 by falling eigenvalue e: ``whitened`` is the centred row projected on the unit eigenvector, over
    sqrt(e); ``explained`` is e over the trace; ``deviation`` is the exact sum of ``(n x - S)**2`` (null where a long cannot hold it);
    ``identity_error`` is measured on the whitened rows.  There are as many components as the covariance has rank, at most
    ``components``; an empty table, or one of equal rows, has none and gives no rows.  Equal eigenvalues have no
    order of their own: any orthogonal basis of their space may come out.  Repeated and null ids are kept as they are.

    Each multiplication is one pass over the written long vectors: tasks centre their rows, add up their part of XᵀXQ, and one
    shuffle of (width x subspace) numbers per task adds the parts; the driver holds matrices of that size only.
    """
    spark = df.sparkSession
    width = widest(df, vector)
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def long_rows(batches):
        for batch in batches:
            at, v = dense(batch.column(1), width)
            x = quantized(v, scale, shift).astype("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    before = made_tables(spark)
    rows = df.select(F.col(f"`{id_column}`").alias("id"), doubles(vector).alias("v"))
    table = materialize(rows.mapInArrow(long_rows, f"id {kind}, x binary"))
    fit = _fitted(table, width, components, guard)
    k = len(fit.values)

    def projected(batches):
        turn = fit.axes / np.sqrt(fit.values)
        for batch in batches:
            x = _matrix(batch.column(1), width)
            m = len(x) * k
            whitened = (fit.centred(x) @ turn).ravel() if m else np.zeros(0)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, fit.n)),
                pa.array(_deviations(x, fit) if m else [], pa.int64()).take(each), pa.array(whitened),
                pa.array(np.tile(fit.values / fit.trace, len(x)) if m else np.zeros(0)), pa.array(np.full(m, fit.identity_error)),
            ], names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    if not k:
        drop_tables(spark, before)
        return spark.createDataFrame([], schema)
    return table.mapInArrow(projected, schema)
