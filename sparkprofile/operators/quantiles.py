"""Exact quantiles and median deviations by selection, without sorting or shuffling the data.

A quantile needs one or two order statistics.  Spark's ``percentile`` keeps every distinct value of
a column in one buffer and a global sort moves the whole table, so the order statistics are
*selected* instead: quantiles by counting bits (:mod:`.radix`), and quantiles together with median deviations so:

1. one pass builds a mergeable sketch per column (``percentile_approx`` on a grid of levels); its
   cuts bound the ranks of all values, and the driver derives an interval for each order statistic;
2. one pass counts the values between the intervals and collects the distinct values inside them;
3. the values at the wanted ranks are read off that small table.

Intervals that may hold too many distinct values are first narrowed by a sketch of their inside:
at 1e12 rows that is one more pass.  The sketch only steers; the result is exact, and a rank that
its interval misses is selected by its bits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import name_rows, numeric_columns, numeric_long
from ..functions.session import materialize
from .radix import quantile_name, quantile_table, quantile_values, wide

SKETCH_ACCURACY = 2_000
SKETCH_CUTS = 1_000
NARROW_ACCURACY = 20_000
NARROW_CUTS = 10_000
# Distinct values one interval may hold when it is read off.
INTERVAL_VALUES = 200_000


class RankBounds:
    """What is known about one column: cut values with bounds on the ranks around them.

    For a cut ``v``: at most ``less`` values are smaller and at least ``leq`` are not larger.
    """

    def __init__(self, n: int, low: float, high: float):
        self.n, self.low, self.high = n, low, high
        self._points = [(low, 0, 1), (high, n - 1, n)]
        self._sort()

    def add(self, values: Sequence[float], below: int, inside: int, accuracy: int) -> None:
        """Cuts of a sketch over ``inside`` values with ``below`` smaller ones, at even levels."""
        error = math.ceil(2.0 * inside / accuracy) + 1
        steps = max(len(values) - 1, 1)
        for i, v in enumerate(values):
            rank = below + inside * i / steps
            self._points.append((v, math.floor(rank) + error, math.ceil(rank) - error))
        self._sort()

    def add_exact(self, lo: float, hi: float, below: int, inside: int) -> None:
        """Exactly ``below`` values are smaller than ``lo`` and ``inside`` lie in [lo, hi]."""
        self._points += [(lo, below, 0), (hi, self.n, below + inside)]
        self._sort()

    def _sort(self) -> None:
        points = sorted(self._points, key=lambda p: (math.isnan(p[0]), p[0]))
        self.values = np.array([p[0] for p in points])
        self.less = np.minimum.accumulate(np.array([p[1] for p in points])[::-1])[::-1]
        self.leq = np.maximum.accumulate(np.array([p[2] for p in points]))

    def less_at_most(self, v: float) -> int:
        i = np.searchsorted(self.values, v, "left")
        return int(self.less[i]) if i < len(self.values) else self.n

    def leq_at_least(self, v: float) -> int:
        i = np.searchsorted(self.values, v, "right") - 1
        return int(self.leq[i]) if i >= 0 else 0

    def interval(self, first: int, second: int) -> tuple[float, float]:
        """Values that surely enclose the order statistics ``first`` and ``second``."""
        lo = np.flatnonzero(self.less <= first)
        hi = np.flatnonzero(self.leq >= second + 1)
        return float(self.values[lo[-1]]), float(self.values[hi[0]])

    def deviation_interval(self, first: int, second: int, centre: tuple[float, float]) -> tuple[float, float]:
        """Bounds of the same order statistics of |x - m| for any m in ``centre``."""
        a, b = centre
        reach = max(self.high - a, b - self.low)

        def bisect(enough) -> tuple[float, float]:
            lo, hi = 0.0, reach
            for _ in range(64):
                middle = (lo + hi) / 2
                lo, hi = (lo, middle) if enough(middle) else (middle, hi)
            return lo, hi

        lower, _ = bisect(lambda m: self.less_at_most(b + m) - self.leq_at_least(a - m) > first)
        _, upper = bisect(lambda m: self.leq_at_least(a + m) - self.less_at_most(b - m) >= second + 1)
        return lower, upper

    def distinct_at_most(self, lo: float, hi: float) -> int:
        return self.less_at_most(hi) - self.leq_at_least(lo) + 2


def _even_levels(steps: int) -> Column:
    """Array literal 0, 1/steps, ..., 1 (as SQL text: one call instead of one per level)."""
    return F.expr("array(" + ", ".join(f"{i / steps!r}D" for i in range(steps + 1)) + ")")


def _merge(intervals: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint intervals in order."""
    out: list[list[float]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


class Selection:
    """Order statistics of the non-null x in ``long(column_id, x)``."""

    def __init__(
        self,
        long: DataFrame,
        probabilities: Sequence[float],
        deviation: bool = False,
        moments: bool = False,
        accuracy: int = SKETCH_ACCURACY,
        interval_values: int = INTERVAL_VALUES,
    ):
        self.spark = long.sparkSession
        self.present = long.where(F.col("x").isNotNull())
        self.probabilities = [float(p) for p in probabilities]
        self.deviation = deviation
        self.interval_values = interval_values
        self.facts = {r.column_id: r for r in self._sketch(moments, accuracy)}  # one row per column
        self.bounds: dict[int, RankBounds] = {}
        for c, r in self.facts.items():
            self.bounds[c] = RankBounds(r.n, r.low, r.high)
            self.bounds[c].add(r.cuts, 0, r.n, accuracy)
        self.values: dict[int, list[float]] = {}
        self.deviations: dict[int, float] = {}
        if self.facts:
            self._select()

    def _sketch(self, moments: bool, accuracy: int) -> list:
        levels = _even_levels(SKETCH_CUTS)
        extra = [F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")] if moments else []
        return (
            self.present.groupBy("column_id")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min("x").alias("low"),
                F.max("x").alias("high"),
                F.percentile_approx("x", levels, F.lit(accuracy)).alias("cuts"),
                *extra,
            )
            .collect()
        )

    def _ranks(self, c: int, p: float) -> tuple[int, int, float]:
        """The two order statistics around a level and the share of the second."""
        position = p * (self.bounds[c].n - 1)
        first = min(int(position), self.bounds[c].n - 1)
        share = position - first
        return first, first + 1 if share > 0 else first, share

    def _wanted(self, c: int) -> tuple[list[tuple[float, float]], tuple[float, float] | None]:
        """Value intervals of a column, and the bounds of its median deviation."""
        known = self.bounds[c]
        intervals = [known.interval(*self._ranks(c, p)[:2]) for p in self.probabilities]
        if not self._deviates(c):
            return intervals, None
        first, second, _ = self._ranks(c, 0.5)
        a, b = known.interval(first, second)
        lower, upper = known.deviation_interval(first, second, (a, b))
        return [*intervals, (a, b), (a - upper, b - lower), (a + lower, b + upper)], (lower, upper)

    def _deviates(self, c: int) -> bool:
        return self.deviation and math.isfinite(self.bounds[c].low) and math.isfinite(self.bounds[c].high)

    def _select(self) -> None:
        for _ in range(8):  # each round keeps about one value in a thousand
            wide = {}
            for c, known in self.bounds.items():
                merged = _merge(self._wanted(c)[0])
                large = [i for i in merged if known.distinct_at_most(*i) > self.interval_values]
                if large:
                    wide[c] = large
            if not wide or not self._narrow(wide):
                break
        intervals = {c: _merge(self._wanted(c)[0]) for c in self.bounds}
        self._read_values(intervals)
        missed = [c for c in self.bounds if c not in self.values]
        if missed:  # a bound did not hold
            levels = [*self.probabilities, 0.5]
            found = quantile_values(self.present.where(F.col("column_id").isin(missed)).select("column_id", "x"), levels)
            self.values.update({c: v[:-1] for c, v in found.items()})
        if self.deviation:
            self._finish_deviations()

    def _regions(self, intervals: dict[int, list[tuple[float, float]]]) -> DataFrame:
        """``(column_id, region, v)``: odd regions are the inside of an interval, v their values.

        The interval relation has one row per column, hence the broadcast.
        """
        most = max(len(i) for i in intervals.values())
        rows = []
        for c, pairs in intervals.items():
            flat = [v for pair in pairs for v in pair]
            rows.append((c, *flat, *[None] * (2 * most - len(flat))))
        ends = [f"lo{k} double, hi{k} double" for k in range(most)]
        relation = self.spark.createDataFrame(rows, "column_id int, " + ", ".join(ends))
        x = F.col("x")
        region = F.lit(0)
        for k in range(most):
            region = region + F.when(x >= F.col(f"lo{k}"), 1).otherwise(0) + F.when(x > F.col(f"hi{k}"), 1).otherwise(0)
        return (
            self.present.join(F.broadcast(relation), "column_id")
            .select("column_id", region.alias("region"), "x")
            .select("column_id", "region", F.when(F.col("region") % 2 == 1, F.col("x")).alias("v"))
        )

    def _narrow(self, intervals: dict[int, list[tuple[float, float]]]) -> bool:
        """Count and sketch the inside of wide intervals; true when something was learnt."""
        levels = _even_levels(NARROW_CUTS)
        rows = (
            self._regions(intervals)
            .groupBy("column_id", "region")
            .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", levels, F.lit(NARROW_ACCURACY)).alias("cuts"))
            .collect()  # one row per column and region
        )
        before = {c: sum(self.bounds[c].distinct_at_most(*i) for i in pairs) for c, pairs in intervals.items()}
        for c, pairs in intervals.items():
            mine = {r.region: r for r in rows if r.column_id == c}
            for k, (lo, hi) in enumerate(pairs):
                inside = mine.get(2 * k + 1)
                below = sum(r.n for g, r in mine.items() if g < 2 * k + 1)
                self.bounds[c].add_exact(lo, hi, below, inside.n if inside else 0)
                if inside:
                    self.bounds[c].add(inside.cuts, below, inside.n, NARROW_ACCURACY)
        after = {c: sum(self.bounds[c].distinct_at_most(*i) for i in _merge(self._wanted(c)[0])) for c in intervals}
        return any(after[c] < before[c] for c in intervals)

    def _read_values(self, intervals: dict[int, list[tuple[float, float]]]) -> None:
        """Read the wanted order statistics; columns whose intervals miss one are left out."""
        counts = self._regions(intervals).groupBy("column_id", "region", "v").agg(F.count(F.lit(1)).alias("c"))
        if self.deviation:
            counts = materialize(counts)  # read twice; small, unlike the data behind it
        wanted = []
        for c in intervals:
            levels = [*self.probabilities, 0.5] if self._deviates(c) else self.probabilities
            for i, p in enumerate(levels):
                first, second, _ = self._ranks(c, p)
                wanted += [(c, 2 * i, first), (c, 2 * i + 1, second)]
        relation = self.spark.createDataFrame(wanted, "column_id int, target int, rank bigint")
        # a bounded number of distinct values per column
        order = W.partitionBy("column_id").orderBy("region", "v").rowsBetween(W.unboundedPreceding, 0)
        picked = (
            counts.withColumn("hi", F.sum("c").over(order))
            .join(F.broadcast(relation), "column_id")
            .where((F.col("rank") < F.col("hi")) & (F.col("rank") >= F.col("hi") - F.col("c")))
            .where(F.col("v").isNotNull())
            .select("column_id", "target", "v")
            .collect()  # two rows per column and level
        )
        found = {(r.column_id, r.target): r.v for r in picked}
        medians = {}
        for c in intervals:
            levels = [*self.probabilities, 0.5] if self._deviates(c) else self.probabilities
            if any((c, t) not in found for t in range(2 * len(levels))):
                continue
            out = []
            for i, p in enumerate(levels):
                share = self._ranks(c, p)[2]
                a, b = found[c, 2 * i], found[c, 2 * i + 1]
                out.append(a if share == 0 else a + (b - a) * share)
            if self._deviates(c):
                medians[c] = out.pop()
            self.values[c] = out
        if medians:
            self._read_deviations(counts, intervals, medians)

    def _read_deviations(self, counts: DataFrame, intervals: dict, medians: dict[int, float]) -> None:
        """Median absolute deviations from the values around median -+ deviation."""
        rows = []
        for c, median in medians.items():
            wanted, (lower, upper) = self._wanted(c)
            left, right = wanted[-2], wanted[-1]
            at = [next((k for k, (lo, hi) in enumerate(intervals[c]) if lo <= side[0] and side[1] <= hi), None) for side in (left, right)]
            if None in at:
                continue
            first, second, share = self._ranks(c, 0.5)
            # everything between the two intervals is nearer to the median than they are
            rows.append((c, median, 2 * (at[0] + 1), 2 * at[1], first, second, share, lower, upper))
        if not rows:
            return
        relation = self.spark.createDataFrame(
            rows,
            "column_id int, median double, inner_from int, inner_to int, first bigint, second bigint, share double, "
            "lower double, upper double",
        )
        inner = (F.col("region") % 2 == 0) & F.col("region").between(F.col("inner_from"), F.col("inner_to"))
        near = (
            counts.join(F.broadcast(relation), "column_id")
            .withColumn("d", F.when(F.col("v").isNotNull(), F.abs(F.col("v") - F.col("median"))).when(inner, F.lit(-1.0)))
            .where(F.col("d").isNotNull())
            .groupBy(*relation.columns, "d")
            .agg(F.sum("c").alias("c"))
        )
        order = W.partitionBy("column_id").orderBy("d").rowsBetween(W.unboundedPreceding, 0)

        def at(rank: str) -> Column:
            return F.max(F.when((F.col(rank) < F.col("hi")) & (F.col(rank) >= F.col("hi") - F.col("c")), F.col("d")))

        picked = (
            near.withColumn("hi", F.sum("c").over(order))
            .groupBy("column_id", "share", "lower", "upper")
            .agg(at("first").alias("a"), at("second").alias("b"))
            .collect()  # one row per column
        )
        for r in picked:
            slack = 1e-9 * max(abs(r.upper), 1e-300)
            if r.a is None or r.b is None or r.a < 0 or r.a < r.lower - slack or r.b > r.upper + slack:
                continue
            self.deviations[r.column_id] = r.a if r.share == 0 else r.a + (r.b - r.a) * r.share

    def _finish_deviations(self) -> None:
        """Columns the shortcut did not serve: select the median of the deviations themselves."""
        rest = [c for c in self.values if c not in self.deviations]
        if not rest:
            return
        middle = self.probabilities.index(0.5)
        medians = self.spark.createDataFrame([(c, self.values[c][middle]) for c in rest], "column_id int, median double")
        long = self.present.join(F.broadcast(medians), "column_id").select(
            "column_id", F.abs(F.col("x") - F.col("median")).alias("x")
        )
        self.deviations.update({c: v[0] for c, v in quantile_values(long, (0.5,)).items()})

    def table(self) -> DataFrame:
        """``(column_id, q25, ...)``, with ``mad`` and ``mean, std`` when they were asked for."""
        names = [quantile_name(p) for p in self.probabilities] + (["mad"] if self.deviation else [])
        schema = "column_id int" + "".join(f", {n} double" for n in names)
        rows = []
        for c, values in self.values.items():
            rows.append((c, *values, *([self.deviations.get(c)] if self.deviation else [])))
        return self.spark.createDataFrame(rows, schema)


def long_quantiles(long: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``(column_id, q25, q50, ...)`` of the non-null x in ``long(column_id, x)``, by linear interpolation."""
    return quantile_table(long.select("column_id", "x"), probabilities)


def wide_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """``(column_id, q25, q50, ...)`` of numeric columns, numbered as listed."""
    return quantile_table(wide(df, columns), probabilities)


def quantiles(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    approx: bool = False,
) -> DataFrame:
    """``(column, q25, q50, q75)`` per numeric column; ``approx=True`` is a single sketch pass."""
    names = numeric_columns(df, columns)
    if approx:
        long = numeric_long(df, names)
        cut = F.percentile_approx("x", F.array(*[F.lit(float(p)) for p in probabilities]), F.lit(10_000))
        table = (
            long.groupBy("column_id")
            .agg(cut.alias("q"))
            .select("column_id", *[F.col("q")[i].alias(quantile_name(p)) for i, p in enumerate(probabilities)])
        )
    else:
        table = wide_quantiles(df, names, probabilities)
    return name_rows(df, names, table).drop("column_id")
