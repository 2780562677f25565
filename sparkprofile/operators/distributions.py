"""Distribution shape: histograms, quartiles, normality tests, density, fits.

Everything that needs order comes from one rank table (``frequency.rank_table``): the empirical
distribution function at a distinct value is ``hi / n``, and ties are weighted, never expanded.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import name_rows, numeric_columns, numeric_long, ratio, stack
from ..functions.normal import log_normal_tail, normal_cdf, with_normal_quantile, with_normal_tail
from ..functions.session import materialize
from ..functions.special import GammaProfile, gamma_cdf, ks_p_value, shapiro_test
from . import frequency as fq
from .quantiles import long_quantiles, wide_quantiles

# Significance level, size limits of the tests, plot defaults, type rules.
ALPHA = 0.05
SHAPIRO_MAX = 5000  # values up to which the approximation of the p-value is published
TIE_CHUNK = 100_000
DAGOSTINO_MIN = 8
TYPE_MIN = 10
BINS = 30
KDE_POINTS = 100
KDE_CELL = 0.5  # width of a cell, in bandwidths
KDE_TERMS = 14  # moments of a cell: the remainder is below 2e-14 of a kernel's height
KDE_REACH = 12.0  # bandwidths beyond which a kernel is below 1e-29
KDE_PADDING = 0.1
KDE_CELLS = 2000
DISTRIBUTIONS = ("norm", "expon", "uniform", "gamma")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def shape_ids(long: DataFrame) -> DataFrame:
    """``(column_id, n, mean, sd_pop, sd, min, max, skewness, kurtosis)`` with population moments."""
    n = F.col("n")
    return (
        long.groupBy("column_id")
        .agg(
            F.count("x").alias("n"),
            F.avg("x").alias("mean"),
            F.var_pop("x").alias("var_pop"),
            F.min("x").alias("min"),
            F.max("x").alias("max"),
            F.skewness("x").alias("skew"),
            F.kurtosis("x").alias("kurt"),
        )
        .select(
            "column_id", "n", "mean", "min", "max",
            F.sqrt("var_pop").alias("sd_pop"),
            F.when(n > 1, F.sqrt(F.col("var_pop") * n / (n - F.lit(1.0)))).alias("sd"),
            F.when(n >= 3, F.coalesce("skew", F.lit(0.0))).otherwise(0.0).alias("skewness"),
            F.when(n >= 4, F.coalesce("kurt", F.lit(0.0))).otherwise(0.0).alias("kurtosis"),
        )
    )


def moments_pop(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, skewness, kurtosis)``: population skewness and excess kurtosis."""
    names = numeric_columns(df, columns)
    zero = F.lit(0.0)
    return name_rows(df, names, shape_ids(numeric_long(df, names))).select(
        "column", F.coalesce("skewness", zero).alias("skewness"), F.coalesce("kurtosis", zero).alias("kurtosis")
    )


def quartiles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, min, q25, median, q75, max, iqr)``."""
    names = numeric_columns(df, columns)
    table = wide_quantiles(df, names, (0.0, 0.25, 0.5, 0.75, 1.0))
    return name_rows(df, names, table).select(
        "column", F.col("q0").alias("min"), "q25", F.col("q50").alias("median"), "q75",
        F.col("q100").alias("max"), (F.col("q75") - F.col("q25")).alias("iqr"),
    )


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """``(column, bin, lower, upper, center, width, count)``: equal-width bins, the last one closed.

    Values are counted into bins before the shuffle.  NaN and infinities are left out; a constant
    column gets the range value +- 0.5.
    """
    names = numeric_columns(df, columns)
    long = numeric_long(df, names).where(finite(F.col("x")))
    ends = long.groupBy("column_id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    flat = F.col("a") == F.col("b")
    edges = ends.select(
        "column_id",
        F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("start"),
        F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("stop"),
    ).withColumn("step", (F.col("stop") - F.col("start")) / float(bins))

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("stop")).otherwise(i * F.col("step") + F.col("start"))

    x, guess = F.col("x"), F.col("guess")
    placed = (
        long.join(F.broadcast(edges), "column_id")  # one row per column
        .withColumn("guess", F.least(F.floor((x - F.col("start")) / F.col("step")).cast("int"), F.lit(bins - 1)))
        # a guess next to an edge is settled by the edge itself
        .withColumn(
            "bin",
            F.when(x < edge(guess), guess - 1)
            .when((guess < bins - 1) & (x >= edge(guess + 1)), guess + 1)
            .otherwise(guess),
        )
    )
    counts = placed.groupBy("column_id", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = name_rows(df, names, edges).where(F.col("start").isNotNull()).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    i = F.col("bin")
    return grid.join(F.broadcast(counts), ["column_id", "bin"], "left").select(
        "column",
        "bin",
        edge(i).alias("lower"),
        edge(i + 1).alias("upper"),
        ((edge(i) + edge(i + 1)) / 2.0).alias("center"),
        F.col("step").alias("width"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def histogram_markers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, total_count, non_finite_count, mean, median)`` to draw on a histogram."""
    names = numeric_columns(df, columns)
    long = numeric_long(df, names)
    keep = finite(F.col("x"))
    marks = long.groupBy("column_id").agg(
        F.count_if(keep).alias("total_count"),
        F.count_if(F.col("x").isNotNull() & ~keep).alias("non_finite_count"),
        F.avg(F.when(keep, F.col("x"))).alias("mean"),
    )
    middle = long_quantiles(long.where(keep), (0.5,)).withColumnRenamed("q50", "median")
    return name_rows(df, names, marks, middle).drop("column_id")


# --- normality tests -------------------------------------------------------------------------


def with_dagostino(shape: DataFrame) -> DataFrame:
    """``shape`` with ``dp_statistic`` and ``dp_p``: K^2 of D'Agostino and Pearson, from n and moments.

    The steps are separate projections: each is used several times by the next, and Spark keeps
    such projections apart instead of repeating their expressions.
    """
    steps = [
        {"_n": f"CASE WHEN n >= {DAGOSTINO_MIN} AND sd_pop > 0 THEN double(n) END"},
        {
            # skewness: Johnson's S_U approximation
            "_y": "skewness * sqrt((_n + 1) * (_n + 3) / (6 * (_n - 2)))",
            "_b2": "3 * (_n * _n + 27 * _n - 70) * (_n + 1) * (_n + 3) / ((_n - 2) * (_n + 5) * (_n + 7) * (_n + 9))",
            # kurtosis: Anscombe and Glynn's cube-root transformation
            "_x": "(kurtosis + 3 - 3 * (_n - 1) / (_n + 1)) / "
            "sqrt(24 * _n * (_n - 2) * (_n - 3) / ((_n + 1) * (_n + 1) * (_n + 3) * (_n + 5)))",
            "_rb": "6 * (_n * _n - 5 * _n + 2) / ((_n + 7) * (_n + 9)) * "
            "sqrt(6 * (_n + 3) * (_n + 5) / (_n * (_n - 2) * (_n - 3)))",
        },
        {
            "_w2": "sqrt(2 * (_b2 - 1)) - 1",
            "_y": "CASE WHEN _y = 0 THEN 1D ELSE _y END",
            "_a": "6 + 8 / _rb * (2 / _rb + sqrt(1 + 4 / (_rb * _rb)))",
        },
        {"_ya": "_y / sqrt(2 / (_w2 - 1))", "_d": "1 + _x * sqrt(2 / (_a - 4))", "_c": "2 / (9 * _a)"},
        {
            "_z1": "ln(_ya + sqrt(_ya * _ya + 1)) / sqrt(0.5D * ln(_w2))",
            "_cube": "sign(_d) * pow(abs(try_divide(1 - 2 / _a, _d)), 1D / 3)",
        },
        {"_z2": "(1 - _c - _cube) / sqrt(_c)"},
        {"dp_statistic": "_z1 * _z1 + _z2 * _z2"},
        {"dp_p": "exp(-dp_statistic / 2)"},
    ]
    out = shape
    for step in steps:
        out = out.withColumns({name: F.expr(text) for name, text in step.items()})
    return out.drop(*{name for step in steps for name in step if name.startswith("_")})


def dagostino_pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, statistic, p_value, is_normal)``; at least eight values and some spread."""
    names = numeric_columns(df, columns)
    tested = with_dagostino(shape_ids(numeric_long(df, names)))
    return _named_tests(
        df, names, tested.select("column_id", F.col("dp_statistic").alias("statistic"), F.col("dp_p").alias("p_value"))
    )


def _named_tests(df: DataFrame, names: Sequence[str], table: DataFrame, verdict: Column | None = None) -> DataFrame:
    verdict = F.col("p_value") > ALPHA if verdict is None else verdict
    return (
        name_rows(df, names, table)
        .where(F.col("statistic").isNotNull())
        .withColumn("is_normal", verdict)
        .drop("column_id")
    )


def _ranked(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rank table and per-column shape of the numeric columns."""
    return fq.column_ranks(df, names), shape_ids(numeric_long(df, names))


def _gaps(cdf: Column) -> Column:
    """Distance of the empirical distribution function from ``cdf`` on both sides of its step."""
    return F.greatest(F.col("hi") / F.col("n") - cdf, cdf - F.col("lo") / F.col("n"))


def order_statistics(ranks: DataFrame, shape: DataFrame, parts: Sequence[str] = ("ks", "ad", "levels")) -> DataFrame:
    """What is read from the rank table, in one pass over it.

    ``ks`` gives ``ks_statistic, ks_p``; ``ad`` gives ``ad_statistic, ad_critical``; ``levels`` gives
    ``unique_count, q25, q50, q75``.
    """
    n = F.col("n").cast("double")
    joined = ranks.join(F.broadcast(shape.select("column_id", "n", "mean", "sd", "sd_pop")), "column_id")
    centred = F.col("x") - F.col("mean")
    scored, sums, out = joined, [], []
    if "ks" in parts:
        scored = with_normal_tail(scored.withColumn("z", ratio(centred, F.col("sd_pop"))), "z")
        scored = scored.withColumn("cdf", normal_cdf("z"))
        sums.append(F.max(F.when(F.col("z").isNotNull(), _gaps(F.col("cdf")))).alias("ks_statistic"))
        out += ["ks_statistic", ks_p_value("ks_statistic", n).alias("ks_p")]
    if "ad" in parts:
        # sum of (2i - 1) over the tied positions lo+1 .. hi; sample deviation
        odd = F.col("hi").cast("double") * F.col("hi") - F.col("lo").cast("double") * F.col("lo")
        rest = 2.0 * n * F.col("count") - odd
        scored = with_normal_tail(scored.withColumn("zs", ratio(centred, F.col("sd"))), "zs").withColumns(
            {"log_lower": log_normal_tail("zs"), "log_upper": log_normal_tail("zs", upper=True)}
        )
        term = odd * F.col("log_lower") + rest * F.col("log_upper")
        sums.append(F.sum(F.when(F.col("zs").isNotNull(), term)).alias("s"))
        out += [
            (-n - F.col("s") / n).alias("ad_statistic"),
            F.when(F.col("s").isNotNull(), 0.752 / (1.0 + 0.75 / n + 2.25 / (n * n))).alias("ad_critical"),
        ]
    if "levels" in parts:

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col("x")))

        sums.append(F.count(F.lit(1)).alias("unique_count"))
        out.append("unique_count")
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            position = F.lit(p) * (F.col("n") - 1)
            sums += [at(F.floor(position)).alias(f"{name}_first"), at(F.ceil(position)).alias(f"{name}_second")]
            a, b = F.col(f"{name}_first"), F.col(f"{name}_second")
            out.append((a + (b - a) * (position - F.floor(position))).alias(name))
    return scored.groupBy("column_id", "n").agg(*sums).select("column_id", *out)


def ks_normal(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, statistic, p_value, is_normal)`` against the normal with the column's mean and deviation."""
    names = numeric_columns(df, columns)
    found = order_statistics(*_ranked(df, names), parts=["ks"])
    return _named_tests(
        df, names, found.select("column_id", F.col("ks_statistic").alias("statistic"), F.col("ks_p").alias("p_value"))
    )


def anderson_darling(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, statistic, critical_value, is_normal)`` at the five percent level."""
    names = numeric_columns(df, columns)
    found = order_statistics(*_ranked(df, names), parts=["ad"])
    table = found.select(
        "column_id", F.col("ad_statistic").alias("statistic"), F.col("ad_critical").alias("critical_value")
    )
    return _named_tests(df, names, table, F.col("statistic") < F.col("critical_value"))


def shapiro_ids(ordered: DataFrame, shape: DataFrame) -> DataFrame:
    """``(column_id, statistic, p_value, extrapolated)`` for columns of at least 3 values.

    The p-value's approximation is published for up to 5000 values; beyond, ``extrapolated`` says so.  Ties are expanded in
    chunks that are dealt out to all tasks, so a very common value is not one long array in one task.
    """
    small = shape.where((F.col("n") >= 3) & (F.col("sd_pop") > 0))
    n = F.col("n").cast("double")
    ranks = fq.rank_rows(ordered.join(F.broadcast(small.select("column_id")), "column_id", "left_semi"))
    chunks = ranks.select(
        "column_id", "x", "hi", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"), F.lit(TIE_CHUNK).cast("bigint"))).alias("start")
    ).repartition("column_id", "start")
    placed = (
        chunks.join(F.broadcast(small), "column_id")
        .select("column_id", "x", "n", "sd_pop",
                F.explode(F.sequence(F.col("start"), F.least(F.col("start") + TIE_CHUNK - 1, F.col("hi")))).alias("i"))
        .withColumn("p", (F.col("i") - 0.375) / (F.col("n") + 0.25))
    )
    scored = with_normal_quantile(placed, "p", "m")

    def at(position: Column, value: str) -> Column:
        return F.max(F.when(F.col("i") == position, F.col(value)))

    sums = scored.groupBy("column_id", "n", "sd_pop").agg(
        at(F.lit(1), "m").alias("m1"),
        at(F.lit(2), "m").alias("m2"),
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.col("m") * F.col("x")).alias("mx"),
        at(F.lit(1), "x").alias("x1"),
        at(F.lit(2), "x").alias("x2"),
        at(F.col("n") - 1, "x").alias("xm"),
        at(F.col("n"), "x").alias("xn"),
    )
    test = shapiro_test(n, "m1", "m2", "mm", "mx", "x1", "x2", "xm", "xn", n * F.col("sd_pop") * F.col("sd_pop"))
    return sums.select("column_id", "n", test.alias("t")).select(
        "column_id", "t.statistic", "t.p_value", (F.col("n") > SHAPIRO_MAX).alias("extrapolated")
    )


def shapiro_wilk(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, statistic, p_value, is_normal, extrapolated)`` for columns of at least 3 values.

    ``extrapolated`` marks p-values of more than 5000 values, where the approximation is outside its published range.
    """
    names = numeric_columns(df, columns)
    ordered = fq.ordered_frequency(fq.numeric_frequency(df, names))
    found = materialize(shapiro_ids(ordered, shape_ids(numeric_long(df, names))))
    flags = name_rows(df, names, found.select("column_id", "extrapolated")).select("column", "extrapolated")
    return _named_tests(df, names, found.drop("extrapolated")).join(F.broadcast(flags), "column")


def normality_ids(df: DataFrame, names: Sequence[str], ordered: DataFrame | None = None) -> DataFrame:
    """Shape, order statistics and all four tests with the vote; tests that do not apply are null."""
    if ordered is None:
        ordered = fq.ordered_frequency(fq.numeric_frequency(df, names))
    shape = shape_ids(numeric_long(df, names))
    s = shapiro_ids(ordered, shape).select(
        "column_id", F.col("statistic").alias("sw_statistic"), F.col("p_value").alias("sw_p")
    )
    # at most one row per column on every side
    out = (
        with_dagostino(shape)
        .join(F.broadcast(order_statistics(fq.rank_rows(ordered), shape)), "column_id", "left")
        .join(F.broadcast(s), "column_id", "left")
    )
    votes = [
        F.col("sw_p") > ALPHA,
        F.col("ad_statistic") < F.col("ad_critical"),
        F.col("dp_p") > ALPHA,
        F.col("ks_p") > ALPHA,
    ]
    yes = sum((F.coalesce(v.cast("int"), F.lit(0)) for v in votes), F.lit(0))
    asked = sum((v.isNotNull().cast("int") for v in votes), F.lit(0))
    enough = F.col("n") >= 3
    return (
        out.withColumn("normal_votes", F.when(enough, yes).otherwise(0))
        .withColumn("normal_test_count", F.when(enough, asked).otherwise(0))
        .withColumn(
            "is_normal",
            (F.col("normal_test_count") > 0) & (F.col("normal_votes") * 2 >= F.col("normal_test_count")),
        )
    )


def normality_vote(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: the four tests, votes, verdict, and the reason when data is too scarce."""
    names = numeric_columns(df, columns)
    few = F.coalesce(F.col("n"), F.lit(0)) < 3
    return name_rows(df, names, normality_ids(df, names)).select(
        "column",
        *[F.col(c) for c in NORMALITY_COLUMNS],
        F.coalesce("normal_votes", F.lit(0)).alias("normal_votes"),
        F.coalesce("normal_test_count", F.lit(0)).alias("normal_test_count"),
        F.coalesce("is_normal", F.lit(False)).alias("is_normal"),
        F.when(few, "insufficient_data").alias("reason"),
    )


NORMALITY_COLUMNS = (
    "sw_statistic", "sw_p", "ad_statistic", "ad_critical", "dp_statistic", "dp_p", "ks_statistic", "ks_p"
)


def type_rules(n: Column, is_normal: Column, skew: Column, kurt: Column, unique: Column, mean: Column, sd: Column, low: Column) -> Column:
    """Distribution type; the first rule that holds."""
    cv = F.when(mean != 0, ratio(sd, mean)).otherwise(0.0)
    return (
        F.when(n < TYPE_MIN, "unknown")
        .when(is_normal, "normal")
        .when((F.abs(skew) < 0.5) & (F.abs(kurt) < 0.5), "approximately_normal")
        .when(skew > 1.0, "right_skewed")
        .when(skew < -1.0, "left_skewed")
        .when(kurt > 3, "heavy_tailed")
        .when(kurt < -1, "light_tailed")
        .when(unique < 10, "discrete")
        .when(cv < 0.1, "uniform")
        .when((low >= 0) & (skew > 0.5), "exponential")
        .otherwise("unknown")
    )


def analyze_distributions(
    df: DataFrame, columns: Sequence[str] | None = None, ordered: DataFrame | None = None
) -> DataFrame:
    """One row per numeric column: tests, vote, type, moments, quartiles, ``kde_available``.

    The frequency table is built once; two tests, distinct counts and quartiles come from one pass
    over its ranks.
    ``ordered`` is the ordered frequency table of the same columns when the caller has it.  The bins
    are a table of their own: :func:`histogram`.
    """
    names = numeric_columns(df, columns)
    n = F.col("n")
    zero = F.lit(0.0)
    table = name_rows(df, names, normality_ids(df, names, ordered)).withColumn("n", F.coalesce(n, F.lit(0)))
    kind = type_rules(
        n, F.coalesce("is_normal", F.lit(False)), F.col("skewness"), F.col("kurtosis"), F.col("unique_count"),
        F.col("mean"), F.col("sd_pop"), F.col("min"),
    )
    return table.select(
        "column",
        n.alias("count"),
        *[F.col(c) for c in NORMALITY_COLUMNS],
        F.coalesce("normal_votes", F.lit(0)).alias("normal_votes"),
        F.coalesce("normal_test_count", F.lit(0)).alias("normal_test_count"),
        F.coalesce("is_normal", F.lit(False)).alias("is_normal"),
        kind.alias("distribution_type"),
        F.coalesce("skewness", zero).alias("skewness"),
        F.coalesce("kurtosis", zero).alias("kurtosis"),
        "min", "q25", F.col("q50").alias("median"), "q75", "max",
        (F.col("q75") - F.col("q25")).alias("iqr"),
        (n > 10).alias("kde_available"),
    )


def distribution_type(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, distribution_type)``."""
    return analyze_distributions(df, columns).select("column", "distribution_type")


def distribution_summary(df: DataFrame, columns: Sequence[str] | None = None, table: DataFrame | None = None) -> DataFrame:
    """One row: number of columns and the sorted names of normal, skewed and heavy-tailed ones."""
    rows = analyze_distributions(df, columns) if table is None else table

    def names(test: Column) -> Column:  # bounded by the number of columns
        return F.array_sort(F.collect_list(F.when(test, F.col("column"))))

    return rows.agg(
        F.count(F.lit(1)).alias("total_numeric_columns"),
        names(F.col("is_normal")).alias("normal_columns"),
        names(F.abs("skewness") > 1.0).alias("skewed_columns"),
        names(F.col("kurtosis") > 3).alias("heavy_tailed_columns"),
    )


def distribution_type_counts(table: DataFrame) -> DataFrame:
    """``(distribution_type, columns)`` of an :func:`analyze_distributions` result."""
    return table.groupBy("distribution_type").agg(F.count(F.lit(1)).alias("columns"))


# --- density and fits ------------------------------------------------------------------------


def kde(df: DataFrame, columns: Sequence[str] | None = None, points: int = KDE_POINTS, binned: bool = False) -> DataFrame:
    """``(column, point, x, density)``: Gaussian kernel density with Scott's bandwidth.

    A fast Gauss transform: values meet in cells of half a bandwidth, where only their first 14 moments are
    kept, summed before the shuffle.  The Hermite expansion around a cell's centre gives its
    share at a grid point from the moments alone.  By Cramer's bound |He_m(z)| <= 1.09 exp(z^2/4) sqrt(m!), and as no
    value is more than u = 1/4 bandwidth from its centre, what is left out is below
    1.09 * u^14 / sqrt(14!) * 1.1 < 2e-14 of a kernel's height for each value: the work for a value does not
    depend on the grid, and no value is shuffled.  ``binned=True`` first rounds values to 2000 cells over
    the range.  Columns with fewer than ten values or no spread have no density.
    """
    names = numeric_columns(df, columns)
    long = numeric_long(df, names).where(F.col("x").isNotNull())
    shape = shape_ids(long).where((F.col("n") >= 10) & (F.col("sd") > 0) & finite(F.col("min")) & finite(F.col("max")))
    n = F.col("n").cast("double")
    span = F.col("max") - F.col("min")
    grid = shape.select(
        "column_id", "n", "min", "max",
        (F.col("sd") * F.pow(n, F.lit(-0.2))).alias("h"),
        (F.col("min") - KDE_PADDING * span).alias("start"),
        (span * (1 + 2 * KDE_PADDING) / float(max(points - 1, 1))).alias("step"),
    ).where(F.col("h") > 0)
    placed = long.join(F.broadcast(grid), "column_id")  # one row per column
    if binned:
        cell = span / float(KDE_CELLS)
        middle = F.least(F.floor((F.col("x") - F.col("min")) / cell), F.lit(KDE_CELLS - 1)) + 0.5
        placed = placed.withColumn("x", F.col("min") + middle * cell)
    cells = _cell_moments(placed).join(F.broadcast(grid), "column_id")
    centre = F.col("min") + (F.col("cell") + 0.5) * KDE_CELL * F.col("h")
    reach = KDE_REACH * F.col("h")
    first = F.greatest(F.ceil((centre - reach - F.col("start")) / F.col("step")), F.lit(0))
    last = F.least(F.floor((centre + reach - F.col("start")) / F.col("step")), F.lit(points - 1))
    near = cells.withColumn("point", F.explode(F.when(first <= last, F.sequence(first, last))))
    near = near.withColumn("z", (F.col("start") + F.col("point") * F.col("step") - centre) / F.col("h"))
    sums = near.groupBy("column_id", "point").agg(F.sum(_cell_share(F.col("z"))).alias("s"))
    labels = df.sparkSession.createDataFrame(list(enumerate(names)), "column_id int, column string")
    every = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return (
        every.join(F.broadcast(sums.withColumn("point", F.col("point").cast("int"))), ["column_id", "point"], "left")
        .join(F.broadcast(labels), "column_id")
        .select(
            "column", "point",
            (F.col("start") + F.col("point") * F.col("step")).alias("x"),
            (F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)) / (n * F.col("h") * math.sqrt(2 * math.pi))).alias("density"),
        )
    )


def _cell_moments(placed: DataFrame) -> DataFrame:
    """``(column_id, cell, m0 .. m13)``: sums of powers of the distance to the cell's centre, in bandwidths."""
    from_start = (F.col("x") - F.col("min")) / F.col("h")
    celled = placed.select("column_id", from_start.alias("v"), F.floor(from_start / KDE_CELL).alias("cell"))
    powers = [F.lit(1.0), F.col("v") - (F.col("cell") + 0.5) * KDE_CELL]
    for m in range(2, KDE_TERMS):
        powers.append(powers[m // 2] * powers[m - m // 2])
    return celled.groupBy("column_id", "cell").agg(*[F.sum(power).alias(f"m{m}") for m, power in enumerate(powers)])


def _cell_share(z: Column) -> Column:
    """Kernel sum of a cell at ``z`` bandwidths from its centre: exp(-z^2/2) times the sum of m_k He_k(z) / k!, by powers of z."""
    total = F.lit(0.0)
    for p in reversed(range(KDE_TERMS)):
        parts = [
            F.col(f"m{p + 2 * j}") * ((-1) ** j / (2**j * math.factorial(j) * math.factorial(p)))
            for j in range((KDE_TERMS - 1 - p) // 2 + 1)
        ]
        total = total * z + sum(parts[1:], parts[0])
    return total * F.exp(-0.5 * z * z)


# Trial locations of the first pass, in deviations below the smallest value, and the most Newton steps after it.
GAMMA_TRIALS = [10.0 ** (-6 + 8.5 * i / 11) for i in range(12)]
GAMMA_STEPS = 25


def gamma_fits(long: DataFrame, base: DataFrame) -> DataFrame:
    """``(column_id, n, shape, location, scale)``: gamma distributions of largest likelihood.

    Shape and scale have a closed condition once the location is known, so the likelihood is a function of the
    location alone.  Its value and slope need three means over the column (of log, inverse and squared inverse
    distance to the location): one pass tries twelve locations, Newton steps between the neighbours of
    the best one follow, one pass each, for all columns at once.  One row per column reaches the driver.
    Below shape one the likelihood grows without bound towards the smallest value, so a free location needs a shape of at
    least one; compared with it are its limit, the exponential distribution from the smallest value on, and for
    positive values the fit with location zero, of any shape.  Locations further than 316 deviations below the
    smallest value are not tried (the distribution is normal by then).
    """
    spark = long.sparkSession
    usable = base.where(finite(F.col("min")) & finite(F.col("max")) & (F.col("sd_pop") > 0))
    rows = usable.select("column_id", "n", "mean", "min", "sd_pop").collect()  # one row per column
    profiles = {r.column_id: GammaProfile(r.mean, r.min, r.sd_pop) for r in rows}
    if rows:
        shifts = spark.createDataFrame([(r.column_id, r.min, r.sd_pop) for r in rows], "column_id int, low double, unit double")
        y = (F.col("x") - F.col("low")) / F.col("unit")
        scaled = long.where(F.col("x").isNotNull()).join(F.broadcast(shifts), "column_id")
        scaled = scaled.select("column_id", y.alias("y"), F.when(F.col("low") > 0, F.log("x")).alias("log_x"))
        sums = [F.avg(F.log(F.col("y") + t)).alias(f"t{i}") for i, t in enumerate(GAMMA_TRIALS)]
        for r in scaled.groupBy("column_id").agg(F.avg("log_x").alias("log_x"), *sums).collect():
            profiles[r.column_id].start(GAMMA_TRIALS, [r[f"t{i}"] for i in range(len(GAMMA_TRIALS))], r.log_x)
        for _ in range(GAMMA_STEPS):
            trials = [(i, p.trial) for i, p in profiles.items() if p.trial is not None]
            if not trials:
                break
            distance = F.col("y") + F.col("trial")
            tried = scaled.join(F.broadcast(spark.createDataFrame(trials, "column_id int, trial double")), "column_id")
            means = tried.groupBy("column_id").agg(
                F.avg(F.log(distance)).alias("log"), F.avg(1.0 / distance).alias("inverse"), F.avg(1.0 / (distance * distance)).alias("square")
            )
            for r in means.collect():
                profiles[r.column_id].step(r["log"], r["inverse"], r["square"])
    fits = [(r.column_id, r.n, *profiles[r.column_id].best()) for r in rows]
    return spark.createDataFrame(fits, "column_id int, n bigint, shape double, location double, scale double")


FIT_SCHEMA = (
    "column string, distribution string, shape double, location double, scale double, ks_statistic double, "
    "ks_p_value double, goodness_of_fit string"
)


def fit_distribution(df: DataFrame, columns: Sequence[str] | None = None, name: str = "norm") -> DataFrame:
    """Maximum-likelihood fit and its Kolmogorov-Smirnov test, one row per column with ten values.

    norm: mean and population deviation; expon: minimum and mean above it; uniform: range;
    gamma: shape, location and scale by :func:`gamma_fits`.
    """
    if name not in DISTRIBUTIONS:
        return df.sparkSession.createDataFrame([], FIT_SCHEMA)
    names = numeric_columns(df, columns)
    long = numeric_long(df, names)
    null = F.lit(None).cast("double")
    base = shape_ids(long).where(F.col("n") >= 10)
    x = F.col("x")
    if name == "norm":
        fits = base.select("column_id", "n", null.alias("shape"), F.col("mean").alias("location"), F.col("sd_pop").alias("scale"))
        cdf = normal_cdf("z")
    elif name == "expon":
        fits = base.select(
            "column_id", "n", null.alias("shape"), F.col("min").alias("location"), (F.col("mean") - F.col("min")).alias("scale")
        )
        cdf = 1.0 - F.exp(-F.col("z"))
    elif name == "uniform":
        fits = base.select(
            "column_id", "n", null.alias("shape"), F.col("min").alias("location"), (F.col("max") - F.col("min")).alias("scale")
        )
        cdf = F.col("z")
    else:
        fits = gamma_fits(long, base)
        cdf = gamma_cdf(x - F.col("location"), "shape", "scale")
    fits = fits.where(F.col("scale") > 0)
    joined = fq.column_ranks(df, names).join(F.broadcast(fits), "column_id")  # one row per column
    joined = with_normal_tail(joined.withColumn("z", (x - F.col("location")) / F.col("scale")), "z")
    gaps = (
        joined.withColumn("cdf", cdf)
        .groupBy("column_id", "n")
        .agg(F.max(_gaps(F.col("cdf"))).alias("d"))
        .select("column_id", "d", ks_p_value("d", F.col("n").cast("double")).alias("p"))
    )
    return (
        name_rows(df, names, fits, gaps)
        .where(F.col("d").isNotNull())
        .select(
            "column",
            F.lit(name).alias("distribution"),
            "shape", "location", "scale",
            F.col("d").alias("ks_statistic"),
            F.col("p").alias("ks_p_value"),
            F.when(F.col("p") > ALPHA, "good").otherwise("poor").alias("goodness_of_fit"),
        )
    )
