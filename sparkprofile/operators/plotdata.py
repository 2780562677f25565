"""The tables behind the charts: box, QQ, scatter, fit line, pair grid, bars, heat maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, col, name_rows, numeric_columns, numeric_long, percent, select_columns
from ..functions.normal import normal_quantile
from . import frequency as fq
from .distributions import finite, kde, quartiles
from .outliers import IQR_FACTOR
from .quantiles import wide_quantiles
from .sampling import uniform_sample

# Sample sizes of the plots, bars shown.
SCATTER_ROWS = 100_000
PAIR_ROWS = 5_000
HEATMAP_ROWS = 500
BARS = 20
QQ_CHUNK = 1_000_000


def box_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, q25, median, q75, mean, whisker_low, whisker_high, flier_count)``.

    Whiskers end at the last value within 1.5 interquartile ranges of the box.
    """
    names = numeric_columns(df, columns)
    long = numeric_long(df, names)
    levels = wide_quantiles(df, names, (0.25, 0.5, 0.75))
    reach = IQR_FACTOR * (F.col("q75") - F.col("q25"))
    x = F.col("x")
    inside = x.between(F.col("q25") - reach, F.col("q75") + reach)
    ends = (
        long.where(x.isNotNull())
        .join(F.broadcast(levels), "column_id")  # one row per column
        .groupBy("column_id")
        .agg(
            F.avg("x").alias("mean"),
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.count_if(~inside).alias("flier_count"),
        )
    )
    return name_rows(df, names, levels, ends).select(
        "column", "q25", F.col("q50").alias("median"), "q75", "mean", "whisker_low", "whisker_high",
        F.coalesce("flier_count", F.lit(0).cast("bigint")).alias("flier_count"),
    )


def violin_stats(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Density and quartiles of each column."""
    return {"density": kde(df, columns), "quartiles": quartiles(df, columns)}


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """``(position, theoretical, sample)`` of the normal probability plot: one point per value.

    Ties are expanded from the rank table in two steps: a value becomes its chunks of at most a
    million positions, chunks are dealt out to all tasks, and there become points.  A value held by
    a large part of the table is never one long array in one task.
    """
    ranks = fq.column_ranks(df, [column]).where(finite(F.col("x")))
    n = F.max("hi").alias("n")
    total = ranks.agg(n).select("n", F.lit(0).alias("column_id"))
    starts = ranks.select(
        "column_id", "x", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(QQ_CHUNK).cast("bigint"))).alias("start")
    )
    last = F.least(F.col("start") + QQ_CHUNK, F.col("hi")) - 1
    points = starts.repartition("start").select(
        "column_id", "x", F.explode(F.sequence(F.col("start"), last)).alias("at")
    ).join(F.broadcast(total), "column_id")  # one row
    size, i = F.col("n").cast("double"), F.col("at") + 1
    top = F.pow(F.lit(0.5), F.lit(1.0) / size)
    uniform = F.when(i == F.col("n"), top).when(i == 1, 1.0 - top).otherwise((i - 0.3175) / (size + 0.365))
    placed = points.select(i.alias("position"), uniform.alias("p"), F.col("x").alias("sample"))
    return placed.select("position", normal_quantile("p").alias("theoretical"), "sample")


def qq_line(points: DataFrame) -> DataFrame:
    """``(slope, intercept, r)`` of the line through the points of :func:`qq_points`."""
    spread = F.stddev_pop("sample") * F.stddev_pop("theoretical")
    return points.agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        F.try_divide(F.covar_pop("sample", "theoretical"), spread).alias("r"),
    )


def scatter_points(
    df: DataFrame, x: str, y: str, hue: str | None = None, n: int = SCATTER_ROWS, keys: Sequence[str] | None = None
) -> DataFrame:
    """At most n sampled ``(x, y, hue)`` points of the rows where both axes are present."""
    rows = uniform_sample(df.dropna(subset=[x, y]), n, keys)
    return rows.select(
        as_double(x).alias("x"), as_double(y).alias("y"), *([col(hue).alias("hue")] if hue else [])
    )


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(slope, intercept, r2, n)`` of y on x over the rows where both are present."""
    a, b = as_double(x), as_double(y)
    # the squared coefficient: null when either side is constant
    spread = F.var_pop(F.when(b.isNotNull(), a)) * F.var_pop(F.when(a.isNotNull(), b))
    covariance = F.covar_pop(a, b)
    return df.agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.try_divide(covariance * covariance, spread).alias("r2"),
        F.regr_count(b, a).alias("n"),
    )


def pair_grid(
    df: DataFrame, columns: Sequence[str], hue: str | None = None, n: int = PAIR_ROWS, keys: Sequence[str] | None = None
) -> DataFrame:
    """At most n sampled rows of the chosen columns and the hue."""
    chosen = [*columns, *([hue] if hue and hue not in columns else [])]
    return uniform_sample(df, n, keys).select(*[col(c) for c in chosen])


def categorical_bar(df: DataFrame, column: str, n: int = BARS) -> DataFrame:
    """``(rank, value, count, percentage)`` of the n most frequent values."""
    counts = fq.text_frequency(df, [column])
    total = counts.groupBy("column_id").agg(F.sum("count").alias("total"))
    return (
        fq.top_k(counts, "value", n)
        .join(F.broadcast(total), "column_id")  # one row
        .select("rank", "value", "count", percent(F.col("count"), F.col("total")).alias("percentage"))
    )


def missing_heatmap(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = HEATMAP_ROWS, keys: Sequence[str] | None = None
) -> DataFrame:
    """Null flags of n sampled rows."""
    names = select_columns(df, columns)
    return uniform_sample(df, n, keys).select(*[col(c).isNull().alias(c) for c in names])
