"""Univariate outliers by quartile fences, z-score and median absolute deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import as_double, band, name_rows, numeric_columns, numeric_long, percent
from .quantiles import Selection

# Thresholds, scale constant, severity bands, length of the value list.
IQR_FACTOR = 1.5
ZSCORE_THRESHOLD = 3.0
MAD_THRESHOLD = 3.5
MAD_SCALE = 0.6745
OUTLIER_BANDS = [(20, "critical"), (10, "high"), (5, "medium")]
MAX_VALUES = 100
METHODS = ("iqr", "zscore", "mad")


def outlier_bounds(df: DataFrame, names: Sequence[str], methods: Sequence[str] = METHODS) -> DataFrame:
    """``(column_id, lower, upper, mean, std, median, mad)``: all a row needs to be judged.

    One row per numeric column; quartiles, median deviation and moments share two passes over the
    data, and nothing is sorted.
    """
    found = Selection(
        numeric_long(df, names), (0.25, 0.5, 0.75), deviation="mad" in methods, moments="zscore" in methods
    )
    rows = []
    for i in range(len(names)):
        if i not in found.values:
            rows.append((i, None, None, None, None, None, None))
            continue
        q25, median, q75 = found.values[i]
        reach = IQR_FACTOR * (q75 - q25)
        facts = found.facts[i].asDict()
        rows.append((i, q25 - reach, q75 + reach, facts.get("mean"), facts.get("std"), median, found.deviations.get(i)))
    return df.sparkSession.createDataFrame(
        rows, "column_id int, lower double, upper double, mean double, std double, median double, mad double"
    )


def outlier_tests(
    x: Column,
    zscore_threshold: float = ZSCORE_THRESHOLD,
    mad_threshold: float = MAD_THRESHOLD,
    methods: Sequence[str] = METHODS,
) -> dict[str, Column]:
    """Flags of a value against the bounds in its row; no spread means no outlier."""
    tests = {
        "iqr": (x < F.col("lower")) | (x > F.col("upper")),
        "zscore": (F.col("std") != 0) & (F.abs(F.try_divide(x - F.col("mean"), F.col("std"))) > zscore_threshold),
        "mad": (F.col("mad") != 0)
        & (F.try_divide(MAD_SCALE * F.abs(x - F.col("median")), F.col("mad")) > mad_threshold),
    }
    return {m: F.coalesce(t, F.lit(False)) if m in methods else F.lit(False) for m, t in tests.items()}


def flagged_long(
    df: DataFrame,
    names: Sequence[str],
    zscore_threshold: float = ZSCORE_THRESHOLD,
    mad_threshold: float = MAD_THRESHOLD,
    methods: Sequence[str] = METHODS,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Long form of the non-null values with their bounds and flags ``is_iqr, is_zscore, is_mad``."""
    bounds = outlier_bounds(df, names, methods) if bounds is None else bounds
    tests = outlier_tests(F.col("x"), zscore_threshold, mad_threshold, methods)
    return (
        numeric_long(df, names)
        .where(F.col("x").isNotNull())
        .join(F.broadcast(bounds), "column_id")  # one row per column
        .select("column_id", "x", "lower", "upper", "median", "mad", "mean", "std",
                *[t.alias(f"is_{m}") for m, t in tests.items()])
    )


def detect_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    zscore_threshold: float = ZSCORE_THRESHOLD,
    mad_threshold: float = MAD_THRESHOLD,
    method: str = "all",
) -> DataFrame:
    """One row per numeric column: exact counts per method, bounds, share of values flagged by any."""
    methods = _methods(method)
    names = numeric_columns(df, columns)
    if not names:
        return df.sparkSession.createDataFrame([], OUTLIER_SCHEMA)
    bounds = outlier_bounds(df, names, methods)
    flags = flagged_long(df, names, zscore_threshold, mad_threshold, methods, bounds)
    counts = flags.groupBy("column_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if("is_iqr").alias("iqr_outlier_count"),
        F.count_if("is_zscore").alias("zscore_outlier_count"),
        F.count_if("is_mad").alias("mad_outlier_count"),
        F.count_if(F.col("is_iqr") | F.col("is_zscore") | F.col("is_mad")).alias("any_outlier_count"),
        # constant within the group
        F.max("lower").alias("iqr_lower_bound"),
        F.max("upper").alias("iqr_upper_bound"),
    )
    zero = F.lit(0).cast("bigint")
    out = name_rows(df, names, counts).select(
        "column",
        *[
            F.coalesce(F.col(c), zero).alias(c)
            for c in ("total_count", "iqr_outlier_count", "zscore_outlier_count", "mad_outlier_count", "any_outlier_count")
        ],
        F.coalesce("iqr_lower_bound", F.lit(0.0)).alias("iqr_lower_bound"),
        F.coalesce("iqr_upper_bound", F.lit(0.0)).alias("iqr_upper_bound"),
        F.lit(float(zscore_threshold)).alias("zscore_threshold"),
        F.lit(float(mad_threshold)).alias("mad_threshold"),
    )
    out = out.withColumn("outlier_percentage", percent(F.col("any_outlier_count"), F.col("total_count")))
    return out.withColumn("severity", band(F.col("outlier_percentage"), OUTLIER_BANDS, "low"))


OUTLIER_SCHEMA = (
    "column string, total_count bigint, iqr_outlier_count bigint, zscore_outlier_count bigint, "
    "mad_outlier_count bigint, any_outlier_count bigint, iqr_lower_bound double, iqr_upper_bound double, "
    "zscore_threshold double, mad_threshold double, outlier_percentage double, severity string"
)


def _methods(method: str) -> tuple[str, ...]:
    if method == "all":
        return METHODS
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)} or all")
    return (method,)


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, lower_bound, upper_bound, outlier_count)`` by the quartile fences."""
    return detect_outliers(df, columns, method="iqr").select(
        "column",
        F.col("iqr_lower_bound").alias("lower_bound"),
        F.col("iqr_upper_bound").alias("upper_bound"),
        F.col("iqr_outlier_count").alias("outlier_count"),
    )


def zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = ZSCORE_THRESHOLD) -> DataFrame:
    """``(column, mean, std, outlier_count)``: two passes, one for the moments and one for the flags."""
    names = numeric_columns(df, columns)
    long = numeric_long(df, names)
    moments = long.groupBy("column_id").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    far = F.abs(F.try_divide(F.col("x") - F.col("mean"), F.col("std"))) > threshold
    counts = (
        long.join(F.broadcast(moments), "column_id")
        .groupBy("column_id")
        .agg(
            F.max("mean").alias("mean"), F.max("std").alias("std"),
            F.count_if((F.col("std") != 0) & far).alias("outlier_count"),
        )
    )
    return name_rows(df, names, counts).drop("column_id")


def mad_outliers(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = MAD_THRESHOLD) -> DataFrame:
    """``(column, median, mad, outlier_count)``."""
    names = numeric_columns(df, columns)
    flags = flagged_long(df, names, mad_threshold=threshold, methods=("mad",))
    counts = flags.groupBy("column_id").agg(
        F.max("median").alias("median"), F.max("mad").alias("mad"), F.count_if("is_mad").alias("outlier_count")
    )
    return name_rows(df, names, counts).drop("column_id")


def flag_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "all",
    zscore_threshold: float = ZSCORE_THRESHOLD,
    mad_threshold: float = MAD_THRESHOLD,
) -> DataFrame:
    """The input rows with ``<column>_is_iqr``, ``_is_zscore`` and ``_is_mad`` flags.

    The bounds (a handful of numbers per column) become literals, so flagging is a projection in
    the scan stage: no join, no shuffle.  Null cells are never outliers.
    """
    methods = _methods(method)
    names = numeric_columns(df, columns)
    if not names:
        return df
    bounds = {r.column_id: r for r in outlier_bounds(df, names, methods).collect()}  # one row per column
    flags = []
    for i, c in enumerate(names):
        b, x = bounds[i], as_double(c)
        if "iqr" in methods:
            test = (x < b.lower) | (x > b.upper) if b.lower is not None else F.lit(False)
            flags.append(F.coalesce(test, F.lit(False)).alias(f"{c}_is_iqr"))
        if "zscore" in methods:
            test = F.abs((x - b.mean) / b.std) > zscore_threshold if b.std else F.lit(False)
            flags.append(F.coalesce(test, F.lit(False)).alias(f"{c}_is_zscore"))
        if "mad" in methods:
            test = MAD_SCALE * F.abs(x - b.median) / b.mad > mad_threshold if b.mad else F.lit(False)
            flags.append(F.coalesce(test, F.lit(False)).alias(f"{c}_is_mad"))
    return df.select("*", *flags)


def outlier_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = MAX_VALUES) -> DataFrame:
    """``(column, position, value)``: the n largest values flagged by any method, per column."""
    names = numeric_columns(df, columns)
    any_flag = F.col("is_iqr") | F.col("is_zscore") | F.col("is_mad")
    order = W.partitionBy("column_id").orderBy(F.desc("x"))
    labels = df.sparkSession.createDataFrame(list(enumerate(names)), "column_id int, column string")
    return (
        flagged_long(df, names)
        .where(any_flag)
        .select("column_id", "x")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= n)
        .join(F.broadcast(labels), "column_id")
        .select("column", "position", F.col("x").alias("value"))
    )


def outlier_summary(df: DataFrame, columns: Sequence[str] | None = None, outliers: DataFrame | None = None) -> DataFrame:
    """One row: columns with outliers by fences or z-score, all detections, columns above five percent."""
    table = detect_outliers(df, columns) if outliers is None else outliers
    found = (F.col("iqr_outlier_count") > 0) | (F.col("zscore_outlier_count") > 0)
    high = F.struct((-F.col("outlier_percentage")).alias("order"), "column", "outlier_percentage")
    return table.agg(
        F.count(F.lit(1)).alias("total_numeric_columns"),
        F.count_if(found).alias("columns_with_outliers_count"),
        F.coalesce(F.sum("any_outlier_count"), F.lit(0)).cast("bigint").alias("total_outlier_detections"),
        # bounded by the number of columns
        F.array_sort(F.collect_list(F.when(found, F.col("column")))).alias("columns_with_outliers"),
        F.array_sort(F.collect_list(F.when(F.col("outlier_percentage") > 5, high))).alias("high"),
    ).select(
        "total_numeric_columns", "columns_with_outliers_count", "total_outlier_detections", "columns_with_outliers",
        F.col("high.column").alias("high_outlier_columns"),
    )


def outliers_for_column(df: DataFrame, column: str) -> DataFrame:
    """``(method, count, percentage, lower_bound, upper_bound, threshold)`` of one numeric column."""
    if column not in df.columns:
        raise ValueError(f"column {column} not found")
    if not numeric_columns(df, [column]):
        raise ValueError(f"column {column} is not numeric")
    row = detect_outliers(df, [column])
    null = F.lit(None).cast("double")
    cells = [
        ("iqr", "iqr_outlier_count", F.col("iqr_lower_bound"), F.col("iqr_upper_bound"), null),
        ("zscore", "zscore_outlier_count", null, null, F.col("zscore_threshold")),
        ("mad", "mad_outlier_count", null, null, F.col("mad_threshold")),
    ]
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("method"),
                        F.col(c).alias("count"),
                        percent(F.col(c), F.col("total_count")).alias("percentage"),
                        lo.alias("lower_bound"), hi.alias("upper_bound"), t.alias("threshold"),
                    )
                    for m, c, lo, hi, t in cells
                ]
            )
        )
    )
