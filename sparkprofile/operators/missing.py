"""Missing values: per column, per row pattern, and the correlation between gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import band, col, percent, ratio, select_columns, stack
from .statistics import value_counts_summary

# Limits of the severity bands and the missing-summary buckets.
MISSING_BANDS = [(50, "critical"), (20, "high"), (5, "medium")]
MISSING_BUCKETS = [(50, "high"), (10, "medium"), (0, "low")]
MAX_PATTERNS = 20
MATRIX_ROWS = 1000
MAR_LIMIT = 0.5


def missing_columns(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """``(column, missing_count, present_count, missing_percentage, total_count, severity)``."""
    table = value_counts_summary(df, select_columns(df, columns))
    total = F.col("count") + F.col("null_count")
    out = table.select(
        "column",
        F.col("null_count").alias("missing_count"),
        F.col("count").alias("present_count"),
        percent(F.col("null_count"), total).alias("missing_percentage"),
        total.alias("total_count"),
    ).withColumn("severity", band(F.col("missing_percentage"), MISSING_BANDS, "low"))
    return out.where(F.col("missing_percentage") >= threshold) if threshold > 0 else out


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None, n: int = MAX_PATTERNS) -> DataFrame:
    """``(columns, count, percentage)``: the n most frequent sets of columns missing together.

    Complete rows are dropped in the scan and the others combined by pattern before the shuffle; the
    row total is a count of its own, which columnar files answer from their footers.
    """
    names = select_columns(df, columns)
    pattern = F.array_compact(F.array(*[F.when(col(c).isNull(), F.lit(c)) for c in names]))
    counts = df.groupBy(pattern.alias("columns")).agg(F.count(F.lit(1)).alias("count"))
    best = counts.where(F.size("columns") > 0).orderBy(F.desc("count"), F.array_join("columns", ",")).limit(n)
    return best.select("columns", "count", percent(F.col("count"), row_total(df)).alias("percentage"))


def row_total(df: DataFrame) -> Column:
    """Rows of the table, as a scalar subquery."""
    return df.select(F.count(F.lit(1))).scalar()


def missing_matrix(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
    n: int = MATRIX_ROWS,
) -> DataFrame:
    """Null flags of the first n rows, one boolean column per input column."""
    names = select_columns(df, columns)
    head = df.orderBy(*[col(c) for c in order_by]).limit(n) if order_by else df.limit(n)
    return head.select(*[col(c).isNull().alias(c) for c in names])


def all_present(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNotNull() for c in names], F.lit(True))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``total_rows, complete_rows, incomplete_rows, complete_rows_percentage``."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(all_present(select_columns(df, columns))).alias("complete_rows"),
    )
    return counts.select(
        "total_rows", "complete_rows",
        (F.col("total_rows") - F.col("complete_rows")).alias("incomplete_rows"),
        percent(F.col("complete_rows"), F.col("total_rows")).alias("complete_rows_percentage"),
    )


def missing_totals(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of table-wide totals, from a single aggregation."""
    names = select_columns(df, columns)
    gaps = [F.count(F.lit(1)) - F.count(col(c)) for c in names]
    one = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(all_present(names)).alias("complete_rows"),
        *[g.alias(f"g{i}") for i, g in enumerate(gaps)],
    )
    missing = reduce(lambda a, b: a + b, [F.col(f"g{i}") for i in range(len(names))], F.lit(0).cast("bigint"))
    with_missing = reduce(
        lambda a, b: a + b, [(F.col(f"g{i}") > 0).cast("bigint") for i in range(len(names))], F.lit(0).cast("bigint")
    )
    out = one.select(
        "total_rows",
        F.lit(len(names)).cast("bigint").alias("columns_count"),
        missing.alias("total_missing_values"),
        (F.col("total_rows") * len(names)).alias("total_cells"),
        with_missing.alias("columns_with_missing"),
        "complete_rows",
        (F.col("total_rows") - F.col("complete_rows")).alias("incomplete_rows"),
    )
    return out.select(
        "*",
        percent(F.col("total_missing_values"), F.col("total_cells")).alias("overall_missing_percentage"),
        percent(F.col("complete_rows"), F.col("total_rows")).alias("complete_rows_percentage"),
    )


def analyze_missing(df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Totals, per-column rows, patterns and the null matrix of the first rows."""
    return {
        "totals": missing_totals(df, columns),
        "columns": missing_columns(df, columns),
        "patterns": missing_patterns(df, columns),
        "matrix": missing_matrix(df, columns, order_by),
    }


def missing_buckets(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, missing_percentage, bucket)`` of the columns with gaps, most missing first."""
    table = missing_columns(df, columns).where(F.col("missing_count") > 0)
    bucket = band(F.col("missing_percentage"), MISSING_BUCKETS, "none", strict=True)
    return table.select("column", "missing_percentage", bucket.alias("bucket")).orderBy(
        F.desc("missing_percentage"), "column"
    )


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Totals, bucketed columns and the five most frequent patterns."""
    return {
        "totals": missing_totals(df, columns).select(
            "overall_missing_percentage", "complete_rows_percentage", "columns_with_missing"
        ),
        "buckets": missing_buckets(df, columns),
        "top_patterns": missing_patterns(df, columns, 5),
    }


def missing_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, correlation)`` between the gaps of ``target`` and those of every other column.

    Indicators are 0/1, so four counts per column give Pearson's coefficient; columns without
    gaps or without values have none and are left out.
    """
    if target not in df.columns:
        return df.sparkSession.createDataFrame([], "column string, correlation double")
    names = [c for c in select_columns(df, columns) if c != target]
    gap = col(target).isNull()
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gap).alias("t"),
        *[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(names)],
        *[F.count_if(col(c).isNull() & gap).alias(f"b{i}") for i, c in enumerate(names)],
    )
    rows = stack(
        counts,
        [[F.lit(c), F.col("n"), F.col("t"), F.col(f"c{i}"), F.col(f"b{i}")] for i, c in enumerate(names)],
        "column string, n bigint, t bigint, c bigint, b bigint",
    )
    n, t, c, b = (F.col(k).cast("double") for k in ("n", "t", "c", "b"))
    spread = F.sqrt((t / n) * (1 - t / n)) * F.sqrt((c / n) * (1 - c / n))
    defined = (F.col("t") > 0) & (F.col("t") < F.col("n")) & (F.col("c") > 0) & (F.col("c") < F.col("n"))
    return rows.where(defined).select(
        "column", ratio(b / n - (t / n) * (c / n), spread).alias("correlation")
    )


def gap_pairs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(a, b, both)``: rows in which columns number a and b are missing together (a = b: missing).

    Rows are combined by null pattern first, so pairs are formed per pattern, not per row, and the
    table is read once however many columns it has.
    """
    pattern = F.array_compact(F.array(*[F.when(col(c).isNull(), F.lit(i)) for i, c in enumerate(names)]))
    patterns = df.groupBy(pattern.alias("gaps")).agg(F.count(F.lit(1)).alias("count"))
    first = patterns.select("gaps", "count", F.explode("gaps").alias("a"))
    return (
        first.select("a", "count", F.explode("gaps").alias("b"))
        .groupBy("a", "b")
        .agg(F.sum("count").alias("both"))
    )


def missing_type(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, missing_type)``: no_missing, all_missing, mar, mcar, or unknown for absent names."""
    asked = list(columns) if columns is not None else list(df.columns)
    names = list(df.columns)
    spark = df.sparkSession
    pairs = gap_pairs(df, names)
    alone = pairs.where(F.col("a") == F.col("b")).select("a", F.col("both").alias("gaps"))
    wanted = spark.createDataFrame(
        [(c, names.index(c) if c in names else None) for c in asked], "column string, a int"
    )
    # every relation below has at most (number of columns)^2 rows
    ids = spark.createDataFrame([(i, list(range(len(names)))) for i in range(len(names))], "a int, b array<int>")
    other = alone.select(F.col("a").alias("b"), F.col("gaps").alias("gaps_b"))
    strongest = (
        ids.select("a", F.explode("b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .join(F.broadcast(alone), "a")
        .join(F.broadcast(other), "b")
        .join(F.broadcast(pairs), ["a", "b"], "left")
        .select("a", "gaps", "gaps_b", F.coalesce("both", F.lit(0)).alias("both"), row_total(df).alias("n"))
    )
    s, t, b = (ratio(F.col(c), F.col("n")) for c in ("gaps", "gaps_b", "both"))
    r = ratio(b - s * t, F.sqrt(s * (1 - s)) * F.sqrt(t * (1 - t)), 0.0)
    strongest = strongest.groupBy("a").agg(F.max(F.abs(r)).alias("r"))
    return (
        wanted.join(F.broadcast(alone), "a", "left")
        .join(F.broadcast(strongest), "a", "left")
        .withColumn("n", row_total(df))
        .select(
            "column",
            F.when(F.col("a").isNull(), "unknown")
            .when(F.coalesce("gaps", F.lit(0)) == 0, "no_missing")
            .when(F.col("gaps") == F.col("n"), "all_missing")
            .when(F.col("r") > MAR_LIMIT, "mar")
            .otherwise("mcar")
            .alias("missing_type"),
        )
    )


def missing_heatmap_data(
    df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None, n: int = MATRIX_ROWS
) -> dict[str, DataFrame]:
    """The null matrix with the percentage of every column."""
    return {
        "matrix": missing_matrix(df, columns, order_by, n),
        "columns": missing_columns(df, columns).select("column", "missing_percentage"),
    }
