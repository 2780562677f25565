"""Data quality: score, duplicates, alerts, quick summary."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import band, col, percent, select_columns, stack
from .frequency import value_text
from .missing import missing_columns, missing_totals
from .outliers import detect_outliers
from .schema import detect_schema

# Weights, rating limits, penalty per suspicious column name, alert limits.
WEIGHTS = {"completeness": 0.4, "outliers": 0.4, "schema": 0.2}
RATINGS = [(90, "excellent"), (75, "good"), (60, "fair")]
NAME_PENALTY = 10
MISSING_WARNING = 5
MISSING_CRITICAL = 20
LOW_SCORE = 70
MOSTLY_MISSING = 50


def unnamed_columns(names: Sequence[str]) -> list[str]:
    """Names a reader made up: ``column_...`` or ``_c<number>``."""
    return [c for c in names if c.startswith("column_") or re.fullmatch(r"_c\d+", c)]


def duplicate_names(names: Sequence[str]) -> list[str]:
    return sorted({c for c in names if list(names).count(c) > 1})


def quality_score(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
    outliers: DataFrame | None = None,
) -> DataFrame:
    """One row: overall score, rating, the three parts and the issues behind them.

    ``names`` are the column names as read, when the profile had to rename duplicates.
    """
    header = list(names) if names is not None else select_columns(df, columns)
    repeated = len(header) - len(set(header))
    unnamed = len(unnamed_columns(header))
    totals = missing_totals(df, columns)
    flags = detect_outliers(df, columns) if outliers is None else outliers
    share = flags.select(F.coalesce(F.avg("outlier_percentage"), F.lit(0.0))).scalar()
    one = totals.withColumn("average_outlier_percentage", share)
    schema_score = float(max(0, 100 - NAME_PENALTY * (repeated + unnamed)))
    complete = F.when(F.col("total_rows") == 0, F.lit(0.0)).otherwise(F.col("complete_rows_percentage"))
    outlier_score = F.greatest(F.lit(0.0), 100.0 - F.col("average_outlier_percentage"))
    overall = (
        WEIGHTS["completeness"] * complete + WEIGHTS["outliers"] * outlier_score + WEIGHTS["schema"] * schema_score
    )
    return one.select(
        overall.alias("overall_score"),
        band(overall, RATINGS, "poor").alias("quality_rating"),
        complete.alias("completeness_score"),
        outlier_score.alias("outlier_score"),
        F.lit(schema_score).alias("schema_score"),
        F.col("overall_missing_percentage").alias("missing_percentage"),
        "average_outlier_percentage",
        F.lit(repeated).alias("duplicate_columns"),
        F.lit(unnamed).alias("unnamed_columns"),
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``total_rows, distinct_rows, duplicate_rows, duplicate_percentage``.

    Rows are grouped by a 128-bit digest of all cells, so 16 bytes per distinct row are shuffled,
    after equal rows were combined in their partition.
    """
    names = select_columns(df, columns)
    cells = []
    for c in names:
        kind = df.schema[c].dataType
        value = col(c)
        if isinstance(kind, T.MapType):
            value = value_text(df, c)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0)
        cells += [value, value.isNull()]
    digest = [F.xxhash64(*cells).alias("h1"), F.xxhash64(F.lit(20011), *cells).alias("h2")]
    counts = df.groupBy(*digest).agg(F.count(F.lit(1)).alias("copies"))
    return counts.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
    ).select(
        "total_rows", "distinct_rows",
        (F.col("total_rows") - F.col("distinct_rows")).alias("duplicate_rows"),
        percent(F.col("total_rows") - F.col("distinct_rows"), F.col("total_rows")).alias("duplicate_percentage"),
    )


def alerts(df: DataFrame, columns: Sequence[str] | None = None, score: DataFrame | None = None) -> DataFrame:
    """``(level, alert, value)`` for what needs attention: gaps, duplicates, low score."""
    score = quality_score(df, columns) if score is None else score
    empty = missing_columns(df, columns).select(F.count_if(F.col("missing_percentage") > MOSTLY_MISSING))
    facts = score.select("overall_score", "missing_percentage").withColumns(
        {"duplicate_rows": duplicate_rows(df, columns).select("duplicate_rows").scalar(), "mostly_missing": empty.scalar()}
    )
    missing = F.col("missing_percentage")
    rows = stack(
        facts,
        [
            [F.when(missing > MISSING_CRITICAL, "critical").when(missing > MISSING_WARNING, "warning"),
             F.lit("missing_data"), missing],
            [F.when(F.col("duplicate_rows") > 0, "warning"), F.lit("duplicate_rows"), F.col("duplicate_rows").cast("double")],
            [F.when(F.col("overall_score") < LOW_SCORE, "critical"), F.lit("low_quality_score"), F.col("overall_score")],
            [F.when(F.col("mostly_missing") > 0, "critical"), F.lit("mostly_missing_columns"),
             F.col("mostly_missing").cast("double")],
        ],
        "level string, alert string, value double",
    )
    return rows.where(F.col("level").isNotNull())


def quick_summary(df: DataFrame, dataset_name: str = "Dataset", schema: DataFrame | None = None) -> DataFrame:
    """One row: name, rows, columns, size, columns per type, missing and complete percentages."""
    table = detect_schema(df) if schema is None else schema
    kinds = ("numeric", "categorical", "datetime", "text", "boolean", "unknown")
    types = table.select(
        F.struct(
            F.sum("memory_mb").alias("memory_mb"),
            *[F.count_if(F.col("data_type") == k).alias(f"{k}_columns") for k in kinds],
        )
    )
    return missing_totals(df).withColumn("t", types.scalar()).select(
        F.lit(dataset_name).alias("dataset_name"),
        F.col("total_rows").alias("rows"),
        F.col("columns_count").alias("columns"),
        "t.memory_mb",
        *[f"t.{k}_columns" for k in kinds],
        F.col("overall_missing_percentage").alias("missing_percentage"),
        "complete_rows_percentage",
    )
