"""The data of the report and of the batch of recommended plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import STRING, columns_of, numeric_columns
from ..operators import plotdata as pd_, schema as sc
from ..operators.correlations import correlation_matrix
from ..operators.distributions import histogram
from ..sources.writers import write_tables
from .profile import Profile


def report_tables(profile: Profile, pairs: int | None = None, missing_bars: int | None = None) -> dict[str, DataFrame]:
    """Rows of every section of the report and the data of its three charts.

    ``pairs`` and ``missing_bars`` keep the strongest correlations and the columns with most gaps only; default all.
    """
    columns = len(profile.df.columns)
    missing = profile.missing("columns").orderBy(F.desc("missing_percentage"), "column")
    return {
        "overview": profile.quick_summary(),
        "quality": profile.quality,
        "schema_rows": profile.schema.select(
            "column", "dtype", "data_type", "semantic_type", "unique_count", "null_count", "null_percentage", "memory_mb"
        ),
        "missing_rows": missing.select("column", "missing_count", "present_count", "missing_percentage"),
        "outlier_rows": profile.outliers.select(
            "column", "iqr_outlier_count", "zscore_outlier_count", "mad_outlier_count", "outlier_percentage"
        ),
        "correlation_rows": profile.top_correlations(pairs or max(1, columns * columns)).select(
            "column1", "column2", "correlation", F.abs("correlation").alias("abs_correlation"), "method"
        ),
        "distribution_rows": profile.distributions.select(
            "column", "distribution_type", "is_normal", "skewness", "kurtosis"
        ),
        "type_chart": sc.type_distribution(profile.schema),
        "missing_chart": missing.where(F.col("missing_count") > 0).select("column", "missing_percentage").limit(missing_bars or max(1, columns)),
        "correlation_chart": profile.correlation_matrix(),
    }


def write_report(profile: Profile, path: str, format: str = "json", **limits) -> dict[str, str]:
    return write_tables(report_tables(profile, **limits), path, format)


def plot_selection(
    df: DataFrame, histograms: int | None = None, boxes: int | None = None, bars: int | None = None
) -> list[tuple[str, list[str]]]:
    """The recommended plots: what kind, over which columns; the limits keep the first columns only, default all."""
    numbers, texts = numeric_columns(df), columns_of(df, STRING)
    plots = [("histogram", [c]) for c in numbers[:histograms]]
    if numbers:
        plots.append(("box", numbers[:boxes]))
    if len(numbers) >= 2:
        plots.append(("heatmap", numbers))
    plots += [("categorical", [c]) for c in texts[:bars]]
    return [*plots, ("missing", list(df.columns))]


def plot_index(df: DataFrame, **limits) -> DataFrame:
    """``(type, info, path)`` of the recommended plots."""
    rows = [(kind, ", ".join(names), _folder(kind, names)) for kind, names in plot_selection(df, **limits)]
    return df.sparkSession.createDataFrame(rows, "type string, info string, path string")


def _folder(kind: str, names: Sequence[str]) -> str:
    return {
        "histogram": f"hist_{names[0]}",
        "box": "box_comparison",
        "heatmap": "correlation_heatmap",
        "categorical": f"cat_{names[0]}",
        "missing": "missing_pattern",
    }[kind]


def plot_tables(df: DataFrame, keys: Sequence[str] | None = None, **limits) -> dict[str, DataFrame]:
    """Data of the recommended plots by folder name, and their ``index``."""
    build = {
        "histogram": lambda names: histogram(df, names),
        "box": lambda names: pd_.box_stats(df, names),
        "heatmap": lambda names: correlation_matrix(df, names, undefined=None),
        "categorical": lambda names: pd_.categorical_bar(df, names[0]),
        "missing": lambda names: pd_.missing_heatmap(df, names, keys=keys),
    }
    out = {_folder(kind, names): build[kind](names) for kind, names in plot_selection(df, **limits)}
    return {**out, "index": plot_index(df, **limits)}


def write_plots(df: DataFrame, path: str, keys: Sequence[str] | None = None, format: str = "parquet", **limits) -> dict[str, str]:
    return write_tables(plot_tables(df, keys, **limits), path, format)
