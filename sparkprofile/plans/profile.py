"""The whole profile of a data set."""

from __future__ import annotations

import time
from collections.abc import Sequence
from itertools import combinations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, numeric_columns, select_columns, unique_names
from ..operators import correlations as co, distributions as di, frequency as fq, missing as mi, outliers as ou
from ..operators import quality as qu, schema as sc, statistics as st
from ..operators.iforest import multivariate_outliers, multivariate_summary
from ..sources.writers import write_json


class Profile:
    """Six analyses of one DataFrame as small result tables.

    Every table is computed once and kept: result tables have one row per column, pair, pattern or
    bin, so they are persisted; the data itself is not.  ``release`` drops them.  The ordered
    frequency table of the numeric columns, the one intermediate that grows with the data, is
    written once and read by statistics, Spearman and distributions.
    """

    def __init__(
        self,
        df: DataFrame,
        dataset_name: str = "Dataset",
        columns: Sequence[str] | None = None,
        order_by: Sequence[str] | None = None,
        skip_multivariate_outliers: bool = False,
    ):
        self.names = list(df.columns)
        df = df.toDF(*unique_names(df.columns))
        self.df = df.select(*[col(c) for c in select_columns(df, columns)]) if columns else df
        if columns:
            self.names = list(self.df.columns)
        self.dataset_name = dataset_name
        self.order_by = order_by
        self.skip_multivariate_outliers = skip_multivariate_outliers
        self._tables: dict[str, DataFrame] = {}
        self._ordered: DataFrame | None = None
        self._categorical: list[str] | None = None

    @property
    def ordered(self) -> DataFrame | None:
        names = numeric_columns(self.df)
        if self._ordered is None and names:
            self._ordered = fq.ordered_frequency(fq.numeric_frequency(self.df, names))
        return self._ordered

    def _mode_frequency(self) -> DataFrame | None:
        """The frequency table for modes, unless integers beyond 2^53 merged in it."""
        if self.ordered is None:
            return None
        largest = self.ordered.agg(F.max(F.abs("x"))).first()[0]
        return self.ordered if largest is None or largest < 2**53 else None

    def _keep(self, name: str, build) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return self._tables[name]

    def release(self) -> None:
        for table in self._tables.values():
            table.unpersist()
        self._tables = {}

    @property
    def schema(self) -> DataFrame:
        return self._keep("schema", lambda: sc.detect_schema(self.df, order_by=self.order_by))

    @property
    def schema_summary(self) -> DataFrame:
        return self._keep("schema_summary", lambda: sc.schema_summary(self.df, self.schema))

    def statistics(self, kind: str) -> DataFrame:
        """``numeric``, ``categorical``, ``datetime``, ``text``, ``top_values`` or ``summary``."""
        if f"statistics_{kind}" not in self._tables:
            for name, table in st.analyze_statistics(self.df, frequency=self._mode_frequency()).items():
                self._keep(f"statistics_{name}", lambda table=table: table)
        return self._tables[f"statistics_{kind}"]

    def missing(self, part: str) -> DataFrame:
        """``totals``, ``columns``, ``patterns`` or ``matrix``."""
        build = {
            "totals": lambda: mi.missing_totals(self.df),
            "columns": lambda: mi.missing_columns(self.df),
            "patterns": lambda: mi.missing_patterns(self.df),
            "matrix": lambda: mi.missing_matrix(self.df, order_by=self.order_by),
        }
        return self._keep(f"missing_{part}", build[part])

    @property
    def outliers(self) -> DataFrame:
        return self._keep("outliers", lambda: ou.detect_outliers(self.df))

    @property
    def outlier_summary(self) -> DataFrame:
        return self._keep("outlier_summary", lambda: ou.outlier_summary(self.df, outliers=self.outliers))

    @property
    def multivariate(self) -> DataFrame | None:
        """Share of joint outliers over all numeric columns; there is no limit on the rows."""
        if self.skip_multivariate_outliers or len(numeric_columns(self.df)) < 2:
            return None
        return self._keep("multivariate", lambda: multivariate_summary(multivariate_outliers(self.df, keys=[])))

    @property
    def categorical(self) -> list[str]:
        if self._categorical is None:
            self._categorical = st.categorical_names(self.df, limit=co.CATEGORICAL_RATIO)
        return self._categorical

    def correlations(self, kind: str) -> DataFrame:
        """``pearson``, ``spearman``, ``cramers_v`` or ``mixed``."""
        build = {
            "pearson": lambda: co.pearson(self.df),
            "spearman": lambda: co.spearman(self.df, ordered=self.ordered),
            "cramers_v": lambda: co.cramers_v(self.df, pairs=list(combinations(self.categorical, 2))),
            "mixed": lambda: co.point_biserial(self.df, categorical=self.categorical),
        }
        return self._keep(f"correlations_{kind}", build[kind])

    def top_correlations(self, n: int = 20, min_correlation: float = 0.3) -> DataFrame:
        pairs = self.correlations("pearson")
        for kind in ("spearman", "cramers_v", "mixed"):
            pairs = pairs.unionByName(self.correlations(kind))
        return co.top_pairs(pairs, n, min_correlation)

    def correlation_matrix(self) -> DataFrame:
        """Long form of the Pearson matrix, read from the pair table."""
        names = numeric_columns(self.df)
        pairs = self.correlations("pearson").select("column1", "column2", "correlation")
        both = pairs.unionByName(pairs.select(F.col("column2").alias("column1"), F.col("column1").alias("column2"), "correlation"))
        grid = self.df.sparkSession.createDataFrame(
            [(a, b) for a in names for b in names], "column1 string, column2 string"
        )
        cell = F.when(F.col("column1") == F.col("column2"), 1.0).otherwise(F.coalesce("correlation", F.lit(0.0)))
        return grid.join(F.broadcast(both), ["column1", "column2"], "left").select(
            F.col("column1").alias("row"), F.col("column2").alias("col"), cell.alias("correlation")
        )

    @property
    def distributions(self) -> DataFrame:
        return self._keep("distributions", lambda: di.analyze_distributions(self.df, ordered=self.ordered))

    @property
    def histograms(self) -> DataFrame:
        return self._keep("histograms", lambda: di.histogram(self.df))

    @property
    def distribution_summary(self) -> DataFrame:
        return self._keep("distribution_summary", lambda: di.distribution_summary(self.df, table=self.distributions))

    @property
    def quality(self) -> DataFrame:
        return self._keep(
            "quality", lambda: qu.quality_score(self.df, names=self.names, outliers=self.outliers)
        )

    @property
    def alerts(self) -> DataFrame:
        return self._keep("alerts", lambda: qu.alerts(self.df, score=self.quality))

    def quick_summary(self) -> DataFrame:
        return qu.quick_summary(self.df, self.dataset_name, self.schema)

    def tables(self) -> dict[str, DataFrame]:
        """All result tables by name."""
        out = {
            "schema": self.schema,
            "schema_summary": self.schema_summary,
            **{f"statistics_{k}": self.statistics(k) for k in ("numeric", "categorical", "datetime", "text", "top_values", "summary")},
            **{f"missing_{p}": self.missing(p) for p in ("totals", "columns", "patterns", "matrix")},
            "outliers": self.outliers,
            "outlier_summary": self.outlier_summary,
            **{f"correlations_{k}": self.correlations(k) for k in ("pearson", "spearman", "cramers_v", "mixed")},
            "top_correlations": self.top_correlations(),
            "correlation_matrix": self.correlation_matrix(),
            "distributions": self.distributions,
            "histograms": self.histograms,
            "distribution_summary": self.distribution_summary,
            "quality": self.quality,
            "alerts": self.alerts,
            "duplicate_rows": qu.duplicate_rows(self.df),
        }
        if self.multivariate is not None:
            out["multivariate_outliers"] = self.multivariate
        return out

    def write(self, path: str) -> dict[str, str]:
        """The analysis as JSON, one sub-folder per table, with the run's headline numbers."""
        started = time.time()
        places = write_json(self.tables(), path)
        overview = self.quick_summary().withColumn("analysis_time_seconds", F.lit(time.time() - started))
        places.update(write_json({"overview": overview}, path))
        return places


def analyze_dataset(
    df: DataFrame,
    dataset_name: str = "Dataset",
    skip_multivariate_outliers: bool = False,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
) -> Profile:
    """Profile of ``df``; tables are computed when first asked for."""
    return Profile(df, dataset_name, columns, order_by, skip_multivariate_outliers)


def column_analysis(df: DataFrame, column: str, order_by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All sections for one column, reading only that column."""
    if column not in df.columns:
        raise ValueError(f"column {column} not found")
    one = df.select(col(column), *[col(c) for c in order_by or [] if c != column])
    only = [column]
    out = {"schema": sc.detect_schema(one, only, order_by), "missing": mi.missing_columns(one, only)}
    for kind, table in st.analyze_statistics(one, only).items():
        if kind != "summary":
            out[f"statistics_{kind}"] = table
    if numeric_columns(one, only):
        out["outliers"] = ou.detect_outliers(one, only)
        out["distribution"] = di.analyze_distributions(one, only)
        out["histogram"] = di.histogram(one, only)
    return {k: t for k, t in out.items() if not k.startswith("statistics_") or not t.isEmpty()}
