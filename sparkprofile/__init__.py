"""Data profiling on Spark: DataFrame in, tidy DataFrames out."""

import sys

from pyspark import cloudpickle

from .functions.session import drop_tables, intermediate_tables
from .operators.correlations import (
    analyze_correlations, chi_square, column_pair_correlation, contingency_table, correlation_columns,
    correlation_matrix, cramers_v, pearson, point_biserial, spearman, top_correlations,
)
from .operators.distributions import (
    analyze_distributions, anderson_darling, dagostino_pearson, distribution_summary, distribution_type,
    distribution_type_counts, fit_distribution, histogram, histogram_markers, kde, ks_normal, moments_pop,
    normality_vote, quartiles, shapiro_wilk,
)
from .operators.frequency import average_rank, distinct_count, frequency_table
from .operators.iforest import multivariate_outliers, multivariate_summary
from .operators.missing import (
    analyze_missing, complete_rows, missing_buckets, missing_columns, missing_correlation, missing_heatmap_data,
    missing_matrix, missing_patterns, missing_summary, missing_totals, missing_type,
)
from .operators.outliers import (
    detect_outliers, flag_outliers, iqr_outliers, mad_outliers, outlier_summary, outlier_values,
    outliers_for_column, zscore_outliers,
)
from .operators.plotdata import (
    box_stats, categorical_bar, linear_fit, missing_heatmap, pair_grid, qq_line, qq_points, scatter_points,
    violin_stats,
)
from .operators.quality import alerts, duplicate_rows, quality_score, quick_summary
from .operators.quantiles import quantiles
from .operators.rolling import rolling_average
from .operators.sampling import drop_nulls, row_search, sample_rows, uniform_sample
from .operators.schema import (
    column_size, detect_schema, null_profile, sample_values, schema_summary, semantic_type, type_distribution,
)
from .operators.statistics import (
    analyze_statistics, categorical_stats, datetime_stats, entropy, kurtosis_stat, mode_value, numeric_stats,
    skewness_stat, statistics_summary, text_stats, top_values,
)
from .plans.profile import Profile, analyze_dataset, column_analysis
from .plans.report import plot_index, plot_tables, report_tables, write_plots, write_report
from .sources.loader import (
    dataset_info, detect_format, infer_types, invalid_utf8_rows, load_dataset, preview_dataset, scan_arrow,
    scan_csv, scan_json, scan_ndjson, scan_parquet, scan_tsv, validate_dataset,
)
from .sources.writers import write_json, write_tables

# The few Python functions that run in tasks travel with the job: nothing to install on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("cloudpickle", "sys")]
