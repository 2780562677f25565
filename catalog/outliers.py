"""Outliers and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

import sparkprofile as sp

from .base import LINEITEM_NUMBERS, SPARSE_COLUMNS, SPARSE_SQL, long_sql, query, rounded

LONG = f"long AS ({long_sql('events', ['event_id', 'user_id', 'value'])} UNION ALL {long_sql('orders', ['o_totalprice'])})"


def bounds_sql(long: str) -> str:
    """Per-column bounds and per-value flags of ``long("column", x)``."""
    return f"""
WITH {long},
q AS (SELECT "column", quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q75,
             avg(x) AS mean, stddev_samp(x) AS std FROM long GROUP BY "column"),
d AS (SELECT "column", quantile_cont(abs(x - med), 0.5) AS mad FROM long JOIN q USING ("column") GROUP BY "column"),
b AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lower, q75 + 1.5 * (q75 - q25) AS upper FROM q JOIN d USING ("column")),
f AS (SELECT "column", x, lower, upper, mean, std, med, mad, x < lower OR x > upper AS i,
             std <> 0 AND abs(x - mean) / CASE WHEN std = 0 THEN NULL ELSE std END > 3.0 AS z,
             mad <> 0 AND 0.6745 * abs(x - med) / CASE WHEN mad = 0 THEN NULL ELSE mad END > 3.5 AS m
      FROM long JOIN b USING ("column") WHERE x IS NOT NULL)"""


FLAGS = bounds_sql(LONG)


def both(operator):
    return lambda t: operator(t.events).unionByName(operator(t.orders, ["o_totalprice"]))


@query(
    "iqr_outliers",
    f"""{FLAGS}
SELECT "column", round(any_value(lower), 6) AS lower_bound, round(any_value(upper), 6) AS upper_bound,
       count(*) FILTER (i) AS outlier_count FROM f GROUP BY "column" """,
)
def iqr_outliers(t):
    return rounded(both(sp.iqr_outliers)(t))


@query(
    "zscore_outliers",
    f"""{FLAGS}
SELECT "column", round(any_value(mean), 7) AS mean, round(any_value(std), 6) AS std,
       count(*) FILTER (z) AS outlier_count FROM f GROUP BY "column" """,
)
def zscore_outliers(t):
    return rounded(both(sp.zscore_outliers)(t), mean=7)


@query(
    "mad_outliers",
    f"""{FLAGS}
SELECT "column", round(any_value(med), 6) AS median, round(any_value(mad), 6) AS mad,
       count(*) FILTER (m) AS outlier_count FROM f GROUP BY "column" """,
)
def mad_outliers(t):
    return rounded(both(sp.mad_outliers)(t))


DETECT = """, r AS (
SELECT "column", count(*) AS total_count, count(*) FILTER (i) AS iqr_outlier_count, count(*) FILTER (z) AS zscore_outlier_count,
       count(*) FILTER (m) AS mad_outlier_count, count(*) FILTER (i OR z OR m) AS any_outlier_count,
       round(any_value(lower), 6) AS iqr_lower_bound, round(any_value(upper), 6) AS iqr_upper_bound,
       100.0 * count(*) FILTER (i OR z OR m) / count(*) AS p
FROM f GROUP BY "column")"""


@query(
    "detect_outliers",
    f"""{FLAGS}{DETECT}
SELECT "column", total_count, iqr_outlier_count, zscore_outlier_count, mad_outlier_count, any_outlier_count,
       iqr_lower_bound, iqr_upper_bound, CAST(3 AS DOUBLE) AS zscore_threshold, CAST(3.5 AS DOUBLE) AS mad_threshold,
       round(p, 6) AS outlier_percentage,
       CASE WHEN p >= 20 THEN 'critical' WHEN p >= 10 THEN 'high' WHEN p >= 5 THEN 'medium' ELSE 'low' END AS severity
FROM r""",
)
def detect_outliers(t):
    return rounded(both(sp.detect_outliers)(t))


LINE_FLAGS = bounds_sql(f"long AS ({long_sql('lineitem', LINEITEM_NUMBERS)})")


@query(
    "detect_outliers_lineitem",
    f"""{LINE_FLAGS}{DETECT}
SELECT "column", total_count, iqr_outlier_count, zscore_outlier_count, mad_outlier_count, any_outlier_count,
       iqr_lower_bound, iqr_upper_bound, round(p, 6) AS outlier_percentage FROM r""",
)
def detect_outliers_lineitem(t):
    return rounded(sp.detect_outliers(t.lineitem).drop("zscore_threshold", "mad_threshold", "severity"))


@query(
    "flag_outliers",
    f"""{bounds_sql(f"src AS ({SPARSE_SQL}), long AS ({long_sql('src', ['value'])})")}
SELECT event_id, value, coalesce(value < lower OR value > upper, false) AS value_is_iqr,
       coalesce(abs(value - mean) / std > 3.0, false) AS value_is_zscore,
       coalesce(0.6745 * abs(value - med) / mad > 3.5, false) AS value_is_mad
FROM src, b""",
)
def flag_outliers(t):
    return sp.flag_outliers(t.sparse.select("event_id", "value"), ["value"])


@query(
    "outlier_values",
    f"""{FLAGS}
SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY x DESC) AS INTEGER) AS position, x AS value
FROM f WHERE i OR z OR m QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY x DESC) <= 100""",
)
def outlier_values(t):
    return both(sp.outlier_values)(t)


@query(
    "outlier_summary",
    f"""{bounds_sql(f"long AS ({long_sql('events', ['event_id', 'user_id', 'value'])})")}{DETECT}
SELECT count(*) AS total_numeric_columns, count(*) FILTER (iqr_outlier_count > 0 OR zscore_outlier_count > 0) AS columns_with_outliers_count,
       CAST(sum(any_outlier_count) AS BIGINT) AS total_outlier_detections,
       coalesce(string_agg("column", ',' ORDER BY "column") FILTER (iqr_outlier_count > 0 OR zscore_outlier_count > 0), '') AS columns_with_outliers,
       coalesce(string_agg("column", ',' ORDER BY p DESC, "column") FILTER (p > 5), '') AS high_outlier_columns
FROM r""",
)
def outlier_summary(t):
    out = sp.outlier_summary(t.events)
    return out.withColumns({c: F.array_join(c, ",") for c in ("columns_with_outliers", "high_outlier_columns")})


@query(
    "outliers_for_column",
    f"""{bounds_sql(f"long AS ({long_sql('events', ['value'])})")}
SELECT 'iqr' AS method, count(*) FILTER (i) AS count, round(100.0 * count(*) FILTER (i) / count(*), 6) AS percentage,
       round(any_value(lower), 6) AS lower_bound, round(any_value(upper), 6) AS upper_bound, CAST(NULL AS DOUBLE) AS threshold FROM f
UNION ALL SELECT 'zscore', count(*) FILTER (z), round(100.0 * count(*) FILTER (z) / count(*), 6), NULL, NULL, 3.0 FROM f
UNION ALL SELECT 'mad', count(*) FILTER (m), round(100.0 * count(*) FILTER (m) / count(*), 6), NULL, NULL, 3.5 FROM f""",
)
def outliers_for_column(t):
    return rounded(sp.outliers_for_column(t.events, "value"))


@query("multivariate_outliers")
def multivariate_outliers(t):
    return sp.multivariate_summary(sp.multivariate_outliers(t.lineitem, keys=["l_orderkey", "l_linenumber"]))


# --- quality -----------------------------------------------------------------------------------


def quality_sql(source: str, columns: list[str], numbers: list[str]) -> str:
    present = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    gaps = " + ".join(f"count(*) - count({c})" for c in columns)
    return f"""{bounds_sql(f"src AS ({source}), long AS ({long_sql('src', numbers)})")},
o AS (SELECT "column", 100.0 * count(*) FILTER (i OR z OR m) / count(*) AS p FROM f GROUP BY "column"),
a AS (SELECT coalesce(sum(p), 0) / {len(numbers)} AS average FROM o),
c AS (SELECT 100.0 * count_if({present}) / count(*) AS complete, 100.0 * ({gaps}) / ({len(columns)} * count(*)) AS missing FROM src),
score AS (SELECT *, 0.4 * complete + 0.4 * greatest(0, 100 - average) + 20.0 AS overall FROM a, c)"""


QUALITY_SELECT = """
SELECT round(overall, 6) AS overall_score,
       CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 60 THEN 'fair' ELSE 'poor' END AS quality_rating,
       round(complete, 6) AS completeness_score, round(greatest(0, 100 - average), 6) AS outlier_score,
       CAST(100 AS DOUBLE) AS schema_score, round(missing, 6) AS missing_percentage,
       round(average, 6) AS average_outlier_percentage, 0 AS duplicate_columns, 0 AS unnamed_columns
FROM score"""


@query("quality_score", quality_sql(SPARSE_SQL, SPARSE_COLUMNS, ["event_id", "user_id", "value", "empty_col"]) + QUALITY_SELECT)
def quality_score(t):
    return rounded(sp.quality_score(t.sparse))


@query(
    "quality_score_customer",
    quality_sql("SELECT * FROM customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                ["c_custkey", "c_nationkey", "c_acctbal"]) + QUALITY_SELECT,
)
def quality_score_customer(t):
    return rounded(sp.quality_score(t.customer))


@query(
    "duplicate_rows",
    """
WITH n AS (SELECT count(*) AS total FROM events), d AS (SELECT count(*) AS k FROM (SELECT DISTINCT user_id, event_type FROM events))
SELECT total AS total_rows, k AS distinct_rows, total - k AS duplicate_rows, round(100.0 * (total - k) / total, 6) AS duplicate_percentage
FROM n, d""",
)
def duplicate_rows(t):
    return rounded(sp.duplicate_rows(t.events, ["user_id", "event_type"]))


@query(
    "alerts",
    quality_sql(SPARSE_SQL, SPARSE_COLUMNS, ["event_id", "user_id", "value", "empty_col"])
    + f""",
e AS (SELECT count(*) FILTER (p > 50) AS k FROM (SELECT 100.0 * (count(*) - count(v)) / count(*) AS p
      FROM ({long_sql("src", SPARSE_COLUMNS, "VARCHAR", "v")}) GROUP BY "column"))
SELECT CASE WHEN missing > 20 THEN 'critical' ELSE 'warning' END AS level, 'missing_data' AS alert, round(missing, 6) AS value
FROM score WHERE missing > 5
UNION ALL SELECT 'critical', 'low_quality_score', round(overall, 6) FROM score WHERE overall < 70
UNION ALL SELECT 'critical', 'mostly_missing_columns', CAST(k AS DOUBLE) FROM e WHERE k > 0""",
)
def alerts(t):
    return rounded(sp.alerts(t.sparse))


@query(
    "quick_summary",
    f"""
WITH long AS ({long_sql("customer", ["c_name", "c_mktsegment"], "VARCHAR", "v")}),
k AS (SELECT "column", count(DISTINCT v) <= 0.05 * count(v) AS few FROM long GROUP BY "column")
SELECT 'customer' AS dataset_name, (SELECT count(*) FROM customer) AS "rows", 5 AS columns, 3 AS numeric_columns,
       count_if(few) AS categorical_columns, 0 AS datetime_columns, count_if(NOT few) AS text_columns, 0 AS boolean_columns,
       0 AS unknown_columns, CAST(0 AS DOUBLE) AS missing_percentage, CAST(100 AS DOUBLE) AS complete_rows_percentage
FROM k""",
)
def quick_summary(t):
    return sp.quick_summary(t.customer, "customer").drop("memory_mb")


@query(
    "column_analysis",
    f"""{bounds_sql(f"long AS ({long_sql('events', ['value'])})")}
SELECT 'value' AS "column", 'numeric' AS data_type, count(*) AS count, round(any_value(mean), 6) AS mean,
       round(any_value(med), 6) AS median, count(*) FILTER (i) AS iqr_outlier_count, CAST(0 AS BIGINT) AS missing_count,
       'right_skewed' AS distribution_type FROM f""",
)
def column_analysis(t):
    parts = sp.column_analysis(t.events, "value")
    out = parts["schema"].select("column", "data_type")
    picks = {
        "statistics_numeric": ["count", "mean", "median"], "outliers": ["iqr_outlier_count"],
        "missing": ["missing_count"], "distribution": ["distribution_type"],
    }
    for name, columns in picks.items():
        out = out.join(F.broadcast(parts[name].select("column", *columns)), "column")  # one row each
    return rounded(out)


@query(
    "analyze_dataset",
    """
WITH r AS (SELECT corr(o_orderkey, o_custkey) AS a, corr(o_orderkey, o_totalprice) AS b, corr(o_custkey, o_totalprice) AS c FROM orders)
SELECT 'schema' AS "table", 6 AS "rows" UNION ALL SELECT 'statistics_numeric', 3 UNION ALL SELECT 'missing_columns', 6
UNION ALL SELECT 'missing_patterns', 0 UNION ALL SELECT 'outliers', 3 UNION ALL SELECT 'correlations_pearson', 3
UNION ALL SELECT 'correlations_spearman', 3 UNION ALL SELECT 'correlations_cramers_v', 1
UNION ALL SELECT 'correlation_matrix', 9 UNION ALL SELECT 'distributions', 3 UNION ALL SELECT 'histograms', 90
UNION ALL SELECT 'quality', 1""",
)
def analyze_dataset(t):
    profile = sp.analyze_dataset(t.orders, "orders", skip_multivariate_outliers=True)
    wanted = [
        "schema", "statistics_numeric", "missing_columns", "missing_patterns", "outliers", "correlations_pearson",
        "correlations_spearman", "correlations_cramers_v", "correlation_matrix", "distributions", "histograms", "quality",
    ]
    tables = profile.tables()
    counts = [tables[n].agg(F.lit(n).alias("table"), F.count(F.lit(1)).cast("int").alias("rows")) for n in wanted]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out
