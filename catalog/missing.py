"""Missing values."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

import sparkprofile as sp

from .base import SPARSE_COLUMNS, SPARSE_SQL, long_sql, query, rounded

SOURCE = f"WITH s AS ({SPARSE_SQL}), long AS ({long_sql('s', SPARSE_COLUMNS, 'VARCHAR', 'v')})"
PATTERN = "concat_ws(','," + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in SPARSE_COLUMNS) + ")"
NOT_EMPTY = [c for c in SPARSE_COLUMNS if c != "empty_col"]
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in NOT_EMPTY)
LABELED = "SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)"


@query(
    "missing_columns",
    f"""{SOURCE}, c AS (
  SELECT "column", count(*) - count(v) AS missing_count, count(v) AS present_count,
         100.0 * (count(*) - count(v)) / count(*) AS p, count(*) AS total_count FROM long GROUP BY "column")
SELECT "column", missing_count, present_count, round(p, 6) AS missing_percentage, total_count,
       CASE WHEN p >= 50 THEN 'critical' WHEN p >= 20 THEN 'high' WHEN p >= 5 THEN 'medium' ELSE 'low' END AS severity FROM c""",
)
def missing_columns(t):
    return rounded(sp.missing_columns(t.sparse))


@query(
    "missing_patterns",
    f"""
WITH s AS ({SPARSE_SQL}), p AS (SELECT {PATTERN} AS columns, count(*) AS count FROM s GROUP BY 1),
t AS (SELECT count(*) AS n FROM s)
SELECT columns, count, round(100.0 * count / n, 6) AS percentage FROM p, t WHERE columns <> ''
ORDER BY count DESC, columns LIMIT 20""",
)
def missing_patterns(t):
    return rounded(sp.missing_patterns(t.sparse)).withColumn("columns", F.array_join("columns", ","))


@query(
    "missing_matrix",
    f"""
WITH s AS ({SPARSE_SQL}), h AS (SELECT * FROM s ORDER BY event_id LIMIT 1000)
SELECT {", ".join(f"{c} IS NULL AS {c}" for c in SPARSE_COLUMNS)} FROM h""",
)
def missing_matrix(t):
    return sp.missing_matrix(t.sparse, order_by=["event_id"])


@query(
    "complete_rows",
    f"""
WITH s AS ({SPARSE_SQL})
SELECT count(*) AS total_rows, count_if({COMPLETE}) AS complete_rows, count_if(NOT ({COMPLETE})) AS incomplete_rows,
       round(100.0 * count_if({COMPLETE}) / count(*), 6) AS complete_rows_percentage FROM s""",
)
def complete_rows(t):
    return rounded(sp.complete_rows(t.sparse, NOT_EMPTY))


TOTALS = """
SELECT {rows} AS total_rows, CAST({n} AS BIGINT) AS columns_count, CAST({missing} AS BIGINT) AS total_missing_values,
       {n} * {rows} AS total_cells, CAST({with_missing} AS BIGINT) AS columns_with_missing, {complete} AS complete_rows,
       {rows} - {complete} AS incomplete_rows, round(100.0 * {missing} / ({n} * {rows}), 6) AS overall_missing_percentage,
       round(100.0 * {complete} / {rows}, 6) AS complete_rows_percentage
"""


@query(
    "analyze_missing",
    f"""
WITH s AS ({LABELED})"""
    + TOTALS.format(
        rows="count(*)", n=7, missing="(count(*) - count(quality) + count(*) - count(toxic))",
        with_missing="((count(quality) < count(*))::INT + (count(toxic) < count(*))::INT)",
        complete="count_if(quality IS NOT NULL AND toxic IS NOT NULL)",
    )
    + "FROM s",
)
def analyze_missing(t):
    return rounded(sp.analyze_missing(t.labeled)["totals"])


@query(
    "missing_summary",
    f"""{SOURCE}, c AS (SELECT "column", 100.0 * (count(*) - count(v)) / count(*) AS p FROM long GROUP BY "column")
SELECT "column", round(p, 6) AS missing_percentage,
       CASE WHEN p > 50 THEN 'high' WHEN p > 10 THEN 'medium' ELSE 'low' END AS bucket FROM c WHERE p > 0""",
)
def missing_summary(t):
    return rounded(sp.missing_summary(t.sparse)["buckets"])


@query(
    "missing_correlation",
    f"""
WITH s AS ({SPARSE_SQL})
{" UNION ALL ".join(f"SELECT '{c}' AS " + '"column"' + f", round(corr(CAST(user_id IS NULL AS INT), CAST({c} IS NULL AS INT)), 6) AS correlation FROM s" for c in ("ts", "event_type", "value", "props"))}""",
)
def missing_correlation(t):
    return rounded(sp.missing_correlation(t.sparse, "user_id"))


def _type_sql() -> str:
    gaps = [c for c in SPARSE_COLUMNS if c not in ("event_id", "empty_col")]
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, abs(corr(CAST({a} IS NULL AS INT), CAST({b} IS NULL AS INT))) AS r FROM s"
        for a, b in combinations(gaps, 2)
    )
    return f"""{SOURCE}, pairs AS ({pairs}), both_ways AS (SELECT a, r FROM pairs UNION ALL SELECT b, r FROM pairs),
strongest AS (SELECT a, max(r) AS r FROM both_ways GROUP BY a),
c AS (SELECT "column", count(v) AS present, count(*) AS n FROM long GROUP BY "column")
SELECT "column", CASE WHEN present = n THEN 'no_missing' WHEN present = 0 THEN 'all_missing'
                      WHEN r > 0.5 THEN 'mar' ELSE 'mcar' END AS missing_type
FROM c LEFT JOIN strongest ON a = "column"
UNION ALL SELECT 'no_such_column', 'unknown'"""


@query("missing_type", _type_sql())
def missing_type(t):
    return sp.missing_type(t.sparse, [*SPARSE_COLUMNS, "no_such_column"])
