"""Correlations.  P-values need Student's t, which DuckDB lacks; they are checked in the tests."""

from __future__ import annotations

from itertools import combinations

import sparkprofile as sp

from .base import LINEITEM_NUMBERS, SPARSE_SQL, query, rounded


def pearson_sql(table: str, columns: list[str], method: str = "pearson") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 6) AS correlation, '{method}' AS method, "
        f"regr_count({a}, {b}) AS n FROM {table}"
        for a, b in combinations(columns, 2)
    )


def ranked_sql(table: str, columns: list[str]) -> str:
    """Tie-averaged ranks of every column, without nulls."""
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in columns
    )
    return f"SELECT {ranks} FROM {table}"


def pair_ranks_sql(table: str, a: str, b: str) -> str:
    """Spearman of one pair after pairwise deletion."""
    kept = f"(SELECT {a}, {b} FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return (
        f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 6) AS correlation, 'spearman' AS method, "
        f"count(*) AS n FROM ({ranked_sql(kept, [a, b])})"
    )


PAIR = ["column1", "column2", "correlation", "method", "n"]


@query("pearson", pearson_sql("lineitem", LINEITEM_NUMBERS))
def pearson(t):
    return rounded(sp.pearson(t.lineitem).select(*PAIR))


@query("pearson_nulls", f"WITH s AS ({SPARSE_SQL}) " + pearson_sql("s", ["event_id", "user_id", "value"]))
def pearson_nulls(t):
    return rounded(sp.pearson(t.sparse).select(*PAIR))


@query(
    "spearman",
    f"WITH r AS ({ranked_sql('lineitem', LINEITEM_NUMBERS)}) " + pearson_sql("r", LINEITEM_NUMBERS, "spearman"),
)
def spearman(t):
    return rounded(sp.spearman(t.lineitem).select(*PAIR))


@query(
    "spearman_nulls",
    f"WITH s AS ({SPARSE_SQL}) "
    + " UNION ALL ".join(pair_ranks_sql("s", a, b) for a, b in combinations(["event_id", "user_id", "value"], 2)),
)
def spearman_nulls(t):
    return rounded(sp.spearman(t.sparse).select(*PAIR))


def chi_sql(table: str, pairs: list[tuple[str, str]]) -> str:
    """Dense chi-square per pair: every combination of levels, empty cells included."""
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM {table} "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in pairs
    )
    return f"""
cells AS ({cells}),
o AS (SELECT column1, column2, a, b, count(*) AS o FROM cells GROUP BY ALL),
r AS (SELECT column1, column2, a, sum(o) AS rt FROM o GROUP BY ALL),
k AS (SELECT column1, column2, b, sum(o) AS ct FROM o GROUP BY ALL),
t AS (SELECT column1, column2, sum(o) AS n FROM o GROUP BY ALL),
g AS (SELECT column1, column2, a, b, rt, ct, n, coalesce(o, 0) AS o, rt * ct / n AS e
      FROM r JOIN k USING (column1, column2) JOIN t USING (column1, column2) LEFT JOIN o USING (column1, column2, a, b)),
chi AS (SELECT column1, column2, CAST(any_value(n) AS BIGINT) AS n, count(DISTINCT a) AS rows_, count(DISTINCT b) AS cols_,
               sum((o - e) * (o - e) / e) AS chi2 FROM g GROUP BY column1, column2)"""


CRAMER = """
SELECT column1, column2, round(sqrt(chi2 / (n * (least(rows_, cols_) - 1))), 6) AS correlation, 'cramers_v' AS method, n FROM chi"""


@query(
    "cramers_v",
    f"WITH {chi_sql('lineitem', [('l_returnflag', 'l_linestatus')])} {CRAMER}",
)
def cramers_v(t):
    return rounded(sp.cramers_v(t.lineitem).select(*PAIR))


@query(
    "cramers_v_nulls",
    f"WITH s AS ({SPARSE_SQL}), {chi_sql('s', [('event_type', 'props')])} {CRAMER}",
)
def cramers_v_nulls(t):
    return rounded(sp.cramers_v(t.sparse, pairs=[("event_type", "props")]).select(*PAIR))


@query(
    "chi_square",
    f"WITH {chi_sql('documents', [('lang', 'source')])} "
    "SELECT column1, column2, round(chi2, 4) AS chi2, (rows_ - 1) * (cols_ - 1) AS degrees, n FROM chi",
)
def chi_square(t):
    return rounded(sp.chi_square(t.documents, "lang", "source"), 4)


@query(
    "contingency_table",
    "SELECT lang AS a, source AS b, count(*) AS count FROM documents GROUP BY lang, source",
)
def contingency_table(t):
    return sp.contingency_table(t.documents, "lang", "source")


@query(
    "contingency_wide",
    """
SELECT l_returnflag, count_if(l_linestatus = 'F') AS "F", count_if(l_linestatus = 'O') AS "O" FROM lineitem GROUP BY l_returnflag""",
)
def contingency_wide(t):
    return sp.contingency_table(t.lineitem, "l_returnflag", "l_linestatus", wide=True)


def biserial_sql(table: str, numbers: list[str], category: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS column1, '{category}' AS column2, "
        f"round(corr({x}, CASE WHEN {category} = (SELECT max({category}) FROM {table}) THEN 1 ELSE 0 END), 6) AS correlation, "
        f"'point_biserial' AS method, count(*) AS n FROM {table}"
        for x in numbers
    )


@query("point_biserial", biserial_sql("lineitem", LINEITEM_NUMBERS, "l_linestatus"))
def point_biserial(t):
    return rounded(sp.point_biserial(t.lineitem).select(*PAIR))


def matrix_sql(pairs: str, columns: list[str]) -> str:
    grid = " UNION ALL ".join(f"SELECT '{c}' AS c" for c in columns)
    return f"""
WITH p AS ({pairs}), both_ways AS (SELECT column1, column2, correlation FROM p UNION ALL SELECT column2, column1, correlation FROM p),
g AS ({grid})
SELECT a.c AS "row", b.c AS col, CASE WHEN a.c = b.c THEN 1.0::DOUBLE ELSE coalesce(correlation, 0) END AS correlation
FROM g a CROSS JOIN g b LEFT JOIN both_ways ON column1 = a.c AND column2 = b.c"""


@query("correlation_matrix", matrix_sql(pearson_sql("lineitem", LINEITEM_NUMBERS), LINEITEM_NUMBERS))
def correlation_matrix(t):
    return rounded(sp.correlation_matrix(t.lineitem))


EVENT_NUMBERS = ["event_id", "user_id", "value"]


@query(
    "correlation_matrix_spearman",
    matrix_sql(
        f"WITH r AS ({ranked_sql('events', EVENT_NUMBERS)}) " + pearson_sql("r", EVENT_NUMBERS, "spearman"), EVENT_NUMBERS
    ),
)
def correlation_matrix_spearman(t):
    return rounded(sp.correlation_matrix(t.events, method="spearman"))


ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


@query(
    "top_correlations",
    f"""
WITH rk AS ({ranked_sql("lineitem", LINEITEM_NUMBERS)}), {chi_sql("lineitem", [("l_returnflag", "l_linestatus")])},
p AS ({pearson_sql("lineitem", LINEITEM_NUMBERS)} UNION ALL {pearson_sql("rk", LINEITEM_NUMBERS, "spearman")}
      UNION ALL {biserial_sql("lineitem", LINEITEM_NUMBERS, "l_linestatus")} UNION ALL {CRAMER})
SELECT *, CASE WHEN abs(correlation) > 0.8 THEN 'very strong' WHEN abs(correlation) > 0.6 THEN 'strong'
               WHEN abs(correlation) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength
FROM p ORDER BY abs(correlation) DESC, column1, column2, method LIMIT 20""",
)
def top_correlations(t):
    return rounded(sp.top_correlations(t.lineitem, n=20, min_correlation=0.0).select(*PAIR, "strength"))


@query(
    "column_pair_correlation",
    f"""
WITH rk AS ({ranked_sql("lineitem", ["l_quantity", "l_extendedprice"])}), {chi_sql("lineitem", [("l_returnflag", "l_linestatus")])}
{pearson_sql("lineitem", ["l_quantity", "l_extendedprice"])} UNION ALL {pearson_sql("rk", ["l_quantity", "l_extendedprice"], "spearman")}
UNION ALL {biserial_sql("lineitem", ["l_quantity"], "l_linestatus")} UNION ALL {CRAMER}""",
)
def column_pair_correlation(t):
    df = t.lineitem
    out = sp.column_pair_correlation(df, "l_quantity", "l_extendedprice")
    out = out.unionByName(sp.column_pair_correlation(df, "l_linestatus", "l_quantity"))
    out = out.unionByName(sp.column_pair_correlation(df, "l_returnflag", "l_linestatus"))
    return rounded(out.select(*PAIR))


@query(
    "average_rank",
    """
WITH long AS (SELECT 'l_quantity' AS "column", l_quantity::DOUBLE AS x FROM lineitem
              UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
r AS (SELECT "column", x, rank() OVER (PARTITION BY "column" ORDER BY x) AS k FROM long)
SELECT "column", x, count(*) AS count, round(any_value(k) + (count(*) - 1) / 2.0, 6) AS average_rank FROM r GROUP BY "column", x""",
)
def average_rank(t):
    return rounded(sp.average_rank(t.lineitem, ["l_quantity", "l_extendedprice"]))
