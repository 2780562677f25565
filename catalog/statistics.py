"""Schema and column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

import sparkprofile as sp

from .base import CONTACTS_SQL, LINEITEM_NUMBERS, SPARSE_COLUMNS, SPARSE_SQL, long_sql, query, rounded

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SPARSE_TEXT = f"WITH s AS ({SPARSE_SQL}), long AS ({long_sql('s', SPARSE_COLUMNS, 'VARCHAR', 'v')})"


# --- schema ------------------------------------------------------------------------------------

CARDINALITY = """
CASE WHEN present = 0 OR unique_count = 1 THEN 'constant' WHEN unique_count = present THEN 'unique'
     WHEN unique_count > 0.5 * present THEN 'high' WHEN unique_count > 0.1 * present THEN 'medium' ELSE 'low' END"""


@query(
    "detect_schema",
    f"""
{SPARSE_TEXT}, c AS (
  SELECT "column", count(*) AS total, count(v) AS present, count(DISTINCT v) AS unique_count FROM long GROUP BY "column")
SELECT "column",
       CASE "column" WHEN 'event_id' THEN 'bigint' WHEN 'user_id' THEN 'bigint' WHEN 'value' THEN 'double'
            WHEN 'empty_col' THEN 'double' WHEN 'ts' THEN 'timestamp_ntz' ELSE 'string' END AS dtype,
       CASE WHEN "column" IN ('event_id', 'user_id', 'value', 'empty_col') THEN 'numeric' WHEN "column" = 'ts' THEN 'datetime'
            WHEN present > 0 AND unique_count <= 0.05 * present THEN 'categorical' ELSE 'text' END AS data_type,
       CASE WHEN "column" IN ('event_id', 'user_id') THEN 'id' ELSE 'none' END AS semantic_type,
       unique_count, {CARDINALITY} AS cardinality, total - present AS null_count,
       round(100.0 * (total - present) / total, 6) AS null_percentage
FROM c""",
)
def detect_schema(t):
    return rounded(sp.detect_schema(t.sparse, order_by=["event_id"]).drop("memory_mb", "sample_values"))


EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://[^\s]+$"
PHONE = r"^[\+]?[(]?[0-9]{1,4}[)]?[-\s\.]?[(]?[0-9]{1,4}[)]?[-\s\.]?[0-9]{1,9}$"
IP = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
ZIP = r"^[0-9]{5}(-[0-9]{4})?$"


@query(
    "semantic_type",
    f"""
WITH s AS ({CONTACTS_SQL}),
long AS ({long_sql("s", ["addr", "src", "code"], "VARCHAR", "v")}
         UNION ALL SELECT 'address', url FROM pages),
shares AS (
  SELECT "column", avg(CAST(regexp_matches(v, '{EMAIL}') AS INT)) AS e, avg(CAST(regexp_matches(v, '{URL}') AS INT)) AS u,
         avg(CAST(regexp_matches(v, '{PHONE}') AS INT)) AS p, avg(CAST(regexp_matches(v, '{IP}') AS INT)) AS i,
         avg(CAST(regexp_matches(v, '{ZIP}') AS INT)) AS z
  FROM long GROUP BY "column")
SELECT "column", CASE WHEN e > 0.8 THEN 'email' WHEN u > 0.8 THEN 'url' WHEN p > 0.8 THEN 'phone'
                      WHEN i > 0.8 THEN 'ip_address' WHEN z > 0.8 THEN 'zipcode' ELSE 'none' END AS semantic_type
FROM shares
UNION ALL SELECT 'l_extendedprice', 'currency' UNION ALL SELECT 'l_quantity', 'none' UNION ALL SELECT 'page_id', 'id'
UNION ALL SELECT 'url', 'url'""",
)
def semantic_type(t):
    parts = [
        sp.semantic_type(t.contacts),
        sp.semantic_type(t.pages.select(F.col("url").alias("address"), "page_id", "url")),
        sp.semantic_type(t.lineitem, ["l_extendedprice", "l_quantity"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "null_profile",
    f"""{SPARSE_TEXT}
SELECT "column", count(*) - count(v) AS null_count, round(100.0 * (count(*) - count(v)) / count(*), 6) AS null_percentage
FROM long GROUP BY "column" """,
)
def null_profile(t):
    return rounded(sp.null_profile(t.sparse))


@query(
    "sample_values",
    f"""
WITH s AS ({SPARSE_SQL}), long AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS " + '"column"' + f", event_id, CAST({c} AS VARCHAR) AS value FROM s" for c in ("event_id", "ts", "user_id", "event_type", "props"))})
SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY event_id) AS INTEGER) AS position, value
FROM long WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY event_id) <= 5""",
)
def sample_values(t):
    return sp.sample_values(t.sparse, ["event_id", "ts", "user_id", "event_type", "props"], order_by=["event_id"])


@query(
    "column_size",
    """
SELECT 'doc_id' AS "column", count(*) * 8 AS size_bytes FROM documents
UNION ALL SELECT 'text', CAST(sum(strlen(text)) + count(*) * 8 AS BIGINT) FROM documents
UNION ALL SELECT 'lang', CAST(sum(strlen(lang)) + count(*) * 8 AS BIGINT) FROM documents
UNION ALL SELECT 'source', CAST(sum(strlen(source)) + count(*) * 8 AS BIGINT) FROM documents
UNION ALL SELECT 'n_chars', count(*) * 8 FROM documents
UNION ALL SELECT 'embedding', CAST(sum(len(embedding)) * 4 AS BIGINT) FROM embeddings""",
)
def column_size(t):
    return sp.column_size(t.documents).unionByName(sp.column_size(t.embeddings, ["embedding"])).drop("memory_mb")


@query(
    "schema_summary",
    f"""
WITH long AS ({long_sql("customer", CUSTOMER_COLUMNS, "VARCHAR", "v")}),
c AS (SELECT "column", count(*) AS total, count(v) AS present, count(DISTINCT v) AS unique_count FROM long GROUP BY "column"),
k AS (SELECT *, {CARDINALITY} AS cardinality FROM c)
SELECT count(*) AS total_columns, max(total) AS total_rows, count_if(total > present) AS columns_with_nulls,
       string_agg("column", ',' ORDER BY "column") FILTER (cardinality IN ('high', 'unique')) AS high_cardinality_columns
FROM k""",
)
def schema_summary(t):
    out = sp.schema_summary(t.customer).drop("total_memory_mb")
    return out.withColumn("high_cardinality_columns", F.array_join("high_cardinality_columns", ","))


@query(
    "type_distribution",
    f"""
WITH long AS ({long_sql("orders", ["o_orderstatus", "o_orderpriority"], "VARCHAR", "v")}),
c AS (SELECT "column", count(DISTINCT v) <= 0.05 * count(v) AS few FROM long GROUP BY "column")
SELECT CASE WHEN few THEN 'categorical' ELSE 'text' END AS data_type, count(*) AS columns FROM c GROUP BY 1
UNION ALL SELECT 'numeric', 3 UNION ALL SELECT 'datetime', 1""",
)
def type_distribution(t):
    return sp.type_distribution(sp.detect_schema(t.orders))


# --- statistics --------------------------------------------------------------------------------


def central(n: str = "count(x)") -> str:
    """Skewness and kurtosis with the sample deviation, from central moments."""
    return f"""
       CASE WHEN {n} < 3 OR stddev_samp(x) = 0 THEN 0.0 ELSE avg(pow(x - m, 3)) / pow(stddev_samp(x), 3) END AS skewness,
       CASE WHEN {n} < 4 OR stddev_samp(x) = 0 THEN 0.0 ELSE avg(pow(x - m, 4)) / pow(stddev_samp(x), 4) - 3 END AS kurtosis"""


def numeric_sql(source: str) -> str:
    """Numeric statistics of a long table ``long("column", x)`` given by ``source``."""
    return f"""
{source},
f AS (SELECT "column", x, count(*) AS c FROM long WHERE x IS NOT NULL GROUP BY "column", x),
modes AS (SELECT "column", x AS mode FROM f
          QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY c DESC, x) = 1),
means AS (SELECT "column", avg(x) AS m FROM long GROUP BY "column"),
s AS (
  SELECT "column", count(x) AS count, count(*) - count(x) AS null_count, avg(x) AS mean, stddev_samp(x) AS std,
         var_samp(x) AS variance, min(x) AS min, max(x) AS max, sum(x) AS sum,
         quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75,
         count(*) FILTER (x = 0) AS zero_count, count(*) FILTER (x < 0) AS negative_count,
         count(*) FILTER (x > 0) AS positive_count, {central()}
  FROM long JOIN means USING ("column") GROUP BY "column")
SELECT "column", count, null_count, round(coalesce(mean, 0), 7) AS mean, round(coalesce(q50, 0), 6) AS median, mode,
       round(coalesce(std, 0), 6) AS std, round(coalesce(variance, 0), 2) AS variance, coalesce(min, 0) AS min,
       coalesce(max, 0) AS max, round(coalesce(max - min, 0), 6) AS range, round(coalesce(q25, 0), 6) AS q25,
       round(coalesce(q50, 0), 6) AS q50, round(coalesce(q75, 0), 6) AS q75, round(coalesce(q75 - q25, 0), 6) AS iqr,
       round(coalesce(skewness, 0), 6) AS skewness, round(coalesce(kurtosis, 0), 6) AS kurtosis,
       round(coalesce(CASE WHEN mean = 0 THEN 0 ELSE std / mean END, 0), 6) AS cv, round(coalesce(sum, 0), 2) AS sum,
       zero_count, negative_count, positive_count
FROM s LEFT JOIN modes USING ("column")"""


@query("numeric_stats", numeric_sql(f"WITH long AS ({long_sql('lineitem', LINEITEM_NUMBERS)})"))
def numeric_stats(t):
    return rounded(sp.numeric_stats(t.lineitem), mean=7, variance=2, sum=2)


@query(
    "numeric_stats_nulls",
    numeric_sql(f"WITH src AS ({SPARSE_SQL}), long AS ({long_sql('src', ['event_id', 'user_id', 'value', 'empty_col'])})"),
)
def numeric_stats_nulls(t):
    return rounded(sp.numeric_stats(t.sparse), mean=7, variance=2, sum=2)


ANALYZE_SQL = f"""
WITH long AS ({long_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"])}),
dates AS (SELECT o_orderdate AS d FROM orders),
cats AS ({long_sql("orders", ["o_orderstatus", "o_orderpriority"], "VARCHAR", "v")})
SELECT "column", 'numeric' AS kind, count(x) AS count, count(DISTINCT x) AS unique_count FROM long GROUP BY "column"
UNION ALL SELECT 'o_orderdate', 'datetime', count(d), count(DISTINCT d) FROM dates
UNION ALL SELECT "column", CASE WHEN count(DISTINCT v) <= 0.05 * count(v) THEN 'categorical' ELSE 'text' END, count(v),
                 count(DISTINCT v) FROM cats GROUP BY "column" """


@query("analyze_statistics", ANALYZE_SQL)
def analyze_statistics(t):
    orders = t.orders
    tables = sp.analyze_statistics(orders)
    counts = tables["numeric"].select("column", "count")
    for kind in ("categorical", "datetime", "text"):
        counts = counts.unionByName(tables[kind].select("column", "count"))
    return tables["summary"].join(counts, "column").join(sp.distinct_count(orders), "column")


@query(
    "statistics_summary",
    f"""
WITH c AS ({ANALYZE_SQL})
SELECT k.kind, coalesce(string_agg("column", ',' ORDER BY "column"), '') AS columns
FROM (VALUES ('numeric'), ('categorical'), ('datetime'), ('text')) k(kind) LEFT JOIN c ON c.kind = k.kind GROUP BY k.kind""",
)
def statistics_summary(t):
    return sp.statistics_summary(t.orders).withColumn("columns", F.array_join("columns", ","))


@query(
    "quantiles",
    f"""
WITH long AS ({long_sql("lineitem", LINEITEM_NUMBERS)})
SELECT "column", {", ".join(f"round(quantile_cont(x, {p}), 6) AS q{int(p * 100)}" for p in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99))}
FROM long GROUP BY "column" """,
)
def quantiles(t):
    return rounded(sp.quantiles(t.lineitem, probabilities=(0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)))


@query(
    "quantiles_selected",
    f"""
WITH long AS ({long_sql("lineitem", LINEITEM_NUMBERS)})
SELECT "column", round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
       round(quantile_cont(x, 0.75), 6) AS q75 FROM long GROUP BY "column" """,
)
def quantiles_selected(t):
    """The way large tables go: intervals narrowed before they are read."""
    from sparkprofile.functions.columns import name_rows, numeric_long
    from sparkprofile.operators.quantiles import Selection

    df = t.lineitem
    table = Selection(numeric_long(df, LINEITEM_NUMBERS), (0.25, 0.5, 0.75), interval_values=100).table()
    return rounded(name_rows(df, LINEITEM_NUMBERS, table).drop("column_id"))


def shape_sql(column: str) -> str:
    return f"""
WITH long AS ({long_sql("events", ["event_id", "user_id", "value"])}),
means AS (SELECT "column", avg(x) AS m FROM long GROUP BY "column"),
s AS (SELECT "column", {central()} FROM long JOIN means USING ("column") GROUP BY "column")
SELECT "column", round({column}, 6) AS {column} FROM s"""


@query("skewness_stat", shape_sql("skewness"))
def skewness_stat(t):
    return rounded(sp.skewness_stat(t.events))


@query("kurtosis_stat", shape_sql("kurtosis"))
def kurtosis_stat(t):
    return rounded(sp.kurtosis_stat(t.events))


def frequency_sql(table: str, columns: list[str]) -> str:
    return f"""
WITH long AS ({long_sql(table, columns, "VARCHAR", "value")}),
f AS (SELECT "column", value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY "column", value)"""


@query(
    "mode_value",
    f"""
WITH n AS ({long_sql("lineitem", ["l_suppkey", "l_quantity", "l_discount"])}),
t AS ({long_sql("lineitem", ["l_returnflag", "l_linestatus", "l_shipdate"], "VARCHAR", "value")}),
fn AS (SELECT "column", x, count(*) AS c FROM n GROUP BY "column", x),
ft AS (SELECT "column", value, count(*) AS c FROM t GROUP BY "column", value)
SELECT "column", CAST(x AS VARCHAR) AS mode, c AS mode_count FROM fn
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY c DESC, x) = 1
UNION ALL
SELECT "column", value, c FROM ft QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY c DESC, value) = 1""",
)
def mode_value(t):
    return sp.mode_value(
        t.lineitem, ["l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"]
    )


@query(
    "categorical_stats",
    f"""
WITH src AS ({SPARSE_SQL}), long AS ({long_sql("src", ["event_type", "props"], "VARCHAR", "value")}),
f AS (SELECT "column", value, count(*) AS c FROM long WHERE value IS NOT NULL GROUP BY "column", value),
t AS (SELECT "column", count(value) AS count, count(*) - count(value) AS null_count, count(DISTINCT value) AS unique_count,
             entropy(value) AS e FROM long GROUP BY "column"),
m AS (SELECT "column", value AS mode, c FROM f QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY c DESC, value) = 1),
e AS (SELECT "column", -sum((c / t.count) * log2(c / t.count)) AS entropy FROM f JOIN t USING ("column") GROUP BY "column")
SELECT "column", count, null_count, unique_count, mode, c AS mode_frequency, round(100.0 * c / count, 6) AS mode_percentage,
       round(entropy, 6) AS entropy, unique_count = count AS is_unique
FROM t JOIN m USING ("column") JOIN e USING ("column")""",
)
def categorical_stats(t):
    return rounded(sp.categorical_stats(t.sparse, ["event_type", "props"]))


@query(
    "top_values",
    f"""{frequency_sql("documents", ["lang", "source", "text"])},
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank,
             sum(count) OVER (PARTITION BY "column") AS total FROM f)
SELECT "column", CAST(rank AS INTEGER) AS rank, value, count, round(100.0 * count / total, 6) AS percentage
FROM r WHERE rank <= 10""",
)
def top_values(t):
    return rounded(sp.top_values(t.documents, ["lang", "source", "text"]))


@query(
    "frequency_table",
    frequency_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]) + " SELECT * FROM f",
)
def frequency_table(t):
    return sp.frequency_table(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"])


@query(
    "entropy",
    f"""{frequency_sql("lineitem", ["l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber"])},
t AS (SELECT "column", sum(count) AS n FROM f GROUP BY "column")
SELECT "column", round(-sum((count / n) * log2(count / n)), 6) AS entropy FROM f JOIN t USING ("column") GROUP BY "column" """,
)
def entropy(t):
    return rounded(sp.entropy(t.lineitem, ["l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber"]))


@query(
    "distinct_count",
    f"""
WITH long AS ({long_sql("lineitem", LINEITEM_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"], "VARCHAR", "v")}
  UNION ALL SELECT 'text', text FROM documents)
SELECT "column", count(DISTINCT v) AS unique_count FROM long GROUP BY "column" """,
)
def distinct_count(t):
    return sp.distinct_count(t.lineitem).unionByName(sp.distinct_count(t.documents, ["text"]))


@query(
    "datetime_stats",
    f"""
WITH src AS ({SPARSE_SQL}),
long AS (SELECT 'ts' AS "column", ts AS x FROM src UNION ALL SELECT 'o_orderdate', o_orderdate FROM orders
         UNION ALL SELECT 'l_shipdate', l_shipdate FROM lineitem),
f AS (SELECT "column", x, count(*) AS c FROM long WHERE x IS NOT NULL GROUP BY "column", x),
m AS (SELECT "column", x AS mode FROM f QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY c DESC, x) = 1)
SELECT "column", count(x) AS count, count(*) - count(x) AS null_count, CAST(min(x) AS VARCHAR) AS min,
       CAST(max(x) AS VARCHAR) AS max, CAST(datesub('day', min(x), max(x)) AS DOUBLE) AS range_days,
       CAST(any_value(mode) AS VARCHAR) AS mode, count(DISTINCT x) AS unique_count
FROM long JOIN m USING ("column") GROUP BY "column" """,
)
def datetime_stats(t):
    return (
        sp.datetime_stats(t.sparse)
        .unionByName(sp.datetime_stats(t.orders))
        .unionByName(sp.datetime_stats(t.lineitem))
    )


@query(
    "text_stats",
    f"""
WITH long AS ({long_sql("documents", ["text"], "VARCHAR", "v")} UNION ALL {long_sql("pages", ["url", "html"], "VARCHAR", "v")}),
f AS (SELECT "column", v, count(*) AS c FROM long GROUP BY "column", v),
m AS (SELECT "column", v AS mode FROM f QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY c DESC, v) = 1)
SELECT "column", count(v) AS count, count(*) - count(v) AS null_count, count(DISTINCT v) AS unique_count,
       any_value(mode) AS mode, round(avg(length(v)), 6) AS avg_length, CAST(min(length(v)) AS INTEGER) AS min_length,
       CAST(max(length(v)) AS INTEGER) AS max_length, count_if(length(v) = 0) AS empty_count
FROM long JOIN m USING ("column") GROUP BY "column" """,
)
def text_stats(t):
    return rounded(sp.text_stats(t.documents, ["text"]).unionByName(sp.text_stats(t.pages, ["url", "html"])))
