"""Registry of the queries: each has a Spark side and, where SQL can say it, a DuckDB side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkprofile.functions.session import new_folder
from sparkprofile.sources.loader import scan_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]

# The test tables have no nulls; this view of events has some in every column but the key.
SPARSE_SQL = """
SELECT event_id,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE WHEN event_id % 4 = 0 OR event_id % 9 = 0 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN event_id % 5 < 3 THEN NULL ELSE value END AS value,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS props,
       CAST(NULL AS DOUBLE) AS empty_col
FROM events"""
SPARSE_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props", "empty_col"]

CONTACTS_SQL = """
SELECT 'user' || user_id || '@example.com' AS addr,
       '10.0.' || (user_id % 200) || '.' || (event_id % 250) AS src,
       lpad(CAST(event_id AS VARCHAR(20)), 5, '0') AS code
FROM events"""


class Tables:
    """The test tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir.rstrip('/')}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return scan_parquet(self.spark, self.path(name))

    def sql(self, text: str, *names: str) -> DataFrame:
        """Spark SQL over the named tables."""
        return self.spark.sql(_bind(text, names), **{n: getattr(self, n) for n in names})

    @property
    def sparse(self) -> DataFrame:
        return self.sql(SPARSE_SQL, "events")

    @property
    def contacts(self) -> DataFrame:
        return self.sql(CONTACTS_SQL, "events")

    @property
    def labeled(self) -> DataFrame:
        return self.documents.join(self.labels, "doc_id", "left")

    def scratch(self) -> str:
        """A new folder below the shared one, for queries that read back what they write."""
        return new_folder(self.spark, "run")


def _bind(text: str, names: Sequence[str]) -> str:
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return text


def query(name: str, sql: str | None = None):
    """Register a Spark query ``f(tables)``; ``sql`` is its DuckDB form."""

    def add(function):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, so that sums in another order compare equal."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def long_sql(table: str, columns: Sequence[str], cast: str = "DOUBLE", value: str = "x") -> str:
    """The long form of a table in SQL."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS {cast}) AS {value} FROM {table}" for c in columns
    )
