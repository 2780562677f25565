"""Schema profile: data type, semantic type, cardinality, nulls, size, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.columns import (
    BOOLEAN, DATETIME, NUMERIC, STRING, col, percent, select_columns, stack, type_class,
)
from . import frequency as fq
from .statistics import CATEGORICAL_RATIO, value_counts_summary

# Cardinality limits (distinct share) and the semantic rules, first match wins.
HIGH_CARDINALITY = 0.5
MEDIUM_CARDINALITY = 0.1
SEMANTIC_SHARE = 0.8
SEMANTIC_SAMPLE = 100
NUMERIC_NAME_RULES = [
    ("id", ["id"]),
    ("currency", ["price", "cost", "amount"]),
    ("percentage", ["percent", "pct", "rate"]),
    ("coordinate", ["lat", "lon", "lng"]),
]
TEXT_NAME_RULES = [
    ("email", ["email"]),
    ("url", ["url", "link", "website"]),
    ("phone", ["phone", "tel", "mobile"]),
    ("zipcode", ["zip", "postal"]),
    ("ip_address", ["ip"]),
]
VALUE_PATTERNS = [
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("url", r"^https?://[^\s]+$"),
    ("phone", r"^[\+]?[(]?[0-9]{1,4}[)]?[-\s\.]?[(]?[0-9]{1,4}[)]?[-\s\.]?[0-9]{1,9}$"),
    ("ip_address", r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"),
    ("zipcode", r"^[0-9]{5}(-[0-9]{4})?$"),
]

_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
    T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


def name_rule(name: str, rules: list[tuple[str, list[str]]]) -> str | None:
    """The first rule with a word inside the lower-cased column name."""
    lower = name.lower()
    return next((kind for kind, words in rules if any(w in lower for w in words)), None)


def size_in_bytes(df: DataFrame, name: str) -> Column:
    """Bytes one cell takes: fixed width, text bytes plus an 8-byte offset, or element widths."""
    kind = df.schema[name].dataType
    if type_class(kind) == STRING or isinstance(kind, T.BinaryType):
        return F.coalesce(F.octet_length(col(name)), F.lit(0)).cast("bigint") + F.lit(8)
    if isinstance(kind, T.ArrayType):
        width = _WIDTHS.get(type(kind.elementType), 8)
        return F.greatest(F.coalesce(F.size(col(name)), F.lit(0)), F.lit(0)).cast("bigint") * F.lit(width)
    return F.lit(_WIDTHS.get(type(kind), 8)).cast("bigint")


def column_size(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, size_bytes, memory_mb)`` by the definition in :func:`size_in_bytes`."""
    names = select_columns(df, columns)
    sums = df.agg(*[F.sum(size_in_bytes(df, c)).alias(f"s{i}") for i, c in enumerate(names)])
    return stack(
        sums,
        [[F.lit(c), F.coalesce(F.col(f"s{i}"), F.lit(0).cast("bigint"))] for i, c in enumerate(names)],
        "column string, size_bytes bigint",
    ).withColumn("memory_mb", F.col("size_bytes") / F.lit(1048576.0))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, null_count, null_percentage)``."""
    table = value_counts_summary(df, select_columns(df, columns))
    return table.select(
        "column", "null_count",
        percent(F.col("null_count"), F.col("count") + F.col("null_count")).alias("null_percentage"),
    )


def first_rows(df: DataFrame, columns: Sequence[str], n: int, order_by: Sequence[str] | None) -> DataFrame:
    """``(column_id, position, value)``: the first n non-null values of each column, as text.

    Without ``order_by`` the smallest values stand for the first ones, so the result is repeatable.
    Each partition keeps n rows per column; nothing larger is shuffled.
    """
    keys = list(order_by or [])
    cells = F.array(*[F.struct(F.lit(i).alias("column_id"), fq.value_text(df, c).alias("value")) for i, c in enumerate(columns)])
    long = df.select(*[col(k).alias(f"key{j}") for j, k in enumerate(keys)], F.explode(cells).alias("cell"))
    long = long.select("cell.*", *[f"key{j}" for j in range(len(keys))]).where(F.col("value").isNotNull())
    order = W.partitionBy("column_id").orderBy(*[f"key{j}" for j in range(len(keys))], "value")
    return (
        long.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= n)
        .select("column_id", "position", "value")
    )


def sample_values(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = 5, order_by: Sequence[str] | None = None
) -> DataFrame:
    """``(column, position, value)`` of the first n non-null values per column."""
    names = select_columns(df, columns)
    labels = df.sparkSession.createDataFrame(list(enumerate(names)), "column_id int, column string")
    return first_rows(df, names, n, order_by).join(F.broadcast(labels), "column_id").drop("column_id")


def pattern_shares(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] | None) -> DataFrame:
    """``(column_id, email, url, ...)``: share of values matching each pattern.

    Over the first 100 values when an order is given, over all values otherwise.
    """
    if order_by:
        long = first_rows(df, columns, SEMANTIC_SAMPLE, order_by)
    else:
        long = fq.text_long(df, columns).where(F.col("value").isNotNull())
    return long.groupBy("column_id").agg(
        *[F.avg(F.col("value").rlike(p).cast("double")).alias(kind) for kind, p in VALUE_PATTERNS]
    )


def cardinality(unique: Column, total: Column) -> Column:
    share = unique / F.nullif(total, F.lit(0)).cast("double")
    return (
        F.when((total == 0) | (unique == 1), "constant")
        .when(unique == total, "unique")
        .when(share > HIGH_CARDINALITY, "high")
        .when(share > MEDIUM_CARDINALITY, "medium")
        .otherwise("low")
    )


def detect_schema(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
    approx: bool = False,
) -> DataFrame:
    """One row per column: types, distinct count, cardinality, nulls, size, five sample values."""
    names = select_columns(df, columns)
    classes = {c: type_class(df.schema[c].dataType) for c in names}
    texts = [c for c in names if classes[c] == STRING]
    facts = df.sparkSession.createDataFrame(
        [
            (
                i, c, df.schema[c].dataType.simpleString(), classes[c],
                name_rule(c, NUMERIC_NAME_RULES) if classes[c] == NUMERIC else None,
                name_rule(c, TEXT_NAME_RULES) if classes[c] == STRING else None,
            )
            for i, c in enumerate(names)
        ],
        "column_id int, column string, dtype string, class string, number_rule string, text_rule string",
    )
    counts = value_counts_summary(df, names).drop("column")
    sizes = column_size(df, names).select("column", "memory_mb")
    samples = (
        first_rows(df, names, 5, order_by)
        .groupBy("column_id")
        # five values at most
        .agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("s"))
        .select("column_id", F.col("s.value").alias("sample_values"))
    )
    out = (
        facts.join(F.broadcast(counts), "column_id")
        .join(F.broadcast(fq.distinct_ids(df, names, approx)), "column_id", "left")
        .join(F.broadcast(sizes), "column")
        .join(F.broadcast(samples), "column_id", "left")
    )
    if texts:
        positions = F.array(*[F.lit(names.index(c)) for c in texts])
        shares = pattern_shares(df, texts, order_by).withColumn(
            "column_id", F.element_at(positions, F.col("column_id") + 1)
        )
        out = out.join(F.broadcast(shares), "column_id", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(kind) for kind, _ in VALUE_PATTERNS])
    maps = [c for c in names if isinstance(df.schema[c].dataType, T.MapType)]
    unique = F.coalesce(F.col("unique_count"), F.when(~F.col("column").isin(maps), F.lit(0).cast("bigint")))
    by_value = F.lit("none")
    for kind, _ in reversed(VALUE_PATTERNS):
        by_value = F.when(F.col(kind) > SEMANTIC_SHARE, kind).otherwise(by_value)
    data_type = (
        F.when(
            F.col("class") == STRING,
            F.when(
                (F.col("count") > 0) & (F.col("unique_count") <= F.col("count") * CATEGORICAL_RATIO), "categorical"
            ).otherwise("text"),
        )
        .when(F.col("class").isin(NUMERIC, BOOLEAN, DATETIME), F.col("class"))
        .otherwise("unknown")
    )
    semantic = (
        F.when(F.col("count") == 0, "none")
        .when(F.col("class") == NUMERIC, F.coalesce("number_rule", F.lit("none")))
        .when(F.col("class") == STRING, F.coalesce(F.col("text_rule"), by_value))
        .otherwise("none")
    )
    return out.select(
        "column",
        "dtype",
        data_type.alias("data_type"),
        semantic.alias("semantic_type"),
        unique.alias("unique_count"),
        cardinality(unique, F.col("count")).alias("cardinality"),
        "null_count",
        percent(F.col("null_count"), F.col("count") + F.col("null_count")).alias("null_percentage"),
        "memory_mb",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def semantic_type(
    df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None
) -> DataFrame:
    """``(column, semantic_type)`` without the distinct counts and samples of the full profile.

    The rules see strings only, whether categorical or text, so no distinct count is needed.
    """
    names = select_columns(df, columns)
    classes = {c: type_class(df.schema[c].dataType) for c in names}
    by_name = {
        c: name_rule(c, NUMERIC_NAME_RULES if classes[c] == NUMERIC else TEXT_NAME_RULES)
        for c in names
        if classes[c] in (NUMERIC, STRING)
    }
    unknown = [c for c in names if classes[c] == STRING and by_name[c] is None]
    rules = df.sparkSession.createDataFrame(
        [(i, c, by_name.get(c)) for i, c in enumerate(names)], "column_id int, column string, rule string"
    )
    out = rules.join(F.broadcast(value_counts_summary(df, names).drop("column")), "column_id")
    kind = F.coalesce(F.col("rule"), F.lit("none"))
    if unknown:
        positions = F.array(*[F.lit(names.index(c)) for c in unknown])
        shares = pattern_shares(df, unknown, order_by).withColumn(
            "column_id", F.element_at(positions, F.col("column_id") + 1)
        )
        out = out.join(F.broadcast(shares), "column_id", "left")
        by_value = F.lit("none")
        for label, _ in reversed(VALUE_PATTERNS):
            by_value = F.when(F.col(label) > SEMANTIC_SHARE, label).otherwise(by_value)
        kind = F.coalesce(F.col("rule"), by_value)
    return out.select("column", F.when(F.col("count") == 0, "none").otherwise(kind).alias("semantic_type"))


def type_distribution(schema: DataFrame) -> DataFrame:
    """``(data_type, columns)`` from a :func:`detect_schema` result."""
    return schema.groupBy("data_type").agg(F.count(F.lit(1)).alias("columns"))


def schema_summary(df: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """One row: totals, columns with nulls, names of the columns with high or unique cardinality."""
    table = detect_schema(df) if schema is None else schema
    rows = df.select(F.count(F.lit(1))).scalar()
    summary = table.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.coalesce(F.sum("memory_mb"), F.lit(0.0)).alias("total_memory_mb"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
        # bounded by the number of columns
        F.array_sort(
            F.collect_list(F.when(F.col("cardinality").isin("high", "unique"), F.col("column")))
        ).alias("high_cardinality_columns"),
    )
    return summary.select(
        "total_columns", rows.alias("total_rows"), "total_memory_mb", "columns_with_nulls", "high_cardinality_columns"
    )
