"""Column statistics: numeric, categorical, datetime and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import (
    BOOLEAN, DATETIME, NUMERIC, STRING, as_double, col, columns_of, name_rows, numeric_columns, numeric_long,
    percent, ratio, select_columns, stack, type_class,
)
from . import frequency as fq
from .quantiles import wide_quantiles

# Fixed value: largest distinct share of a categorical column.
CATEGORICAL_RATIO = 0.05
TOP_VALUES = 10

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def moment_ids(long: DataFrame) -> DataFrame:
    """The moments pass: one grouped aggregation over ``long(column_id, x)``.

    Skewness and excess kurtosis are the population values (null for constant columns).
    """
    x = F.col("x")
    return long.groupBy("column_id").agg(
        F.count("x").alias("count"),
        F.count_if(x.isNull()).alias("null_count"),
        F.avg("x").alias("mean"),
        F.var_samp("x").alias("variance"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.sum("x").alias("sum"),
        F.skewness("x").alias("skew_pop"),
        F.kurtosis("x").alias("kurt_pop"),
        F.count_if(x == 0).alias("zero_count"),
        F.count_if(x < 0).alias("negative_count"),
        F.count_if(x > 0).alias("positive_count"),
    )


def sample_skewness(skew: Column, n: Column) -> Column:
    """Third central moment over the cubed *sample* deviation; 0 below three values or without spread."""
    factor = F.pow((n - 1) / F.nullif(n, F.lit(0)).cast("double"), F.lit(1.5))
    return F.when(n < 3, 0.0).otherwise(F.coalesce(skew * factor, F.lit(0.0)))


def sample_kurtosis(kurt: Column, n: Column) -> Column:
    """Fourth central moment over the fourth power of the sample deviation, minus three."""
    factor = F.pow((n - 1) / F.nullif(n, F.lit(0)).cast("double"), F.lit(2.0))
    return F.when(n < 4, 0.0).otherwise(F.coalesce((kurt + 3) * factor - 3, F.lit(0.0)))


def numeric_modes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column_id, mode, mode_count)`` as double, from one frequency table.

    Integers are counted as bigint beside the doubles, so integers above 2^53 stay apart.
    """
    null_x, null_k = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    rows = []
    for i, c in enumerate(names):
        whole = isinstance(df.schema[c].dataType, _INTEGERS)
        rows.append([F.lit(i), null_x if whole else as_double(c), col(c).cast("bigint") if whole else null_k])
    long = stack(df, rows, "column_id int, x double, k bigint").where(F.coalesce(F.col("x"), F.col("k")).isNotNull())
    counts = long.groupBy("column_id", "x", "k").agg(F.count(F.lit(1)).alias("count"))
    best = counts.groupBy("column_id").agg(F.max("count").alias("mode_count"))
    reach = counts.join(F.broadcast(best), "column_id").where(F.col("count") == F.col("mode_count"))
    return reach.groupBy("column_id", "mode_count").agg(
        F.coalesce(F.min("k").cast("double"), F.min("x")).alias("mode")
    )


def _with_ids(table: DataFrame, part: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Renumber ``column_id`` from positions in ``part`` to positions in ``names``."""
    positions = F.array(*[F.lit(list(names).index(c)) for c in part])
    return table.withColumn("column_id", F.element_at(positions, F.col("column_id") + 1))


def numeric_stats(
    df: DataFrame, columns: Sequence[str] | None = None, frequency: DataFrame | None = None
) -> DataFrame:
    """One row per numeric column: counts, moments, quartiles, mode.

    ``frequency`` is the double frequency table of the same columns when the caller has it and no
    integer is too large for it.
    """
    names = numeric_columns(df, columns)
    if not names:
        return df.sparkSession.createDataFrame([], NUMERIC_SCHEMA)
    long = numeric_long(df, names)
    table = name_rows(
        df, names,
        moment_ids(long),
        wide_quantiles(df, names, (0.25, 0.5, 0.75)),
        numeric_modes(df, names) if frequency is None else fq.modes(frequency, "x"),
    )
    return numeric_result(table)


NUMERIC_SCHEMA = (
    "column string, count bigint, null_count bigint, mean double, median double, mode double, std double, "
    "variance double, min double, max double, range double, q25 double, q50 double, q75 double, iqr double, "
    "skewness double, kurtosis double, cv double, sum double, zero_count bigint, negative_count bigint, "
    "positive_count bigint"
)


def numeric_result(table: DataFrame) -> DataFrame:
    """Final columns from joined moments, quartiles and modes; empty columns show zeros."""
    n = F.coalesce(F.col("count"), F.lit(0).cast("bigint"))

    def filled(value: Column) -> Column:
        return F.when(n == 0, F.lit(0.0)).otherwise(value)

    def tally(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name)

    std = F.sqrt("variance")
    cv = F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(ratio(std, F.col("mean")))
    return table.select(
        "column",
        n.alias("count"),
        tally("null_count"),
        filled(F.col("mean")).alias("mean"),
        filled(F.col("q50")).alias("median"),
        F.col("mode"),
        filled(std).alias("std"),
        filled(F.col("variance")).alias("variance"),
        filled(F.col("min")).alias("min"),
        filled(F.col("max")).alias("max"),
        filled(F.col("max") - F.col("min")).alias("range"),
        filled(F.col("q25")).alias("q25"),
        filled(F.col("q50")).alias("q50"),
        filled(F.col("q75")).alias("q75"),
        filled(F.col("q75") - F.col("q25")).alias("iqr"),
        filled(sample_skewness(F.col("skew_pop"), n)).alias("skewness"),
        filled(sample_kurtosis(F.col("kurt_pop"), n)).alias("kurtosis"),
        filled(cv).alias("cv"),
        filled(F.col("sum")).alias("sum"),
        tally("zero_count"),
        tally("negative_count"),
        tally("positive_count"),
    )


def _shape(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    names = numeric_columns(df, columns)
    return name_rows(df, names, moment_ids(numeric_long(df, names)))


def skewness_stat(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, skewness)`` with the sample deviation in the denominator."""
    n = F.coalesce(F.col("count"), F.lit(0))
    return _shape(df, columns).select("column", sample_skewness(F.col("skew_pop"), n).alias("skewness"))


def kurtosis_stat(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, kurtosis)`` with the sample deviation in the denominator."""
    n = F.coalesce(F.col("count"), F.lit(0))
    return _shape(df, columns).select("column", sample_kurtosis(F.col("kurt_pop"), n).alias("kurtosis"))


def mode_value(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, mode, mode_count)``, the mode as text; the smallest value wins ties."""
    names = select_columns(df, columns)
    numbers = [c for c in names if type_class(df.schema[c].dataType) == NUMERIC]
    texts = [c for c in names if c not in numbers]
    parts = []
    if numbers:
        parts.append(_with_ids(numeric_modes(df, numbers), numbers, names).withColumn("mode", F.col("mode").cast("string")))
    if texts:
        leader = fq.text_leaders(df, texts, 1)[0].select("column_id", F.col("value").alias("mode"), F.col("count").alias("mode_count"))
        parts.append(_with_ids(leader, texts, names))
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return name_rows(df, names, table).select("column", "mode", "mode_count")


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """``(column, rank, value, count, percentage)``: the k most frequent values of each column."""
    names = select_columns(df, columns)
    long = columns_of(df, STRING, columns=names) if names else []
    short = [c for c in names if c not in long]
    parts = []
    if short:  # values combine well before the shuffle
        parts.append(_with_ids(fq.top_k(fq.text_frequency(df, short), "value", k), short, names))
    if long:
        parts.append(_with_ids(fq.text_leaders(df, long, k)[0], long, names))
    best = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    totals = value_counts_summary(df, names).select("column_id", "column", F.col("count").alias("total"))
    return best.join(F.broadcast(totals), "column_id").select(
        "column", "rank", "value", "count", percent(F.col("count"), F.col("total")).alias("percentage")
    )


def entropy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, entropy)``: Shannon entropy of the non-null values, in bits."""
    names = select_columns(df, columns)
    table = fq.entropy_ids(fq.text_digest_counts(df, names))
    return name_rows(df, names, table).select("column", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def value_counts_summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column_id, column, count, null_count)`` in one plain aggregation."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]
    )
    return stack(
        counts,
        [
            [F.lit(i), F.lit(c), F.col(f"n{i}"), F.col("rows") - F.col(f"n{i}")]
            for i, c in enumerate(names)
        ],
        "column_id int, column string, count bigint, null_count bigint",
    )


def categorical_names(df: DataFrame, columns: Sequence[str] | None = None, limit: float = CATEGORICAL_RATIO) -> list[str]:
    """String columns with at least one value and a distinct share of at most ``limit``.

    The decision is one row per string column, so it is taken on the driver.
    """
    names = columns_of(df, STRING, columns=columns)
    if not names:
        return []
    share = value_counts_summary(df, names).join(F.broadcast(fq.distinct_ids(df, names)), "column_id")
    rows = share.where((F.col("count") > 0) & (F.col("unique_count") <= F.col("count") * limit)).collect()
    found = {r.column for r in rows}
    return [c for c in names if c in found]


def statistics_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Column names per kind of statistics; booleans count as categorical."""
    names = select_columns(df, columns)
    classes = {c: type_class(df.schema[c].dataType) for c in names}
    categorical = set(categorical_names(df, [c for c in names if classes[c] == STRING])) if STRING in classes.values() else set()
    return {
        "numeric": [c for c in names if classes[c] == NUMERIC],
        "categorical": [c for c in names if classes[c] == BOOLEAN or c in categorical],
        "datetime": [c for c in names if classes[c] == DATETIME],
        "text": [c for c in names if classes[c] == STRING and c not in categorical],
    }


CATEGORICAL_SCHEMA = (
    "column string, count bigint, null_count bigint, unique_count bigint, mode string, mode_frequency bigint, "
    "mode_percentage double, entropy double, is_unique boolean"
)


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per categorical column; the ten most frequent values are :func:`top_values`."""
    names = columns if columns is not None else statistics_kinds(df)["categorical"]
    if not names:
        return df.sparkSession.createDataFrame([], CATEGORICAL_SCHEMA)
    counts = fq.text_frequency(df, names)
    summary = counts.groupBy("column_id").agg(F.count(F.lit(1)).alias("unique_count"))
    zero = F.lit(0).cast("bigint")
    return (
        value_counts_summary(df, names)
        .join(F.broadcast(summary), "column_id", "left")
        .join(F.broadcast(fq.modes(counts, "value")), "column_id", "left")
        .join(F.broadcast(fq.entropy_ids(counts)), "column_id", "left")
        .select(
            "column",
            "count",
            "null_count",
            F.coalesce("unique_count", zero).alias("unique_count"),
            "mode",
            F.coalesce("mode_count", zero).alias("mode_frequency"),
            percent(F.coalesce("mode_count", zero), F.col("count")).alias("mode_percentage"),
            F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
            ((F.col("count") > 0) & (F.col("unique_count") == F.col("count"))).alias("is_unique"),
        )
        .withColumn("is_unique", F.coalesce("is_unique", F.lit(False)))
    )


DATETIME_SCHEMA = (
    "column string, count bigint, null_count bigint, min string, max string, range_days double, mode string, "
    "unique_count bigint"
)


def datetime_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per date, timestamp or time column; values as text, range in whole days."""
    names = columns_of(df, DATETIME, columns=columns)
    if not names:
        return df.sparkSession.createDataFrame([], DATETIME_SCHEMA)
    ends = df.agg(
        *[F.min(col(c)).alias(f"a{i}") for i, c in enumerate(names)],
        *[F.max(col(c)).alias(f"b{i}") for i, c in enumerate(names)],
    )

    def days(i: int, c: str) -> Column:
        if not isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(None).cast("double")
        return F.timestamp_diff("DAY", F.col(f"a{i}"), F.col(f"b{i}")).cast("double")

    bounds = stack(
        ends,
        [
            [F.lit(i), F.col(f"a{i}").cast("string"), F.col(f"b{i}").cast("string"), days(i, c)]
            for i, c in enumerate(names)
        ],
        "column_id int, min string, max string, range_days double",
    )
    common = None
    for kind in dict.fromkeys(df.schema[c].dataType.simpleString() for c in names):  # values keep their type
        same = [c for c in names if df.schema[c].dataType.simpleString() == kind]
        long = stack(df, [[F.lit(names.index(c)), col(c)] for c in same], f"column_id int, value {kind}")
        counts = long.where(F.col("value").isNotNull()).groupBy("column_id", "value").agg(F.count(F.lit(1)).alias("count"))
        unique = counts.groupBy("column_id").agg(F.count(F.lit(1)).alias("unique_count"))
        part = unique.join(F.broadcast(fq.modes(counts, "value")), "column_id").select(
            "column_id", "unique_count", F.col("mode").cast("string").alias("mode")
        )
        common = part if common is None else common.unionByName(part)
    return (
        value_counts_summary(df, names)
        .join(F.broadcast(bounds), "column_id")
        .join(F.broadcast(common), "column_id", "left")
        .select(
            "column", "count", "null_count", "min", "max", "range_days", "mode",
            F.coalesce("unique_count", F.lit(0).cast("bigint")).alias("unique_count"),
        )
    )


TEXT_SCHEMA = (
    "column string, count bigint, null_count bigint, unique_count bigint, mode string, avg_length double, "
    "min_length int, max_length int, empty_count bigint"
)


def text_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: lengths in characters, distinct values, mode."""
    names = columns if columns is not None else statistics_kinds(df)["text"]
    if not names:
        return df.sparkSession.createDataFrame([], TEXT_SCHEMA)
    lengths = stack(
        df,
        [[F.lit(i), F.char_length(col(c).cast("string"))] for i, c in enumerate(names)],
        "column_id int, n int",
    )
    sizes = lengths.groupBy("column_id").agg(
        F.count("n").alias("count"),
        F.count_if(F.col("n").isNull()).alias("null_count"),
        F.avg("n").alias("avg_length"),
        F.min("n").alias("min_length"),
        F.max("n").alias("max_length"),
        F.count_if(F.col("n") == 0).alias("empty_count"),
    )
    zero = F.lit(0).cast("bigint")
    leaders, unique = fq.text_leaders(df, names, 1)
    mode = leaders.select("column_id", F.col("value").alias("mode"))
    return name_rows(df, names, sizes, unique, mode).select(
        "column",
        F.coalesce("count", zero).alias("count"),
        F.coalesce("null_count", zero).alias("null_count"),
        F.coalesce("unique_count", zero).alias("unique_count"),
        "mode",
        F.coalesce("avg_length", F.lit(0.0)).alias("avg_length"),
        F.coalesce("min_length", F.lit(0)).alias("min_length"),
        F.coalesce("max_length", F.lit(0)).alias("max_length"),
        F.coalesce("empty_count", zero).alias("empty_count"),
    )


def analyze_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, frequency: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The four result tables by kind, the top values, and ``summary``: one row per column and kind."""
    kinds = statistics_kinds(df, columns)
    counted = kinds["categorical"] + kinds["text"]
    spark = df.sparkSession
    return {
        "numeric": numeric_stats(df, kinds["numeric"], frequency) if kinds["numeric"] else spark.createDataFrame([], NUMERIC_SCHEMA),
        "categorical": categorical_stats(df, kinds["categorical"]),
        "datetime": datetime_stats(df, kinds["datetime"]) if kinds["datetime"] else spark.createDataFrame([], DATETIME_SCHEMA),
        "text": text_stats(df, kinds["text"]),
        "top_values": top_values(df, counted) if counted else spark.createDataFrame(
            [], "column string, rank int, value string, count bigint, percentage double"
        ),
        "summary": spark.createDataFrame(
            [(c, kind) for kind, names in kinds.items() for c in names], "column string, kind string"
        ),
    }


def statistics_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(kind, columns)``: sorted column names per kind of statistics."""
    kinds = statistics_kinds(df, columns)
    return df.sparkSession.createDataFrame(
        [(kind, sorted(names)) for kind, names in kinds.items()], "kind string, columns array<string>"
    )
