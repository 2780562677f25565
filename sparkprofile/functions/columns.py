"""Column classes, column selection and the two reshaping helpers every operator uses.

The *long form* of a table is one row per (row, column): ``(column_id, x)``.  Grouping it by the
small integer ``column_id`` keeps the aggregation buffer narrow whatever the number of columns, so
whole-stage codegen stays on and only ``columns x partitions`` partial rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = "numeric"
BOOLEAN = "boolean"
DATETIME = "datetime"
STRING = "string"
UNKNOWN = "unknown"

_DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType) + (
    (T.TimeType,) if hasattr(T, "TimeType") else ()
)


def type_class(data_type: T.DataType) -> str:
    """Coarse class of a Spark type; nested, binary and interval types are ``unknown``."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, _DATETIME_TYPES):
        return DATETIME
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    return UNKNOWN


def col(name: str) -> Column:
    """Reference a column by its exact name (dots and back-ticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def select_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """Names to work on: the valid ones of ``columns``; all when none is valid or none is given."""
    if columns is None:
        return list(df.columns)
    valid = [c for c in columns if c in df.columns]
    return valid or list(df.columns)


def columns_of(df: DataFrame, *classes: str, columns: Iterable[str] | None = None) -> list[str]:
    """Selected columns whose type class is one of ``classes``, in schema order of the selection."""
    types = {f.name: type_class(f.dataType) for f in df.schema.fields}
    return [c for c in select_columns(df, columns) if types[c] in classes]


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return columns_of(df, NUMERIC, columns=columns)


def unique_names(names: Sequence[str]) -> list[str]:
    """Make names unique by position: ``a, a`` becomes ``a, a__2``."""
    taken, out = set(names), []
    seen: dict[str, int] = {}
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        new = name
        if seen[name] > 1:
            n = seen[name]
            while f"{name}__{n}" in taken:
                n += 1
            new = f"{name}__{n}"
            taken.add(new)
        out.append(new)
    return out


def with_unique_names(df: DataFrame) -> DataFrame:
    """The same rows under unambiguous column names."""
    if len(set(df.columns)) == len(df.columns):
        return df
    return df.toDF(*unique_names(df.columns))


def as_double(name: str) -> Column:
    """A numeric column as double; adding zero folds -0.0 into 0.0."""
    return col(name).cast("double") + F.lit(0.0)


def stack(df: DataFrame, rows: Sequence[Sequence[Column]], schema: str) -> DataFrame:
    """Every input row becomes ``len(rows)`` rows; ``schema`` names and types their cells."""
    if not rows:
        return df.sparkSession.createDataFrame([], schema)
    names = [part.split()[0] for part in schema.split(",")]
    return df.select(
        F.inline(F.array(*[F.struct(*[c.alias(n) for c, n in zip(r, names)]) for r in rows]))
    )


def numeric_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column_id, x)`` of numeric columns, nulls kept."""
    return stack(
        df,
        [[F.lit(i), as_double(c)] for i, c in enumerate(columns)],
        "column_id int, x double",
    )


def name_rows(df: DataFrame, columns: Sequence[str], *tables: DataFrame) -> DataFrame:
    """One row per column, with the per-column ``tables`` (keyed by ``column_id``) attached.

    The tables hold at most one row per column of the profiled schema, so broadcasting them is
    bounded by the schema's width, not by the data.
    """
    out = df.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(columns)], "column_id int, column string"
    )
    for table in tables:
        out = out.join(F.broadcast(table), "column_id", "left")
    return out


def ratio(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """Division that is null (or ``default``) when the denominator is zero or null."""
    out = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, zero when there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100.0
    )


def band(value: Column, bands: Sequence[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """First band whose lower limit ``value`` reaches (exceeds, when ``strict``)."""
    out = None
    for limit, label in bands:
        test = value > limit if strict else value >= limit
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)
