"""Reading data sets: format by suffix, delimited text with null tokens and type inference."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import STRING, col, columns_of, stack
from ..operators.quality import duplicate_names, unnamed_columns
from .arrow import read_arrow
from .delimited import largest_file, read_in_splits, split_bytes

# Suffixes, null tokens, rows the type inference looks at.
FORMATS = {
    ".csv": "csv",
    ".txt": "csv",
    ".tsv": "tsv",
    ".json": "json",
    ".jsonl": "jsonl",
    ".ndjson": "jsonl",
    ".parquet": "parquet",
    ".pq": "parquet",
    ".arrow": "arrow",
    ".feather": "arrow",
}
NULL_TOKENS = ["NA", "N/A", "null", "NULL", ""]

_INTEGER = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"^[+-]?(inf|Inf|INF|nan|NaN|NAN)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$"


def detect_format(path: str) -> str:
    """Format by suffix; delimited text when the suffix says nothing."""
    name = path.rstrip("/*").rsplit("/", 1)[-1].lower()
    suffix = "." + name.rsplit(".", 1)[-1] if "." in name else ""
    return FORMATS.get(suffix, "csv")


def load_dataset(
    spark: SparkSession, path: str, format: str | None = None, columns: Sequence[str] | None = None, **options
) -> DataFrame:
    """Read a file, folder or glob; ``options`` go to the Spark reader."""
    kind = format or detect_format(path)
    readers = {
        "csv": scan_csv, "tsv": scan_tsv, "json": scan_json, "jsonl": scan_ndjson, "parquet": scan_parquet,
        "arrow": scan_arrow, "feather": scan_arrow,
    }
    if kind not in readers:
        raise ValueError(f"unknown format {kind}")
    if readers[kind] is scan_arrow and columns:
        options = {"columns": columns, **options}
    df = readers[kind](spark, path, **options)
    return df.select(*[col(c) for c in columns if c in df.columns]) if columns else df


def scan_text(spark: SparkSession, path: str, sep: str = ",", split: int | None = None, **options) -> DataFrame:
    """Delimited text as strings, null tokens already null; malformed rows raise.

    Quoted cells may hold separators, doubled quotes and line breaks.  Files larger than one split (``split`` bytes, Spark's
    ``spark.sql.files.maxPartitionBytes`` if not given) are read by many tasks (:mod:`.delimited`), smaller ones whole, with equal results.  Other
    encodings than UTF-8, escapes other than the doubled quote and an explicit ``multiLine=True`` read whole files;
    ``multiLine=False`` takes every line for a record.
    """
    settings = {"header": True, "sep": sep, "mode": "FAILFAST", "quote": '"', "escape": '"', "multiLine": True, **options}
    raw = spark.read.options(**settings).csv(path)
    plain = not {"multiLine", "encoding", "charset", "lineSep", "schema", "comment"} & set(options) and settings["escape"] == settings["quote"] != ""
    if plain and settings["mode"] == "FAILFAST" and largest_file(spark, path) > (split or split_bytes(spark)):
        extra = {k: v for k, v in options.items() if k not in ("header", "sep", "mode", "quote", "escape")}
        header = str(settings["header"]).lower() == "true"
        raw = read_in_splits(spark, path, raw.columns, sep, settings["quote"], header, extra, split)
    return raw.select(*[F.when(~col(c).isin(NULL_TOKENS), col(c)).alias(c) for c in raw.columns])


def scan_csv(spark: SparkSession, path: str, infer_rows: int | None = None, sep: str = ",", **options) -> DataFrame:
    """Comma-separated text with inferred types."""
    return infer_types(scan_text(spark, path, sep, **options), infer_rows)


def scan_tsv(spark: SparkSession, path: str, infer_rows: int | None = None, **options) -> DataFrame:
    """Tab-separated text with inferred types."""
    return scan_csv(spark, path, infer_rows, "\t", **options)


TYPES = ["bigint", "double", "boolean", "date", "timestamp_ntz"]  # in the order they are tried; bit k of a mask stands for type k
_BIGINT, _DOUBLE, _BOOLEAN, _DAY, _INSTANT = (1 << k for k in range(len(TYPES)))


def _fitting(c: Column) -> Column:
    """The types that a cell fits, as a bit mask; null where there is no value.

    The classes exclude each other, so a cell is looked at until its class is found: numbers with one pattern.
    """

    def if_cast(kind: str, bits: int) -> Column:
        return F.when(c.try_cast(kind).isNotNull(), bits).otherwise(0)

    return (
        F.when(c.isNull(), None)
        .when(c.rlike(_INTEGER), if_cast("bigint", _BIGINT).bitwiseOR(F.lit(_DOUBLE)))
        .when(c.rlike(_FLOAT) | c.rlike(_SPECIAL), if_cast("double", _DOUBLE))
        .when(F.lower(c).isin("true", "false"), _BOOLEAN)
        .when(c.rlike(_DATE), if_cast("date", _DAY).bitwiseOR(if_cast("timestamp_ntz", _INSTANT)))
        .when(c.rlike(_TIMESTAMP), if_cast("timestamp_ntz", _INSTANT))
        .otherwise(0)
    )


def infer_types(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cast string columns to the first type that every value fits.

    One aggregation decides, one bit mask a column that every cell narrows, over all rows, or over the first ``rows`` if given: then a later value that does not
    fit raises when it is read (ANSI cast).  Columns without values stay strings.
    """
    names = columns_of(df, STRING)
    if not names:
        return df
    seen = df.select(*[col(c) for c in names])
    found = (seen if rows is None else seen.limit(rows)).agg(*[F.bit_and(_fitting(col(c))).alias(f"m{i}") for i, c in enumerate(names)]).first()
    types = {c: next((t for k, t in enumerate(TYPES) if (found[f"m{i}"] or 0) >> k & 1), "string") for i, c in enumerate(names)}
    return df.select(*[col(c).cast(types[c]).alias(c) if types.get(c, "string") != "string" else col(c) for c in df.columns])


def inferred_types(df: DataFrame) -> DataFrame:
    """``(column, dtype)`` of a loaded table."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def scan_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def scan_ndjson(spark: SparkSession, path: str, **options) -> DataFrame:
    """One JSON document per line."""
    return spark.read.options(**options).json(path)


def scan_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files that are one JSON document or array each."""
    return spark.read.options(multiLine=True, **options).json(path)


def scan_arrow(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, split: int | None = None, filters: Sequence[tuple] = ()
) -> DataFrame:
    """Arrow IPC files, read in runs of record batches: a partition has one batch at least and about ``split`` bytes at most.

    Without ``split`` there are as many partitions as cores, or more where they would pass ``spark.sql.files.maxPartitionBytes``.
    Only ``columns`` are read if given; names that are not there are left out.  ``filters`` are ``(column, test, value)`` with
    the tests ``=``, ``<``, ``<=``, ``>``, ``>=``, ``in``, ``is null`` and ``is not null``; rows must pass all of them, as Spark
    compares, and a batch is read whole only if a row of it may pass.
    """
    return read_arrow(spark, path, columns, split, filters)


def invalid_utf8_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, invalid_rows)``: cells holding the replacement character left by lossy decoding."""
    names = columns_of(df, STRING, columns=columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, invalid_rows bigint")
    counts = df.agg(*[F.count_if(F.contains(col(c), F.lit("�"))).alias(f"u{i}") for i, c in enumerate(names)])
    return stack(counts, [[F.lit(c), F.col(f"u{i}")] for i, c in enumerate(names)], "column string, invalid_rows bigint")


def file_size(spark: SparkSession, path: str, format: str) -> DataFrame:
    """One row: files and bytes behind ``path``, from the file listing."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents are not read
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("bytes"))


def preview_dataset(spark: SparkSession, path: str, n_rows: int = 5, format: str | None = None) -> dict[str, DataFrame]:
    """Facts about the file, its columns, and its first rows."""
    kind = format or detect_format(path)
    df = load_dataset(spark, path, kind)
    facts = file_size(spark, path, kind).select(
        F.lit(path).alias("file_path"),
        (F.col("bytes") / 1048576.0).alias("file_size_mb"),
        F.lit(kind).alias("format"),
        F.lit(len(df.columns)).alias("columns"),
    )
    columns = spark.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, column string, dtype string"
    )
    return {"info": facts, "columns": columns, "rows": df.limit(n_rows)}


def raw_header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names as written in the first line; Spark renames duplicates when it reads them."""
    first = spark.read.options(header=False, sep=sep, mode="PERMISSIVE").csv(path).limit(1).collect()
    return [str(v) for v in first[0]] if first else []


def validate_dataset(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``(check, detail)`` warnings: no rows, no columns, duplicate names, unnamed columns."""
    header = list(names) if names is not None else df.columns
    found = []
    if header and df.isEmpty():
        found.append(("empty", "0 rows"))
    if not header:
        found.append(("no_columns", "0 columns"))
    if duplicate_names(header):
        found.append(("duplicate_columns", ", ".join(duplicate_names(header))))
    if unnamed_columns(header):
        found.append(("unnamed_columns", str(len(unnamed_columns(header)))))
    return df.sparkSession.createDataFrame(found, "check string, detail string")


INFO_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("format", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("columns", T.IntegerType()),
        T.StructField("column_names", T.ArrayType(T.StringType())),
        T.StructField("load_time_seconds", T.DoubleType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)


def dataset_info(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """One row about a data set: rows, columns, names, size, format, load seconds, warnings."""
    started = time.time()
    kind = format or detect_format(path)
    df = load_dataset(spark, path, kind, **options)
    names = raw_header(spark, path, "\t" if kind == "tsv" else ",") if kind in ("csv", "tsv") else df.columns
    rows = df.count()
    size = file_size(spark, path, kind).first()["bytes"] / 1048576.0
    warnings = [f"{r.check}: {r.detail}" for r in validate_dataset(df, names).collect()]
    if kind in ("csv", "tsv"):
        lossy = invalid_utf8_rows(df).agg(F.coalesce(F.sum("invalid_rows"), F.lit(0)).alias("n")).first()["n"]
        if lossy:
            warnings.append(f"invalid_utf8: {lossy} cells")
    row = (path, size, kind, rows, len(df.columns), list(names), time.time() - started, warnings)
    return spark.createDataFrame([row], INFO_SCHEMA)
