"""Arrow IPC files (``.arrow``, ``.feather``) as a Spark data source.

Spark's own file listing finds the files, so globs, folders, ``s3a://`` and paths on the default file system mean what they
mean to every other reader.  A Spark job reads the footers, one row per file; runs of record
batches are the input partitions, read on executors.  Files in stream format, which have no
footer, are one partition each.  Only the columns asked for are read; with filters the columns that they compare are read
first, and a batch in which no row passes is skipped.  Filters are a parameter of the scan: a reader that Spark has pushed
filters to keeps them for later queries of the same DataFrame, which then miss rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.columns import col
from .delimited import split_bytes

SUFFIXES = (".arrow", ".feather")
SCHEMES = {"s3a": "s3", "s3n": "s3"}  # Hadoop's names of file systems that Arrow calls otherwise
STREAM = -1  # instead of a number of batches
COMPARISONS = {"=": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
TESTS = (*COMPARISONS, "in", "is null", "is not null")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path as Spark lists it, and the path there."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{quote(rest, safe='/:@')}")


@contextmanager
def opened(uri: str):
    fs, path = file_system(uri)
    with fs.open_input_file(path) as handle:
        yield handle


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the files of a file, folder or glob path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    if any(ch in path for ch in "*?[{"):
        return found
    named = F.col("path").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1])
    return found.where(named | F.lower("path").rlike("(" + "|".join(rf"\{s}" for s in SUFFIXES) + ")$"))


def _footers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            with opened(row["path"]) as handle:
                try:
                    reader = pa.ipc.open_file(handle)
                    count = reader.num_record_batches
                except pa.ArrowInvalid:
                    handle.seek(0)
                    reader, count = pa.ipc.open_stream(handle), STREAM
                rows.append({**row, "batches": count, "arrow": reader.schema.serialize().to_pybytes()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("length", pa.int64()), ("batches", pa.int32()), ("arrow", pa.binary())]))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, batches, arrow)``: one row per file with its batches (-1: stream format) and its serialized schema."""
    return files_of(spark, path).mapInArrow(_footers, "path string, length bigint, batches int, arrow binary")


def _plain(schema: pa.Schema) -> pa.Schema:
    """Dictionary columns under their value type, which is how Spark sees them."""
    fields = [f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in schema]
    return pa.schema(fields)


class BatchPartition(InputPartition):
    """Batches ``first`` to ``past`` of a file; all of a stream."""

    def __init__(self, file: str, first: int, past: int):
        self.file, self.first, self.past = file, first, past


def condition(filters: Sequence[tuple]) -> Column:
    """The filters ``(column, test, value)`` as Spark evaluates them, all of them together."""
    found = F.lit(True)
    for name, test, *value in filters:
        c = col(name)
        if test not in TESTS:
            raise ValueError(f"unknown test {test}; known are {', '.join(TESTS)}")
        if test in ("is null", "is not null"):
            one = c.isNull() if test == "is null" else c.isNotNull()
        elif test == "in":
            one = c.isin(*value[0])
        else:
            v = F.lit(value[0])
            one = {"=": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[test]
        found &= one
    return found


def passing(table: pa.Table, filters: Sequence[Sequence]) -> pa.ChunkedArray | None:
    """Rows that may pass: never fewer than Spark keeps.

    NaN is larger than any number and equal to itself in Spark, so a row with NaN stays, and comparing with NaN leaves all rows.
    Values that the column's type cannot hold, such as a fraction for integers, leave all rows as well.
    """
    mask = None
    for name, test, *value in filters:
        column = table.column(name)
        if test in ("is null", "is not null"):
            one = pc.is_null(column) if test == "is null" else pc.is_valid(column)
        else:
            floating = pa.types.is_floating(column.type)
            column = column.cast(pa.float64()) if floating else column  # as Spark compares
            given = [v for v in (value[0] if test == "in" else value) if v is not None]
            texts = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
            if any(isinstance(v, str) != texts for v in given):
                continue
            try:
                values = pa.array(given).cast(column.type)
            except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError, OverflowError):
                continue
            if floating and pc.any(pc.is_nan(values)).as_py():
                continue
            if test == "in":
                one = pc.is_in(column, value_set=values)
            else:
                one = COMPARISONS[test](column, values[0] if len(values) else pa.scalar(None, column.type))
            if floating:
                one = pc.or_(pc.fill_null(one, False), pc.fill_null(pc.is_nan(column), False))
        one = pc.fill_null(one, False)
        mask = one if mask is None else pc.and_(mask, one)
    return mask


class ArrowReader(DataSourceReader):
    def __init__(self, files: list, schema: T.StructType, split: int, filters: Sequence[Sequence] = ()):
        self.files, self.schema, self.split, self.filters = files, schema, split, filters

    def partitions(self) -> list[BatchPartition]:
        parts = []
        for file, length, batches in self.files:
            if batches == STREAM:
                parts.append(BatchPartition(file, 0, STREAM))
                continue
            run = max(1, self.split * batches // max(length, 1))
            parts += [BatchPartition(file, b, min(b + run, batches)) for b in range(0, batches, run)]
        return parts

    def _tables(self, handle, partition: BatchPartition, names: set[str]):
        """Functions that read the batches of a partition, each for some columns: only their buffers are read."""
        if partition.past == STREAM:
            for batch in pa.ipc.open_stream(handle):
                yield lambda chosen, batch=batch: pa.Table.from_batches([batch]).select([c for c in batch.schema.names if c in chosen])
            return
        known = pa.ipc.open_file(handle).schema.names
        readers = {}

        def read(chosen, number):
            key = frozenset(chosen)
            if key not in readers:
                fields = [i for i, c in enumerate(known) if c in key]
                readers[key] = pa.ipc.open_file(handle, options=pa.ipc.IpcReadOptions(included_fields=fields))
            return pa.Table.from_batches([readers[key].get_batch(number)])

        if not any(c in names for c in known):  # no column is asked for, only how many rows there are
            names |= set(known[:1])
        for number in range(partition.first, partition.past):
            yield lambda chosen, number=number: read(chosen, number)

    def read(self, partition: BatchPartition) -> Iterator[pa.RecordBatch]:
        names = self.schema.fieldNames()
        with opened(partition.file) as handle:
            wanted = set(names)
            for load in self._tables(handle, partition, wanted):
                mask = None
                if self.filters:
                    compared = load({f[0] for f in self.filters})
                    compared = compared.cast(_plain(compared.schema))
                    there = [f for f in self.filters if f[0] in compared.column_names]
                    mask = passing(compared, there)
                    if mask is not None and not pc.any(mask).as_py():
                        continue
                table = load(wanted)
                table = table.cast(_plain(table.schema))
                table = table if mask is None else table.filter(mask)
                rows = table.num_rows
                columns = [table.column(c) if c in table.column_names else pa.nulls(rows, self.arrow_type(c)) for c in names]
                yield from pa.Table.from_arrays(columns, names=names).to_batches()

    def arrow_type(self, name: str) -> pa.DataType:
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(self.schema[name].dataType)


class ArrowDataSource(DataSource):
    """Reads files whose footers are known: ``files`` is a list of (path, bytes, batches), ``split`` the bytes of a partition, ``filters`` of (column, test, value)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def reader(self, schema) -> ArrowReader:
        return ArrowReader(json.loads(self.options["files"]), schema, int(self.options["split"]), json.loads(self.options["filters"]))


def read_arrow(spark: SparkSession, path: str, columns: Sequence[str] | None = None, split: int | None = None, filters: Sequence[tuple] = ()) -> DataFrame:
    """The files of ``path`` under the schema of the first one; columns that a file lacks are null, as in Spark's readers."""
    found = footers(spark, path)
    rows = sorted(found.select("path", "length", "batches").collect())  # one row per file, as Spark's own listing
    if not rows:
        raise FileNotFoundError(path)
    first = found.where(F.col("path") == rows[0].path).select("arrow").first().arrow
    schema = from_arrow_schema(_plain(pa.ipc.read_schema(pa.py_buffer(first))), prefer_timestamp_ntz=True)
    names = schema.fieldNames() if columns is None else [c for c in columns if c in schema.fieldNames()]
    read = T.StructType([f for f in schema if f.name in names or f.name in {name for name, *_ in filters}])
    if split is None:
        share = sum(r.length for r in rows) // spark.sparkContext.defaultParallelism
        split = max(1, min(share, split_bytes(spark)))
    spark.dataSource.register(ArrowDataSource)
    options = {"files": json.dumps([list(r) for r in rows]), "split": str(split), "filters": json.dumps([list(f) for f in filters if _plain_value(f)])}
    found = spark.read.format("arrow_ipc").schema(read).options(**options).load()
    return found.where(condition(filters)).select(*[col(c) for c in names]) if filters else found.select(*[col(c) for c in names])


def _plain_value(filter: tuple) -> bool:
    """Whether the reader can compare the filter's value; Spark alone evaluates the others, such as dates and decimals."""
    values = filter[2] if filter[1] == "in" else filter[2:]
    return all(v is None or isinstance(v, bool | int | float | str) for v in values)
