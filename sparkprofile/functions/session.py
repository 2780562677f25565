"""Lineage cuts: tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .columns import col

_made: dict[str, list[str]] = {}  # by application: the folders of its intermediate tables
_names: dict[str, str] = {}  # by folder: the catalog table that stands for it


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read: ``spark.checkpoint.dir``.

    A folder of our own is used only in local mode, where driver and executors are one process.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return "file:" + tempfile.mkdtemp(prefix="sparkprofile-")


def new_folder(spark: SparkSession, name: str, table: bool = False) -> str:
    """A folder of its own below the shared one; ``table`` if a catalog table of that name will stand for it."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    if table:
        _names[folder] = name
    return folder


def made_tables(spark: SparkSession) -> int:
    """How many intermediate tables this application has made and not dropped."""
    return len(made_folders(spark))


def made_folders(spark: SparkSession, since: int = 0) -> list[str]:
    """The folders of the intermediate tables from number ``since`` on."""
    return _made.get(spark.sparkContext.applicationId, [])[since:]


def drop_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete these intermediate tables, with the catalog tables that stand for them."""
    made = _made.get(spark.sparkContext.applicationId, [])
    for folder in folders:
        if folder in _names:
            spark.sql(f"DROP TABLE IF EXISTS `{_names.pop(folder)}`")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in made:
            made.remove(folder)


def drop_tables(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete the intermediate tables made by this application, all or those from number ``since`` to ``until``; returns how many.

    Results that were not written or collected before cannot be computed any more afterwards.
    """
    chosen = _made.get(spark.sparkContext.applicationId, [])[since:until]
    drop_folders(spark, chosen)
    return len(chosen)


@contextmanager
def intermediate_tables(spark: SparkSession):
    """Everything that operators write down inside the block is deleted at its end."""
    before = made_tables(spark)
    try:
        yield
    finally:
        drop_tables(spark, before)


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Cuts the lineage like a checkpoint, but in one job instead of two, and readers get column
    pruning, pushed-down filters and real size statistics.  ``by`` makes one sub-folder per value
    of that column.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "table")
    # untyped null columns cannot be stored; they have nothing to store either
    empty = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    writer = df.drop(*empty).write
    (writer.partitionBy(by) if by else writer).parquet(folder)
    stored = spark.read.schema(T.StructType([f for f in df.schema.fields if f.name not in empty])).parquet(folder)
    if not empty:
        return stored
    return stored.select(*[F.lit(None).alias(c) if c in empty else col(c) for c in df.columns])
