"""Rolling average over a whole table ordered by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import col
from ..functions.session import materialize

MAX_WINDOW = 30
CHUNK_ROWS = 1_000_000


def number_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``position`` 0, 1, ... in the order of the columns ``order``, without a global window.

    Rows are range-partitioned by the order, written down so that partition bounds are fixed, and
    numbered inside their partition; the sizes of the partitions before give the offset.
    """
    keys = [col(c).asc_nulls_last() for c in order]
    ranged = materialize(df.repartitionByRange(*keys).withColumn("_bucket", F.spark_partition_id()))
    sizes = ranged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition
    before = W.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_bucket").orderBy(*keys)
    return (
        ranged.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("position", F.col("_offset") + F.col("_row") - 1)
        .drop("_bucket", "_row", "_offset")
    )


def rolling_average(
    df: DataFrame,
    time: str,
    value: str,
    tie: Sequence[str] = (),
    window: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(time, value, *tie, rolling)``: mean of the last ``window`` values in time order.

    The default window is min(rows // 10, 30).  ``rolling`` is null until the window is full and
    wherever it holds a null.  ``tie`` orders rows of equal time.  Numbered rows are cut into chunks;
    the last ``window - 1`` rows of a chunk are copied to the next one, so every average is computed
    inside a chunk and no window spans the whole table.
    """
    tie = [c for c in tie if c not in (time, value)]
    rows = df.select(col(time), col(value), *[col(c) for c in tie])
    width = min(df.count() // 10, MAX_WINDOW) if window is None else window
    if width < 1:
        return rows.withColumn("rolling", F.lit(None).cast("double"))
    chunk_rows = max(chunk_rows, width)  # a frame reaches into one chunk before
    numbered = number_rows(rows, [time, *tie, value])
    chunk = F.floor(F.col("position") / F.lit(chunk_rows)).cast("bigint")
    into = F.col("position") % F.lit(chunk_rows)
    homes = F.when(into >= chunk_rows - (width - 1), F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = numbered.withColumn("_home", chunk).withColumn("_chunk", F.explode(homes))
    frame = W.partitionBy("_chunk").orderBy("position").rowsBetween(-(width - 1), 0)
    average = F.when(F.count(col(value)).over(frame) == width, F.avg(col(value)).over(frame))
    return (
        spread.withColumn("rolling", average.cast("double"))
        .where(F.col("_chunk") == F.col("_home"))
        .select(col(time), col(value), *[col(c) for c in tie], "rolling")
    )
