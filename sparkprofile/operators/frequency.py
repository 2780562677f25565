"""Shared intermediates built from value counts: frequency, distinct, mode, top-k and rank tables.

``frequency_table`` has one row per distinct (column, value).  Spark combines equal values before
the shuffle, so a value held by a third of all rows costs one partial row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.columns import col, name_rows, numeric_long, stack
from ..functions.session import materialize


# Bytes of a text that travel with its digest; texts that agree in them are told apart by 16 times as many.
HEAD_BYTES = 16


def value_text(df: DataFrame, name: str) -> Column:
    """A value as text, one text per distinct value."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(col(name)) if not isinstance(kind, T.VariantType) else col(name).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(col(name))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (col(name) + F.lit(0.0).cast(kind)).cast("string")  # -0.0 and 0.0 are one value
    return col(name).cast("string")


def text_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column_id, value)`` with values as text, nulls kept."""
    return stack(
        df,
        [[F.lit(i), value_text(df, c)] for i, c in enumerate(columns)],
        "column_id int, value string",
    )


def numeric_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_id, x, count)`` over the non-null values of numeric columns."""
    long = numeric_long(df, columns).where(F.col("x").isNotNull())
    return long.groupBy("column_id", "x").agg(F.count(F.lit(1)).alias("count"))


def text_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_id, value, count)`` over the non-null values, as text."""
    long = text_long(df, columns).where(F.col("value").isNotNull())
    return long.groupBy("column_id", "value").agg(F.count(F.lit(1)).alias("count"))


def frequency_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Public form: ``(column, value, count)`` with values as text."""
    names = F.array(*[F.lit(c) for c in columns])
    return text_frequency(df, columns).select(
        F.element_at(names, F.col("column_id") + 1).alias("column"), "value", "count"
    )


def text_digest_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_id, h1, h2, count)``: how often each value occurs, by 128-bit digest; values are not shuffled."""
    keyed = text_long(df, columns).where(F.col("value").isNotNull()).select(
        "column_id", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(20011), "value").alias("h2")
    )
    return keyed.groupBy("column_id", "h1", "h2").agg(F.count(F.lit(1)).alias("count"))


def distinct_ids(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``(column_id, unique_count)`` of non-null values; maps have no order or hash and give null.

    Only 128-bit digests of the values are shuffled (two seeded 64-bit hashes), never the values:
    a distinct count over long documents moves 16 bytes per distinct text and partition.
    ``approx=True`` needs no shuffle of values at all (HyperLogLog++).
    """
    usable = [(i, c) for i, c in enumerate(columns) if not isinstance(df.schema[c].dataType, (T.MapType, T.NullType))]
    rows = []
    for i, c in usable:
        value = col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else col(c)
        present = col(c).isNotNull()
        rows.append(
            [F.lit(i), F.when(present, F.xxhash64(value)), F.when(present, F.xxhash64(F.lit(20011), value))]
        )
    long = stack(df, rows, "column_id int, h1 bigint, h2 bigint").where(F.col("h1").isNotNull())
    if approx:
        return long.groupBy("column_id").agg(F.approx_count_distinct("h1", 0.01).alias("unique_count"))
    return long.distinct().groupBy("column_id").agg(F.count(F.lit(1)).alias("unique_count"))


def distinct_count(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """``(column, unique_count)`` of non-null values."""
    names = list(columns or df.columns)
    none = [c for c in names if isinstance(df.schema[c].dataType, T.MapType)]
    out = name_rows(df, names, distinct_ids(df, names, approx))
    count = F.coalesce(F.col("unique_count"), F.lit(0).cast("bigint"))
    if none:
        count = F.when(~F.col("column").isin(none), count)
    return out.select("column", count.alias("unique_count"))


def modes(frequency: DataFrame, value: str) -> DataFrame:
    """``(column_id, mode, mode_count)``; the smallest value wins among equally frequent ones.

    Two small aggregations instead of a sort: the largest count per column, then the smallest
    value among the rows that reach it.
    """
    best = frequency.groupBy("column_id").agg(F.max("count").alias("mode_count"))
    reach = frequency.join(F.broadcast(best), "column_id").where(F.col("count") == F.col("mode_count"))
    return reach.groupBy("column_id", "mode_count").agg(F.min(value).alias("mode"))


def top_k(frequency: DataFrame, value: str, k: int, by: str = "column_id") -> DataFrame:
    """The ``k`` most frequent values per column with ``rank`` 1..k (ties: smaller value first).

    The ``rank <= k`` filter lets Spark keep k rows per column and partition before the shuffle.
    """
    order = W.partitionBy(by).orderBy(F.desc("count"), F.asc(value))
    return frequency.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _keyed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_id, value, h1, h2)`` of the non-null values: texts with their 128-bit digests."""
    digests = [F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(20011), "value").alias("h2")]
    return text_long(df, columns).where(F.col("value").isNotNull()).select("column_id", "value", *digests)


def _head(width: int) -> Column:
    """The first bytes of a text: bytes order as Spark orders texts, whatever they encode."""
    return F.substring(F.col("value").cast("binary"), 1, width)


def text_leaders(df: DataFrame, columns: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """The k most frequent texts per column, and distinct counts; whole texts are neither shuffled nor sorted.

    Returns ``(column_id, rank, value, count)`` and ``(column_id, unique_count)``.  Texts are counted by
    128-bit digest, with their first 16 bytes.  How many texts occur how often (at most sqrt(2 x rows)
    different counts a column) gives the k-th largest count: fewer than k texts lie above it.  Of the
    texts tied at it the smallest are selected by their first bytes; only those that agree with
    the last one in all of them are read again with 16 times as many, until the place is settled.
    At most k texts a column are looked up in the end, however many are tied.
    """
    spark, keyed, width = df.sparkSession, _keyed(df, columns), HEAD_BYTES
    count = F.count(F.lit(1)).alias("count")
    counts = materialize(keyed.groupBy("column_id", "h1", "h2", _head(width).alias("head")).agg(count))
    larger = W.partitionBy("column_id").orderBy(F.desc("count")).rowsBetween(W.unboundedPreceding, -1)
    sizes = counts.groupBy("column_id", "count").agg(F.count(F.lit(1)).alias("texts"))
    above = F.coalesce(F.sum("texts").over(larger), F.lit(0))
    reached = F.col("above") < k
    facts = (
        sizes.withColumn("above", above)
        .groupBy("column_id")
        .agg(
            F.sum("texts").alias("unique_count"),
            F.min(F.when(reached, F.col("count"))).alias("cut"),
            F.max(F.when(reached, F.col("above"))).alias("above"),
        )
        .collect()  # one row per column
    )
    unique = spark.createDataFrame([(r.column_id, r.unique_count) for r in facts], "column_id int, unique_count bigint")
    cuts = spark.createDataFrame([(r.column_id, r.cut) for r in facts], "column_id int, cut bigint")
    ranked = counts.join(F.broadcast(cuts), "column_id")
    wanted = ranked.where(F.col("count") > F.col("cut")).select("column_id", "h1", "h2", "count")
    tied = ranked.where(F.col("count") == F.col("cut"))
    cut_of, places = {r.column_id: r.cut for r in facts}, {r.column_id: k - r.above for r in facts}
    while places:
        sure, bounds = _smallest_heads(tied, places, width)
        chosen = spark.createDataFrame(sure, "column_id int, head binary")
        wanted = wanted.unionByName(
            tied.join(F.broadcast(chosen), ["column_id", "head"]).select("column_id", "h1", "h2", "count")
        )
        places = {i: left for i, (_, left) in bounds.items()}
        if places:
            limits = spark.createDataFrame(
                [(i, cut_of[i], bytearray(head)) for i, (head, _) in bounds.items()], "column_id int, cut bigint, bound binary"
            )
            rest = keyed.join(F.broadcast(limits), "column_id").where(_head(width) == F.col("bound"))
            width *= 16
            longer = rest.groupBy("column_id", "h1", "h2", _head(width).alias("head"), "cut").agg(count)
            tied = materialize(longer.where(F.col("count") == F.col("cut")))
    found = keyed.join(F.broadcast(wanted), ["column_id", "h1", "h2"]).select("column_id", "value", "count").distinct()
    return top_k(found, "value", k), unique


def _smallest_heads(tied: DataFrame, places: dict[int, int], width: int) -> tuple[list, dict]:
    """Heads whose texts surely fill the places of a column, and the head at which they run out, if more texts share it.

    Every task keeps as many heads of a column as it has places: a bounded heap, not a sort.
    """
    heads = materialize(tied.groupBy("column_id", "head").agg(F.count(F.lit(1)).alias("texts")))
    firsts = [heads.where(F.col("column_id") == i).orderBy("head").limit(left) for i, left in places.items()]
    rows = reduce(DataFrame.union, firsts).collect()  # at most k heads a column
    sure, bounds = [], {}
    for i, left in places.items():
        for row in sorted((r for r in rows if r.column_id == i), key=lambda r: bytes(r["head"])):
            if row.texts > left and len(row["head"]) == width:
                bounds[i] = (bytes(row["head"]), left)
                break
            sure.append((i, row["head"]))
            left -= row.texts
            if left <= 0:
                break
    return sure, bounds


def entropy_ids(frequency: DataFrame) -> DataFrame:
    """``(column_id, entropy)`` in bits: log2(n) - sum(c * log2(c)) / n."""
    n, weighted = F.sum("count"), F.sum(F.col("count") * F.log2(F.col("count").cast("double")))
    return frequency.groupBy("column_id").agg(
        F.greatest(F.log2(n.cast("double")) - weighted / n, F.lit(0.0)).alias("entropy")
    )


def ordered_frequency(frequency: DataFrame) -> DataFrame:
    """``frequency(column_id, x, count)`` with ``before``: values in earlier range partitions.

    The first half of a distributed prefix sum, without an unpartitioned window.  The distinct
    values are range-partitioned and written with their partition number as ``bucket``:
    bucket totals and running sums must see the same partition bounds, also when an executor is
    lost.  One (column, value) is one row, so no value is hot.
    """
    ranged = materialize(
        frequency.repartitionByRange("column_id", "x").withColumn("bucket", F.spark_partition_id())
    )
    totals = ranged.groupBy("column_id", "bucket").agg(F.sum("count").alias("total"))
    # one row per column and partition
    earlier = W.partitionBy("column_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "column_id", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before")
    )
    return ranged.join(F.broadcast(offsets), ["column_id", "bucket"])


def rank_rows(ordered: DataFrame) -> DataFrame:
    """``(column_id, x, count, lo, hi)``: ``lo`` values are smaller than x, ``hi`` are not larger.

    Each bucket is summed on its own and shifted by the values before it.
    """
    inside = W.partitionBy("column_id", "bucket").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    hi = F.col("before") + F.sum("count").over(inside)
    return ordered.withColumn("hi", hi).select(
        "column_id", "x", "count", (F.col("hi") - F.col("count")).alias("lo"), "hi"
    )


def column_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank table of the numeric ``columns`` of ``df``."""
    return rank_rows(ordered_frequency(numeric_frequency(df, columns)))


def average_rank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, x, count, average_rank)``: tied values share the mean of their positions."""
    names = F.array(*[F.lit(c) for c in columns])
    return column_ranks(df, columns).select(
        F.element_at(names, F.col("column_id") + 1).alias("column"),
        "x",
        "count",
        ((F.col("lo") + 1 + F.col("hi")) / F.lit(2.0)).alias("average_rank"),
    )


