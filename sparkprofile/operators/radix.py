"""Exact order statistics by radix selection: counting passes over order-preserving integers.

A double becomes a 64-bit integer in the same order.  A pass counts, in every task, the next bits of the values that agree with a
wanted order statistic in all bits before; the counts say which bucket holds it, and the next pass looks into that
bucket only.  A bucket that holds one value ends the search for it.  No value is shuffled: a task sends one
row per non-empty bucket, and the running sums go over the buckets of one prefix, at most 2**16 rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import as_double

BITS = 16  # of a pass, if so many counters fit
TASK_BYTES = 64 << 20  # of a task's counters
TOGETHER = 1 << 20  # values that a task counts at once
_COUNTER = 17  # bytes of a count, a value and a flag
_SIGN = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; the zeros are equal, NaN is the largest value."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.uint64)
    bits = np.where(np.isnan(x), np.uint64(0x7FF8_0000_0000_0000), bits)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_bits(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


class Counters:
    """Counts of the next bits under some prefixes of one column."""

    def __init__(self, prefixes: np.ndarray, shift: int, bits: int):
        self.prefixes, self.shift, self.bits = prefixes, shift, bits
        shape = (len(prefixes), 1 << bits)
        self.n, self.value, self.mixed = np.zeros(shape, np.int64), np.zeros(shape, np.uint64), np.zeros(shape, bool)

    def add(self, keys: np.ndarray) -> None:
        above = self.shift + self.bits
        for i, prefix in enumerate(self.prefixes):
            own = keys if above >= 64 else keys[(keys >> np.uint64(above)) == prefix]
            if not len(own):
                continue
            bucket = ((own >> np.uint64(self.shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            last = np.zeros(1 << self.bits, np.uint64)
            last[bucket] = own
            self.value[i] = np.where(self.n[i] > 0, self.value[i], last)
            self.mixed[i, bucket[own != self.value[i][bucket]]] = True
            self.n[i] += np.bincount(bucket, minlength=1 << self.bits)

    def rows(self, column: int) -> Iterator[pa.RecordBatch]:
        for i, prefix in enumerate(self.prefixes):
            at = np.flatnonzero(self.n[i])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), column, np.int32)), pa.array(np.full(len(at), prefix, np.uint64).view(np.int64)), pa.array(at.astype(np.int32)),
                pa.array(self.n[i, at]), pa.array(self.value[i, at].view(np.int64)), pa.array(self.mixed[i, at]),
            ], names=["column_id", "prefix", "bucket", "n", "value", "mixed"])


def wide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The numeric columns as doubles ``c0, c1, ...``: the form that costs one row per row."""
    return df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(columns)])


def _present(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """``(column_id, values that are not null)`` of a batch of either form."""
    if batch.schema.names == ["column_id", "x"]:
        column, x = batch.column(0).to_numpy(), batch.column(1)
        for c in np.unique(column).tolist():
            yield c, x.filter(pa.array(column == c)).drop_null().to_numpy()
    else:
        for c, x in enumerate(batch.columns):
            yield c, x.drop_null().to_numpy()


def _counted(values: DataFrame, wanted: dict[int, list[int]], shift: int, bits: int) -> DataFrame:
    """``(column_id, prefix, bucket, n, value, mixed)`` of the values under the wanted prefixes."""
    def run(batches):
        held = {c: Counters(np.array(p, np.uint64), shift, bits) for c, p in wanted.items()}
        waiting: dict[int, list[np.ndarray]] = {c: [] for c in wanted}
        rows = 0

        def count():
            for c, parts in waiting.items():
                if parts:
                    held[c].add(ordered_bits(np.concatenate(parts)))
                    parts.clear()

        for batch in batches:
            for c, x in _present(batch):
                if c in held:
                    waiting[c].append(x)
                    rows += len(x)
            if rows >= TOGETHER:
                count()
                rows = 0
        count()
        for c, counters in held.items():
            yield from counters.rows(c)

    schema = "column_id int, prefix bigint, bucket int, n bigint, value bigint, mixed boolean"
    return values.mapInArrow(run, schema).groupBy("column_id", "prefix", "bucket").agg(
        F.sum("n").alias("n"), F.min("value").alias("value"), (F.bool_or("mixed") | (F.min("value") != F.max("value"))).alias("mixed")
    )


def _long(unsigned: int) -> int:
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def select(values: DataFrame, ranks: dict[int, Sequence[int]]) -> dict[tuple[int, int], float]:
    """``{(column_id, rank): value}`` of the values that are not null, in ``long(column_id, x)`` or :func:`wide` form.

    Ranks count from 0; too large ones have no value.
    """
    spark = values.sparkSession
    # (column, rank) -> bits found so far, rank among the values that share them
    todo = {(c, int(r)): (0, int(r)) for c, rs in ranks.items() for r in rs}
    out: dict[tuple[int, int], float] = {}
    above = 64
    while todo:
        wanted = {c: sorted({todo[t][0] for t in todo if t[0] == c}) for c in sorted({c for c, _ in todo})}
        room = TASK_BYTES // (_COUNTER * sum(map(len, wanted.values())))
        bits = min(above, BITS, max(4, floor(log2(max(room, 1)))))
        shift = above - bits
        running = F.sum("n").over(W.partitionBy("column_id", "prefix").orderBy("bucket"))
        counts = _counted(values, wanted, shift, bits).withColumn("past", running)
        targets = spark.createDataFrame(
            [(c, rank, _long(prefix), left) for (c, rank), (prefix, left) in todo.items()], "column_id int, rank bigint, prefix bigint, wanted bigint"
        )  # one row per order statistic
        hit = (F.col("wanted") < F.col("past")) & (F.col("wanted") >= F.col("past") - F.col("n"))
        found = counts.join(F.broadcast(targets), ["column_id", "prefix"]).where(hit).collect()
        after = {}
        for r in found:
            key, unsigned = (r.column_id, r.rank), r.value % (1 << 64)
            if not shift or not r.mixed:
                out[key] = from_bits(unsigned)
            else:
                after[key] = ((todo[key][0] << bits) | r.bucket, r.wanted - (r.past - r.n))
        todo, above = after, shift
    return out


def passes(columns: int, statistics: int) -> int:
    """The most passes over the data that so many order statistics of so many columns can take."""
    bits = min(BITS, max(4, floor(log2(max(TASK_BYTES // (_COUNTER * columns * statistics), 1)))))
    return ceil(64 / bits)


def quantile_values(values: DataFrame, probabilities: Sequence[float]) -> dict[int, list[float]]:
    """Quantiles by linear interpolation of every column that has values: one pass for their number, then the selection."""
    if values.columns == ["column_id", "x"]:
        sizes = {r.column_id: r.n for r in values.groupBy("column_id").agg(F.count("x").alias("n")).collect()}
    else:
        sizes = dict(enumerate(values.agg(*[F.count(c) for c in values.columns]).first()))
    wanted: dict[int, list[tuple[int, int, float]]] = {}
    for c, n in sizes.items():
        for p in probabilities if n else ():
            first = min(int(p * (n - 1)), n - 1)
            share = p * (n - 1) - first
            wanted.setdefault(c, []).append((first, first + 1 if share > 0 else first, share))
    found = select(values, {c: sorted({r for a, b, _ in w for r in (a, b)}) for c, w in wanted.items()})
    out = {}
    for c, w in wanted.items():
        pairs = [(found[c, a], found[c, b], share) for a, b, share in w]
        out[c] = [a if share == 0 or a == b else a + (b - a) * share for a, b, share in pairs]
    return out


def quantile_name(p: float) -> str:
    return "q" + f"{p * 100:g}".replace(".", "_")


def quantile_table(values: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``(column_id, q25, ...)``: one row per column that has values."""
    schema = "column_id int" + "".join(f", {quantile_name(p)} double" for p in probabilities)
    return values.sparkSession.createDataFrame([(c, *v) for c, v in quantile_values(values, probabilities).items()], schema)
