"""Helpers shared by the operators: batches grouped by key, text hashing, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.session import drop_folders, drop_tables, made_folders, made_tables, materialize, new_folder, shared_folder

__all__ = [
    "WordIds", "components", "drop_folders", "drop_tables", "grouped", "hash64", "made_folders", "made_tables", "materialize", "mix64", "new_folder", "read", "settled", "shared_folder", "small", "small_batches",
    "tasks", "text_slices", "words",
]

U64 = np.uint64
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``ARROW_ROWS`` rows: rows are whole texts here, and batches are held in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` describes, written; the tables that were written on the way to it are deleted."""
    before = made_tables(spark)
    out = materialize(make())
    drop_tables(spark, before, made_tables(spark) - 1)
    return out


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle that Spark does not size by itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def words(text: str) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash64(data: bytes, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data, seed)


def text_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes behind a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def grouped(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal keys as one table each; rows arrive sorted by the keys.

    Only the group being read is held, so the groups must be bounded.
    """
    held: list[pa.Table] = []
    current = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[lo].item() for c in columns)
            if current is not None and key != current:
                yield current, pa.concat_tables(held)
                held = []
            current = key
            held.append(table.slice(lo, hi - lo))
    if held:
        yield current, pa.concat_tables(held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, component)`` of the vertices of ``edges (a, b)``; a component is named by its smallest vertex.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges are stars around
    the smallest vertices.  Every step is two shuffles of long pairs.  In the large-star step a vertex may have very many
    neighbours; the table of minima is written first, so that Spark can split the join there.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs (u, v): every edge from the end that looks at its neighbours
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(least) if large else least
        joined = pairs.join(least, "u")
        kept = joined.where("v > u") if large else joined
        out = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def print_of(pairs: DataFrame):
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def converged() -> DataFrame:
        now = materialize(
            edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        )
        seen = print_of(now)
        for _ in range(rounds):
            if not seen[0]:
                return now
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            now = settled(spark, lambda both=both: star(star(both, True), False))
            after = print_of(now)
            if after == seen:
                return now
            seen = after
        raise RuntimeError("components did not converge")

    now = settled(spark, converged)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


class _Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class WordIds:
    """Ids of rows of words; each distinct word is encoded once while it stays in the table.

    ``learn(words)`` gives the ids of the words in a row and each word's number of ids.  The table is emptied when it
    has passed ``limit`` words, so memory is bounded by the limit and one slice of texts.
    """

    def __init__(self, learn, limit: int):
        self.learn, self.limit = learn, limit
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def numbers_of(self, words: pa.Array) -> np.ndarray:
        """The number of each word; equal words are found by Arrow first, which is kind to the caches."""
        if len(self.numbers) > self.limit:
            self._clear()
        coded = words.dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), len(self.numbers)
        found = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        if len(self.numbers) > known:
            flat, sizes = self.learn(list(islice(self.numbers, known, None)))
            starts = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, flat])
            self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        return found[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)

    def rows(self, numbers: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each row; ``ends`` are the rows' bounds among the numbers."""
        sizes = self.sizes[numbers]
        last = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(last[-1]) + np.repeat(self.starts[numbers] - last[:-1], sizes)
        raw, bounds = self.flat[at].astype("<u4").tobytes(), (last[ends] * 4).tolist()
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
