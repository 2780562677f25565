"""Approximate nearest neighbours: learned rotated binary codes, multi-index hashing, reranking by the vectors themselves."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialize, settled, tasks
from .vectors import dense, doubles, widest

BITS = 64
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 64 << 20  # the bound of the sample that the codes are learned from
PROBED = 512  # rows of the sample that stand for queries
COVERED = 0.97  # share of the pairs at a distance whose codes lie within the radius chosen for it
BLOCK = 2_048  # entries of an index block, four times as many at most
SLOT = 256  # queries that visit a block together
PAIRS = 65_536  # pairs that are reranked together
NO_ID = -(1 << 63)


@dataclass
class Codes:
    """What is learned: a rotation whose signs are the code, and the Hamming radius that covers a distance."""

    scale: float
    mean: np.ndarray
    turn: np.ndarray
    sample: np.ndarray
    edges: np.ndarray
    radii: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            bits = (x * self.scale - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)

    def radius_at(self, distance: np.ndarray) -> np.ndarray:
        return np.append(self.radii, BITS)[np.searchsorted(self.edges, distance)]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, not below the true ones by more than rounding; infinite where squares overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        p, q = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
        out = np.sqrt(np.maximum(p + q - 2 * (a @ b.T), 0) + 1e-13 * (p + q))
    return np.where(np.isnan(out), np.inf, out)


def learn(sample: np.ndarray, seed: int = 0, rounds: int = 40) -> Codes:
    """Iterative quantization (Gong and Lazebnik, 2011): principal coordinates, turned so that their signs lose least.

    Fewer than 64 dimensions are turned several times, each turn from another start.
    """
    rng = np.random.default_rng(seed)
    scale = 1.0 / max(float(np.abs(sample).max()), np.finfo(float).tiny)
    mean = (sample * scale).mean(0)
    centred = sample * scale - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :BITS]
    own = centred @ axes
    turns = []
    while sum(t.shape[1] for t in turns) < BITS:
        turn = np.linalg.qr(rng.normal(size=(own.shape[1], own.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(own @ turn > 0, 1.0, -1.0).T @ own)
            turn = (left @ right).T
        turns.append(axes @ turn)
    codes = Codes(scale, mean, np.concatenate(turns, 1)[:, :BITS], sample, np.zeros(0), np.zeros(0, np.int64))
    asked = sample[:PROBED]
    apart = _distances(asked, sample)
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1, kind="stable")[:, : max(0, min(100, len(sample) - 1))]
    packed = codes.of(sample)
    distance = np.take_along_axis(apart, near, 1).ravel()
    bits = np.bitwise_count(packed[: len(asked)][:, None] ^ packed[near]).ravel().astype(np.int64)
    order = np.argsort(distance, kind="stable")
    parts = [p for p in np.array_split(order, 64) if len(p)]
    codes.edges = np.array([distance[p].max() for p in parts])
    codes.radii = np.maximum.accumulate(np.array([np.ceil(np.quantile(bits[p], COVERED)) for p in parts], np.int64)) if parts else codes.radii
    return codes


def segments_of(entries: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of the substrings: about log2 of the number of codes wide, 8 to 32 bits."""
    n = ceil(BITS / min(32, max(8, round(log2(max(entries, 2))))))
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@contextmanager
def _records(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows inside the block, for rows that hold whole blocks of vectors."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def top_k(df: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: about the ``k`` nearest other rows of ``df`` of every row of ``queries``, which are rows of ``df``.

    ``score`` is the Euclidean distance of the vectors in double precision; nearest first, ties to the smaller id.  Vectors
    that are null, empty, zero or hold null or non-finite components take no part; shorter vectors are filled up with zeros.
    Every row is a candidate but the query's own: of repeated rows one is left out, and repeated queries answer
    repeatedly.  A null id counts as the smallest.  Fewer candidates than ``k`` are all returned.  Empty tables give no rows.

    Codes are learned from a sample of at most ``SAMPLE_ROWS`` different vectors (and ``SAMPLE_BYTES``), drawn by hash; every vector is
    indexed.  The sample bounds a query's k-th distance from above, and the radius covers ``COVERED`` of the code distances seen at
    that bound; it is large enough for k results.  Equal vectors are one entry with their k + 1 smallest ids.  By the pigeonhole principle a code within
    radius r differs in at most r / m bits of one of the m substrings.  The index is sorted by substring and cut into blocks that share a
    prefix; queries go to the blocks whose prefix may hold such substrings, at most ``SLOT`` of them together, and there every
    code within the radius is retrieved once (by the first substring that finds it) and reranked.  A task returns k rows
    per query and block.  Hot prefixes are many blocks, and hot blocks are visited by many small groups of queries.
    """
    return settled(df.sparkSession, lambda: _search(df, queries, id_column, vector, k))


def _usable(df: DataFrame, id_column: str, vector: str, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            at, x = dense(batch.column(1), width)
            keep = x.any(1) if width else np.zeros(len(x), bool)
            data = pa.array([v.tobytes() for v in x[keep].astype("<f8")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[keep])), data], names=["id", "data"])

    rows = df.select(F.coalesce(F.col(f"`{id_column}`").cast("bigint"), F.lit(NO_ID)).alias("id"), doubles(vector).alias("v"))
    return rows.mapInArrow(run, "id bigint, data binary")


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def _search(df: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int) -> DataFrame:
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = widest(df, vector)
    least = Window.partitionBy("data").orderBy("id")
    entries = materialize(
        _usable(df, id_column, vector, width).withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
        .groupBy("data").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    count = entries.count()
    if not count:
        return empty
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    drawn = entries.orderBy(F.xxhash64("data"), "data").limit(most).select("data").toArrow()
    learned = spark.sparkContext.broadcast(learn(_matrix(drawn["data"], width)))
    segments = segments_of(count)
    prefix = min(min(w for _, w in segments), max(0, ceil(log2(count / BLOCK)))) if count > BLOCK else 0

    def ask(batches):
        codes = learned.value
        known = codes.of(codes.sample)
        for batch in batches:
            x = _matrix(batch.column(2), width)
            code = codes.of(x)
            radius, bound = np.full(len(x), BITS, np.int32), np.full(len(x), np.inf)
            for at in range(0, len(x) if len(known) > k else 0, 128):
                part = slice(at, at + 128)
                apart = _distances(x[part], codes.sample)
                bits = np.bitwise_count(code[part][:, None] ^ known[None, :])
                own = np.maximum(codes.radius_at(np.partition(apart, k, axis=1)[:, k]), np.partition(bits, k, axis=1)[:, k])
                radius[part] = own
                bound[part] = np.partition(np.where(bits <= own[:, None], apart, np.inf), k, axis=1)[:, k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(code.view(np.int64)), pa.array(radius), pa.array(bound)],
                names=["q", "query_id", "data", "code", "radius", "bound"],
            )

    usable = _usable(queries, id_column, vector, width).select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), "data")
    asked = materialize(usable.mapInArrow(ask, "q bigint, query_id bigint, data binary, code bigint, radius int, bound double"))
    blocks = _index(entries, learned, segments, prefix, width)

    def probe(batches):
        flips = [np.array([sum(1 << i for i in c) for c in combinations(range(prefix), n)], np.int64) for n in range(prefix + 1)]
        for batch in batches:
            code, radius = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy() // len(segments)
            for near in np.unique(radius).tolist():
                at = np.flatnonzero(radius == near)
                masks = np.concatenate(flips[: near + 1])
                for s, (shift, w) in enumerate(segments):
                    own = ((code[at] >> np.uint64(shift + w - prefix)) & np.uint64((1 << prefix) - 1)).astype(np.int64)
                    for lo in range(0, len(at), max(1, PAIRS // len(masks))):
                        rows = slice(lo, lo + max(1, PAIRS // len(masks)))
                        value = (own[rows][:, None] ^ masks[None, :]).ravel()
                        number = batch.column(0).take(pa.array(np.repeat(at[rows], len(masks))))
                        yield pa.RecordBatch.from_arrays([number, pa.array(np.full(len(value), s, np.int32)), pa.array(value)], names=["q", "s", "prefix"])

    probes = asked.select("q", "code", "radius").mapInArrow(probe, "q bigint, s int, prefix bigint")
    # Spark cannot know how many probes a row makes: no broadcast of them
    visits = materialize(probes.hint("merge").join(blocks.select("s", "prefix", "block"), ["s", "prefix"]).select("q", "block"))
    slots = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SLOT).alias("slots"))
    slotted = visits.join(slots, "block").select("q", "block", F.pmod(F.xxhash64("q"), F.col("slots")).alias("slot"))
    each = F.struct("q", "query_id", "code", "radius", "bound", "data")
    groups = slotted.join(asked, "q").groupBy("block", "slot").agg(F.collect_list(each).alias("asked"))
    work = groups.hint("merge").join(blocks, "block").select("s", "codes", "vectors", "ids", "asked")
    with _records(spark, 16):
        found = materialize(work.mapInArrow(_rerank(segments, width, k), "q bigint, query_id bigint, vec_id bigint, score double"))
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    real = [F.nullif(c, F.lit(NO_ID)).alias(c) for c in ("query_id", "vec_id")]
    return ranked.select(real[0], "rank", real[1], "score")


def _index(entries: DataFrame, learned, segments: list[tuple[int, int]], prefix: int, width: int) -> DataFrame:
    """``(block, s, prefix, codes, vectors, ids)``: consecutive entries of each substring's order that share a prefix."""
    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = learned.value.of(_matrix(batch.column(0), width))
            for s, (shift, w) in enumerate(segments):
                value = ((code >> np.uint64(shift)) & np.uint64((1 << w) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), s, np.int32)), pa.array(value >> (w - prefix)), pa.array(value), pa.array(code.view(np.int64)), *batch.columns],
                    names=["s", "prefix", "value", "code", "data", "ids"],
                )

    def cut(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        number = 0

        def block():
            nonlocal number, held
            table, held, number = pa.concat_tables(held).combine_chunks(), [], number + 1
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int32()), table["s"].slice(0, 1).combine_chunks(), table["prefix"].slice(0, 1).combine_chunks(),
                pa.array([table["code"].to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(table["data"].to_pylist())], pa.binary()),
                pa.array([table["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))),
            ], names=["number", "s", "prefix", "codes", "vectors", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            s, p = table["s"].to_numpy(), table["prefix"].to_numpy()
            starts = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (p[1:] != p[:-1])) + 1).tolist(), len(s)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if held and ((held[0]["s"][0].as_py(), held[0]["prefix"][0].as_py()) != (s[lo], p[lo]) or sum(map(len, held)) >= 3 * BLOCK):
                    yield block()
                held.append(table.slice(lo, hi - lo))
        if held:
            yield block()

    rows = entries.mapInArrow(placed, "s int, prefix bigint, value bigint, code bigint, data binary, ids array<bigint>")
    order = ["s", "value", "code", "data"]
    ordered = rows.repartitionByRange(tasks(entries.sparkSession), *order).sortWithinPartitions(*order)
    made = ordered.mapInArrow(cut, "number int, s int, prefix bigint, codes binary, vectors binary, ids array<array<bigint>>")
    block = (F.spark_partition_id().cast("bigint") * (1 << 32) + F.col("number")).alias("block")
    return materialize(made.select(block, "s", "prefix", "codes", "vectors", "ids"))


def _rerank(segments: list[tuple[int, int]], width: int, k: int):
    """The task function: codes within each query's radius that its block's substring finds first, by distance of their vectors."""
    def within(x: np.ndarray, s: int, near: np.ndarray) -> np.ndarray:
        shift, w = segments[s]
        return np.bitwise_count((x >> np.uint64(shift)) & np.uint64((1 << w) - 1)) <= near

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                s = batch.column(0)[row].as_py()
                codes = np.frombuffer(batch.column(1)[row].as_py(), "<i8").view(np.uint64)
                vectors = np.frombuffer(batch.column(2)[row].as_py(), "<f8").reshape(-1, width)
                lists = batch.column(3)[row].values
                sizes = lists.value_lengths().to_numpy()
                firsts, ids = np.cumsum(sizes) - sizes, lists.flatten().to_numpy()
                asked = pa.RecordBatch.from_struct_array(batch.column(4)[row].values)
                code, radius = asked.column("code").to_numpy().view(np.uint64), asked.column("radius").to_numpy()
                own, bound, points = asked.column("query_id").to_numpy(), asked.column("bound").to_numpy(), _matrix(asked.column("data"), width)
                i, j = np.nonzero(np.bitwise_count(code[:, None] ^ codes[None, :]) <= radius[:, None])
                x, near = code[i] ^ codes[j], radius[i] // len(segments)
                first = within(x, s, near)
                for t in range(s):
                    first &= ~within(x, t, near)
                i, j = i[first], j[first]
                score = np.empty(len(i))
                for at in range(0, len(i), PAIRS):
                    part = slice(at, at + PAIRS)
                    gap = vectors[j[part]] - points[i[part]]
                    with np.errstate(over="ignore"):
                        score[part] = np.sqrt((gap * gap).sum(1))
                    for far in np.flatnonzero(~np.isfinite(score[part])):
                        most = np.abs(gap[far]).max()
                        score[at + far] = most * np.sqrt(np.square(gap[far] / most).sum())
                fine = score <= bound[i]
                i, j, score = i[fine], j[fine], score[fine]
                each = np.repeat(np.arange(len(i)), sizes[j])
                place = np.arange(len(each)) - np.repeat(np.cumsum(sizes[j]) - sizes[j], sizes[j])
                vec = ids[firsts[j][each] + place]
                # the query's own row is one of its entry's ids: the first that is equal, if it is listed
                mine = (score[each] == 0) & (vec == own[i[each]])
                mine[1:] &= ~(mine[:-1] & (each[1:] == each[:-1]))
                i, vec, score = i[each][~mine], vec[~mine], score[each][~mine]
                order = np.lexsort((vec, score, i))
                i, vec, score = i[order], vec[order], score[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_arrays([
                    asked.column("q").take(pa.array(i[top])), pa.array(own[i[top]]), pa.array(vec[top]), pa.array(score[top]),
                ], names=["q", "query_id", "vec_id", "score"])

    return run
