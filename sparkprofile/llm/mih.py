"""Exact nearest neighbours of binary codes by incremental multi-index hashing (Norouzi et al., 2012)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, islice
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, settled

BITS = 64
MASKS = 1 << 16


def sign_codes(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(id, code)``: the sign bits of a vector of at most 64 components as a long; a wider one is an error, not cut.

    A null or non-finite component counts as not positive; a null vector has a null code and is left out of
    searches; shorter vectors leave the remaining bits zero.
    """
    def codes(batches):
        for batch in batches:
            column = batch.column(1)
            out = []
            for v in column.to_pylist():
                if v is None:
                    out.append(None)
                    continue
                if len(v) > BITS:
                    raise ValueError(f"a vector has {len(v)} components; codes hold the signs of at most {BITS}")
                bits = np.zeros(BITS, np.uint8)
                for i, x in enumerate(v):
                    bits[i] = x is not None and np.isfinite(x) and x > 0
                out.append(int(np.packbits(bits).view(">i8")[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.int64())], ["id", "code"])

    return df.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("v")).mapInArrow(
        codes, "id bigint, code bigint"
    )


def segments_for(codes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """``(shift, width)`` of the segments: as wide as keeps about one code per value, at most 32 bits."""
    width = min(32, max(8, round(log2(max(codes, 2)))))
    n = ceil(bits / width)
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _segment(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def _probes(queries: DataFrame, segments: Sequence[tuple[int, int]], radius: int) -> DataFrame:
    """``(query_id, query, s, value)``: per segment of each query all values that differ in ``radius`` bits."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, codes = batch.column(0), batch.column(1).to_numpy().view(np.uint64)
            for s, (shift, width) in enumerate(segments):
                own = (codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                flips = combinations(range(width), radius)
                while chunk := list(islice(flips, max(1, MASKS // len(own)))):
                    masks = (np.uint64(1) << np.array(chunk, np.uint64).reshape(len(chunk), radius)).sum(1, dtype=np.uint64)
                    value = (own[:, None] ^ masks[None, :]).ravel().astype(np.int64)
                    at = pa.array(np.repeat(np.arange(len(own)), len(masks)))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), batch.column(1).take(at), pa.array(np.full(len(value), s, np.int32)), pa.array(value)],
                        names=["query_id", "query", "s", "value"],
                    )

    return queries.select("query_id", "query").mapInArrow(run, "query_id bigint, query bigint, s int, value bigint")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, neighbor_id, distance, rank)``: the k other rows nearest in Hamming distance, ties by id.

    ``codes`` and ``queries`` are ``(id, code)``; null codes neither ask nor answer.  Equal codes are one entry of
    the index with its k + 1 smallest ids, which is all that ties by id can need, so a group of copies costs
    one candidate.  The index has a row per segment and distinct code.  In round r every unfinished query looks
    up the segment values at distance r; all codes nearer than m * (r + 1), with m segments, have then been met, so a
    query is finished when its k-th verified distance is below that, or when no value is left to look up.
    Fewer than k other rows give fewer rows.  Rows of equal id and code are one; rows of one id and several codes ask and answer by
    each of them, and only a row's own code does not answer it.  A null id counts as the smallest.
    """
    return settled(codes.sparkSession, lambda: _search(codes, queries, k))


def _search(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The rounds of :func:`top_k`."""
    rows = codes.where("code IS NOT NULL").select("id", "code").distinct()
    least = Window.partitionBy("code").orderBy("id")
    entries = materialize(
        rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
        .groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("id"))), lambda x: x["id"]).alias("ids")).withColumn("first", F.get("ids", F.lit(0)))
    )
    segments = segments_for(entries.count())
    pieces = F.array(*[F.struct(F.lit(i).alias("s"), _segment(F.col("code"), a, w).alias("value")) for i, (a, w) in enumerate(segments)])
    index = materialize(entries.select("code", "first", F.explode(pieces).alias("p")).select("p.s", "p.value", "code", "first"))
    asked = materialize(queries.where("code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct())
    open_queries, best, radius = asked, None, 0
    asks = ["query_id", "query"]
    done = []
    nearest = Window.partitionBy(*asks).orderBy("distance", "first")
    while True:
        near = [(a, w) if radius <= w else (a, 0) for a, w in segments]
        if not any(w for _, w in near):
            done.append(best.join(open_queries, asks))
            break
        probes = _probes(open_queries, near, radius)
        # Spark cannot know how many probes a query makes: no broadcast of them
        met = probes.hint("merge").join(index, ["s", "value"]).select(
            *asks, "code", "first", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance")
        )
        if best is not None:
            met = met.union(best.join(open_queries, asks).select(*asks, "code", "first", "distance"))
        # k + 1 codes hold the k nearest other rows: each code has at least one row, one of them may be the query
        best = materialize(
            met.distinct().withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n")
        )
        ranked = best.join(entries.select("code", "ids"), "code").select(*asks, "distance", F.explode("ids").alias("neighbor_id"))
        ranked = ranked.where("NOT (neighbor_id <=> query_id AND distance = 0)")
        found = ranked.groupBy(*asks).agg(F.sort_array(F.collect_list("distance")).alias("d")).select(
            *asks, F.get("d", F.lit(k - 1)).alias("kth")
        )
        covered = len(segments) * (radius + 1) - 1
        closed = materialize(found.where(F.col("kth") <= covered).select(*asks))
        done.append(best.join(closed, asks, "left_semi"))
        open_queries = materialize(open_queries.join(closed, asks, "left_anti"))
        radius += 1
        if open_queries.isEmpty():
            break
    found = None
    for d in done:
        if d is not None:
            found = d if found is None else found.unionByName(d)
    order = Window.partitionBy(*asks).orderBy("distance", "neighbor_id")
    return (
        found.join(entries.select("code", "ids"), "code").select(*asks, "distance", F.explode("ids").alias("neighbor_id"))
        .where("NOT (neighbor_id <=> query_id AND distance = 0)").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "neighbor_id", "distance", "rank")
    )
