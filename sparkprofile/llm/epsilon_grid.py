"""Near-duplicate vectors by the epsilon grid order join (Boehm et al., 2001)."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import components, grouped, materialize, settled, tasks

DIMENSIONS = 6
BLOCK = 256
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row numbers, vectors)`` of the vectors of a batch that can be compared, in double precision."""
    at, found = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and not any(x is None for x in v):
            x = np.array(v, float)
            if np.isfinite(x).all() and x.any():
                at.append(i)
                found.append(x)
    return np.array(at, np.int64), np.array(found)


def principal_axes(vectors: DataFrame, width: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The leading axes of the unit vectors' second moments, each task summing its own part."""
    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            at, x = usable_rows(batch.column(0))
            if len(at):
                x = _unit(x)
                total += x.T @ x
        rows, columns = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": rows.astype(np.int32), "j": columns.astype(np.int32), "s": total[rows, columns]})

    sums = vectors.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros((width, width))
    total[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["s"].to_numpy()
    total += np.triu(total, 1).T
    _, axes = np.linalg.eigh(total)
    return np.ascontiguousarray(axes[:, ::-1][:, :dimensions])


def _links(a: np.ndarray, b: np.ndarray | None, least: float, out: list[np.ndarray], at: tuple[int, int] = (0, 0), axes: int = 0) -> None:
    """Pairs of rows of two intervals of the sequence with a scalar product of at least ``least``.

    Columns 0 to ``axes`` hold the grid coordinates.  Intervals whose boxes are further apart than the radius are
    skipped whole; larger ones are halved and their halves joined.
    """
    radius = sqrt(max(0.0, 2 - 2 * least)) + SLACK
    p, q = a[:, :axes], (a if b is None else b)[:, :axes]
    gap = np.maximum(0, np.maximum(q.min(0) - p.max(0), p.min(0) - q.max(0)))
    if gap @ gap > radius * radius:
        return
    n, m = len(a), len(a if b is None else b)
    if max(n, m) <= 64:
        s = a[:, axes:] @ (a if b is None else b)[:, axes:].T >= least
        if b is None:
            s = np.triu(s, 1)
        found = np.argwhere(s)
        if len(found):
            out.append(found + np.array(at))
        return
    halves = [(0, n // 2), (n // 2, n)] if n > 1 else [(0, n)]
    if b is None:
        (x0, x1), (y0, y1) = halves
        _links(a[x0:x1], None, least, out, (at[0] + x0, at[1] + x0), axes)
        _links(a[y0:y1], None, least, out, (at[0] + y0, at[1] + y0), axes)
        _links(a[x0:x1], a[y0:y1], least, out, (at[0] + x0, at[1] + y0), axes)
        return
    others = [(0, m // 2), (m // 2, m)] if m > 1 else [(0, m)]
    for x0, x1 in halves:
        for y0, y1 in others:
            _links(a[x0:x1], b[y0:y1], least, out, (at[0] + x0, at[1] + y0), axes)


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Those pairs that connect what was not connected before: at most n - 1, with the same components."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(i)
    return pairs[kept]


def near_duplicates(
    df: DataFrame, id_column: str, vector: str, label: str, cosine: float = 0.98, dimensions: int = DIMENSIONS, block: int = BLOCK
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Rows with equal, non-null labels link when their cosine in double precision is at least ``cosine``; ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id reachable over links, ``kept`` marks the row with
    that id.  Vectors of different widths do not link; each width is joined on its own.  Vectors that are null, empty, zero,
    or hold null or non-finite components, and rows with a null label, link with nothing.  Rows are numbered first, so that rows of
    one id, or without an id, are told apart: each row has a row of its own in the result, and each row linked to counts.
    Null ids are no smallest id unless a component has no other (``component_id`` is null then).

    Equal vectors of a label are one entry with a count.  Entries are sorted by label and the grid cells of their leading
    principal coordinates (cell width: the radius that the cosine means) and cut into blocks of consecutive entries.
    Blocks whose boxes of coordinates are within the radius are paired through the first coordinate's cells that
    they touch, and every pair of blocks is joined recursively in one task.  A task returns each row's number of links and a
    spanning forest, never the pairs, so a large group of near copies costs rows in proportion to its blocks.
    """
    rows = materialize(df.select(
        F.monotonically_increasing_id().alias("id"), F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").alias("v"),
    ))
    sized = rows.where("label IS NOT NULL AND size(v) > 0").select("id", "label", "v")
    linked = None
    for r in sized.groupBy(F.size("v").alias("w")).count().collect():  # one row per width
        own = sized.where(F.size("v") == r["w"])
        part = settled(df.sparkSession, lambda own=own, width=r["w"]: _linked(own, width, cosine, dimensions, block))
        linked = part if linked is None else linked.unionByName(part)
    out = rows.select("id", "vec_id")
    if linked is None:
        named = out.withColumns({"n_links": F.lit(0).cast("bigint"), "component_id": F.col("vec_id")})
    else:
        placed = materialize(out.join(linked.withColumnRenamed("component_id", "component"), "id", "left"))
        names = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
        named = placed.join(names, "component", "left").select(
            "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"),
        )
    return named.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(rows: DataFrame, width: int, cosine: float, dimensions: int, block: int) -> DataFrame:
    """``(id, n_links, component_id)`` of the comparable vectors of one width among ``rows(id, label, v)``."""
    spark = rows.sparkSession
    radius = sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    axes = principal_axes(rows, width, min(dimensions, width))
    k = axes.shape[1]
    shared = spark.sparkContext.broadcast(axes)
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"

    def place(batches):
        for batch in batches:
            good, x = usable_rows(batch.column(2))
            if not len(good):
                continue
            at = _unit(x) @ shared.value
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).take(pa.array(good)), "label": batch.column(1).take(pa.array(good)),
                "cells": pa.array(list(np.floor(at / radius).astype(np.int32)), pa.list_(pa.int32())),
                "data": pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()),
            })

    placed = materialize(rows.mapInArrow(place, "id bigint, label string, cells array<int>, data binary"))
    entry_of = materialize(placed.groupBy("label", F.md5("data").alias("print")).agg(F.min("id").alias("entry"), F.count(F.lit(1)).alias("copies")))
    entries = placed.join(entry_of.select(F.col("entry").alias("id"), "copies"), "id")

    # the sequence: sorted by label and cells, cut into blocks of consecutive entries
    parts = tasks(spark)

    def cut(batches):
        for i, batch in enumerate(batches):
            labels = batch.column(1).to_pylist()
            number, filled, last = [], 0, None
            for lab in labels:
                if lab != last or filled == block:
                    number.append((number[-1] + 1) if number else 0)
                    filled, last = 0, lab
                else:
                    number.append(number[-1])
                filled += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([i] * len(labels), pa.int32()), pa.array(number, pa.int32())], names=[*batch.schema.names, "batch", "number"])

    cells = [F.get("cells", F.lit(i)) for i in range(k)]
    ordered = entries.select("id", "label", "cells", "data", "copies").repartitionByRange(parts, "label", *cells, "id").sortWithinPartitions("label", *cells, "id")
    schema = "id bigint, label string, cells array<int>, data binary, copies bigint, batch int, number int"
    blocks = materialize(ordered.mapInArrow(cut, schema).withColumn(
        "block", (F.spark_partition_id().cast("bigint") * (1 << 20) + F.col("batch")) * (1 << 20) + F.col("number")
    ))
    boxes = materialize(blocks.groupBy("label", "block").agg(
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(cells)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cells)]
    ))
    left = boxes.select("label", F.col("block").alias("a"), *[F.col(f"{x}{i}").alias(f"a_{x}{i}") for i in range(k) for x in ("lo", "hi")],
                        F.explode(F.sequence(F.col("lo0") - 1, F.col("hi0") + 1)).alias("cell"))
    right = boxes.select("label", F.col("block").alias("b"), *[F.col(f"{x}{i}").alias(f"b_{x}{i}") for i in range(k) for x in ("lo", "hi")],
                         F.explode(F.sequence("lo0", "hi0")).alias("cell"))
    near = F.col("a") <= F.col("b")
    for i in range(k):
        near &= (F.col(f"a_lo{i}") <= F.col(f"b_hi{i}") + 1) & (F.col(f"b_lo{i}") <= F.col(f"a_hi{i}") + 1)
    pairs = materialize(left.join(right, ["label", "cell"]).where(near).select("a", "b").distinct())
    sides = pairs.select("a", "b", F.col("a").alias("block")).union(pairs.where("a <> b").select("a", "b", F.col("b").alias("block")))
    work = sides.join(blocks.select("block", "id", "copies", "data"), "block")
    work = work.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "block", "id")

    def join(batches) -> Iterator[pa.RecordBatch]:
        for (a, b), table in grouped(batches, ["a", "b"]):
            ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
            x = _unit(np.stack([np.frombuffer(v, kind) for v in table["data"].to_pylist()]).astype(float))
            x = np.concatenate([x @ shared.value, x], 1)
            cut_at = int((table["block"].to_numpy() == a).sum())
            found: list[np.ndarray] = []
            if a == b:
                _links(x, None, cosine, found, (0, 0), k)
            elif 0 < cut_at < len(x):
                _links(x[:cut_at], x[cut_at:], cosine, found, (0, cut_at), k)
            if not found:
                continue
            links = np.concatenate(found)
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, links[:, 0], copies[links[:, 1]])
            np.add.at(n, links[:, 1], copies[links[:, 0]])
            hit = np.flatnonzero(n)
            tree = forest(links, len(ids))
            yield pa.RecordBatch.from_pydict({
                "id": np.concatenate([ids[hit], ids[tree[:, 0]]]), "other": pa.array([None] * len(hit) + ids[tree[:, 1]].tolist(), pa.int64()),
                "n": np.concatenate([n[hit], np.zeros(len(tree), np.int64)]),
            })

    found = materialize(work.select("a", "b", "block", "id", "copies", "data").mapInArrow(join, "id bigint, other bigint, n bigint"))
    counts = found.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of_entry = materialize(
        entry_of.join(counts, entry_of["entry"] == counts["id"], "left").drop("id")
        .join(groups, F.col("entry") == groups["id"], "left")
        .select("label", "print", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "entry").alias("component_id"))
    )
    return placed.select("id", "label", F.md5("data").alias("print")).join(of_entry, ["label", "print"]).select("id", "n_links", "component_id")
