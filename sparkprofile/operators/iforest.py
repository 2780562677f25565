"""Multivariate outliers with an isolation forest (Liu, Ting and Zhou, ICDM 2008).

Spark draws the subsamples and groups them by tree; a task grows one tree from at most 256 rows;
the finished forest (at most 100 x 511 nodes) is shipped to the executors, which score their own
Arrow batches.  The table itself is never collected, grouped or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.columns import as_double, col, numeric_columns
from ..functions.session import materialize
from .sampling import smallest_draws
from .quantiles import long_quantiles

TREES = 100
SUBSAMPLE = 256
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def draw_subsamples(data: DataFrame, features: Sequence[str], trees: int, size: int, seed: int) -> DataFrame:
    """``(tree, features...)``: ``size`` random rows per tree.

    ``trees * size`` random rows are drawn once (a bounded top-k, not a sort) and dealt out in their random
    order, ``size`` to each tree; a smaller table is dealt out again from its start.
    """
    pool = smallest_draws(data.select(*[col(c) for c in features], F.rand(seed).alias("draw")), trees * size, "draw")
    # the pool has at most trees * size rows, whatever the size of the table
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("draw")) - 1
    total = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    dealt = pool.withColumns({"place": place, "total": total})
    takers = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.col("place") - t * size, F.col("total")) < size
    )
    return dealt.select(*[col(c) for c in features], F.explode(takers).alias("tree"))


def tree_grower(features: Sequence[str], seed: int):
    """Function for ``applyInPandas``: grow one tree from the rows of its subsample."""

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        data = rows[list(features)].to_numpy(dtype=float)
        data = data[np.lexsort(data.T[::-1])]  # row order must not depend on the shuffle
        random = np.random.default_rng([seed, tree])
        height = math.ceil(math.log2(max(len(data), 2)))
        nodes: list[list] = []

        def add(part: np.ndarray, depth: int) -> int:
            index = len(nodes)
            nodes.append([tree, index, -1, 0.0, -1, -1, depth + average_path(len(part))])
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= height or len(part) <= 1 or not len(usable):
                return index
            feature = int(random.choice(usable))
            threshold = float(random.uniform(low[feature], high[feature]))
            below = part[:, feature] <= threshold
            nodes[index][2:4] = [feature, threshold]
            nodes[index][4] = add(part[below], depth + 1)
            nodes[index][5] = add(part[~below], depth + 1)
            return index

        add(data, 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    return grow


def fit_forest(
    data: DataFrame, features: Sequence[str], trees: int = TREES, size: int = SUBSAMPLE, seed: int = 42
) -> DataFrame:
    """The forest as a node table of at most ``trees * (2 * size - 1)`` rows."""
    draws = draw_subsamples(data, features, trees, size, seed)
    return draws.groupBy("tree").applyInPandas(tree_grower(features, seed), NODE_SCHEMA)


def complete_trees(nodes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forest as complete binary trees: (feature, threshold) per inner node, path per last-level node.

    The children of node i are 2i+1 and 2i+2; a leaf above the last level sends every value left.
    """
    trees: dict[int, dict[int, object]] = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n

    def depth(tree: dict, at: int) -> int:
        n = tree[at]
        return 0 if n.feature < 0 else 1 + max(depth(tree, n.left), depth(tree, n.right))

    height = max(depth(tree, 0) for tree in trees.values())
    inner = 2**height - 1
    feature = np.zeros((len(trees), inner), dtype=np.int64)
    threshold = np.full((len(trees), inner), np.inf)
    path = np.zeros((len(trees), inner + 2**height))
    for t, tree in enumerate(trees.values()):
        open_nodes = [(0, 0, 0)]
        while open_nodes:
            at, place, level = open_nodes.pop()
            n = tree[at]
            if n.feature < 0:
                path[t, (place + 1) * 2 ** (height - level) - 1] = n.path
                continue
            feature[t, place], threshold[t, place] = n.feature, n.threshold
            open_nodes += [(n.left, 2 * place + 1, level + 1), (n.right, 2 * place + 2, level + 1)]
    return feature, threshold, path


def scorer(nodes: list, scale: float, features: int):
    """Arrow UDF: anomaly score 2^(-mean path / scale) of every row of a batch."""
    feature, threshold, path = complete_trees(nodes)
    trees, inner = feature.shape
    height = (inner + 1).bit_length() - 1
    scale = scale or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            data = np.ascontiguousarray(batch.to_numpy(dtype=float))
            flat, start = data.ravel(), np.arange(len(data)) * features
            total = np.zeros(len(data))
            for t in range(trees):
                at = np.zeros(len(data), dtype=np.int64)
                for _ in range(height):
                    value = flat.take(start + feature[t].take(at))
                    at = 2 * at + 1 + (value > threshold[t].take(at))
                total += path[t].take(at)
            yield pd.Series(np.exp2(-total / trees / scale))

    return score


def multivariate_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    contamination: float = 0.1,
    seed: int = 42,
    trees: int = TREES,
    size: int = SUBSAMPLE,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Rows without nulls in the numeric ``columns``, with ``anomaly_score`` and ``is_outlier``.

    The cut is the exact (1 - contamination) quantile of the scores.  ``keys`` limits the columns
    carried along (default: all).  Scored rows are written once: scoring is the expensive part and
    the quantile and the flags both read it.
    """
    names = numeric_columns(df, columns)
    kept = [col(c) for c in (keys if keys is not None else df.columns)]
    if not names:
        return df.select(*kept, F.lit(None).cast("double").alias("anomaly_score"), F.lit(False).alias("is_outlier")).limit(0)
    carried = [c.alias(f"kept_{i}") for i, c in enumerate(kept)]
    inputs = [f"feature_{i}" for i in range(len(names))]
    data = df.select(*carried, *[as_double(c).alias(f) for c, f in zip(names, inputs)]).dropna(subset=inputs)
    nodes = fit_forest(data, inputs, trees, size, seed).collect()  # bounded: trees x (2 size - 1) rows
    titles = list(keys if keys is not None else df.columns)
    if not nodes:
        return df.select(*kept, F.lit(None).cast("double").alias("anomaly_score"), F.lit(False).alias("is_outlier")).limit(0)
    scale = max(n.path for n in nodes if n.node == 0)  # a root holds c(its rows)
    score = scorer(nodes, scale, len(names))
    scored = materialize(
        data.select(*[f"kept_{i}" for i in range(len(kept))], score(F.struct(*inputs)).alias("anomaly_score"))
    )
    long = scored.select(F.lit(0).alias("column_id"), F.col("anomaly_score").alias("x"))
    cut = long_quantiles(long, (1.0 - contamination,)).collect()[0][1]
    few = scored.limit(2).count() < 2
    flag = F.lit(False) if few else F.col("anomaly_score") > F.lit(cut)
    return scored.select(
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(titles)], "anomaly_score", flag.alias("is_outlier")
    )


def multivariate_summary(flagged: DataFrame, contamination: float = 0.1) -> DataFrame:
    """One row: rows scored, outliers, their percentage, the contamination asked for."""
    return flagged.agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if("is_outlier").alias("outlier_count")
    ).select(
        "total_count",
        "outlier_count",
        F.coalesce(F.try_divide(F.col("outlier_count") * 100.0, F.col("total_count").cast("double")), F.lit(0.0)).alias(
            "outlier_percentage"
        ),
        F.lit(float(contamination)).alias("contamination"),
    )
