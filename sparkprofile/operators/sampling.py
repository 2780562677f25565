"""Row selection: search, head, uniform samples, listwise deletion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, select_columns
from .frequency import value_text


def row_search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any cell, as lower-case text, contains ``text``; all rows for an empty search."""
    if not text:
        return df
    needle = F.lit(text.lower())
    hits = [F.contains(F.lower(value_text(df, c)), needle) for c in select_columns(df, columns)]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def sample_rows(df: DataFrame, n: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first n rows: by ``order_by`` (a distributed top-k), else any n."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n) if order_by else df.limit(n)


def smallest_draws(df: DataFrame, n: int, draw: str, *ties: Column) -> DataFrame:
    """The n rows with the smallest ``draw``, a number spread evenly over 0 to 1.

    A top-k alone would send n rows of every partition to one task.  So rows are counted, and only those below the share that
    holds n rows almost surely compete; the share is widened in the rare case that it holds fewer.
    """
    rows = df.count()
    share = 1.0 if rows <= 4 * n else min(1.0, (n + 6 * n**0.5 + 10) / rows)
    while True:
        some = df if share >= 1 else df.where(F.col(draw) < share)
        if share >= 1 or some.count() >= n:
            return some.orderBy(draw, *ties).limit(n)
        share = min(1.0, 4 * share)


def uniform_sample(df: DataFrame, n: int, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """n rows, every row equally likely, the same ones for the same seed.

    Rows are drawn by the n smallest MD5 digests of the seed and their unique ``keys``, joined by bars, which does not
    depend on the partitioning.  Without keys a seeded random number per row decides, so that
    copies of one row are drawn one by one.
    """
    if not keys:
        return smallest_draws(df.withColumn("_draw", F.rand(seed)), n, "_draw").drop("_draw")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]))
    share = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
    drawn = df.withColumn("_digest", digest).withColumn("_draw", share)
    return smallest_draws(drawn, n, "_draw", F.col("_digest"), *[col(k) for k in keys]).drop("_digest", "_draw")


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in ``columns`` (listwise deletion)."""
    return df.dropna(subset=select_columns(df, columns))
