"""Correlations: Pearson, Spearman, Cramer's V, point-biserial, and the matrix built from them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    NUMERIC, STRING, as_double, band, col, columns_of, numeric_columns, ratio, select_columns, stack, type_class,
)
from ..functions.session import materialize
from ..functions.special import correlation_p_value
from . import frequency as fq
from .statistics import categorical_names

# Distinct share of a categorical column here, strength bands.
CATEGORICAL_RATIO = 0.1
STRENGTH_BANDS = [(0.8, "very strong"), (0.6, "strong"), (0.4, "moderate")]
STRONG = 0.6
# Partners per stacked row; keeps the aggregation buffer inside whole-stage codegen.
SLOTS = 8
# Side of a tile of rank products: 16 sums for each stacked row.
TILE = 4
# A rank table of at most this many distinct values is broadcast (24 bytes each).
BROADCAST_VALUES = 200_000
# Copies of a very common value in the rank lookup.
SALTS = 64

PAIR_SCHEMA = "column1 string, column2 string, correlation double, method string, p_value double, n bigint"


def pair_moments(df: DataFrame, pairs: Sequence[tuple[str, str]], values: dict[str, Column]) -> DataFrame:
    """``(column1, column2, n, cov, sd1, sd2)`` over the rows where both sides are present.

    One scan for all pairs: a row becomes one row per left column and eight partners, grouped by a
    small integer, so the buffer fits whole-stage codegen for any number of columns and only
    ``groups x partitions`` rows are shuffled.
    """
    groups: list[tuple[str, list[str]]] = []
    for left in dict.fromkeys(a for a, _ in pairs):
        partners = [b for a, b in pairs if a == left]
        groups += [(left, partners[i : i + SLOTS]) for i in range(0, len(partners), SLOTS)]
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    prepared = df.select(*[values[c].cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    at = {c: F.col(f"v{i}") for i, c in enumerate(names)}
    width = max(len(p) for _, p in groups)
    null = F.lit(None).cast("double")
    rows = [
        [F.lit(g), at[left], *[at[p] for p in partners], *[null] * (width - len(partners))]
        for g, (left, partners) in enumerate(groups)
    ]
    schema = "g int, x double" + "".join(f", y{k} double" for k in range(width))
    x = F.col("x")
    sums = []
    for k in range(width):
        y = F.col(f"y{k}")
        sums += [
            F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{k}"),
            F.covar_pop(x, y).alias(f"c{k}"),
            F.var_pop(F.when(y.isNotNull(), x)).alias(f"a{k}"),
            F.var_pop(F.when(x.isNotNull(), y)).alias(f"b{k}"),
        ]
    wide = stack(prepared, rows, schema).groupBy("g").agg(*sums)
    long = stack(
        wide,
        [[F.col("g"), F.lit(k), *[F.col(f"{s}{k}") for s in "ncab"]] for k in range(width)],
        "g int, slot int, n bigint, cov double, var1 double, var2 double",
    )
    labels = df.sparkSession.createDataFrame(
        [(g, k, left, p) for g, (left, partners) in enumerate(groups) for k, p in enumerate(partners)],
        "g int, slot int, column1 string, column2 string",
    )
    return labels.join(F.broadcast(long), ["g", "slot"], "left").select(
        "column1", "column2", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "cov",
        F.sqrt("var1").alias("sd1"), F.sqrt("var2").alias("sd2"),
    )


def _finish(moments: DataFrame, method: str, small_p: Column | None = None) -> DataFrame:
    """Coefficient and p-value; constant columns and pairs below two rows have none and drop out."""
    r = F.when((F.col("sd1") > 0) & (F.col("sd2") > 0), ratio(F.col("cov"), F.col("sd1") * F.col("sd2")))
    found = moments.withColumn("r", r).where((F.col("n") >= 2) & F.col("r").isNotNull() & ~F.isnan("r"))
    kept = found.withColumn("correlation", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))))
    p = correlation_p_value("correlation", F.col("n").cast("double"))
    p = p if small_p is None else F.when(F.col("n") == 2, small_p).otherwise(p)
    return kept.select("column1", "column2", "correlation", F.lit(method).alias("method"), p.alias("p_value"), "n")


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], PAIR_SCHEMA)


def pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All numeric pairs: ``(column1, column2, correlation, method, p_value, n)``."""
    names = numeric_columns(df, columns)
    pairs = list(combinations(names, 2))
    if not pairs:
        return _empty(df)
    return _finish(pair_moments(df, pairs, {c: as_double(c) for c in names}), "pearson")


def spearman(
    df: DataFrame, columns: Sequence[str] | None = None, ordered: DataFrame | None = None
) -> DataFrame:
    """Pearson's coefficient of tie-averaged ranks, ranked after pairwise deletion.

    A column is ranked once on its own, and once more for each partner with nulls (over the rows
    where that partner is present).  All rankings come from one rank table and are looked up per
    value; the coefficient is then one pass over the ranked rows.  ``ordered`` is the ordered
    frequency table of the same columns when the caller has it; it serves columns without nulls.
    """
    names = numeric_columns(df, columns)
    pairs = list(combinations(names, 2))
    if not pairs:
        return _empty(df)
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    gaps = {c for i, c in enumerate(names) if counts[f"c{i}"] < counts["n"]}
    rankings: dict[tuple[str, str | None], int] = {}
    sides = {}
    for a, b in pairs:
        first = (a, b if b in gaps else None)
        second = (b, a if a in gaps else None)
        for key in (first, second):
            rankings.setdefault(key, len(rankings))
        sides[a, b] = (rankings[first], rankings[second])
    prepared = df.select(
        *[
            (as_double(c) if other is None else F.when(col(other).isNotNull(), as_double(c))).alias(f"r{i}")
            for (c, other), i in rankings.items()
        ]
    )
    # without gaps ranking number i is that of column number i
    ranked, sizes = centred_ranks(prepared, [f"r{i}" for i in rankings.values()], None if gaps else ordered)
    # both rankings of a pair hold the rows where both sides are present
    labels = df.sparkSession.createDataFrame(
        [(a, b, i, j, sizes[i]) for (a, b), (i, j) in sides.items()], "column1 string, column2 string, i int, j int, n bigint"
    )
    sums = rank_products(ranked, list(sides.values()), len(rankings))
    squares = sums.where("i = j")
    moments = labels
    for table in (
        sums.select("i", "j", F.col("s").alias("xy")), squares.select("i", F.col("s").alias("xx")), squares.select("j", F.col("s").alias("yy")),
    ):
        moments = moments.join(F.broadcast(table), [c for c in "ij" if c in table.columns])
    named = moments.select(
        "column1", "column2", "n", ratio(F.col("xy"), F.col("n")).alias("cov"),
        F.sqrt(ratio(F.col("xx"), F.col("n"))).alias("sd1"), F.sqrt(ratio(F.col("yy"), F.col("n"))).alias("sd2"),
    )
    return _finish(named, "spearman", small_p=F.lit(None).cast("double"))


def rank_products(ranked: DataFrame, pairs: Sequence[tuple[int, int]], rankings: int) -> DataFrame:
    """``(i, j, s)``: the sum of products of centred ranks of each pair, and of each ranking with itself.

    Centred ranks have mean zero exactly, so plain sums lose nothing and take the place of running means.  One scan: a row
    becomes one row per tile of ``TILE`` by ``TILE`` rankings that holds a pair.
    """
    wanted = {*pairs, *((i, i) for i in range(rankings))}
    tiles: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in sorted(wanted):
        tiles.setdefault((i // TILE, j // TILE), []).append((i, j))
    at = [F.col(f"rank_r{i}") for i in range(rankings)] + [F.lit(None).cast("double")] * TILE
    rows = [
        [F.lit(g), *at[p * TILE : (p + 1) * TILE], *at[q * TILE : (q + 1) * TILE]] for g, (p, q) in enumerate(tiles)
    ]
    sides = range(TILE)
    schema = "g int" + "".join(f", x{k} double" for k in sides) + "".join(f", y{k} double" for k in sides)
    wide = stack(ranked, rows, schema).groupBy("g").agg(
        *[F.sum(F.col(f"x{k}") * F.col(f"y{m}")).alias(f"s{k}_{m}") for k in sides for m in sides]
    )
    cells = stack(
        wide, [[F.col("g"), F.lit(k), F.lit(m), F.col(f"s{k}_{m}")] for k in sides for m in sides], "g int, k int, m int, s double"
    )
    places = ranked.sparkSession.createDataFrame(
        [(g, i % TILE, j % TILE, i, j) for g, inside in enumerate(tiles.values()) for i, j in inside], "g int, k int, m int, i int, j int"
    )
    return places.join(F.broadcast(cells), ["g", "k", "m"]).select("i", "j", "s")


def centred_ranks(
    df: DataFrame, columns: Sequence[str], ordered: DataFrame | None = None
) -> tuple[DataFrame, list[int]]:
    """``rank_<column>`` for every row of ``df``: the tie-averaged rank of each non-null value less the mean rank; and the non-null values of each column.

    Columns whose rank table has few values look it up by broadcast.  All others go together, whatever their number: rows get an
    id, turn into long form, meet their ranks in one join and are put together again by id.  A value that holds
    more than one shuffle partition's share of its column is joined under several salts.
    """
    ranks = (fq.column_ranks(df, columns) if ordered is None else fq.rank_rows(ordered)).select("x", "count", "lo", "hi", "column_id")
    ranks = materialize(ranks, by="column_id")  # each lookup below reads the folder of its column
    sizes = {
        r.column_id: (r.values, r.rows)
        for r in ranks.groupBy("column_id").agg(F.count(F.lit(1)).alias("values"), F.sum("count").alias("rows")).collect()
    }  # one row per column
    present = [sizes.get(i, (0, 0))[1] for i in range(len(columns))]
    total = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in present]), F.col("column_id") + 1)
    ranks = ranks.withColumn("rank", (F.col("lo") + F.col("hi") - total) / F.lit(2.0))  # a column's mean rank is (total + 1) / 2
    large = [i for i in range(len(columns)) if sizes.get(i, (0, 0))[0] > BROADCAST_VALUES]
    for i, c in enumerate(columns):
        if i not in large:
            small = ranks.where(F.col("column_id") == i).select(F.col("x").alias(c), F.col("rank").alias(f"rank_{c}"))
            df = df.join(F.broadcast(small), c, "left").drop(c)
    if not large:
        return df, present
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    long = stack(
        rows, [[F.col("_row"), F.lit(i), F.col(columns[i])] for i in large], "_row bigint, column_id int, x double"
    ).where(F.col("x").isNotNull())
    table = ranks.where(F.col("column_id").isin(large))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # at most one value per column and shuffle partition
    hot = table.where(F.col("count") * partitions > total).select("column_id", "x", F.lit(True).alias("hot"))
    salted = long.join(F.broadcast(hot), ["column_id", "x"], "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lookup = table.join(F.broadcast(hot), ["column_id", "x"], "left").select("column_id", "x", "rank", F.explode(copies).alias("salt"))
    # x first: the sort of the join compares 8-byte prefixes of its first key
    # every row has its own id: combining before the shuffle would only fill memory
    found = salted.join(lookup, ["x", "column_id", "salt"]).select("_row", "column_id", "rank").repartition("_row").groupBy("_row").agg(
        *[F.max(F.when(F.col("column_id") == i, F.col("rank"))).alias(f"rank_{columns[i]}") for i in large]
    )
    return rows.drop(*[columns[i] for i in large]).join(found, "_row", "left").drop("_row"), present


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(pair, a, b, count)`` of the non-null combinations of every column pair, in one scan."""
    long = stack(
        df,
        [[F.lit(i), col(a).cast("string"), col(b).cast("string")] for i, (a, b) in enumerate(pairs)],
        "pair int, a string, b string",
    )
    return (
        long.where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("pair", "a", "b")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def contingency_table(df: DataFrame, column1: str, column2: str, wide: bool = False) -> DataFrame:
    """Counts of value combinations: long ``(a, b, count)``, or pivoted on ``column2`` with zeros."""
    cells = contingency(df, [(column1, column2)]).drop("pair")
    if not wide:
        return cells
    return cells.groupBy(F.col("a").alias(column1)).pivot("b").agg(F.sum("count")).na.fill(0)


def chi_square_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(pair, n, rows, cols, chi2)`` per column pair.

    n * (sum(o^2 / (row * col)) - 1) equals the dense sum over all cells, empty ones included,
    and needs only the combinations that occur.
    """
    cells = contingency(df, pairs)
    rows = cells.groupBy("pair", "a").agg(F.sum("count").alias("row_total"))
    cols = cells.groupBy("pair", "b").agg(F.sum("count").alias("col_total"))
    share = F.col("count").cast("double") * F.col("count") / F.col("row_total").cast("double") / F.col("col_total")
    sums = (
        cells.join(rows, ["pair", "a"])
        .join(cols, ["pair", "b"])
        .groupBy("pair")
        .agg(F.sum("count").alias("n"), F.sum(share).alias("s"))
    )
    shape = (
        rows.groupBy("pair").agg(F.count(F.lit(1)).alias("rows"))
        .join(cols.groupBy("pair").agg(F.count(F.lit(1)).alias("cols")), "pair")
    )
    return sums.join(F.broadcast(shape), "pair").select(
        "pair", "n", "rows", "cols", F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1.0)).alias("chi2")
    )


def _pair_labels(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column1 string, column2 string"
    )


def chi_square(df: DataFrame, column1: str, column2: str) -> DataFrame:
    """``(column1, column2, chi2, degrees, n)`` of the contingency table of two columns."""
    pairs = [(column1, column2)]
    return _pair_labels(df, pairs).join(F.broadcast(chi_square_pairs(df, pairs)), "pair", "left").select(
        "column1", "column2",
        F.coalesce("chi2", F.lit(0.0)).alias("chi2"),
        ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("degrees"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def cramers_v(df: DataFrame, columns: Sequence[str] | None = None, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of categorical string columns; no bias correction."""
    if pairs is None:
        pairs = list(combinations(categorical_names(df, columns, CATEGORICAL_RATIO), 2))
    if not pairs:
        return _empty(df)
    smaller = F.least("rows", "cols") - 1
    v = F.sqrt(ratio(F.col("chi2"), F.col("n") * smaller))
    return (
        _pair_labels(df, pairs)
        .join(F.broadcast(chi_square_pairs(df, pairs)), "pair")
        .where((F.col("n") >= 2) & (smaller > 0))
        .select(
            "column1", "column2", v.alias("correlation"), F.lit("cramers_v").alias("method"),
            F.lit(None).cast("double").alias("p_value"), "n",
        )
    )


def binary_columns(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Columns with exactly two non-null values, with the larger of them (by text)."""
    if not names:
        return {}
    ends = df.agg(
        *[F.min(col(c).cast("string")).alias(f"a{i}") for i, c in enumerate(names)],
        *[F.max(col(c).cast("string")).alias(f"b{i}") for i, c in enumerate(names)],
    ).first()
    spread = {c: (ends[f"a{i}"], ends[f"b{i}"]) for i, c in enumerate(names) if ends[f"a{i}"] != ends[f"b{i}"]}
    if not spread:
        return {}
    # two values exactly when nothing lies between the smallest and the largest
    between = df.agg(
        *[
            F.count_if(~col(c).cast("string").isin(lo, hi)).alias(f"m{i}")
            for i, (c, (lo, hi)) in enumerate(spread.items())
        ]
    ).first()
    return {c: hi for i, (c, (_, hi)) in enumerate(spread.items()) if between[f"m{i}"] == 0}


def point_biserial(
    df: DataFrame, columns: Sequence[str] | None = None, categorical: Sequence[str] | None = None
) -> DataFrame:
    """Numeric columns against binary categorical ones; the larger category value is coded 1."""
    numbers = numeric_columns(df, columns)
    if categorical is None:
        categorical = categorical_names(df, columns, CATEGORICAL_RATIO)
    binary = binary_columns(df, categorical)
    pairs = [(x, c) for x in numbers for c in binary]
    if not pairs:
        return _empty(df)
    values = {x: as_double(x) for x in numbers}
    values.update({c: (col(c).cast("string") == F.lit(hi)).cast("double") for c, hi in binary.items()})
    return _finish(pair_moments(df, pairs, values), "point_biserial")


def analyze_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The four pair tables; all share one schema."""
    categorical = categorical_names(df, columns, CATEGORICAL_RATIO)
    return {
        "pearson": pearson(df, columns),
        "spearman": spearman(df, columns),
        "cramers_v": cramers_v(df, pairs=list(combinations(categorical, 2))),
        "mixed": point_biserial(df, columns, categorical),
    }


def correlation_matrix(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "pearson",
    wide: bool = False,
    undefined: float | None = 0.0,
) -> DataFrame:
    """Numeric matrix: diagonal 1, undefined pairs ``undefined``; long form or pivoted.

    Built from a pair table of at most (number of columns)^2 / 2 rows.
    """
    names = numeric_columns(df, columns)
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be pearson or spearman")
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "row string, col string, correlation double")
    pairs = (pearson if method == "pearson" else spearman)(df, names).select("column1", "column2", "correlation")
    grid = spark.createDataFrame(
        [(i, j, a, b, *sorted((i, j))) for i, a in enumerate(names) for j, b in enumerate(names)],
        "i int, j int, row string, col string, lo int, hi int",
    )
    at = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
    numbered = pairs.select(at[F.col("column1")].alias("lo"), at[F.col("column2")].alias("hi"), "correlation")
    cell = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.coalesce("correlation", F.lit(undefined)))
    long = grid.join(F.broadcast(numbered), ["lo", "hi"], "left").select("i", "row", "col", cell.alias("correlation"))
    if not wide:
        return long.drop("i")
    return (
        long.groupBy("i", "row").pivot("col", names).agg(F.first("correlation")).orderBy("i").drop("i")
    )


def top_pairs(pairs: DataFrame, n: int = 10, min_correlation: float = 0.5) -> DataFrame:
    """The n strongest of a pair table, with their strength band."""
    size = F.abs("correlation")
    return (
        pairs.where(size >= min_correlation)
        .withColumn("strength", band(size, STRENGTH_BANDS, "weak", strict=True))
        .orderBy(size.desc(), "column1", "column2", "method")
        .limit(n)
    )


def top_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = 10, min_correlation: float = 0.5
) -> DataFrame:
    """The n strongest pairs of all four kinds with abs(correlation) of at least ``min_correlation``."""
    first, *rest = analyze_correlations(df, columns).values()
    pairs = first
    for table in rest:
        pairs = pairs.unionByName(table)
    return top_pairs(pairs, n, min_correlation)


def column_pair_correlation(df: DataFrame, column1: str, column2: str) -> DataFrame:
    """The coefficient(s) that fit the two column types."""
    for c in (column1, column2):
        if c not in df.columns:
            raise ValueError(f"column {c} not found")
    numeric = [type_class(df.schema[c].dataType) == NUMERIC for c in (column1, column2)]
    if all(numeric):
        both = df.select(col(column1), col(column2))
        return pearson(both).unionByName(spearman(both))
    if not any(numeric):
        return cramers_v(df, pairs=[(column1, column2)])
    number, other = (column1, column2) if numeric[0] else (column2, column1)
    if not binary_columns(df, [other]):
        raise ValueError("no appropriate correlation method for these column types")
    return point_biserial(df.select(col(number), col(other)), categorical=[other])


def correlation_columns(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Names used by the analysis: numeric and categorical."""
    return {
        "numeric": numeric_columns(df, columns),
        "categorical": categorical_names(df, columns, CATEGORICAL_RATIO)
        if columns_of(df, STRING, columns=select_columns(df, columns))
        else [],
    }
