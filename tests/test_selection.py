"""Exact quantiles and median deviations by selection, ranks, and what is built on them."""

import re
from unittest import mock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import sparkprofile as sp
from sparkprofile.functions.columns import numeric_long
from sparkprofile.operators import correlations as co
from sparkprofile.operators.frequency import column_ranks
from sparkprofile.operators.quantiles import Selection

LEVELS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def shapes() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    n = 20_000
    heavy = np.where(rng.random(n) < 0.4, 5.0, rng.normal(0, 10, n))  # one value holds 40 percent
    return {
        "normal": rng.normal(100, 15, n),
        "skewed": rng.lognormal(0, 2, n),
        "hot": heavy,
        "few": rng.integers(0, 4, n).astype(float),
        "constant": np.full(n, 3.0),
        "two": np.where(rng.random(n) < 0.5, -1.0, 1.0),
        "wide": rng.normal(0, 1, n) * 10.0 ** rng.integers(-8, 9, n),
    }


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(pd.DataFrame(shapes())).repartition(7)


@pytest.mark.parametrize("options", [{}, {"interval_values": 300}, {"interval_values": 3, "accuracy": 50}])
def test_selection_is_exact(frame, options):
    data = shapes()
    names = list(data)
    found = Selection(numeric_long(frame, names), LEVELS, deviation=True, **options)
    for i, name in enumerate(names):
        x = data[name]
        assert found.values[i] == pytest.approx(np.quantile(x, LEVELS), rel=1e-12, abs=1e-12), name
        assert found.deviations[i] == pytest.approx(np.median(np.abs(x - np.median(x))), rel=1e-12, abs=1e-12), name


def test_selection_survives_a_wrong_sketch(frame):
    """A sketch that breaks its promise costs a pass, not the result."""
    from sparkprofile.operators import quantiles as q

    def wrong(self, values, below, inside, accuracy):
        self._points += [(v, 0, self.n) for v in values[:1]]
        self._sort()

    data = shapes()
    with mock.patch.object(q.RankBounds, "add", wrong):
        found = Selection(numeric_long(frame, ["normal", "hot"]), (0.25, 0.5), deviation=True)
    for i, name in enumerate(("normal", "hot")):
        x = data[name]
        assert found.values[i] == pytest.approx(np.quantile(x, (0.25, 0.5)))
        assert found.deviations[i] == pytest.approx(np.median(np.abs(x - np.median(x))))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_selection_of_few_values(spark, n):
    x = [7.0, -2.0, 7.0, 1.5, 0.0][:n]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    found = Selection(numeric_long(df, ["x"]), LEVELS, deviation=True)
    assert found.values[0] == pytest.approx(np.quantile(x, LEVELS))
    assert found.deviations[0] == pytest.approx(np.median(np.abs(np.array(x) - np.median(x))))


def test_selection_with_infinite_values(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, "inf"]], "x double")
    found = Selection(numeric_long(df, ["x"]), (0.25, 0.5), deviation=True)
    assert found.values[0] == [2.0, 3.0]
    assert found.deviations[0] == 1.0


def test_ranks_equal_pandas(frame):
    data = shapes()
    names = list(data)
    ranks = column_ranks(frame, names).toPandas()
    for i, name in enumerate(names):
        mine = ranks[ranks.column_id == i].set_index("x")
        average = (mine.lo + 1 + mine.hi) / 2
        expected = pd.Series(data[name]).rank()
        assert np.allclose(average.loc[data[name]].to_numpy(), expected.to_numpy())


@pytest.mark.parametrize("limit", [0, 200_000])
def test_spearman_by_shuffle_and_broadcast(spark, limit):
    """Hot values, nulls and both lookup ways give pandas' coefficients."""
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"x": x, "y": np.where(rng.random(n) < 0.35, 0.0, x + rng.normal(size=n)), "z": rng.integers(0, 9, n) * 1.0})
    pdf.loc[rng.random(n) < 0.3, "y"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "z"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, y double, z double")
    with mock.patch.object(co, "BROADCAST_VALUES", limit):
        rows = sp.spearman(df).collect()
    assert len(rows) == 3
    for r in rows:
        both = pdf[[r.column1, r.column2]].dropna()
        expected = both[r.column1].rank().corr(both[r.column2].rank())
        assert r.correlation == pytest.approx(expected, abs=1e-12)
        assert r.n == len(both)


def test_pearson_many_columns(spark):
    """More partners than slots, with nulls."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(500, 12)), columns=[f"c{i}" for i in range(12)])
    pdf["c3"] = pdf.c0 * 2 + pdf.c3
    pdf.loc[::7, "c5"] = np.nan
    pdf["c11"] = 4.0
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"c{i} double" for i in range(12)))
    found = {(r.column1, r.column2): r.correlation for r in sp.pearson(df).collect()}
    assert len(found) == 55  # the constant column has no coefficient
    expected = pdf.corr()
    for (a, b), r in found.items():
        assert r == pytest.approx(expected.loc[a, b], abs=1e-12)


def test_results_do_not_depend_on_partitioning(spark, frame):
    names = ["normal", "hot", "few"]
    for operator in (sp.numeric_stats, sp.detect_outliers, sp.histogram):
        one = {tuple(r)[:2]: r for r in operator(frame.coalesce(1), names).collect()}
        many = {tuple(r)[:2]: r for r in operator(frame.repartition(23), names).collect()}
        assert one.keys() == many.keys()
        for key, row in one.items():
            for a, b in zip(row, many[key]):
                assert a == pytest.approx(b, rel=1e-9) if isinstance(a, float) else a == b


def test_qq_expansion_splits_ties(spark, frame):
    from sparkprofile.operators import plotdata

    with mock.patch.object(plotdata, "QQ_CHUNK", 100):
        points = sp.qq_points(frame, "hot").orderBy("position").toPandas()
    x = np.sort(shapes()["hot"])
    assert (points.position.to_numpy() == np.arange(1, len(x) + 1)).all()
    assert np.allclose(points["sample"], x)
    assert points.theoretical.is_monotonic_increasing


def test_kde_equals_direct_formula(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.gamma(2, 10, 500), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    out = sp.kde(df, ["x"]).orderBy("point").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    pad = 0.1 * (x.max() - x.min())
    grid = np.linspace(x.min() - pad, x.max() + pad, 100)
    direct = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(out.x, grid) and np.abs(out.density - direct).max() < 1e-12
    binned = sp.kde(df, ["x"], binned=True).orderBy("point").toPandas()
    assert np.abs(binned.density - direct).max() < 1e-3 * direct.max()


def test_kde_of_far_values(spark):
    """Grid points without a value near them, values far from each other, and cells on their edges."""
    x = np.concatenate([np.arange(40) / 8, [1e7, -1e7, 3.0, 3.0], np.linspace(-1, 1, 5000)])
    df = spark.createDataFrame([(float(v), float(v) * 1e-9 if i % 7 else None) for i, v in enumerate(x)], "x double, y double")
    out = sp.kde(df, ["x", "y"], points=400).toPandas()
    for name, values in {"x": x, "y": np.array([v * 1e-9 for i, v in enumerate(x) if i % 7])}.items():
        mine = out[out.column == name].sort_values("point")
        h = values.std(ddof=1) * len(values) ** -0.2
        direct = np.exp(-0.5 * ((mine.x.to_numpy()[:, None] - values) / h) ** 2).sum(axis=1)
        scaled = mine.density.to_numpy() * len(values) * h * np.sqrt(2 * np.pi)
        assert len(mine) == 400 and np.abs(scaled - direct).max() < 1e-9
        assert (mine.density == 0).any()


def test_histogram_equals_numpy(frame):
    data = shapes()
    out = sp.histogram(frame, list(data), bins=30).toPandas()
    for name, x in data.items():
        counts, edges = np.histogram(x, 30)
        mine = out[out.column == name].sort_values("bin")
        assert (mine["count"].to_numpy() == counts).all(), name
        assert np.allclose(mine.lower, edges[:-1]) and np.allclose(mine.upper, edges[1:])


def test_rolling_average_equals_pandas(spark):
    rng = np.random.default_rng(9)
    n = 2500
    pdf = pd.DataFrame({"ts": rng.integers(0, 400, n), "id": np.arange(n), "v": rng.normal(size=n)})
    df = spark.createDataFrame(pdf).repartition(11)
    out = sp.rolling_average(df, "ts", "v", tie=["id"], chunk_rows=100).toPandas().sort_values(["ts", "id"])
    expected = pdf.sort_values(["ts", "id"]).v.rolling(30).mean()
    assert len(out) == n
    assert np.allclose(out["rolling"].astype(float), expected, equal_nan=True)


def test_rolling_average_of_a_short_series(spark):
    df = spark.range(9).select(F.col("id").alias("ts"), F.col("id").cast("double").alias("v"))
    assert sp.rolling_average(df, "ts", "v").where("rolling IS NOT NULL").count() == 0
    out = sp.rolling_average(spark.range(25).selectExpr("id ts", "double(id) v"), "ts", "v").orderBy("ts").collect()
    assert [r.rolling for r in out][:3] == [None, 0.5, 1.5]  # window of two


@pytest.mark.parametrize("head", [16, 1])
def test_text_leaders_equal_direct_counts(spark, head):
    """Above, tied and single texts; ties that differ late, in other alphabets, or by length only."""
    from sparkprofile.operators import frequency as fq

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({
        "single": [f"t{i}" for i in range(300)],
        "tied": [f"t{i % 100}" for i in range(300)],
        "some": [f"t{min(i, 297)}" for i in range(300)],
        "few": rng.choice(list("abc"), 300),
        "gaps": [None if i % 3 else f"t{i % 7}" for i in range(300)],
        "twice": [f"{'same beginning ' * 20}{(i * 7) % 150:05d}" for i in range(300)],
        "nested": ["ab" * (1 + i % 60) for i in range(300)],
        "signs": [("", "é", "\U0001f600", "\uffff", "z\x00", "z")[i % 6] + "x" * (i % 30) for i in range(300)],
        "none": [None] * 300,
    })
    names = list(pdf)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} string" for c in names))
    with mock.patch.object(fq, "HEAD_BYTES", head):
        top, unique = fq.text_leaders(df.repartition(5), names, 4)
        mine = {(r.column_id, r["rank"]): (r.value, r["count"]) for r in top.collect()}
        distinct = {r.column_id: r.unique_count for r in unique.collect()}
    for i, name in enumerate(names):
        counts = pdf[name].dropna().value_counts()
        expected = sorted(counts.items(), key=lambda item: (-item[1], item[0].encode()))[:4]
        assert [mine[i, k + 1] for k in range(len(expected))] == expected, name
        assert (i, len(expected) + 1) not in mine
        assert distinct.get(i, 0) == len(counts)


def test_text_leaders_look_up_few_texts(spark):
    """Whatever is tied, no plan sorts or shuffles texts: only the winners are looked up."""
    from sparkprofile.operators import frequency as fq

    df = spark.range(40_000).selectExpr("concat('a long text of which most occur twice ', lpad(id % 20000, 6, '0')) AS t")
    top, unique = fq.text_leaders(df, ["t"], 3)
    assert [(r.value[-6:], r["count"]) for r in top.orderBy("rank").collect()] == [("000000", 2), ("000001", 2), ("000002", 2)]
    assert unique.first().unique_count == 20_000


def test_rank_lookup_sorts_by_value_and_regroups_once(spark):
    draw = np.random.default_rng(5)
    values = np.round(draw.normal(size=(500, 6)), 1)
    values[:, 5] = 3.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in values], ", ".join(f"r{i} double" for i in range(6)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with mock.patch.object(co, "BROADCAST_VALUES", 0):
            ranked, present = co.centred_ranks(df, df.columns)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert present == [500] * 6 and all(c.startswith("rank_") for c in ranked.columns)
    assert re.search(r"Sort \[\S*\bx#", plan) and not re.search(r"Sort \[\S*column_id#", plan)
    # one shuffle by row on either side of the last join, the ranks before they are grouped
    assert plan.count("hashpartitioning(_row#") == 2 and "REPARTITION_BY_COL" in plan
    pairs = [(i, j) for i in range(6) for j in range(i + 1, 6)]
    sums = {(r.i, r.j): r.s for r in co.rank_products(ranked, pairs, 6).collect()}
    ranks = pd.DataFrame(values).rank().to_numpy()
    expected = (ranks - ranks.mean(0)).T @ (ranks - ranks.mean(0))
    assert sums == pytest.approx({(i, j): expected[i, j] for i in range(6) for j in range(i, 6)}, abs=1e-6)
    assert {(r.column1, r.column2) for r in sp.spearman(df).collect()} == {(f"r{i}", f"r{j}") for i, j in pairs if j < 5}
