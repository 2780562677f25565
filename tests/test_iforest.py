"""Isolation forest: planted outliers, share, repeatability, tree layout."""

import numpy as np
import pandas as pd
import pytest

import sparkprofile as sp
from sparkprofile.operators import iforest


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(rng.normal(size=(2000, 3)), columns=["a", "b", "c"])
    pdf.loc[:9, ["a", "b", "c"]] = 12.0 + rng.normal(size=(10, 3))
    pdf["id"] = [f"r{i}" for i in range(len(pdf))]
    return spark.createDataFrame(pdf).repartition(5, "id")


def test_planted_outliers_score_highest(planted):
    out = sp.multivariate_outliers(planted, keys=["id"])
    rows = out.toPandas().sort_values("anomaly_score", ascending=False)
    assert set(rows.id.head(10)) == {f"r{i}" for i in range(10)}
    assert rows.is_outlier.mean() == pytest.approx(0.1, abs=0.005)
    summary = sp.multivariate_summary(out).first()
    assert summary.total_count == 2000 and summary.outlier_percentage == pytest.approx(10, abs=0.5)


def test_same_seed_same_result(planted):
    a = {r.id: r.anomaly_score for r in sp.multivariate_outliers(planted, keys=["id"], trees=20).collect()}
    b = {r.id: r.anomaly_score for r in sp.multivariate_outliers(planted, keys=["id"], trees=20).collect()}
    assert a == b


def test_nulls_are_dropped_and_small_input(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    out = sp.multivariate_outliers(df).collect()
    assert len(out) == 1 and not out[0].is_outlier
    assert sp.multivariate_outliers(spark.createDataFrame([("x",)], "s string")).count() == 0
    assert sp.multivariate_outliers(df.where("a < 0")).count() == 0


def test_each_tree_gets_its_rows(planted):
    for trees, size in ((10, 64), (50, 256)):
        counts = iforest.draw_subsamples(planted, ["a", "b", "c"], trees, size, 1).groupBy("tree").count().collect()
        assert len(counts) == trees and {r["count"] for r in counts} == {size}


def test_complete_layout_equals_walking_the_tree(planted):
    nodes = iforest.fit_forest(planted, ["a", "b", "c"], trees=5, size=64).collect()
    feature, threshold, path = iforest.complete_trees(nodes)
    trees = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n
    rng = np.random.default_rng(0)
    height = (feature.shape[1] + 1).bit_length() - 1
    for t, tree in enumerate(trees.values()):
        for x in rng.normal(size=(50, 3)) * 3:
            n = tree[0]
            while n.feature >= 0:
                n = tree[n.left if x[n.feature] <= n.threshold else n.right]
            at = 0
            for _ in range(height):
                at = 2 * at + 1 + (x[feature[t, at]] > threshold[t, at])
            assert path[t, at] == n.path
