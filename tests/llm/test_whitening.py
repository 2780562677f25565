"""Whitening against numpy's dense eigenvalues and exact integers."""

import numpy as np
import pytest

from sparkprofile.llm import whitening
from sparkprofile.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, components=8):
    """``{position: (deviation, projections, explained)}`` in input order, from the dense covariance."""
    good = [v for v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(map(len, good))
    x = np.array([[int(np.floor(np.float32(c).astype(float) * 1024)) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for v in good], object)
    n, s = len(x), x.sum(0)
    y = ((n * x - s) / n).astype(float)
    e, axes = np.linalg.eigh(y.T @ y / n)
    e, axes = e[::-1], axes[:, ::-1]
    keep = e[:components] > 1e-12 * e[0]
    k = int(keep.sum())
    return n, ((n * x - s) ** 2).sum(1).tolist(), y @ axes[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(found, expected, places):
    """``places``: the id of each usable row."""
    n, deviation, z, explained = expected
    k = z.shape[1]
    assert len(found) == n * k
    at = {(r.vec_id, r.component): r for r in found}
    sign = [np.sign(sum(at[i, c + 1].whitened * z[j, c] for j, i in enumerate(places))) for c in range(k)]
    for j, i in enumerate(places):
        for c in range(k):
            r = at[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation[j])
            assert abs(r.whitened - sign[c] * z[j, c]) < 1e-8
            assert abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9


def test_query_matches_dense_eigenvectors(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    found = QUERIES["op13_chebyshev_whitening"](spark, folder).collect()
    compare(found, by_hand([r.embedding for r in table]), [r.vec_id for r in table])


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=40).tolist(), None) for i in range(120)]
    bad = [(500, None, 1), (501, [None] + [1.0] * 39, 1), (502, [float("nan")] * 40, 1), (503, [float("inf")] + [0.0] * 39, 1)]
    short = [(600, [1.0, 2.0], 1), (601, [], 1), (602, [0.0] * 40, 1)]
    df = spark.createDataFrame([*rows, *bad, *short], SCHEMA).selectExpr("*", "vec_id AS component", "'x' AS whitened", "0 AS n")
    good = [*rows, *short]
    compare(whitening.whiten(df, "vec_id", "embedding").collect(), by_hand([r[1] for r in good]), [r[0] for r in good])


def test_repeated_and_null_ids(spark):
    rows = [(None, [1.0, 0.0, 2.0], 1), (None, [0.0, 1.0, 5.0], 1), (7, [3.0, 3.0, -1.0], 1), (7, [3.0, 3.0, -1.0], 1)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()
    n, deviation, z, _ = by_hand([r[1] for r in rows])
    assert z.shape[1] == 2 and len(found) == 8 and {r.component for r in found} == {1, 2}
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)
    assert sum(r.vec_id is None for r in found) == 4
    assert abs(sorted(abs(r.whitened) for r in found if r.component == 2)[0] - sorted(np.abs(z[:, 1]))[0]) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)], [(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]])
def test_tables_without_components(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_entries_beyond_a_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding").collect()
    assert len(found) in (3, 6) and {r.deviation for r in found if r.vec_id < 3} == {None}
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding").collect()
    assert {r.vec_id: r.deviation for r in found}[3] is not None


def test_filter_finds_close_eigenvalues():
    rng = np.random.default_rng(2)
    width = 200
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    spectrum = np.concatenate([[1e4, 50.0], np.linspace(2.0, 1.9, 6), np.linspace(1.85, 0.0, width - 8)])
    matrix = (turn * spectrum) @ turn.T
    values, axes, residuals, passes = whitening.eigenpairs(lambda q: matrix @ q, width, 8)
    assert np.abs(values / spectrum[:8] - 1).max() < 1e-10
    assert np.abs(np.abs((axes * turn[:, :8]).sum(0)) - 1).max() < 1e-9
    assert residuals.max() <= whitening.ROUNDING and passes > 5
