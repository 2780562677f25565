"""Approximate neighbours against all distances."""

import numpy as np
import pytest

from sparkprofile.llm import ann
from sparkprofile.llm.queries import QUERIES


def brute(rows, queries, k=10):
    """``[[(score, id)]]`` of each query row: all other rows by distance, ties by id."""
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    out = []
    for i, v in queries:
        own = next((n for n, (j, u) in enumerate(usable) if j == i and np.array_equal(u, np.pad(np.array(v, float), (0, width - len(v))))), None)
        if own is None:
            continue
        rest = [(float(np.sqrt(((u - usable[own][1]) ** 2).sum())), j) for n, (j, u) in enumerate(usable) if n != own]
        out.append((i, sorted(rest, key=lambda x: (x[0], -1 if x[1] is None else x[1]))[:k]))
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_query_recall(spark, folder):
    folder = f"/root/testdata/{folder}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    expected = dict(brute(rows, [r for r in rows if r[0] % 100 == 0]))
    found = answers(QUERIES["op11_rotated_codes"](spark, folder))
    assert found.keys() == expected.keys() and all(len(f) == 10 for f in found.values())
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, f in found.items():
        assert f == sorted(f) and q not in [i for _, i in f]
        assert all(abs(s - np.linalg.norm(vectors[q] - vectors[i])) < 1e-12 for s, i in f)
    hits = sum(len({i for _, i in f} & {i for _, i in expected[q]}) for q, f in found.items())
    assert hits >= 0.9 * 10 * len(found)


def test_blocks_copies_and_small_radii(spark, monkeypatch):
    """Groups of copies and near copies over many blocks; neighbours that are near are all found."""
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "SLOT", 3)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 24))
    rows = [(n, (centres[n % 60] + 0.02 * rng.normal(size=24)).tolist()) for n in range(900)]
    rows += [(1000 + n, [1.0] * 24) for n in range(400)] + [(2000 + n, (np.ones(24) + 0.001 * rng.normal(size=24)).tolist()) for n in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "0 AS rank", "'x' AS q", "1.5 AS score")
    expected = dict(brute(rows, [r for r in rows if r[0] % 50 == 0]))
    found = answers(ann.top_k(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 10))
    assert found.keys() == expected.keys()
    assert found[1000] == [(0.0, i) for i in range(1001, 1011)] and found[1050] == [(0.0, i) for i in range(1000, 1010)]
    hits = sum(len({i for _, i in f} & {i for _, i in expected[q]}) for q, f in found.items())
    assert hits >= 0.97 * sum(map(len, expected.values()))


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.5, 0.5]), (None, [1.0, 0.1]), (5, [2.0]), (6, None), (200, []), (300, [0.0, 0.0]), (7, [None, 1.0]),
        (400, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (500, [1e300, -1e300]), (9, [-0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = ann.top_k(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).collect()
    by = {}
    for r in sorted(found, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {0, 100, 500}
    assert len(by[500]) == 7 and len(by[0]) == 14 and len(by[100]) == 14  # two rows each, seven others
    assert [x for x in by[0] if x[0] == 1] == [(1, 0, 0.0)] * 2
    assert (9, 0.0) in [x[1:] for x in by[100] if x[0] == 1]
    assert any(i is None for _, i, _ in by[0])
    assert all(np.isfinite(s) for x in by.values() for _, _, s in x)
    for small in (df.limit(0), df.where("vec_id = 6"), df.where("vec_id = 300")):
        assert ann.top_k(small, small, "vec_id", "embedding").count() == 0
    assert ann.top_k(df, df.where("vec_id = 3"), "vec_id", "embedding").count() == 0
    one = df.where("vec_id = 5")
    assert ann.top_k(one, one, "vec_id", "embedding").count() == 0
