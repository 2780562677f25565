"""Radix selection against sorted values."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, strategies as st

import sparkprofile as sp
from sparkprofile.functions.columns import numeric_long
from sparkprofile.operators import radix

SPECIAL = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, math.nan, 0.1, 1 / 3, 2.0**53, 1e-300]


@given(st.lists(st.floats(), min_size=2))
def test_bits_keep_the_order(values):
    bits = radix.ordered_bits(np.array(values))
    for a, x in zip(values, bits.tolist(), strict=True):
        for b, y in zip(values, bits.tolist(), strict=True):
            less = not math.isnan(a) and (math.isnan(b) or a < b)
            assert (x < y) == less
        assert radix.from_bits(x) == a or math.isnan(a)


def frame(spark, columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame([tuple(c[i] for c in columns.values()) for i in range(n)], ", ".join(f"{k} double" for k in columns))


def columns(n=3000):
    draw = random.Random(4)
    return {
        "normal": [draw.gauss(0, 1) for _ in range(n)], "hot": [7.5 if i % 3 else draw.random() for i in range(n)], "whole": [float(i % 40) for i in range(n)],
        "wide": [draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(n)], "gaps": [None if i % 2 else draw.random() for i in range(n)],
        "near": [1.0 + i * 2.0**-52 for i in range(n)], "special": [SPECIAL[i % len(SPECIAL)] for i in range(n)], "none": [None] * n, "zero": [0.0 if i % 2 else -0.0 for i in range(n)],
    }


def ordered(values):
    return sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize("room", [radix.TASK_BYTES, 60_000, 1])
@pytest.mark.parametrize("form", ["wide", "long"])
def test_every_rank(spark, monkeypatch, room, form):
    monkeypatch.setattr(radix, "TASK_BYTES", room)
    data = columns(300 if room == 1 else 3000)
    df = frame(spark, data).repartition(5)
    names = list(data)
    values = radix.wide(df, names) if form == "wide" else numeric_long(df, names)
    sizes = {i: len(ordered(c)) for i, c in enumerate(data.values())}
    ranks = {i: [0, 1, n // 4, n // 2, n - 2, n - 1] for i, n in sizes.items() if n}
    found = radix.select(values, ranks | {names.index("none"): [0]})
    assert found.keys() == {(i, r) for i, rs in ranks.items() for r in rs}
    for (i, r), v in found.items():
        assert same(v, ordered(data[names[i]])[r]), (names[i], r)


def test_quantiles_and_plans(spark):
    data = columns()
    df = frame(spark, data)
    got = {r["column"]: r for r in sp.quantiles(df, probabilities=(0.0, 0.1, 0.5, 0.999, 1.0)).collect()}
    for name, values in data.items():
        rest = ordered(values)
        for p, key in ((0.0, "q0"), (0.1, "q10"), (0.5, "q50"), (0.999, "q99_9"), (1.0, "q100")):
            if not rest:
                assert got[name][key] is None
                continue
            at = p * (len(rest) - 1)
            a, b = rest[int(at)], rest[min(int(at) + 1, len(rest) - 1)]
            assert same(got[name][key], a if at == int(at) or a == b else a + (b - a) * (at - int(at)))
    counts = radix._counted(radix.wide(df, list(data)), {0: [0]}, 48, 16)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "MapInArrow" in plan
    assert sp.quantiles(df.limit(0), ["normal"]).first()["q50"] is None


def test_passes_are_bounded():
    assert radix.passes(8, 6) == 4 and radix.passes(500, 6) <= 7


def test_missed_bounds_are_selected_by_bits(spark, monkeypatch):
    from sparkprofile.operators.quantiles import RankBounds, Selection

    monkeypatch.setattr(RankBounds, "interval", lambda self, first, second: (self.low, self.low))
    data = columns(500)
    df = frame(spark, {"normal": data["normal"], "hot": data["hot"]})
    found = Selection(numeric_long(df, ["normal", "hot"]), (0.25, 0.5, 0.75), deviation=True)
    for i, name in enumerate(("normal", "hot")):
        x = np.array(data[name])
        assert np.allclose(found.values[i], np.quantile(x, (0.25, 0.5, 0.75)), rtol=0, atol=1e-15)
        assert abs(found.deviations[i] - np.median(np.abs(x - np.median(x)))) < 1e-15
