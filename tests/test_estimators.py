"""Fold estimators on planted signals, and the stencils under them against loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import estimators, tiles
from gridloom.operators.boosting import Settings

N = (30, 30)
QUICK = Settings(rounds=8, rate=0.3, leaves=6, least=15, l2=1.0, depth=3)


def test_box_functions_by_loops():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(14, 11))
    a[5, 5] = np.nan
    inside = lambda y, x, r: all(0 <= y + i < 14 and 0 <= x + j < 11 and not np.isnan(a[y + i, x + j]) for i in range(-r, r + 1) for j in range(-r, r + 1))
    for r in (1, 3):
        got = tiles.whole_box(a, r)
        assert all(got[y, x] == inside(y, x, r) for y in range(14) for x in range(11))
    b = np.nan_to_num(a)
    at = lambda y, x: b[min(max(y, 0), 13), min(max(x, 0), 10)]
    mean = tiles.box_mean(b, 5)
    assert all(mean[y, x] == pytest.approx(np.mean([at(y + i, x + j) for i in range(-2, 3) for j in range(-2, 3)])) for y in range(14) for x in range(11))


def test_derivatives_of_known_surfaces():
    y, x = np.mgrid[:61, :61].astype(float) - 30
    mid = (slice(25, 36), slice(25, 36))
    assert np.allclose(tiles.derived(2 * x + 3 * y, 2.0, (0, 1), 5.0)[mid], 2.0, atol=1e-3)
    assert np.allclose(tiles.derived(2 * x + 3 * y, 2.0, (1, 0), 5.0)[mid], 3.0, atol=1e-3)
    assert np.allclose(tiles.derived(x * y, 2.0, (1, 1), 5.0)[mid], 1.0, atol=1e-2)
    assert np.allclose(tiles.derived(x * x, 2.0, (0, 2), 6.0)[mid], 2.0, atol=1e-2)
    ridge = tiles.least_curvature(-x * x, (2.0,))[mid]
    # kernels end at three sigma, so a curvature of 2 comes out a tenth too small
    assert np.allclose(ridge, 8.0, rtol=0.15) and tiles.least_curvature(x * x + y * y, (2.0,))[mid].max() < 0.5


def test_sharpened_by_loops(spark):
    rng = np.random.default_rng(3)
    p = {(y, x): float(rng.random()) for y in range(N[0]) for x in range(N[1]) if (y - 15) ** 2 + (x - 14) ** 2 < 150}
    df = spark.createDataFrame([(y, x, v) for (y, x), v in p.items()], "y long, x long, p double").repartition(3)
    got = {(r["y"], r["x"]): r["s"] for r in estimators.sharpened(df, "p", "s", N).collect()}
    assert set(got) == set(p)
    at = lambda y, x: p.get((min(max(y, 0), N[0] - 1), min(max(x, 0), N[1] - 1)), 0.0)
    gain = {}
    for y, x in p:
        means = []
        for k in range(8):
            t = k * math.pi / 8
            means.append(sum(at(y + round(s * math.sin(t)), x + round(s * math.cos(t))) for s in range(-4, 5)) / 9)
        gain[y, x] = max(max(means) - sum(means) / 8, 0.0)
    p99 = float(np.percentile(list(gain.values()), 99))
    for c, v in p.items():
        assert got[c] == pytest.approx(min(1.0, 0.72 * v + 0.28 * v * min(gain[c] / p99, 1.5)))


def test_soft_labels(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (9, 9)], "y long, x long")
    got = {(r["y"], r["x"]): r["s"] for r in estimators.soft_labels(df, spark.createDataFrame([(0, 0), (3, 2)], "y long, x long"), "s").collect()}
    assert got == {(0, 0): 1.0, (0, 1): pytest.approx(2 / 3), (2, 2): pytest.approx(2 / 3), (9, 9): 0.0}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(N[0] * N[1]):
        y, x = divmod(i, N[1])
        label = float(rng.random() < 0.2)
        a = None if rng.random() < 0.05 else label * 2 + y / 10 + float(rng.normal()) * 0.7  # signal on top of a nuisance
        rows.append((i, y, x, int(y < 15) * 2 + int(x < 15), label, float(y), float(x), bool(rng.random() < 0.7), a, float(rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "cell_id long, y long, x long, fold int, label double, c1 double, c2 double, covered boolean, a double, b double, c double").repartition(3)


CHANNELS = estimators.Channels(["a", "b", "c"], ["a"], ["c1", "c2"], ["a"], ["b"], "c", "b", "c", "covered")


def ranked(rows, name):
    pos, neg = ([r[name] for r in rows if r["label"] == k] for k in (1.0, 0.0))
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


def test_fold_surface_finds_the_signal(planted):
    known, target = planted.where("fold <> 0"), planted.where("fold = 0")
    got = estimators.fold_surface(known, known.where("label = 0"), target, CHANNELS, "label", N, QUICK)
    rows = got.join(target.select("cell_id", "label"), "cell_id").collect()
    assert len(rows) == target.count() and all(0 <= r["conduit"] <= r["sharp"] <= 1 for r in rows)
    assert ranked(rows, "sharp") > 0.85


def test_split_view_finds_the_signal(planted):
    known, target = planted.where("fold <> 0"), planted.where("fold = 0")
    soft = estimators.soft_labels(known, known.where("label = 1"), "soft")
    means = soft.agg(F.avg("label"), F.avg("soft")).first()
    got = estimators.split_view(known, soft, known.where("label = 0"), target, CHANNELS, ["a", "b"], "label", "soft", N, QUICK, population=tuple(means))
    rows = got.join(target.select("cell_id", "label", "covered"), "cell_id").collect()
    assert len(rows) == target.count() and ranked(rows, "core") > 0.85 and ranked(rows, "blend") > 0.8
    for r in rows:
        w = 0.52 if r["covered"] else 0.35
        assert r["blend"] == pytest.approx(w * r["core"] + (1 - w) * r["kernel"])
