"""Boosted trees against a plain grower, tiles and filters against whole arrays, and the fits that go with them."""

import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boosting, fourier, models, solve, tiles
from gridloom.operators.boosting import MISSING, UNIT, Settings

SMALL = Settings(rounds=3, rate=0.3, leaves=5, least=8, l2=1.0, depth=4, bins=16)


# ---- trees


def plain_tree(bins, g, h, s, lost):
    """One tree by recursion over every split, best-first; [(rows, value)] of its leaves, and how it splits."""

    def best(rows):
        tg, th, found = g[rows].sum(), h[rows].sum(), None
        score = lambda a, b: (a / UNIT) * (a / UNIT) / (b / UNIT + s.l2)
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            for cut in sorted({int(c) for c in b[b != MISSING]}):
                for miss in (False, True) if (b == MISSING).any() else (False,):
                    left = (b <= cut) & (b != MISSING) | ((b == MISSING) & miss)
                    n, lg, lh = left.sum(), g[rows][left].sum(), h[rows][left].sum()
                    if min(n, len(rows) - n) < s.least or min(lh, th - lh) < UNIT * 1e-3:
                        continue
                    gain = score(lg, lh) + score(tg - lg, th - lh) - score(tg, th)
                    if gain > 0 and (found is None or (gain, -f, -cut, not miss) > found[0]):
                        found = (gain, -f, -cut, not miss), rows[left], rows[~left]
        return found

    value = lambda rows: -s.rate * g[rows].sum() / UNIT / (h[rows].sum() / UNIT + s.l2)
    leaves = [(0, np.arange(len(bins)), 0)]
    order = itertools.count(1)
    while len(leaves) < s.leaves:
        some = [(b[0][0], -o, i, b) for i, (o, rows, d) in enumerate(leaves) if d < s.depth and (b := best(rows))]
        if not some:
            break
        _, _, i, b = max(some, key=lambda x: x[:2])
        depth = leaves.pop(i)[2] + 1
        leaves += [(next(order), b[1], depth), (next(order), b[2], depth)]
    return [(rows, value(rows)) for _, rows, _ in leaves]


def plain_fit(model, x, y, w, s):
    bins = model.binned(list(x.T))
    raw = np.full(len(y), model.base)
    for _ in range(s.rounds):
        g, h = boosting.gradients(y, raw, w, s.loss, UNIT)
        step = np.zeros(len(y))
        for rows, value in plain_tree(bins, g, h, s, model.lost):
            step[rows] = value
        raw = raw + step
    return raw


def sample(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[rng.random((n, 3)) < 0.15] = np.nan
    x[:, 2] = np.round(x[:, 2])
    y = ((np.nan_to_num(x[:, 0], nan=1.0) > 0.3) ^ (np.nan_to_num(x[:, 2]) > 0)).astype(float)
    flip = rng.random(n) < 0.1
    return x, np.where(flip, 1 - y, y), rng.integers(1, 4, n).astype(float)


def frame(spark, x, y, w):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r], float(t), float(u)) for i, (r, t, u) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, w double").repartition(3)


@pytest.mark.parametrize("loss", ["log", "squared"])
def test_trees_equal_a_plain_grower(spark, loss):
    x, y, w = sample()
    s = replace(SMALL, loss=loss)
    df = frame(spark, x, y, w)
    model = boosting.fit(df, ["a", "b", "c"], "y", s, "w")
    want = plain_fit(model, x, y, w, s)
    got = {r["id"]: r["p"] for r in model.predict(df, "p").collect()}
    want = 1 / (1 + np.exp(-want)) if loss == "log" else want
    assert max(abs(got[i] - want[i]) for i in range(len(want))) < 1e-12
    assert all(len([v for v in t.left if v < 0]) <= s.leaves for t in model.trees) and model.lost == [True, True, True]


def test_trees_do_not_depend_on_the_deal(spark, monkeypatch):
    x, y, w = sample(seed=5)
    df = frame(spark, x, y, w)
    first = boosting.fit(df, ["a", "b", "c"], "y", SMALL)
    monkeypatch.setattr(boosting, "RENEW", 2)  # scores are written between rounds
    again = boosting.fit(df.repartition(7, "b"), ["a", "b", "c"], "y", SMALL)
    assert [vars(t) for t in first.trees] == [vars(t) for t in again.trees]


def test_models_in_the_same_passes_equal_those_alone(spark):
    x, y, w = sample(seed=6)
    df = frame(spark, x, y, w).withColumn("fold", F.col("id") % 3).withColumn("z", 1 - F.col("y"))
    labels, uses = [F.col("y"), F.col("y"), F.col("z")], [F.col("fold") != 0, F.lit(True), F.col("fold") != 1]
    many = boosting.fit_many(df, ["a", "b", "c"], labels, uses, SMALL)
    for k, (label, rows) in enumerate((("y", "fold <> 0"), ("y", "true"), ("z", "fold <> 1"))):
        alone = boosting.fit(df.where(rows), ["a", "b", "c"], label, SMALL)
        alone.cuts = many[k].cuts
        if rows == "true":
            assert [vars(t) for t in many[k].trees] == [vars(t) for t in alone.trees]
        assert abs(many[k].base - alone.base) < 1e-12


def test_trees_on_odd_tables(spark):
    schema = "id long, a double, b double, c double, y double, w double"
    none = spark.createDataFrame([], schema)
    model = boosting.fit(none, ["a", "b"], "y", SMALL)
    assert model.trees == [] and model.predict(none, "p").collect() == []
    one = spark.createDataFrame([(i, float(i), None, float("nan"), 1.0, 1.0) for i in range(40)] + [(99, 1.0, 1.0, 1.0, None, 1.0)], schema)
    got = boosting.fit(one, ["a", "b", "c"], "y", SMALL).predict(one, "p").collect()
    assert all(r["p"] > 0.999 for r in got)  # one class
    rng = random.Random(1)
    rows = [(i, rng.random(), None, 0.5, float(i % 2), 1.0) for i in range(200)]
    rows = [(i, a + y, b, c, y, w) for i, a, b, c, y, w in rows]
    two = spark.createDataFrame(rows, schema)
    model = boosting.fit(two, ["a", "b", "c"], "y", SMALL)
    assert {f for t in model.trees for f, left in zip(t.feature, t.left, strict=True) if left >= 0} == {0}
    missing = spark.createDataFrame([(1, None, None, None, 0.0, 1.0)], schema)
    assert 0 < model.predict(missing, "p").first()["p"] < 1  # a value missing only now follows the larger side


def test_cross_fitted_test_sees_a_signal_and_no_leak(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(480):
        block, y = i // 12, int(rng.random() < 0.5)
        rows.append((i, block, block % 4, float(y + rng.normal()), float(rng.normal()), float(y)))
    df = spark.createDataFrame(rows, "id long, block int, fold int, a double, b double, y double")
    s = Settings(rounds=4, rate=0.3, leaves=4, least=10, l2=1.0, depth=2)
    for null in ("grouped", "permutation", "shift"):
        drawn = models.drawn_labels(df, "y", "id", "block", draws=3, seed=1, null=null)
        got = drawn.orderBy("id").select("y0", "y1", "y2", "y3").toPandas()
        assert list(got.y0) == [int(r[5]) for r in rows] and all((got.y0 != got[f"y{d}"]).any() for d in (1, 2, 3))
        if null != "grouped":
            assert all(got.y0.sum() == got[f"y{d}"].sum() for d in (1, 2, 3))
    hit = models.classifier_test(df, ["a"], "y", "fold", "block", "id", draws=4, seed=3, settings=s).first()
    assert hit["observed"] > 0.65 > hit["null_top"] and hit["p"] == 1 / 5
    miss = models.classifier_test(df, ["b"], "y", "fold", "block", "id", draws=4, seed=3, settings=s).first()
    assert 0.35 < miss["observed"] < 0.65
    # a column that names the block tells nothing once whole blocks are held out
    assert all(r["auc"] < 0.7 for r in models.fold_auc(df, ["block"], "y", "fold", s, "block").collect())


# ---- tiles


def cells(spark, a, name="a"):
    rows = [(y, x, None if math.isnan(a[y, x]) else float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, f"y int, x int, {name} double").repartition(4)


def array(df, name, n):
    out = np.full(n, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["y"], r["x"]] = r[name]
    return out


def field(n, holes=0.0, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n).cumsum(0).cumsum(1) / 20 + rng.normal(size=n)
    a[rng.random(n) < holes] = np.nan
    return a


@pytest.mark.parametrize(
    ("fn", "halo", "holes"),
    [
        (lambda a: tiles.lineament(a), 7, 0.02), (lambda a: tiles.strike_means(a)[0], 4, 0.02), (lambda a: tiles.ring_coherence(*tiles.slopes(a), 4), 7, 0.01),
        (lambda a: tiles.horizon(a, 16, 6)["openness"], 6, 0.01), (lambda a: tiles.semivariances(a, 3, 1.0).mean(0), 7, 0.0), (lambda a: tiles.log_jumps(np.abs(a)), 5, 0.0),
        (lambda a: tiles.gaussian(a, 1.5), 6, 0.0), (lambda a: tiles.rim_support(a, np.abs(a), (2, 3)), 10, 0.0), (lambda a: tiles.window_solutions(a, a * a, np.isfinite(a))["z0"], 4, 0.0),
    ],
)
def test_tiles_equal_the_whole_array(spark, fn, halo, holes):
    for n, size in (((23, 31), 8), ((40, 17), 11)):
        a = field(n, holes)
        with np.errstate(all="ignore"):
            want = fn(a)
        want = want[0] if want.ndim == 3 else want
        got = tiles.tiled(cells(spark, a), ["a"], lambda z: {"r": (lambda v: v[0] if v.ndim == 3 else v)(fn(z["a"]))}, ["r"], n, halo, size=size)
        rows = got.collect()
        assert len(rows) == len({(r["y"], r["x"]) for r in rows}) == a.size
        np.testing.assert_allclose(array(got, "r", n), want, rtol=1e-9, atol=1e-9)


def test_tiles_keep_missing_rows_out(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (5, 9, None)], "y int, x int, a double")
    got = {(r["y"], r["x"]): r["r"] for r in tiles.tiled(df, ["a"], lambda z: {"r": z["a"] * 2}, ["r"], (6, 10), 1, size=4).collect()}
    assert got == {(0, 0): 2.0, (5, 9): None}
    assert tiles.tiled(df.where("false"), ["a"], lambda z: {"r": z["a"]}, ["r"], (6, 10), 1).collect() == []


def test_lines_by_hand():
    """A line's own cells stand out from its flanks by its height."""
    a = np.zeros((31, 31))
    a[:, 15] = 2.0
    assert tiles.lineament(a)[15, 15] == pytest.approx(2.0) and tiles.lineament(a)[15, 10] == pytest.approx(0.0)


def test_ring_transpose():
    """The rim's cast is the transpose of the ring's mean: both inner products agree."""
    rng = np.random.default_rng(3)
    c, e = rng.normal(size=(30, 26)), rng.normal(size=(30, 26))
    assert np.sum(tiles.ring_mean(c, 4) * e) == pytest.approx(np.sum(c * tiles.ring_mean(e, 4)))


def test_rim_lies_on_the_rim():
    y, x = np.mgrid[:61, :61]
    a = 1 / (1 + np.exp((np.hypot(y - 30, x - 30) - 8) / 0.7))
    gy, gx = tiles.slopes(a)
    s = tiles.rim_support(a, np.hypot(gy, gx), (8,))
    assert s[30, 38] > 5 * max(s[30, 30], s[30, 50], 1e-9)


def test_windows_find_a_source():
    """A field whose gradients all point to one line of sight is solved to its place and depth; what does not fit is refused."""
    y, x = np.mgrid[:41, :41].astype(float)
    dy, dx, depth = y - 20, x - 20, 3.0
    f = 0.5 * np.log(dx * dx + dy * dy + depth**2) * 0 + np.arctan2(dx, depth)
    fz = -(np.arctan2(dx, depth - 1e-4) - np.arctan2(dx, depth)) / 1e-4
    got = tiles.window_solutions(f + 0.01 * np.arctan2(dy, depth), fz, np.ones_like(f, bool))
    assert got["accepted"].sum() > 0 and np.isnan(tiles.window_solutions(f * 0, fz * 0, np.ones_like(f, bool))["x0"]).all()
    near = np.abs(got["x0"][20, 18:23] + np.arange(18, 23) - 20)
    assert near.max() < 0.5
    off = np.zeros_like(f, bool)
    assert np.isnan(tiles.window_solutions(f, fz, off)["accepted"]).all()


def test_window_equations_by_hand():
    """One window's solution is numpy's least squares of its 49 equations."""
    a, z = field((15, 15), seed=4), field((15, 15), seed=5)
    got = tiles.window_solutions(a, z, np.ones((15, 15), bool), residual_max=np.inf)
    fy, fx = np.gradient(a)
    for cy, cx in ((7, 7), (4, 9)):
        at = [(v, u) for v in range(-3, 4) for u in range(-3, 4)]
        m = np.array([[fx[cy + v, cx + u], fy[cy + v, cx + u], z[cy + v, cx + u]] for v, u in at])
        b = np.array([u * fx[cy + v, cx + u] + v * fy[cy + v, cx + u] for v, u in at])
        want, res = np.linalg.lstsq(m, b, rcond=None)[:2]
        np.testing.assert_allclose([got[k][cy, cx] for k in ("x0", "y0", "z0")], want, rtol=1e-6)
        assert got["residual"][cy, cx] == pytest.approx(math.sqrt(res[0] / (b @ b)))


def test_texture_channels_by_loops():
    """A channel worked out cell by cell."""
    n = (40, 36)
    z = {k: field(n, seed=i) for i, k in enumerate("abcdefgh")}
    got = tiles.texture_channels(z, sigma=1.0)
    at = lambda a, y, x: a[min(max(y, 0), n[0] - 1), min(max(x, 0), n[1] - 1)]

    def raw(a, unit, lag, y, x):
        dy, dx, s = tiles.lag_step(unit, lag)
        return 0.25 * s * ((at(a, y + dy, x + dx) - a[y, x]) ** 2 + (at(a, y - dy, x - dx) - a[y, x]) ** 2)

    mean = {lag: np.mean([tiles.gaussian(np.array([[raw(z["a"], u, lag, y, x) for x in range(n[1])] for y in range(n[0])]), 1.0) for u in tiles.STRIKES], axis=0) for lag in (2, 6)}
    for y, x in ((20, 18), (2, 33), (39, 0)):
        best = 0.0
        for u in tiles.NORMALS:
            dy, dx, _ = tiles.lag_step(u, 5)
            j = [math.log(at(mean[k], y + dy, x + dx) + 1e-3) - math.log(at(mean[k], y - dy, x - dx) + 1e-3) for k in (2, 6)]
            best = max(best, math.sqrt(j[0] * j[1]) if j[0] * j[1] > 0 else 0.0)
        assert got["jump_a"][y, x] == pytest.approx(best)
    assert set(got) == {"jump_a", "jump_b", "concordance", "spectral_step", "persistence", "anisotropy", "scalar_step", "strained"}


@pytest.mark.parametrize("n", [(12, 20), (21, 13), (16, 16)])
def test_filters_equal_one_transform(spark, n):
    a = field(n, 0.05)
    got = array(fourier.vertical_derivative(cells(spark, a), "a", "f", n, pad=5), "f", n)
    b = np.pad(np.nan_to_num(a), 5, "symmetric")
    k = 2 * np.pi * np.hypot(np.fft.fftfreq(b.shape[0])[:, None], np.fft.rfftfreq(b.shape[1])[None, :])
    want = np.fft.irfft2(np.fft.rfft2(b) * k, s=b.shape)[5:-5, 5:-5]
    np.testing.assert_allclose(got, want, atol=1e-10)


def test_label_features(spark):
    n = (20, 24)
    labels = {(3, 4), (15, 20), (15, 21)}
    grid = spark.createDataFrame([(y, x) for y in range(n[0]) for x in range(n[1])], "y long, x long")
    got = models.label_features(grid, spark.createDataFrame(list(labels), "y long, x long"), n, (1.0, 2.0)).collect()
    on = np.zeros(n)
    for y, x in labels:
        on[y, x] = 1
    dense = tiles.gaussian(on, 2.0, "constant")
    for r in got:
        d = min(math.hypot(r["y"] - y, r["x"] - x) for y, x in labels)
        assert r["log_distance"] == pytest.approx(math.log1p(d * 0.1)) and r["density_1"] == pytest.approx(dense[r["y"], r["x"]])
    assert len(got) == n[0] * n[1]


# ---- bounded least squares


def test_bounded_least_squares_equals_every_active_set(spark):
    rng = np.random.default_rng(8)
    for trial in range(12):
        k = int(rng.integers(1, 5))
        x, low, high = rng.normal(size=(30, k)), -rng.random(k), rng.random(k)
        if trial % 4 == 0:
            x[:, -1] = x[:, 0]  # dependent columns
        y = x @ rng.normal(size=k) * 2 + rng.normal(size=30)
        g, r = x.T @ x, x.T @ y
        cost = lambda v: v @ g @ v / 2 - r @ v  # noqa: B023, E731
        best = min((cost(v) for v in _active_sets(g, r, low, high)))
        got = solve.bounded(g, r, low, high)
        assert (got >= low - 1e-12).all() and (got <= high + 1e-12).all() and cost(got) == pytest.approx(best, abs=1e-8)
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 3.0), (None, 9.0, 9.0)], "a double, b double, t double")
    got = solve.bounded_least_squares(df, ["a", "b"], "t", [0.0, 0.0], [1.0, 1.0])
    assert got["a"] == pytest.approx(1.0) and got["b"] == pytest.approx(1.0)


def _active_sets(g, r, low, high):
    for state in itertools.product((-1, 0, 1), repeat=len(r)):
        s = np.array(state)
        v = np.where(s < 0, low, high).astype(float)
        free = np.flatnonzero(s == 0)
        if len(free):
            rest = np.flatnonzero(s != 0)
            v[free] = np.linalg.lstsq(g[np.ix_(free, free)], r[free] - g[np.ix_(free, rest)] @ v[rest], rcond=None)[0]
        if (v >= low - 1e-12).all() and (v <= high + 1e-12).all():
            yield v
