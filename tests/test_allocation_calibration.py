"""Staged allocation against a plain greedy scan, calibrators against numpy, distances against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import calibrate as cal
from gridloom.operators import distance, emit
from gridloom.operators.stencil import triangular
from gridloom.plans.allocation_queries import _fields, kernel_mean
from gridloom.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def greedy(demand, some, stages, spacing, tau=None, existing=()):
    """[(id, stage)] by a scan that takes the best candidate again and again; cells by (y, x)."""
    kern = triangular()
    cover, dots, out = {}, [], []

    def put(y, x):
        dots.append((y, x))
        for a, b, w in kern:
            cover[y + a, x + b] = max(cover.get((y + a, x + b), 0.0), w)

    for y, x in existing:
        put(y, x)
    budget = sum(k for _, k in stages)
    for i, (weight, k) in enumerate(stages):
        want = budget - len(out) if i == len(stages) - 1 else min(k, budget - len(out))
        live = {c: r for c, r in some.items() if r[weight] > 0}
        fee_of = tau * max(np.mean([r[weight] for r in live.values()]), 1e-4) if tau else 0.0
        for _ in range(want):
            best = None
            for (y, x), r in live.items():
                if any((y - a) ** 2 + (x - b) ** 2 < spacing**2 for a, b in dots):
                    continue
                adds = sum(min(max(demand[y + a, x + b][weight], 0.0), 1.0) * max(0.0, w - cover.get((y + a, x + b), 0.0)) for a, b, w in kern if (y + a, x + b) in demand)
                if round(adds, 9) <= 1e-9:
                    continue
                net = round(round(adds, 9) - fee_of * (1 - min(max(r["mu"], 0), 1)), 9)
                if best is None or (net, -r["cell_id"]) > best[0]:
                    best = (net, -r["cell_id"]), (y, x)
            if best is None:
                break
            put(*best[1])
            out.append((-best[0][1], i + 1))
    return out


@pytest.fixture(scope="module")
def fields(spark):
    df, some = _fields(spark, SF)
    by = lambda d: {(r["y"], r["x"]): {**r.asDict(), "mu": r["mu"] or 0.0} for r in d.collect()}
    return df, some, by(df), by(some)


@pytest.mark.parametrize("tau", [None, 0.35, 50.0])
def test_stages_equal_the_scan(fields, tau):
    df, some, demand, cells = fields
    stages = [("u", 8), ("hydro", 5), ("concealed", 4), ("u", 0)]
    got = emit.staged(df, "cell_id", stages, spacing=2.9, candidates=some, cost=emit.net_cost("mu", tau) if tau else None).collect()
    assert sorted((r["id"], r["stage"]) for r in got) == sorted(greedy(demand, cells, stages, 2.9, tau))


def test_kernel_mean_equals_a_scatter(spark):
    rows = [(y, x, None if (y * x) % 7 == 3 else float(y + 2 * x)) for y in range(9) for x in range(8) if (y + x) % 5]
    df = spark.createDataFrame(rows, "y long, x long, u double")
    out = kernel_mean(df, "u", "mu", (9, 8))
    got, at = {(r["y"], r["x"]): r["mu"] for r in out.collect()}, {(y, x): u or 0.0 for y, x, u in rows}
    near = {c: [(w, at[q]) for a, b, w in triangular() if (q := (c[0] + a, c[1] + b)) in at] for c in at}
    assert got == {c: pytest.approx(sum(w * u for w, u in n) / sum(w for w, _ in n)) for c, n in near.items()}


def test_stage_on_existing_dots(spark, fields):
    df, some, demand, cells = fields
    there = sorted(cells)[::40][:6]
    dots = spark.createDataFrame(there, "y long, x long")
    got = emit.cover(df, "u", "cell_id", k=10, spacing=2.5, candidates=some, existing=dots, pool=100).collect()
    pool = dict(sorted(cells.items(), key=lambda c: (-c[1]["u"], c[1]["cell_id"]))[:100])
    assert sorted(r["id"] for r in got) == sorted(i for i, _ in greedy(demand, pool, [("u", 10)], 2.5, existing=there))


def test_ratio_select_equals_the_scan(spark):
    """The early stop of the rounds gives the scan's first dots."""
    rng = np.random.default_rng(2)
    rows = [(y, x, float(np.floor(20 * rng.random())), y * 30 + x) for y in range(30) for x in range(30)]
    df = spark.createDataFrame(rows, "y long, x long, q double, cell_id long")
    for k in (5, 40, 500):
        kept = []
        for y, x, q, i in sorted(rows, key=lambda r: (-r[2], r[3])):
            if q > 0 and len(kept) < k and all((y - a) ** 2 + (x - b) ** 2 >= 6.25 for a, b, _ in kept):
                kept.append((y, x, i))
        assert sorted(r["id"] for r in emit.poisson(df, "q", "cell_id", spacing=2.5, k=k).collect()) == sorted(i for *_, i in kept)


def test_distances_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    cells = [(y, x) for y in range(25) for x in range(31) if rng.random() > 0.1]
    df = spark.createDataFrame(cells, "y long, x long")
    for n in (0, 1, 9):
        seeds = [cells[i] for i in rng.choice(len(cells), n, replace=False)]
        got = {(r["y"], r["x"]): r["d2"] for r in distance.transform(df, spark.createDataFrame(seeds, "y long, x long")).collect()}
        own = {}
        for y, x in cells:  # along the column through cells that are there, then along the row
            own[y, x] = min(((y - a) ** 2 for a, b in seeds if b == x), default=math.inf)
        want = {(y, x): min((own[y, b] + (x - b) ** 2 for b in range(31) if (y, b) in own), default=math.inf) for y, x in cells}
        assert got == {k: None if v == math.inf else int(v) for k, v in want.items()}


def test_spline_pieces(spark):
    """One quadratic an interval gives the same basis as the recursion, and it sums to one."""
    from gridloom.operators.models import spline as recursive

    knots = [0.0, 1.0, 2.5, 4.0, 7.0]
    df = spark.createDataFrame([(x / 8,) for x in range(-8, 64)], "x double")
    got = df.select(*[c.alias(f"a{i}") for i, c in enumerate(cal.spline(F.col("x"), knots))], *[c.alias(f"b{i}") for i, c in enumerate(recursive(F.col("x"), knots))]).toPandas().to_numpy()
    assert np.allclose(got[:, :6], got[:, 6:], atol=1e-6) and np.allclose(got[:, :6].sum(1), 1.0)


def plain_ridge(b, z, alpha):
    m, zm = b.mean(0), z.mean()
    w = np.linalg.solve((b - m).T @ (b - m) + alpha * np.eye(b.shape[1]), (b - m).T @ (z - zm))
    return w, zm - m @ w


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(6)
    n = 700
    c1, c2 = rng.random(n) * 10, rng.random(n) * 5
    x = 2 * c1 + rng.normal(size=n)
    p = 1 / (1 + np.exp(-(0.5 * c1 - 3 + rng.normal(size=n))))
    rows = [(i, float(c1[i]), float(c2[i]), None if i % 11 == 0 else float(x[i]), 1.0 * (i % 4), float(p[i]), bool(i % 3), float(rng.random())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, c1 double, c2 double, x double, safe double, p double, covered boolean, slope double"), rows


def matrix(df, basis):
    cols = df.select("id", *[c.alias(f"b{i}") for i, c in enumerate(basis.columns)]).toPandas().sort_values("id")
    return cols.drop(columns="id").to_numpy()


def test_residualiser(sample):
    """Equal to numpy's ridge on the same basis; nulls stay, other columns are untouched, the trend shrinks."""
    df, rows = sample
    basis = cal.Basis.fit(df, ["c1", "c2"])
    got = cal.Residualiser.fit(df, basis, ["x"], alpha=10.0).transform(df).toPandas().sort_values("id")
    x = np.array([np.nan if r[3] is None else r[3] for r in rows])
    known = ~np.isnan(x)
    med = np.sort(x[known])[(known.sum() - 1) // 2]
    mad = np.sort(np.abs(x[known] - med))[(known.sum() - 1) // 2]
    z = np.clip((x - med) / (1.4826 * mad), -8, 8)
    b = matrix(df, basis)
    w, c = plain_ridge(b[known], z[known], 10.0)
    assert np.allclose(got.x[known], (z - b @ w - c)[known], atol=1e-4) and got.x[~known].isna().all()
    assert (got.safe.to_numpy() == [r[4] for r in rows]).all()
    trend = lambda v: abs(np.corrcoef(v, np.array([r[1] for r in rows])[known])[0, 1])
    assert trend(got.x[known]) < 0.6 * trend(z[known])  # the penalty leaves some of it
    assert cal.Residualiser.fit(df.limit(10), basis, ["x"]).median == {}


def test_calibrator(sample):
    """Log odds less the nuisance's part; gap rows have the covered rows' median and spread, ranks within a tier are kept."""
    df, rows = sample
    basis = cal.Basis.fit(df, ["c1", "c2"])
    plain = cal.Calibrator.fit(df, "p", basis, alpha=10.0)
    got = plain.transform(df, "p", "out").toPandas().sort_values("id")
    ell = np.log(got.p / (1 - got.p)).to_numpy()
    b = matrix(df, basis)
    w, c = plain_ridge(b, ell, 10.0)
    eff = b @ w + c
    odds = ell - (eff - eff.mean())
    assert np.allclose(got.out, 1 / (1 + np.exp(-odds)), atol=1e-5)
    score = cal.relief_score(df, "slope", "safe")
    both = plain.matched(df, "p", "covered", cal.terciles(df, score))
    out = both.transform(df.withColumn("t", cal.terciles(df, score)), "p", "out", "covered").toPandas().sort_values("id")
    assert np.allclose(out.out[out.covered], got.out[out.covered.to_numpy()], atol=1e-9)
    for t in (0, 1, 2):
        gap, here = out[(out.t == t) & ~out.covered], out[(out.t == t) & out.covered]
        if len(gap) >= 100 and len(here) >= 100:
            assert abs(np.log(gap.out / (1 - gap.out)).median() - np.log(here.out / (1 - here.out)).median()) < 0.1
        assert (np.argsort(gap.out.to_numpy()) == np.argsort(odds[gap.index])).all()
    moved = cal.Calibrator.fit(df, "p", basis, alpha=10.0, sample_mean=0.5, population_mean=0.1).transform(df, "p", "out").toPandas().sort_values("id")
    assert np.allclose(moved.out, 1 / (1 + np.exp(-(odds + math.log(0.1 / 0.9)))), atol=1e-5)


def test_queries_keep_null_cells(spark):
    got = {r["cell_id"]: r for r in QUERIES["k14_selective_transform"](spark, SF).collect()}
    rows = QUERIES["k18_targeted_transform"](spark, SF).collect()
    assert any(r["qty"] is None for r in got.values()) and all(r["qty"] is not None for r in rows)
    assert all(got[r["cell_id"]]["v"] == pytest.approx(r["v"]) for r in rows)
