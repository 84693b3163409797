"""Burned vectors, fits, drainage channels, sinks, vector files and hold-out objects against plain versions."""

import io
import json
import math
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import burn, emit, flow, folds, georef, holdout, metric
from gridloom.sources import commits, vectors

# ---- burning


def hits(seg, y, x):
    """Whether a segment meets the closed cell."""
    (ay, ax, by, bx), lo, hi = seg, 0.0, 1.0
    for a, b, c in ((ay, by, y), (ax, bx, x)):
        if a == b:
            if not c <= a <= c + 1:
                return False
            continue
        p, q = sorted(((c - a) / (b - a), (c + 1 - a) / (b - a)))
        lo, hi = max(lo, p), min(hi, q)
    return lo <= hi


def test_burned_cells_equal_every_test(spark):
    rng = random.Random(4)
    n = (14, 17)
    edges = [tuple(rng.uniform(-4, 20) for _ in range(4)) for _ in range(25)]
    edges += [(3.5, 1.2, 3.5, 9.7), (1.5, 4.5, 9.5, 4.5), (6.3, 6.3, 6.3, 6.3), (30.0, 30.0, 40.0, 41.0)]
    df = spark.createDataFrame([(*e, "k") for e in edges] + [(None, 1.0, 2.0, 3.0, "k"), (float("nan"), 1.0, 2.0, 3.0, "k")], "ay double, ax double, by double, bx double, name string")
    for pad in (0, 3):
        want = {(y, x) for y in range(-pad, n[0] + pad) for x in range(-pad, n[1] + pad) if any(hits(e, y, x) for e in edges)}
        assert {tuple(r) for r in burn.touched(df, n, padding=pad).collect()} == want
    assert burn.touched(df.where("false"), n).collect() == []


def test_polygon_insides(spark):
    square = [(1.2, 1.3), (1.2, 12.1), (9.4, 12.1), (9.4, 1.3)]
    hole = [(3.1, 4.2), (6.6, 4.2), (6.6, 8.8), (3.1, 8.8)]
    edges = [(0, *a, *b) for ring in (square, hole) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    got = {tuple(r) for r in burn.inside(spark.createDataFrame([(p, *map(float, e)) for p, *e in edges], "poly int, ay double, ax double, by double, bx double"), (12, 14)).collect()}
    inside = lambda y, x: 1.2 < y + 0.5 < 9.4 and 1.3 < x + 0.5 < 12.1 and not (3.1 < y + 0.5 < 6.6 and 4.2 < x + 0.5 < 8.8)
    assert got == {(y, x) for y in range(12) for x in range(14) if inside(y, x)}


def test_burn_distance_certifies(spark):
    n = (8, 9)
    grid = spark.createDataFrame([(y, x) for y in range(n[0]) for x in range(n[1])], "y long, x long")
    seeds = spark.createDataFrame([(-3, 4), (9, 9)], "y long, x long")
    got = burn.distance(grid, seeds, n, 12).collect()
    assert all(r["d2"] == min((r["y"] + 3) ** 2 + (r["x"] - 4) ** 2, (r["y"] - 9) ** 2 + (r["x"] - 9) ** 2) for r in got) and len(got) == 72
    with pytest.raises(ValueError, match="too narrow"):
        burn.distance(grid, seeds, n, 4)
    with pytest.raises(ValueError, match="no seed"):
        burn.distance(grid, seeds.where("false"), n, 4)


def test_burn_distance_makes_no_padded_grid(spark, monkeypatch):
    """Only the grid's rows, over the columns of cells and seeds, go through the transform."""
    n, seen = (8, 9), []
    grid = spark.createDataFrame([(y, x) for y in range(n[0]) for x in range(n[1])], "y long, x long")
    through = burn.transform
    monkeypatch.setattr(burn, "transform", lambda df, seeds: (seen.append(df.count()), through(df, seeds))[1])
    got = burn.distance(grid, spark.createDataFrame([(-3, 4), (9, 11), (-200, 3)], "y long, x long"), n, 12).collect()
    assert all(r["d2"] == min((r["y"] + 3) ** 2 + (r["x"] - 4) ** 2, (r["y"] - 9) ** 2 + (r["x"] - 11) ** 2) for r in got) and len(got) == 72
    assert seen == [8 * 12]


# ---- fit of a map


def test_georef_recovers_a_planted_map(spark):
    rng = random.Random(2)
    n, outline = (60, 80), []
    for i in range(160):
        t = 2 * math.pi * i / 160
        r = 1 + 0.25 * math.sin(3 * t) + 0.1 * math.cos(5 * t)
        outline.append((round(30 + 20 * r * math.sin(t)), round(40 + 27 * r * math.cos(t))))
    want = (31.0, -42.0, 3700.0, 1660.0)
    points = [((x - want[2]) / want[0], (y - want[3]) / want[1]) for y, x in outline]
    rng.shuffle(points)
    mask = spark.createDataFrame(sorted(set(outline)), "y long, x long")
    grid = spark.createDataFrame([(y, x) for y in range(n[0]) for x in range(n[1])], "y long, x long")
    got, cost = georef.fit(spark.createDataFrame(points, "x double, y double"), mask, grid, n)
    u = [(got[0] * x + got[2] - want[0] * x - want[2], got[1] * y + got[3] - want[1] * y - want[3]) for x, y in points]
    assert cost < 0.05 and max(abs(v) for p in u for v in p) < 0.75
    with pytest.raises(ValueError, match="span"):
        georef.fit(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), mask, grid, n)


# ---- drainage


def test_flow_channels_equal_walks(spark):
    rng = random.Random(6)
    h, w = 11, 13
    z = {(y, x): 3.0 * y + abs(x - 6) + rng.random() * 4 for y in range(h) for x in range(w)}
    df = spark.createDataFrame([(y, x, v) for (y, x), v in z.items()], "y long, x long, z double")
    to, slope = {}, {}
    for (y, x), v in z.items():
        near = [((v - z[q]) / math.hypot(a, b), -(q[0] * w + q[1]), q) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (q := (y + a, x + b)) in z and z[q] < v]
        to[y, x], slope[y, x] = (max(near)[2], max(near)[0]) if near else ((y, x), 0.0)
    acc = dict.fromkeys(z, 0)
    for p in z:
        while True:
            acc[p] += 1
            if to[p] == p:
                break
            p = to[p]
    donors = {p: [q for q in z if to[q] == p and q != p] for p in z}

    def up(v):
        return {p: sum(acc[q] * v[q] for q in donors[p]) / sum(acc[q] for q in donors[p]) if donors[p] else v[p] for p in z}

    k = [{p: max(slope[p], 1e-5) * acc[p] ** 0.45 for p in z}]
    ys, xs = [{p: float(p[0]) for p in z}], [{p: float(p[1]) for p in z}]
    for _ in range(4):
        k.append(up(k[-1]))
        ys.append(up(ys[-1]))
        xs.append(up(xs[-1]))
    knick = {}
    for p in z:
        d, at = [], p
        for _ in range(3):
            at = to[at]
            d.append(k[0][at])
        knick[p] = max(0.0, k[0][p] - 0.5 * (sum(d) / 3 + (k[1][p] + k[2][p] + k[3][p]) / 3)) if acc[p] >= 4 else 0.0
    got = {divmod(r["cell_id"], w): r for r in flow.channels(df, "z", w).collect()}
    assert set(got) == set(z)
    for p, r in got.items():
        end = to[to[to[to[p]]]]
        dy, dx, uy, ux = end[0] - p[0], end[1] - p[1], p[0] - ys[4][p], p[1] - xs[4][p]
        turn = 0.0
        if acc[p] >= 6 and math.hypot(dy, dx) > 0.5 and math.hypot(uy, ux) > 0.5:
            turn = (1 - max(-1.0, min(1.0, (dy * uy + dx * ux) / (math.hypot(dy, dx) * math.hypot(uy, ux))))) * math.log1p(acc[p])
        reach = max([knick[p], knick[to[p]], knick[to[to[p]]], *(knick[q] for q in donors[p]), *(knick[s] for q in donors[p] for s in donors[q])])
        assert r["acc"] == acc[p] and r["log_acc"] == pytest.approx(math.log1p(acc[p]))
        assert r["knick"] == pytest.approx(knick[p], abs=1e-9) and r["knick_reach"] == pytest.approx(reach, abs=1e-9) and r["turn"] == pytest.approx(turn, abs=1e-9)


# ---- the two-phase sink


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = (tmp_path / "t").as_uri()
    df = spark.range(100).select("id", (F.col("id") / 100).alias("v")).repartition(4)
    options = {"key": "id", "value": "v", "low": 0, "high": 1}
    commits.write_staged(df, path, **options, rows=100, keys=4950)
    read = lambda: sorted(map(tuple, commits.read_staged(spark, path).collect()))
    first = read()
    assert len(first) == 100
    bad = {
        "outside": (df.withColumn("v", F.col("v") * 2), {}),
        "not finite": (df.withColumn("v", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("v"))), {}),
        "null": (df.withColumn("v", F.when(F.col("id") != 3, F.col("v"))), {"nulls": "refuse"}),
        "promised": (df.where("id < 99"), {"rows": 100}),
        "keys": (df.withColumn("id", F.when(F.col("id") == 3, 4).otherwise(F.col("id"))), {"rows": 100, "keys": 4950}),
    }
    for what, (rows, more) in bad.items():
        with pytest.raises(Exception, match=what):
            commits.write_staged(rows, path, **options, **more)
        assert read() == first
    commits.write_staged(df.where("id < 7").withColumn("v", F.when(F.col("id") > 2, F.col("v"))), path, **options)
    assert len(read()) == 7 and sum(v is None for _, v in read()) == 3
    commits.write_staged(df.where("false"), path)
    assert read() == []
    current = json.loads((tmp_path / "t" / "CURRENT").read_text())
    assert current["rows"] == 0


def test_a_write_that_ends_between_stage_and_commit(spark, tmp_path, monkeypatch):
    """Parts are staged, the commit fails: readers see the old table."""
    path = (tmp_path / "t").as_uri()
    df = spark.range(10).select("id", F.lit(0.5).alias("v"))
    commits.write_staged(df, path)
    with pytest.raises(Exception, match="promised"):
        commits.write_staged(df.limit(5), path, rows=6)
    assert commits.read_staged(spark, path).count() == 10


# ---- vector files

LINES = [[(0.0, 1.0), (2.5, 3.0), (4.0, -1.0)], [(9.0, 9.0), (8.0, 7.5)], [], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (1.0, 1.0)]]


def files(lines, names=("a", "bé", "", "long name")):
    shp, shx = vectors.encoded(vectors.LINE, [([0] if p else [], p) for p in lines])
    return {"shp": shp, "shx": shx, "dbf": vectors.table([("name", 16)], [[n] for n in names])}


def put(folder, stem, blobs, zipped=False):
    if zipped:
        with zipfile.ZipFile(folder / f"{stem}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for e, b in blobs.items():
                z.writestr(f"in/{stem}.{e}", b)
    else:
        for e, b in blobs.items():
            (folder / f"{stem}.{e}").write_bytes(b)


def test_vector_files_round_trip(spark, tmp_path):
    put(tmp_path, "one", files(LINES))
    put(tmp_path, "two", files(LINES), zipped=True)
    put(tmp_path, "bare", {k: v for k, v in files(LINES).items() if k != "dbf"})
    df = vectors.read_shapes(spark, tmp_path.as_uri(), records_a_task=1)
    assert df.rdd.getNumPartitions() == 4 + 1 + 4
    rows = df.collect()
    for source in ("one", "two", "bare"):
        mine = sorted((r for r in rows if r["source"] == source), key=lambda r: r["record"])
        assert [[tuple(p) for p in r["points"]] for r in mine] == LINES
        assert [r["kind"] for r in mine] == [3, 3, 0, 3] and [r["parts"] for r in mine] == [[0], [0], [], [0]]
        assert [r["attributes"].get("name") for r in mine] == (["a", "bé", "", "long name"] if source != "bare" else [None] * 4)
    one = vectors.read_shapes(spark, (tmp_path / "one.shp").as_uri())
    assert one.count() == 4
    empty = tmp_path / "none"
    empty.mkdir()
    assert vectors.read_shapes(spark, empty.as_uri()).collect() == []


@pytest.mark.parametrize("damage", ["cut", "header", "count", "number", "attributes", "part"])
def test_damaged_vector_files_are_refused(spark, tmp_path, damage):
    blobs = files(LINES)
    shp = bytearray(blobs["shp"])
    if damage == "cut":
        blobs["shp"] = bytes(shp[:-10])
    elif damage == "header":
        shp[24:28] = struct.pack(">i", 7)
        blobs["shp"] = bytes(shp)
    elif damage == "count":
        shp[100 + 8 + 40 : 100 + 8 + 44] = struct.pack("<i", 2)
        blobs["shp"] = bytes(shp)
    elif damage == "number":
        shp[100:104] = struct.pack(">i", 9)
        blobs["shp"] = bytes(shp)
    elif damage == "part":
        shp[100 + 8 + 44 : 100 + 8 + 48] = struct.pack("<i", 5)
        blobs["shp"] = bytes(shp)
    else:
        blobs["dbf"] = blobs["dbf"][:-20]
    for zipped in (False, True):
        folder = tmp_path / str(zipped)
        folder.mkdir()
        put(folder, "x", blobs, zipped)
        with pytest.raises(Exception, match="record|counts|longer|early|part"):
            vectors.read_shapes(spark, folder.as_uri()).collect()


def test_an_archive_of_several_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for stem in ("p", "q"):
            for e, b in files(LINES).items():
                z.writestr(f"{stem}.{e}", b)
        z.writestr("readme.txt", "nothing")
    got = vectors.read_shapes(spark, tmp_path.as_uri())
    assert sorted((r["source"], r["record"]) for r in got.collect()) == [(s, i) for s in "pq" for i in (1, 2, 3, 4)]
    assert io.BytesIO(b"").read() == b""


# ---- hold-out objects


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(3)
    rows = [(y * 24 + x, y, x, float(rng.random()), bool(rng.random() < 0.12)) for y in range(24) for x in range(24)]
    df = spark.createDataFrame(rows, "cell_id long, y long, x long, v double, label boolean")
    return folds.quadrants(df), rows


def plain_dti(pred, truth):
    near = lambda a, b: {p: max((max(0.0, 1 - math.dist(p, q) / 3) for q in b), default=0.0) for p in a}
    c, d = near(truth, pred), near(pred, truth)
    tp, fn, fp = sum(c.values()), sum(1 - v for v in c.values()), sum(1 - v for v in d.values())
    return tp / (tp + 0.2 * fp + 0.8 * fn + 1e-7), tp, fp, fn


def test_summary_and_pairs(spark, grid):
    f, rows = grid
    fold = {(r["y"], r["x"]): r["fold"] for r in f.collect()}
    truth = f.where("label")
    a, b = holdout.emitted(f, 0.08), holdout.emitted(f.withColumn("v", 1 - F.col("v")), 0.08)
    cells = lambda d, k: [(r["y"], r["x"]) for r in d.collect() if r["fold"] == k]
    per = [plain_dti(cells(a, k), cells(truth, k)) for k in range(4)]
    got = {r["fold"]: r for r in holdout.summary(a, truth, f, size=6, draws=200, seed=1).collect()}
    for k in range(4):
        assert got[k]["dti"] == pytest.approx(per[k][0]) and got[k]["n_truth"] == len(cells(truth, k)) and got[k]["lo"] is None
    tp, fp, fn = (sum(p[i] for p in per) for i in (1, 2, 3))
    assert got[None]["dti"] == pytest.approx(tp / (tp + 0.2 * fp + 0.8 * fn + 1e-7)) and got[None]["lo"] < got[None]["dti"] < got[None]["hi"]
    other = [plain_dti(cells(b, k), cells(truth, k)) for k in range(4)]
    p = holdout.paired(a, b, truth, f, size=6, draws=200, seed=2).first()
    assert p["wins"] == sum(x[0] > y[0] for x, y in zip(per, other, strict=True)) and p["min_delta"] == pytest.approx(min(x[0] - y[0] for x, y in zip(per, other, strict=True)))
    assert p["lo"] <= p["delta"] <= p["hi"] and p["positive"] == (p["lo"] > 0)
    same = holdout.paired(a, a, truth, f, size=6, draws=50, seed=2).first()
    assert same["delta"] == same["lo"] == same["hi"] == 0 and same["wins"] == 0 and not same["positive"]
    # the emission: budgets by fold, best first
    for k in range(4):
        mine = sorted((r for r in rows if fold[r[1], r[2]] == k), key=lambda r: (-r[3], r[0]))
        budget = int(np.rint(0.08 * len(mine)))
        assert sorted(cells(a, k)) == sorted((r[1], r[2]) for r in mine[:budget])


def test_quadrant_truths_and_scores(spark, grid):
    f, _ = grid
    labels = f.where("label")
    t = holdout.quadrant_truths(holdout.checked(f, labels), 24, keep_of_100=40)
    rows = t.collect()
    assert len(rows) == labels.count()
    by = {}
    for r in rows:
        by.setdefault((r["fold"], r["comp"]), set()).add(r["sparse"])
    assert all(len(s) == 1 for s in by.values()) and {True, False} == {x for s in by.values() for x in s}
    a = holdout.emitted(f, 0.1)
    dots = [(r["y"], r["x"], r["fold"]) for r in a.collect()]
    got = {(r["mode"], r["fold"]): r["dti"] for r in holdout.quadrant_scores(a, t).collect()}
    for k in range(4):
        dense = [(r["y"], r["x"]) for r in rows if r["fold"] == k]
        hidden = [(r["y"], r["x"]) for r in rows if r["fold"] == k and r["sparse"]]
        known = {(r["y"], r["x"]) for r in rows if not r["sparse"]}
        mine = [(y, x) for y, x, g in dots if g == k]
        assert got["dense", k] == pytest.approx(plain_dti(mine, dense)[0])
        assert got["sparse", k] == pytest.approx(plain_dti([p for p in mine if p not in known], hidden)[0])
    assert got["dense", None] == pytest.approx(np.mean([got["dense", k] for k in range(4)]))
    with pytest.raises(ValueError, match="outside"):
        holdout.checked(f.where("y > 3"), labels)
    with pytest.raises(ValueError, match="empty fold"):
        holdout.checked(f.where("fold < 3"), labels.where("fold < 3"))


def test_canary_flags_both_polarities_and_presence(spark, grid):
    f, _ = grid
    low = f.withColumn("pos", F.col("label")).withColumn("up", F.col("label").cast("double") + F.col("v") / 10).withColumn("down", -F.col("up"))
    low = low.withColumn("gone", F.when(~F.col("label"), F.col("v"))).withColumn("one_fold", F.when(F.col("fold") == 2, F.col("up")).otherwise(F.col("v")))
    got = {r["feature"]: r for r in holdout.canary(low, ["v", "up", "down", "gone", "one_fold"], "pos", "fold").collect()}
    assert {k: r["suspected"] for k, r in got.items()} == {"v": False, "up": True, "down": True, "gone": True, "one_fold": True}
    assert got["up"]["auc"] > 0.99 > 0.01 > got["down"]["auc"] and got["gone"]["presence_auc"] < 0.01


def test_bridge_counts_every_test_block(spark, grid):
    f, _ = grid
    truth = f.where("label").select("y", "x", "fold")
    dots = holdout.emitted(f, 0.1).select("y", "x", "fold")
    got = holdout.bridged(dots, truth, f, size=8, draws=100, seed=3).first()
    want = metric.scored(metric.owned(dots, truth, ("fold",))).first()["dti"]
    assert round(got["dti"], 6) == want and got["lo"] <= want <= got["hi"]


def test_demand_is_within_one(spark):
    """Weights over 1 ask for no more than 1, negative and missing ones for nothing."""
    rng = random.Random(2)
    cells = [(y, x, rng.choice([3.0, 0.5, -2.0, None]), y * 10 + x) for y in range(10) for x in range(10)]
    clipped = [(y, x, None if v is None else min(max(v, 0.0), 1.0), i) for y, x, v, i in cells]
    take = lambda rows: [(r["id"], round(r["gain"], 9)) for r in emit.cover(spark.createDataFrame(rows, "y long, x long, v double, id long"), "v", "id", k=6).collect()]
    assert take(cells) == take(clipped)
