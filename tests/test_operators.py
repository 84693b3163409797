"""Operators against plain loops and hand-made grids."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import distance, emit, folds, metric, rules, similarity, stencil, tiles
from gridloom.sources import scans


def grid(spark, h, w, f):
    return spark.createDataFrame([(y, x, y * w + x, f(y, x)) for y in range(h) for x in range(w)], "y long, x long, cell_id long, v double")


def values(df, name):
    return {(r["y"], r["x"]): r[name] for r in df.collect()}


def test_worked_example(spark):
    r = spark.range(1).select(scalar.tversky(F.lit(3.0), F.lit(1.89), F.lit(2.0)).alias("d")).first()
    assert round(r["d"], 2) == 0.60


@pytest.mark.parametrize(("f", "want"), [(lambda y, x: float(x * x - y * y), 2.0), (lambda y, x: float(-x * x), 0.0), (lambda y, x: float(x * x + y * y), 0.0)])
def test_saddle(spark, f, want):
    n = 21
    g = grid(spark, n, n, lambda y, x: f(y - 10, x - 10))
    got = values(stencil.saddle(stencil.smoothed(g, "v", "s", 1.0, (n, n)), "s", "c"), "c")
    assert abs(got[10, 10] - want) < 0.05


def test_metric_edges(spark):
    cell = lambda rows: spark.createDataFrame(rows, "y long, x long")
    truth, pred = cell([(10, 10), (14, 20)]), cell([(9, 10), (14, 19), (29, 29)])
    whole = metric.scored(metric.owned(pred, truth)).first()
    tiles = metric.tiles(metric.owned(pred, truth), 10).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).first()
    assert all(abs(whole[c] - tiles[c]) < 1e-6 for c in ("tp", "fp", "fn"))
    assert abs(whole["tp"] - 2 * (1 - 1 / 3)) < 1e-6 and abs(whole["fp"] - (1 + 2 / 3)) < 1e-5
    none = metric.scored(metric.owned(cell([]), truth)).first()
    assert none["tp"] == 0 and none["fn"] == 2


def test_overlap_radius_is_inclusive(spark):
    a = spark.createDataFrame([(2, 2)], "y long, x long")
    ref = spark.createDataFrame([(2, 5, "in"), (2, 6, "out")], "y long, x long, entry string")
    got = {r["entry"]: r["forward"] for r in similarity.overlap(a, ref).collect()}
    assert got == {"in": 1.0, "out": 0.0}


def test_duplicate_is_strict(spark):
    d = lambda a, b: spark.range(1).select(similarity.duplicate(F.lit(a), F.lit(b)).alias("d")).first()["d"]
    assert not d(0.90, 0.70) and d(0.90001, 0.0) and d(0.0, 0.70001) and not d(None, None)


def test_poisson_equals_scan(spark):
    rng = random.Random(1)
    for _ in range(3):
        cells = [(y, x, float(rng.randrange(1, 30)), y * 20 + x) for y in range(20) for x in range(20)]
        got = [r["id"] for r in emit.poisson(spark.createDataFrame(cells, "y long, x long, v double, id long"), "v", "id", spacing=3.0, k=25).collect()]
        want = []
        for y, x, _, i in sorted(cells, key=lambda c: (-c[2], c[3])):
            if all((y - a) ** 2 + (x - b) ** 2 >= 9 for a, b, _ in want):
                want.append((y, x, i))
        assert got == [i for _, _, i in want[:25]]


@pytest.mark.parametrize("spacing", [0.0, 2.5])
def test_cover_equals_greedy(spark, spacing):
    rng = random.Random(2)
    cells = [(y, x, rng.randrange(1, 9) / 8, y * 12 + x) for y in range(12) for x in range(12)]
    got = [r["id"] for r in emit.cover(spark.createDataFrame(cells, "y long, x long, v double, id long"), "v", "id", k=8, spacing=spacing).collect()]
    kern = stencil.triangular()
    weight, cov, taken, left = {(y, x): v for y, x, v, _ in cells}, {}, [], {(y, x): i for y, x, _, i in cells}
    while len(taken) < 8:
        gain = lambda p: round(sum(weight[q] * max(0.0, w - cov.get(q, 0.0)) for dy, dx, w in kern if (q := (p[0] + dy, p[1] + dx)) in weight), 9)
        best = max(left, key=lambda p: (gain(p), -left[p]))
        taken.append(left.pop(best))
        for dy, dx, w in kern:
            q = best[0] + dy, best[1] + dx
            cov[q] = max(cov.get(q, 0.0), w)
        for p in [p for p in left if (p[0] - best[0]) ** 2 + (p[1] - best[1]) ** 2 < spacing * spacing]:
            del left[p]
    assert got == taken


def test_greedy_looks_at_the_best_first(spark, monkeypatch):
    """Few candidates in a round, more where those do not do: the same dots, and only the best go through the first round."""
    rng = random.Random(4)
    df = spark.createDataFrame([(y, x, rng.randrange(1, 99) / 99, y * 14 + x) for y in range(14) for x in range(14)], "y long, x long, v double, id long")
    both = lambda: [[tuple(r) for r in d.collect()] for d in (emit.cover(df, "v", "id", k=4, spacing=2.5), emit.poisson(df, "v", "id", spacing=3.0, k=4))]
    want = both()  # all candidates at once
    seen, outranking = [], emit._outranking
    monkeypatch.setattr(emit, "_outranking", lambda d, *a: (seen.append(d.count()), outranking(d, *a))[1])
    monkeypatch.setattr(emit, "LEAST", 5)
    monkeypatch.setattr(emit, "AHEAD", 1)
    assert both() == want and seen[0] < 20 and len(seen) > 2


def test_large_sample_is_not_sorted_whole(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "k").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) k"))
    kept = lambda n: sorted((r["k"] is not None, r["k"]) for r in emit.sample(df, "k", n, 7).collect())
    sizes = (0, 1, 40, 2999, 3001, 9000)
    want = [kept(n) for n in sizes]
    monkeypatch.setattr(emit, "SORTED", -1)
    assert [kept(n) for n in sizes] == want
    assert emit.sample(df, "k", 2000, 7)._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1


def test_thinning_by_tiles_equals_one_scan(spark, monkeypatch):
    """Small tiles that see little beyond them, walks of few cells together: the dots of one scan of the whole mask."""
    rng, h, w = random.Random(5), 30, 26
    inside = {(y, x) for y in range(h) for x in range(w) if rng.random() < 0.35}
    ring, kept, queued = [(a, b) for a, b, _ in emit._within(2.8)], set(), set()
    for start in sorted(inside):
        todo = [] if start in queued else [start]
        queued.add(start)
        for y, x in todo:
            if not any((y + a, x + b) in kept for a, b in ring):
                kept.add((y, x))
            for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if q in inside and q not in queued:
                    queued.add(q)
                    todo.append(q)
    most, tiled = [], emit.tiles.tiled
    monkeypatch.setattr(emit, "BEYOND", 2)
    monkeypatch.setattr(emit, "WALKED", 40)
    monkeypatch.setattr(emit.tiles, "tiled", lambda *a: (most.append(1), tiled(*a, size=12))[1])
    got = emit.geodesic_thin(spark.createDataFrame(sorted(inside), "y long, x long"), w, 2.8).collect()
    assert sorted(map(tuple, got)) == sorted(kept) and len(most) > 1


def test_scattered_sides_are_not_broadcast(spark):
    """A small file scattered to a hundred times its rows stays out of the driver."""
    df = spark.createDataFrame([(y, x, 1.0, y * 9 + x) for y in range(9) for x in range(9)], "y long, x long, s double, id long")
    for d in (emit._outranking(df, F.struct("s", "id"), emit._within(6)), emit._without(df, df.limit(3), emit._within(6))):
        d.collect()
        assert "SortMergeJoin" in (plan := d._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan


def test_components_of_a_long_snake(spark):
    w = 40
    snake = [(y, x) for y in range(0, 40, 2) for x in range(w)] + [(y, (w - 1) if y % 4 == 1 else 0) for y in range(1, 39, 2)]
    lone = [(50, 3)]
    got = distance.components(spark.createDataFrame(snake + lone, "y long, x long"), w).collect()
    assert {r["comp"] for r in got} == {0, 50 * w + 3} and len(got) == len(snake) + 1


def test_distance_transform(spark):
    rng = random.Random(3)
    seeds = [(rng.randrange(15), rng.randrange(18)) for _ in range(5)]
    g = grid(spark, 15, 18, lambda y, x: 0.0)
    got = values(distance.transform(g, spark.createDataFrame(seeds, "y long, x long")), "d2")
    assert got == {(y, x): min((y - a) ** 2 + (x - b) ** 2 for a, b in seeds) for y in range(15) for x in range(18)}
    none = values(distance.transform(g, spark.createDataFrame([], "y long, x long")), "d2")
    assert set(none.values()) == {None}


def test_distance_transform_is_linear(spark):
    """Seeds far off and outside the rows count, no frame runs to a column's end, and a row's work does not follow its largest distance."""
    g = grid(spark, 3, 400, lambda y, x: 0.0)
    seeds = [(-7, 0), (1, 399), (40, 120)]
    out = distance.transform(g, spark.createDataFrame(seeds, "y long, x long"))
    assert values(out, "d2") == {(y, x): min((y - a) ** 2 + (x - b) ** 2 for a, b in seeds) for y in range(3) for x in range(400)}
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString()
    at, high = list(range(0, 3000, 3)), [(i * i * 7) % 1000 for i in range(1000)]
    lowest, starts = distance._envelope(at, high)
    for x in range(0, 3000, 37):
        i = lowest[max(k for k in range(len(starts)) if starts[k] <= x)]
        assert high[i] + (x - at[i]) ** 2 == min(h + (x - u) ** 2 for u, h in zip(at, high, strict=True))


def test_drainage_of_a_plane(spark):
    g = grid(spark, 6, 7, lambda y, x: 100.0 - 10 * x - y * 0.001)
    acc = {r["cell_id"]: r["acc"] for r in distance.accumulation(distance.d8(g, "v", 7)).collect()}
    assert min(acc.values()) == 1 and sum(acc[y * 7] for y in range(6)) == 6
    assert sum(a for c, a in acc.items() if c % 7 == 6) >= 42


def test_runs_round_trip(spark):
    runs = [3, 5, 200, 1, 70_000, 4]
    assert scans.run_lengths(scans.packed_runs(runs)) == runs
    df = spark.createDataFrame([("m", bytearray(scans.packed_runs(runs)))], "mask string, payload binary")
    got = sorted(r["cell_id"] for r in scans.decode_runs(df, sum(runs)).collect())
    assert got == [3, 4, 5, 6, 7, 208, *range(70_209, 70_213)]
    with pytest.raises(ValueError):
        scans.run_lengths(b"\x80")
    with pytest.raises(Exception, match="runs cover"):
        scans.decode_runs(df, 5).collect()


def test_impute(spark):
    g = grid(spark, 5, 5, lambda y, x: None if (y, x) == (2, 2) else float(y * 5 + x))
    got = values(stencil.impute(g, "v", "f"), "f")
    assert got[2, 2] == 12.0 and got[0, 0] == 0.0
    none = grid(spark, 7, 7, lambda y, x: None)
    assert set(values(stencil.impute(none, "v", "f"), "f").values()) == {None}


def test_leaderboard(spark):
    row = '<tr><td>#{}</td><td><a href="/u">{}</a></td><td>{} submissions</td><td>{}</td></tr>'
    html = "<table>" + row.format(1, "ann", 3, "0.1234") + row.format(2, "bob", 9, "0.12345") + row.format(3, "short", 1, "0.12") + "</table>"
    pages = spark.createDataFrame([(1, html), (2, "<form>log in</form>"), (3, None)], "page_id long, html string")
    got = [tuple(r) for r in scans.leaderboard(pages, "html").collect()]
    assert got == [(1, 1, "ann", 3, 0.1234), (1, 2, "bob", 9, 0.12345)]


def test_header_fails_closed(spark):
    lines = spark.createDataFrame([(0, "a,b"), (1, "c,d")], "line_no int, text string")
    with pytest.raises(Exception, match="no header"):
        scans.header(lines, ["line"]).collect()


def test_blob_sha(spark):
    import hashlib

    text = "naïve\n"
    got = spark.createDataFrame([(text,)], "t string").select(rules.blob_sha(F.col("t")).alias("s")).first()["s"]
    data = text.encode()
    assert got == hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


def test_strict_number(spark):
    df = spark.createDataFrame([('{"k": 5}',), ('{"k": true}',), ('{"k": "5"}',), ('{"k": 500}',), ("{}",), ("bad",), (None,)], "j string")
    assert [r["ok"] for r in df.select(rules.number_in(F.col("j"), "$.k", 0, 60).alias("ok")).collect()] == [True, False, False, False, False, False, False]


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, b double")
    assert similarity.spearman(df, "a", "b").first()["rho"] is None


def test_gate(spark):
    rows = spark.createDataFrame([(0, 0.2, 0.1), (1, 0.2, 0.1), (2, 0.2, 0.1), (3, 0.1, 0.105)], "fold int, candidate double, baseline double")
    assert folds.gate(rows).first()["passed"]
    assert not folds.gate(rows.withColumn("candidate", F.col("candidate") - F.when(F.col("fold") == 3, 0.02).otherwise(0.0))).first()["passed"]


def test_lineament_prefers_lines(spark):
    line = grid(spark, 31, 31, lambda y, x: math.exp(-((y - 15) ** 2) / 4))
    blob = grid(spark, 31, 31, lambda y, x: math.exp(-((y - 15) ** 2 + (x - 15) ** 2) / 4))
    at = lambda g: values(tiles.tiled(g, ["v"], lambda z: {"response": tiles.lineament(z["v"])}, ["response"], (31, 31), 7), "response")[15, 15]
    assert at(line) > 1.5 * at(blob)


def test_replace_table_fails_closed(spark, tmp_path):
    df = spark.range(5)
    assert scans.replace_table(df, str(tmp_path / "t"), [F.col("id") >= 0]) == 5
    with pytest.raises(ValueError):
        scans.replace_table(df, str(tmp_path / "t"), [F.col("id") > 2])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
