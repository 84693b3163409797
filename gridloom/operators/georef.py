"""Fit of an axis-parallel map to an outline: u = a x + c, v = b y + d, so that points fall on a mask.

A search from coarse to fine instead of a simplex: every level places the points under 81 neighbouring parameter sets at once,
reads the distance to the mask from the exact transform as a table, and keeps the set of least mean cost, until steps are
far below a cell. The reference's optimiser stops at a local minimum of the same cost; results agree where
the minimum is one.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.distance import transform, written

#: Farthest distance that counts, the share of points that must fall on the grid, and the cost where fewer do.
FAR, SHARE, OUTSIDE = 40.0, 0.9, 1000.0


def costs(points: DataFrame, field: DataFrame, n: tuple[int, int], sets: list[tuple[float, float, float, float]]) -> DataFrame:
    """(i, cost): mean cost of points (x, y) under each parameter set. The sets are literals, at most a hundred or so."""
    k = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(c) for c, v in zip("abcd", s, strict=True)]) for i, s in enumerate(sets)])
    at = points.select("x", "y", F.explode(k).alias("k"))
    u, v = F.col("x") * F.col("k.a") + F.col("k.c"), F.col("y") * F.col("k.b") + F.col("k.d")
    at = at.select("k.i", u.alias("u"), v.alias("v"))
    on = (F.col("u") >= 0) & (F.col("u") < n[1] - 1) & (F.col("v") >= 0) & (F.col("v") < n[0] - 1)
    cell = at.select("i", F.when(on, F.rint("v").cast("long")).alias("fy"), F.when(on, F.rint("u").cast("long")).alias("fx"))
    hit = cell.groupBy("i", "fy", "fx").agg(F.count("*").alias("m")).join(field, ["fy", "fx"], "left")
    by = hit.groupBy("i").agg(F.sum("m").alias("m"), F.sum(F.when(F.col("fy").isNotNull(), F.col("m"))).alias("on"), F.sum(F.col("cost") * F.col("m")).alias("s"))
    return by.select("i", F.when(F.coalesce("on", F.lit(0)) < SHARE * F.col("m"), OUTSIDE).otherwise(F.col("s") / F.col("on")).alias("cost"))


def fit(points: DataFrame, mask: DataFrame, grid: DataFrame, n: tuple[int, int], *, levels: int = 14) -> tuple[tuple[float, float, float, float], float]:
    """((a, b, c, d), cost) for points (x, y) and mask cells (y, x) of a dense grid."""
    field = transform(grid.select("y", "x"), mask)
    field = written(field.select(F.col("y").alias("fy"), F.col("x").alias("fx"), F.least(F.sqrt("d2"), F.lit(FAR)).alias("cost")))
    points = written(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    p = points.agg(*[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("a", F.min), ("b", F.max))]).first()
    m = mask.agg(*[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("a", F.min), ("b", F.max))]).first()
    if p["ax"] is None or m["ax"] is None or p["ax"] == p["bx"] or p["ay"] == p["by"]:
        raise ValueError("points and mask must span both axes")
    a = (m["bx"] - m["ax"]) / (p["bx"] - p["ax"])
    b = -(m["by"] - m["ay"]) / (p["by"] - p["ay"])
    base = (a, b, m["ax"] - a * p["ax"], m["ay"] - b * p["by"])
    spread = min(60.0, max(n) / 4)
    sets = [(base[0] * s, base[1] * s, base[2] + dx, base[3] + dy) for s in (0.9, 0.95, 1.0, 1.05, 1.1) for dx in (-spread, 0, spread) for dy in (-spread, 0, spread)]
    best, cost = _least(points, field, n, sets)
    wide, high = abs(p["bx"] - p["ax"]), abs(p["by"] - p["ay"])
    shift = spread / 2
    for _ in range(levels):
        # a change of scale moves the farthest point as far as a shift does
        steps = (shift / wide, shift / high, shift, shift)
        mid = ((p["ax"] + p["bx"]) / 2, (p["ay"] + p["by"]) / 2)
        sets = []
        for i, j, k, l in product((0, -1, 1), repeat=4):
            # scales turn about the middle of the points, so that they do not shift them as well
            sets.append((best[0] + i * steps[0], best[1] + j * steps[1], best[2] + k * steps[2] - i * steps[0] * mid[0], best[3] + l * steps[3] - j * steps[1] * mid[1]))
        best, cost = _least(points, field, n, sets)
        shift /= 2
    return best, cost


def _least(points: DataFrame, field: DataFrame, n: tuple[int, int], sets: list) -> tuple[tuple, float]:
    got = costs(points, field, n, sets).agg(F.min_by(F.struct("i", "cost"), F.struct("cost", "i")).alias("b")).first()["b"]
    return sets[got["i"]], got["cost"]
