"""Dense stencils by tiles, and filters by rows and columns, over the order grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import fourier, tiles
from gridloom.operators import stencil as st
from gridloom.plans.registry import query
from gridloom.plans.stencil_queries import DENSE, NEAREST, REFLECT, conv_sql, grad_sql, smooth_sql
from gridloom.sources.cells import cells, spec


def _grid(spark, sf, *, items=False):
    """y, x, a (price in thousands) and with items b (quantity) and c (discount), 0 where there is none; every cell of the square."""
    w = spec(spark, sf).width
    d = st.dense(cells(spark, sf, items=items), w, w)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    cols = {"a": zero("v") / 1000} | ({"b": zero("qty"), "c": zero("disc") * 100, "whole": F.col("v").isNotNull() & F.col("qty").isNotNull()} if items else {})
    return d.select("y", "x", *[c.alias(k) for k, c in cols.items()]), (w, w)


def _rounded(df, *columns, digits=6):
    return df.select("y", "x", *[F.round(c, digits).alias(c) for c in columns])


#: A square without holes: a, b and c as in `_grid`.
FILLED = f"{DENSE}, q AS (SELECT y, x, w, coalesce(v, 0) / 1000 AS a, coalesce(qty, 0) AS b, coalesce(disc, 0) * 100 AS c, v IS NOT NULL AND qty IS NOT NULL AS whole FROM dn)"


def _at(alias: str, dy: str, dx: str) -> str:
    """Join condition: `alias` is q at the clamped offset from d."""
    return f"{alias}.y = {NEAREST.format(c=f'd.y + {dy}')} AND {alias}.x = {NEAREST.format(c=f'd.x + {dx}')}"


@query()
def c26_vertical_derivative(spark, sf):
    """The upward derivative in the Fourier domain; a task holds one row or one column."""
    d, n = _grid(spark, sf, items=True)
    return fourier.vertical_derivative(d, "b", "f", n).select("y", "x", F.round("f", 6).alias("value"))


WINDOW = "(SELECT a AS dv, b AS du FROM range(-3, 4) r(a), range(-3, 4) s(b)) k"
SOLVE = f"""{FILLED}, gr AS (SELECT y, x, w, whole, b / 10 AS fz, {grad_sql('q', 'a', 'y', 'fy')}, {grad_sql('q', 'a', 'x', 'fx')} FROM q),
s AS (SELECT d.y, d.x, any_value(d.whole) AS whole, sum(n.fx * n.fx) AS sxx, sum(n.fx * n.fy) AS sxy, sum(n.fx * n.fz) AS sxz, sum(n.fy * n.fy) AS syy, sum(n.fy * n.fz) AS syz, sum(n.fz * n.fz) AS szz,
  sum(n.fx * (du * n.fx + dv * n.fy)) AS rx, sum(n.fy * (du * n.fx + dv * n.fy)) AS ry, sum(n.fz * (du * n.fx + dv * n.fy)) AS rz, sum((du * n.fx + dv * n.fy) ** 2) AS bb
  FROM gr d, {WINDOW}, gr n WHERE {_at('n', 'k.dv', 'k.du')} GROUP BY d.y, d.x),
m AS (SELECT *, sxx * (syy * szz - syz * syz) + sxy * (sxz * syz - sxy * szz) + sxz * (sxy * syz - sxz * syy) AS det, sxx + syy + szz AS tr FROM s WHERE whole),
t AS (SELECT *, (rx * (syy * szz - syz * syz) + ry * (sxz * syz - sxy * szz) + rz * (sxy * syz - sxz * syy)) / det AS x0,
  (rx * (sxz * syz - sxy * szz) + ry * (sxx * szz - sxz * sxz) + rz * (sxz * sxy - sxx * syz)) / det AS y0,
  (rx * (sxy * syz - sxz * syy) + ry * (sxz * sxy - sxx * syz) + rz * (sxx * syy - sxy * sxy)) / det AS z0 FROM m WHERE tr > 0 AND abs(det) > 1e-10 * greatest((tr / 3) ** 3, 1e-30) AND bb > 0),
e AS (SELECT *, sqrt(greatest(bb - (x0 * rx + y0 * ry + z0 * rz), 0) / greatest(bb, 1e-30)) AS residual FROM t),
ok AS (SELECT *, abs(z0) BETWEEN 0.5 AND 15 AND abs(x0) <= 3.5 AND abs(y0) <= 3.5 AND residual < {{residual}} AS accepted FROM e)"""


def _solutions(spark, sf, residual):
    """Windows solved for the price as a field and the quantity as its vertical derivative."""
    d, n = _grid(spark, sf, items=True)
    d = d.withColumn("fz", F.col("b") / 10)

    def solve(z):
        return tiles.window_solutions(z["a"], z["fz"], z["whole"] == 1, residual_max=residual)

    return tiles.tiled(d.withColumn("whole", F.col("whole").cast("double")), ["a", "fz", "whole"], solve, ["x0", "y0", "z0", "residual", "accepted"], n, halo=4).where("accepted IS NOT NULL"), n


@query(f"WITH {SOLVE.format(residual=0.15)} SELECT y, x, round(x0, 5) AS x0, round(y0, 5) AS y0, round(abs(z0), 5) AS depth, round(residual, 5) AS residual, accepted FROM ok")
def c28_window_equations(spark, sf):
    """Three unknowns of every 7 x 7 window, with the gates on conditioning, depth, offset and residual."""
    s, _ = _solutions(spark, sf, 0.15)
    return s.where("x0 IS NOT NULL").select("y", "x", F.round("x0", 5).alias("x0"), F.round("y0", 5).alias("y0"), F.round(F.abs("z0"), 5).alias("depth"), F.round("residual", 5).alias("residual"), (F.col("accepted") == 1).alias("accepted"))


@query(f"WITH {SOLVE.format(residual=0.15)} SELECT count(*) AS windows, count(*) - (SELECT count(*) FROM t) AS unsolved, (SELECT count(*) FROM ok WHERE NOT accepted) AS rejected, (SELECT count(*) FROM ok WHERE accepted) AS accepted FROM m")
def c28_rejected_windows(spark, sf):
    """How many windows have no solution, and how many solutions the gates refuse."""
    s, _ = _solutions(spark, sf, 0.15)
    lost = F.col("x0").isNull()
    return s.agg(F.count("*").alias("windows"), F.count_if(lost).alias("unsolved"), F.count_if(~lost & (F.col("accepted") == 0)).alias("rejected"), F.count_if(F.col("accepted") == 1).alias("accepted"))


SPREAD = f"""{SOLVE.format(residual=0.99)}, hit AS (SELECT greatest(0, least((SELECT max(w) FROM q) - 1, y + round_even(round(y0, 5), 0)::BIGINT)) AS y, greatest(0, least((SELECT max(w) FROM q) - 1, x + round_even(round(x0, 5), 0)::BIGINT)) AS x, abs(z0) AS depth, 1 - residual AS quality FROM ok WHERE accepted),
h AS (SELECT y, x, count(*)::DOUBLE AS n, sum(depth) AS ds, sum(quality) AS qs FROM hit GROUP BY ALL), base AS (SELECT q.y, q.x, q.w, coalesce(n, 0) AS n, coalesce(ds, 0) AS ds, coalesce(qs, 0) AS qs FROM q LEFT JOIN h USING (y, x)),
{conv_sql('base', 'n', 'n', st.gaussian_taps(1.5), NEAREST, 'cn')}, {conv_sql('base', 'ds', 'ds', st.gaussian_taps(1.5), NEAREST, 'cd')}, {conv_sql('base', 'qs', 'qs', st.gaussian_taps(1.5), NEAREST, 'cq')}"""


@query(f"WITH {SPREAD} SELECT y, x, round(n, 5) AS density, CASE WHEN n > 1e-3 THEN round(ds / n, 4) END AS depth, CASE WHEN n > 1e-3 THEN round(qs / n, 4) END AS quality FROM cn JOIN cd USING (y, x) JOIN cq USING (y, x)")
def c29_scatter_solutions(spark, sf):
    """Accepted solutions gathered where they point to (halves to even, kept on the grid), smoothed: density, depth and quality."""
    s, (h, w) = _solutions(spark, sf, 0.99)
    to = lambda c, off, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + F.rint(F.round(off, 5)).cast("long")))
    hit = s.where("accepted = 1").select(to("y", "y0", h).alias("y"), to("x", "x0", w).alias("x"), F.abs("z0").alias("depth"), (1 - F.col("residual")).alias("quality"))
    sums = hit.groupBy("y", "x").agg(F.count("*").cast("double").alias("n"), F.sum("depth").alias("ds"), F.sum("quality").alias("qs"))
    base = st.dense(sums, h, w).fillna(0.0)
    spread = lambda z: {k: tiles.gaussian(v, 1.5, "edge") for k, v in z.items()}
    got = tiles.tiled(base, ["n", "ds", "qs"], spread, ["n", "ds", "qs"], (h, w), halo=6)
    seen = lambda c: F.when(F.col("n") > 1e-3, F.round(F.col(c) / F.col("n"), 4))
    return got.select("y", "x", F.round("n", 5).alias("density"), seen("ds").alias("depth"), seen("qs").alias("quality"))


RINGS = {r: ", ".join(f"({y}, {x}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for y, x, a, b in tiles.ring(r)) for r in (3, 5)}
_RIM = """r{r} AS (SELECT d.y, d.x, least(abs(sum(n.gy * uy + n.gx * ux) / nullif(sum(n.m), 0)), 1) AS c FROM gm d, (VALUES {ring}) k(dy, dx, uy, ux), gm n WHERE n.y = d.y + dy AND n.x = d.x + dx GROUP BY d.y, d.x HAVING count(*) = {size}),
b{r} AS (SELECT d.y, d.x, sum(coalesce(n.c, 0)) / {size} AS s FROM gm d, (VALUES {ring}) k(dy, dx, uy, ux) LEFT JOIN r{r} n ON n.y = d.y + dy AND n.x = d.x + dx GROUP BY d.y, d.x)"""


@query(f"""WITH {FILLED}, gr AS (SELECT y, x, {grad_sql('q', 'a', 'y', 'gy')}, {grad_sql('q', 'a', 'x', 'gx')} FROM q), gm AS (SELECT *, sqrt(gy * gy + gx * gx) AS m FROM gr), p AS (SELECT quantile_cont(m, 0.95) AS s FROM gm),
{', '.join(_RIM.format(r=r, ring=RINGS[r], size=len(tiles.ring(r))) for r in RINGS)}
SELECT y, x, round(greatest(b3.s, b5.s) * least(gm.m / greatest(p.s, 1e-12), 3), 6) AS value FROM gm JOIN b3 USING (y, x) JOIN b5 USING (y, x), p""")
def c23_rim_support(spark, sf):
    """Centres of radial gradient cast back onto rings of two radii, times the edge there."""
    d, n = _grid(spark, sf)
    size = tiles.tiled(d, ["a"], lambda z: {"m": _steepness(z["a"])}, ["m"], n, halo=1)
    p95 = size.agg(F.percentile("m", 0.95).alias("p")).first()["p"] or 0.0  # one number
    rim = lambda z: {"s": tiles.rim_support(z["a"], _edge(z["a"], p95), (3, 5))}
    return tiles.tiled(d, ["a"], rim, ["s"], n, halo=14).select("y", "x", F.round("s", 6).alias("value"))


def _steepness(a):
    gy, gx = tiles.slopes(a)
    return (gy * gy + gx * gx) ** 0.5


def _edge(a, scale):
    return (_steepness(a) / max(scale, 1e-12)).clip(0, 3)


LAGS = [(lag, i, *tiles.lag_step(u, lag)) for lag in (2, 3, 6) for i, u in enumerate(tiles.STRIKES)]
LAG_SQL = ", ".join(f"({lag}, {i}, {dy}, {dx}, {s!r}::DOUBLE)" for lag, i, dy, dx, s in LAGS)


@query(f"WITH {FILLED} SELECT lag, strike, dy, dx, round(any_value(scale), 6) AS scale, count(n.y) AS pairs FROM q d CROSS JOIN (VALUES {LAG_SQL}) k(lag, strike, dy, dx, scale) LEFT JOIN q n ON n.whole AND n.y = d.y + dy AND n.x = d.x + dx WHERE d.whole GROUP BY ALL")
def c30_lag_steps(spark, sf):
    """The whole steps of each lag along each strike, and how many pairs of valid cells they join."""
    d = _grid(spark, sf, items=True)[0].where("whole").select("y", "x")
    k = F.array(*[F.struct(F.lit(lag).alias("lag"), F.lit(i).alias("strike"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(s)).alias("scale")) for lag, i, dy, dx, s in LAGS])
    ends = d.select("y", "x", F.explode(k).alias("k")).select((F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x"), "k.*")
    ends = ends.join(d.withColumn("there", F.lit(1)), ["y", "x"], "left")
    return ends.groupBy("lag", "strike", "dy", "dx").agg(F.round(F.first("scale"), 6).alias("scale"), F.count("there").alias("pairs"))


def _variance_sql(src: str, col: str, lag: int, tag: str) -> str:
    """{tag}0 .. {tag}3 (y, x, w, e): smoothed semivariances along the strikes, and {tag} (y, x, w, g): their mean."""
    parts = []
    for i, unit in enumerate(tiles.STRIKES):
        dy, dx, s = tiles.lag_step(unit, lag)
        parts.append(f"""{tag}e{i} AS (SELECT d.y, d.x, d.w, {0.25 * s!r}::DOUBLE * ((f.{col} - d.{col}) ** 2 + (b.{col} - d.{col}) ** 2) AS e FROM {src} d, {src} f, {src} b WHERE {_at('f', str(dy), str(dx))} AND {_at('b', str(-dy), str(-dx))}),
{conv_sql(f'{tag}e{i}', 'e', 'e', st.gaussian_taps(1.0), REFLECT, f'{tag}{i}')}""")
    return ",\n".join(parts) + f", {tag} AS (SELECT a.y, a.x, a.w, (a.e + b.e + c.e + d.e) / 4 AS g FROM {tag}0 a JOIN {tag}1 b USING (y, x) JOIN {tag}2 c USING (y, x) JOIN {tag}3 d USING (y, x))"


@query(f"""WITH {FILLED}, {_variance_sql('q', 'a', 2, 's')}, {_variance_sql('q', 'a', 6, 't')}
SELECT s.y, s.x, round(s0.e, 4) AS g0, round(s1.e, 4) AS g1, round(s2.e, 4) AS g2, round(s3.e, 4) AS g3, round(s.g, 4) AS iso2, round(t.g, 4) AS iso6 FROM s JOIN s0 USING (y, x) JOIN s1 USING (y, x) JOIN s2 USING (y, x) JOIN s3 USING (y, x) JOIN t USING (y, x)""")
def c31_directional_semivariance(spark, sf):
    """Smoothed semivariances at lag 2 along four strikes, and their means at lags 2 and 6."""
    d, n = _grid(spark, sf)

    def variances(z):
        two = tiles.semivariances(z["a"], 2, 1.0)
        return {f"g{i}": two[i] for i in range(4)} | {"iso2": two.mean(0), "iso6": tiles.semivariances(z["a"], 6, 1.0).mean(0)}

    names = ["g0", "g1", "g2", "g3", "iso2", "iso6"]
    return _rounded(tiles.tiled(d, ["a"], variances, names, n, halo=10), *names, digits=4)


def _sides_sql(src: str, value: str) -> tuple[str, str]:
    """Select list and joins of the four differences across the strikes."""
    cols, joins = [], []
    for i, unit in enumerate(tiles.NORMALS):
        dy, dx, _ = tiles.lag_step(unit, 5)
        cols.append(f"round({value.format(t=f'p{i}')} - {value.format(t=f'm{i}')}, 5) AS j{i}")
        joins.append(f"JOIN {src} p{i} ON {_at(f'p{i}', str(dy), str(dx))} JOIN {src} m{i} ON {_at(f'm{i}', str(-dy), str(-dx))}")
    return ", ".join(cols), " ".join(joins)


_COLS, _JOINS = _sides_sql("s", "ln(greatest({t}.g, 0) + 1e-3)")


@query(f"WITH {FILLED}, {_variance_sql('q', 'a', 2, 's')} SELECT d.y, d.x, {_COLS} FROM s d {_JOINS}")
def c32_two_sided_log_jump(spark, sf):
    """Jumps of the log semivariance at lag 2 across four strikes, five cells to either side."""
    d, n = _grid(spark, sf)
    jumps = lambda z: {f"j{i}": j for i, j in enumerate(tiles.log_jumps(tiles.semivariances(z["a"], 2, 1.0).mean(0)))}
    return _rounded(tiles.tiled(d, ["a"], jumps, ["j0", "j1", "j2", "j3"], n, halo=11), "j0", "j1", "j2", "j3", digits=5)


_COLS, _JOINS = _sides_sql("q", "{t}.a")


@query(f"WITH {FILLED} SELECT d.y, d.x, {_COLS} FROM q d {_JOINS}")
def c33_two_sided_difference(spark, sf):
    d, n = _grid(spark, sf)
    sides = lambda z: {f"j{i}": j for i, j in enumerate(tiles.across(z["a"]))}
    return _rounded(tiles.tiled(d, ["a"], sides, ["j0", "j1", "j2", "j3"], n, halo=5), "j0", "j1", "j2", "j3", digits=5)


@query()
def f08_texture_channels(spark, sf):
    """Eight channels of texture contrast; the bands in standard units over the whole grid."""
    d, n = _grid(spark, sf, items=True)
    m = d.agg(*[f(c).alias(f"{k}{c}") for c in "abc" for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()  # six numbers
    z = d.select("y", "x", *[((F.col(c) - m[f"m{c}"]) / (m[f"s{c}"] or 1.0)).alias(c) for c in "abc"])

    def channels(t):
        return tiles.texture_channels({"a": t["a"], "b": t["b"], "c": t["a"], "d": tiles.gaussian(t["a"], 1.0), "e": t["b"], "f": t["c"], "g": t["c"], "h": t["b"]})

    names = ["jump_a", "jump_b", "concordance", "spectral_step", "persistence", "anisotropy", "scalar_step", "strained"]
    return _rounded(tiles.tiled(z, ["a", "b", "c"], channels, names, n, halo=28), *names)


SLOPE = f"sl AS (SELECT y, x, degrees(atan(sqrt(gy * gy + gx * gx))) AS slope FROM (SELECT y, x, {grad_sql('q', 'a', 'y', 'gy')}, {grad_sql('q', 'a', 'x', 'gx')} FROM q))"


@query(f"""WITH {FILLED}, rays AS (SELECT i, k, round_even(sin(2 * pi() * i / 32) * k, 0)::BIGINT AS dy, round_even(cos(2 * pi() * i / 32) * k, 0)::BIGINT AS dx, 2 * pi() * i / 32 AS t FROM range(32) r(i), range(1, 17) s(k)),
o AS (SELECT d.y, d.x, i, any_value(t) AS t, avg(atan2(n.a - d.a, k)) AS ray FROM q d, rays, q n WHERE {_at('n', 'dy', 'dx')} GROUP BY d.y, d.x, i),
s AS (SELECT y, x, sum(ray) AS total, sum(cos(2 * t) * ray) AS c2, sum(sin(2 * t) * ray) AS s2, sum(abs(ray)) AS size FROM o GROUP BY y, x), {SLOPE}
SELECT s.y, s.x, round(1 - total / 32 / (pi() / 2), 6) AS openness, round(sqrt(c2 * c2 + s2 * s2) / greatest(size, 1e-9), 6) AS magnitude, round(slope, 6) AS slope FROM s JOIN sl USING (y, x)""")
def c42_openness(spark, sf):
    """Mean sight line over 32 rays of 16 steps, the strength of its axis, and the slope."""
    d, n = _grid(spark, sf)

    def layers(z):
        gy, gx = tiles.slopes(z["a"])
        return tiles.horizon(z["a"]) | {"slope": _degrees(gy, gx)}

    names = ["openness", "magnitude", "slope"]
    return _rounded(tiles.tiled(d, ["a"], layers, names, n, halo=16), *names)


def _degrees(gy, gx):
    return np.degrees(np.arctan(np.hypot(gy, gx)))


@query(f"WITH {FILLED}, {smooth_sql('q', 'b', 1.5, 's')} SELECT y, x, round(s, 6) AS value FROM s")
def c06_smoothed_by_tiles(spark, sf):
    """The Gaussian mean of a filled band by tiles: the same numbers as by windows."""
    d, n = _grid(spark, sf, items=True)
    return _rounded(tiles.tiled(d.select("y", "x", "b"), ["b"], lambda z: {"value": tiles.gaussian(z["b"], 1.5, "edge")}, ["value"], n, halo=6), "value")

