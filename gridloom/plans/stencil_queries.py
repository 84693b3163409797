"""Neighbourhood operators over the order grid."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions.scalar import quantile01, robust_z
from gridloom.operators import stencil as st
from gridloom.operators import tiles
from gridloom.operators.distance import eroded
from gridloom.plans.registry import query
from gridloom.sources.cells import GRID_SQL, cells, footprint, spec, truth

DENSE = f"{GRID_SQL}, dn AS (SELECT yy.y, xx.x, dims.w, g.cell_id, g.v, g.qty, g.disc, g.p, g.st FROM dims, unnest(range(w)) yy(y), unnest(range(w)) xx(x) LEFT JOIN g ON g.y = yy.y AND g.x = xx.x)"
NEAREST = "greatest(0, least(d.w - 1, {c}))"
REFLECT = "CASE WHEN {c} < 0 THEN -({c}) - 1 WHEN {c} >= d.w THEN 2 * d.w - 1 - ({c}) ELSE {c} END"


def taps_sql(weights) -> str:
    r = len(weights) - 1
    return "(VALUES " + ", ".join(f"({k}, {weights[abs(k)]!r}::DOUBLE)" for k in range(-r, r + 1)) + ")"


def conv_sql(src: str, col: str, out: str, weights, mode: str, tag: str) -> str:
    """CTEs that convolve column `col` of `src` along x, then y; the result is {tag} (y, x, w, out)."""
    cx, cy = mode.format(c="d.x + k.k"), mode.format(c="d.y + k.k")
    return f"""{tag}x AS (SELECT d.y, d.x, d.w, sum(k.wt * n.{col}) + CASE WHEN count(n.{col}) < count(*) THEN NULL ELSE 0 END AS {out} FROM {src} d, {taps_sql(weights)} k(k, wt), {src} n WHERE n.y = d.y AND n.x = {cx} GROUP BY d.y, d.x, d.w),
{tag} AS (SELECT d.y, d.x, d.w, sum(k.wt * n.{out}) + CASE WHEN count(n.{out}) < count(*) THEN NULL ELSE 0 END AS {out} FROM {tag}x d, {taps_sql(weights)} k(k, wt), {tag}x n WHERE n.x = d.x AND n.y = {cy} GROUP BY d.y, d.x, d.w)"""


def smooth_sql(src: str, col: str, sigma: float, tag: str, truncate: float = 4.0) -> str:
    """{tag} (y, x, w, s): the normalised Gaussian mean of {col} over its valid cells."""
    w = st.gaussian_taps(sigma, truncate)
    return f"""{tag}0 AS (SELECT y, x, w, coalesce({col}, 0.0) AS num, CAST({col} IS NOT NULL AS DOUBLE) AS den FROM {src}),
{conv_sql(tag + '0', 'num', 'num', w, NEAREST, tag + 'n')}, {conv_sql(tag + '0', 'den', 'den', w, NEAREST, tag + 'd')},
{tag} AS (SELECT s.y, s.x, s.w, CASE WHEN s.{col} IS NOT NULL AND d.den > 1e-12 THEN n.num / d.den END AS s FROM {src} s JOIN {tag}n n USING (y, x) JOIN {tag}d d USING (y, x))"""


def grad_sql(src: str, col: str, axis: str, out: str) -> str:
    o = "x" if axis == "y" else "y"
    w = f"OVER (PARTITION BY {o} ORDER BY {axis})"
    return f"CASE WHEN lag(1) {w} IS NULL THEN lead({col}) {w} - {col} WHEN lead(1) {w} IS NULL THEN {col} - lag({col}) {w} ELSE (lead({col}) {w} - lag({col}) {w}) / 2 END AS {out}"


def mag_sql(src: str, col: str, tag: str) -> str:
    return f"{tag} AS (SELECT y, x, sqrt(gy * gy + gx * gx) AS m FROM (SELECT y, x, {grad_sql(src, col, 'y', 'gy')}, {grad_sql(src, col, 'x', 'gx')} FROM {src}))"


def _dense(spark, sf, *, items=False):
    w = spec(spark, sf).width
    return st.dense(cells(spark, sf, items=items), w, w), (w, w)


def _out(df, value, name="value"):
    return df.where(F.col(value).isNotNull()).select("y", "x", F.round(value, 6).alias(name))


@query(f"WITH {DENSE}, {mag_sql('dn', 'v', 'm')} SELECT y, x, round(m, 6) AS value FROM m WHERE m IS NOT NULL")
def c01_gradient_magnitude(spark, sf):
    d, _ = _dense(spark, sf)
    return _out(st.gradient_magnitude(d, "v", "m"), "m")


@query(f"WITH {DENSE}, z AS (SELECT y, x, coalesce(qty, 0) AS q FROM dn), {mag_sql('z', 'q', 'm')} SELECT y, x, round(m, 6) AS value FROM m WHERE m IS NOT NULL")
def c02_gradient_null_as_zero(spark, sf):
    d, _ = _dense(spark, sf, items=True)
    return _out(st.gradient_magnitude(d.withColumn("q", F.coalesce("qty", F.lit(0.0))), "q", "m"), "m")


@query(f"WITH {DENSE}, {smooth_sql('dn', 'v', 1.0, 's')}, {mag_sql('s', 's', 'm')} SELECT y, x, round(m, 4) AS value FROM m WHERE m IS NOT NULL")
def c03_smoothed_gradient(spark, sf):
    d, n = _dense(spark, sf)
    return st.gradient_magnitude(st.smoothed(d, "v", "s", 1.0, n), "s", "m").where("m IS NOT NULL").select("y", "x", F.round("m", 4).alias("value"))


BOX5 = [0.2] * 3


@query(f"WITH {DENSE}, q AS (SELECT y, x, w, v / 1000 AS a, v / 1000 * (v / 1000) AS b FROM dn), {conv_sql('q', 'a', 'm', BOX5, REFLECT, 'ma')}, {conv_sql('q', 'b', 'm', BOX5, REFLECT, 'mb')} SELECT y, x, round(sqrt(greatest(0, mb.m - ma.m * ma.m)), 6) AS value FROM ma JOIN mb USING (y, x) WHERE ma.m IS NOT NULL")
def c04_local_std(spark, sf):
    d, n = _dense(spark, sf)
    return _out(st.box_std(d.withColumn("a", F.col("v") / 1000), "a", "s", 5, n), "s")


@query(f"""WITH {GRID_SQL}, q AS (SELECT y, x, qty AS a FROM g), seed AS (SELECT d.y, d.x, avg(n.a) AS seed FROM (SELECT y + i AS ny, x + j AS nx, y, x FROM q, range(-2, 3) r(i), range(-2, 3) s(j)) d JOIN q n ON n.y = d.ny AND n.x = d.nx GROUP BY d.y, d.x),
sd AS (SELECT q.y, q.x, coalesce(q.a, seed.seed) AS s FROM q LEFT JOIN seed USING (y, x)),
mid AS (SELECT d.y, d.x, median(n.s) AS m FROM (SELECT y + i AS ny, x + j AS nx, y, x FROM sd, range(-1, 2) r(i), range(-1, 2) s(j)) d JOIN sd n ON n.y = d.ny AND n.x = d.nx GROUP BY d.y, d.x)
SELECT q.y, q.x, round(coalesce(q.a, CASE WHEN seed.seed IS NOT NULL THEN mid.m END), 6) AS value FROM q LEFT JOIN seed USING (y, x) LEFT JOIN mid USING (y, x)""")
def c05_impute(spark, sf):
    return st.impute(cells(spark, sf, items=True), "qty", "f").select("y", "x", F.round("f", 6).alias("value"))


@query(f"WITH {DENSE}, {smooth_sql('dn', 'qty', 1.5, 's')} SELECT y, x, round(s, 6) AS value FROM s WHERE s IS NOT NULL")
def c06_smoothed(spark, sf):
    d, n = _dense(spark, sf, items=True)
    return _out(st.smoothed(d, "qty", "s", 1.5, n), "s")


@query(f"""WITH {DENSE}, {smooth_sql('dn', 'qty', 2.0, 's')}, r AS (SELECT dn.y, dn.x, dn.w, (qty - s) * (qty - s) AS e, qty - s AS d FROM dn JOIN s USING (y, x)), {smooth_sql('r', 'e', 2.0, 't')}
SELECT y, x, round(d / greatest(sqrt(t.s), 1e-6), 6) AS value FROM r JOIN t USING (y, x) WHERE d IS NOT NULL""")
def c07_local_contrast(spark, sf):
    d, n = _dense(spark, sf, items=True)
    s = st.smoothed(d, "qty", "s", 2.0, n).withColumn("d", F.col("qty") - F.col("s")).withColumn("e", F.col("d") * F.col("d"))
    return _out(st.smoothed(s, "e", "t", 2.0, n).withColumn("c", F.col("d") / st.at_least(F.sqrt("t"), 1e-6)), "c")


@query(f"""WITH {DENSE}, {smooth_sql('dn', 'qty', 1.0, 's')}, {mag_sql('s', 's', 'm')}, bad AS (SELECT y + i AS y, x + j AS x FROM (SELECT y, x FROM dn WHERE qty IS NULL), range(-2, 3) r(i), range(-2, 3) s(j))
SELECT y, x, round(m, 6) AS value FROM m ANTI JOIN bad USING (y, x), dims WHERE m IS NOT NULL AND y BETWEEN 2 AND w - 3 AND x BETWEEN 2 AND w - 3""")
def c08_gradient_on_eroded_support(spark, sf):
    d, n = _dense(spark, sf, items=True)
    m = st.gradient_magnitude(st.smoothed(d, "qty", "s", 1.0, n), "s", "m").where("m IS NOT NULL")
    box = [(a, b, 1.0) for a in range(-2, 3) for b in range(-2, 3)]
    return _out(eroded(m, d.where("qty IS NOT NULL"), box), "m")


@query(f"""WITH {DENSE}, {smooth_sql('dn', 'qty', 2.0, 's')}, r AS (SELECT dn.y, dn.x, dn.w, (qty - s) * (qty - s) AS e FROM dn JOIN s USING (y, x)), {smooth_sql('r', 'e', 2.0, 't')} SELECT y, x, round(greatest(sqrt(s), 1e-6), 6) AS value FROM t WHERE s IS NOT NULL""")
def c09_local_sd_floor(spark, sf):
    d, n = _dense(spark, sf, items=True)
    s = st.smoothed(d, "qty", "s", 2.0, n).withColumn("e", (F.col("qty") - F.col("s")) * (F.col("qty") - F.col("s")))
    return _out(st.smoothed(s, "e", "t", 2.0, n).withColumn("c", st.at_least(F.sqrt("t"), 1e-6)), "c")


def _bilinear(dy: float, dx: float):
    fy, fx = math.floor(dy), math.floor(dx)
    a, b = dy - fy, dx - fx
    return [(fy, fx, (1 - a) * (1 - b)), (fy, fx + 1, (1 - a) * b), (fy + 1, fx, a * (1 - b)), (fy + 1, fx + 1, a * b)]


BIL = ", ".join(f"({y}, {x}, {w!r}::DOUBLE)" for y, x, w in _bilinear(1.25, -0.5))


@query(f"WITH {DENSE}, q AS (SELECT y, x, w, coalesce(qty, 0) AS a FROM dn) SELECT d.y, d.x, round(sum(k.wt * n.a), 6) AS value FROM q d, (VALUES {BIL}) k(dy, dx, wt), q n WHERE n.y = greatest(0, least(d.w - 1, d.y + k.dy)) AND n.x = greatest(0, least(d.w - 1, d.x + k.dx)) GROUP BY d.y, d.x")
def c10_subpixel_shift(spark, sf):
    d, (h, w) = _dense(spark, sf, items=True)
    q = d.select("y", "x", F.coalesce("qty", F.lit(0.0)).alias("a"))
    at = st.scatter(q.select(F.col("y").alias("oy"), F.col("x").alias("ox"), "y", "x"), _bilinear(1.25, -0.5))
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    at = at.withColumn("y", clamp(F.col("y"), h)).withColumn("x", clamp(F.col("x"), w))
    return at.join(q, ["y", "x"]).groupBy("oy", "ox").agg(F.round(F.sum(F.col("w") * F.col("a")), 6).alias("value")).select(F.col("oy").alias("y"), F.col("ox").alias("x"), "value")


@query(f"WITH {DENSE}, {smooth_sql('dn', 'qty', 2.0, 's')} SELECT y, x, round(1 - exp(-greatest(0, s - qty) / 10), 6) AS value FROM dn JOIN s USING (y, x) WHERE s IS NOT NULL")
def c12_depletion(spark, sf):
    d, n = _dense(spark, sf, items=True)
    s = st.smoothed(d, "qty", "s", 2.0, n)
    return _out(s.withColumn("c", -F.expm1(-st.at_least(F.col("s") - F.col("qty")) / 10)), "c")


HESS = "h1 AS (SELECT y, x, s, {gy}, {gx} FROM {src}), h2 AS (SELECT y, x, {yy}, {xx}, {xy} FROM h1)"


def hess_sql(src: str) -> str:
    return HESS.format(src=src, gy=grad_sql(src, "s", "y", "gy"), gx=grad_sql(src, "s", "x", "gx"), yy=grad_sql("h1", "gy", "y", "yy"), xx=grad_sql("h1", "gx", "x", "xx"), xy=grad_sql("h1", "gy", "x", "xy"))


def _saddle(spark, sf, scale):
    d, n = _dense(spark, sf, items=True)
    s = st.saddle(st.smoothed(d, "qty", "s", 2.0, n), "s", "c")
    return _out(s.withColumn("c", F.col("c") * scale), "c")


@query(f"WITH {DENSE}, {smooth_sql('dn', 'qty', 2.0, 's')}, {hess_sql('s')} SELECT y, x, round(4.0 * sqrt(greatest(0, -(yy * xx - xy * xy))), 6) AS value FROM h2 WHERE yy * xx - xy * xy IS NOT NULL")
def c14_saddle_twist(spark, sf):
    return _saddle(spark, sf, 4.0)


@query(f"WITH {DENSE}, {smooth_sql('dn', 'qty', 2.0, 's')}, {hess_sql('s')} SELECT y, x, round(sqrt(greatest(0, -(yy * xx - xy * xy))), 6) AS value FROM h2 WHERE yy * xx - xy * xy IS NOT NULL")
def c17_saddle_strength(spark, sf):
    return _saddle(spark, sf, 1.0)


def _dog(narrow: float, wide: float, weight: float) -> st.Kernel:
    a, b = st.gaussian_taps(narrow), st.gaussian_taps(wide)
    at = lambda w, k: w[abs(k)] if abs(k) < len(w) else 0.0
    r = len(b) - 1
    return [(y, x, at(a, y) * at(a, x) - weight * at(b, y) * at(b, x)) for y in range(-r, r + 1) for x in range(-r, r + 1)]


DOG = ", ".join(f"({y}, {x}, {w!r}::DOUBLE)" for y, x, w in _dog(1.0, 2.0, 0.65))


@query(f"WITH {GRID_SQL}, i AS (SELECT y, x FROM fp WHERE p = '1-URGENT' AND st = 'F') SELECT i.y + k.dy AS y, i.x + k.dx AS x, round(greatest(0, sum(k.wt)), 6) AS value FROM i, (VALUES {DOG}) k(dy, dx, wt) GROUP BY 1, 2")
def c15_difference_of_gaussians(spark, sf):
    """Sparse impulses scatter both Gaussians at once; the sum is clipped at zero."""
    i = truth(footprint(spark, sf)).where("st = 'F'").select("y", "x")
    return st.scatter(i, _dog(1.0, 2.0, 0.65)).groupBy("y", "x").agg(F.round(F.greatest(F.lit(0.0), F.sum("w")), 6).alias("value"))


LINES = ", ".join(f"({a}, {p}, {y}, {x})" for a, p, y, x in st.line_offsets(8, 4, 3))


@query(f"""WITH {GRID_SQL}, s AS (SELECT g.y - k.dy AS y, g.x - k.dx AS x, k.a, k.p, g.v / 1000 AS v FROM g, (VALUES {LINES}) k(a, p, dy, dx)),
o AS (SELECT y, x, a, sum(v) FILTER (p = 0) / 9 AS m, sum(v) FILTER (p = -1) / 9 AS l, sum(v) FILTER (p = 1) / 9 AS r FROM s GROUP BY y, x, a HAVING count(*) = 27) SELECT y, x, round(max(m - greatest(l, r)), 6) AS value FROM o GROUP BY y, x""")
def c19_lineament_response(spark, sf):
    n = (spec(spark, sf).width,) * 2
    got = tiles.tiled(cells(spark, sf).select("y", "x", F.col("v") / 1000).toDF("y", "x", "a"), ["a"], lambda z: {"r": tiles.lineament(z["a"])}, ["r"], n, halo=7)
    return _out(got, "r")


LINES0 = ", ".join(f"({a}, {y}, {x})" for a, _, y, x in st.line_offsets(8, 4))


@query(f"""WITH {GRID_SQL}, s AS (SELECT g.y - k.dy AS y, g.x - k.dx AS x, k.a, g.v / 1000 AS v FROM g, (VALUES {LINES0}) k(a, dy, dx)), o AS (SELECT y, x, a, sum(v) / 9 AS m FROM s GROUP BY y, x, a HAVING count(*) = 9),
b AS (SELECT y, x, max(m) - avg(m) AS boost FROM o GROUP BY y, x), q AS (SELECT quantile_cont(boost, 0.99) AS p99 FROM b) SELECT y, x, round(least(1, boost / p99), 6) AS value FROM b, q""")
def c20_ridge_coherence(spark, sf):
    def boost(z):
        best, mean = tiles.strike_means(z["a"])
        return {"boost": best - mean}

    n = (spec(spark, sf).width,) * 2
    b = tiles.tiled(cells(spark, sf).select("y", "x", F.col("v") / 1000).toDF("y", "x", "a"), ["a"], boost, ["boost"], n, halo=4).where("boost IS NOT NULL")
    q = b.agg(F.percentile("boost", 0.99).alias("p99"))
    return b.join(F.broadcast(q)).select("y", "x", F.round(F.least(F.lit(1.0), F.col("boost") / F.col("p99")), 6).alias("value"))


RING = ", ".join(f"({y}, {x}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for y, x, a, b in tiles.ring(4))


@query(f"SELECT dy, dx, round(uy, 6) AS uy, round(ux, 6) AS ux FROM (VALUES {RING}) k(dy, dx, uy, ux)")
def c21_annular_kernel(spark, sf):
    k = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx"), F.lit(a).alias("uy"), F.lit(b).alias("ux")) for y, x, a, b in tiles.ring(4)])
    return spark.range(1).select(F.explode(k).alias("k")).select("k.dy", "k.dx", F.round("k.uy", 6).alias("uy"), F.round("k.ux", 6).alias("ux"))


@query(f"""WITH {DENSE}, q AS (SELECT y, x, v / 1000 AS a FROM dn), gr AS (SELECT y, x, {grad_sql('q', 'a', 'y', 'gy')}, {grad_sql('q', 'a', 'x', 'gx')} FROM q),
s AS (SELECT gr.y - dy AS y, gr.x - dx AS x, gy * uy + gx * ux AS r, sqrt(gy * gy + gx * gx) AS m FROM gr, (VALUES {RING}) k(dy, dx, uy, ux) WHERE gy + gx IS NOT NULL)
SELECT y, x, round(sum(r) / sum(m), 6) AS value FROM s GROUP BY y, x HAVING count(*) = {len(tiles.ring(4))}""")
def c22_radial_coherence(spark, sf):
    """Share of a ring's gradient that points outward; only where the whole ring is valid."""
    n = (spec(spark, sf).width,) * 2
    got = tiles.tiled(cells(spark, sf).select("y", "x", F.col("v") / 1000).toDF("y", "x", "a"), ["a"], lambda z: {"c": tiles.ring_coherence(*tiles.slopes(z["a"]), 4)}, ["c"], n, halo=6)
    return _out(got, "c")


SOBEL_Y = [(a, b, a * (2.0 if b == 0 else 1.0)) for a in (-1, 0, 1) for b in (-1, 0, 1) if a]
SOBEL_X = [(b, a, w) for a, b, w in SOBEL_Y]
SOB = ", ".join(f"({y}, {x}, {dict(((a, b), w) for a, b, w in SOBEL_Y).get((y, x), 0.0)!r}::DOUBLE, {dict(((a, b), w) for a, b, w in SOBEL_X).get((y, x), 0.0)!r}::DOUBLE)" for y in (-1, 0, 1) for x in (-1, 0, 1))


def _sobel(df, value):
    wy, wx = ({(a, b): w for a, b, w in k} for k in (SOBEL_Y, SOBEL_X))
    k = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx"), F.lit(wy.get((y, x), 0.0)).alias("wy"), F.lit(wx.get((y, x), 0.0)).alias("wx")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    s = df.where(F.col(value).isNotNull()).select("y", "x", value, F.explode(k).alias("k"))
    s = s.select((F.col("y") - F.col("k.dy")).alias("y"), (F.col("x") - F.col("k.dx")).alias("x"), (F.col(value) * F.col("k.wy")).alias("a"), (F.col(value) * F.col("k.wx")).alias("b"))
    return s.groupBy("y", "x").agg(F.count("*").alias("n"), F.sum("a").alias("sy"), F.sum("b").alias("sx")).where("n = 9").drop("n")


@query(f"""WITH {GRID_SQL}, s AS (SELECT g.y - dy AS y, g.x - dx AS x, v / 1000 * wy AS a, v / 1000 * wx AS b, qty * wy AS c, qty * wx AS d FROM g, (VALUES {SOB}) k(dy, dx, wy, wx) WHERE qty IS NOT NULL)
SELECT y, x, round(abs(sum(a) * sum(d) - sum(b) * sum(c)), 4) AS value FROM s GROUP BY y, x HAVING count(*) = 9""")
def c24_cross_gradient(spark, sf):
    g = cells(spark, sf, items=True).where("qty IS NOT NULL").withColumn("v", F.col("v") / 1000)
    a, b = _sobel(g, "v").withColumnsRenamed({"sy": "ay", "sx": "ax"}), _sobel(g, "qty")
    return a.join(b, ["y", "x"]).select("y", "x", F.round(F.abs(F.col("ay") * F.col("sx") - F.col("ax") * F.col("sy")), 4).alias("value"))


@query(f"""WITH {DENSE}, q AS (SELECT y, x, v / 1000 AS a, coalesce(qty, 0) AS b FROM dn), d AS (SELECT y, x, {grad_sql('q', 'a', 'y', 'ay')}, {grad_sql('q', 'a', 'x', 'ax')}, {grad_sql('q', 'b', 'y', 'by_')}, {grad_sql('q', 'b', 'x', 'bx')} FROM q),
m AS (SELECT *, sqrt(ay * ay + ax * ax) AS ma, sqrt(by_ * by_ + bx * bx) AS mb FROM d) SELECT y, x, round((1 - abs(ay * bx - ax * by_) / (ma * mb)) * sqrt(ma * mb), 6) AS value FROM m WHERE ma * mb > 0""")
def c25_gradient_coalignment(spark, sf):
    d, _ = _dense(spark, sf, items=True)
    d = d.withColumn("a", F.col("v") / 1000).withColumn("b", F.coalesce("qty", F.lit(0.0)))
    for c in "ab":
        d = st.gradient(st.gradient(d, c, "y", f"{c}y"), c, "x", f"{c}x")
    d = d.withColumn("ma", F.sqrt(F.col("ay") * F.col("ay") + F.col("ax") * F.col("ax"))).withColumn("mb", F.sqrt(F.col("by") * F.col("by") + F.col("bx") * F.col("bx"))).where("ma * mb > 0")
    sine = F.abs(F.col("ay") * F.col("bx") - F.col("ax") * F.col("by")) / (F.col("ma") * F.col("mb"))
    return _out(d.withColumn("c", (1 - sine) * F.sqrt(F.col("ma") * F.col("mb"))), "c")


@query("SELECT a::INTEGER AS v, b::INTEGER AS u, (a * a)::INTEGER AS vv, (b * b)::INTEGER AS uu, (a * b)::INTEGER AS uv FROM range(-3, 4) r(a), range(-3, 4) s(b)")
def c27_moment_kernel(spark, sf):
    k = spark.range(1).select(F.explode(st.kernel_column([(a, b, 1.0) for a in range(-3, 4) for b in range(-3, 4)])).alias("k")).select(F.col("k.dy").alias("v"), F.col("k.dx").alias("u"))
    return k.select("v", "u", (F.col("v") * F.col("v")).alias("vv"), (F.col("u") * F.col("u")).alias("uu"), (F.col("v") * F.col("u")).alias("uv"))


@query(f"WITH {DENSE} SELECT d.y, d.x, n.v AS value FROM dn d JOIN dn n ON n.y = greatest(0, least(d.w - 1, d.y + 3)) AND n.x = greatest(0, least(d.w - 1, d.x - 2)) WHERE n.v IS NOT NULL")
def c34_clamped_shift(spark, sf):
    d, (h, w) = _dense(spark, sf)
    at = d.select(F.col("y").alias("oy"), F.col("x").alias("ox"), F.least(F.col("y") + 3, F.lit(h - 1)).alias("y"), F.greatest(F.col("x") - 2, F.lit(0)).alias("x"))
    return at.join(d.select("y", "x", F.col("v").alias("value")), ["y", "x"]).where("value IS NOT NULL").select(F.col("oy").alias("y"), F.col("ox").alias("x"), "value")


@query(f"WITH {GRID_SQL} SELECT c.y, c.x, n.v AS value FROM g c LEFT JOIN g n ON n.y = c.y - 3 AND n.x = c.x + 2")
def c35_dropping_shift(spark, sf):
    g = cells(spark, sf)
    return g.select("y", "x").join(st.shifted(g, -3, 2, "v", "value"), ["y", "x"], "left")


PAIRS = [(dy * k, dx * k) for k in (1, 3) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
PAIR_SQL = ", ".join(f"({y}, {x})" for y, x in PAIRS)


@query(f"WITH {GRID_SQL} SELECT a.y, a.x, max(least(a.qty, b.qty)) AS value FROM g a, (VALUES {PAIR_SQL}) k(dy, dx), g b WHERE b.y = a.y + k.dy AND b.x = a.x + k.dx AND a.qty IS NOT NULL AND b.qty IS NOT NULL GROUP BY a.y, a.x")
def c36_pair_offset(spark, sf):
    g = cells(spark, sf, items=True).where("qty IS NOT NULL")
    other = st.scatter(g.select("y", "x", F.col("qty").alias("b")), [(-y, -x, 1.0) for y, x in PAIRS])
    best = other.groupBy("y", "x").agg(F.max("b").alias("b"))  # the largest of least(a, b) is least(a, largest b)
    return g.join(best, ["y", "x"]).select("y", "x", F.least("qty", "b").alias("value"))


@query("SELECT a::INTEGER AS dy, b::INTEGER AS dx, round(greatest(0, 1 - sqrt(a*a + b*b) / 3), 6) AS w FROM range(-3, 4) r(a), range(-3, 4) s(b)")
def c38_triangular_kernel(spark, sf):
    k = [(a, b, max(0.0, 1 - math.hypot(a, b) / 3)) for a in range(-3, 4) for b in range(-3, 4)]
    return spark.range(1).select(F.explode(st.kernel_column(k)).alias("k")).select("k.dy", "k.dx", F.round("k.w", 6).alias("w"))


@query(f"""WITH {GRID_SQL}, k AS (SELECT a AS dy, b AS dx, 1 - sqrt(a*a + b*b) / 3 AS w FROM range(-2, 3) r(a), range(-2, 3) s(b)), q AS (SELECT y, x, p, v / 500000 AS pr FROM fp),
s AS (SELECT q.y + dy AS y, q.x + dx AS x, sum(k.w * pr) AS c FROM q, k GROUP BY ALL) SELECT q.y, q.x, CASE WHEN p = '1-URGENT' THEN 0 ELSE round(sqrt(pr * c), 6) END AS value FROM q JOIN s USING (y, x)""")
def c39_kernel_trace_score(spark, sf):
    q = footprint(spark, sf).select("y", "x", "p", (F.col("v") / 500000).alias("pr"))
    s = st.scatter(q.select("y", "x", "pr"), st.triangular()).groupBy("y", "x").agg(F.sum(F.col("w") * F.col("pr")).alias("c"))
    return q.join(s, ["y", "x"]).select("y", "x", F.when(F.col("p") == "1-URGENT", 0.0).otherwise(F.round(F.sqrt(F.col("pr") * F.col("c")), 6)).alias("value"))


LINE4 = ", ".join(f"({a}, {y}, {x})" for a, _, y, x in st.line_offsets(4, 2))


@query(f"SELECT a, dy, dx FROM (VALUES {LINE4}) k(a, dy, dx)")
def c40_line_kernels(spark, sf):
    k = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for a, _, y, x in st.line_offsets(4, 2)])
    return spark.range(1).select(F.explode(k).alias("k")).select("k.*")


@query(f"""WITH {GRID_SQL}, s AS (SELECT g.y - dy AS y, g.x - dx AS x, v AS wt, radians(2 * (cell_id * 37 % 180)) AS t FROM g, range(-2, 3) r(dy), range(-2, 3) q(dx))
SELECT y, x, round(1 - sqrt(sum(wt * cos(t)) ** 2 + sum(wt * sin(t)) ** 2) / sum(wt), 6) AS value FROM s GROUP BY y, x HAVING count(*) = 25""")
def c41_circular_dispersion(spark, sf):
    box = [(-a, -b, 1.0) for a in range(-2, 3) for b in range(-2, 3)]
    t = F.radians(2 * (F.col("cell_id") * 37 % 180))
    s = st.scatter(cells(spark, sf).select("y", "x", F.col("v").alias("wt"), (F.col("v") * F.cos(t)).alias("c"), (F.col("v") * F.sin(t)).alias("s")), box)
    s = s.groupBy("y", "x").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("wt").alias("t")).where("n = 25")
    return s.select("y", "x", F.round(1 - F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("t"), 6).alias("value"))


@query(f"WITH {GRID_SQL}, t AS (SELECT y, x FROM fp WHERE p = '1-URGENT'), n AS (SELECT t.y + a AS y, t.x + b AS x, count(*) AS n FROM t, range(-1, 2) r(a), range(-1, 2) s(b) WHERE a <> 0 OR b <> 0 GROUP BY ALL) SELECT coalesce(n.n, 0) AS neighbours, count(*) AS cells FROM t LEFT JOIN n USING (y, x) GROUP BY 1")
def c43_neighbour_profile(spark, sf):
    return st.neighbour_counts(truth(footprint(spark, sf))).groupBy("neighbours").agg(F.count("*").alias("cells"))


@query(f"""WITH {DENSE}, s AS (SELECT dn.y - dy AS y, dn.x - dx AS x, v / 1000 * wy AS a, v / 1000 * wx AS b FROM dn, (VALUES {SOB}) k(dy, dx, wy, wx) WHERE v IS NOT NULL),
m AS (SELECT y, x, sqrt(sum(a) ** 2 + sum(b) ** 2) AS m FROM s GROUP BY y, x HAVING count(*) = 9), e AS (SELECT dn.y, dn.x, dn.w, m.m FROM dn LEFT JOIN m USING (y, x)), {smooth_sql('e', 'm', 1.0, 's2')} SELECT y, x, round(s, 4) AS value FROM s2 WHERE s IS NOT NULL""")
def c44_smoothed_edges(spark, sf):
    d, n = _dense(spark, sf)
    e = _sobel(d.withColumn("a", F.col("v") / 1000), "a").select("y", "x", F.sqrt(F.col("sy") * F.col("sy") + F.col("sx") * F.col("sx")).alias("m"))
    e = d.select("y", "x").join(e, ["y", "x"], "left")
    return st.smoothed(e, "m", "s", 1.0, n).where("s IS NOT NULL").select("y", "x", F.round("s", 4).alias("value"))


@query(f"WITH {GRID_SQL}, q AS (SELECT median(v) AS m, greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 1e-6) AS i FROM g) SELECT cell_id, round(greatest(-8, least(8, (v - m) / i)), 6) AS value FROM g, q")
def e02_robust_z(spark, sf):
    return robust_z(cells(spark, sf), "v", "z").select("cell_id", F.round("z", 6).alias("value"))


@query(f"WITH {GRID_SQL}, q AS (SELECT quantile_cont(qty, 0.05) AS a, quantile_cont(qty, 0.95) AS b FROM g) SELECT cell_id, round(CASE WHEN qty IS NULL THEN NULL WHEN b <= a THEN 0 ELSE greatest(0, least(1, (qty - a) / (b - a))) END, 6) AS value FROM g, q")
def e05_quantile_scale(spark, sf):
    return quantile01(cells(spark, sf, items=True), "qty", "z", 0.05, 0.95).select("cell_id", F.round("z", 6).alias("value"))
