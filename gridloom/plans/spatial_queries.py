"""Vectors, fits, drainage and sinks over the order grid."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.operators import burn, flow, georef, ranks, solve
from gridloom.operators import similarity as sim
from gridloom.operators.distance import near, written
from gridloom.operators.stencil import dense
from gridloom.plans.distance_queries import D8
from gridloom.plans.registry import query
from gridloom.plans.select_queries import _registry
from gridloom.plans.stencil_queries import DENSE
from gridloom.sources import commits, vectors
from gridloom.sources.cells import GRID_SQL, cells, footprint, inside, prediction, spec, table, truth

#: Edges between suppliers of five nations that follow each other, scaled to the grid.
EDGES = """sp AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_acctbal + 1000) / 11000 * w AS py, (s_suppkey * 37 % 101 + 0.37) / 101 * w AS px FROM supplier, dims),
ed AS (SELECT a.py AS ay, a.px AS ax, b.py AS by_, b.px AS bx FROM sp a JOIN sp b ON b.k = a.k + 1 WHERE a.n < 5),
tc AS (SELECT DISTINCT dn.y, dn.x FROM dn, ed, (SELECT 1) WHERE
  greatest(0, least((dn.y - ay) / nullif(by_ - ay, 0), (dn.y + 1 - ay) / nullif(by_ - ay, 0)), least((dn.x - ax) / nullif(bx - ax, 0), (dn.x + 1 - ax) / nullif(bx - ax, 0)))
  <= least(1, greatest((dn.y - ay) / nullif(by_ - ay, 0), (dn.y + 1 - ay) / nullif(by_ - ay, 0)), greatest((dn.x - ax) / nullif(bx - ax, 0), (dn.x + 1 - ax) / nullif(bx - ax, 0))))"""


def _edges(spark, sf):
    w = spec(spark, sf).width
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"),
        ((F.col("s_acctbal") + 1000) / 11000 * w).alias("ay"), ((F.col("s_suppkey") * 37 % 101 + 0.37) / 101 * w).alias("ax"),
    )
    nxt = s.select((F.col("k") - 1).alias("k"), F.col("ay").alias("by"), F.col("ax").alias("bx"))
    return s.where("n < 5").join(nxt, "k"), (w, w)


@query(f"WITH {DENSE}, {EDGES} SELECT y, x FROM tc")
def a19_burned_edges(spark, sf):
    """Cells that the edges touch; the twin tests every cell against every edge."""
    e, n = _edges(spark, sf)
    return burn.touched(e, n)


@query(f"WITH {DENSE}, {EDGES} SELECT fp.cell_id, min((fp.y - tc.y) ** 2 + (fp.x - tc.x) ** 2)::BIGINT AS d2 FROM fp, tc GROUP BY fp.cell_id")
def a19_burn_distance(spark, sf):
    """Distance to the edges over a padded grid; too narrow a padding is an error."""
    e, n = _edges(spark, sf)
    pad = n[0]
    return burn.distance(footprint(spark, sf), burn.touched(e, n, padding=pad), n, pad).select("cell_id", "d2")


@query()
def g23_fit_georef(spark, sf):
    """The map from table points to the outline of the label cells that they were taken from."""
    n = (spec(spark, sf).width,) * 2
    fp = footprint(spark, sf)
    rim = fp.join(near(fp, dense(cells(spark, sf), *n).where(~inside(n[0])).select("y", "x"), 1).where("d2 IS NOT NULL").select("y", "x"), ["y", "x"], "left_semi")
    rim = written(rim.select("y", "x"))
    points = rim.select((F.col("x") / 40.0 - 118.0).alias("x"), (39.0 - F.col("y") / 50.0).alias("y"))
    (a, b, c, d), cost = georef.fit(points, rim, dense(cells(spark, sf), *n), n, levels=10)
    return rim.agg(F.count("*").alias("cells")).select("cells", *[F.lit(round(v, 1)).alias(k) for k, v in (("a", a), ("b", b), ("c", c), ("d", d))], F.lit(round(cost, 3)).alias("cost"))


@query()
def k45_bounded_rates(spark, sf):
    """A hit rate within [0, 1] for each distance bin, and a truth size, shared by all entries of the registry."""
    fp = footprint(spark, sf, items=True)
    reg = _registry(spark, sf)
    d = near(fp, truth(fp), 4).select("y", "x", F.coalesce(F.floor(F.sqrt("d2")), F.lit(5)).cast("int").alias("bin"))
    bins = [0, 1, 2, 3]
    counts = reg.join(d, ["y", "x"]).groupBy("entry").agg(F.count("*").alias("n"), *[F.count_if(F.col("bin") == b).alias(f"c{b}") for b in bins])
    rows = counts.join(sim.overlap(prediction(fp), reg).select("entry", F.col("forward").alias("score")), "entry")
    cols = [f"x{b}" for b in bins] + ["size"]
    rows = rows.select(*[(F.col(f"c{b}") / F.col("n")).alias(f"x{b}") for b in bins], (-0.8 * F.col("score") / F.col("n")).alias("size"), (0.2 * F.col("score")).alias("target"))
    got = solve.bounded_least_squares(rows, cols, "target", [0.0] * 4 + [-1e7], [1.0] * 4 + [0.0])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(got[c]).alias("value")) for c in cols]))
    return rows.agg(F.count("*").alias("entries")).select("entries", each.alias("e")).select("entries", "e.name", F.round("e.value", 6).alias("value"))


#: Down p1 .. p4, up by what drains through, as in the operator.
FLOW = f"""{D8}, wk AS (SELECT cell_id AS src, cell_id AS pos FROM fp UNION ALL SELECT wk.src, rc.receiver FROM wk JOIN rc ON rc.cell_id = wk.pos), ac AS (SELECT pos AS cell_id, count(*) AS acc FROM wk GROUP BY pos),
fo AS (SELECT fp.cell_id, fp.y::DOUBLE AS y, fp.x::DOUBLE AS x, coalesce(rc.receiver, fp.cell_id) AS p1, rc.receiver IS NOT NULL AS has, acc, coalesce(ns.s, 0) AS s FROM fp LEFT JOIN rc USING (cell_id) LEFT JOIN ns ON ns.cell_id = rc.cell_id AND ns.r = rc.receiver JOIN ac ON ac.cell_id = fp.cell_id),
f0 AS (SELECT *, ln(1 + acc) AS la, greatest(s, 1e-5) * pow(acc, 0.45) AS k FROM fo),
f1 AS (SELECT f0.*, coalesce(u.y, f0.y) AS y1, coalesce(u.x, f0.x) AS x1, coalesce(u.k, f0.k) AS k1 FROM f0 LEFT JOIN (SELECT p1 AS cell_id, sum(acc * y) / sum(acc) AS y, sum(acc * x) / sum(acc) AS x, sum(acc * k) / sum(acc) AS k FROM f0 WHERE has GROUP BY p1) u USING (cell_id)),
f2 AS (SELECT f1.*, coalesce(u.y, f1.y1) AS y2, coalesce(u.x, f1.x1) AS x2, coalesce(u.k, f1.k1) AS k2 FROM f1 LEFT JOIN (SELECT p1 AS cell_id, sum(acc * y1) / sum(acc) AS y, sum(acc * x1) / sum(acc) AS x, sum(acc * k1) / sum(acc) AS k FROM f1 WHERE has GROUP BY p1) u USING (cell_id)),
f3 AS (SELECT f2.*, coalesce(u.y, f2.y2) AS y3, coalesce(u.x, f2.x2) AS x3, coalesce(u.k, f2.k2) AS k3 FROM f2 LEFT JOIN (SELECT p1 AS cell_id, sum(acc * y2) / sum(acc) AS y, sum(acc * x2) / sum(acc) AS x, sum(acc * k2) / sum(acc) AS k FROM f2 WHERE has GROUP BY p1) u USING (cell_id)),
f4 AS (SELECT f3.*, coalesce(u.y, f3.y3) AS y4, coalesce(u.x, f3.x3) AS x4 FROM f3 LEFT JOIN (SELECT p1 AS cell_id, sum(acc * y3) / sum(acc) AS y, sum(acc * x3) / sum(acc) AS x FROM f3 WHERE has GROUP BY p1) u USING (cell_id)),
kn AS (SELECT f4.*, b.k AS d1, b.p1 AS p2, c.k AS d2, c.p1 AS p3, d.k AS d3, d.p1 AS p4 FROM f4 JOIN f4 b ON b.cell_id = f4.p1 JOIN f4 c ON c.cell_id = b.p1 JOIN f4 d ON d.cell_id = c.p1),
kk AS (SELECT *, CASE WHEN acc >= 4 THEN greatest(0, k - 0.5 * ((d1 + d2 + d3) / 3 + (k1 + k2 + k3) / 3)) ELSE 0 END AS knick FROM kn),
u1 AS (SELECT p1 AS cell_id, max(knick) AS m FROM kk WHERE has GROUP BY p1), u2 AS (SELECT kk.p1 AS cell_id, max(u1.m) AS m FROM u1 JOIN kk USING (cell_id) WHERE has GROUP BY kk.p1),
ch AS (SELECT kk.*, greatest(kk.knick, a.knick, b.knick, coalesce(u1.m, 0), coalesce(u2.m, 0)) AS reach, e.y - kk.y AS dy, e.x - kk.x AS dx, kk.y - kk.y4 AS uy, kk.x - kk.x4 AS ux
  FROM kk JOIN kk a ON a.cell_id = kk.p1 JOIN kk b ON b.cell_id = kk.p2 JOIN fo e ON e.cell_id = kk.p4 LEFT JOIN u1 ON u1.cell_id = kk.cell_id LEFT JOIN u2 ON u2.cell_id = kk.cell_id),
fl AS (SELECT cell_id, acc, la AS log_acc, knick, reach AS knick_reach, CASE WHEN acc >= 6 AND sqrt(dy * dy + dx * dx) > 0.5 AND sqrt(uy * uy + ux * ux) > 0.5 THEN (1 - least(1, greatest(-1, (dy * uy + dx * ux) / (sqrt(dy * dy + dx * dx) * sqrt(uy * uy + ux * ux))))) * la ELSE 0 END AS turn FROM ch)"""


@query(f"WITH RECURSIVE {GRID_SQL}, {FLOW} SELECT cell_id, acc, round(log_acc, 5) AS log_acc, round(knick, 3) AS knick, round(knick_reach, 3) AS knick_reach, round(turn, 5) AS turn FROM fl")
def d07_flow_channels(spark, sf):
    """Catchment, knickpoints, their reach and the turn of the thalweg."""
    got = flow.channels(footprint(spark, sf), "v", spec(spark, sf).width)
    return got.select("cell_id", "acc", F.round("log_acc", 5).alias("log_acc"), F.round("knick", 3).alias("knick"), F.round("knick_reach", 3).alias("knick_reach"), F.round("turn", 5).alias("turn"))


def _folder(spark, name):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"


@query(f"WITH {DENSE} SELECT y * w + x AS cell_id, CASE WHEN (2*y-w+1)*(2*y-w+1) + (2*x-w+1)*(2*x-w+1) <= (w-3)*(w-3) THEN coalesce(v, 0) / 1e6 ELSE 0 END AS v FROM dn")
def b02_two_phase_write(spark, sf):
    """The whole grid staged, checked for range, count and keys, committed, and read back."""
    w = spec(spark, sf).width
    d = dense(cells(spark, sf), w, w).select((F.col("y") * w + F.col("x")).alias("cell_id"), F.when(inside(w), F.coalesce("v", F.lit(0.0)) / 1e6).otherwise(0.0).alias("v"))
    path, n = _folder(spark, "staged"), w * w
    commits.write_staged(d, path, key="cell_id", value="v", low=0, high=1, nulls="refuse", rows=n, keys=n * (n - 1) // 2)
    return commits.read_staged(spark, path)


@query(f"WITH {GRID_SQL}, r AS (SELECT cell_id, percent_rank() OVER (ORDER BY v) AS a FROM fp), q AS (SELECT cell_id, percent_rank() OVER (ORDER BY qty) AS b FROM fp WHERE qty IS NOT NULL) SELECT cell_id, CAST(floor(a * 65534) AS INTEGER) AS a, CAST(coalesce(floor(b * 65534), 0) AS INTEGER) AS b FROM r LEFT JOIN q USING (cell_id)")
def b06_rank_stack_written(spark, sf):
    """The rank stack as a written table, read back."""
    fp = footprint(spark, sf, items=True)
    a, b = (ranks.percent_rank(fp, c, "r").select("cell_id", F.floor(F.col("r") * 65534).cast("int").alias(n)) for c, n in (("v", "a"), ("qty", "b")))
    stack = written(a.join(b, "cell_id", "left").select("cell_id", "a", F.coalesce("b", F.lit(0)).alias("b")))
    path = _folder(spark, "stack")
    commits.write_staged(stack, path, key="cell_id", value="a", low=0, high=65534, rows=stack.count())
    return commits.read_staged(spark, path)


@query(f"WITH {GRID_SQL} SELECT 'row-' || y AS name, count(*) AS points, round(sum(x), 4) AS sx, round(sum(v / 1000), 4) AS sy FROM fp WHERE p = '1-URGENT' GROUP BY y")
def a10_vector_files(spark, sf):
    """Each grid row's label cells as a polyline, in zipped vector files of twenty rows, read back by record."""
    fp = truth(footprint(spark, sf))
    points = F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), (F.col("v") / 1000).alias("y"))))  # one grid row
    lines = fp.groupBy("y").agg(points.alias("points")).select(F.format_string("lines-%05d", F.floor(F.col("y") / 20)).alias("file"), F.concat(F.lit("row-"), F.col("y")).alias("name"), "points")
    folder = _folder(spark, "shapes")
    written(vectors.write_shapes(lines, folder))
    got = vectors.read_shapes(spark, folder)
    total = lambda c: F.round(F.aggregate("points", F.lit(0.0), lambda s, p: s + p[c]), 4)
    return got.select(F.col("attributes")["name"].alias("name"), F.size("points").cast("long").alias("points"), total("x").alias("sx"), total("y").alias("sy"))


@query(f"WITH {GRID_SQL}, c AS (SELECT st, (max(y) + min(y)) / 2.0 AS cy, (max(x) + min(x)) / 2.0 AS cx, max(y) - min(y) + 1.0 AS h, max(x) - min(x) + 1.0 AS w2 FROM fp GROUP BY st), l AS (SELECT st, cx - w2 / 2 AS lk, 0.01 AS lm, cx + w2 / 2 AS rk, -0.02 AS rm, cy - h / 2 AS tk, 0.03 AS tm, cy + h / 2 AS bk, 0.0 AS bm FROM c), k AS (SELECT st, 0 AS corner, lm AS mv, lk AS kv, tm AS mh, tk AS kh FROM l UNION ALL SELECT st, 1, rm, rk, tm, tk FROM l UNION ALL SELECT st, 2, rm, rk, bm, bk FROM l UNION ALL SELECT st, 3, lm, lk, bm, bk FROM l) SELECT st, corner, round(mv * ((mh * kv + kh) / (1 - mh * mv)) + kv, 6) AS x, round((mh * kv + kh) / (1 - mh * mv), 6) AS y FROM k")
def e24_rect_corners(spark, sf):
    """Four corners of each group's frame from its two upright and two level lines."""
    half = lambda c: (F.max(c) + F.min(c)) / 2.0
    size = lambda c: F.max(c) - F.min(c) + 1.0
    c = footprint(spark, sf).groupBy("st").agg(half("y").alias("cy"), half("x").alias("cx"), size("y").alias("h"), size("x").alias("w"))
    left, right = (F.lit(0.01), F.col("cx") - F.col("w") / 2), (F.lit(-0.02), F.col("cx") + F.col("w") / 2)
    top, bottom = (F.lit(0.03), F.col("cy") - F.col("h") / 2), (F.lit(0.0), F.col("cy") + F.col("h") / 2)
    each = [F.struct(F.lit(i).alias("corner"), v[0].alias("mv"), v[1].alias("kv"), h[0].alias("mh"), h[1].alias("kh")) for i, (v, h) in enumerate(((left, top), (right, top), (right, bottom), (left, bottom)))]
    k = c.select("st", F.explode(F.array(*each)).alias("k")).select("st", "k.*")
    y = (F.col("mh") * F.col("kv") + F.col("kh")) / (1 - F.col("mh") * F.col("mv"))
    return k.select("st", "corner", F.round(F.col("mv") * y + F.col("kv"), 6).alias("x"), F.round(y, 6).alias("y"))

