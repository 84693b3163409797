"""Distances, components, drainage over the order grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import distance as ds
from gridloom.operators.stencil import dense, disc
from gridloom.plans.metric_queries import COMPS
from gridloom.plans.registry import query
from gridloom.plans.stencil_queries import DENSE
from gridloom.sources.cells import GRID_SQL, cells, footprint, spec, truth

RGRID = f"WITH RECURSIVE {GRID_SQL}"


@query(f"WITH {DENSE}, s AS (SELECT y, x FROM fp WHERE p = '1-URGENT') SELECT d.y, d.x, min((d.y - s.y) * (d.y - s.y) + (d.x - s.x) * (d.x - s.x)) AS d2 FROM dn d, s GROUP BY ALL")
def d01_distance_transform(spark, sf):
    """Exact distance to the nearest seed anywhere, in two passes."""
    w = spec(spark, sf).width
    seeds = truth(footprint(spark, sf))
    return ds.transform(dense(cells(spark, sf), w, w), seeds).select("y", "x", "d2")


@query(f"WITH {GRID_SQL}, s AS (SELECT y + a AS y, x + b AS x, min(a*a + b*b) AS d2 FROM fp, range(-9, 10) r(a), range(-9, 10) q(b) WHERE p = '1-URGENT' AND a*a + b*b <= 81 GROUP BY ALL) SELECT g.cell_id, s.d2 FROM g LEFT JOIN s USING (y, x)")
def d01_distance_within(spark, sf):
    seeds = truth(footprint(spark, sf))
    return ds.near(cells(spark, sf), seeds, 9).select("cell_id", F.col("d2").cast("long").alias("d2"))


@query(f"""WITH {GRID_SQL}, h AS (SELECT g.y + a AS y, g.x + b AS x, g.qty, a*a + b*b AS d2, g.y AS sy, g.x AS sx FROM g, range(-4, 5) r(a), range(-4, 5) q(b) WHERE qty IS NOT NULL AND a*a + b*b <= 16),
f AS (SELECT y, x, arg_min(qty, (d2, sy, sx)) AS fill FROM h GROUP BY y, x) SELECT cell_id, coalesce(qty, fill) AS value FROM g LEFT JOIN f USING (y, x)""")
def d02_nearest_fill(spark, sf):
    return ds.nearest_fill(cells(spark, sf, items=True), "qty", "value", 4).select("cell_id", "value")


@query(f"{RGRID}, {COMPS} SELECT c AS cell_id, comp FROM comp")
def d03_components(spark, sf):
    w = spec(spark, sf).width
    return ds.components(truth(footprint(spark, sf)), w).select((F.col("y") * w + F.col("x")).alias("cell_id"), "comp")


@query(f"{RGRID}, {COMPS} SELECT y // 20 AS block, count(DISTINCT comp) AS components FROM comp GROUP BY 1")
def d04_components_per_block(spark, sf):
    got = ds.components(truth(footprint(spark, sf)), spec(spark, sf).width)
    return got.groupBy(F.floor(F.col("y") / 20).alias("block")).agg(F.count_distinct("comp").alias("components"))


@query(f"WITH {GRID_SQL} SELECT fp.cell_id FROM fp, range(-2, 3) r(a), range(-2, 3) q(b), g n WHERE n.y = fp.y + a AND n.x = fp.x + b AND n.qty IS NOT NULL GROUP BY fp.cell_id HAVING count(*) = 25")
def d05_supported_cells(spark, sf):
    box = [(a, b, 1.0) for a in range(-2, 3) for b in range(-2, 3)]
    return ds.eroded(footprint(spark, sf), cells(spark, sf, items=True).where("qty IS NOT NULL"), box).select("cell_id")


@query(f"WITH {GRID_SQL} SELECT fp.cell_id FROM fp, range(-3, 4) r(a), range(-3, 4) q(b), g n WHERE a*a + b*b <= 9 AND n.y = fp.y + a AND n.x = fp.x + b AND n.qty IS NOT NULL GROUP BY fp.cell_id HAVING count(*) = 29")
def d06_support_margin(spark, sf):
    """Cells farther than 3 from any invalid cell."""
    return ds.eroded(footprint(spark, sf), cells(spark, sf, items=True).where("qty IS NOT NULL"), disc(3)).select("cell_id")


D8 = """ns AS (SELECT a.cell_id, b.cell_id AS r, (a.v - b.v) / sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS s FROM fp a, range(-1, 2) p(i), range(-1, 2) q(j), fp b WHERE b.y = a.y + i AND b.x = a.x + j AND b.v < a.v),
rc AS (SELECT cell_id, arg_max(r, (s, -r)) AS receiver FROM ns GROUP BY cell_id)"""


@query(f"WITH {GRID_SQL}, {D8} SELECT fp.cell_id, rc.receiver FROM fp LEFT JOIN rc USING (cell_id)")
def d07_receivers(spark, sf):
    return ds.d8(footprint(spark, sf), "v", spec(spark, sf).width)


@query(f"{RGRID}, {D8}, up AS (SELECT cell_id AS src, cell_id AS pos FROM fp UNION ALL SELECT up.src, rc.receiver FROM up JOIN rc ON rc.cell_id = up.pos) SELECT pos AS cell_id, count(*) AS acc FROM up GROUP BY pos")
def d07_flow_accumulation(spark, sf):
    return ds.accumulation(ds.d8(footprint(spark, sf), "v", spec(spark, sf).width))


@query(f"""WITH {GRID_SQL}, a AS (SELECT y, x, CASE WHEN qty IS NULL THEN NULL ELSE p END AS lab FROM g), h AS (SELECT a.y + i AS y, a.x + j AS x, lab, i*i + j*j AS d2, a.y AS sy, a.x AS sx FROM a, range(-4, 5) r(i), range(-4, 5) q(j) WHERE lab IS NOT NULL AND i*i + j*j <= 16),
f AS (SELECT y, x, arg_min(lab, (d2, sy, sx)) AS fill FROM h GROUP BY y, x) SELECT a.y, a.x, coalesce(lab, fill) AS label FROM a LEFT JOIN f USING (y, x)""")
def d08_fill_labels(spark, sf):
    a = cells(spark, sf, items=True).select("y", "x", F.when(F.col("qty").isNotNull(), F.col("p")).alias("lab"))
    return ds.nearest_fill(a, "lab", "label", 4).select("y", "x", "label")


FREE = "SELECT cell_id FROM fp ANTI JOIN (SELECT DISTINCT y + a AS y, x + b AS x FROM fp, range(-3, 4) r(a), range(-3, 4) q(b) WHERE p = '{p}' AND st = 'O' AND a*a + b*b <= 9) d USING (y, x)"


@query(f"WITH {GRID_SQL} {FREE.format(p='2-HIGH')}")
def d09_free_cells(spark, sf):
    fp = footprint(spark, sf)
    return ds.apart(fp, fp.where("p = '2-HIGH' AND st = 'O'"), 3).select("cell_id")


@query(f"WITH {GRID_SQL}, i AS (SELECT fp.cell_id, fp.y, fp.x FROM fp, range(-3, 4) r(a), range(-3, 4) q(b), fp n WHERE a*a + b*b <= 9 AND n.y = fp.y + a AND n.x = fp.x + b GROUP BY ALL HAVING count(*) = 29) SELECT cell_id FROM i ANTI JOIN (SELECT DISTINCT y + a AS y, x + b AS x FROM fp, range(-3, 4) r(a), range(-3, 4) q(b) WHERE cell_id % 25 = 2 AND a*a + b*b <= 9) d USING (y, x)")
def d10_interior_off_lattice(spark, sf):
    fp = footprint(spark, sf)
    inner = ds.eroded(fp, fp, disc(3))
    return ds.apart(inner, fp.where("cell_id % 25 = 2"), 3).select("cell_id")
