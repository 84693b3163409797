"""Composite surfaces: projections and products of the smaller operators over the order grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.scalar import clip, quantile01
from gridloom.functions.scalar import expit as _expit
from gridloom.operators import stencil as st
from gridloom.operators.distance import apart, near
from gridloom.operators.metric import credit
from gridloom.plans.registry import query
from gridloom.plans.select_queries import _hash
from gridloom.plans.stencil_queries import DENSE, grad_sql, smooth_sql
from gridloom.sources.cells import GRID_SQL, cells, footprint, spec, truth
from gridloom.functions.scalar import hashed


def norm_sql(col: str, out: str, lo: float = 0.02, hi: float = 0.98, src: str = "g") -> str:
    return f"(SELECT cell_id, greatest(0, least(1, ({col} - a) / (b - a))) AS {out} FROM {src}, (SELECT quantile_cont({col}, {lo}) AS a, quantile_cont({col}, {hi}) AS b FROM {src}) WHERE {col} IS NOT NULL)"


def _norm(df, col, out):
    return quantile01(df.where(F.col(col).isNotNull()), col, out, 0.02, 0.98)


def _r(df, col="s"):
    return df.select("cell_id", F.round(col, 6).alias("value"))


@query(f"WITH {GRID_SQL}, a AS {norm_sql('v', 'nv')}, b AS {norm_sql('qty', 'nq')} SELECT cell_id, round(nv * nq * (1 - disc), 6) AS value FROM g JOIN a USING (cell_id) JOIN b USING (cell_id)")
def f02_product_surface(spark, sf):
    """Product of normalised layers and a penalty."""
    g = cells(spark, sf, items=True)
    s = _norm(g, "v", "nv").join(_norm(g, "qty", "nq").select("cell_id", "nq"), "cell_id")
    return _r(s.withColumn("s", F.col("nv") * F.col("nq") * (1 - F.col("disc"))))


@query(f"WITH {DENSE}, {smooth_sql('dn', 'qty', 2.0, 's')}, h AS (SELECT cell_id, s.s, dn.qty, dn.disc FROM dn JOIN s USING (y, x)) SELECT cell_id, round((1 - exp(-greatest(0, s - qty) / 10)) * (0.5 + 0.5 * disc), 6) AS value FROM h WHERE s IS NOT NULL")
def f13_trough_surface(spark, sf):
    w = spec(spark, sf).width
    d = st.dense(cells(spark, sf, items=True), w, w)
    s = st.smoothed(d, "qty", "sm", 2.0, (w, w)).where("sm IS NOT NULL")
    return _r(s.withColumn("s", -F.expm1(-F.greatest(F.lit(0.0), F.col("sm") - F.col("qty")) / 10) * (0.5 + 0.5 * F.col("disc"))))


@query()
def f14_toroidal_null(spark, sf):
    """Agreement of two axial layers against hashed toroidal shifts: coherence, null mean, rank."""
    w = spec(spark, sf).width
    g = cells(spark, sf).select("y", "x", F.radians(2 * (F.col("cell_id") * 37 % 180)).alias("a"), F.radians(2 * (F.col("cell_id") * 53 % 180)).alias("b"))
    shifts = spark.range(20).select("id", F.when(F.col("id") == 0, 0).otherwise(hashed(F.lit(29), "id") % w).alias("sy"), F.when(F.col("id") == 0, 0).otherwise(hashed(F.lit(31), "id") % w).alias("sx"))
    moved = g.select("y", "x", "b").join(F.broadcast(shifts)).select("id", F.pmod(F.col("y") + F.col("sy"), F.lit(w)).alias("y"), F.pmod(F.col("x") + F.col("sx"), F.lit(w)).alias("x"), "b")
    one = moved.join(g.select("y", "x", "a"), ["y", "x"]).groupBy("id").agg(F.avg(F.cos(F.col("a") - F.col("b"))).alias("c"))
    seen = F.max(F.when(F.col("id") == 0, F.col("c")))
    return one.agg(F.round(seen, 6).alias("observed"), F.round(F.avg(F.when(F.col("id") > 0, F.col("c"))), 6).alias("null_mean"), F.count("*").alias("draws"))


@query(f"WITH {DENSE}, q AS (SELECT y, x, v / 1000 AS a FROM dn), m AS (SELECT y, x, sqrt(gy * gy + gx * gx) AS gm FROM (SELECT y, x, {grad_sql('q', 'a', 'y', 'gy')}, {grad_sql('q', 'a', 'x', 'gx')} FROM q)), t AS (SELECT dn.cell_id, abs(atan2(dn.qty, gm)) AS tilt, dn.disc FROM dn JOIN m USING (y, x) WHERE gm IS NOT NULL AND dn.qty IS NOT NULL), p AS (SELECT quantile_cont(tilt, 0.95) AS p95 FROM t) SELECT cell_id, round(least(1, tilt / p95) * exp(-disc / 5), 6) AS value FROM t, p")
def f17_tilt_surface(spark, sf):
    w = spec(spark, sf).width
    d = st.dense(cells(spark, sf, items=True), w, w).withColumn("a", F.col("v") / 1000)
    t = st.gradient_magnitude(d, "a", "gm").where("gm IS NOT NULL AND qty IS NOT NULL").withColumn("tilt", F.abs(F.atan2("qty", "gm")))
    p = t.agg(F.percentile("tilt", 0.95).alias("p95"))
    return _r(t.join(F.broadcast(p)).withColumn("s", F.least(F.lit(1.0), F.col("tilt") / F.col("p95")) * F.exp(-F.col("disc") / 5)))


@query(f"WITH {GRID_SQL}, t AS (SELECT y + a AS y, x + b AS x, min(a*a + b*b) AS d2 FROM fp, range(-12, 13) r(a), range(-12, 13) q(b) WHERE p = '1-URGENT' AND a*a + b*b <= 144 GROUP BY ALL), n AS {norm_sql('v', 'nv')} SELECT cell_id, round(0.6 * coalesce(exp(-sqrt(d2) / 4), 0) + 0.4 * nv, 6) AS value FROM fp JOIN n USING (cell_id) LEFT JOIN t USING (y, x)")
def f18_source_decay_surface(spark, sf):
    """Decay with distance to sources, blended with a normalised layer."""
    fp = footprint(spark, sf)
    d = near(fp, truth(fp), 12)
    n = _norm(cells(spark, sf), "v", "nv").select("cell_id", "nv")
    return _r(d.join(n, "cell_id").withColumn("s", 0.6 * F.coalesce(F.exp(-F.sqrt("d2") / 4), F.lit(0.0)) + 0.4 * F.col("nv")))


@query(f"WITH {GRID_SQL}, k AS (SELECT a AS dy, b AS dx, 1 - sqrt(a*a + b*b) / 3 AS w FROM range(-2, 3) r(a), range(-2, 3) s(b)), c1 AS (SELECT y + dy AS y, x + dx AS x, max(k.w) AS a FROM fp, k WHERE p = '2-HIGH' GROUP BY ALL), c2 AS (SELECT y + dy AS y, x + dx AS x, max(k.w * v / 500000) AS b FROM fp, k WHERE p = '3-MEDIUM' GROUP BY ALL) SELECT cell_id, round(greatest(coalesce(a, 0), coalesce(b, 0)), 6) AS value FROM fp LEFT JOIN c1 USING (y, x) LEFT JOIN c2 USING (y, x)")
def f23_credit_surface(spark, sf):
    """The larger of two credits, one weighted."""
    fp = footprint(spark, sf)
    a = credit(fp.where("p = '2-HIGH'")).withColumnRenamed("w", "a")
    b = st.scatter(fp.where("p = '3-MEDIUM'").select("y", "x", "v"), st.triangular()).groupBy("y", "x").agg(F.max(F.col("w") * F.col("v") / 500000).alias("b"))
    z = F.lit(0.0)
    return _r(fp.join(a, ["y", "x"], "left").join(b, ["y", "x"], "left").withColumn("s", F.greatest(F.coalesce("a", z), F.coalesce("b", z))))


@query(f"WITH {GRID_SQL}, far AS (SELECT fp.* FROM fp ANTI JOIN (SELECT DISTINCT y + a AS y, x + b AS x FROM fp, range(-2, 3) r(a), range(-2, 3) q(b) WHERE p = '1-URGENT' AND a*a + b*b <= 4) d USING (y, x)) SELECT cell_id, round(0.72 * v / 500000 + 0.28 * coalesce(disc, 0), 6) AS value FROM far")
def f29_ranking_surface(spark, sf):
    """A weighted surface off the labels, for ranking against a registry."""
    fp = footprint(spark, sf, items=True)
    return _r(apart(fp, truth(fp), 2).withColumn("s", 0.72 * F.col("v") / 500000 + 0.28 * F.coalesce("disc", F.lit(0.0))))


@query(f"WITH {GRID_SQL} SELECT cell_id, round(greatest(0.05, least(1, 1 / (1 + exp(-(qty - 100) / 50)) * (1 - disc) * CASE WHEN v > 100000 THEN 1 ELSE 0.5 END)), 6) AS value FROM g WHERE qty IS NOT NULL")
def f12_factor_product(spark, sf):
    g = cells(spark, sf, items=True).where("qty IS NOT NULL")
    s = _expit((F.col("qty") - 100) / 50) * (1 - F.col("disc")) * F.when(F.col("v") > 100000, 1.0).otherwise(0.5)
    return _r(g.withColumn("s", clip(s, 0.05, 1.0)))
