"""Operators that build on others: ridges, troughs, Euler windows, fold emission, budgets, feeds."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalar import clip, expit, logit, quantile01, robust_z
from gridloom.operators import emit, folds, metric, ranks, rules
from gridloom.operators import similarity as sim
from gridloom.operators import stencil as st
from gridloom.operators.distance import apart, d8, nearest_fill, written
from gridloom.plans.metric_queries import HEAD, SUMS
from gridloom.plans.registry import query
from gridloom.plans.select_queries import OVER, REG, _hash, _registry
from gridloom.plans.stencil_queries import DENSE, grad_sql, mag_sql, smooth_sql
from gridloom.sources.cells import GRID_SQL, cells, footprint, prediction, spec, table, truth


def _dense(spark, sf):
    w = spec(spark, sf).width
    return st.dense(cells(spark, sf, items=True), w, w), (w, w)


def _out(df, value):
    return df.where(F.col(value).isNotNull()).select("y", "x", F.round(value, 6).alias("value"))


@query("SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status FROM orders")
def a05_open_stack(spark, sf):
    """A columnar stack read through a schema that was stored as JSON beside it."""
    from pyspark.sql.types import StructType

    kept = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").schema.json()
    df = spark.read.schema(StructType.fromJson(json.loads(kept))).parquet(f"{sf}/orders.parquet")
    return df.toDF("id", "price", "status")


@query(f"WITH {GRID_SQL} SELECT g.cell_id, qty, disc FROM g SEMI JOIN (SELECT cell_id FROM fp WHERE p = '2-HIGH') s USING (cell_id)")
def a07_assemble_rows(spark, sf):
    g = cells(spark, sf, items=True).select("cell_id", "qty", "disc")
    return g.join(footprint(spark, sf).where("p = '2-HIGH'").select("cell_id"), "cell_id", "left_semi")


@query("WITH p AS (SELECT c_custkey, c_acctbal / 100 AS px, c_nationkey AS py FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey, CAST(floor((px - (-10)) / 2) AS BIGINT) AS x, CAST(floor(py / 2) AS BIGINT) AS y FROM p WHERE px > 0")
def a11_points_to_cells(spark, sf):
    """Points snapped to cells; the forbidden column is never selected."""
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    return c.select("c_custkey", F.floor((F.col("c_acctbal") / 100 + 10) / 2).alias("x"), F.floor(F.col("c_nationkey") / 2).alias("y"))


@query("SELECT c_nationkey AS y, CAST(floor(c_acctbal / 1000) AS BIGINT) AS x, round(sum(CASE c_mktsegment WHEN 'BUILDING' THEN 2.0 WHEN 'MACHINERY' THEN 1.5 ELSE 1.0 END), 6) AS weight FROM customer GROUP BY 1, 2")
def a12_weighted_impulses(spark, sf):
    w = F.when(F.col("c_mktsegment") == "BUILDING", 2.0).when(F.col("c_mktsegment") == "MACHINERY", 1.5).otherwise(1.0)
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("y"), F.floor(F.col("c_acctbal") / 1000).alias("x")).agg(F.round(F.sum(w), 6).alias("weight"))


@query("SELECT p_partkey, try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS n FROM part WHERE try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) IS NOT NULL")
def a13_skip_malformed(spark, sf):
    n = F.regexp_replace("p_brand", "[^0-9]", "").try_cast("int")
    return table(spark, sf, "part").select("p_partkey", n.alias("n")).where("n IS NOT NULL")


@query("SELECT 'n' || n_nationkey || '/' || n_name AS path, n_regionkey AS size, md5(n_name) AS sha FROM nation WHERE regexp_matches(n_name, '^[A-Za-z0-9_ ]+$')")
def a23_inventory(spark, sf):
    """A nested listing exploded to rows; rows of a bad shape are left out."""
    # one listing for each region, each exploded where it is
    tree = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.concat(F.lit("n"), "n_nationkey", F.lit("/"), "n_name").alias("path"), F.col("n_regionkey").alias("size"), F.md5(F.col("n_name").cast("binary")).alias("sha"), "n_name")).alias("tree"))
    e = tree.select(F.explode("tree").alias("t")).select("t.*")
    return e.where(F.col("n_name").rlike("^[A-Za-z0-9_ ]+$") & rules.is_hash(F.col("sha"), 32)).select("path", "size", "sha")


@query()
def b04_dump_json(spark, sf):
    """Receipts as JSON rows."""
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct("*")).alias("json"))


@query(f"WITH {DENSE}, z AS (SELECT y, x, w, qty FROM dn), {smooth_sql('z', 'qty', 1.0, 's')}, {mag_sql('s', 's', 'm')} SELECT dn.cell_id, round(dn.v / 1000, 6) AS price, round(s.s, 6) AS smooth, round(m.m, 6) AS slope FROM dn JOIN s USING (y, x) JOIN m USING (y, x) WHERE dn.cell_id IS NOT NULL")
def b07_prepared_stack(spark, sf):
    """A wide stack: a band, its smooth form and its slope, by one chain of windows."""
    d, n = _dense(spark, sf)
    s = st.gradient_magnitude(st.smoothed(d, "qty", "s", 1.0, n), "s", "m").where("cell_id IS NOT NULL")
    return s.select("cell_id", F.round(F.col("v") / 1000, 6).alias("price"), F.round("s", 6).alias("smooth"), F.round("m", 6).alias("slope"))


TROUGH = [(dy, dx) for dy, dx in ((0, 3), (3, 0), (2, 2), (2, -2))]


@query(f"""WITH {DENSE}, q AS (SELECT y, x, w, coalesce(qty, 0) AS a FROM dn), t AS (SELECT c.y, c.x, k.dy, k.dx, least(p.a, m.a) - c.a AS r FROM q c, (VALUES (0, 3), (3, 0), (2, 2), (2, -2)) k(dy, dx), q p, q m
WHERE p.y = greatest(0, least(c.w - 1, c.y + k.dy)) AND p.x = greatest(0, least(c.w - 1, c.x + k.dx)) AND m.y = greatest(0, least(c.w - 1, c.y - k.dy)) AND m.x = greatest(0, least(c.w - 1, c.x - k.dx))) SELECT y, x, round(1 - exp(-greatest(0, max(r)) / 50), 6) AS value FROM t GROUP BY y, x""")
def c11_paired_trough(spark, sf):
    """The lower shoulder less the centre, best of four directions, saturating."""
    d, (h, w) = _dense(spark, sf)
    q = d.select("y", "x", F.coalesce("qty", F.lit(0.0)).alias("a"))
    lim = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    k = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s * dy).alias("dy"), F.lit(s * dx).alias("dx")) for i, (dy, dx) in enumerate(TROUGH) for s in (1, -1)])
    at = q.select(F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("a").alias("c"), F.explode(k).alias("k"))
    at = at.select("oy", "ox", "c", "k.i", lim(F.col("oy") + F.col("k.dy"), h).alias("y"), lim(F.col("ox") + F.col("k.dx"), w).alias("x"))
    both = at.join(q, ["y", "x"]).groupBy("oy", "ox", "i").agg((F.min("a") - F.first("c")).alias("r")).groupBy("oy", "ox").agg(F.max("r").alias("r"))
    return both.select(F.col("oy").alias("y"), F.col("ox").alias("x"), F.round(-F.expm1(-st.at_least(F.col("r")) / 50), 6).alias("value"))


@query()
def c13_ridge_nms(spark, sf):
    d, n = _dense(spark, sf)
    return st.ridges(d, "qty", 1.0, n).select("y", "x", "qty")


@query(f"""WITH {DENSE}, q AS (SELECT y, x, w, coalesce(qty, 0) AS a FROM dn), gr AS (SELECT y, x, w, {grad_sql('q', 'a', 'y', 'gy')}, {grad_sql('q', 'a', 'x', 'gx')} FROM q),
p AS (SELECT y, x, w, gy * gy AS yy, gx * gx AS xx, gy * gx AS xy FROM gr), {smooth_sql('p', 'yy', 1.0, 'a1')}, {smooth_sql('p', 'xx', 1.0, 'a2')}, {smooth_sql('p', 'xy', 1.0, 'a3')}
SELECT y, x, round(sqrt((a1.s - a2.s) * (a1.s - a2.s) + 4 * a3.s * a3.s) / (a1.s + a2.s), 6) AS value FROM a1 JOIN a2 USING (y, x) JOIN a3 USING (y, x) WHERE a1.s + a2.s > 1e-9""")
def c16_structure_tensor(spark, sf):
    """Coherence of the smoothed structure tensor."""
    d, n = _dense(spark, sf)
    d = d.select("y", "x", F.coalesce("qty", F.lit(0.0)).alias("a"))
    d = st.gradient(st.gradient(d, "a", "y", "gy"), "a", "x", "gx")
    d = d.withColumns({"yy": F.col("gy") * F.col("gy"), "xx": F.col("gx") * F.col("gx"), "xy": F.col("gy") * F.col("gx")})
    for c in ("yy", "xx", "xy"):
        d = st.smoothed(d, c, f"s{c}", 1.0, n)
    gap, sum_ = F.col("syy") - F.col("sxx"), F.col("syy") + F.col("sxx")
    return _out(d.where("syy + sxx > 1e-9").withColumn("c", F.sqrt(gap * gap + 4 * F.col("sxy") * F.col("sxy")) / sum_), "c")


@query(f"""WITH {DENSE}, {smooth_sql('dn', 'qty', 1.0, 's')}, {mag_sql('s', 's', 'm1')}, {smooth_sql('dn', 'qty', 2.0, 't')}, {mag_sql('t', 's', 'm2')}
SELECT m1.y, m1.x, round(greatest(m1.m, m2.m), 6) AS best, CASE WHEN m1.m >= m2.m THEN 1 ELSE 2 END AS sigma FROM m1 JOIN m2 USING (y, x) WHERE m1.m IS NOT NULL AND m2.m IS NOT NULL""")
def c37_multiscale_edges(spark, sf):
    d, n = _dense(spark, sf)
    a = st.gradient_magnitude(st.smoothed(d, "qty", "s", 1.0, n), "s", "a")
    b = st.gradient_magnitude(st.smoothed(a, "qty", "t", 2.0, n), "t", "b").where("a IS NOT NULL AND b IS NOT NULL")
    return b.select("y", "x", F.round(F.greatest("a", "b"), 6).alias("best"), F.when(F.col("a") >= F.col("b"), 1).otherwise(2).alias("sigma"))


@query(f"WITH {GRID_SQL}, b AS (SELECT avg(v) AS mv, avg(disc) AS md, covar_pop(v, disc) / (var_pop(disc) + 0.01) AS k FROM g WHERE disc IS NOT NULL), r AS (SELECT cell_id, round(v - mv - k * (disc - md), 6) AS e FROM g, b WHERE disc IS NOT NULL) SELECT cell_id, round((row_number() OVER (ORDER BY e, cell_id) - 0.5) / count(*) OVER (), 6) AS value FROM r")
def e14_residual_rank(spark, sf):
    """Rank of what ridge on one nuisance leaves, from sums alone."""
    g = cells(spark, sf, items=True).where("disc IS NOT NULL")
    b = g.agg(F.avg("v").alias("mv"), F.avg("disc").alias("md"), (F.covar_pop("v", "disc") / (F.var_pop("disc") + 0.01)).alias("k"))
    r = g.join(F.broadcast(b)).withColumn("e", F.round(F.col("v") - F.col("mv") - F.col("k") * (F.col("disc") - F.col("md")), 6))
    return ranks.numbered(r, "e", "cell_id", "i", "n").select("cell_id", F.round((F.col("i") - 0.5) / F.col("n"), 6).alias("value"))


@query(f"WITH {GRID_SQL}, a AS (SELECT cell_id, (v - q.a) / (q.b - q.a) AS s, (cell_id * 37 % 256) / 255.0 AS u FROM fp, (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM fp) q) SELECT cell_id, round(greatest(0, least(1, s)) - u, 6) AS value FROM a")
def e26_scaled_difference(spark, sf):
    s = quantile01(footprint(spark, sf), "v", "s", 0.01, 0.99)
    return s.select("cell_id", F.round(F.col("s") - (F.col("cell_id") * 37 % 256) / 255.0, 6).alias("value"))


@query(f"WITH {GRID_SQL}, z AS (SELECT cell_id, disc, greatest(-8, least(8, (qty - m) / i)) AS z FROM g, (SELECT median(qty) AS m, greatest(quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25), 1e-6) AS i FROM g) WHERE qty IS NOT NULL) SELECT cell_id, round(z * ln(1 + disc), 6) AS interaction, round(ln(1 + abs(z)), 6) AS damped FROM z")
def e30_interaction_channels(spark, sf):
    z = robust_z(cells(spark, sf, items=True), "qty", "z").where("qty IS NOT NULL")
    return z.select("cell_id", F.round(F.col("z") * F.log1p("disc"), 6).alias("interaction"), F.round(F.log1p(F.abs("z")), 6).alias("damped"))


@query(f"WITH {GRID_SQL}, a AS (SELECT cell_id, v, percent_rank() OVER (ORDER BY v) AS r FROM fp WHERE p = '1-URGENT'), b AS (SELECT quantile_cont(v, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM fp WHERE p = '5-LOW') SELECT cell_id, round(least(v, q[CAST(least(floor(r * 4), 3) AS INTEGER) + 1] + (r * 4 - least(floor(r * 4), 3)) * (q[CAST(least(floor(r * 4), 3) AS INTEGER) + 2] - q[CAST(least(floor(r * 4), 3) AS INTEGER) + 1])), 4) AS value FROM a, b")
def e31_quantile_map(spark, sf):
    """One class mapped onto another's quantiles, downward only."""
    fp = footprint(spark, sf)
    q = fp.where("p = '5-LOW'").agg(F.percentile("v", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q"))
    a = ranks.percent_rank(truth(fp), "v", "r").withColumn("r", F.col("r") * 4).join(F.broadcast(q))
    i = F.least(F.floor("r"), F.lit(3)).cast("int")
    to = F.get("q", i) + (F.col("r") - i) * (F.get("q", i + 1) - F.get("q", i))
    return a.select("cell_id", F.round(F.least("v", to), 4).alias("value"))


@query(f"WITH {GRID_SQL}, p AS (SELECT cell_id, v / 500000 AS a FROM fp), s AS (SELECT cell_id, ln(greatest(1e-6, least(1 - 1e-6, a)) / (1 - greatest(1e-6, least(1 - 1e-6, a)))) AS l FROM p), m AS (SELECT median(l) AS m FROM s) SELECT cell_id, round(greatest(-14, least(14, l - m)), 6) AS value FROM s, m")
def k28_logit_debias(spark, sf):
    s = footprint(spark, sf).select("cell_id", logit(F.col("v") / 500000).alias("l"))
    return s.join(F.broadcast(s.agg(F.median("l").alias("m")))).select("cell_id", F.round(clip(F.col("l") - F.col("m"), -14.0, 14.0), 6).alias("value"))


@query(f"{HEAD}, o AS (SELECT cell_id, fold, row_number() OVER (PARTITION BY fold ORDER BY v DESC, cell_id) AS i, count(*) OVER (PARTITION BY fold) AS n FROM f) SELECT cell_id, fold FROM o WHERE i <= floor(0.02 * n)")
def i11_emit_by_fold(spark, sf):
    """Each fold's best share by rank."""
    f = folds.quadrants(footprint(spark, sf))
    o = f.withColumn("i", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("v"), "cell_id"))).withColumn("n", F.count("*").over(Window.partitionBy("fold")))
    return o.where(F.col("i") <= F.floor(0.02 * F.col("n"))).select("cell_id", "fold")


@query(f"""{HEAD}, o AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY v DESC, cell_id) AS i, count(*) OVER (PARTITION BY fold) AS n FROM f), t AS (SELECT y, x, fold FROM f WHERE p = '1-URGENT'), pr AS (SELECT y, x, fold FROM o WHERE i <= floor(0.02 * n)),
tp AS (SELECT t.y, t.x, t.fold, coalesce(max(h.w), 0) AS c FROM t LEFT JOIN (SELECT pr.y + k.dy AS y, pr.x + k.dx AS x, pr.fold, w FROM pr, k) h ON t.y = h.y AND t.x = h.x AND t.fold = h.fold GROUP BY ALL),
fx AS (SELECT pr.y, pr.x, pr.fold, 1 - coalesce(max(h.w), 0) AS c FROM pr LEFT JOIN (SELECT t.y + k.dy AS y, t.x + k.dx AS x, t.fold, w FROM t, k) h ON pr.y = h.y AND pr.x = h.x AND pr.fold = h.fold GROUP BY ALL),
u AS (SELECT fold, c AS tp, 0::DOUBLE AS fp, 1 - c AS fn FROM tp UNION ALL SELECT fold, 0, c, 0 FROM fx) SELECT fold, {SUMS} FROM u GROUP BY fold""")
def i13_emit_and_score(spark, sf):
    f = folds.quadrants(footprint(spark, sf))
    o = f.withColumn("i", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("v"), "cell_id"))).withColumn("n", F.count("*").over(Window.partitionBy("fold")))
    return metric.scored(metric.owned(o.where(F.col("i") <= F.floor(0.02 * F.col("n"))), truth(f), ("fold",)), ("fold",))


@query(f"{HEAD} SELECT fold, count(*) AS cells, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM f GROUP BY fold")
def i21_quadrant_views(spark, sf):
    f = folds.quadrants(footprint(spark, sf))
    return f.groupBy("fold").agg(F.count("*").alias("cells"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@query()
def j02_place_dots(spark, sf):
    """Spaced dots; too few is an error."""
    fp = footprint(spark, sf).select("y", "x", "v", "cell_id")
    dots = written(emit.poisson(fp, "v", "cell_id", spacing=3.0, k=50))
    if dots.count() < 50:
        raise ValueError("fewer dots than the budget")
    return dots.select("y", "x", "id")


@query()
def j04_obligation_and_spaced(spark, sf):
    """A set that must be there, and spaced dots around it."""
    fp = footprint(spark, sf)
    must = emit.top_positive(truth(fp), "v", "cell_id", 20).select("y", "x", F.col("cell_id").alias("id"))
    rest = emit.poisson(apart(fp, must, 2.9).select("y", "x", "v", "cell_id"), "v", "cell_id", spacing=3.0, k=60)
    return must.unionByName(rest.select("y", "x", "id"))


@query()
def j05_geodesic_thin(spark, sf):
    return emit.geodesic_thin(truth(footprint(spark, sf)), spec(spark, sf).width, 2.8)


@query()
def j16_trace_score_dots(spark, sf):
    """Dots by the kernel-trace score."""
    q = footprint(spark, sf).select("y", "x", "cell_id", (F.col("v") / 500000).alias("pr"))
    s = st.scatter(q.select("y", "x", "pr"), st.triangular()).groupBy("y", "x").agg(F.sum(F.col("w") * F.col("pr")).alias("c"))
    t = q.join(s, ["y", "x"]).withColumn("t", F.round(F.sqrt(F.col("pr") * F.col("c")), 9))
    return emit.poisson(t, "t", "cell_id", spacing=3.0, k=100).select("y", "x", "id")


@query()
def j22_ordered_dots(spark, sf):
    """Dots in the order of placement: any budget is a prefix."""
    fp = footprint(spark, sf).select("y", "x", "v", "cell_id")
    d = emit.poisson(fp, "v", "cell_id", spacing=3.0)
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.desc("s"), "id"))).select("place", "id")


@query("SELECT u, k, 10 * (k - u) > 7 * k AS beyond FROM range(0, 200, 10) a(u), range(100, 400, 25) b(k)")
def l06_rational_bounds(spark, sf):
    """Exact ratios by whole-number products; equality is no failure."""
    u = spark.range(0, 200, 10).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(100).cast("long"), F.lit(375).cast("long"), F.lit(25).cast("long"))).alias("k"))
    return u.select("u", "k", (10 * (F.col("k") - F.col("u")) > 7 * F.col("k")).alias("beyond"))


@query(f"WITH {GRID_SQL}, {REG}, {OVER} SELECT entry, CASE WHEN n_ref = 0 THEN NULL ELSE backward END AS share FROM ov")
def l17_directed_overlap(spark, sf):
    """An empty side is null."""
    ov = sim.overlap(prediction(footprint(spark, sf)), _registry(spark, sf))
    return ov.select("entry", F.when(F.col("n_ref") > 0, F.col("backward")).alias("share"))


@query("SELECT c_mktsegment AS candidate, avg(c_acctbal) > 4400 AND count(*) > 20 AND min(c_acctbal) < 0 AS passed FROM customer GROUP BY 1")
def m18_candidate_evidence(spark, sf):
    """Every rule of the list must hold."""
    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("candidate")).agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("n"), F.min("c_acctbal").alias("lo"))
    return c.select("candidate", F.forall(F.array(F.col("m") > 4400, F.col("n") > 20, F.col("lo") < 0), lambda x: x).alias("passed"))


@query("WITH b AS (SELECT max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS k FROM orders) SELECT k, (SELECT count(*) FROM lineitem WHERE l_orderkey = k) AS items, (SELECT count(*) FROM lineitem WHERE l_orderkey = k AND l_quantity <= 0) = 0 AS valid FROM b")
def m21_review_best(spark, sf):
    """The best record, validated again."""
    o = table(spark, sf, "orders").agg(F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("k"))
    li = table(spark, sf, "lineitem").join(F.broadcast(o), F.col("l_orderkey") == F.col("k"))
    s = li.agg(F.count("*").alias("items"), (F.count_if(F.col("l_quantity") <= 0) == 0).alias("valid"))
    return o.join(F.broadcast(s)).select("k", "items", "valid")


@query("WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT r_regionkey AS k, 5 AS n FROM region) SELECT bool_and(a.n IS NOT DISTINCT FROM b.n) AS consistent, count(*) AS files FROM a FULL JOIN b USING (k)")
def m22_release_consistency(spark, sf):
    a = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.lit(5).alias("m"))
    return a.join(b, "k", "full").agg(F.bool_and(F.col("n").eqNullSafe(F.col("m"))).alias("consistent"), F.count("*").alias("files"))


@query("WITH b AS (SELECT o_orderpriority AS ch, o_orderkey // 4096 AS b, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS h, count(*) AS n FROM orders GROUP BY ALL) SELECT ch, sha256(string_agg(h, ',' ORDER BY b)) AS sha, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ch")
def m26_channel_hashes(spark, sf):
    ch = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("ch"), "o_orderkey")
    return rules.content_id(ch, "o_orderkey", "sha", ("ch",)).join(ch.groupBy("ch").agg(F.count("*").alias("n")), "ch")


@query("SELECT 'orders' AS asset, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders UNION ALL SELECT 'lineitem', count(*), min(l_extendedprice), max(l_extendedprice) FROM lineitem")
def m27_asset_profile(spark, sf):
    one = lambda t, c: table(spark, sf, t).agg(F.lit(t).alias("asset"), F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    return one("orders", "o_totalprice").unionByName(one("lineitem", "l_extendedprice"))


@query(f"WITH {GRID_SQL}, d AS (SELECT g.*, (2*y-w+1)*(2*y-w+1) + (2*x-w+1)*(2*x-w+1) <= (w-3)*(w-3) AS inside FROM g) SELECT count(*) FILTER (p = '2-HIGH' AND st = 'O' AND NOT inside) AS outside, bool_and(v IS NOT NULL) AS complete, bool_and(v > 0) AS positive FROM d")
def m28_format_check(spark, sf):
    from gridloom.sources.cells import inside

    w = spec(spark, sf).width
    dot = (F.col("p") == "2-HIGH") & (F.col("st") == "O")
    return cells(spark, sf).agg(F.count_if(dot & ~inside(w)).alias("outside"), F.bool_and(F.col("v").isNotNull()).alias("complete"), F.bool_and(F.col("v") > 0).alias("positive"))


@query("WITH f AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT n_nationkey AS k, coalesce(n, 0) AS seen, coalesce(n, 0) = 1 AS once FROM nation LEFT JOIN f ON f.k = n_nationkey")
def m29_feed_covers_pins(spark, sf):
    f = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).join(f, "k", "left").select("k", n.alias("seen"), (n == 1).alias("once"))


@query(f"WITH {GRID_SQL}, ns AS (SELECT a.cell_id, b.cell_id AS r, (a.v - b.v) / sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS s FROM fp a, range(-1, 2) p(i), range(-1, 2) q(j), fp b WHERE b.y = a.y + i AND b.x = a.x + j AND b.v < a.v), rc AS (SELECT cell_id, arg_max(r, (s, -r)) AS receiver FROM ns GROUP BY cell_id) SELECT receiver AS cell_id, count(*) AS donors FROM rc GROUP BY 1")
def f09_drainage_donors(spark, sf):
    """Donors of each cell of the drainage forest."""
    r = d8(footprint(spark, sf), "v", spec(spark, sf).width).where("receiver IS NOT NULL")
    return r.groupBy(F.col("receiver").alias("cell_id")).agg(F.count("*").alias("donors"))


@query(f"WITH {DENSE}, h AS (SELECT a.y + i AS y, a.x + j AS x, qty, i*i + j*j AS d2, a.y AS sy, a.x AS sx FROM dn a, range(-4, 5) r(i), range(-4, 5) q(j) WHERE qty IS NOT NULL AND i*i + j*j <= 16), fl AS (SELECT y, x, arg_min(qty, (d2, sy, sx)) AS fill FROM h GROUP BY y, x), q AS (SELECT dn.y, dn.x, dn.w, coalesce(qty, fill) AS a, qty FROM dn LEFT JOIN fl USING (y, x)), {mag_sql('q', 'a', 'm')} SELECT y, x, round(m, 6) AS value FROM m JOIN dn USING (y, x) WHERE dn.qty IS NOT NULL AND m IS NOT NULL")
def c18_front(spark, sf):
    """Gradient of the nearest-filled band, null where the band is."""
    d, _ = _dense(spark, sf)
    f = nearest_fill(d, "qty", "a", 4)
    return _out(st.gradient_magnitude(f, "a", "m").where("qty IS NOT NULL"), "m")


@query(f"WITH {GRID_SQL}, z AS (SELECT cell_id, 0.48 * v / 500000 + 0.28 * coalesce(disc, 0) + 0.24 / (1 + exp(-coalesce(qty, 100) / 100)) AS s FROM fp) SELECT cell_id, round(s, 6) AS value FROM z")
def f30_three_part_surface(spark, sf):
    s = 0.48 * F.col("v") / 500000 + 0.28 * F.coalesce("disc", F.lit(0.0)) + 0.24 * expit(F.coalesce("qty", F.lit(100.0)) / 100)
    return footprint(spark, sf, items=True).select("cell_id", F.round(s, 6).alias("value"))


@query(f"WITH {DENSE} SELECT y, x, coalesce(v, 0) AS value FROM dn")
def i10_vector_to_grid(spark, sf):
    """Rows by cell id back on the dense grid."""
    w = spec(spark, sf).width
    rows = cells(spark, sf).select("cell_id", "v")
    full = spark.range(w * w).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / w).alias("y"), (F.col("id") % w).alias("x"))
    return full.join(rows, "cell_id", "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("value"))


@query(f"WITH {GRID_SQL} SELECT st, round(median(disc), 6) AS mid, round(quantile_cont(disc, 0.75) - quantile_cont(disc, 0.25), 6) AS iqr FROM g WHERE disc IS NOT NULL GROUP BY st")
def k31_gate_scaler_by_regime(spark, sf):
    q = cells(spark, sf, items=True).where("disc IS NOT NULL").groupBy("st").agg(F.percentile("disc", [0.25, 0.5, 0.75]).alias("q"))
    return q.select("st", F.round(F.col("q")[1], 6).alias("mid"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("iqr"))


@query(f"WITH {GRID_SQL}, a AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM g) SELECT cell_id, round(greatest(0, least(1, (v - lo) / (hi - lo))), 6) AS value FROM (SELECT fp.* FROM fp ANTI JOIN (SELECT DISTINCT y + i AS y, x + j AS x FROM fp, range(-3, 4) r(i), range(-3, 4) q(j) WHERE p = '2-HIGH' AND st = 'O' AND i*i + j*j <= 9) d USING (y, x)), a")
def f27_interior_favourability(spark, sf):
    """A normalised layer where no reference dot is near."""
    s = quantile01(cells(spark, sf), "v", "s", 0.02, 0.98)
    free = apart(footprint(spark, sf), prediction(footprint(spark, sf)), 3).select("cell_id")
    return s.join(free, "cell_id", "left_semi").select("cell_id", F.round("s", 6).alias("value"))
