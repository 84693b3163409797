"""Top-k, apportionment, sampling, greedy selection, similarity joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import emit, rules, similarity as sim
from gridloom.operators.distance import apart, near, transform
from gridloom.operators.stencil import dense, disc, scatter, triangular
from gridloom.plans.registry import query
from gridloom.plans.stencil_queries import DENSE  # noqa: F401
from gridloom.sources.cells import GRID_SQL, cells, footprint, prediction, spec, table, truth


def _hash(seed: str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {' || chr(58) || '.join(parts)}), 1, 12) AS BIGINT)"


@query(f"WITH {GRID_SQL} SELECT cell_id, qty FROM fp WHERE qty > 0 AND p <> '1-URGENT' ORDER BY qty DESC, cell_id LIMIT 200")
def g01_top_positive(spark, sf):
    fp = footprint(spark, sf, items=True).where("p <> '1-URGENT'")
    return emit.top_positive(fp, "qty", "cell_id", 200).select("cell_id", "qty")


@query(f"WITH {GRID_SQL} SELECT cell_id FROM fp ORDER BY v DESC, cell_id LIMIT 100")
def g10_choose_dots(spark, sf):
    return footprint(spark, sf).orderBy(F.desc("v"), "cell_id").limit(100).select("cell_id")


SHARE = "w AS (SELECT p AS k, sum(v) AS w FROM fp GROUP BY p), s AS (SELECT k, 1000 * w / sum(w) OVER () AS s FROM w), f AS (SELECT k, s, floor(s) AS f, row_number() OVER (ORDER BY round(s - floor(s), 9) DESC, k) AS r, 1000 - sum(floor(s)) OVER () AS l FROM s)"


@query(f"WITH {GRID_SQL}, {SHARE} SELECT k, CAST(f + CASE WHEN r <= l THEN 1 ELSE 0 END AS BIGINT) AS n FROM f")
def g08_apportion(spark, sf):
    w = footprint(spark, sf).groupBy(F.col("p").alias("k")).agg(F.sum("v").alias("w"))
    return emit.apportion(w, "w", "k", 1000).select("k", "n")


@query(f"WITH {GRID_SQL}, {SHARE}, n AS (SELECT k, CAST(f + CASE WHEN r <= l THEN 1 ELSE 0 END AS BIGINT) AS n FROM f), o AS (SELECT cell_id, p, row_number() OVER (PARTITION BY p ORDER BY v DESC, cell_id) AS i FROM fp) SELECT cell_id FROM o JOIN n ON n.k = o.p WHERE i <= n")
def g09_obligation_plan(spark, sf):
    """Shares by group, then each group's best cells."""
    fp = footprint(spark, sf)
    n = emit.apportion(fp.groupBy(F.col("p").alias("k")).agg(F.sum("v").alias("w")), "w", "k", 1000).select("k", "n")
    o = fp.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("v"), "cell_id")))
    return o.join(F.broadcast(n), o["p"] == n["k"]).where("i <= n").select("cell_id")


@query(f"WITH {GRID_SQL}, d AS (SELECT q.cell_id, sqrt(min((q.y - t.y) * (q.y - t.y) + (q.x - t.x) * (q.x - t.x))) AS d FROM fp q, fp t WHERE q.p = '2-HIGH' AND q.st = 'O' AND t.p = '1-URGENT' GROUP BY 1) SELECT count(*) AS dots, round(avg(CASE WHEN d <= 3 THEN 1.0 ELSE 0 END), 6) AS within3, round(avg(CASE WHEN d <= 9 THEN 1.0 ELSE 0 END), 6) AS within9, round(median(d), 6) AS mid, round(min(d), 6) AS nearest FROM d")
def g11_distance_profile(spark, sf):
    """Distances from dots to the nearest truth cell, however far."""
    fp, w = footprint(spark, sf), spec(spark, sf).width
    d2 = transform(dense(cells(spark, sf), w, w), truth(fp)).select("y", "x", "d2")
    d = prediction(fp).join(d2, ["y", "x"]).select(F.sqrt("d2").alias("d"))
    share = lambda r: F.round(F.avg(F.when(F.col("d") <= r, 1.0).otherwise(0.0)), 6)
    return d.agg(F.count("*").alias("dots"), share(3).alias("within3"), share(9).alias("within9"), F.round(F.median("d"), 6).alias("mid"), F.round(F.min("d"), 6).alias("nearest"))


@query(f"WITH {GRID_SQL} SELECT count(*) AS n, count(*) FILTER (qty IS NULL) AS nulls, min(qty) AS lo, max(qty) AS hi, count(DISTINCT qty) AS kinds, count(*) FILTER (qty > 200) AS beyond, count(*) FILTER (qty < 50) AS b0, count(*) FILTER (qty >= 50 AND qty < 100) AS b1, count(*) FILTER (qty >= 100) AS b2 FROM g")
def g12_band_profile(spark, sf):
    q = F.col("qty")
    return cells(spark, sf, items=True).agg(F.count("*").alias("n"), F.count_if(q.isNull()).alias("nulls"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.count_distinct(q).alias("kinds"), F.count_if(q > 200).alias("beyond"), F.count_if(q < 50).alias("b0"), F.count_if((q >= 50) & (q < 100)).alias("b1"), F.count_if(q >= 100).alias("b2"))


@query("SELECT md5(text) AS h, count(*) AS copies, min(doc_id) AS first, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def g13_dedupe_by_content(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h"))
    return d.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).where("copies > 1")


@query("WITH s AS (SELECT l_orderkey AS line, l_linenumber % 3 AS block, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT o_orderkey AS line, o_totalprice AS km FROM orders) SELECT block, round(sum(km * n / tot), 4) AS km FROM (SELECT *, sum(n) OVER (PARTITION BY line) AS tot FROM s) JOIN t USING (line) GROUP BY block")
def g14_block_length(spark, sf):
    """Line lengths apportioned to blocks by their share of samples."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("line"), (F.col("l_linenumber") % 3).alias("block")).agg(F.count("*").alias("n"))
    s = s.withColumn("tot", F.sum("n").over(Window.partitionBy("line")))
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("line"), F.col("o_totalprice").alias("km"))
    return s.join(t, "line").groupBy("block").agg(F.round(F.sum(F.col("km") * F.col("n") / F.col("tot")), 4).alias("km"))


@query("WITH d AS (SELECT o_orderpriority AS block, sum(o_totalprice) AS km FROM orders GROUP BY 1), c AS (SELECT o_orderpriority AS block, count(*) * 150000.0 AS ctl FROM orders GROUP BY 1) SELECT block, round((km - ctl) / ctl, 6) AS rel, abs((km - ctl) / ctl) <= 0.5 AS ok FROM d JOIN c USING (block)")
def g15_audit_totals(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("block")).agg(F.sum("o_totalprice").alias("km"), (F.count("*") * 150000.0).alias("ctl"))
    rel = (F.col("km") - F.col("ctl")) / F.col("ctl")
    return d.select("block", F.round(rel, 6).alias("rel"), (F.abs(rel) <= 0.5).alias("ok"))


DIFF = "b AS (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem GROUP BY 1), d AS (SELECT coalesce(o_orderkey, b.k) AS k, CASE WHEN o_orderkey IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN o_orderstatus IS NOT DISTINCT FROM b.s THEN 'unchanged' ELSE 'changed' END AS state FROM orders FULL JOIN b ON o_orderkey = b.k)"


def _diff(spark, sf):
    """Orders against what their items say of them."""
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("sa"), F.lit(True).alias("in_a"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("sb")).withColumn("in_b", F.lit(True))
    state = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("sa").eqNullSafe(F.col("sb")), "unchanged").otherwise("changed")
    return a.join(b, "k", "full").select("k", state.alias("state"))


@query(f"WITH {DIFF} SELECT k, state FROM d")
def g16_compare(spark, sf):
    return _diff(spark, sf)


@query(f"WITH {DIFF} SELECT s.state, count(d.k) AS n FROM (VALUES ('added'), ('removed'), ('changed'), ('unchanged')) s(state) LEFT JOIN d ON d.state = s.state GROUP BY 1")
def g17_summarise_states(spark, sf):
    """Counts of all four states, zeros included, in one pass."""
    states = ("added", "removed", "changed", "unchanged")
    one = _diff(spark, sf).agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    return one.unpivot([], list(states), "state", "n")


@query("SELECT max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS best, max(o_totalprice) AS score FROM orders")
def g18_best_record(spark, sf):
    o = table(spark, sf, "orders")
    return o.agg(F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("best"), F.max("o_totalprice").alias("score"))


@query("WITH u AS (SELECT 'orders' AS src, o_totalprice AS s FROM orders UNION ALL SELECT 'pinned', 150000.0 UNION ALL SELECT 'items', l_extendedprice FROM lineitem) SELECT src, max(s) AS best FROM u GROUP BY src")
def g19_selection_floor(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.col("o_totalprice").alias("s"))
    b = table(spark, sf, "lineitem").select(F.lit("items").alias("src"), F.col("l_extendedprice").alias("s"))
    c = spark.range(1).select(F.lit("pinned").alias("src"), F.lit(150000.0).alias("s"))
    return a.unionByName(b).unionByName(c).groupBy("src").agg(F.max("s").alias("best"))


@query("SELECT o_custkey AS site, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS claim, max(o_totalprice) AS score, 'hold' AS decision FROM orders GROUP BY 1")
def g20_group_argmax(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("site"))
    return o.agg(F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("claim"), F.max("o_totalprice").alias("score"), F.lit("hold").alias("decision"))


FIT = """d AS (SELECT (event_id % 500)::DOUBLE AS x, value AS y FROM events), f0 AS (SELECT regr_slope(y, x) AS m, regr_intercept(y, x) AS b FROM d),
c0 AS (SELECT quantile_cont(abs(y - m * x - b), 0.5) AS q FROM d, f0), d1 AS (SELECT d.* FROM d, f0, c0 WHERE abs(y - m * x - b) <= 2.5 * q),
f1 AS (SELECT regr_slope(y, x) AS m, regr_intercept(y, x) AS b FROM d1), c1 AS (SELECT quantile_cont(abs(y - m * x - b), 0.5) AS q FROM d1, f1), d2 AS (SELECT d1.* FROM d1, f1, c1 WHERE abs(y - m * x - b) <= 2.5 * q)"""


@query(f"WITH {FIT} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, count(*) AS n FROM d2")
def g21_robust_line(spark, sf):
    """Least squares, trimmed at 2.5 median residuals, three times."""
    d = table(spark, sf, "events").select((F.col("event_id") % 500).cast("double").alias("x"), F.col("value").alias("y"))
    for _ in range(2):
        f = d.agg(F.regr_slope("y", "x").alias("m"), F.regr_intercept("y", "x").alias("b"))
        r = d.join(F.broadcast(f)).withColumn("r", F.abs(F.col("y") - F.col("m") * F.col("x") - F.col("b")))
        d = r.join(F.broadcast(r.agg(F.percentile("r", 0.5).alias("q")))).where("r <= 2.5 * q").select("x", "y")
    return d.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.count("*").alias("n"))


@query(f"WITH {GRID_SQL} SELECT cell_id FROM g WHERE p = '1-URGENT' AND x BETWEEN 30 - 4 AND 30 + 4 AND y BETWEEN 5 AND 60")
def g22_edge_pixels(spark, sf):
    return cells(spark, sf).where("p = '1-URGENT'").where(F.col("x").between(26, 34) & F.col("y").between(5, 60)).select("cell_id")


@query(f"WITH {GRID_SQL}, d AS (SELECT * FROM fp WHERE p = '2-HIGH' AND st = 'O') , b AS (SELECT cell_id // 4096 AS b, sha256(string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY cell_id)) AS h FROM d GROUP BY 1) SELECT (SELECT count(*) FROM d) AS dots, (SELECT count(*) FROM d WHERE cell_id % 5 = 2) AS on_lattice, sha256(string_agg(h, ',' ORDER BY b)) AS content FROM b")
def g25_geometry(spark, sf):
    d = prediction(footprint(spark, sf))
    n = d.agg(F.count("*").alias("dots"), F.count_if(F.col("cell_id") % 5 == 2).alias("on_lattice"))
    return n.crossJoin(F.broadcast(rules.content_id(d, "cell_id", "content")))  # one row each


@query()
def j01_priority_poisson(spark, sf):
    """Rank-first dots, none nearer than 3, the first 300."""
    return emit.poisson(footprint(spark, sf).select("y", "x", "v", "cell_id"), "v", "cell_id", spacing=3.0, k=300).select("y", "x", "id")


@query()
def j14_poisson_with_clearance(spark, sf):
    fp = footprint(spark, sf)
    free = apart(fp, truth(fp), 2)
    return emit.poisson(free.select("y", "x", "v", "cell_id"), "v", "cell_id", spacing=3.0, k=200).select("y", "x", "id")


@query()
def j15_two_regime_poisson(spark, sf):
    """A quarter of the dots from one regime, the rest from the other, spaced across both."""
    fp = footprint(spark, sf).select("y", "x", "v", "cell_id", "st")
    a = emit.poisson(fp.where("st = 'F'"), "v", "cell_id", spacing=3.0, k=50)
    from gridloom.operators.distance import written

    a = written(a)
    rest = apart(fp.where("st <> 'F'"), a, 2.9)
    b = emit.poisson(rest, "v", "cell_id", spacing=3.0, k=150)
    return a.select("y", "x", "id", F.lit(1).alias("regime")).unionByName(b.select("y", "x", "id", F.lit(2).alias("regime")))


@query()
def j06_kernel_cover(spark, sf):
    """Greedy coverage: the dots that add most kernel credit, in order."""
    fp = truth(footprint(spark, sf))
    return emit.cover(fp.withColumn("one", F.lit(1.0)), "one", "cell_id", k=100).select("y", "x", "id", "gain")


@query(f"WITH {GRID_SQL}, k AS (SELECT a AS dy, b AS dx, 1 - sqrt(a*a + b*b) / 3 AS w FROM range(-2, 3) r(a), range(-2, 3) s(b)), d AS (SELECT cell_id, y, x FROM fp WHERE p = '2-HIGH' AND st = 'O') SELECT a.cell_id AS a, b.cell_id AS b, round(w, 6) AS w FROM d a, k, d b WHERE b.y = a.y + dy AND b.x = a.x + dx")
def j07_neighbour_table(spark, sf):
    d = prediction(footprint(spark, sf)).select("y", "x", "cell_id")
    return scatter(d.withColumnRenamed("cell_id", "a"), triangular()).join(d.withColumnRenamed("cell_id", "b"), ["y", "x"]).select("a", "b", F.round("w", 6).alias("w"))


@query(f"WITH {GRID_SQL} SELECT cell_id FROM fp ORDER BY {_hash('11', 'cell_id')}, cell_id LIMIT 500")
def j08_random_thin(spark, sf):
    return emit.sample(footprint(spark, sf), "cell_id", 500, 11).select("cell_id")


FAR9 = "bad AS (SELECT DISTINCT y + a AS y, x + b AS x FROM fp, range(-3, 4) r(a), range(-3, 4) q(b) WHERE p = '1-URGENT' AND a*a + b*b <= 9)"


@query(f"WITH {GRID_SQL}, {FAR9}, s AS (SELECT cell_id, 'pos' AS kind, y // 20 AS by_, x // 20 AS bx FROM fp WHERE p = '1-URGENT' UNION ALL (SELECT cell_id, 'neg', y // 20, x // 20 FROM fp ANTI JOIN bad USING (y, x) ORDER BY {_hash('13', 'cell_id')}, cell_id LIMIT 400)) SELECT * FROM s")
def j18_training_sample(spark, sf):
    """All positives, a bounded hash sample of background away from them, with block ids."""
    fp = footprint(spark, sf)
    pos = truth(fp)
    neg = emit.sample(apart(fp, pos, 3), "cell_id", 400, 13)
    block = lambda d, k: d.select("cell_id", F.lit(k).alias("kind"), F.floor(F.col("y") / 20).alias("by_"), F.floor(F.col("x") / 20).alias("bx"))
    return block(pos, "pos").unionByName(block(neg, "neg"))


STRATA = "t AS (SELECT y + a AS y, x + b AS x, min(a*a + b*b) AS d2 FROM fp, range(-9, 10) r(a), range(-9, 10) q(b) WHERE p = '1-URGENT' AND a*a + b*b <= 81 GROUP BY ALL), s AS (SELECT cell_id, CASE WHEN d2 = 0 THEN 'core' WHEN d2 <= 9 THEN 'corridor' WHEN d2 <= 81 THEN 'near' ELSE 'far' END AS stratum FROM fp LEFT JOIN t USING (y, x))"


def _strata(spark, sf):
    fp = footprint(spark, sf)
    d = near(fp, truth(fp), 9)
    return d.withColumn("stratum", F.when(F.col("d2") == 0, "core").when(F.col("d2") <= 9, "corridor").when(F.col("d2") <= 81, "near").otherwise("far"))


@query(f"WITH {GRID_SQL}, {STRATA}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_hash('17', 'cell_id')}, cell_id) AS i FROM s) SELECT cell_id, stratum FROM r WHERE i <= 120")
def j19_stratified_sample(spark, sf):
    return emit.stratified(_strata(spark, sf), "stratum", "cell_id", 120, 17).select("cell_id", "stratum")


@query(f"WITH {GRID_SQL}, {STRATA} SELECT stratum, count(*) AS cells FROM s GROUP BY 1")
def j20_corridor_strata(spark, sf):
    return _strata(spark, sf).groupBy("stratum").agg(F.count("*").alias("cells"))


REG = "reg AS (SELECT p || '/' || st AS entry, y, x, cell_id FROM fp), dots AS (SELECT y, x FROM fp WHERE p = '2-HIGH' AND st = 'O'), dk AS (SELECT a, b FROM range(-3, 4) r(a), range(-3, 4) q(b) WHERE a*a + b*b <= 9)"


def _registry(spark, sf):
    fp = footprint(spark, sf)
    return fp.select("y", "x", "cell_id", F.concat_ws("/", "p", "st").alias("entry"))


OVER = """fw AS (SELECT entry, count(*) AS hit FROM dots JOIN (SELECT DISTINCT entry, y + a AS y, x + b AS x FROM reg, dk) USING (y, x) GROUP BY 1),
bw AS (SELECT entry, count(*) AS hit FROM reg SEMI JOIN (SELECT DISTINCT y + a AS y, x + b AS x FROM dots, dk) USING (y, x) GROUP BY 1), sz AS (SELECT entry, count(*) AS n_ref FROM reg GROUP BY 1),
ov AS (SELECT entry, (SELECT count(*) FROM dots) AS n_dots, n_ref, round(coalesce(fw.hit, 0) / (SELECT count(*) FROM dots), 6) AS forward, round(coalesce(bw.hit, 0) / n_ref, 6) AS backward FROM sz LEFT JOIN fw USING (entry) LEFT JOIN bw USING (entry))"""


@query(f"WITH {GRID_SQL}, {REG}, {OVER} SELECT * FROM ov")
def l01_dot_overlap(spark, sf):
    return sim.overlap(prediction(footprint(spark, sf)), _registry(spark, sf))


@query("SELECT i, j, i / 100.0 > 0.90 OR j / 100.0 > 0.70 AS duplicate FROM range(80, 101) r(i), range(60, 81) s(j)")
def l02_is_duplicate(spark, sf):
    ij = spark.range(21 * 21).select((F.floor(F.col("id") / 21) + 80).alias("i"), (F.col("id") % 21 + 60).alias("j"))
    return ij.select("i", "j", sim.duplicate(F.col("i") / 100.0, F.col("j") / 100.0).alias("duplicate"))


COVER = "c AS (SELECT count(*) AS cells, count(d.y) AS covered FROM fp LEFT JOIN (SELECT DISTINCT y + a AS y, x + b AS x FROM fp, (SELECT a, b FROM range(-3, 4) r(a), range(-3, 4) q(b) WHERE a*a + b*b <= 9) WHERE p = '2-HIGH' AND st = 'O') d USING (y, x))"


@query(f"WITH {GRID_SQL}, {COVER} SELECT cells, covered, cells - covered AS uncovered, 10 * covered >= 7 * cells AS space_filling FROM c")
def l03_space_filling_control(spark, sf):
    c = sim.covered(footprint(spark, sf), prediction(footprint(spark, sf)))
    return c.withColumn("space_filling", 10 * F.col("covered") >= 7 * F.col("cells"))


@query(f"WITH {GRID_SQL}, i AS (SELECT fp.y, fp.x FROM fp, (SELECT a, b FROM range(-3, 4) r(a), range(-3, 4) q(b) WHERE abs(a) + abs(b) <= 3) k, fp n WHERE n.y = fp.y + a AND n.x = fp.x + b GROUP BY ALL HAVING count(*) = 25), u AS (SELECT i.* FROM i ANTI JOIN (SELECT DISTINCT y + a AS y, x + b AS x FROM fp, (SELECT a, b FROM range(-3, 4) r(a), range(-3, 4) q(b) WHERE a*a + b*b <= 9) WHERE p = '2-HIGH' AND st = 'O') d USING (y, x)) SELECT (SELECT count(*) FROM i) AS interior, count(*) AS uncovered FROM u")
def l04_interior_coverage(spark, sf):
    from gridloom.operators.distance import eroded

    fp = footprint(spark, sf)
    diamond = [(a, b, 1.0) for a in range(-3, 4) for b in range(-3, 4) if abs(a) + abs(b) <= 3]
    return sim.covered(eroded(fp, fp, diamond), prediction(fp)).select(F.col("cells").alias("interior"), "uncovered")


@query(f"WITH {GRID_SQL}, {COVER} SELECT k AS budget, 10 * (k - (cells - covered)) > 7 * k AS ruled_out FROM c, range(100, 3000, 100) r(k)")
def l05_budget_feasibility(spark, sf):
    """In whole numbers: with k dots, more than 70 % must fall on covered cells."""
    c = sim.covered(footprint(spark, sf), prediction(footprint(spark, sf)))
    k = spark.range(100, 3000, 100).select(F.col("id").alias("budget"))
    return k.join(F.broadcast(c)).select("budget", (10 * (F.col("budget") - F.col("uncovered")) > 7 * F.col("budget")).alias("ruled_out"))


def _rho_sql(a: str, b: str, src: str, by: str) -> str:
    r = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"
    return f"rk AS (SELECT {by}, {r(a)} AS ra, {r(b)} AS rb FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), rho AS (SELECT {by}, count(*) AS n, round(CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END, 6) AS rho FROM rk GROUP BY {by})"


@query(f"WITH {GRID_SQL}, s AS (SELECT p || '/' || st AS entry, v, qty FROM fp), {_rho_sql('v', 'qty', 's', 'entry')} SELECT * FROM rho")
def k01_rank_correlation(spark, sf):
    s = footprint(spark, sf, items=True).select(F.concat_ws("/", "p", "st").alias("entry"), "v", "qty")
    return sim.spearman(s, "v", "qty", ("entry",))


@query(f"WITH {GRID_SQL}, s AS (SELECT 'one' AS entry, v, 1 AS flat FROM fp), {_rho_sql('v', 'flat', 's', 'entry')} SELECT entry, rho FROM rho")
def k02_constant_correlation(spark, sf):
    """A constant side gives null, not an error."""
    s = footprint(spark, sf).select(F.lit("one").alias("entry"), "v", F.lit(1).alias("flat"))
    return sim.spearman(s, "v", "flat", ("entry",)).select("entry", "rho")


@query(f"WITH {GRID_SQL}, s AS (SELECT p || '/' || st AS entry, v, qty FROM fp), {REG}, {OVER}, {_rho_sql('v', 'qty', 's', 'entry')} SELECT entry, rho, forward, backward, coalesce(rho > 0.9, FALSE) OR forward > 0.7 AS duplicate FROM ov JOIN rho USING (entry)")
def l07_compare_registry(spark, sf):
    """Every entry's overlap, rank correlation and verdict in one plan."""
    fp = footprint(spark, sf, items=True)
    rho = sim.spearman(fp.select(F.concat_ws("/", "p", "st").alias("entry"), "v", "qty"), "v", "qty", ("entry",))
    ov = sim.overlap(prediction(fp), _registry(spark, sf))
    return ov.join(rho, "entry").select("entry", "rho", "forward", "backward", sim.duplicate(F.col("rho"), F.col("forward")).alias("duplicate"))


@query("SELECT n_nationkey, coalesce(r_name, 'unknown') AS role FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def l08_classify_entry(spark, sf):
    r = table(spark, sf, "region").where("r_regionkey < 3")
    n = table(spark, sf, "nation")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("n_nationkey", F.coalesce("r_name", F.lit("unknown")).alias("role"))


@query(f"WITH {GRID_SQL}, {REG}, {OVER} SELECT split_part(entry, '/', 1) AS role, count(*) AS entries, max(forward) AS worst FROM ov GROUP BY ROLLUP(split_part(entry, '/', 1))")
def l09_registry_by_role(spark, sf):
    ov = sim.overlap(prediction(footprint(spark, sf)), _registry(spark, sf)).withColumn("role", F.split_part("entry", F.lit("/"), F.lit(1)))
    return ov.rollup("role").agg(F.count("*").alias("entries"), F.max("forward").alias("worst"))


@query(f"WITH {GRID_SQL}, {REG}, {OVER} SELECT entry, forward FROM ov WHERE entry <> '2-HIGH/O' ORDER BY forward DESC, entry LIMIT 12")
def l11_scan_comparators(spark, sf):
    ov = sim.overlap(prediction(footprint(spark, sf)), _registry(spark, sf).where("entry <> '2-HIGH/O'"))
    return ov.orderBy(F.desc("forward"), "entry").limit(12).select("entry", "forward")


SETS = "m AS (SELECT 'm' || st AS entry, y, x FROM fp WHERE p = '1-URGENT' UNION SELECT 'all', y, x FROM fp WHERE p = '1-URGENT' UNION SELECT 'dear', y, x FROM fp WHERE v > 200000), n AS (SELECT entry, count(*) AS n FROM m GROUP BY 1)"


@query(f"WITH {GRID_SQL}, {SETS}, b AS (SELECT a.entry AS a, b.entry AS b, count(*) AS nb FROM m a JOIN m b USING (y, x) WHERE a.entry < b.entry GROUP BY ALL) SELECT a, b, x.n AS n_a, z.n AS n_b, nb AS \"both\", round(nb / (x.n + z.n - nb), 6) AS jaccard, nb = x.n OR nb = z.n AS subset FROM b JOIN n x ON x.entry = a JOIN n z ON z.entry = b")
def l15_set_forensics(spark, sf):
    fp = footprint(spark, sf)
    t = truth(fp)
    m = t.select(F.concat(F.lit("m"), "st").alias("entry"), "y", "x").unionByName(t.select(F.lit("all").alias("entry"), "y", "x")).unionByName(fp.where("v > 200000").select(F.lit("dear").alias("entry"), "y", "x"))
    return sim.set_pairs(m.distinct())


@query(f"WITH {GRID_SQL}, {REG}, sz AS (SELECT entry, count(*) AS n FROM reg GROUP BY 1), o AS (SELECT a.entry AS a, b.entry AS b, count(*) AS hit FROM reg a JOIN (SELECT DISTINCT entry, y + a AS y, x + b AS x FROM reg, dk) b USING (y, x) WHERE a.entry <> b.entry GROUP BY ALL) SELECT a, max(round(hit / n, 6)) AS largest FROM o JOIN sz ON sz.entry = a GROUP BY a")
def l16_overlap_matrix(spark, sf):
    """Each entry's largest directed overlap with any other."""
    reg = _registry(spark, sf)
    spread = scatter(reg.select("y", "x", F.col("entry").alias("b")), disc(3)).select("y", "x", "b").distinct()
    o = reg.select("y", "x", F.col("entry").alias("a")).join(spread, ["y", "x"]).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("hit"))
    n = reg.groupBy(F.col("entry").alias("a")).agg(F.count("*").alias("n"))
    return o.join(n, "a").groupBy("a").agg(F.max(F.round(F.col("hit") / F.col("n"), 6)).alias("largest"))


@query(f"WITH {GRID_SQL}, {REG}, e AS (SELECT entry, count(*) AS n FROM reg GROUP BY 1) SELECT entry, CASE WHEN entry = '2-HIGH/O' THEN 'self' WHEN n < (SELECT quantile_cont(n, 0.2) FROM e) THEN 'small' ELSE 'compared' END AS reason FROM e")
def l18_skip_reasons(spark, sf):
    e = _registry(spark, sf).groupBy("entry").agg(F.count("*").alias("n"))
    q = e.agg(F.percentile("n", 0.2).alias("q"))
    return e.join(F.broadcast(q)).select("entry", F.when(F.col("entry") == "2-HIGH/O", "self").when(F.col("n") < F.col("q"), "small").otherwise("compared").alias("reason"))


@query("WITH u AS (SELECT md5(text) AS sha, 'd' || doc_id AS alias FROM documents UNION ALL SELECT md5(text), 'b' || item_id FROM benchmark) SELECT sha, array_to_string(list_sort(list_distinct(list(alias))), ' ') AS aliases FROM u GROUP BY sha")
def l14_union_dedupe_aliases(spark, sf):
    a = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("sha"), F.concat(F.lit("d"), "doc_id").alias("alias"))
    b = table(spark, sf, "benchmark").select(F.md5(F.col("text").cast("binary")).alias("sha"), F.concat(F.lit("b"), "item_id").alias("alias"))
    return a.unionByName(b).groupBy("sha").agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("aliases"))


@query("""WITH e AS (SELECT user_id AS g, value AS x, (event_id * 7) % 101 AS y FROM events), p AS (SELECT a.g, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND (a.x, a.y) < (b.x, b.y) GROUP BY a.g)
SELECT g, round(s / n, 6) AS tau FROM p""")
def k44_kendall(spark, sf):
    """Kendall's tau by signs of pairs, within each user."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("g"), F.col("value").alias("x"), ((F.col("event_id") * 7) % 101).alias("y"))
    b = e.select("g", F.col("x").alias("x2"), F.col("y").alias("y2"))
    p = e.join(b, "g").where(F.struct("x", "y") < F.struct(F.col("x2"), F.col("y2")))
    s = F.signum(F.col("x") - F.col("x2")) * F.signum((F.col("y") - F.col("y2")).cast("double"))
    return p.groupBy("g").agg(F.round(F.sum(s) / F.count("*"), 6).alias("tau"))


@query(f"WITH d AS (SELECT event_id % 50 AS i, avg(value) AS v FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS n FROM d), b AS (SELECT dr.d AS draw, avg(r.v) AS m FROM range(400) dr(d), range(50) s(s), r WHERE r.k = {_hash('1', 'dr.d', 's.s')} % r.n GROUP BY dr.d) SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM b")
def k46_mean_bootstrap(spark, sf):
    from gridloom.operators.metric import bootstrap, interval

    d = table(spark, sf, "events").groupBy((F.col("event_id") % 50).alias("i")).agg(F.avg("value").alias("v"))
    return interval(bootstrap(d, ["v"], draws=400, seed=1).withColumn("m", F.col("v") / 50), "m")


@query(f"WITH s AS (SELECT event_id, value, user_id, event_id % 24 AS hour FROM events ORDER BY {_hash('2', 'event_id')}, event_id LIMIT 2000) SELECT round(corr(value, user_id), 6) AS r_user, round(corr(value, hour), 6) AS r_hour FROM s")
def k53_pearson_on_sample(spark, sf):
    s = emit.sample(table(spark, sf, "events").select("event_id", "value", "user_id", (F.col("event_id") % 24).alias("hour")), "event_id", 2000, 2)
    return s.agg(F.round(sim.pearson("value", "user_id"), 6).alias("r_user"), F.round(sim.pearson("value", "hour"), 6).alias("r_hour"))


@query(f"WITH {GRID_SQL}, {FAR9.replace('-3, 4', '-9, 10').replace('<= 9)', '<= 81)')}, n AS (SELECT DISTINCT y + a AS y, x + b AS x FROM fp, range(-3, 4) r(a), range(-3, 4) q(b) WHERE p = '1-URGENT' AND a*a + b*b <= 9) SELECT count(*) FILTER (n.y IS NOT NULL) AS near, count(*) FILTER (bad.y IS NULL) AS far FROM fp LEFT JOIN n USING (y, x) LEFT JOIN bad USING (y, x)")
def k04_near_far(spark, sf):
    fp = footprint(spark, sf)
    d = near(fp, truth(fp), 9)
    return d.agg(F.count_if(F.col("d2") <= 9).alias("near"), F.count_if(F.col("d2").isNull()).alias("far"))


@query(f"WITH {GRID_SQL}, r AS (SELECT cell_id, p = '1-URGENT' AS pos, row_number() OVER (PARTITION BY p = '1-URGENT' ORDER BY {_hash('19', 'cell_id')}, cell_id) AS i FROM fp WHERE qty IS NOT NULL) SELECT cell_id, pos FROM r WHERE i <= 250")
def k05_balanced_matrix(spark, sf):
    fp = footprint(spark, sf, items=True).dropna(subset=["qty"]).withColumn("pos", F.col("p") == "1-URGENT")
    return emit.stratified(fp, "pos", "cell_id", 250, 19).select("cell_id", "pos")
