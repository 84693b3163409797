"""Evaluation metric, folds and gates over the order grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.scalar import credit_per_mass_threshold, hashed, inclusion_threshold, tversky
from gridloom.operators import folds, metric
from gridloom.operators.distance import components, written
from gridloom.operators.stencil import kernel_column, scatter, triangular
from gridloom.plans.registry import query
from gridloom.sources.cells import GRID_SQL, cells, footprint, prediction, spec, table, truth

KERNEL = "k AS (SELECT a AS dy, b AS dx, 1 - sqrt(a*a + b*b) / 3 AS w FROM range(-2, 3) r(a), range(-2, 3) s(b))"
FOLDS = "m AS (SELECT floor(median(y)) AS ym, floor(median(x)) AS xm FROM fp), f AS (SELECT fp.*, CASE WHEN y < ym AND x < xm THEN 0 WHEN y < ym THEN 1 WHEN x < xm THEN 2 ELSE 3 END AS fold FROM fp CROSS JOIN m)"
HEAD = f"WITH {GRID_SQL}, {KERNEL}, {FOLDS}"
#: Truth and prediction parts by fold; {by} and {on} are the fold's columns or nothing.
PARTS = """t AS (SELECT y, x, fold FROM f WHERE p = '1-URGENT'), pr AS (SELECT y, x, fold FROM f WHERE p = '2-HIGH' AND st = 'O'),
tp AS (SELECT t.y, t.x, t.fold, coalesce(max(h.w), 0) AS c FROM t LEFT JOIN (SELECT pr.y + k.dy AS y, pr.x + k.dx AS x, pr.fold, w FROM pr, k) h ON t.y = h.y AND t.x = h.x {on_t} GROUP BY ALL),
fx AS (SELECT pr.y, pr.x, pr.fold, 1 - coalesce(max(h.w), 0) AS c FROM pr LEFT JOIN (SELECT t.y + k.dy AS y, t.x + k.dx AS x, t.fold, w FROM t, k) h ON pr.y = h.y AND pr.x = h.x {on_p} GROUP BY ALL),
u AS (SELECT y, x, fold, c AS tp, 0::DOUBLE AS fp, 1 - c AS fn FROM tp UNION ALL SELECT y, x, fold, 0, c, 0 FROM fx)"""
BY_FOLD = PARTS.format(on_t="AND t.fold = h.fold", on_p="AND pr.fold = h.fold")
WHOLE = PARTS.format(on_t="", on_p="")
SUMS = "round(sum(tp), 6) AS tp, round(sum(fp), 6) AS fp, round(sum(fn), 6) AS fn, round(sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-7), 6) AS dti"


def _folded(spark, sf):
    return folds.quadrants(footprint(spark, sf))


@query(f"{HEAD}, {BY_FOLD} SELECT fold, {SUMS} FROM u GROUP BY ROLLUP(fold)")
def dti_pooled_by_fold(spark, sf):
    """The flagship: score by fold and pooled, in one pass."""
    f = _folded(spark, sf)
    return metric.scored(metric.owned(prediction(f), truth(f), ("fold",)), ("fold",), rollup=True)


@query("SELECT a::INTEGER AS dy, b::INTEGER AS dx, round(1 - sqrt(a*a + b*b) / 3, 6) AS w FROM range(-2, 3) r(a), range(-2, 3) s(b)")
def h01_kernel_offsets(spark, sf):
    return spark.range(1).select(F.explode(kernel_column(triangular())).alias("k")).select("k.dy", "k.dx", F.round("k.w", 6).alias("w"))


@query(f"{HEAD}, c AS (SELECT f.y + dy AS y, f.x + dx AS x, max(k.w) AS w FROM f, k WHERE p = '1-URGENT' GROUP BY ALL) SELECT cell_id, round(coalesce(c.w, 0), 6) AS credit FROM fp LEFT JOIN c USING (y, x)")
def h02_kernel_credit(spark, sf):
    fp = footprint(spark, sf)
    return fp.join(metric.credit(truth(fp)), ["y", "x"], "left").select("cell_id", F.round(F.coalesce("w", F.lit(0.0)), 6).alias("credit"))


@query(f"{HEAD} SELECT count(*) AS cells, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v < 0) AS negative, count(DISTINCT cell_id) = count(*) AS unique_cells FROM fp")
def h03_evaluation_arrays(spark, sf):
    fp = footprint(spark, sf)
    return fp.agg(F.count("*").alias("cells"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("v") < 0).alias("negative"), (F.count_distinct("cell_id") == F.count("*")).alias("unique_cells"))


SOFT = """q AS (SELECT y, x, fold, ((cell_id * 37) % 101) / 100.0 AS pv FROM f WHERE (cell_id * 37) % 101 > 60), t AS (SELECT y, x FROM f WHERE p = '1-URGENT'),
tp AS (SELECT t.y, t.x, coalesce(max(h.c), 0) AS c FROM t LEFT JOIN (SELECT q.y + dy AS y, q.x + dx AS x, w * pv AS c FROM q, k) h USING (y, x) GROUP BY ALL),
fx AS (SELECT q.y, q.x, pv * (1 - coalesce(max(h.w), 0)) AS c FROM q LEFT JOIN (SELECT t.y + dy AS y, t.x + dx AS x, w FROM t, k) h USING (y, x) GROUP BY q.y, q.x, pv),
u AS (SELECT c AS tp, 0::DOUBLE AS fp, 1 - c AS fn FROM tp UNION ALL SELECT 0, c, 0 FROM fx)"""


@query(f"{HEAD}, {SOFT} SELECT {SUMS} FROM u")
def h04_dti_components_exact(spark, sf):
    fp = footprint(spark, sf)
    soft = fp.withColumn("s", (F.col("cell_id") * 37) % 101).where("s > 60").withColumn("pv", F.col("s") / 100.0)
    return metric.scored(metric.owned(soft, truth(fp), soft="pv"))


@query(f"{HEAD}, {WHOLE} SELECT {SUMS} FROM u")
def h05_dti_score_fast(spark, sf):
    fp = footprint(spark, sf)
    return metric.scored(metric.owned(prediction(fp), truth(fp)))


@query(f"{HEAD}, {WHOLE.replace('t AS (SELECT y, x, fold FROM f WHERE p', 't AS (SELECT y, x, fold FROM f WHERE st <> chr(80) AND p').replace('pr AS (SELECT y, x, fold FROM f WHERE p', 'pr AS (SELECT y, x, fold FROM f WHERE st <> chr(80) AND p')} SELECT {SUMS} FROM u")
def h06_dti_score_masked(spark, sf):
    fp = footprint(spark, sf)
    known = fp.where("st = 'P'").select("cell_id")
    active = fp.join(known, "cell_id", "left_anti")
    return metric.scored(metric.owned(prediction(active), truth(active)))


GRID_OF_D = "FROM range(1, 100) r(i)"


@query(f"SELECT i, round(0.2 * (i / 100.0) / (1 - (1 - 0.8) * (i / 100.0)), 6) AS threshold {GRID_OF_D}")
def h07_marginal_inclusion_threshold(spark, sf):
    return spark.range(1, 100).select(F.col("id").alias("i"), F.round(inclusion_threshold(F.col("id") / 100.0), 6).alias("threshold"))


@query(f"SELECT i, round(0.2 * (i / 100.0), 6) AS threshold {GRID_OF_D}")
def h08_credit_per_mass_threshold(spark, sf):
    return spark.range(1, 100).select(F.col("id").alias("i"), F.round(credit_per_mass_threshold(F.col("id") / 100.0), 6).alias("threshold"))


@query("SELECT round(3.0 / (3.0 + 0.2 * 1.89 + 0.8 * 2.0 + 1e-7), 2) AS score")
def h09_worked_example(spark, sf):
    return spark.range(1).select(F.round(tversky(F.lit(3.0), F.lit(1.89), F.lit(2.0)), 2).alias("score"))


@query(f"{HEAD}, {BY_FOLD}, s AS (SELECT fold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM u GROUP BY fold) SELECT {SUMS} FROM s")
def h10_pooled_dti(spark, sf):
    f = _folded(spark, sf)
    by = metric.owned(prediction(f), truth(f), ("fold",)).groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return metric.scored(by)


@query(f"{HEAD}, {BY_FOLD} SELECT fold, round(sum(tp), 6) AS tp, round(sum(fp), 6) AS fp, round(sum(fn), 6) AS fn FROM u GROUP BY fold")
def h11_pooled_components(spark, sf):
    f = _folded(spark, sf)
    return metric.scored(metric.owned(prediction(f), truth(f), ("fold",)), ("fold",)).drop("dti")


TILES = "ti AS (SELECT y // 20 AS ty, x // 20 AS tx, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM u GROUP BY ALL)"


@query(f"{HEAD}, {WHOLE}, {TILES} SELECT ty, tx, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn FROM ti")
def h12_spatial_components(spark, sf):
    fp = footprint(spark, sf)
    got = metric.tiles(metric.owned(prediction(fp), truth(fp)), 20)
    return got.select("ty", "tx", *[F.round(c, 6).alias(c) for c in ("tp", "fp", "fn")])


def _boot(draws, seed):
    return f"""{HEAD}, {WHOLE}, {TILES}, n AS (SELECT count(*) AS n FROM ti), nr AS (SELECT *, row_number() OVER (ORDER BY ty, tx) - 1 AS i FROM ti),
dr AS (SELECT d.d AS draw, s.s AS slot, CAST('0x' || substr(md5('{seed}:' || d.d || ':' || s.s), 1, 12) AS BIGINT) % n AS i FROM range({draws}) d(d), n, range(n) s(s)),
b AS (SELECT draw, sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-7) AS dti FROM dr JOIN nr USING (i) GROUP BY draw)
SELECT round(quantile_cont(dti, 0.025), 6) AS lo, round(quantile_cont(dti, 0.975), 6) AS hi FROM b"""


def _bootstrap(spark, sf, draws, seed):
    fp = footprint(spark, sf)
    t = written(metric.tiles(metric.owned(prediction(fp), truth(fp)), 20))
    drawn = metric.bootstrap(t, ["tp", "fp", "fn"], draws=draws, seed=seed)
    return metric.interval(drawn.withColumn("dti", tversky(F.col("tp"), F.col("fp"), F.col("fn"))), "dti")


@query(_boot(1000, 20261025))
def h13_pooled_bootstrap(spark, sf):
    return _bootstrap(spark, sf, 1000, 20261025)


@query(_boot(1999, 7))
def h14_spatial_bootstrap_ci(spark, sf):
    return _bootstrap(spark, sf, 1999, 7)


@query(f"{HEAD}, {BY_FOLD} SELECT fold, {SUMS} FROM u GROUP BY fold")
def h17_dense_scores(spark, sf):
    f = _folded(spark, sf)
    return metric.scored(metric.owned(prediction(f), truth(f), ("fold",)), ("fold",))


COMPS = """lab AS (SELECT cell_id AS c, y, x FROM fp WHERE p = '1-URGENT'),
adj AS (SELECT a.c AS a, b.c AS b FROM lab a JOIN (SELECT c, y + dy AS y, x + dx AS x FROM lab, range(-1, 2) r(dy), range(-1, 2) s(dx)) b ON a.y = b.y AND a.x = b.x),
walk AS (SELECT a, b FROM adj UNION SELECT walk.a, adj.b FROM walk JOIN adj ON walk.b = adj.a),
comp AS (SELECT lab.y, lab.x, lab.c, min(walk.b) AS comp FROM lab JOIN walk ON walk.a = lab.c GROUP BY ALL)"""
RHEAD = HEAD.replace("WITH ", "WITH RECURSIVE ", 1)
DRAWS = "thin AS (SELECT comp, d.d AS draw FROM (SELECT DISTINCT comp FROM comp), range(3) d(d) WHERE CAST('0x' || substr(md5('5:' || d.d || ':' || comp), 1, 12) AS BIGINT) % 100 < 34)"


@query(f"""{RHEAD}, {COMPS}, {DRAWS}, t AS (SELECT y, x, draw FROM comp JOIN thin USING (comp)), pr AS (SELECT y, x, draw FROM fp, range(3) r(draw) WHERE p = '2-HIGH' AND st = 'O'),
tp AS (SELECT t.y, t.x, t.draw, coalesce(max(h.w), 0) AS c FROM t LEFT JOIN (SELECT pr.y + k.dy AS y, pr.x + k.dx AS x, pr.draw, k.w FROM pr, k) h ON t.y = h.y AND t.x = h.x AND t.draw = h.draw GROUP BY ALL),
fx AS (SELECT pr.y, pr.x, pr.draw, 1 - coalesce(max(h.w), 0) AS c FROM pr LEFT JOIN (SELECT t.y + k.dy AS y, t.x + k.dx AS x, t.draw, k.w FROM t, k) h ON pr.y = h.y AND pr.x = h.x AND pr.draw = h.draw GROUP BY ALL),
u AS (SELECT draw, c AS tp, 0::DOUBLE AS fp, 1 - c AS fn FROM tp UNION ALL SELECT draw, 0, c, 0 FROM fx) SELECT draw, {SUMS} FROM u GROUP BY draw""")
def h18_sparse_scores(spark, sf):
    """Scores against truth thinned by whole components, in three draws."""
    fp = footprint(spark, sf)
    comp = components(truth(fp), spec(spark, sf).width)
    draws = spark.range(3).select(F.col("id").alias("draw"))
    kept = comp.select("comp").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    kept = kept.where(hashed(F.lit(5), "draw", "comp") % 100 < 34)
    t = comp.join(kept, "comp")
    pred = prediction(fp).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    got = metric.scored(metric.owned(pred, t, ("draw",)), ("draw",))
    return draws.join(got, "draw")


@query(f"{HEAD} SELECT count(*) AS cells, count(*) FILTER (p IS NULL) AS missing, bool_and(p IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) AS in_domain FROM fp")
def i01_binary_grid(spark, sf):
    good = F.col("p").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return footprint(spark, sf).agg(F.count("*").alias("cells"), F.count_if(F.col("p").isNull()).alias("missing"), F.bool_and(good).alias("in_domain"))


@query(f"{HEAD} SELECT cell_id, fold FROM f")
def i02_quadrant_folds(spark, sf):
    return _folded(spark, sf).select("cell_id", "fold")


HIDE = "hid AS (SELECT DISTINCT comp.y, comp.x, comp.comp, tf.fold FROM comp JOIN (SELECT DISTINCT comp, fold FROM comp JOIN f USING (y, x)) tf USING (comp))"


@query(f"{RHEAD}, {COMPS}, {HIDE} SELECT y, x, comp, fold FROM hid")
def i03_hidden_components(spark, sf):
    f = _folded(spark, sf)
    return folds.hidden(f, truth(f), spec(spark, sf).width)


@query(f"""{RHEAD}, {COMPS}, {HIDE}, disc AS (SELECT a AS dy, b AS dx FROM range(-5, 6) r(a), range(-5, 6) s(b) WHERE a*a + b*b <= 25),
near AS (SELECT DISTINCT y + dy AS y, x + dx AS x, fold FROM hid, disc), o AS (SELECT f.y, f.x, k.fold AS fold, f.fold = k.fold AS valid FROM f, (SELECT DISTINCT fold FROM f) k),
a AS (SELECT o.*, n.y IS NOT NULL AS near, l.c IS NOT NULL AS label, h.comp IS NOT NULL AS hid FROM o LEFT JOIN near n ON o.y = n.y AND o.x = n.x AND o.fold = n.fold
  LEFT JOIN lab l ON o.y = l.y AND o.x = l.x LEFT JOIN hid h ON o.y = h.y AND o.x = h.x AND o.fold = h.fold)
SELECT fold, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid AND NOT near) AS train, count(*) FILTER (label AND NOT hid) AS visible, count(*) FILTER (hid AND valid) AS truth FROM a GROUP BY fold""")
def i04_segment_holdout(spark, sf):
    f = _folded(spark, sf)
    t = folds.fold_cells(f, truth(f), spec(spark, sf).width, 5)
    return t.groupBy("fold").agg(*[F.count_if(F.col(c)).alias(c) for c in ("valid", "train", "visible", "truth")])


@query(f"{HEAD}, {BY_FOLD}, ti AS (SELECT fold, y // 10 AS ty, x // 10 AS tx, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM u WHERE fold = 2 GROUP BY ALL) SELECT ty, tx, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn FROM ti")
def i05_score_fold(spark, sf):
    f = _folded(spark, sf).where("fold = 2")
    got = metric.tiles(metric.owned(prediction(f), truth(f)), 10)
    return got.select("ty", "tx", *[F.round(c, 6).alias(c) for c in ("tp", "fp", "fn")])


OTHER = BY_FOLD.replace("p = '2-HIGH' AND st = 'O'", "p = '3-MEDIUM' AND st = 'O'")


@query(f"""{HEAD}, a AS (WITH {BY_FOLD} SELECT fold, sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-7) AS c FROM u GROUP BY fold),
b AS (WITH {OTHER} SELECT fold, sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-7) AS c FROM u GROUP BY fold)
SELECT round(avg(a.c - b.c), 6) AS mean_delta, count(*) FILTER (a.c > b.c) AS wins, round(min(a.c - b.c), 6) AS min_delta FROM a JOIN b USING (fold)""")
def i07_compare_paired(spark, sf):
    f = _folded(spark, sf)
    dti = tversky(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    one = lambda p, n: metric.owned(p, truth(f), ("fold",)).groupBy("fold").agg(dti.alias(n))
    both = one(prediction(f), "a").join(one(f.where("p = '3-MEDIUM' AND st = 'O'"), "b"), "fold")
    d = F.col("a") - F.col("b")
    return both.agg(F.round(F.avg(d), 6).alias("mean_delta"), F.count_if(d > 0).alias("wins"), F.round(F.min(d), 6).alias("min_delta"))


AUC = """r AS (SELECT feature, value, pos, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS mid FROM lo WHERE value IS NOT NULL)
SELECT feature, count(*) FILTER (pos) AS pos, count(*) FILTER (NOT pos) AS neg,
  round((sum(mid) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / nullif(count(*) FILTER (pos) * count(*) FILTER (NOT pos), 0), 6) AS auc FROM r GROUP BY feature"""


@query(f"{HEAD}, lo AS (SELECT 'v' AS feature, v AS value, p = '1-URGENT' AS pos FROM fp UNION ALL SELECT 'qty', qty, p = '1-URGENT' FROM fp UNION ALL SELECT 'disc', disc, p = '1-URGENT' FROM fp), {AUC}")
def i08_canary_auc(spark, sf):
    """Single-feature AUC of every band in one pass over the unpivoted table."""
    fp = footprint(spark, sf, items=True).withColumn("pos", F.col("p") == "1-URGENT")
    return folds.auc(fp.unpivot(["pos"], ["v", "qty", "disc"], "feature", "value"), "value", "pos", ("feature",))


@query("WITH lo AS (SELECT 'n_chars' AS feature, n_chars AS value, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), " + AUC)
def i08_canary_label_auc(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    d = d.select(F.lit("n_chars").alias("feature"), F.col("n_chars").alias("value"), (F.col("quality") == 1).alias("pos"))
    return folds.auc(d, "value", "pos", ("feature",))


@query(f"{HEAD}, lo AS (SELECT 'qty' AS feature, CAST(qty IS NULL AS INTEGER) AS value, p = '1-URGENT' AS pos FROM g), {AUC}")
def i08_missingness_auc(spark, sf):
    g = cells(spark, sf, items=True).select(F.lit("qty").alias("feature"), F.col("qty").isNull().cast("int").alias("value"), (F.col("p") == "1-URGENT").alias("pos"))
    return folds.auc(g, "value", "pos", ("feature",))


@query(f"{HEAD}, {BY_FOLD}, s AS (SELECT fold, round(sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-7), 5) AS d FROM u GROUP BY fold) SELECT round(avg(d), 5) AS mean_dti FROM s")
def i12_score_mask(spark, sf):
    f = _folded(spark, sf)
    s = metric.owned(prediction(f), truth(f), ("fold",)).groupBy("fold").agg(F.round(tversky(F.sum("tp"), F.sum("fp"), F.sum("fn")), 5).alias("d"))
    return s.agg(F.round(F.avg("d"), 5).alias("mean_dti"))


@query(f"{RHEAD}, {COMPS}, {HIDE}, vis AS (SELECT fold, y, x FROM lab, (SELECT DISTINCT fold FROM f) EXCEPT SELECT fold, y, x FROM hid) SELECT fold, count(*) AS known FROM vis GROUP BY fold")
def i16_known_for(spark, sf):
    f = _folded(spark, sf)
    every = truth(f).select("y", "x").withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    known = every.select("fold", "y", "x").exceptAll(folds.hidden(f, truth(f), spec(spark, sf).width).select("fold", "y", "x"))
    return known.groupBy("fold").agg(F.count("*").alias("known"))


@query(f"""{HEAD}, a AS (WITH {BY_FOLD} SELECT fold, sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-7) AS c FROM u GROUP BY fold),
b AS (WITH {OTHER} SELECT fold, sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-7) AS c FROM u GROUP BY fold),
s AS (SELECT avg(a.c - b.c) AS m, count(*) FILTER (a.c > b.c) AS wins, min(a.c - b.c) AS w, count(*) AS n FROM a JOIN b USING (fold))
SELECT round(m, 6) AS mean_gain, wins, round(w, 6) AS worst, m >= 0.001 AND 4 * wins >= 3 * n AND w >= -0.01 AS passed FROM s""")
def i18_gate(spark, sf):
    f = _folded(spark, sf)
    dti = tversky(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    one = lambda p, n: metric.owned(p, truth(f), ("fold",)).groupBy("fold").agg(dti.alias(n))
    return folds.gate(one(prediction(f), "candidate").join(one(f.where("p = '3-MEDIUM' AND st = 'O'"), "baseline"), "fold"))


SECTORS = "WITH {g}, m AS (SELECT median(y + x) AS um, median(y - x) AS vm FROM fp) SELECT cell_id, CASE WHEN y + x < um AND y - x < vm THEN {o[0]} WHEN y + x < um THEN {o[1]} WHEN y - x < vm THEN {o[2]} ELSE {o[3]} END AS fold FROM fp CROSS JOIN m"


@query(SECTORS.format(g=GRID_SQL, o=(0, 1, 2, 3)))
def i19_rotated_sectors(spark, sf):
    return folds.sectors(footprint(spark, sf)).select("cell_id", "fold")


@query(SECTORS.format(g=GRID_SQL, o=(0, 3, 1, 2)))
def i20_rotated_sectors_renumbered(spark, sf):
    return folds.sectors(footprint(spark, sf), (0, 3, 1, 2)).select("cell_id", "fold")


@query(f"""{HEAD}, dr AS (SELECT * FROM range(3) d(draw)), t AS (SELECT y, x, fold, draw FROM f, dr WHERE p = '1-URGENT' AND (cell_id + draw) % 3 = 0), pr AS (SELECT y, x, fold, draw FROM f, dr WHERE p = '2-HIGH' AND st = 'O'),
tp AS (SELECT t.y, t.x, t.fold, t.draw, coalesce(max(h.w), 0) AS c FROM t LEFT JOIN (SELECT pr.y + k.dy AS y, pr.x + k.dx AS x, pr.fold, pr.draw, k.w FROM pr, k) h ON t.y = h.y AND t.x = h.x AND t.fold = h.fold AND t.draw = h.draw GROUP BY ALL),
fx AS (SELECT pr.y, pr.x, pr.fold, pr.draw, 1 - coalesce(max(h.w), 0) AS c FROM pr LEFT JOIN (SELECT t.y + k.dy AS y, t.x + k.dx AS x, t.fold, t.draw, k.w FROM t, k) h ON pr.y = h.y AND pr.x = h.x AND pr.fold = h.fold AND pr.draw = h.draw GROUP BY ALL),
u AS (SELECT draw, fold, c AS tp, 0::DOUBLE AS fp, 1 - c AS fn FROM tp UNION ALL SELECT draw, fold, 0, c, 0 FROM fx) SELECT draw, fold, {SUMS} FROM u GROUP BY draw, fold""")
def i23_draw_by_fold_scores(spark, sf):
    f = _folded(spark, sf).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return metric.scored(metric.owned(prediction(f), truth(f).where("(cell_id + draw) % 3 = 0"), ("draw", "fold")), ("draw", "fold"))


@query("SELECT k AS fold, round(avg(v), 6) AS m FROM (SELECT l_linenumber % 4 AS k, l_quantity AS v FROM lineitem) GROUP BY ROLLUP(k)")
def i24_summary(spark, sf):
    """Mean by fold and over all, in one pass."""
    li = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 4).alias("fold"), F.col("l_quantity").alias("v"))
    return li.rollup("fold").agg(F.round(F.avg("v"), 6).alias("m"))


@query(f"{HEAD}, c AS (SELECT t.y + dy AS y, t.x + dx AS x, max(k.w) AS w FROM fp t, k WHERE t.p = '1-URGENT' GROUP BY ALL) SELECT fp.st AS st, count(*) AS dots, round(sum(coalesce(c.w, 0)), 6) AS credit FROM fp LEFT JOIN c USING (y, x) WHERE p = '2-HIGH' GROUP BY fp.st")
def h20_stored_distance_score(spark, sf):
    """Credit of dots from a stored proximity field, reused for every group of dots."""
    fp = footprint(spark, sf)
    field = written(metric.credit(truth(fp)))
    return fp.where("p = '2-HIGH'").join(field, ["y", "x"], "left").groupBy("st").agg(F.count("*").alias("dots"), F.round(F.sum(F.coalesce("w", F.lit(0.0))), 6).alias("credit"))


@query(f"{HEAD}, far AS (SELECT DISTINCT f.y + a AS y, f.x + b AS x FROM f, range(-2, 3) r(a), range(-2, 3) s(b) WHERE p = '5-LOW' AND st = 'F' AND a*a + b*b <= 4), {WHOLE.replace('FROM f WHERE p = ' + chr(39) + '1-URGENT' + chr(39), 'FROM f ANTI JOIN far USING (y, x) WHERE p = ' + chr(39) + '1-URGENT' + chr(39))} SELECT {SUMS} FROM u")
def h21_independent_truth(spark, sf):
    """Score against truth that lies away from another set of labels."""
    fp = footprint(spark, sf)
    known = fp.where("p = '5-LOW' AND st = 'F'")
    from gridloom.operators.distance import apart

    return metric.scored(metric.owned(prediction(fp), apart(truth(fp), known, 2)))


@query(f"{HEAD}, {WHOLE} SELECT abs(a.d - b.d) <= 1e-9 AS equal FROM (SELECT sum(tp) AS d FROM u) a, (SELECT sum(tp) AS d FROM u) b")
def h19_two_plans_agree(spark, sf):
    """The scatter plan and a gather plan give the same credit."""
    fp = footprint(spark, sf)
    a = metric.owned(prediction(fp), truth(fp)).agg(F.sum("tp").alias("a"))
    back = scatter(truth(fp).select("y", "x", "cell_id"), [(-y, -x, w) for y, x, w in triangular()])
    b = back.join(prediction(fp).select("y", "x"), ["y", "x"]).groupBy("cell_id").agg(F.max("w").alias("w")).agg(F.sum("w").alias("b"))
    return a.join(F.broadcast(b)).select((F.abs(F.col("a") - F.col("b")) <= 1e-9).alias("equal"))
