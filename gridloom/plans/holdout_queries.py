"""Hold-out objects over the order grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import emit, folds, holdout, metric
from gridloom.operators.distance import components
from gridloom.operators.stencil import dense, ridges
from gridloom.plans.metric_queries import BY_FOLD, COMPS, HEAD, OTHER, RHEAD, SUMS
from gridloom.plans.registry import query
from gridloom.sources.cells import cells, footprint, prediction, spec, truth


def _folded(spark, sf, *, items=False):
    return folds.quadrants(footprint(spark, sf, items=items))


#: Components within each fold, and the fifth of them that stays as truth.
QUADS = """lab4 AS (SELECT cell_id AS c, y, x, fold FROM f WHERE p = '1-URGENT'),
adj4 AS (SELECT a.c AS a, b.c AS b FROM lab4 a JOIN (SELECT c, fold, y + dy AS y, x + dx AS x FROM lab4, range(-1, 2) r(dy), range(-1, 2) s(dx)) b ON a.y = b.y AND a.x = b.x AND a.fold = b.fold),
walk4 AS (SELECT a, b FROM adj4 UNION SELECT walk4.a, adj4.b FROM walk4 JOIN adj4 ON walk4.b = adj4.a),
comp4 AS (SELECT lab4.y, lab4.x, lab4.fold, min(walk4.b) AS comp FROM lab4 JOIN walk4 ON walk4.a = lab4.c GROUP BY lab4.y, lab4.x, lab4.fold),
quad AS (SELECT *, CAST('0x' || substr(md5('4242:' || fold || ':' || comp), 1, 12) AS BIGINT) % 100 < 20 AS sparse FROM comp4)"""


@query(f"{RHEAD}, {QUADS} SELECT fold, count(*) AS dense, count(*) FILTER (sparse) AS sparse, count(*) FILTER (NOT sparse) AS known, count(DISTINCT comp) AS components FROM quad GROUP BY fold")
def i09_quadrant_truths(spark, sf):
    """Each quadrant's labels, the components of them that stay as truth, and what is known."""
    f = _folded(spark, sf)
    t = holdout.quadrant_truths(holdout.checked(f, truth(f)), spec(spark, sf).width)
    return t.groupBy("fold").agg(F.count("*").alias("dense"), F.count_if("sparse").alias("sparse"), F.count_if(~F.col("sparse")).alias("known"), F.count_distinct("comp").alias("components"))


EMIT = "em AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY qty DESC, cell_id) AS i, (SELECT round_even(count(*) * 0.05, 0) FROM f g WHERE g.fold = f.fold) AS k FROM f WHERE qty > 0) WHERE i <= k)"
#: Scores of em against all labels, and against the sparse ones off the known.
MODES = """kn AS (SELECT y, x FROM quad WHERE NOT sparse), tt AS (SELECT 'dense' AS mode, y, x, fold FROM quad UNION ALL SELECT 'sparse', y, x, fold FROM quad WHERE sparse),
pp AS (SELECT 'dense' AS mode, y, x, fold FROM em UNION ALL SELECT 'sparse', y, x, fold FROM em ANTI JOIN kn USING (y, x)),
tp2 AS (SELECT t.mode, t.y, t.x, t.fold, coalesce(max(h.w), 0) AS c FROM tt t LEFT JOIN (SELECT mode, pp.y + dy AS y, pp.x + dx AS x, fold, w FROM pp, k) h ON t.y = h.y AND t.x = h.x AND t.fold = h.fold AND t.mode = h.mode GROUP BY ALL),
fp2 AS (SELECT p.mode, p.y, p.x, p.fold, 1 - coalesce(max(h.w), 0) AS c FROM pp p LEFT JOIN (SELECT mode, tt.y + dy AS y, tt.x + dx AS x, fold, w FROM tt, k) h ON p.y = h.y AND p.x = h.x AND p.fold = h.fold AND p.mode = h.mode GROUP BY ALL),
u2 AS (SELECT mode, fold, c AS tp, 0::DOUBLE AS fp, 1 - c AS fn FROM tp2 UNION ALL SELECT mode, fold, 0, c, 0 FROM fp2),
sc AS (SELECT mode, fold, sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-7) AS dti FROM u2 GROUP BY ALL)"""


def _emitted(spark, sf):
    return holdout.emitted(_folded(spark, sf, items=True), 0.05, score="qty")


@query(f"{HEAD}, {EMIT} SELECT cell_id, fold FROM em WHERE fold = 1")
def i14_emit_quadrant(spark, sf):
    """One quadrant's dots: its best cells up to a share of it."""
    return _emitted(spark, sf).where("fold = 1").select("cell_id", "fold")


@query(f"{RHEAD}, {QUADS}, {EMIT}, {MODES} SELECT mode, round(dti, 6) AS dti FROM sc WHERE fold = 1")
def i15_score_quadrant(spark, sf):
    """One quadrant's dots against all its labels, and against the hidden ones with the known left out."""
    f = _folded(spark, sf)
    t = holdout.quadrant_truths(truth(f), spec(spark, sf).width).where("fold = 1")
    return holdout.quadrant_scores(_emitted(spark, sf).where("fold = 1"), t).where("fold = 1").select("mode", F.round("dti", 6).alias("dti"))


@query(f"{RHEAD}, {QUADS}, {EMIT}, {MODES} SELECT mode, fold, round(dti, 6) AS dti FROM sc UNION ALL SELECT mode, NULL, round(avg(dti), 6) FROM sc GROUP BY mode")
def i17_evaluate_by_quadrant(spark, sf):
    """Every quadrant in both modes, and the means."""
    f = _folded(spark, sf)
    t = holdout.quadrant_truths(truth(f), spec(spark, sf).width)
    return holdout.quadrant_scores(_emitted(spark, sf), t).select("mode", "fold", F.round("dti", 6).alias("dti"))


@query()
def i11_emit_crests(spark, sf):
    """The best crests of each fold up to a share of the fold."""
    f, w = _folded(spark, sf, items=True), spec(spark, sf).width
    crest = ridges(dense(cells(spark, sf, items=True), w, w), "qty", 1.0, (w, w))
    return holdout.emitted(f, 0.05, crests=crest, score="qty").select("cell_id", "fold")


@query()
def i13_emit_and_score_crests(spark, sf):
    """Crests emitted and scored in both modes."""
    f, w = _folded(spark, sf, items=True), spec(spark, sf).width
    crest = ridges(dense(cells(spark, sf, items=True), w, w), "qty", 1.0, (w, w))
    t = holdout.quadrant_truths(truth(f), w)
    return holdout.quadrant_scores(holdout.emitted(f, 0.05, crests=crest, score="qty"), t).select("mode", "fold", F.round("dti", 6).alias("dti"))


def _drawn(names: str, point: str, draws: int, seed: int, source: str) -> str:
    """CTEs that draw blocks of `source` (y, x, names) with replacement; ci (lo, hi) of `point`."""
    sums = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in names.split())
    over = ", ".join(f"sum({c}) AS {c}" for c in names.split())
    return f"""act AS (SELECT DISTINCT y // 10 AS ty, x // 10 AS tx FROM fp), bl AS (SELECT ty, tx, {sums} FROM act LEFT JOIN (SELECT *, y // 10 AS ty, x // 10 AS tx FROM {source}) USING (ty, tx) GROUP BY ALL),
nb AS (SELECT count(*) AS n FROM bl), nr AS (SELECT *, row_number() OVER (ORDER BY ty, tx) - 1 AS i FROM bl),
dr AS (SELECT d.d AS draw, CAST('0x' || substr(md5('{seed}:' || d.d || ':' || s.s), 1, 12) AS BIGINT) % n AS i FROM range({draws}) d(d), nb, range(n) s(s)),
bs AS (SELECT draw, {over} FROM dr JOIN nr USING (i) GROUP BY draw), ci AS (SELECT round(quantile_cont({point}, 0.025), 6) AS lo, round(quantile_cont({point}, 0.975), 6) AS hi FROM bs)"""


DTI = "{p}tp / ({p}tp + 0.2 * {p}fp + 0.8 * {p}fn + 1e-7)"
_SUMMARY = f"""rows_ AS (SELECT fold, {SUMS} FROM u GROUP BY ROLLUP(fold)), nt AS (SELECT fold, count(*) AS n_truth FROM t GROUP BY ROLLUP(fold))
SELECT r.fold, tp, fp, fn, dti, coalesce(n_truth, 0) AS n_truth, CASE WHEN r.fold IS NULL THEN lo END AS lo, CASE WHEN r.fold IS NULL THEN hi END AS hi FROM rows_ r LEFT JOIN nt ON r.fold IS NOT DISTINCT FROM nt.fold, ci"""


@query(f"{HEAD}, {BY_FOLD}, {_drawn('tp fp fn', DTI.format(p=''), 500, 11, 'u')}, {_SUMMARY}")
def i06_summarise(spark, sf):
    """A row a fold and the pooled row with its interval."""
    f = _folded(spark, sf)
    got = holdout.summary(prediction(f), truth(f), f, size=10, draws=500, seed=11)
    return got.select("fold", *[F.round(c, 6).alias(c) for c in ("tp", "fp", "fn", "dti")], "n_truth", "lo", "hi")


_PAIR = f"""ua AS (WITH {BY_FOLD} SELECT * FROM u), ub AS (WITH {OTHER} SELECT * FROM u),
ab AS (SELECT y, x, fold, tp AS atp, fp AS afp, fn AS afn, 0 AS btp, 0 AS bfp, 0 AS bfn FROM ua UNION ALL SELECT y, x, fold, 0, 0, 0, tp, fp, fn FROM ub),
pf AS (SELECT fold, sum(atp) / (sum(atp) + 0.2 * sum(afp) + 0.8 * sum(afn) + 1e-7) - sum(btp) / (sum(btp) + 0.2 * sum(bfp) + 0.8 * sum(bfn) + 1e-7) AS d FROM ab GROUP BY fold),
po AS (SELECT sum(atp) / (sum(atp) + 0.2 * sum(afp) + 0.8 * sum(afn) + 1e-7) AS candidate, sum(btp) / (sum(btp) + 0.2 * sum(bfp) + 0.8 * sum(bfn) + 1e-7) AS baseline FROM ab)"""


@query(f"""{HEAD}, {_PAIR}, {_drawn('atp afp afn btp bfp bfn', f"({DTI.format(p='a')} - {DTI.format(p='b')})", 500, 13, 'ab')}
SELECT round(candidate, 6) AS candidate, round(baseline, 6) AS baseline, round(candidate - baseline, 6) AS delta, lo, hi, lo > 0 AS positive, (SELECT count(*) FROM pf WHERE d > 0) AS wins, (SELECT count(*) FROM pf) AS folds, (SELECT round(min(d), 6) FROM pf) AS min_delta FROM po, ci""")
def i07_paired_interval(spark, sf):
    """Two predictions against the same folds: the pooled difference with the interval of paired draws."""
    f = _folded(spark, sf)
    got = holdout.paired(prediction(f), f.where("p = '3-MEDIUM' AND st = 'O'"), truth(f), f, size=10, draws=500, seed=13)
    return got.select(*[F.round(c, 6).alias(c) for c in ("candidate", "baseline", "delta")], "lo", "hi", "positive", "wins", "folds", F.round("min_delta", 6).alias("min_delta"))


_MID = "rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS mid"
_AREA = "round((sum(mid) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / nullif(count(*) FILTER (pos) * count(*) FILTER (NOT pos), 0), 6) AS auc"


@query(f"""{HEAD}, s AS (SELECT fold, p = '1-URGENT' AS pos, v, qty, CASE WHEN p <> '1-URGENT' THEN disc END AS gap FROM f),
lo AS (SELECT fold, pos, 'v' AS feature, coalesce(v, 0) AS value, v IS NOT NULL AS there FROM s UNION ALL SELECT fold, pos, 'qty', coalesce(qty, 0), qty IS NOT NULL FROM s UNION ALL SELECT fold, pos, 'gap', coalesce(gap, 0), gap IS NOT NULL FROM s),
b AS (SELECT fold, pos, feature, 'value' AS what, value::DOUBLE AS x FROM lo UNION ALL SELECT fold, pos, feature, 'there', there::INTEGER FROM lo),
mp AS (SELECT *, {_MID.format(by='feature, what')} FROM b), mf AS (SELECT *, {_MID.format(by='feature, what, fold')} FROM b),
po AS (SELECT feature, what, {_AREA} FROM mp GROUP BY ALL), ea AS (SELECT feature, what, fold, {_AREA} FROM mf GROUP BY ALL),
wo AS (SELECT feature, max(greatest(auc, 1 - auc)) AS extremity FROM (SELECT feature, auc FROM po UNION ALL SELECT feature, auc FROM ea) GROUP BY feature)
SELECT feature, max(auc) FILTER (what = 'value') AS auc, max(auc) FILTER (what = 'there') AS presence_auc, any_value(round(extremity, 6)) AS extremity, any_value(extremity > 0.9) AS suspected FROM po JOIN wo USING (feature) GROUP BY feature""")
def i08_canary(spark, sf):
    """Every band's AUC and its presence's, pooled and by fold, in both polarities; a band missing on all labels is suspected."""
    f = _folded(spark, sf, items=True).withColumn("pos", F.col("p") == "1-URGENT").withColumn("gap", F.when(~F.col("pos"), F.col("disc")))
    got = holdout.canary(f, ["v", "qty", "gap"], "pos", "fold")
    return got.select("feature", "auc", "presence_auc", F.round("extremity", 6).alias("extremity"), "suspected")


@query(f"{HEAD}, {BY_FOLD}, z AS (SELECT fold, sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-7) AS d FROM u GROUP BY fold) SELECT count(*) AS folds, round(avg(d), 6) AS mean, round(min(d), 6) AS worst, round(max(d), 6) AS best FROM z")
def i12_fold_means(spark, sf):
    """The unweighted mean over folds, its worst and best."""
    f = _folded(spark, sf)
    by = metric.scored(metric.owned(prediction(f), truth(f), ("fold",)), ("fold",))
    return by.agg(F.count("*").alias("folds"), F.round(F.avg("dti"), 6).alias("mean"), F.min("dti").alias("worst"), F.max("dti").alias("best"))


@query(f"{RHEAD}, {COMPS} SELECT count(*) AS cells, count(DISTINCT comp) AS components FROM comp")
def i06_withheld(spark, sf):
    """How many label cells and whole components are withheld over all folds."""
    fp = footprint(spark, sf)
    c = components(truth(fp), spec(spark, sf).width)
    return c.agg(F.count("*").alias("cells"), F.count_distinct("comp").alias("components"))


@query()
def i22_bridge_protocol(spark, sf):
    """Spaced dots of each fold off its visible labels, scored against its hidden ones over blocks."""
    f, w = _folded(spark, sf), spec(spark, sf).width
    table = folds.fold_cells(f, truth(f), w, 3)
    dots = None
    scores = f.select("y", "x", "cell_id", "v")
    total = f.count()
    for k in range(4):
        part = table.where(F.col("fold") == k)
        free = scores.join(part.where("valid AND NOT visible").select("y", "x"), ["y", "x"], "left_semi")
        budget = round(0.03 * total * part.where("valid").count() / total)
        got = emit.poisson(free, "v", "cell_id", spacing=3.0, k=budget).select("y", "x").withColumn("fold", F.lit(k))
        dots = got if dots is None else dots.unionByName(got)
    got = holdout.bridged(dots, table.where("truth").select("y", "x", "fold"), table.where("valid"), size=20, draws=500, seed=17)
    return got.select(F.round("dti", 6).alias("dti"), "lo", "hi")


@query(f"{HEAD}, dr AS (SELECT * FROM range(3) d(draw)), a AS (SELECT draw, fold, avg(v) AS m FROM f, dr WHERE (cell_id + draw) % 3 = 0 GROUP BY ALL), b AS (SELECT draw, avg(m) AS m FROM a GROUP BY draw) SELECT round(avg(m), 6) AS mean, round(min(m), 6) AS least, round(max(m), 6) AS most, count(*) AS draws FROM b")
def i24_draw_means(spark, sf):
    """A value's mean by draw and fold, then over the folds, then over the draws."""
    f = _folded(spark, sf).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((F.col("cell_id") + F.col("draw")) % 3 == 0)
    by = f.groupBy("draw", "fold").agg(F.avg("v").alias("m")).groupBy("draw").agg(F.avg("m").alias("m"))
    return by.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.min("m"), 6).alias("least"), F.round(F.max("m"), 6).alias("most"), F.count("*").alias("draws"))

