"""Estimators over the order grid; fitted models have no SQL twin and are tested for what they must satisfy."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import boosting, emit, folds, models, tiles
from gridloom.operators.boosting import Settings
from gridloom.operators.distance import apart, written
from gridloom.operators.stencil import dense, gaussian_taps, ridges
from gridloom.plans.registry import query
from gridloom.plans.select_queries import _hash
from gridloom.plans.stencil_queries import DENSE, conv_sql
from gridloom.sources.cells import GRID_SQL, cells, footprint, spec, truth


def _rows(spark, sf):
    fp = folds.quadrants(footprint(spark, sf, items=True))
    return fp.select("cell_id", "fold", "v", "qty", "disc", F.floor(F.col("y") / 20).alias("block"), (F.col("p") == "1-URGENT").cast("double").alias("label"))


#: Few and shallow trees: the queries show the operator, its settings scale it up.
BRIEF = Settings(rounds=3, rate=0.1, leaves=7, least=20, l2=5.0, depth=3)


@query()
def k06_boosted_trees(spark, sf):
    """Probability of the label in fold 0 by trees fitted on the others; missing quantities are a bin of their own."""
    r = _rows(spark, sf)
    return models.boosted(r.where("fold <> 0"), r.where("fold = 0"), ["v", "qty", "disc"], "label", BRIEF).select("cell_id", F.round("p", 6).alias("p"))


@query()
def k07_spatial_cv_auc(spark, sf):
    """AUC of each fold under trees that saw neither the fold nor any block it touches."""
    return models.fold_auc(_rows(spark, sf), ["v", "qty"], "label", "fold", BRIEF, "block")


@query()
def k08_classifier_test(spark, sf):
    """Cross-fitted AUC against labels turned by whole blocks."""
    got = models.classifier_test(_rows(spark, sf), ["v", "qty"], "label", "fold", "block", "cell_id", draws=4, seed=5, settings=replace(BRIEF, rounds=2))
    return got.select(*[F.round(c, 4).alias(c) for c in ("observed", "null_mean", "null_top", "p")])


@query(f"""WITH {GRID_SQL}, r AS (SELECT y // 20 AS block, p = '1-URGENT' AS lab, v FROM fp), dr AS (SELECT unnest(range(-1, 19)) AS d),
x AS (SELECT d, v, CASE WHEN d >= 0 AND {_hash('5', 'd', 'block')} % 2 = 1 THEN NOT lab ELSE lab END AS lab FROM r, dr),
gaps AS (SELECT d, round(abs(avg(v) FILTER (lab) - avg(v) FILTER (NOT lab)), 6) AS gap FROM x GROUP BY d)
SELECT round(max(gap) FILTER (d < 0), 4) AS observed, round(avg(gap) FILTER (d >= 0), 4) AS null_mean, (1 + count(*) FILTER (d >= 0 AND gap >= (SELECT gap FROM gaps WHERE d < 0))) / 20.0 AS p FROM gaps""")
def k08_two_sample_test(spark, sf):
    """Difference of means between the classes against flips by block."""
    got = models.two_sample(_rows(spark, sf), "v", "label", "block", draws=19, seed=5)
    return got.select(F.round("observed", 4).alias("observed"), F.round("null_mean", 4).alias("null_mean"), "p")


@query()
def k09_spline_residuals(spark, sf):
    """qty less its mean given price, fitted on folds other than 0."""
    r = _rows(spark, sf)
    return models.residuals(r, "v", "qty", "res", train=F.col("fold") != 0).select("cell_id", F.round("res", 6).alias("res"))


@query()
def k10_spline_basis(spark, sf):
    g = cells(spark, sf)
    knots = models.quantile_knots(g, "v")
    return g.select("cell_id", *[F.round(b, 6).alias(f"b{i}") for i, b in enumerate(models.spline(F.col("v"), knots))])


def _learning_rows(rows, ratio):
    """All labels outside fold 0, and of the cells outside it that lie off every label a hash sample of `ratio` a label."""
    known = rows.where("fold <> 0")
    pos = known.where("label = 1")
    off = apart(known.where("label = 0"), pos, 1)
    return pos.unionByName(emit.sample(off, "cell_id", ratio * pos.count(), 29))


@query()
def k36_calibrated_trees(spark, sf):
    """Trees fitted on five of six blocks, isotonic calibration on the sixth, scores in fold 0."""
    r = _placed(spark, sf)
    learn = _learning_rows(r, 3).withColumn("held", F.pmod(F.xxhash64("by_", "bx"), F.lit(6)) == 0)
    trees = boosting.fit(learn.where("NOT held"), ["v", "qty"], "label", BRIEF)
    both = models.calibrated(trees.predict(learn.where("held"), "p"), trees.predict(r.where("fold = 0"), "p"), "p", "label", "c")
    return both.select("cell_id", F.round(F.least(F.greatest("c", F.lit(0.0)), F.lit(1.0)), 6).alias("p"))


def _placed(spark, sf):
    """Rows with their places and 20-cell blocks."""
    fp = folds.quadrants(footprint(spark, sf, items=True))
    return fp.select("cell_id", "y", "x", "fold", "v", "qty", "disc", F.floor(F.col("y") / 20).alias("by_"), F.floor(F.col("x") / 20).alias("bx"), (F.col("p") == "1-URGENT").cast("double").alias("label"))


def _surface(scored, n):
    """Scores of fold 0 on the whole square, null elsewhere."""
    return dense(scored.select("y", "x", "p"), *n)


@query()
def k37_ridge_baseline(spark, sf):
    """Trees, then the crests of their surface in fold 0 off the labels, best first up to a share of its cells."""
    r, n = _placed(spark, sf), (spec(spark, sf).width,) * 2
    trees = boosting.fit(_learning_rows(r, 3), ["v", "qty"], "label", BRIEF)
    scored = trees.predict(r.where("fold = 0"), "p")
    crest = ridges(_surface(scored, n), "p", 1.0, n).join(r.where("fold = 0 AND label = 0").select("y", "x", "cell_id"), ["y", "x"])
    k = round(0.0245 * r.where("fold = 0 AND label = 0").count())
    return emit.top_positive(crest, "p", "cell_id", k).select("cell_id", F.round("p", 6).alias("p"))


ZERO = "{c}"  # nothing beyond the border


@query(f"""WITH {DENSE}, lab AS (SELECT y, x FROM fp WHERE p = '1-URGENT'), o AS (SELECT d.y, d.x, d.w, CAST(lab.y IS NOT NULL AS DOUBLE) AS o FROM dn d LEFT JOIN lab USING (y, x)),
{conv_sql('o', 'o', 'o', gaussian_taps(2.0), ZERO, 's2')}, {conv_sql('o', 'o', 'o', gaussian_taps(5.0), ZERO, 's5')},
dd AS (SELECT o.y, o.x, min((o.y - lab.y) ** 2 + (o.x - lab.x) ** 2) AS d2 FROM o, lab GROUP BY ALL)
SELECT dd.y, dd.x, round(ln(1 + sqrt(d2) * 0.1), 6) AS log_distance, round(s2.o, 6) AS density_0, round(s5.o, 6) AS density_1 FROM dd JOIN s2 USING (y, x) JOIN s5 USING (y, x)""")
def e32_label_features(spark, sf):
    """Log distance to the labels and their density at two widths."""
    n = (spec(spark, sf).width,) * 2
    got = models.label_features(dense(cells(spark, sf), *n), truth(footprint(spark, sf)), n, (2.0, 5.0))
    return got.select("y", "x", *[F.round(c, 6).alias(c) for c in ("log_distance", "density_0", "density_1")])


@query()
def k42_label_feature_trees(spark, sf):
    """Trees on static bands and on features of the visible labels alone, six background cells a label; scores in fold 0."""
    r, n = _placed(spark, sf), (spec(spark, sf).width,) * 2
    visible = r.where("fold <> 0 AND label = 1").select("y", "x")
    feats = models.label_features(dense(cells(spark, sf), *n), visible, n, (2.0, 5.0))
    rows = written(r.join(feats, ["y", "x"]))  # every pass reads it again
    names = ["v", "qty", "disc", "log_distance", "density_0", "density_1"]
    trees = boosting.fit(written(_learning_rows(rows, 6)), names, "label", replace(BRIEF, rate=0.08))
    return trees.predict(rows.where("fold = 0"), "p").select("cell_id", F.round("p", 6).alias("p"))


@query()
def k43_pair_trees(spark, sf):
    """Trees on bands and their values on both sides of each cell, three background cells a label; scores in fold 0."""
    r, n = _placed(spark, sf), (spec(spark, sf).width,) * 2

    def pairs(z):
        same = np.fmin(z["v"], z["qty"])
        best = np.full(same.shape, np.nan)
        for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1)):
            for k in (1, 2, 3):
                for s in (k, -k):
                    best = np.fmax(best, np.minimum(z["v"], tiles.moved(z["qty"], s * dy, s * dx, "constant")))
        return {"pair_same": same, "pair_offset": best}

    z = cells(spark, sf, items=True).select("y", "x", (F.col("v") / 10000).alias("v"), "qty")
    feats = tiles.tiled(z, ["v", "qty"], pairs, ["pair_same", "pair_offset"], n, halo=3)
    rows = r.join(feats, ["y", "x"], "left")
    trees = boosting.fit(_learning_rows(rows, 3), ["v", "qty", "pair_same", "pair_offset"], "label", BRIEF)
    return trees.predict(rows.where("fold = 0"), "p").select("cell_id", F.round("p", 6).alias("p"))
