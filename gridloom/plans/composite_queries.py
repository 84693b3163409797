"""Channels and reports made of several operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import calibrate, emit, estimators, folds, metric, tiles
from gridloom.operators.distance import written
from gridloom.operators.stencil import dense, ridges
from gridloom.plans.calibration_queries import _basis, _rows
from gridloom.plans.metric_queries import HEAD
from gridloom.plans.model_queries import BRIEF
from gridloom.plans.registry import query
from gridloom.plans.spatial_queries import _folder
from gridloom.plans.stencil_queries import grad_sql
from gridloom.plans.tile_queries import FILLED
from gridloom.sources import vectors
from gridloom.sources.cells import GRID_SQL, cells, footprint, spec, truth

TILT = f"""{FILLED}, e AS (SELECT greatest((0.1 * median(abs(b))) ** 2, 1e-12) AS e FROM q WHERE whole),
t AS (SELECT q.y, q.x, q.w, whole, CASE WHEN whole THEN (a - 75) / sqrt(b * b + e.e) ELSE 0 END AS r FROM q, e), th AS (SELECT *, atan(r) AS h FROM t),
gr AS (SELECT y, x, w, whole, r, {grad_sql('th', 'h', 'y', 'gy')}, {grad_sql('th', 'h', 'x', 'gx')} FROM th),
ok AS (SELECT c.y, c.x FROM gr c, range(-1, 2) i(a), range(-1, 2) j(b), gr n WHERE n.whole AND n.y = c.y + a AND n.x = c.x + b GROUP BY c.y, c.x HAVING count(*) = 9)"""


@query(f"WITH {TILT} SELECT gr.y, gr.x, round(1 / sqrt(1 + r * r), 6) AS cos_tilt, CASE WHEN ok.y IS NOT NULL THEN round(sqrt(gy * gy + gx * gx), 6) END AS grad_tilt FROM gr LEFT JOIN ok USING (y, x) WHERE whole")
def e25_tilt_channels(spark, sf):
    """Cosine of the tilt of a field's slope, and the gradient of the tilt where the whole 3 x 3 box is valid."""
    n = (spec(spark, sf).width,) * 2
    d = dense(cells(spark, sf, items=True), *n).select("y", "x", (F.coalesce("v", F.lit(0.0)) / 1000 - 75).alias("vg"), F.col("qty").alias("hg"), (F.col("v").isNotNull() & F.col("qty").isNotNull()).alias("whole"))
    eps = d.where("whole").agg(F.greatest(F.pow(0.1 * F.median(F.abs("hg")), F.lit(2)), F.lit(1e-12)).alias("e")).first()["e"] or 1e-12  # one number
    d = d.select("y", "x", F.when(F.col("whole"), F.col("vg") / F.sqrt(F.col("hg") * F.col("hg") + eps)).alias("r"))

    def channels(z):
        gy, gx = tiles.slopes(np.arctan(np.nan_to_num(z["r"])))
        return {"cos_tilt": 1 / np.sqrt(1 + z["r"] ** 2), "grad_tilt": np.where(tiles.whole_box(z["r"], 1), np.hypot(gy, gx), np.nan)}

    got = tiles.tiled(d, ["r"], channels, ["cos_tilt", "grad_tilt"], n, halo=2).where("cos_tilt IS NOT NULL")
    return got.select("y", "x", F.round("cos_tilt", 6).alias("cos_tilt"), F.round("grad_tilt", 6).alias("grad_tilt"))


@query()
def e25_curvature_ridges(spark, sf):
    """Negative curvature at two scales where the whole 21 x 21 box is valid; missing cells take the median meanwhile."""
    n = (spec(spark, sf).width,) * 2
    d = dense(cells(spark, sf, items=True), *n).select("y", "x", (F.col("v") / 1000).alias("a"))
    mid = d.agg(F.percentile_approx("a", 0.5).alias("m")).first()["m"] or 0.0  # one number

    def ridge(z):
        return {"ridge": np.where(tiles.whole_box(z["a"], 10), tiles.least_curvature(np.where(np.isnan(z["a"]), mid, z["a"])), np.nan)}

    return tiles.tiled(d, ["a"], ridge, ["ridge"], n, halo=20).where("ridge IS NOT NULL").select("y", "x", F.round("ridge", 6).alias("ridge"))


BOX = "(SELECT d.y, d.x, avg(n.{c}) AS m FROM q2 d, range(-4, 5) i(a), range(-4, 5) j(b), q2 n WHERE n.y = greatest(0, least(d.w - 1, d.y + a)) AND n.x = greatest(0, least(d.w - 1, d.x + b)) GROUP BY d.y, d.x)"


@query(f"""WITH {FILLED}, q2 AS (SELECT y, x, w, whole, a / 600 - b / 300 + 1 AS i, c / 10 AS u, b / 300 AS th FROM q), ok AS (SELECT c.y, c.x FROM q2 c, range(-4, 5) i(a), range(-4, 5) j(b), q2 n WHERE n.whole AND n.y = c.y + a AND n.x = c.x + b GROUP BY c.y, c.x HAVING count(*) = 81),
gr AS (SELECT y, x, {grad_sql('q2', 'th', 'y', 'gy')}, {grad_sql('q2', 'th', 'x', 'gx')} FROM q2),
r AS (SELECT q2.y, q2.x, exp(-4 * sqrt(gy * gy + gx * gx)) * (0.6 * greatest(0, least(1, i - mi.m)) + 0.4 * greatest(0, least(1, u - mu.m))) AS r FROM ok JOIN q2 USING (y, x) JOIN gr USING (y, x) JOIN {BOX.format(c='i')} mi USING (y, x) JOIN {BOX.format(c='u')} mu USING (y, x)),
p AS (SELECT greatest(quantile_cont(r, 0.95), 1e-6) AS p FROM r) SELECT y, x, round(greatest(0, least(1, r / p.p)), 6) AS value FROM r, p""")
def e28_alteration(spark, sf):
    """Excess of two ratios over their 9 x 9 means, damped where a third changes, over its 95th percentile; whole boxes only."""
    n = (spec(spark, sf).width,) * 2
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    d = dense(cells(spark, sf, items=True), *n)
    whole = F.col("v").isNotNull() & F.col("qty").isNotNull()
    d = d.select("y", "x", (zero("v") / 600_000 - zero("qty") / 300 + 1).alias("i"), (zero("disc") * 10).alias("u"), (zero("qty") / 300).alias("th"), F.when(whole, 1.0).alias("ok"))

    def raw(z):
        gy, gx = tiles.slopes(z["th"])
        over = lambda k: np.clip(z[k] - tiles.box_mean(z[k], 9), 0, 1)
        return {"r": np.where(tiles.whole_box(z["ok"], 4), np.exp(-4 * np.hypot(gy, gx)) * (0.6 * over("i") + 0.4 * over("u")), np.nan)}

    r = written(tiles.tiled(d, ["i", "u", "th", "ok"], raw, ["r"], n, halo=5).where("r IS NOT NULL"))
    p95 = r.agg(F.greatest(F.percentile("r", 0.95), F.lit(1e-6)).alias("p"))
    return r.join(F.broadcast(p95)).select("y", "x", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r") / F.col("p"))), 6).alias("value"))


@query()
def g24_select_ridges(spark, sf):
    """Crests on the whole support, off the labels, best first up to a share of the valid cells, with the counts of each step."""
    n, fp = (spec(spark, sf).width,) * 2, footprint(spark, sf, items=True)
    crest = ridges(dense(cells(spark, sf, items=True), *n), "qty", 1.0, n).select("y", "x").join(fp, ["y", "x"]).where("p <> '1-URGENT'")
    crest = written(crest.select("cell_id", "qty"))
    k = round(0.0245 * fp.count())
    got = emit.top_positive(crest, "qty", "cell_id", k)
    counts = crest.agg(F.count("*").alias("eligible")).withColumn("requested", F.lit(k))
    return got.select("cell_id", "qty").join(F.broadcast(counts))


@query("SELECT 'row-' || y AS line, count(*) AS points, round(sum(coalesce(sqrt((x - px) * (x - px) + (v - pv) * (v - pv)), 0)), 3) AS length, min(x)::DOUBLE AS west, max(x)::DOUBLE AS east FROM (SELECT y, x, v / 1000 AS v, lag(x) OVER w AS px, lag(v / 1000) OVER w AS pv FROM ("
       f"WITH {GRID_SQL} SELECT * FROM fp WHERE p = '1-URGENT') WINDOW w AS (PARTITION BY y ORDER BY x)) GROUP BY y")
def g07_line_summary(spark, sf):
    """A row a line read from vector files: points, length and extent; a file without the line field is an error."""
    fp = truth(footprint(spark, sf))
    points = F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), (F.col("v") / 1000).alias("y"))))  # one grid row
    rows = fp.groupBy("y").agg(points.alias("points")).select(F.format_string("area-%04d", F.floor(F.col("y") / 30)).alias("file"), F.concat(F.lit("row-"), F.col("y")).alias("name"), "points")
    folder = _folder(spark, "flights")
    written(vectors.write_shapes(rows, folder))
    got = vectors.read_shapes(spark, folder)
    line = F.coalesce(F.col("attributes")["name"], F.raise_error(F.concat(F.lit("no line field in "), "source")).cast("string"))
    pairs = F.zip_with(F.slice("points", F.lit(1), F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", F.lit(2), F.greatest(F.size("points") - 1, F.lit(0))), lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))
    length = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)
    xs = F.transform("points", lambda p: p["x"])
    return got.select(line.alias("line"), F.size("points").cast("long").alias("points"), F.round(length, 3).alias("length"), F.array_min(xs).alias("west"), F.array_max(xs).alias("east"))


@query(f"""{HEAD}, g3 AS (SELECT DISTINCT st FROM fp), tt AS (SELECT g3.st, y, x FROM g3, fp WHERE p = '1-URGENT'), pp AS (SELECT st, y, x FROM fp WHERE p = '2-HIGH'),
tp AS (SELECT t.st, t.y, t.x, coalesce(max(h.w), 0) AS c FROM tt t LEFT JOIN (SELECT st, y + dy AS y, x + dx AS x, w FROM pp, k) h ON t.st = h.st AND t.y = h.y AND t.x = h.x GROUP BY ALL),
fq AS (SELECT p.st, p.y, p.x, 1 - coalesce(max(h.w), 0) AS c FROM pp p LEFT JOIN (SELECT st, y + dy AS y, x + dx AS x, w FROM tt, k) h ON p.st = h.st AND p.y = h.y AND p.x = h.x GROUP BY ALL),
s AS (SELECT st, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT st, c AS tp, 0::DOUBLE AS fp, 1 - c AS fn FROM tp UNION ALL SELECT st, 0, c, 0 FROM fq) GROUP BY st)
SELECT st, round(tp / (tp + 0.2 * fp + 0.8 * fn + 1e-7), 6) AS dti, round(tp / greatest(tp + fn, 1), 6) AS coverage, round(fp / greatest(tp + fn, 1), 6) AS fp_per_truth FROM s""")
def h20_cell_scores(spark, sf):
    """Score, coverage and false credit a truth cell of each group of dots against one truth."""
    fp = footprint(spark, sf)
    groups = fp.select("st").distinct()
    t = truth(fp).select("y", "x").crossJoin(F.broadcast(groups))  # three groups
    s = metric.owned(fp.where("p = '2-HIGH'"), t, ("st",)).groupBy("st").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    n = F.greatest(F.col("tp") + F.col("fn"), F.lit(1.0))
    dti = F.col("tp") / (F.col("tp") + 0.2 * F.col("fp") + 0.8 * F.col("fn") + 1e-7)
    return s.select("st", F.round(dti, 6).alias("dti"), F.round(F.col("tp") / n, 6).alias("coverage"), F.round(F.col("fp") / n, 6).alias("fp_per_truth"))


#: Established controls of the registry; all other entries compete.
CONTROLS = {"5-LOW/F": "lattice_control", "4-NOT SPECIFIED/P": "uniform_control"}


@query(f"WITH {GRID_SQL}, e AS (SELECT p || '/' || st AS entry, count(*) AS dots FROM fp GROUP BY 1) SELECT entry, dots, CASE entry WHEN '5-LOW/F' THEN 'lattice_control' WHEN '4-NOT SPECIFIED/P' THEN 'uniform_control' ELSE 'competing_method_lane' END AS role FROM e")
def l08_registry_roles(spark, sf):
    """Entries of the registry by established controls alone, never by what a name suggests."""
    e = footprint(spark, sf).groupBy(F.concat_ws("/", "p", "st").alias("entry")).agg(F.count("*").alias("dots"))
    role = F.coalesce(*[F.when(F.col("entry") == k, v) for k, v in CONTROLS.items()], F.lit("competing_method_lane"))
    return e.select("entry", "dots", role.alias("role"))


@query()
def k27_unconditional_effect(spark, sf):
    """The fitted marginal effect of the nuisance: its mean, which is what stays in, and its range over the training rows."""
    _, train = _rows(spark, sf)
    c = calibrate.Calibrator.fit(train, "prob", _basis(train), edge=1e-4, bound=14.0)
    return train.agg(F.count("*").alias("rows"), F.round(F.lit(c.offset), 6).alias("mean_effect"), F.round(F.min(c.effect), 6).alias("least"), F.round(F.max(c.effect), 6).alias("most"))


def _fold_rows(spark, sf):
    """(rows, channels): the grid with its folds, two nuisances and a derived step; fold 0 is predicted."""
    half = spec(spark, sf).width / 2.0
    df = folds.quadrants(footprint(spark, sf, items=True))
    df = df.withColumns({
        "c1": F.abs(F.col("y") - half), "c2": F.abs(F.col("x") - half), "covered": F.col("ck") % 3 != 0, "label": (F.col("p") == "1-URGENT").cast("double"),
        "relief": F.col("disc") * 1000 - 50, "step": F.col("v") / (1 + F.coalesce("qty", F.lit(0.0))),
    })
    names = estimators.Channels(features=["v", "qty", "disc", "step"], selective=["qty", "disc"], nuisance=["c1", "c2"], upflow=["qty"], steps=["step", "v"], steep="disc", slope="qty", relief="relief", covered="covered")
    return written(df.select("cell_id", "y", "x", "fold", "label", "c1", "c2", "covered", "v", "qty", "disc", "relief", "step")), names


@query()
def k38_fold_surface(spark, sf):
    """Residuals, trees, calibration by relief, sharpening and gates; fitted outside fold 0, shown in it."""
    rows, names = _fold_rows(spark, sf)
    known = rows.where("fold <> 0")
    learn = known.where("label = 1").unionByName(emit.sample(known.where("label = 0"), "cell_id", 400, 37))
    got = estimators.fold_surface(learn, known.where("label = 0"), rows.where("fold = 0"), names, "label", (spec(spark, sf).width,) * 2, BRIEF)
    return got.select("cell_id", F.round("sharp", 6).alias("sharp"), F.round("conduit", 6).alias("conduit"))


@query()
def k39_split_view(spark, sf):
    """A core head and a kernel head on soft labels, each moved to the population's mean, blended by coverage."""
    rows, names = _fold_rows(spark, sf)
    known = rows.where("fold <> 0")
    soft = written(estimators.soft_labels(known, known.where("label = 1"), "soft"))
    learn = known.where("label = 1").unionByName(emit.sample(known.where("label = 0"), "cell_id", 400, 37))
    corridor = emit.sample(soft.where("soft > 0"), "cell_id", 300, 41).unionByName(emit.sample(soft.where("soft = 0"), "cell_id", 300, 43))
    means = soft.agg(F.avg("label").alias("a"), F.avg("soft").alias("b")).first()
    got = estimators.split_view(learn, corridor, known.where("label = 0"), rows.where("fold = 0"), names, ["v", "qty", "step"], "label", "soft", (spec(spark, sf).width,) * 2, BRIEF, population=(means["a"], means["b"]))
    return got.select("cell_id", *[F.round(c, 6).alias(c) for c in ("core", "kernel", "blend")])
