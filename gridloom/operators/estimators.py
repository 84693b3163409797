"""Fold estimators: residualise, grow trees, calibrate on background, sharpen along ridges, gate by regime.

Everything is fitted on training rows outside the fold: scales and conditional means of the columns that a nuisance drives,
trees on the residuals, a calibrator of their log odds on background rows, and the gates' medians and quartile ranges. What
comes back for the rows to predict is a surface on the grid and its products with the gates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import clip, expit, prior_shift
from gridloom.operators import boosting, tiles
from gridloom.operators import calibrate as cal
from gridloom.operators.boosting import Settings
from gridloom.operators.distance import written
from gridloom.operators.stencil import line_offsets, scatter, triangular


@dataclass(frozen=True)
class Channels:
    """Names of columns by what they are used for."""

    features: list[str]
    selective: list[str]
    nuisance: list[str]
    upflow: list[str]
    steps: list[str]
    steep: str
    slope: str
    relief: str
    covered: str


def strike_gain(a: np.ndarray, half: int = 4) -> np.ndarray:
    """The largest of eight along-strike means less their mean; borders repeat."""
    sums: dict[int, np.ndarray] = {}
    for az, _, dy, dx in line_offsets(8, half):
        sums[az] = sums.get(az, 0) + tiles.moved(a, dy, dx)
    means = np.stack([sums[i] for i in range(8)]) / (2 * half + 1)
    return np.maximum(means.max(0) - means.mean(0), 0.0)


def sharpened(df: DataFrame, value: str, out: str, n: tuple[int, int], half: int = 4) -> DataFrame:
    """(y, x, out) for the rows of df: 0.72 of a probability, and 0.28 of it times its gain along the best strike over the 99th
    percentile of the gains, up to 1.5. Cells that df lacks count as 0."""
    w = n[1]
    full = df.sparkSession.range(n[0] * w).select(F.floor(F.col("id") / w).alias("y"), (F.col("id") % w).alias("x"))
    p = df.select("y", "x", clip(F.coalesce(F.col(value), F.lit(0.0)), 0.0, 1.0).alias("__p"), F.lit(True).alias("__in"))
    grid = full.join(p, ["y", "x"], "left").select("y", "x", F.coalesce("__p", F.lit(0.0)).alias("__p"), F.coalesce("__in", F.lit(False)).cast("double").alias("__in"))
    got = tiles.tiled(grid, ["__p", "__in"], lambda z: {"g": strike_gain(z["__p"], half), "p": z["__p"], "on": z["__in"]}, ["g", "p", "on"], n, halo=half).where("on = 1")
    got = written(got)
    p99 = got.agg(F.greatest(F.percentile("g", 0.99), F.lit(1e-6)).alias("q")).first()["q"] or 1e-6  # one number
    boost = F.least(F.col("g") / p99, F.lit(1.5))
    return got.select("y", "x", F.least(F.lit(1.0), 0.72 * F.col("p") + 0.28 * F.col("p") * boost).alias(out))


def gates(train: DataFrame, ch: Channels) -> Column:
    """(0.3 + 0.7 upflow) (0.3 + 0.7 steps) (1 - 0.5 steep): means of sigmoids of training-scaled columns, 0.5 where one is missing."""
    scale = {r["name"]: r for r in cal.gate_scale(train, [*ch.upflow, *ch.steps, ch.steep]).collect()}  # a row a column

    def sig(c: str) -> Column:
        z = clip((F.col(c).cast("double") - float(scale[c]["median"])) / float(scale[c]["iqr"]), -6.0, 6.0)
        return F.coalesce(expit(z), F.lit(0.5))

    mean = lambda names: sum((sig(c) for c in names), F.lit(0.0)) / len(names)
    return (0.3 + 0.7 * mean(ch.upflow)) * (0.3 + 0.7 * mean(ch.steps)) * (1 - 0.5 * sig(ch.steep))


def _kept(df: DataFrame, ch: Channels) -> DataFrame:
    return df.withColumn("__slope", F.col(ch.slope)).withColumn("__relief", F.col(ch.relief))


def fold_surface(learn: DataFrame, background: DataFrame, target: DataFrame, ch: Channels, label: str, n: tuple[int, int], settings: Settings) -> DataFrame:
    """cell_id, y, x, sharp, conduit for the rows of target: calibrated, sharpened probabilities, and those times the gates."""
    residual = cal.Residualiser.fit(background, cal.Basis.fit(background, ch.nuisance), ch.selective, least=64)
    trees = boosting.fit(residual.transform(learn), ch.features, label, settings)
    seen = written(trees.predict(residual.transform(_kept(background, ch)), "__raw"))
    score = cal.relief_score(seen, "__slope", "__relief")
    calibrator = cal.Calibrator.fit(seen, "__raw", cal.Basis.fit(seen, ch.nuisance), more=[score, score * score, F.col(ch.covered).cast("double")])
    calibrator = calibrator.matched(seen, "__raw", ch.covered, cal.terciles(seen, score))
    gate = target.select("cell_id", gates(background, ch).alias("__gate"))
    done = calibrator.transform(trees.predict(residual.transform(_kept(target, ch)), "__raw"), "__raw", "__p", ch.covered)
    done = written(done.select("cell_id", "y", "x", "__p"))
    sharp = sharpened(done, "__p", "sharp", n)
    out = done.join(sharp, ["y", "x"]).join(gate, "cell_id")
    return out.select("cell_id", "y", "x", "sharp", (F.col("sharp") * F.col("__gate")).alias("conduit"))


def soft_labels(df: DataFrame, labels: DataFrame, out: str) -> DataFrame:
    """df with the largest kernel weight that any label gives to a cell, 0 beyond reach."""
    credit = scatter(labels.select("y", "x"), triangular()).groupBy("y", "x").agg(F.max("w").alias("__w"))
    return df.join(credit, ["y", "x"], "left").withColumn(out, F.coalesce("__w", F.lit(0.0))).drop("__w")


def split_view(learn: DataFrame, corridor: DataFrame, background: DataFrame, target: DataFrame, ch: Channels, kernel_features: list[str], label: str, soft: str, n: tuple[int, int], settings: Settings, *, population: tuple[float, float]) -> DataFrame:
    """cell_id, y, x, core, kernel, blend: two heads on one set of residuals.

    The core head is trees for the label, moved from the sample's prevalence to the population's; the kernel head is trees for the
    soft label by squared error, its mean moved in the same way. The blend leans on the core where `covered` (0.52) and on
    the kernel elsewhere (0.65). population: prevalence of the label and mean of the soft label.
    """
    residual = cal.Residualiser.fit(background, cal.Basis.fit(background, ch.nuisance), ch.selective, least=64)
    core = boosting.fit(residual.transform(learn), ch.features, label, settings)
    kernel = boosting.fit(residual.transform(corridor), kernel_features, soft, Settings(**{**vars(settings), "loss": "squared"}))
    heads = lambda d: kernel.predict(core.predict(residual.transform(_kept(d, ch)), "__core"), "__kernel").withColumn("__kernel", clip(F.col("__kernel"), 0.0, 1.0))
    seen = written(heads(background))
    score = cal.relief_score(seen, "__slope", "__relief")
    basis = cal.Basis.fit(seen, ch.nuisance)
    a = cal.Calibrator.fit(seen, "__core", basis, more=[score, score * score, F.col(ch.covered).cast("double")]).matched(seen, "__core", ch.covered, cal.terciles(seen, score))
    means = learn.agg(F.avg(label).alias("a")).first()["a"], corridor.agg(F.avg(soft).alias("b")).first()["b"]
    b = cal.Calibrator.fit(seen, "__kernel", basis, edge=1e-4, more=[score, score * score], sample_mean=means[1], population_mean=population[1])
    done = b.transform(a.transform(heads(target), "__core", "__q", ch.covered), "__kernel", "__mu")
    inside = lambda x: min(max(float(x), 1e-6), 1 - 1e-6)
    done = done.withColumn("__q", prior_shift(F.col("__q"), inside(population[0]), inside(means[0])))
    done = written(done.select("cell_id", "y", "x", F.col(ch.covered).alias("__has"), "__q", "__mu"))
    out = done.join(sharpened(done, "__q", "core", n), ["y", "x"]).join(sharpened(done, "__mu", "kernel", n), ["y", "x"])
    blend = F.when(F.col("__has"), 0.52 * F.col("core") + 0.48 * F.col("kernel")).otherwise(0.35 * F.col("core") + 0.65 * F.col("kernel"))
    return out.select("cell_id", "y", "x", "core", "kernel", blend.alias("blend"))
