"""Residualisers and calibrators on the grid: fitted on one part, applied to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import calibrate as cal
from gridloom.plans.registry import query
from gridloom.sources.cells import footprint, spec

NUISANCE, KINDS = ["c1", "c2"], ["F", "O", "P"]


def _rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(all cells, training cells): nuisances c1 and c2, features v, qty, disc, prob, coverage."""
    half = spec(spark, sf).width / 2.0
    df = footprint(spark, sf, items=True)
    df = df.withColumns({"c1": F.abs(F.col("y") - half), "c2": F.abs(F.col("x") - half), "prob": F.col("v") / 600_000, "covered": F.col("ck") % 3 != 0})
    return df, df.where("(y + x) % 2 = 0")


def _basis(train: DataFrame, **options) -> cal.Basis:
    return cal.Basis.fit(train, NUISANCE, **options)


def _out(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("cell_id", *[F.round(c, 6).alias(c) for c in columns])


@query()
def k12_residualise(spark, sf):
    """All features: scaled, missing ones as the median, less the mean given the nuisance, clipped."""
    df, train = _rows(spark, sf)
    fit = cal.Residualiser.fit(train, _basis(train, category="st", kinds=KINDS), ["v", "qty", "disc"], alpha=60.0)
    return _out(fit.transform(df, fill=True, bound=8.0), "v", "qty", "disc")


@query()
def k13_selective_fit(spark, sf):
    """Scales of the named columns, from at least 64 known values each."""
    _, train = _rows(spark, sf)
    fit = cal.Residualiser.fit(train, _basis(train), ["qty", "disc"], least=64)
    rows = [F.struct(F.lit(c).alias("name"), F.round(F.lit(fit.median[c]), 6).alias("median"), F.round(F.lit(fit.scale[c]), 6).alias("scale")) for c in fit.median]
    return spark.range(1).select(F.inline(F.array(*rows)))


@query()
def k14_selective_transform(spark, sf):
    """Named columns lose the nuisance's part; nulls and other columns stay."""
    df, train = _rows(spark, sf)
    return _out(cal.Residualiser.fit(train, _basis(train), ["qty", "disc"], least=64).transform(df), "v", "qty", "disc")


@query()
def k15_null_preserving_fit(spark, sf):
    """Scales of all columns; regional ones also have a conditional mean."""
    _, train = _rows(spark, sf)
    fit = cal.Residualiser.fit(train, _basis(train), ["qty"], scaled=["v", "disc"])
    rows = [F.struct(F.lit(c).alias("name"), F.round(F.lit(fit.median[c]), 6).alias("median"), F.round(F.lit(fit.scale[c]), 6).alias("scale"), F.lit(c in fit.mean).alias("regional")) for c in fit.median]
    return spark.range(1).select(F.inline(F.array(*rows)))


@query()
def k16_null_preserving_transform(spark, sf):
    df, train = _rows(spark, sf)
    return _out(cal.Residualiser.fit(train, _basis(train), ["qty"], scaled=["v", "disc"]).transform(df), "v", "qty", "disc")


@query()
def k17_targeted_fit(spark, sf):
    _, train = _rows(spark, sf)
    fit = cal.Residualiser.fit(train, _basis(train, category="st", kinds=KINDS), ["qty"], alpha=60.0)
    return spark.range(1).select(F.lit("qty").alias("name"), F.round(F.lit(fit.median["qty"]), 6).alias("median"), F.round(F.lit(fit.scale["qty"]), 6).alias("scale"))


@query()
def k18_targeted_transform(spark, sf):
    """The named target is residualised, protected columns are the very same values."""
    df, train = _rows(spark, sf)
    fit = cal.Residualiser.fit(train, _basis(train, category="st", kinds=KINDS), ["qty"], alpha=60.0)
    return fit.transform(df, fill=True, bound=8.0).select("cell_id", "v", F.round("qty", 6).alias("qty"), "disc")


def _relief(spark, sf) -> tuple[DataFrame, DataFrame, Column]:
    df, train = _rows(spark, sf)
    return df, train, cal.relief_score(train, "qty", "disc")


def _stats(spark, c: cal.Calibrator) -> DataFrame:
    names = ("tier", "median_covered", "spread_covered", "median_gap", "spread_gap")
    rows = [F.struct(*[(F.lit(x) if i == 0 else F.round(F.lit(x), 6)).alias(n) for i, (n, x) in enumerate(zip(names, s, strict=True))]) for s in c.stats]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _by_relief(train: DataFrame, score: Column) -> cal.Calibrator:
    more = [score, score * score, F.col("covered").cast("double")]
    fit = cal.Calibrator.fit(train, "prob", _basis(train), more=more)
    return fit.matched(train, "prob", "covered", cal.terciles(train, score))


@query()
def k19_relief_fit(spark, sf):
    """Medians and spreads of log odds by relief tier and coverage, beside the nuisance's part."""
    _, train, score = _relief(spark, sf)
    return _stats(spark, _by_relief(train, score))


@query()
def k20_relief_transform(spark, sf):
    """Gap rows move, tier by tier, to the median and spread of covered ones."""
    df, train, score = _relief(spark, sf)
    return _out(_by_relief(train, score).transform(df, "prob", "calibrated", "covered"), "calibrated")


@query()
def k21_regime_fit(spark, sf):
    _, train = _rows(spark, sf)
    return _stats(spark, cal.Calibrator.fit(train, "prob", _basis(train)).matched(train, "prob", "covered"))


@query()
def k22_regime_transform(spark, sf):
    df, train = _rows(spark, sf)
    return _out(cal.Calibrator.fit(train, "prob", _basis(train)).matched(train, "prob", "covered").transform(df, "prob", "calibrated", "covered"), "calibrated")


def _by_terrain(train: DataFrame) -> cal.Calibrator:
    height = F.coalesce(F.abs(F.col("qty")), F.lit(0.0))
    return cal.Calibrator.fit(train, "prob", _basis(train)).matched(train, "prob", "covered", cal.terciles(train, height))


@query()
def k23_terrain_fit(spark, sf):
    _, train = _rows(spark, sf)
    return _stats(spark, _by_terrain(train))


@query()
def k24_terrain_transform(spark, sf):
    """As by relief, with strata of absolute relief alone."""
    df, train = _rows(spark, sf)
    return _out(_by_terrain(train).transform(df, "prob", "calibrated", "covered"), "calibrated")


def _by_kernel(train: DataFrame, score: Column) -> cal.Calibrator:
    means = train.agg(F.avg("prob").alias("s"), F.avg(F.when(F.col("covered"), F.col("prob")).otherwise(F.col("prob") / 2)).alias("p")).first()
    return cal.Calibrator.fit(train, "prob", _basis(train), edge=1e-4, more=[score, score * score], sample_mean=means["s"], population_mean=means["p"])


@query()
def k25_kernel_credit_fit(spark, sf):
    """The prior's shift from sample to population, and the mean of the nuisance's part."""
    _, train, score = _relief(spark, sf)
    c = _by_kernel(train, score)
    return spark.range(1).select(F.round(F.lit(c.shift), 6).alias("shift"), F.round(F.lit(c.offset), 6).alias("offset"))


@query()
def k26_kernel_credit_transform(spark, sf):
    df, train, score = _relief(spark, sf)
    return _out(_by_kernel(train, score).transform(df, "prob", "calibrated"), "calibrated")


@query()
def k27_unconditional_fit(spark, sf):
    """Mean of the marginal nuisance effect; its use clips log odds at 14."""
    df, train = _rows(spark, sf)
    c = cal.Calibrator.fit(train, "prob", _basis(train), edge=1e-4, bound=14.0)
    return _out(c.transform(df, "prob", "calibrated"), "calibrated")


@query()
def k34_conduit_gate_fit(spark, sf):
    """Median and quartile range of each gate column after the nuisance is out."""
    _, train = _rows(spark, sf)
    left = cal.Residualiser.fit(train, _basis(train), ["qty", "disc"]).transform(train)
    return cal.gate_scale(left, ["qty", "disc", "v"]).select("name", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))
