"""Spatial hold-out: quadrants, rotated sectors, hiding of whole components, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.distance import components, near


def _by_median(df: DataFrame, u: Column, v: Column, *, whole: bool) -> DataFrame:
    cut = (lambda c: F.floor(F.median(c))) if whole else F.median
    mid = df.agg(cut(u).alias("__u"), cut(v).alias("__v"))
    return df.join(F.broadcast(mid)).withColumn("__a", u < F.col("__u")).withColumn("__b", v < F.col("__v")).drop("__u", "__v")


def quadrants(df: DataFrame) -> DataFrame:
    """df with fold 0..3 by whole-number medians of y and x."""
    got = _by_median(df, F.col("y"), F.col("x"), whole=True)
    return got.withColumn("fold", F.when(F.col("__a") & F.col("__b"), 0).when(F.col("__a"), 1).when(F.col("__b"), 2).otherwise(3)).drop("__a", "__b")


def sectors(df: DataFrame, order: tuple[int, int, int, int] = (0, 1, 2, 3)) -> DataFrame:
    """df with fold by diamond sectors, medians of y + x and y - x; order names (--, -+, +-, ++)."""
    got = _by_median(df, F.col("y") + F.col("x"), F.col("y") - F.col("x"), whole=False)
    a, b, c, d = order
    return got.withColumn("fold", F.when(F.col("__a") & F.col("__b"), a).when(F.col("__a"), b).when(F.col("__b"), c).otherwise(d)).drop("__a", "__b")


def hidden(folds: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """(y, x, comp, fold): label cells hidden in each fold, whole components that touch it."""
    comp = components(labels, width)
    touch = comp.join(folds.select("y", "x", "fold"), ["y", "x"]).select("comp", "fold").distinct()
    return comp.join(touch, "comp").select("y", "x", "comp", "fold")


def fold_cells(folds: DataFrame, labels: DataFrame, width: int, buffer: int) -> DataFrame:
    """(fold, y, x, valid, train, visible, truth): the long fold table.

    valid: cells of the fold; truth: hidden label cells in it; visible: labels not hidden;
    train: cells outside the fold farther than `buffer` from every hidden label cell.
    """
    hide = hidden(folds, labels, width)
    kinds = folds.select("fold").distinct().withColumnRenamed("fold", "f")
    every = folds.select("y", "x", "fold").join(F.broadcast(kinds))  # the four folds
    every = every.withColumn("valid", F.col("fold") == F.col("f")).drop("fold").withColumnRenamed("f", "fold")
    marked = labels.select("y", "x").distinct().withColumn("label", F.lit(True))
    every = every.join(marked, ["y", "x"], "left").join(hide.select("y", "x", "fold", F.lit(True).alias("hid")), ["y", "x", "fold"], "left")
    parts = []
    for f in range(4):
        part = every.where(F.col("fold") == f)
        parts.append(near(part, hide.where(F.col("fold") == f), buffer))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    label, hid = F.coalesce("label", F.lit(False)), F.coalesce("hid", F.lit(False))
    return out.select("fold", "y", "x", "valid", (~F.col("valid") & F.col("d2").isNull()).alias("train"), (label & ~hid).alias("visible"), (hid & F.col("valid")).alias("truth"))


def gate(pairs: DataFrame, *, max_loss: float = 0.01, min_gain: float = 0.001) -> DataFrame:
    """One row from (fold, candidate, baseline): gains, wins, worst loss and the verdict."""
    gain = F.col("candidate") - F.col("baseline")
    s = pairs.agg(F.avg(gain).alias("mean_gain"), F.count_if(gain > 0).alias("wins"), F.min(gain).alias("worst"), F.count("*").alias("folds"))
    ok = (F.col("mean_gain") >= min_gain) & (4 * F.col("wins") >= 3 * F.col("folds")) & (F.col("worst") >= -max_loss)
    return s.select(F.round("mean_gain", 6).alias("mean_gain"), F.col("wins"), F.round("worst", 6).alias("worst"), ok.alias("passed"))


def auc(df: DataFrame, value: str, positive: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank-sum AUC of a value for a boolean class, midranks for ties; null if a class is empty."""
    rows = df.where(F.col(value).isNotNull())
    ties = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.count_if(F.col(positive)).alias("pos"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("mid", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    s = ties.groupBy(*by).agg(F.sum(F.col("mid") * F.col("pos")).alias("r"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    area = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))
    return s.select(*by, "pos", "neg", F.round(area, 6).alias("auc"))
