"""Similarity against a registry of earlier results: overlap of dots, rank correlation, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.stencil import disc, scatter


def overlap(dots: DataFrame, registry: DataFrame, radius: float = 3.0) -> DataFrame:
    """(entry, n_dots, n_ref, forward, backward): shares of dots within radius of each entry's dots, and back.

    Each side scatters its discs once; equality by cell replaces a search for neighbours.
    """
    d = dots.select("y", "x").distinct()
    n = d.agg(F.count("*").alias("n_dots"))
    fwd = d.join(scatter(registry.select("y", "x", "entry"), disc(radius)).select("y", "x", "entry").distinct(), ["y", "x"]).groupBy("entry").agg(F.count("*").alias("hit"))
    disc_of_dots = scatter(d, disc(radius)).select("y", "x").distinct()
    size = registry.groupBy("entry").agg(F.count("*").alias("n_ref"))
    back = registry.join(disc_of_dots, ["y", "x"], "left_semi").groupBy("entry").agg(F.count("*").alias("hit_ref"))
    out = size.join(fwd, "entry", "left").join(back, "entry", "left").join(F.broadcast(n))
    share = lambda a, b: F.round(F.coalesce(a, F.lit(0)) / F.nullif(b, F.lit(0)), 6)
    return out.select("entry", "n_dots", "n_ref", share(F.col("hit"), F.col("n_dots")).alias("forward"), share(F.col("hit_ref"), F.col("n_ref")).alias("backward"))


def midrank(value: str, by: tuple[str, ...] = ()) -> Column:
    """Average rank of ties, from 1."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def pearson(a: str, b: str) -> Column:
    """Correlation as an aggregate; null if either side is constant."""
    # corr itself divides by zero where a side is constant
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def spearman(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation over rows where both are there; null if either is constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.withColumn("__a", midrank(a, by)).withColumn("__b", midrank(b, by))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(pearson("__a", "__b"), 6).alias("rho"))


def duplicate(rho: Column, share: Column) -> Column:
    """Strictly over 0.90 in rank correlation or 0.70 in overlap; null does not count."""
    return F.coalesce(rho > 0.90, F.lit(False)) | F.coalesce(share > 0.70, F.lit(False))


def covered(cells: DataFrame, dots: DataFrame, radius: float = 3.0) -> DataFrame:
    """One row: cells, covered, uncovered."""
    hit = scatter(dots.select("y", "x"), disc(radius)).select("y", "x").distinct().withColumn("h", F.lit(1))
    return cells.select("y", "x").join(hit, ["y", "x"], "left").agg(F.count("*").alias("cells"), F.count("h").alias("covered"), F.count_if(F.col("h").isNull()).alias("uncovered"))


def set_pairs(members: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, both, jaccard, subset): all pairs of named sets that share a cell."""
    size = members.groupBy("entry").agg(F.count("*").alias("n"))
    left = members.select("y", "x", F.col("entry").alias("a"))
    right = members.select("y", "x", F.col("entry").alias("b"))
    both = left.join(right, ["y", "x"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = both.join(size.select(F.col("entry").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("entry").alias("b"), F.col("n").alias("n_b")), "b")
    return out.select("a", "b", "n_a", "n_b", "both", F.round(F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")), 6).alias("jaccard"), ((F.col("both") == F.col("n_a")) | (F.col("both") == F.col("n_b"))).alias("subset"))
