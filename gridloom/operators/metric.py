"""The distance-weighted Tversky metric, exact, as joins.

A kernel of 25 offsets carries credit. The sparse sides scatter to it; truth and predictions meet
in equi-joins by cell (and fold), so a plan's cost follows the dots, not the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalar import hashed, tversky
from gridloom.operators.stencil import scatter, triangular


def credit(mask: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(y, x, w): the largest kernel weight that any mask cell gives to a cell."""
    return scatter(mask.select("y", "x", *by), triangular()).groupBy("y", "x", *by).agg(F.max("w").alias("w"))


def owned(pred: DataFrame, truth: DataFrame, by: tuple[str, ...] = (), soft: str | None = None) -> DataFrame:
    """(y, x, by, tp, fp, fn): truth cells own their credit and loss, predictions their distance.

    soft: a column of pred in [0, 1] that scales credit and false positives.
    """
    keys = ["y", "x", *by]
    p = pred.select(*keys, (F.col(soft) if soft else F.lit(1.0)).alias("__p"))
    given = scatter(p, triangular()).groupBy(*keys).agg(F.max(F.col("w") * F.col("__p")).alias("c"))
    t = truth.select(*keys).join(given, keys, "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    t = t.select(*keys, F.col("c").alias("tp"), F.lit(0.0).alias("fp"), (1 - F.col("c")).alias("fn"))
    q = p.join(credit(truth, by), keys, "left")
    q = q.select(*keys, F.lit(0.0).alias("tp"), (F.col("__p") * (1 - F.coalesce("w", F.lit(0.0)))).alias("fp"), F.lit(0.0).alias("fn"))
    return t.unionByName(q)


def scored(parts: DataFrame, by: tuple[str, ...] = (), *, rollup: bool = False) -> DataFrame:
    """tp, fp, fn, dti summed by the keys; with rollup also pooled over them in the same pass."""
    grouped = parts.rollup(*by) if rollup else parts.groupBy(*by)
    s = grouped.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    dti = tversky(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select(*by, *[F.round(c, 6).alias(c) for c in ("tp", "fp", "fn")], F.round(dti, 6).alias("dti"))


def tiles(parts: DataFrame, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn by square tile."""
    return parts.groupBy(*by, F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def bootstrap(rows: DataFrame, columns: list[str], *, draws: int, seed: int) -> DataFrame:
    """(draw, sums): in each draw as many rows as there are, picked with replacement by a hash.

    The rows are numbered and small in number (tiles); draws times rows picks are made in parallel and
    meet the rows by number.
    """
    n = rows.count()
    numbered = rows.withColumn("__i", F.row_number().over(Window.orderBy(*[c for c in rows.columns if c not in columns])) - 1)
    picks = rows.sparkSession.range(draws * max(n, 1)).where(F.lit(n > 0))
    picks = picks.select(F.floor(F.col("id") / max(n, 1)).alias("draw"), (F.col("id") % max(n, 1)).alias("slot"))
    picks = picks.withColumn("__i", (hashed(F.lit(seed), "draw", "slot") % max(n, 1)).cast("int"))
    return picks.join(numbered, "__i").groupBy("draw").agg(*[F.sum(c).alias(c) for c in columns])


def interval(drawn: DataFrame, value: str) -> DataFrame:
    """lo, hi: the central 95 % of a drawn value."""
    q = F.percentile(F.col(value), [0.025, 0.975])
    return drawn.agg(q.alias("q")).select(F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))
