"""Vectors burned into cells, and the distance to them.

Each edge gives the cells that it touches row by row: within one row of cells a segment covers one run of columns, so work follows
the cells touched, and no cell is tested against every edge. Polygons' insides are runs between crossings of the
rows' middle lines. Cell (y, x) covers [y, y + 1) x [x, x + 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.distance import transform, written

ENDS = ("ay", "ax", "by", "bx")


def _whole(c: Column) -> Column:
    return F.floor(c).cast("long")


def touched(edges: DataFrame, n: tuple[int, int], *, padding: int = 0) -> DataFrame:
    """(y, x): distinct cells that any edge (ay, ax, by, bx) touches, of a grid with `padding` more cells on every side; edges with a
    null or NaN end are left out."""
    good = F.lit(True)
    for c in ENDS:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    e = edges.select(*[F.col(c).cast("double").alias(c) for c in ENDS]).where(good)
    down = F.col("ay") <= F.col("by")
    e = e.select(*[F.when(down, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("ay", "by"), ("ax", "bx"), ("by", "ay"), ("bx", "ax"))])
    low, high = F.greatest(_whole(F.col("ay")), F.lit(-padding)), F.least(_whole(F.col("by")), F.lit(n[0] + padding - 1))
    e = e.where(low <= high).withColumn("y", F.explode(F.sequence(low, high)))
    flat = F.col("by") == F.col("ay")
    at = lambda v: F.col("ax") + (v - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    p = F.when(flat, F.col("ax")).otherwise(at(F.greatest(F.col("ay"), F.col("y").cast("double"))))
    q = F.when(flat, F.col("bx")).otherwise(at(F.least(F.col("by"), F.col("y") + 1.0)))
    left, right = F.greatest(_whole(F.least(p, q)), F.lit(-padding)), F.least(_whole(F.greatest(p, q)), F.lit(n[1] + padding - 1))
    return e.select("y", left.alias("l"), right.alias("r")).where("l <= r").select("y", F.explode(F.sequence("l", "r")).alias("x")).distinct()


def inside(edges: DataFrame, n: tuple[int, int], *, padding: int = 0) -> DataFrame:
    """(y, x): cells whose middle lies inside polygons (poly, ay, ax, by, bx), holes left out: between each second crossing of a
    row's middle line and the next."""
    e = edges.select("poly", *[F.col(c).cast("double").alias(c) for c in ENDS]).where(F.col("ay") != F.col("by"))
    low = F.ceil(F.least("ay", "by") - 0.5).cast("long")
    high = (F.ceil(F.greatest("ay", "by") - 0.5) - 1).cast("long")
    low, high = F.greatest(low, F.lit(-padding)), F.least(high, F.lit(n[0] + padding - 1))
    e = e.where(low <= high).withColumn("y", F.explode(F.sequence(low, high)))
    at = F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    w = Window.partitionBy("poly", "y").orderBy("at")
    runs = e.select("poly", "y", at.alias("at")).withColumn("i", F.row_number().over(w)).withColumn("next", F.lead("at").over(w)).where("i % 2 = 1 AND next IS NOT NULL")
    left, right = F.greatest(F.ceil(F.col("at") - 0.5).cast("long"), F.lit(-padding)), F.least((F.ceil(F.col("next") - 0.5) - 1).cast("long"), F.lit(n[1] + padding - 1))
    return runs.select("y", left.alias("l"), right.alias("r")).where("l <= r").select("y", F.explode(F.sequence("l", "r")).alias("x")).distinct()


def distance(cells: DataFrame, seeds: DataFrame, n: tuple[int, int], padding: int) -> DataFrame:
    """cells, which lie in the grid, with d2, the squared distance to the nearest seed of a grid with `padding` more cells on every side.

    No seed at all, or a cell that a seed beyond the padding could be nearer to, is an error: the window of
    vectors was too small to certify the distance.
    """
    # a cell's distance needs its own row in full, over the columns of cells and seeds; the rest of the padding has only to hold the seeds
    inner = lambda c, size: F.col(c).between(-padding, size + padding - 1)
    seeds = written(seeds.where(inner("y", n[0]) & inner("x", n[1])).select("y", "x"))
    ends = seeds.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    low, high = (min(0, ends["low"]), max(n[1] - 1, ends["high"])) if ends["low"] is not None else (0, n[1] - 1)
    wide = high - low + 1
    rows = seeds.sparkSession.range(n[0] * wide).select(F.floor(F.col("id") / wide).alias("y"), (F.col("id") % wide + low).alias("x"))
    got = written(cells.join(transform(rows, seeds), ["y", "x"], "left"))
    far = got.agg(F.max("d2").alias("far"), F.count_if(F.col("d2").isNull()).alias("none")).first()
    if far["none"]:
        raise ValueError("no seed in the padded window")
    if padding and far["far"] is not None and far["far"] >= padding * padding:
        raise ValueError("the padded window is too narrow to certify the nearest distance")
    return got
