"""Exact distances, nearest fill, erosion and connected components on cell tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.stencil import Kernel, disc, scatter


def written(df: DataFrame) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir and read it back: it cuts lineage and outlives executors.

    Only a local session may leave the folder unset: its executors are the driver.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def near(df: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """df with d2, the squared distance to the nearest seed within radius, else null.

    The sparse seeds scatter to their disc; cells meet them in one equi-join.
    """
    d2 = F.col("__dy") * F.col("__dy") + F.col("__dx") * F.col("__dx")
    hit = scatter(seeds.select("y", "x", F.col("y").alias("__sy"), F.col("x").alias("__sx")), disc(radius))
    hit = hit.withColumn("__dy", F.col("y") - F.col("__sy")).withColumn("__dx", F.col("x") - F.col("__sx"))
    return df.join(hit.groupBy("y", "x").agg(F.min(d2).alias("d2")), ["y", "x"], "left")


def transform(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """Dense df with d2, the squared distance to the nearest seed anywhere; null if there is no seed.

    Two passes: the nearest seed in the own column by windows, each up to the row itself, then along each row
    the lower envelope of the columns' parabolas, in whole numbers. Work and memory of a row follow its width,
    whatever the distances; no row meets itself in a join. Seeds may lie outside df, if df's rows have all
    columns that seeds lie in.
    """
    places = lambda d: d.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna()
    g = places(df).withColumn("__here", F.lit(True)).join(places(seeds).distinct().withColumn("__seed", F.lit(True)), ["y", "x"], "full")
    # a frame that reaches to the end of a column costs the square of its length: this one turns the order round
    up, down = (Window.partitionBy("x").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("y"), F.desc("y")))
    y = F.when(F.col("__seed"), F.col("y"))
    above, below = F.col("y") - F.last(y, ignorenulls=True).over(up), F.last(y, ignorenulls=True).over(down) - F.col("y")
    own = g.select("y", "x", F.coalesce("__here", F.lit(False)).alias("here"), F.least(above, below).cast("double").alias("g"))
    best = own.groupBy("y").applyInArrow(_along_row, "y long, x long, d2 long")
    return df.join(best, ["y", "x"], "left")


def _along_row(table: pa.Table) -> pa.Table:
    x, own, here = (table.column(c).to_numpy() for c in ("x", "g", "here"))
    seen = ~np.isnan(own)
    at, first = np.unique(x[seen], return_index=True)
    high = np.square(own[seen][first].astype(np.int64))
    x = x[here]
    lowest, starts = _envelope(at.tolist(), high.tolist())
    if lowest:
        best = np.array(lowest)[np.searchsorted(starts, x, side="right") - 1]
        d2 = high[best] + np.square(x - at[best])
    else:
        x, d2 = x[:0], np.empty(0, np.int64)
    return pa.table({"y": pa.array(np.full(len(x), table.column("y")[0].as_py()), pa.int64()), "x": pa.array(x, pa.int64()), "d2": pa.array(d2, pa.int64())})


def _envelope(at: list[int], high: list[int]) -> tuple[list[int], list[int]]:
    """Of the parabolas high + (x - at)^2, by increasing at: those that are lowest anywhere, and the whole x from which each is."""
    lowest, starts = [], []
    for i, (u, h) in enumerate(zip(at, high, strict=True)):
        start = -(1 << 62)  # the first is lowest from the left end on
        while lowest:
            v, top = at[lowest[-1]], high[lowest[-1]]
            start = (u * u - v * v + h - top) // (2 * (u - v)) + 1  # the first x where u is strictly below v
            if start > starts[-1]:
                break
            lowest.pop()
            starts.pop()
            start = -(1 << 62)
        lowest.append(i)
        starts.append(start)
    return lowest, starts


def nearest_fill(df: DataFrame, value: str, out: str, radius: int) -> DataFrame:
    """Null cells take the nearest valid value within radius; ties go to the least (d2, y, x) of the source."""
    src = df.where(F.col(value).isNotNull()).select("y", "x", F.col(value).alias("__v"), F.col("y").alias("__sy"), F.col("x").alias("__sx"))
    hit = scatter(src, disc(radius))
    d2 = (F.col("y") - F.col("__sy")) * (F.col("y") - F.col("__sy")) + (F.col("x") - F.col("__sx")) * (F.col("x") - F.col("__sx"))
    best = hit.groupBy("y", "x").agg(F.min_by("__v", F.struct(d2, "__sy", "__sx")).alias("__fill"))
    return df.join(best, ["y", "x"], "left").withColumn(out, F.coalesce(value, "__fill")).drop("__fill")


def eroded(df: DataFrame, valid: DataFrame, kernel: Kernel) -> DataFrame:
    """Cells of df all of whose offsets are valid cells; beyond the border nothing is valid."""
    full = scatter(valid.select("y", "x"), [(-a, -b, w) for a, b, w in kernel]).groupBy("y", "x").agg(F.count("*").alias("__n"))
    return df.join(full.where(F.col("__n") == len(kernel)).drop("__n"), ["y", "x"], "left_semi")


def apart(df: DataFrame, dots: DataFrame, radius: float) -> DataFrame:
    """Cells of df farther than radius from every dot."""
    # the scattered side is many times as large as the planner takes it for: no broadcast
    return df.join(scatter(dots.select("y", "x"), disc(radius)).select("y", "x").hint("merge"), ["y", "x"], "left_anti")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of a graph's linked nodes, links (u, v): root is the least node of the component.

    Alternating large-star and small-star rounds take a number of rounds that grows with the
    logarithm of a component's length; each is written before the next reads it. Links take several times their file
    in memory, so no side is broadcast by the size of its file.
    """
    e = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).hint("merge")
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark(after) == mark(e):
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = after


def components(mask: DataFrame, width: int) -> DataFrame:
    """(y, x, comp): eight-connected components, named by their least cell id."""
    here = mask.select("y", "x").distinct().withColumn("u", F.col("y") * width + F.col("x"))
    half = [(0, 1, 1.0), (1, -1, 1.0), (1, 0, 1.0), (1, 1, 1.0)]
    found = connected(scatter(here.withColumnRenamed("u", "v"), half).join(here.hint("merge"), ["y", "x"]).select("u", "v"))
    return here.join(found.hint("merge"), F.col("u") == F.col("node"), "left").select("y", "x", F.coalesce("root", "u").alias("comp"))


def d8(df: DataFrame, value: str, width: int) -> DataFrame:
    """(cell_id, receiver): the steepest strictly lower of eight neighbours; ties to the least cell; sinks have none."""
    ring = [(a, b, (a * a + b * b) ** 0.5) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    here = df.where(F.col(value).isNotNull()).select("y", "x", F.col(value).alias("__z"))
    donors = scatter(here.withColumn("__from", F.col("y") * width + F.col("x")).withColumnRenamed("__z", "__high"), ring)
    hit = donors.join(here, ["y", "x"]).where("__z < __high").withColumn("__to", F.col("y") * width + F.col("x"))
    best = hit.groupBy("__from").agg(F.max_by("__to", F.struct((F.col("__high") - F.col("__z")) / F.col("w"), -F.col("__to"))).alias("receiver"))
    return here.select((F.col("y") * width + F.col("x")).alias("cell_id")).join(best.withColumnRenamed("__from", "cell_id"), "cell_id", "left")


def accumulation(receivers: DataFrame) -> DataFrame:
    """(cell_id, acc): cells that drain through each cell, itself included.

    Pointer doubling: in each round a cell hands on the sums of all cells 2**k - 1 steps up, and its
    pointer jumps twice as far; the number of rounds is the logarithm of the longest path.
    """
    df = written(receivers.select("cell_id", F.col("receiver").alias("to"), F.lit(1).cast("long").alias("acc")))
    while df.where(F.col("to").isNotNull()).limit(1).count():
        got = df.where(F.col("to").isNotNull()).groupBy(F.col("to").alias("cell_id")).agg(F.sum("acc").alias("more"))
        jump = df.select(F.col("cell_id").alias("to"), F.col("to").alias("__next"))
        df = written(df.join(got, "cell_id", "left").join(jump, "to", "left").select("cell_id", F.col("__next").alias("to"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
    return df.select("cell_id", "acc")
