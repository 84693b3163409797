"""Lines of ordered samples: runs, gaps, running distance, thinning, summaries; batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(df: DataFrame, line: str, order: tuple[str, ...], position: str, gap: float) -> DataFrame:
    """df with seg (distance from the sample before, 0 at a run's start) and run (number within its line)."""
    w = Window.partitionBy(line).orderBy(*order)
    step = F.abs(F.col(position) - F.lag(position).over(w))
    df = df.withColumn("__d", step)
    fresh = F.col("__d").isNull() | (F.col("__d") > gap)
    df = df.withColumn("__new", fresh.cast("int"))
    return df.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("seg", F.when(F.col("__new") == 1, 0.0).otherwise(F.col("__d"))).drop("__d", "__new")


def travelled(df: DataFrame, line: str, order: tuple[str, ...]) -> DataFrame:
    """df with dist: running distance within its run."""
    w = Window.partitionBy(line, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("dist", F.sum("seg").over(w))


def thinned(df: DataFrame, line: str, order: tuple[str, ...], step: float) -> DataFrame:
    """The first sample of each bin of running distance in each run."""
    w = Window.partitionBy(line, "run").orderBy(*order)
    df = df.withColumn("bin", F.floor(F.round(F.col("dist"), 6) / step))
    df = df.withColumn("__b", F.lag("bin").over(w))
    return df.where(F.col("__b").isNull() | (F.col("__b") != F.col("bin"))).drop("__b")


def summary(df: DataFrame, line: str, value: str) -> DataFrame:
    """Partial and final aggregates by line; ratios of sums come last."""
    s = df.groupBy(line).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(value) > 50).alias("over"), F.sum("seg").alias("length"), F.max("run").alias("runs"))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return s.select(line, "n", "lo", "hi", "over", F.col("runs").cast("long").alias("runs"), F.round("length", 6).alias("length"), ratio("total", "n").alias("mean"), ratio("over", "n").alias("share_over"))


def heading(dy: Column, dx: Column) -> Column:
    """Direction in degrees, modulo 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))
