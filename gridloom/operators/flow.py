"""Channels along a drainage forest: each cell looks some steps down its path and some steps up its donors.

Steps down are pointers: one join doubles them. Steps up are sums over donors weighted by what drains through each;
a cell without donors keeps its own value. Rounds are written, so a lost executor costs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.distance import accumulation, d8, written


def forest(df: DataFrame, value: str, width: int) -> DataFrame:
    """(cell_id, y, x, to, s, acc): the receiver (itself for a sink), the slope down to it, and what drains through the cell."""
    rc = written(d8(df, value, width))
    acc = accumulation(rc)
    here = df.where(F.col(value).isNotNull()).select((F.col("y") * width + F.col("x")).alias("cell_id"), "y", "x", F.col(value).alias("__z"))
    low = here.select(F.col("cell_id").alias("to"), F.col("__z").alias("__low"), F.col("y").alias("__ty"), F.col("x").alias("__tx"))
    got = here.join(rc.withColumnRenamed("receiver", "to"), "cell_id").join(low, "to", "left")
    step = F.sqrt((F.col("y") - F.col("__ty")) * (F.col("y") - F.col("__ty")) + (F.col("x") - F.col("__tx")) * (F.col("x") - F.col("__tx")))
    slope = F.coalesce((F.col("__z") - F.col("__low")) / step, F.lit(0.0))
    return written(got.join(acc, "cell_id").select("cell_id", "y", "x", F.coalesce("to", "cell_id").alias("to"), slope.alias("s"), "acc"))


def pointers(f: DataFrame) -> DataFrame:
    """(cell_id, p1, p2, p3, p4): the cells one to four steps down; a sink points at itself."""
    one = f.select("cell_id", F.col("to").alias("p1"))
    jump = lambda at, out: one.select(F.col("cell_id").alias(at), F.col("p1").alias(out))
    two = written(one.join(jump("p1", "p2"), "p1"))
    twice = two.select(F.col("cell_id").alias("p2"), F.col("p1").alias("p3"), F.col("p2").alias("p4"))
    return written(two.join(twice, "p2"))


def down(df: DataFrame, at: str, value: str, out: str) -> DataFrame:
    """df with the value found at the cell that column `at` names."""
    return df.join(df.select(F.col("cell_id").alias(at), F.col(value).alias(out)), at, "left")


def up(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """df with each value's mean over the donors, weighted by what drains through them; a cell without donors keeps its own."""
    mean = lambda c: F.sum(F.col("acc") * F.col(c)) / F.sum("acc")
    got = df.where("to <> cell_id").groupBy(F.col("to").alias("cell_id")).agg(*[mean(c).alias(f"__{o}") for c, o in values.items()])
    both = df.join(got, "cell_id", "left")
    return both.select(*df.columns, *[F.coalesce(f"__{o}", c).alias(o) for c, o in values.items()])


def channels(df: DataFrame, value: str, width: int) -> DataFrame:
    """cell_id, acc, log_acc, knick, knick_reach, turn.

    knick: stream power s * acc ** 0.45 over the mean of three steps down and three steps up, where four cells drain;
    knick_reach: its largest within two steps; turn: one less the cosine between the four steps down and the
    four steps up, times log_acc, where six cells drain and both chords are longer than half a cell.
    """
    f = forest(df, value, width)
    f = f.withColumn("log_acc", F.log1p("acc")).withColumn("k0", F.greatest("s", F.lit(1e-5)) * F.pow("acc", F.lit(0.45))).withColumn("y0", F.col("y").cast("double")).withColumn("x0", F.col("x").cast("double"))
    for i in range(4):
        rows = {f"y{i}": f"y{i + 1}", f"x{i}": f"x{i + 1}"} | ({f"k{i}": f"k{i + 1}"} if i < 3 else {})
        f = written(up(f, rows))
    f = written(f.join(pointers(f), "cell_id"))
    for i in (1, 2, 3):
        f = down(f, f"p{i}", "k0", f"d{i}")
    ref = 0.5 * ((F.col("d1") + F.col("d2") + F.col("d3")) / 3 + (F.col("k1") + F.col("k2") + F.col("k3")) / 3)
    f = written(f.withColumn("knick", F.when(F.col("acc") >= 4, F.greatest(F.lit(0.0), F.col("k0") - ref)).otherwise(0.0)))
    here = f.select("cell_id", F.col("to").alias("__to"), F.col("knick").alias("__k"))
    once = here.where("__to <> cell_id").groupBy(F.col("__to").alias("cell_id")).agg(F.max("__k").alias("ku1"))
    twice = once.join(here.where("__to <> cell_id"), "cell_id").groupBy(F.col("__to").alias("cell_id")).agg(F.max("ku1").alias("ku2"))
    f = down(down(f, "p1", "knick", "kd1"), "p2", "knick", "kd2").join(once, "cell_id", "left").join(twice, "cell_id", "left")
    end = f.select(F.col("cell_id").alias("p4"), F.col("y0").alias("ey"), F.col("x0").alias("ex"))
    f = f.join(end, "p4")
    dy, dx, uy, ux = F.col("ey") - F.col("y0"), F.col("ex") - F.col("x0"), F.col("y0") - F.col("y4"), F.col("x0") - F.col("x4")
    n_down, n_up = F.sqrt(dy * dy + dx * dx), F.sqrt(uy * uy + ux * ux)
    whole = (F.col("acc") >= 6) & (n_down > 0.5) & (n_up > 0.5)
    cosine = F.least(F.greatest((dy * uy + dx * ux) / F.nullif(n_down * n_up, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    reach: Column = F.greatest("knick", zero("kd1"), zero("kd2"), zero("ku1"), zero("ku2"))
    return f.select("cell_id", "acc", "log_acc", "knick", reach.alias("knick_reach"), F.when(whole, (1 - cosine) * F.col("log_acc")).otherwise(0.0).alias("turn"))
