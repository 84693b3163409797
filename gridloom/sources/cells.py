"""A grid as an ordinary keyed table: (cell_id, y, x) and nullable bands.

The supplied tables hold no rasters, so the orders make the grid: their keys are contiguous,
and a square of side ceil(sqrt(n)) takes them row by row. Missing line items make real nulls.
NaN and sentinels become null here, once, and nowhere later.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values at or below this are "no observation".
SENTINEL = -1e30


@dataclass(frozen=True)
class GridSpec:
    """A dense row-major grid of `height` x `width` cells."""

    height: int
    width: int

    def cell(self, y: Column, x: Column) -> Column:
        return y * self.width + x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(spark: SparkSession, sf_dir: str) -> GridSpec:
    n = table(spark, sf_dir, "orders").count()  # parquet footers only
    w = math.isqrt(max(n - 1, 0)) + 1
    return GridSpec(w, w)


def band(v: Column, nodata: float | None = None) -> Column:
    """Finite observations; NaN, sentinels and values equal to `nodata` are null."""
    ok = v.isNotNull() & ~F.isnan(v) & (v > SENTINEL)
    if nodata is not None:
        ok &= F.abs(v - nodata) > 1e-9
    return F.when(ok, v)


def cells(spark: SparkSession, sf_dir: str, *, items: bool = False) -> DataFrame:
    """cell_id, y, x, v (price), p (priority), st (status), ck (customer); with `items` also qty, disc."""
    w = spec(spark, sf_dir).width
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    df = o.select(
        key.alias("cell_id"), F.floor(key / w).alias("y"), (key % w).alias("x"),
        F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("st"), F.col("o_custkey").alias("ck"),
    )
    if not items:
        return df
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
    return df.join(li, "cell_id", "left")


def inside(w: int) -> Column:
    """The footprint: an ellipse given in whole numbers, so both engines agree at its edge."""
    a, b = 2 * F.col("y") - (w - 1), 2 * F.col("x") - (w - 1)
    return a * a + b * b <= (w - 3) ** 2


def footprint(spark: SparkSession, sf_dir: str, *, items: bool = False) -> DataFrame:
    return cells(spark, sf_dir, items=items).where(inside(spec(spark, sf_dir).width))


def truth(df: DataFrame) -> DataFrame:
    return df.where("p = '1-URGENT'")


def prediction(df: DataFrame) -> DataFrame:
    return df.where("p = '2-HIGH' AND st = 'O'")


#: The same substrate for DuckDB.
GRID_SQL = """dims AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM orders),
li AS (SELECT l_orderkey, sum(l_quantity) AS qty, avg(l_discount) AS disc FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey AS cell_id, o_orderkey // w AS y, o_orderkey % w AS x, w, o_totalprice AS v, qty, disc,
    o_orderpriority AS p, o_orderstatus AS st, o_custkey AS ck FROM orders CROSS JOIN dims LEFT JOIN li ON l_orderkey = o_orderkey),
fp AS (SELECT * FROM g WHERE (2*y-w+1)*(2*y-w+1) + (2*x-w+1)*(2*x-w+1) <= (w-3)*(w-3))"""
