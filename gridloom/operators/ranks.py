"""Ranks and row numbers over a whole table without a window over a whole table.

Approximate quantiles cut the order into parts; each part is numbered on its own and starts after
the rows of the parts before it. The cuts only deal the work: the numbers are exact. A value that
makes up more than a part of all rows is a cut itself, and its rows are dealt by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of the order, and of the keys within one frequent value.
PARTS = 64


def _cuts(df: DataFrame, columns: list[str], parts: int) -> list[Column]:
    """For each column its cuts, less than `parts` numbers. They are read once and go into the plan as
    literals: approximate quantiles worked out twice need not be the same."""
    at = [i / parts for i in range(1, parts)]
    one = df.agg(*[F.percentile_approx(c, at, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    kinds = [df.schema[c].dataType.simpleString() for c in columns]
    return [F.array(*[F.lit(x) for x in sorted(set(cut or []))]).cast(f"array<{k}>") for cut, k in zip(one, kinds, strict=True)]


def _below(cuts: Column, column: str) -> Column:
    return F.size(F.filter(cuts, lambda x: x < F.col(column)))


def _starts(dealt: DataFrame, by: list[str], n: Column) -> DataFrame:
    """(by, __start, __rows): a row for each part, so at most 2 * PARTS * PARTS."""
    each = dealt.groupBy(*by).agg(n.alias("__n"))
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__n").over(before), F.lit(0))
    return each.select(*by, start.alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("__rows"))


def numbered(df: DataFrame, value: str, key: str, out: str, rows: str | None = None, *, parts: int = PARTS) -> DataFrame:
    """df with its row number from 1 by (value, key), and with how many rows there are as `rows`.

    Both columns are numbers; rows where either is null are left out; rows equal in both are
    numbered in any order; an empty table stays empty.
    """
    df = df.where(F.col(value).isNotNull() & F.col(key).isNotNull())
    cuts, key_cuts = _cuts(df, [value, key], parts)
    often = F.array_contains(cuts, F.col(value))
    dealt = df.withColumn("__p", 2 * _below(cuts, value) + often.cast("int")).withColumn("__q", F.when(often, _below(key_cuts, key)).otherwise(0))
    starts = F.broadcast(_starts(dealt, ["__p", "__q"], F.count("*")))
    within = F.row_number().over(Window.partitionBy("__p", "__q").orderBy(value, key))
    got = dealt.withColumn(out, within).join(starts, ["__p", "__q"]).withColumn(out, F.col(out) + F.col("__start"))
    return (got.withColumn(rows, F.col("__rows")) if rows else got).drop("__p", "__q", "__start", "__rows")


def placed(df: DataFrame, value: str, *, parts: int = PARTS) -> DataFrame:
    """df with __below, __same and __all: how many rows have a smaller value, the same one, and any.

    The value is a number; rows where it is null are left out. Values are counted before they are
    put in order, so a frequent one is one row there.
    """
    df = df.where(F.col(value).isNotNull())
    kinds = df.groupBy(value).agg(F.count("*").alias("__same"))
    (cuts,) = _cuts(kinds, [value], parts)
    dealt = kinds.withColumn("__p", _below(cuts, value))
    starts = F.broadcast(_starts(dealt, ["__p"], F.sum("__same")))
    before = Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    at = dealt.withColumn("__b", F.coalesce(F.sum("__same").over(before), F.lit(0))).join(starts, "__p")
    return df.join(at.select(value, (F.col("__b") + F.col("__start")).alias("__below"), "__same", F.col("__rows").alias("__all")), value)


def percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the share of other rows that have a smaller value; 0 for a row alone."""
    share = F.when(F.col("__all") > 1, F.col("__below") / (F.col("__all") - 1)).otherwise(0.0)
    return placed(df, value).withColumn(out, share).drop("__below", "__same", "__all")
