"""Filters in the Fourier domain of a whole grid, row by row and column by column.

A two-dimensional transform is one along every row, then one along every column. So each task holds single rows, then
single columns: two shuffles forth and back, and the same numbers as one transform of the whole array. Borders
are mirrored inside each row and column; mirrored rows need no rows of their own, as their transforms are equal.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, value: str, out: str, multiplier: Callable[[np.ndarray, np.ndarray], np.ndarray], n: tuple[int, int], pad: int) -> DataFrame:
    """(y, x, out): the dense band times multiplier(ky, kx), frequencies in cycles a cell, on a mirrored border of `pad`
    cells. Nulls and missing cells count as 0; every cell of the grid is returned."""
    wide, high = n[1] + 2 * pad, n[0] + 2 * pad
    k = wide // 2 + 1

    def along_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a = np.zeros(n[1])
        a[table.column("x").to_numpy()] = table.column("v").to_numpy()
        f = np.fft.rfft(np.pad(a, pad, "symmetric"))
        return pa.table({"y": pa.array(np.full(k, key[0].as_py()), pa.int64()), "k": pa.array(np.arange(k), pa.int64()), "re": f.real, "im": f.imag})

    def along_columns(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a = np.zeros(n[0], complex)
        a[table.column("y").to_numpy()] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        at = key[0].as_py()
        f = np.fft.ifft(np.fft.fft(np.pad(a, pad, "symmetric")) * multiplier(np.fft.fftfreq(high), np.full(high, at / wide)))[pad : pad + n[0]]
        return pa.table({"y": pa.array(np.arange(n[0]), pa.int64()), "k": pa.array(np.full(n[0], at), pa.int64()), "re": f.real, "im": f.imag})

    def back(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        f = np.zeros(k, complex)
        f[table.column("k").to_numpy()] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        a = np.fft.irfft(f, wide)[pad : pad + n[1]]
        return pa.table({"y": pa.array(np.full(n[1], key[0].as_py()), pa.int64()), "x": pa.array(np.arange(n[1]), pa.int64()), out: a})

    rows = df.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    waves = rows.groupBy("y").applyInArrow(along_rows, "y long, k long, re double, im double")
    waves = waves.groupBy("k").applyInArrow(along_columns, "y long, k long, re double, im double")
    return waves.groupBy("y").applyInArrow(back, f"y long, x long, {out} double")


def vertical_derivative(df: DataFrame, value: str, out: str, n: tuple[int, int], pad: int = 16) -> DataFrame:
    """|k| in radians a cell: the derivative upwards of a harmonic field."""
    return filtered(df, value, out, lambda ky, kx: 2 * np.pi * np.hypot(ky, kx), n, pad)
