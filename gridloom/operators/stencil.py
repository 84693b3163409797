"""Neighbourhood operators.

Dense bands use windows along each axis: `taps` reads neighbours with lag and lead, so a separable
filter costs two shuffles whatever its radius. Borders are a padding stage of their own: cells
near an edge are also placed at the mirrored or clamped positions outside, and drop out at
the end. Sparse masks scatter: each cell goes to its neighbours, which are then grouped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Kernel = list[tuple[int, int, float]]


def triangular(radius: int = 3) -> Kernel:
    """1 - d / radius where it is positive: 25 offsets at radius 3."""
    r = range(-radius, radius + 1)
    out = [(a, b, 1 - math.hypot(a, b) / radius) for a in r for b in r]
    return [k for k in out if k[2] > 0]


def disc(radius: float) -> Kernel:
    """Offsets no farther than radius, at weight 1."""
    r = range(-int(radius), int(radius) + 1)
    return [(a, b, 1.0) for a in r for b in r if a * a + b * b <= radius * radius]


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    """One-sided weights 0..r of a normalised Gaussian."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(r + 1)]
    total = w[0] + 2 * sum(w[1:])
    return [x / total for x in w]


def at_least(v: Column, low: float = 0.0) -> Column:
    """max(low, v) that keeps null."""
    return F.when(v.isNotNull(), F.greatest(v, F.lit(low)))


def kernel_column(kernel: Kernel) -> Column:
    """A kernel as a literal array, to be exploded without a join."""
    return F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(float(w)).alias("w")) for a, b, w in kernel])


def scatter(df: DataFrame, kernel: Kernel) -> DataFrame:
    """Every row once for each offset, at the offset's cell, with weight w; other columns stay."""
    k = df.withColumn("__k", F.explode(kernel_column(kernel)))
    return k.withColumn("y", F.col("y") + F.col("__k.dy")).withColumn("x", F.col("x") + F.col("__k.dx")).withColumn("w", F.col("__k.w")).drop("__k")


def shifted(df: DataFrame, dy: int, dx: int, value: str, out: str) -> DataFrame:
    """(y, x, out): the value found at (y + dy, x + dx); nothing beyond the border."""
    return df.select((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col(value).alias(out))


def pad(df: DataFrame, axis: str, n: int, r: int, mode: str) -> DataFrame:
    """Add up to r cells outside [0, n) along an axis: reflect (d c b a | a b c d), nearest, or none."""
    c = F.col(axis)
    if mode == "constant":
        return df
    if mode == "nearest":
        low = F.when(c == 0, F.sequence(F.lit(-r), F.lit(-1)))
        high = F.when(c == n - 1, F.sequence(F.lit(n), F.lit(n + r - 1)))
    else:
        low = F.when(c < r, F.array((-c - 1).cast("int")))
        high = F.when(c >= n - r, F.array((2 * n - 1 - c).cast("int")))
    none = F.array().cast("array<int>")
    at = F.concat(F.array(c.cast("int")), F.coalesce(low, none), F.coalesce(high, none))
    return df.withColumn(axis, F.explode(at))


def along(axis: str) -> Window:
    other = "x" if axis == "y" else "y"
    return Window.partitionBy(other).orderBy(axis)


def tap(value: str | Column, axis: str, k: int) -> Column:
    """The neighbour k steps along an axis, on a dense axis; null beyond it."""
    w = along(axis)
    return F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else (F.col(value) if isinstance(value, str) else value)


def dense(df: DataFrame, height: int, width: int) -> DataFrame:
    """Every cell of the grid; those that df lacks have null bands."""
    spark = df.sparkSession
    full = spark.range(height * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    return full.join(df, ["y", "x"], "left")


def separable(df: DataFrame, value: str, out: str, weights: list[float], n: tuple[int, int], mode: str = "reflect") -> DataFrame:
    """Convolve a dense band with a symmetric kernel along x, then y. A null anywhere makes a null."""
    r = len(weights) - 1
    for axis, size in (("x", n[1]), ("y", n[0])):
        df = pad(df, axis, size, r, mode)
        total = F.col(value if axis == "x" else out) * weights[0]
        src = value if axis == "x" else out
        for k in range(1, r + 1):
            total = total + (tap(src, axis, k) + tap(src, axis, -k)) * weights[k]
        df = df.withColumn(out, total).where(F.col(axis).between(0, size - 1))
    return df


def smoothed(df: DataFrame, value: str, out: str, sigma: float, n: tuple[int, int], *, truncate: float = 4.0, mode: str = "nearest") -> DataFrame:
    """Gaussian mean over valid cells: the smoothed values over the smoothed support, null off support."""
    w = gaussian_taps(sigma, truncate)
    df = df.withColumn("__num", F.coalesce(F.col(value), F.lit(0.0))).withColumn("__den", F.col(value).isNotNull().cast("double"))
    df = separable(df, "__num", "__num_s", w, n, mode)
    df = separable(df, "__den", "__den_s", w, n, mode)
    good = F.col(value).isNotNull() & (F.col("__den_s") > 1e-12)
    return df.withColumn(out, F.when(good, F.col("__num_s") / F.col("__den_s"))).drop("__num", "__den", "__num_s", "__den_s")


def gradient(df: DataFrame, value: str, axis: str, out: str) -> DataFrame:
    """Central difference, one-sided where a neighbour is beyond the border; needs a dense band."""
    a, b = tap(value, axis, -1), tap(value, axis, 1)
    here = F.col(value)
    first, last = F.lag(F.lit(1), 1).over(along(axis)).isNull(), F.lead(F.lit(1), 1).over(along(axis)).isNull()
    return df.withColumn(out, F.when(first, b - here).when(last, here - a).otherwise((b - a) / 2))


def gradient_magnitude(df: DataFrame, value: str, out: str) -> DataFrame:
    df = gradient(gradient(df, value, "y", "__gy"), value, "x", "__gx")
    return df.withColumn(out, F.sqrt(F.col("__gy") * F.col("__gy") + F.col("__gx") * F.col("__gx"))).drop("__gy", "__gx")


def hessian(df: DataFrame, value: str) -> DataFrame:
    """Second differences __yy, __xx, __xy as gradients of gradients."""
    df = gradient(gradient(df, value, "y", "__gy"), value, "x", "__gx")
    df = gradient(gradient(gradient(df, "__gy", "y", "__yy"), "__gx", "x", "__xx"), "__gy", "x", "__xy")
    return df.drop("__gy", "__gx")


def saddle(df: DataFrame, value: str, out: str) -> DataFrame:
    """sqrt of the positive part of minus the Hessian determinant."""
    det = F.col("__yy") * F.col("__xx") - F.col("__xy") * F.col("__xy")
    return hessian(df, value).withColumn(out, F.sqrt(at_least(-det))).drop("__yy", "__xx", "__xy")


def box_std(df: DataFrame, value: str, out: str, size: int, n: tuple[int, int]) -> DataFrame:
    """Standard deviation in a size x size box with mirrored borders."""
    r = size // 2
    w = [1.0 / size] * (r + 1)
    df = df.withColumn("__sq", F.col(value) * F.col(value))
    df = separable(separable(df, value, "__m", w, n), "__sq", "__m2", w, n)
    return df.withColumn(out, F.sqrt(at_least(F.col("__m2") - F.col("__m") * F.col("__m")))).drop("__sq", "__m", "__m2")


def gathered(df: DataFrame, kernel: Kernel, value: str) -> DataFrame:
    """(y, x, value, w): for each cell the values found at its offsets; only where there is one."""
    back = [(-a, -b, w) for a, b, w in kernel]
    return scatter(df.select("y", "x", value), back)


def impute(df: DataFrame, value: str, out: str) -> DataFrame:
    """Null cells take the median of the 3 x 3 box, where their own place holds the mean of the
    valid cells of the 5 x 5 box; what has no valid cell near stays null."""
    box = lambda r: [(a, b, 1.0) for a in range(-r, r + 1) for b in range(-r, r + 1)]
    seed = gathered(df, box(2), value).groupBy("y", "x").agg(F.avg(value).alias("__seed"))
    seeded = df.select("y", "x", value).join(seed, ["y", "x"], "left").withColumn("__s", F.coalesce(value, "__seed"))
    mid = gathered(seeded, box(1), "__s").groupBy("y", "x").agg(F.median("__s").alias("__mid"))
    return df.join(seed.join(mid, ["y", "x"], "left"), ["y", "x"], "left").withColumn(out, F.coalesce(F.col(value), F.when(F.col("__seed").isNotNull(), F.col("__mid")))).drop("__seed", "__mid")


def line_offsets(n_azimuths: int, half: int, flank: int = 0) -> list[tuple[int, int, int, int]]:
    """(azimuth, part, dy, dx): part 0 along the line, parts -1 and 1 its flanks; duplicates stay."""
    out = []
    for a in range(n_azimuths):
        t = math.pi * a / n_azimuths
        uy, ux = math.sin(t), math.cos(t)
        for part in (-1, 0, 1) if flank else (0,):
            for s in range(-half, half + 1):
                out.append((a, part, round(s * uy + part * flank * ux), round(s * ux - part * flank * uy)))
    return out


def neighbour_counts(df: DataFrame) -> DataFrame:
    """Cells of a mask with the number of their eight neighbours in it."""
    ring = [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    near = scatter(df.select("y", "x"), ring).groupBy("y", "x").agg(F.count("*").alias("neighbours"))
    return df.select("y", "x").join(near, ["y", "x"], "left").select("y", "x", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def ridges(df: DataFrame, value: str, sigma: float, n: tuple[int, int]) -> DataFrame:
    """Cells of a dense band that are ridge crests: concave down across the strike and no lower than both
    neighbours across it, in four direction bins; positive values only, with all neighbours valid."""
    df = hessian(smoothed(df, value, "__s", sigma, n), "__s")
    half, dev = (F.col("__yy") + F.col("__xx")) / 2, (F.col("__yy") - F.col("__xx")) / 2
    low = half - F.sqrt(dev * dev + F.col("__xy") * F.col("__xy"))  # the more negative curvature
    # its direction, from x towards y, in bins of 45 degrees
    angle = F.degrees(F.atan2(low - F.col("__xx"), F.col("__xy")))
    df = df.withColumn("__low", low).withColumn("__bin", F.pmod(F.rint(F.round(angle, 6) / 45), F.lit(4.0)).cast("int"))
    near = {}
    rows = {k: tap(value, "y", k) for k in (-1, 1)}
    df = df.withColumns({f"__r{k + 1}": c for k, c in rows.items()})
    for dy, name in ((-1, "__r0"), (0, value), (1, "__r2")):
        for dx in (-1, 0, 1):
            if dy or dx:
                near[dy, dx] = tap(name, "x", dx)
    df = df.withColumns({f"__n{i}": near[k] for i, k in enumerate(sorted(near))})
    at = {k: F.col(f"__n{i}") for i, k in enumerate(sorted(near))}
    pairs = {0: ((0, 1), (0, -1)), 1: ((1, 1), (-1, -1)), 2: ((1, 0), (-1, 0)), 3: ((1, -1), (-1, 1))}
    v = F.col(value)
    top = F.lit(False)
    for b, (p, q) in pairs.items():
        top = top | ((F.col("__bin") == b) & (v >= at[p]) & (v >= at[q]))
    whole = F.lit(True)
    for c in at.values():
        whole = whole & c.isNotNull()
    return df.where(whole & (v > 0) & (F.col("__low") < 0) & top).select("y", "x", value)
