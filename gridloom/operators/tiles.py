"""Dense stencils on tiles with a halo.

Cells are dealt once, to their own tile and to every tile whose halo they lie in: about (1 + 2 halo / size) ** 2 rows a
cell, whatever the stencil. A tile's rows become arrays clipped to the grid, a function of whole
arrays runs on them, and only the tile's own cells come back. A function whose result at a cell depends
on cells within `halo` of it gives the same numbers as over the whole grid: real borders are the arrays'
borders, and what an artificial border spoils lies outside the tile's own cells.

Nulls are NaN in the arrays and NaN results are null. Cells that the table lacks are NaN and get no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.stencil import gaussian_taps, line_offsets

Arrays = dict[str, np.ndarray]
SIZE = 256


def tiled(df: DataFrame, bands: list[str], fn: Callable[[Arrays], Arrays], out: list[str], n: tuple[int, int], halo: int, *, size: int = SIZE) -> DataFrame:
    """(y, x, *out) for every cell of df: `fn` of the bands' arrays, given that it reaches no farther than `halo`."""

    def tiles(axis: str, length: int):
        c, last = F.col(axis), (length - 1) // size
        low, high = F.floor((c - halo) / size), F.floor((c + halo) / size)
        return F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(last))))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ty, tx = (k.as_py() for k in key)
        y0, x0 = max(0, ty * size - halo), max(0, tx * size - halo)
        y1, x1 = min(n[0], (ty + 1) * size + halo), min(n[1], (tx + 1) * size + halo)
        y, x = table.column("y").to_numpy() - y0, table.column("x").to_numpy() - x0
        arrays = {}
        for b in bands:
            a = np.full((y1 - y0, x1 - x0), np.nan)
            a[y, x] = table.column(b).to_numpy()
            arrays[b] = a
        with np.errstate(all="ignore"):
            got = fn(arrays)
        own = ((y + y0) // size == ty) & ((x + x0) // size == tx)
        y, x = y[own], x[own]
        cols = {"y": pa.array(y + y0, pa.int64()), "x": pa.array(x + x0, pa.int64())}
        for name in out:
            v = np.asarray(got[name], float)[y, x]
            cols[name] = pa.array(v, pa.float64(), mask=np.isnan(v))
        return pa.table(cols)

    rows = df.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.col(b).cast("double").alias(b) for b in bands])
    rows = rows.withColumn("ty", tiles("y", n[0])).withColumn("tx", tiles("x", n[1]))
    return rows.groupBy("ty", "tx").applyInArrow(run, "y long, x long, " + ", ".join(f"{c} double" for c in out))


def moved(a: np.ndarray, dy: int, dx: int, mode: str = "edge") -> np.ndarray:
    """The value found at (y + dy, x + dx); beyond the border the edge's, or NaN for mode "constant"."""
    r = max(abs(dy), abs(dx))
    p = np.pad(a, r, mode, **({"constant_values": np.nan} if mode == "constant" else {}))
    return p[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]]


def gaussian(a: np.ndarray, sigma: float, mode: str = "symmetric", truncate: float = 4.0) -> np.ndarray:
    w = gaussian_taps(sigma, truncate)
    r = len(w) - 1
    for axis in (1, 0):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(2)], mode)
        cut = lambda k: p[(slice(None), slice(r + k, r + k + a.shape[1]))] if axis == 1 else p[r + k : r + k + a.shape[0]]  # noqa: B023, E731
        a = w[0] * cut(0) + sum(w[k] * (cut(k) + cut(-k)) for k in range(1, r + 1))
    return a


def derived(a: np.ndarray, sigma: float, orders: tuple[int, int], truncate: float = 3.0) -> np.ndarray:
    """Derivatives of the Gaussian mean, orders down the rows and along the columns (0, 1 or 2); borders repeat."""
    r = int(truncate * sigma + 0.5)
    k = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (k / sigma) ** 2)
    g /= g.sum()
    weights = (g, k / sigma**2 * g, (k * k / sigma**4 - 1 / sigma**2) * g)
    for axis, order in enumerate(orders):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(2)], "edge")
        cut = lambda j: p[:, r + j : r + j + a.shape[1]] if axis else p[r + j : r + j + a.shape[0]]  # noqa: B023, E731
        a = sum(w * cut(j) for j, w in zip(k, weights[order], strict=True))
    return a


def least_curvature(a: np.ndarray, sigmas: tuple[float, ...] = (1.5, 3.0)) -> np.ndarray:
    """How far the smaller curvature is below zero, times sigma squared, summed over scales. Reaches 3 * max(sigmas) cells."""
    total = np.zeros(a.shape)
    for s in sigmas:
        yy, xx, xy = derived(a, s, (2, 0)), derived(a, s, (0, 2)), derived(a, s, (1, 1))
        low = 0.5 * (yy + xx - np.sqrt((yy - xx) ** 2 + 4 * xy * xy))
        total += s * s * np.maximum(-low, 0.0)
    return total


def whole_box(a: np.ndarray, r: int) -> np.ndarray:
    """Whether all cells of the box of radius r are there; none is beyond the border."""
    good = np.ones(a.shape, bool)
    for dy in range(-r, r + 1):
        good &= ~np.isnan(moved(a, dy, 0, "constant"))
    row = np.where(good, 0.0, np.nan)
    for dx in range(-r, r + 1):
        good = good & ~np.isnan(moved(row, 0, dx, "constant"))
    return good


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean of a size x size box; borders repeat."""
    r = size // 2
    rows = sum(moved(a, d, 0) for d in range(-r, r + 1))
    return sum(moved(rows, 0, d) for d in range(-r, r + 1)) / (size * size)


def slopes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences down the rows and along the columns, one-sided at borders."""
    return tuple(np.gradient(a, axis=i) if a.shape[i] > 1 else np.full(a.shape, np.nan) for i in range(2))


def lineament(a: np.ndarray, half: int = 4, flank: int = 3, n_azimuths: int = 8) -> np.ndarray:
    """Along-strike mean less the larger flank mean, largest over azimuths all of whose cells are there."""
    best, size = np.full(a.shape, np.nan), 2 * half + 1
    sums: dict[tuple[int, int], np.ndarray] = {}
    for az, part, dy, dx in line_offsets(n_azimuths, half, flank):
        sums[az, part] = sums.get((az, part), 0) + moved(a, dy, dx, "constant")
    for az in range(n_azimuths):
        best = np.fmax(best, (sums[az, 0] - np.maximum(sums[az, -1], sums[az, 1])) / size)
    return best


def strike_means(a: np.ndarray, half: int = 4, n_azimuths: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Largest and mean of the along-strike means over the azimuths all of whose cells are there."""
    means = np.stack([sum(moved(a, dy, dx, "constant") for az, _, dy, dx in line_offsets(n_azimuths, half) if az == i) / (2 * half + 1) for i in range(n_azimuths)])
    there = ~np.isnan(means)
    count = there.sum(0)
    mean = np.where(there, means, 0).sum(0) / np.where(count, count, np.nan)
    return np.where(count > 0, np.where(there, means, -np.inf).max(0), np.nan), mean


def ring(radius: float, width: float = 1.5) -> list[tuple[int, int, float, float]]:
    """(dy, dx, uy, ux): the cells of a ring and their unit vectors outward."""
    r = range(-int(radius + width), int(radius + width) + 1)
    return [(y, x, y / math.hypot(y, x), x / math.hypot(y, x)) for y in r for x in r if (y or x) and abs(math.hypot(y, x) - radius) <= width / 2]


def ring_coherence(gy: np.ndarray, gx: np.ndarray, radius: float) -> np.ndarray:
    """Share of a ring's gradient that points outward; NaN unless the whole ring is there."""
    radial = energy = 0.0
    size = np.hypot(gy, gx)
    for dy, dx, uy, ux in ring(radius):
        radial = radial + moved(gy, dy, dx, "constant") * uy + moved(gx, dy, dx, "constant") * ux
        energy = energy + moved(size, dy, dx, "constant")
    return np.where(energy > 0, radial / energy, np.nan)


def ring_mean(c: np.ndarray, radius: float) -> np.ndarray:
    """Mean over a ring, zero beyond the border: as a ring is symmetric, its own transpose."""
    k = ring(radius)
    return sum(np.nan_to_num(moved(c, dy, dx, "constant")) for dy, dx, *_ in k) / len(k)


def rim_support(a: np.ndarray, edge: np.ndarray, radii: tuple[float, ...]) -> np.ndarray:
    """Centres' coherence of either sign cast back onto their rims, times the edge there; largest over radii.

    Reaches 1 + 2 * (max(radii) + 1.5) cells.
    """
    gy, gx = slopes(a)
    rims = [ring_mean(np.minimum(np.abs(np.nan_to_num(ring_coherence(gy, gx, r))), 1.0), r) for r in radii]
    return np.max(rims, axis=0) * edge


def horizon(a: np.ndarray, rays: int = 32, steps: int = 16, cell: float = 1.0) -> Arrays:
    """openness, magnitude, phase from the mean elevation angle along each ray.

    A ray's step k looks at the cell nearest to k cells along it, at distance k * cell; borders repeat. A cell with a
    missing value on any ray has none. Rays are swept one at a time, so memory is that of a few arrays.
    """
    total, c2, s2, size = (np.zeros(a.shape) for _ in range(4))
    for i in range(rays):
        t = 2 * math.pi * i / rays
        ray = sum(np.arctan2(moved(a, round(math.sin(t) * k), round(math.cos(t) * k)) - a, cell * k) for k in range(1, steps + 1)) / steps
        total, c2, s2, size = total + ray, c2 + math.cos(2 * t) * ray, s2 + math.sin(2 * t) * ray, size + np.abs(ray)
    phase = np.mod(0.5 * np.degrees(np.arctan2(s2, c2)), 180.0)
    return {"openness": 1 - total / rays / (math.pi / 2), "magnitude": np.hypot(c2, s2) / np.maximum(size, 1e-9), "phase": phase}


#: Unit steps along four strikes (45 degrees apart) and the steps across them.
STRIKES, NORMALS = ((0, 1), (1, 1), (1, 0), (1, -1)), ((1, 0), (-1, 1), (0, -1), (1, 1))


def lag_step(unit: tuple[int, int], lag: int) -> tuple[int, int, float]:
    """(dy, dx, scale): whole steps nearest to `lag` cells along a unit step, and lag**2 over their squared length."""
    k = max(1, round(lag / math.sqrt(2))) if unit[0] and unit[1] else lag
    dy, dx = unit[0] * k, unit[1] * k
    return dy, dx, lag * lag / max(dy * dy + dx * dx, 1)


def semivariances(a: np.ndarray, lag: int, sigma: float = 3.0) -> np.ndarray:
    """Smoothed half mean squared increments, forward and back, along each of the four strikes."""
    out = []
    for unit in STRIKES:
        dy, dx, scale = lag_step(unit, lag)
        f, b = moved(a, dy, dx) - a, moved(a, -dy, -dx) - a
        out.append(gaussian(0.25 * scale * (f * f + b * b), sigma))
    return np.stack(out)


def across(a: np.ndarray, offset: int = 5) -> np.ndarray:
    """Differences of a field between the two sides of each strike, `offset` cells off."""
    steps = [lag_step(u, offset) for u in NORMALS]
    return np.stack([moved(a, dy, dx) - moved(a, -dy, -dx) for dy, dx, _ in steps])


def log_jumps(a: np.ndarray, offset: int = 5) -> np.ndarray:
    return across(np.log(np.maximum(a, 0) + 1e-3), offset)


def texture_channels(z: Arrays, sigma: float = 3.0) -> Arrays:
    """Eight channels of texture contrast from filled, standardised bands: a, b two fields, c, d one field and
    its continuation, e, f two scalar fields, g, h two rates.

    Reaches 6 + 4 sigma + 5 cells.
    """
    var = {k: {lag: semivariances(z[k], lag, sigma) for lag in lags} for k, lags in (("a", (2, 3, 6)), ("b", (2, 3, 6)), ("c", (3,)), ("d", (3,)))}
    jump = {(k, lag): log_jumps(v.mean(0)) for k, by in var.items() for lag, v in by.items()}
    both = lambda p, q: np.sqrt(np.maximum(0.0, p * q)).max(0)  # noqa: E731 - one sign on both, else 0
    spectral = np.log((np.maximum(var["a"][2].mean(0), 0) + 1e-3) / (np.maximum(var["a"][6].mean(0), 0) + 1e-3))
    ratio = lambda k: np.log((np.maximum(np.roll(var[k][3], -2, axis=0), 0) + 1e-3) / (np.maximum(var[k][3], 0) + 1e-3))
    e, f = (np.abs(across(gaussian(z[k], 2.0))) for k in "ef")
    gate = lambda k: 0.5 + 0.5 / (1 + np.exp(-z[k]))
    concord = both(jump["a", 2], jump["b", 2])
    return {
        "jump_a": both(jump["a", 2], jump["a", 6]), "jump_b": both(jump["b", 2], jump["b", 6]), "concordance": concord,
        "spectral_step": np.abs(across(spectral)).max(0), "persistence": both(jump["c", 3], jump["d", 3]),
        "anisotropy": np.maximum(0.0, 0.5 * (ratio("a") + ratio("b"))).max(0), "scalar_step": np.sqrt(e * f).max(0), "strained": concord * gate("g") * gate("h"),
    }


#: Accepted solutions: depth, plan offset and residual.
DEPTHS, PLAN, RESIDUAL = (0.5, 15.0), 3.5, 0.15


def window_solutions(f: np.ndarray, fz: np.ndarray, valid: np.ndarray, window: int = 7, residual_max: float = RESIDUAL) -> Arrays:
    """x0, y0, z0, residual, accepted: least squares of u Fx + v Fy = x0 Fx + y0 Fy + z0 Fz over each window.

    `f` and `fz` are filled; windows beyond the border repeat its products; `valid` says which centres count. Sums of products by
    offsets give the normal equations, cofactors solve them. A window is solvable if its determinant
    stands out from its trace. Reaches window // 2 + 1 cells.
    """
    fy, fx = slopes(f)
    half = range(-(window // 2), window // 2 + 1)
    product = {"xx": fx * fx, "xy": fx * fy, "xz": fx * fz, "yy": fy * fy, "yz": fy * fz, "zz": fz * fz}

    def total(name: str, weight=lambda v, u: 1.0) -> np.ndarray:
        return sum(weight(v, u) * moved(product[name], v, u) for v in half for u in half if weight(v, u))

    u, v = (lambda v, u: u), (lambda v, u: v)
    sxx, sxy, sxz, syy, syz, szz = (total(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    r = total("xx", u) + total("xy", v), total("xy", u) + total("yy", v), total("xz", u) + total("yz", v)
    bb = total("xx", lambda v, u: u * u) + 2 * total("xy", lambda v, u: u * v) + total("yy", lambda v, u: v * v)
    co = [
        [syy * szz - syz * syz, sxz * syz - sxy * szz, sxy * syz - sxz * syy],
        [sxz * syz - sxy * szz, sxx * szz - sxz * sxz, sxz * sxy - sxx * syz],
        [sxy * syz - sxz * syy, sxz * sxy - sxx * syz, sxx * syy - sxy * sxy],
    ]
    det = sxx * co[0][0] + sxy * co[0][1] + sxz * co[0][2]
    trace = sxx + syy + szz
    solvable = valid & (trace > 0) & (np.abs(det) > 1e-10 * np.maximum((trace / 3) ** 3, 1e-30)) & (bb > 0)
    det = np.where(solvable, det, np.nan)
    x0, y0, z0 = (sum(c * s for c, s in zip(row, r, strict=True)) / det for row in co)
    residual = np.sqrt(np.maximum(bb - (x0 * r[0] + y0 * r[1] + z0 * r[2]), 0) / np.maximum(bb, 1e-30))
    depth = np.abs(z0)
    ok = solvable & (depth >= DEPTHS[0]) & (depth <= DEPTHS[1]) & (np.abs(x0) <= PLAN) & (np.abs(y0) <= PLAN) & (residual < residual_max)
    return {"x0": x0, "y0": y0, "z0": z0, "residual": residual, "accepted": np.where(valid, ok.astype(float), np.nan)}
