"""Top-k, apportionment, sampling by hash, and greedy selection as parallel rounds."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalar import hashed
from gridloom.operators import tiles
from gridloom.operators.distance import components, written
from gridloom.operators.stencil import Kernel, scatter, triangular


def top_positive(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best positive scores, ties to the least key; never padded."""
    return df.where((F.col(score) > 0) & ~F.isnan(score)).orderBy(F.desc(score), key).limit(k)


def apportion(df: DataFrame, weight: str, key: str, total: int) -> DataFrame:
    """df with n: whole shares of total by largest remainder, ties to the least key."""
    every = Window.partitionBy()
    share = F.col(weight) * total / F.sum(weight).over(every)
    df = df.withColumn("__s", share).withColumn("__f", F.floor("__s"))
    df = df.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__s") - F.col("__f"), 9)), key)))
    left = total - F.sum("__f").over(every)
    return df.withColumn("__l", left).withColumn("n", F.col("__f") + (F.col("__r") <= F.col("__l")).cast("long")).drop("__s", "__f", "__r", "__l")


#: A sample of more rows is not sorted in one task.
SORTED = 100_000


def sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows by hash order: the same rows in any engine. Of a large sample only the range of hashes that holds the last row is sorted."""
    df = df.withColumn("__h", hashed(F.lit(seed), key))
    if k <= SORTED:
        return df.orderBy("__h", key).limit(k).drop("__h")
    df = df.withColumn("__p", F.coalesce(F.shiftright("__h", 36), F.lit(-1)))  # 4,096 ranges, nulls before them
    left = k
    for r in sorted(df.groupBy("__p").count().collect()):
        if r["count"] > left:
            last = df.where(F.col("__p") == r["__p"]).orderBy("__h", key).limit(left)
            return df.where(F.col("__p") < r["__p"]).unionByName(last).drop("__h", "__p")
        left -= r["count"]
    return df.drop("__h", "__p")


def stratified(df: DataFrame, stratum: str, key: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows of each stratum by hash order."""
    w = Window.partitionBy(stratum).orderBy("__h", key)
    return df.withColumn("__h", hashed(F.lit(seed), key)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__h", "__r")


def _within(radius: float) -> list[tuple[int, int, float]]:
    """Offsets nearer than radius, itself left out."""
    r = range(-int(radius) - 1, int(radius) + 2)
    return [(a, b, 1.0) for a in r for b in r if 0 < a * a + b * b < radius * radius]


#: Candidates looked at together: so many for each dot asked for, so many at least, and so many times more when those did not do.
AHEAD, LEAST, FURTHER = 64, 4096, 8


def _spread(df: DataFrame, kernel: Kernel) -> DataFrame:
    """`scatter` for a side of a join: many times as large as the file it comes from, so never broadcast, whatever the planner takes it for."""
    return scatter(df, kernel).hint("merge")


def _without(df: DataFrame, dots: DataFrame, ring: Kernel) -> DataFrame:
    """df without the dots' own cells and those at the ring's offsets."""
    return df.join(_spread(dots.select("y", "x"), [*ring, (0, 0, 1.0)]).select("y", "x"), ["y", "x"], "left_anti")


def _outranking(df: DataFrame, rank: Column, reach: Kernel) -> DataFrame:
    """Rows of df that no other within reach outranks."""
    rival = scatter(df, reach).groupBy("y", "x").agg(F.max(rank).alias("best")).hint("merge")
    return df.join(rival, ["y", "x"], "left").where(F.col("best").isNull() | (rank > F.col("best"))).drop("best")


def _cut(df: DataFrame, value: str, rows: float):
    """A value that about so many rows of df reach; None if all of df is no more."""
    n = df.count()
    return df.agg(F.percentile_approx(value, F.lit(1 - rows / n), 10_000)).first()[0] if n > rows else None


def poisson(df: DataFrame, score: str, key: str, *, spacing: float = 3.0, k: int | None = None) -> DataFrame:
    """Dots in rank order with no two nearer than spacing; the first k of them.

    The sequential scan's result is the first maximal independent set by rank: in each round every
    undecided cell that outranks its undecided neighbours is taken, and its neighbours go. With k, the best cells
    are decided first; the rest, which none of them can lose to, come in only where those do not give k dots.
    """
    rest = written(df.where(F.col(score) > 0).select("y", "x", F.col(score).alias("s"), F.col(key).alias("id")))
    ring, taken = _within(spacing), None
    rank = F.struct(F.col("s"), -F.col("id"))
    rows = math.inf if k is None else max(LEAST, AHEAD * k)
    while True:
        cut = None if k is None else _cut(rest, "s", rows)
        left = rest if cut is None else written(rest.where(F.col("s") >= cut))
        enough = False
        while not enough and left.limit(1).count():
            fresh = written(_outranking(left, rank, ring))
            taken = fresh if taken is None else taken.unionByName(fresh)
            left = written(_without(left, fresh, ring))
            if k is not None:
                # what is undecided cannot come before the k-th of those taken that outrank all of it
                best = left.agg(F.max(rank).alias("best")).first()["best"]
                ahead = taken if best is None else taken.where((F.col("s") > best[0]) | ((F.col("s") == best[0]) & (-F.col("id") > best[1])))
                enough = ahead.count() >= k
        if enough or cut is None:
            break
        rest, rows = rest.where(F.col("s") < cut), rows * FURTHER
        rest = written(rest if taken is None else _without(rest, taken, ring))
    out = taken if taken is not None else rest
    return out.orderBy(F.desc("s"), "id").limit(k) if k is not None else out


def cover(
    df: DataFrame, weight: str, key: str, *, k: int, radius: int = 3, spacing: float = 0.0,
    candidates: DataFrame | None = None, existing: DataFrame | None = None, cost: str | None = None, pool: int | None = None,
) -> DataFrame:
    """k dots by greedy kernel coverage: each adds sum w * max(0, kernel - covered so far), less its cost; w is the weight
    within [0, 1], none counts as 0.

    A dot's gain depends only on dots nearer than twice the radius, so in each round every
    undecided cell whose gain is the largest within that reach is what the sequential greedy takes before
    any of its neighbours. The first k by recorded gain are its first k. Gains only fall as dots are added, so rounds run over
    the candidates with the largest first gains, in whose presence no other is taken; more come in only where those
    do not give k dots.

    Dots come from `candidates` (y, x, the key, the weight; df if none is given), the `pool` best by weight if
    one is set. `existing` dots cover from the start, and nothing nearer than spacing to them is taken. A
    candidate that adds no coverage is never taken, one whose cost is above what it adds may be.
    """
    kern = triangular(radius)
    reach, ring = _within(max(2 * radius, spacing)), _within(spacing) if spacing else []
    within = F.least(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    demand = written(df.select("y", "x", within.alias("wt")))
    some = df if candidates is None else candidates
    if pool is not None:
        some = some.orderBy(F.desc(weight), key).limit(pool)
    fee = F.coalesce(F.col(cost), F.lit(0.0)) if cost else F.lit(0.0)
    rest = some.select("y", "x", F.col(key).alias("id"), fee.alias("fee"))
    dots = None if existing is None else existing.select("y", "x")
    if dots is not None and spacing:
        rest = _without(rest, dots, ring)
    rest = written(rest)
    rank = F.struct(F.col("gain"), -F.col("id"))

    def covering(cells: DataFrame) -> DataFrame:
        """cells by how far the nearest of them covers a place."""
        return scatter(cells.select("y", "x"), kern).groupBy("y", "x").agg(F.max("w").alias("g")).hint("merge")

    def gains(left: DataFrame, field: DataFrame) -> DataFrame:
        reachable = _spread(left.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "id", "fee", "y", "x"), kern)
        adds = F.round(F.sum(F.col("wt") * F.greatest(F.lit(0.0), F.col("w") - F.col("c"))), 9)
        got = reachable.join(field, ["y", "x"]).groupBy("sy", "sx", "id", "fee").agg(adds.alias("adds")).where("adds > 1e-9")
        return got.select(F.col("sy").alias("y"), F.col("sx").alias("x"), "id", "fee", F.round(F.col("adds") - F.col("fee"), 9).alias("gain"))

    def covered(field: DataFrame, by: DataFrame) -> DataFrame:
        return field.join(covering(by), ["y", "x"], "left").select("y", "x", "wt", F.greatest("c", F.coalesce("g", F.lit(0.0))).alias("c"))

    bare = demand.withColumn("c", F.lit(0.0))
    # a gain only falls as dots are added, so the first ones are bounds
    rest = written(gains(rest, bare if dots is None else covered(bare, dots)))
    taken, rows = None, max(LEAST, AHEAD * k)
    while True:
        cut = _cut(rest, "gain", rows)
        left = rest if cut is None else written(rest.where(F.col("gain") >= cut))
        field = bare.join(_spread(left.select("y", "x"), kern).select("y", "x"), ["y", "x"], "left_semi")
        for by in (dots, taken):
            field = field if by is None else covered(field, by)
        field = written(field)
        enough = False
        while not enough:
            live = gains(left, field)
            live = written(live if cut is None else live.where(F.col("gain") >= cut))
            fresh = written(_outranking(live, rank, reach))
            taken = fresh if taken is None else taken.unionByName(fresh)
            best = live.join(fresh.select("y", "x").hint("merge"), ["y", "x"], "left_anti").agg(F.max("gain")).first()[0]
            enough = (taken if best is None else taken.where(F.col("gain") > best)).count() >= k
            if best is None:
                break
            field = written(covered(field, fresh))
            left = written(_without(live.select("y", "x", "id", "fee"), fresh, ring))
        if enough or cut is None:
            break
        rest, rows = written(_without(rest, taken, ring)), rows * FURTHER
    return taken.orderBy(F.desc("gain"), "id").limit(k).drop("fee")


def staged(df: DataFrame, key: str, stages: list[tuple[str, int]], *, spacing: float, candidates: DataFrame | None = None, cost: Callable[[DataFrame, str], Column] | None = None) -> DataFrame:
    """Dots (y, x, id, gain, stage) of several coverage stages (weight, k), each on top of the dots before.

    A stage that runs out of candidates leaves its rest to the next; the last one fills up
    to the sum of all k. cost: a candidate's fee, from the candidates and the stage's weight.
    """
    budget, dots, n = sum(k for _, k in stages), None, 0
    for i, (weight, k) in enumerate(stages):
        want = budget - n if i == len(stages) - 1 else min(k, budget - n)
        if want <= 0:
            break
        some = df if candidates is None else candidates
        some = some.where(F.col(weight) > 0)
        if cost is not None:
            some = some.withColumn("fee_of", cost(some, weight))
        got = written(cover(df, weight, key, k=want, spacing=spacing, candidates=some, existing=dots, cost="fee_of" if cost is not None else None).withColumn("stage", F.lit(i + 1)))
        n += got.count()
        dots = got if dots is None else dots.unionByName(got)
    return dots


def net_cost(mu: str, tau: float) -> Callable[[DataFrame, str], Column]:
    """A dot's fee: tau times the stage's mean candidate weight, less where the kernel mean mu is high."""

    def fee(some: DataFrame, weight: str) -> Column:
        mean = some.agg(F.avg(weight)).first()[0] or 0.0
        return F.lit(tau * max(mean, 1e-4)) * (1.0 - F.least(F.greatest(F.coalesce(F.col(mu), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))

    return fee


#: Cells whose components are walked together; a tile of a thinning sees so many cells beyond those that could block it.
WALKED, BEYOND = 20_000, 14


def geodesic_thin(mask: DataFrame, width: int, spacing: float) -> DataFrame:
    """Dots of a mask, breadth first from each component's first cell in raster order, none nearer than spacing.

    A walk gives each cell its place in the scan, whole components at a time. Then tiles go through their cells in that
    order: what depends on a cell that is not decided yet waits for the next round, and all else is as in one
    scan of the whole mask. Clusters of near components may so be of any size; the largest single component is walked in one task.
    """
    parts = written(components(mask, width))
    buckets = max(1, parts.count() // WALKED)
    walked = parts.groupBy(F.pmod(F.xxhash64("comp"), F.lit(buckets)).alias("bucket")).applyInArrow(_walk, "y long, x long, comp long, place long")
    r = max((max(a, b) for a, b, _ in _within(spacing)), default=0)
    halo = r + BEYOND
    # off the arrays' borders, so that only the edge of what a tile sees is undecided
    left = written(walked.select((F.col("y") + halo).alias("y"), (F.col("x") + halo).alias("x"), "comp", "place", F.lit(OPEN).alias("state")))
    n = ((left.agg(F.max("y")).first()[0] or 0) + halo + 1, width + 2 * halo)
    kept = None
    while left.where(F.col("state") == OPEN).limit(1).count():
        got = tiles.tiled(left, ["comp", "place", "state"], lambda z: {"now": _scanned(z, _within(spacing), r)}, ["now"], n, halo)
        after = written(left.drop("state").join(got.where(F.col("now") > 0).hint("merge"), ["y", "x"]).withColumn("state", F.col("now").cast("int")).drop("now"))
        fresh = after.where(F.col("state") == KEPT)
        # only dots that may still block an open cell stay in the rounds
        near = scatter(after.where(F.col("state") == OPEN).select("y", "x"), _within(spacing)).select("y", "x").distinct()
        left = written(after.where(F.col("state") == OPEN).unionByName(fresh.join(near.hint("merge"), ["y", "x"], "left_semi")))
        kept = fresh if kept is None else kept.unionByName(fresh)
    kept = left if kept is None else kept
    return kept.select((F.col("y") - halo).alias("y"), (F.col("x") - halo).alias("x")).distinct()


#: States of a cell in a thinning; those that are out have no row.
KEPT, OPEN = 1, 2


def _walk(table: pa.Table) -> pa.Table:
    """Cells of whole components with their place: breadth first from each component's first cell, in raster order."""
    rows = zip(*(table.column(c).to_pylist() for c in ("y", "x", "comp")), strict=True)
    comp = {(y, x): c for y, x, c in rows}
    order, queued = [], set()
    for start in sorted(comp):
        if start in queued:
            continue
        queued.add(start)
        todo = deque([start])
        while todo:
            y, x = todo.popleft()
            order.append((y, x))
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    q = (y + a, x + b)
                    if q in comp and q not in queued:
                        queued.add(q)
                        todo.append(q)
    ys, xs = zip(*order, strict=True)
    return pa.table({"y": ys, "x": xs, "comp": [comp[q] for q in order], "place": list(range(len(order)))})


def _scanned(z: dict[str, np.ndarray], ring: Kernel, r: int) -> np.ndarray:
    """State of every cell of a tile after a scan by (comp, place): kept, open or 0 for out. Cells at the edge see too little to be kept."""
    later, (h, w) = 3, z["state"].shape
    state = np.pad(np.where(z["state"] == OPEN, later, np.nan_to_num(z["state"])), r).astype(int).ravel().tolist()
    ys, xs = np.nonzero(z["state"] == OPEN)
    order = np.lexsort((z["place"][ys, xs], z["comp"][ys, xs]))
    wide = w + 2 * r
    whole = ((ys >= r) & (ys < h - r) & (xs >= r) & (xs < w - r))[order].tolist()
    offsets = [a * wide + b for a, b, _ in ring]
    for c, sees in zip((((ys + r) * wide + xs + r)[order]).tolist(), whole, strict=True):
        near = [state[c + o] for o in offsets]
        state[c] = 0 if KEPT in near else OPEN if OPEN in near or not sees else KEPT
    return np.array(state).reshape(h + 2 * r, wide)[r : r + h, r : r + w].astype(float)
