"""Boosted trees on histograms with a bin of their own for missing values.

Features are cut once at quantiles into at most `bins` bins, a byte each; null and NaN have byte 255 and are never
filled in. Each level of a tree is one pass over the rows: tasks add up gradients by (node, feature, bin) with
numpy, Spark sums the tasks' tables, running sums along the bins give every split's two sides, with the
missing rows sent to either, and each open node's best split comes back as one row. Trees grow level by
level down to `depth`; then the `leaves` leaves that a best-first order would reach first are kept.
Gradients are added as whole numbers of 2**-30, so sums do not depend on how rows are dealt, and the same
rows give the same trees under any partitioning. Models on other rows or labels of the same table (folds, draws of a null)
grow in the same passes. A model is a list of small trees on the driver; rows keep their scores in a written table that is
renewed every `RENEW` rounds.

Defined results: rows with a null label or weight take no part in a fit; a fit without rows, or on one class, has no
splits; a value missing only when scoring follows the larger side; a feature that is null in all rows is never used.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.distance import written

MISSING, UNIT, RENEW = 255, 1 << 30, 16


@dataclass(frozen=True)
class Settings:
    rounds: int = 190
    rate: float = 0.055
    leaves: int = 31
    least: int = 80
    l2: float = 2.5
    depth: int = 6
    bins: int = 255
    #: "log" for probabilities of a 0/1 label, "squared" for means.
    loss: str = "log"


@dataclass
class Tree:
    """Nodes by number; a leaf has left -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, 0), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of bins."""
        at = np.zeros(len(bins), np.int64)
        left, right, feature, cut, missing = (np.array(x) for x in (self.left, self.right, self.feature, self.cut, self.missing_left))
        while True:
            inner = np.flatnonzero(left[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            b = bins[inner, feature[here]]
            goes = np.where(b == MISSING, missing[here], b <= cut[here])
            at[inner] = np.where(goes, left[here], right[here])


@dataclass
class Model:
    columns: list[str]
    cuts: list[np.ndarray]
    base: float
    settings: Settings
    #: Whether the fit has seen each column missing.
    lost: list[bool]
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for j, (v, cuts) in enumerate(zip(columns, self.cuts, strict=True)):
            out[:, j] = np.where(np.isnan(v), MISSING, np.searchsorted(cuts, v, side="left"))
        return out

    def margin(self, bins: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        total = np.zeros(len(bins))
        for t in self.trees if trees is None else trees:
            total += np.array(t.value)[t.node(bins)]
        return total

    def value(self, bins: np.ndarray) -> np.ndarray:
        raw = self.base + self.margin(bins)
        return 1 / (1 + np.exp(-raw)) if self.settings.loss == "log" else raw

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """df with the probability, or the mean, as column `out`."""
        return predicted([self], df, F.lit(0), out)


def quantile_cuts(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """For each column the upper ends of its bins but the last, at most bins - 1; read once, so a fit has one set."""
    at = [i / bins for i in range(1, bins)]
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(clean(c), at, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [np.array(sorted(set(x or []))) for x in row]


def gradients(y: np.ndarray, raw: np.ndarray, w: np.ndarray, loss: str, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss in whole units."""
    p = 1 / (1 + np.exp(-raw)) if loss == "log" else raw
    h = p * (1 - p) if loss == "log" else np.ones(len(y))
    return np.rint((p - y) * w * unit), np.rint(h * w * unit)


#: Nodes of model k are numbered from k * NODES.
NODES = 1 << 12


def _matrix(batch: pa.RecordBatch, column: str, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind).reshape(-1, n)


def _packed(a: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in a], pa.binary())


def _sums(models: list[Model], pending: list[list[Tree]], trees: list[Tree], opened: list[list[int]], unit: float):
    """Each task's sums of gradients of the open nodes' rows by (node, feature, bin), for all models at once."""
    n, m = len(models[0].columns), len(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((3, len(o), n, 256), np.int64) for o in opened]
        for batch in batches:
            every, w = _matrix(batch, "bins", np.uint8, n), batch.column("w").to_numpy()
            ys, raws, uses = (_matrix(batch, c, kind, m) for c, kind in (("y", float), ("raw", float), ("uses", np.uint8)))
            for k in range(m):
                if not opened[k]:
                    continue
                slot = np.full(len(trees[k].left), -1)
                slot[opened[k]] = np.arange(len(opened[k]))
                node = np.where(uses[:, k] > 0, slot[trees[k].node(every)], -1)
                keep = node >= 0
                bins, node = every[keep], node[keep]
                g, h = gradients(ys[keep, k], raws[keep, k] + models[k].margin(bins, pending[k]), w[keep], models[k].settings.loss, unit)
                for j in range(n):
                    at = node * 256 + bins[:, j]
                    for i, weight in enumerate((g, h, None)):
                        total[k][i, :, j] += np.bincount(at, weight, len(opened[k]) * 256).astype(np.int64).reshape(-1, 256)
        for k in range(m):
            node, feature, b = np.nonzero(total[k][2])
            cols = [k * NODES + np.array(opened[k], np.int32)[node] if opened[k] else node, feature, b]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in cols] + [pa.array(total[k][i][node, feature, b]) for i in range(3)], ["node", "feature", "bin", "g", "h", "n"])

    return run


def best_splits(sums: DataFrame, s: Settings, unit: float) -> DataFrame:
    """node, gain, feature, bin, missing_left, and g, h, n of the left side and of the node: each node's best split.

    sums: (node, feature, bin, g, h, n) with bin 255 for missing rows. Ties go to the least feature, the least
    bin, and missing rows on the right.
    """
    side = Window.partitionBy("node", "feature")
    upto = side.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("bin") < MISSING
    d = sums.select(
        "node", "feature", "bin",
        *[F.sum(F.when(known, F.col(c))).over(upto).alias(f"l{c}") for c in "ghn"],
        *[F.coalesce(F.sum(F.when(~known, F.col(c))).over(side), F.lit(0)).alias(f"m{c}") for c in "ghn"],
        *[F.sum(c).over(side).alias(f"t{c}") for c in "ghn"],
    ).where(known)
    d = d.withColumn("missing_left", F.explode(F.when(F.col("mn") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    d = d.withColumns({f"l{c}": F.col(f"l{c}") + F.when(F.col("missing_left"), F.col(f"m{c}")).otherwise(0) for c in "ghn"})
    score = lambda g, h: (g / unit) * (g / unit) / (h / unit + s.l2)
    lg, lh, tg, th = F.col("lg"), F.col("lh"), F.col("tg"), F.col("th")
    gain = score(lg, lh) + score(tg - lg, th - lh) - score(tg, th)
    d = d.where((F.col("ln") >= s.least) & (F.col("tn") - F.col("ln") >= s.least) & (F.least(lh, th - lh) >= unit * 1e-3)).withColumn("gain", gain)
    first = F.struct("gain", -F.col("feature"), -F.col("bin"), ~F.col("missing_left"))
    kept = ["gain", "feature", "bin", "missing_left", "lg", "lh", "ln", "tg", "th", "tn"]
    return d.where("gain > 0").groupBy("node").agg(F.max_by(F.struct(*kept), first).alias("b")).select("node", "b.*")


def pruned(tree: Tree, gain: dict[int, float], leaves: int) -> Tree:
    """The tree that best-first growth reaches with so many leaves."""
    out, order = Tree(), 0
    heap: list[tuple[float, int, int, int]] = []

    def put(node: int) -> int:
        nonlocal order
        new = out.add(tree.value[node])
        if tree.left[node] >= 0:
            heapq.heappush(heap, (-gain[node], order, node, new))
            order += 1
        return new

    put(0)
    count = 1
    while heap and count < leaves:
        _, _, node, new = heapq.heappop(heap)
        out.feature[new], out.cut[new], out.missing_left[new] = tree.feature[node], tree.cut[node], tree.missing_left[node]
        out.left[new] = put(tree.left[node])
        out.right[new] = put(tree.right[node])
        count += 1
    return out


def grown(rows: DataFrame, models: list[Model], pending: list[list[Tree]], unit: float) -> list[Tree]:
    """The next tree of every model: a pass over the rows for each level."""
    s, trees, gains = models[0].settings, [Tree() for _ in models], [{} for _ in models]
    step = lambda g, h: -s.rate * g / unit / (h / unit + s.l2) if h or s.l2 else 0.0
    opened = [[t.add(0.0)] for t in trees]
    for _ in range(s.depth):
        parts = rows.mapInArrow(_sums(models, pending, trees, opened, unit), "node int, feature int, bin int, g long, h long, n long")
        # tasks have added up their rows: one deal by node and feature serves the sums and their running totals
        sums = parts.repartition("node", "feature").groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
        opened = [[] for _ in models]
        for r in sorted(best_splits(sums, s, unit).collect(), key=lambda r: r["node"]):  # a row a node
            k, i = divmod(r["node"], NODES)
            tree = trees[k]
            tree.feature[i], tree.cut[i], gains[k][i] = r["feature"], r["bin"], r["gain"]
            # where the fit has no missing value, rows that lack one follow the larger side
            tree.missing_left[i] = bool(r["missing_left"]) if models[k].lost[r["feature"]] else 2 * r["ln"] > r["tn"]
            tree.value[i] = step(r["tg"], r["th"])
            tree.left[i] = tree.add(step(r["lg"], r["lh"]))
            tree.right[i] = tree.add(step(r["tg"] - r["lg"], r["th"] - r["lh"]))
            opened[k] += [j for j, n in ((tree.left[i], r["ln"]), (tree.right[i], r["tn"] - r["ln"])) if n >= 2 * s.least]
        if not any(opened):
            break
    return [pruned(t, g, s.leaves) for t, g in zip(trees, gains, strict=True)]


def fit_many(df: DataFrame, columns: list[str], labels: list[Column], uses: list[Column], settings: Settings = Settings(), weight: Column | None = None) -> list[Model]:
    """A model for each label and each condition on the rows to learn from, all grown in the same passes."""
    names, m = [f"f{i}" for i in range(len(columns))], len(labels)
    known = df.select(
        *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)], (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"),
        F.array(*[F.coalesce(y.cast("double"), F.lit(0.0)) for y in labels]).alias("ys"), F.array(*[F.coalesce(u & y.isNotNull(), F.lit(False)).cast("int") for u, y in zip(uses, labels, strict=True)]).alias("us"),
    ).where("w IS NOT NULL")
    lost = [F.max(F.col(c).isNull() | F.isnan(c)).alias(c) for c in names]
    used = [F.col("us")[k] * F.col("w") for k in range(m)]
    sums = [x for k in range(m) for x in (F.sum(used[k] * F.col("ys")[k]).alias(f"y{k}"), F.sum(used[k]).alias(f"w{k}"), F.max(F.abs(F.col("ys")[k])).alias(f"t{k}"))]
    one = known.agg(*sums, *lost).first()
    cuts, models = quantile_cuts(known, names, settings.bins), []
    for k in range(m):
        mean = (one[f"y{k}"] or 0.0) / one[f"w{k}"] if one[f"w{k}"] else 0.0
        inside = min(max(mean, 1e-7), 1 - 1e-7)
        base = math.log(inside / (1 - inside)) if settings.loss == "log" else mean
        models.append(Model(list(columns), cuts, base, settings, [bool(one[c]) for c in names]))
    if not any(one[f"w{k}"] for k in range(m)):
        return models
    unit = UNIT if settings.loss == "log" else UNIT / max(1.0, *[one[f"t{k}"] or 0.0 for k in range(m)])
    schema, kept = "w double, y binary, uses binary, bins binary, raw binary", ["w", "y", "uses", "bins", "raw"]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = models[0].binned([b.column(c).to_numpy(zero_copy_only=False) for c in names])
            ys = b.column("ys").flatten().to_numpy().reshape(-1, m)
            uses = b.column("us").flatten().to_numpy().reshape(-1, m).astype(np.uint8)
            raw = np.tile([x.base for x in models], (len(bins), 1))
            yield pa.RecordBatch.from_arrays([b.column("w"), _packed(ys), _packed(uses), _packed(bins), _packed(raw)], kept)

    def moved(pending: list[list[Tree]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = _matrix(b, "bins", np.uint8, len(names))
                raw = _matrix(b, "raw", float, m) + np.stack([x.margin(bins, p) for x, p in zip(models, pending, strict=True)], axis=1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept[:-1]), _packed(raw)], kept)

        return run

    rows, pending = written(known.mapInArrow(start, schema)), [[] for _ in models]
    for _ in range(settings.rounds):
        for k, tree in enumerate(grown(rows, models, pending, unit)):
            models[k].trees.append(tree)
            pending[k] = [*pending[k], tree]
        if len(pending[0]) == RENEW:
            rows, pending = written(rows.mapInArrow(moved(pending), schema)), [[] for _ in models]
    return models


def fit(df: DataFrame, columns: list[str], label: str, settings: Settings = Settings(), weight: str | None = None) -> Model:
    """Trees on `columns` for a 0/1 label (log loss) or a number (squared loss)."""
    return fit_many(df, columns, [F.col(label)], [F.lit(True)], settings, None if weight is None else F.col(weight))[0]


def predicted(models: list[Model], df: DataFrame, which: Column, out: str) -> DataFrame:
    """df with each row's value by the model whose place `which` gives; null where it gives none."""

    @F.pandas_udf("double")
    def scored(at: pd.Series, *series: pd.Series) -> pd.Series:
        bins, result = models[0].binned([s.to_numpy(float, na_value=np.nan) for s in series]), np.full(len(at), np.nan)
        for k, model in enumerate(models):
            rows = (at == k).to_numpy(bool, na_value=False)
            result[rows] = model.value(bins[rows])
        return pd.Series(result)

    got = scored(which.cast("long"), *[F.col(c).cast("double") for c in models[0].columns])
    return df.withColumn(out, F.when(which.between(0, len(models) - 1), got))
