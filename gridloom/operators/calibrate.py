"""Residualisers and calibrators: what a nuisance explains is fitted on training rows and taken out.

Every fit is a few aggregates and one ridge on spline bases; what comes back is a set of column
expressions, so applying it is a projection. Quantiles are sketches of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import clip, expit, logit
from gridloom.operators.models import quantile_knots, ridge

#: Entries of a quantile sketch: the rank error is one part in so many.
ACCURACY = 100_000


def pieces(knots: list[float]) -> list[list[tuple[float, float, float]]]:
    """The quadratic of each degree-2 B-spline on each interval between knots, in the distance from its left end."""
    t = [knots[0]] * 2 + list(knots) + [knots[-1]] * 2

    def value(i: int, d: int, x: float, j: int) -> float:
        if d == 0:
            return float(i == j + 2)  # x lies in interval j
        left = (x - t[i]) / (t[i + d] - t[i]) * value(i, d - 1, x, j) if t[i + d] > t[i] else 0.0
        right = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * value(i + 1, d - 1, x, j) if t[i + d + 1] > t[i + 1] else 0.0
        return left + right

    out = []
    for i in range(len(t) - 3):
        row = []
        for j, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
            h = b - a
            y0, y1, y2 = (value(i, 2, x, j) for x in (a, a + h / 2, b))
            row.append((y0, (4 * y1 - 3 * y0 - y2) / h, 2 * (y0 - 2 * y1 + y2) / (h * h)))
        out.append(row)
    return out


def spline(c: Column, knots: list[float]) -> list[Column]:
    """The degree-2 basis on the knots, one quadratic to an interval; beyond the ends the ends' values."""
    x = F.least(F.greatest(c, F.lit(knots[0])), F.lit(knots[-1]))
    out = []
    for row in pieces(knots):
        live = [(j, q) for j, q in enumerate(row) if any(q)]
        e = None
        for j, (p, q, r) in live:
            d = x - knots[j]
            v = p + d * (q + d * r)
            last = j == len(row) - 1
            here = F.lit(True) if last else x < knots[j + 1]
            e = F.when(here, v) if e is None else e.when(here, v)
        first = live[0][0] if live else 0
        out.append(F.when(x >= knots[first], e.otherwise(0.0)).otherwise(0.0) if e is not None and first else (e.otherwise(0.0) if e is not None else F.lit(0.0)))
    return out


def _quantile(c: Column, q: float) -> Column:
    return F.percentile_approx(c, q, ACCURACY)


def _dot(columns: list[Column], weights: list[float]) -> Column:
    return sum((b * w for b, w in zip(columns, weights, strict=True)), F.lit(0.0))


@dataclass(frozen=True)
class Basis:
    """Splines of nuisance columns, products of the first two's, and each spline by category."""

    columns: list[Column]

    @classmethod
    def fit(cls, train: DataFrame, nuisance: list[str], *, category: str | None = None, kinds: list | None = None) -> Basis:
        parts = [spline(F.col(c), quantile_knots(train.where(F.col(c).isNotNull()), c)) for c in nuisance]
        out = [b for p in parts for b in p]
        if len(parts) > 1:
            out += [a * b for a in parts[0] for b in parts[1]]
        for k in kinds or ():
            here = (F.col(category) == k).cast("double")
            out += [here, *[here * b for p in parts for b in p]]
        return cls(out)

    def mean(self, df: DataFrame, label: str, alpha: float, more: list[Column] | None = None) -> tuple[Column, Column]:
        """(ridge mean of the label, its part by this basis alone without intercept); `more` columns are fitted beside it."""
        every = [*self.columns, *(more or [])]
        names = [f"__b{i}" for i in range(len(every))]
        model = ridge(df.withColumns(dict(zip(names, every, strict=True))), names, label, alpha)
        w = model.coefficients.toArray().tolist()
        own = _dot(self.columns, w[: len(self.columns)])
        rest = _dot(more, w[len(self.columns) :]) if more else F.lit(0.0)
        return own + rest + F.lit(float(model.intercept)), own


@dataclass(frozen=True)
class Residualiser:
    """Scales and conditional means of target columns; every other column passes untouched."""

    median: dict[str, float]
    scale: dict[str, float]
    mean: dict[str, Column]

    @classmethod
    def fit(cls, train: DataFrame, basis: Basis, targets: list[str], *, scaled: list[str] = (), alpha: float = 100.0, least: int = 32) -> Residualiser:
        """targets are scaled and lose their conditional mean, `scaled` columns are only scaled; one that is
        known in fewer than `least` training rows is left as it is."""
        names = [*targets, *[c for c in scaled if c not in targets]]
        one = train.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in names for k, f in (("n", F.count), ("m", lambda x: _quantile(x, 0.5)), ("s", F.stddev_pop))]).first()
        names = [c for c in names if one[f"n_{c}"] >= least]
        if not names:
            return cls({}, {}, {})
        mad = train.agg(*[_quantile(F.abs(F.col(c) - one[f"m_{c}"]), 0.5).alias(c) for c in names]).first()
        median = {c: float(one[f"m_{c}"]) for c in names}
        scale = {c: max(1.4826 * mad[c] if 1.4826 * mad[c] > 1e-6 else one[f"s_{c}"], 1e-6) for c in names}
        self = cls(median, scale, {})
        for c in (c for c in names if c in targets):
            known = train.where(F.col(c).isNotNull()).withColumn("__z", self._z(c))
            self.mean[c] = basis.mean(known, "__z", alpha)[0]
        return self

    def _z(self, c: str) -> Column:
        return clip((F.col(c).cast("double") - self.median[c]) / self.scale[c], -8.0, 8.0)

    def transform(self, df: DataFrame, *, fill: bool = False, bound: float | None = None) -> DataFrame:
        """Nulls stay null; with `fill` they count as the median. `bound` clips what is left."""
        out = {}
        for c in self.median:
            z = self._z(c)
            if fill:
                z = F.coalesce(z, F.lit(0.0))
            left = z - self.mean[c] if c in self.mean else z
            out[c] = clip(left, -bound, bound) if bound else left
        return df.withColumns(out)


def relief_score(train: DataFrame, slope: str, relief: str) -> Column:
    """Half of each robust score of slope and of absolute relief; unknown values count as the median."""
    s, r = F.greatest(F.col(slope), F.lit(0.0)), F.abs(F.col(relief))
    q = train.agg(*[_quantile(c, p).alias(f"{k}{p}") for k, c in (("s", F.col(slope)), ("r", r)) for p in (0.25, 0.5, 0.75)]).first()
    score = lambda c, k: clip((F.coalesce(c, F.lit(float(q[f"{k}0.5"]))) - q[f"{k}0.5"]) / max(q[f"{k}0.75"] - q[f"{k}0.25"], 1e-4), -6.0, 6.0)
    return 0.5 * score(s, "s") + 0.5 * score(r, "r")


@dataclass(frozen=True)
class Calibrator:
    """A probability's log odds less what the nuisance explains, and gap rows matched to the covered ones."""

    effect: Column
    offset: float
    edge: float
    bound: float | None = None
    shift: float = 0.0
    tier: Column | None = None
    stats: tuple = ()

    @classmethod
    def fit(cls, train: DataFrame, p: str, basis: Basis, *, alpha: float = 100.0, edge: float = 1e-5, more: list[Column] | None = None, bound: float | None = None, sample_mean: float | None = None, population_mean: float | None = None) -> Calibrator:
        """Beside columns `more`, if there are any, only the basis' own part is taken out. The means move the prior."""
        df = train.withColumn("__l", logit(clip(F.col(p), edge, 1 - edge)))
        mean, own = basis.mean(df, "__l", alpha, more)
        effect = own if more else mean
        offset = df.agg(F.avg(effect)).first()[0] or 0.0
        shift = 0.0
        if sample_mean is not None and population_mean is not None:
            import math

            a, b = (min(max(x, 1e-4), 1 - 1e-4) for x in (population_mean, sample_mean))
            shift = math.log(a / (1 - a)) - math.log(b / (1 - b))
        return cls(effect, float(offset), edge, bound, shift)

    def odds(self, p: str) -> Column:
        """Log odds without the nuisance's part."""
        return logit(clip(F.col(p), self.edge, 1 - self.edge)) - (self.effect - self.offset) + self.shift

    def matched(self, train: DataFrame, p: str, covered: str, tier: Column | None = None, *, least: int = 32, least_tier: int = 100) -> Calibrator:
        """Also learn to move gap rows: each tier's median and spread (to the 99th percentile) to those of its
        covered rows; a tier with too few rows takes those of all."""
        tier_ = F.lit(0) if tier is None else tier
        df = train.select(self.odds(p).alias("l"), F.col(covered).alias("has"), tier_.alias("t"))
        agg = [F.count("*").alias("n"), _quantile(F.col("l"), 0.5).alias("m"), _quantile(F.col("l"), 0.99).alias("q")]
        rows = {(r["has"], r["t"]): r for r in df.groupBy("has", "t").agg(*agg).collect()}  # a row for each tier and coverage
        whole = {r["has"]: r for r in df.groupBy("has").agg(*agg).collect()}
        every = df.agg(*agg).first()
        of = lambda r: (float(r["m"]), max(float(r["q"] - r["m"]), 0.25))
        enough = lambda r, n: r is not None and r["n"] >= n
        high = of(whole[True]) if enough(whole.get(True), least) else ((float(every["m"]), 1.0) if tier is not None else of(every))
        low = of(whole[False]) if enough(whole.get(False), least) else high
        most = least if tier is None else least_tier
        stats = tuple((t, *(of(rows[True, t]) if enough(rows.get((True, t)), most) else high), *(of(rows[False, t]) if enough(rows.get((False, t)), most) else low)) for t in sorted({t for _, t in rows}))
        return Calibrator(self.effect, self.offset, self.edge, self.bound, self.shift, tier_, stats)

    def transform(self, df: DataFrame, p: str, out: str, covered: str | None = None) -> DataFrame:
        # the log odds are a column of their own, so that what is built on them does not repeat them
        df = df.withColumn("__odds", self.odds(p))
        odds = F.col("__odds")
        if covered is not None:
            df = df.withColumn("__tier", F.lit(0) if self.tier is None else self.tier)
            moved = F.coalesce(*[F.when(F.col("__tier") == t, a + b * (odds - c) / d) for t, a, b, c, d in self.stats], odds)
            odds = F.when(F.col(covered), odds).otherwise(moved)
        if self.bound:
            odds = clip(odds, -self.bound, self.bound)
        return df.withColumn(out, expit(odds)).drop("__odds", "__tier")


def terciles(train: DataFrame, score: Column) -> Column:
    """0, 1 or 2 by the score's training terciles."""
    lo, hi = train.agg(_quantile(score, 0.3333).alias("a"), _quantile(score, 0.6667).alias("b")).first()
    return F.when(score >= hi, 2).when(score >= lo, 1).otherwise(0)


def gate_scale(train: DataFrame, columns: list[str], *, least: int = 32) -> DataFrame:
    """(name, median, iqr) of each column; too few known values give 0 and 1."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "value")
    few = F.count("value") < least
    iqr = F.greatest(_quantile(F.col("value"), 0.75) - _quantile(F.col("value"), 0.25), F.lit(1e-5))
    return long.groupBy("name").agg(F.when(few, 0.0).otherwise(_quantile(F.col("value"), 0.5)).alias("median"), F.when(few, 1.0).otherwise(iqr).alias("iqr"))
