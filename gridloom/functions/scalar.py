"""Column expressions: normalisers, ranks, decoders, projections and closed-form scores.

Quantiles are exact and interpolate linearly. Statistics of a whole band come as one aggregate row
that the planner broadcasts; its size does not depend on the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALPHA, BETA, EPS = 0.2, 0.8, 1e-7


def with_stats(df: DataFrame, value: str, **stats: Column) -> DataFrame:
    """df with statistics of a column as further columns."""
    one = df.agg(*[c.alias(k) for k, c in stats.items()])
    return df.join(F.broadcast(one))


def clip(v: Column, lo: float, hi: float) -> Column:
    """Into [lo, hi]; null stays null."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def robust_z(df: DataFrame, value: str, out: str, *, bound: float = 8.0, floor_sd: float = 0.0, floor: float = 1e-6) -> DataFrame:
    """(x - median) / IQR; the IQR is at least `floor`, or floor_sd times the population deviation."""
    v = F.col(value)
    df = with_stats(df, value, __q=F.percentile(v, [0.25, 0.5, 0.75]), __sd=F.stddev_pop(v))
    iqr = F.greatest(F.col("__q")[2] - F.col("__q")[0], F.col("__sd") * floor_sd, F.lit(floor))
    return df.withColumn(out, clip((v - F.col("__q")[1]) / iqr, -bound, bound)).drop("__q", "__sd")


def quantile01(df: DataFrame, value: str, out: str, lo: float, hi: float) -> DataFrame:
    """Quantiles lo..hi to 0..1, clipped; 0 where they are equal."""
    v = F.col(value)
    df = with_stats(df, value, __q=F.percentile(v, [lo, hi]))
    a, b = F.col("__q")[0], F.col("__q")[1]
    return df.withColumn(out, F.when(v.isNull(), None).when(b <= a, 0.0).otherwise(clip((v - a) / F.nullif(b - a, F.lit(0.0)), 0.0, 1.0))).drop("__q")


def expit(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def decode_u8(q: Column, maximum: float, encoding: str) -> Column:
    """Quantised byte to value: 0 is nodata, 1..255 linear or square-root coded."""
    t = (q - 1) / 254.0
    return F.when(q > 0, (t * t if encoding == "sqrt" else t) * maximum)


def rank_logit(q: Column) -> Column:
    """Logit of a byte rank."""
    r = clip(q / 255.0, 1e-3, 1 - 1e-3)
    return F.ln(r / (1 - r))


def sanitise(v: Column) -> Column:
    """NaN and null to 0, into [0, 1]."""
    return F.when(v.isNull() | F.isnan(v), 0.0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def leading_number(s: Column) -> Column:
    """The number that a text begins with, else null."""
    return F.nullif(F.regexp_extract(s, r"^\s*(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def blend(a: Column, b: Column, w: float = 0.65) -> Column:
    """Log-odds blend of two probabilities."""
    return expit(w * logit(a) + (1 - w) * logit(b))


def prior_shift(p: Column, population: float, sample: float) -> Column:
    """Move a probability from the sample's prior odds to the population's."""
    shift = math.log(population / (1 - population)) - math.log(sample / (1 - sample))
    return expit(logit(p) + shift)


def affine(u: Column, v: Column, c: tuple[float, ...]) -> tuple[Column, Column]:
    a, b, e, d, f, g = c
    return u * a + v * b + e, u * d + v * f + g


def affine_inverse(u: Column, v: Column, c: tuple[float, ...]) -> tuple[Column, Column]:
    a, b, e, d, f, g = c
    det = a * f - b * d
    return ((u - e) * f - (v - g) * b) / det, ((v - g) * a - (u - e) * d) / det


def tversky(tp: Column, fp: Column, fn: Column) -> Column:
    return tp / (tp + ALPHA * fp + BETA * fn + EPS)


def inclusion_threshold(d: Column) -> Column:
    return ALPHA * d / (1 - (1 - BETA) * d)


def credit_per_mass_threshold(d: Column) -> Column:
    return ALPHA * d / (1 - (1 - ALPHA - BETA) * d)


def model_dti(tp: Column, n: Column, tau: float, phi: float = 0.05) -> Column:
    """First-order score of tp credit and n dots an area, with truth density tau."""
    return tp / (tp + ALPHA * (n - phi * tp) + BETA * (tau - tp) + EPS)


def implied_credit(d: Column, n: Column, tau: float, phi: float = 0.05) -> Column:
    """The credit at which `model_dti` is d."""
    return d * (ALPHA * n + BETA * tau + EPS) / (1 - d * (1 - ALPHA * phi - BETA))


def holm(p: str, key: str) -> Column:
    """Holm's step-down factors times p, before their running maximum."""
    by = Window.orderBy(p, key)
    m, i = F.count("*").over(Window.partitionBy()), F.row_number().over(by)
    return (m - i + 1) * F.col(p)


def holm_adjusted(df: DataFrame, p: str, key: str, out: str) -> DataFrame:
    run = Window.orderBy(p, key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__s", holm(p, key)).withColumn(out, F.least(F.lit(1.0), F.max("__s").over(run))).drop("__s")


def hashed(*parts: Column | str) -> Column:
    """A draw in [0, 2**48) from md5 of the parts; the same in any engine."""
    text = F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
