"""Estimators: ridge on spline bases, boosted trees, isotonic calibration, two-sample tests."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import hashed
from gridloom.operators import boosting, ranks, tiles
from gridloom.operators.boosting import Settings
from gridloom.operators.distance import transform, written
from gridloom.operators.folds import auc


def spline(c: Column, knots: list[float]) -> list[Column]:
    """Degree-2 B-spline basis on the given knots, ends repeated, as expressions."""
    t = [knots[0]] * 2 + list(knots) + [knots[-1]] * 2
    x = F.least(F.greatest(c, F.lit(knots[0])), F.lit(knots[-1] - 1e-9))
    basis = [F.when((x >= a) & (x < b), 1.0).otherwise(0.0) if b > a else F.lit(0.0) for a, b in zip(t, t[1:], strict=False)]
    for d in (1, 2):
        basis = [
            (basis[i] * (x - t[i]) / (t[i + d] - t[i]) if t[i + d] > t[i] else F.lit(0.0)) + (basis[i + 1] * (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) if t[i + d + 1] > t[i + 1] else F.lit(0.0))
            for i in range(len(basis) - 1)
        ]
    return basis


def quantile_knots(df: DataFrame, value: str, n: int = 5) -> list[float]:
    q = df.agg(F.percentile(value, [i / (n - 1) for i in range(n)]).alias("q")).first()["q"]
    return sorted(set(q))


def ridge(df: DataFrame, features: list[str], label: str, alpha: float):
    """Ridge with the penalty alpha of the sum of squares; the library scales its own by the label's deviation."""
    s = df.agg(F.count("*").alias("n"), F.stddev_pop(label).alias("sd")).first()
    fit = LinearRegression(featuresCol="__f", labelCol=label, regParam=alpha / s["n"] * (s["sd"] or 1.0), elasticNetParam=0.0, standardization=False, solver="normal")
    return fit.fit(VectorAssembler(inputCols=features, outputCol="__f").transform(df))


def residuals(df: DataFrame, nuisance: str, target: str, out: str, *, train: Column, alpha: float = 60.0) -> DataFrame:
    """target less its spline-ridge mean given the nuisance, fitted on training rows; null stays null."""
    known = df.where(train & F.col(nuisance).isNotNull() & F.col(target).isNotNull())
    basis = spline(F.col(nuisance), quantile_knots(known, nuisance))
    names = [f"__b{i}" for i in range(len(basis))]
    add = lambda d: d.withColumns(dict(zip(names, basis, strict=True)))
    model = ridge(add(known), names, target, alpha)
    w, c = model.coefficients.toArray().tolist(), float(model.intercept)
    mean = F.lit(c)
    for name, k in zip(names, w, strict=True):
        mean = mean + F.col(name) * k
    return add(df).withColumn(out, F.when(F.col(nuisance).isNotNull(), F.col(target) - mean)).drop(*names)


#: Small trees for tests between classes.
SMALL = Settings(rounds=25, rate=0.1, leaves=7, least=20, l2=5.0, depth=4)


def boosted(train: DataFrame, score: DataFrame, columns: list[str], label: str, settings: Settings = SMALL) -> DataFrame:
    """score with column p: probability of boosted trees fitted on train; missing values have a bin of their own."""
    return boosting.fit(train, columns, label, settings).predict(score, "p")


def apart_by_group(df: DataFrame, fold: str, group: str, out: str) -> DataFrame:
    """df with the folds that a row's group touches, as an array: whoever holds one of them out must not learn from the row."""
    touched = df.where(F.col(fold).isNotNull()).groupBy(group).agg(F.collect_set(fold).alias(out))  # a handful of folds
    return df.join(touched, group, "left")


def fold_auc(df: DataFrame, columns: list[str], label: str, fold: str, settings: Settings = SMALL, group: str | None = None) -> DataFrame:
    """AUC of each fold's rows under trees fitted on the other folds, less groups that the fold touches; all in the same passes."""
    kinds = [r[0] for r in df.select(fold).distinct().where(F.col(fold).isNotNull()).orderBy(fold).collect()]  # a handful of folds
    kept = apart_by_group(df, fold, group, "__touched") if group else df.withColumn("__touched", F.array(fold))
    uses = [(F.col(fold) != f) & ~F.array_contains("__touched", f) for f in kinds]
    trees = boosting.fit_many(kept, columns, [F.col(label)] * len(kinds), uses, settings)
    which = F.array_position(F.array(*[F.lit(f) for f in kinds]), F.col(fold)) - 1
    got = boosting.predicted(trees, df, which, "__p")
    return auc(got.withColumn("__pos", F.col(label) == 1), "__p", "__pos", (fold,))


def drawn_labels(df: DataFrame, label: str, key: str, block: str, *, draws: int, seed: int, null: str) -> DataFrame:
    """df with labels y0 (as observed) to y<draws>, each draw's under the null.

    "grouped": a draw turns the labels of half of the blocks; "permutation": rows take the labels of rows in another order;
    "shift": rows take the label of the row that is a draw's share of the table further on, by key.
    """
    one = F.col(label).cast("int")
    df = df.withColumn("y0", one)
    if null == "grouped":
        flip = lambda d: hashed(F.lit(seed), F.lit(d), F.coalesce(F.col(block).cast("string"), F.lit(""))) % 2 == 1
        return df.withColumns({f"y{d}": F.when(flip(d), 1 - one).otherwise(one) for d in range(1, draws + 1)})
    placed = ranks.numbered(df.where(one.isNotNull()), key, key, "__i", "__n")
    source = placed.select("__i", "__n", one.alias("__y"), F.col(key).alias("__key"))
    for d in range(1, draws + 1):
        if null == "permutation":
            other = ranks.numbered(source.withColumn("__h", hashed(F.lit(seed), F.lit(d), "__key")), "__h", "__key", "__j")
            other = other.select(F.col("__j").alias("__i"), F.col("__y").alias(f"y{d}"))
        elif null == "shift":
            by = F.greatest(F.lit(1), F.floor(F.col("__n") * d / (draws + 1)))
            other = source.select((F.pmod(F.col("__i") - 1 + by, F.col("__n")) + 1).alias("__i"), F.col("__y").alias(f"y{d}"))
        else:
            raise ValueError(null)
        placed = placed.join(other, "__i")
    return placed.drop("__i", "__n")


def classifier_test(df: DataFrame, columns: list[str], label: str, fold: str, block: str, key: str, *, draws: int, seed: int, null: str = "grouped", settings: Settings = SMALL) -> DataFrame:
    """One row (observed, null_mean, null_top, p): mean AUC over folds of trees that never saw the fold or its blocks, against the
    same refitted on each draw's labels; p = (1 + #>=) / (draws + 1). Observed and null models grow in the same passes."""
    kinds = [r[0] for r in df.select(fold).distinct().where(F.col(fold).isNotNull()).orderBy(fold).collect()]  # a handful of folds
    kept = written(drawn_labels(apart_by_group(df, fold, block, "__touched"), label, key, block, draws=draws, seed=seed, null=null))
    pairs = [(d, f) for d in range(draws + 1) for f in kinds]
    uses = [(F.col(fold) != f) & ~F.array_contains("__touched", f) for _, f in pairs]
    trees = boosting.fit_many(kept, columns, [F.col(f"y{d}") for d, _ in pairs], uses, settings)
    at = F.array_position(F.array(*[F.lit(f) for f in kinds]), F.col(fold)) - 1
    for d in range(draws + 1):
        kept = boosting.predicted(trees[d * len(kinds) : (d + 1) * len(kinds)], kept, at, f"p{d}")
    each = F.array(*[F.struct(F.lit(d).alias("draw"), F.col(f"p{d}").alias("p"), (F.col(f"y{d}") == 1).alias("pos")) for d in range(draws + 1)])
    scores = auc(kept.select(fold, F.explode(each).alias("e")).select(fold, "e.*"), "p", "pos", ("draw", fold)).groupBy("draw").agg(F.avg("auc").alias("auc"))
    seen = F.max(F.when(F.col("draw") == 0, F.col("auc")))
    drawn = F.when(F.col("draw") > 0, F.col("auc"))
    got = scores.agg(seen.alias("observed"), F.avg(drawn).alias("null_mean"), F.max(drawn).alias("null_top"), F.collect_list(drawn).alias("null"))  # one number a draw
    return got.select("observed", "null_mean", "null_top", ((1 + F.size(F.filter("null", lambda x: x >= F.col("observed")))) / (draws + 1)).alias("p"))


def label_features(cells: DataFrame, labels: DataFrame, n: tuple[int, int], sigmas: tuple[float, ...], *, cell: float = 0.1) -> DataFrame:
    """(y, x, log_distance, density_0, ..): log(1 + distance) to the nearest label and the label density at each sigma, nothing
    beyond the border. `cells` is dense; labels that are to stay unseen must not be in `labels`."""
    d = transform(cells.select("y", "x"), labels)
    d = d.join(labels.select("y", "x", F.lit(1.0).alias("__on")).distinct(), ["y", "x"], "left").withColumn("__on", F.coalesce("__on", F.lit(0.0)))
    d = d.withColumn("log_distance", F.log1p(F.sqrt("d2") * cell))
    names = [f"density_{i}" for i in range(len(sigmas))]
    dense = tiles.tiled(d, ["__on"], lambda z: {c: tiles.gaussian(z["__on"], s, "constant") for c, s in zip(names, sigmas, strict=True)}, names, n, halo=int(4 * max(sigmas) + 0.5))
    return d.select("y", "x", "log_distance").join(dense, ["y", "x"])


def calibrated(fit: DataFrame, score: DataFrame, p: str, label: str, out: str) -> DataFrame:
    """Isotonic calibration of p, fitted on held-out rows; without any, p itself."""
    if not fit.limit(1).count():
        return score.withColumn(out, F.col(p))
    model = IsotonicRegression(featuresCol=p, labelCol=label, predictionCol=out).fit(fit)
    return model.transform(score)


def two_sample(df: DataFrame, value: str, label: str, block: str, *, draws: int, seed: int) -> DataFrame:
    """One row (observed, null_mean, p): the gap between the class means against labels flipped by
    whole blocks, p = (1 + #>=) / (draws + 1). Gaps are compared to six decimals.

    Rows are summed by block and class once; all draws flip those sums in one aggregate. Rows
    without a value or label are left out.
    """
    one = F.col(label).cast("int")
    sums = df.where(one.isNotNull() & F.col(value).isNotNull()).groupBy(F.col(block).alias("b"), one.alias("one")).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    each = sums.withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))  # -1: as observed
    flip = (F.col("draw") >= 0) & (hashed(F.lit(seed), "draw", F.coalesce(F.col("b").cast("string"), F.lit(""))) % 2 == 1)
    each = each.withColumn("one", F.when(flip, 1 - F.col("one")).otherwise(F.col("one")))
    mean = lambda k: F.try_divide(F.sum(F.when(F.col("one") == k, F.col("s"))), F.sum(F.when(F.col("one") == k, F.col("n"))))
    gaps = each.groupBy("draw").agg(F.round(F.abs(mean(1) - mean(0)), 6).alias("gap"))
    seen = F.max(F.when(F.col("draw") < 0, F.col("gap")))
    null = F.collect_list(F.when(F.col("draw") >= 0, F.col("gap")))  # one number a draw
    got = gaps.agg(seen.alias("observed"), F.avg(F.when(F.col("draw") >= 0, F.col("gap"))).alias("null_mean"), null.alias("null"))
    at_least = F.size(F.filter("null", lambda x: x >= F.col("observed")))
    return got.select("observed", "null_mean", ((1 + at_least) / (draws + 1)).alias("p"))
