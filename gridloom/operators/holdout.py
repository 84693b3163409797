"""Hold-out objects: what is hidden, what is emitted from a score, and how it is reported.

Tables instead of objects: the quadrants' truths are one table of label cells with flags; an emission is a table of dots with
their fold; a report is one row a fold and one row pooled over them, with the pooled row's interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalar import hashed, tversky
from gridloom.operators import metric
from gridloom.operators.distance import components, written
from gridloom.operators.folds import auc

PARTS = ("tp", "fp", "fn")


def checked(footprint: DataFrame, labels: DataFrame) -> DataFrame:
    """labels, once all lie in the footprint and every one of the four folds has a cell; else a ValueError."""
    if labels.join(footprint, ["y", "x"], "left_anti").limit(1).count():
        raise ValueError("labels outside the footprint")
    if footprint.select("fold").distinct().count() < 4:
        raise ValueError("an empty fold: no four-fold hold-out")
    return labels


def quadrant_truths(labels: DataFrame, width: int, *, keep_of_100: int = 20, seed: int = 4242) -> DataFrame:
    """(y, x, fold, comp, sparse): label cells with their fold; sparse ones belong to the components, within their fold, that
    stay as truth when most of a fold is known. A hash of seed, fold and component picks them."""
    # folds lie apart from each other while components are sought, so one pass serves all four
    far = (labels.agg(F.max("y")).first()[0] or 0) + 2
    moved = components(labels.select((F.col("y") + F.col("fold") * far).alias("y"), "x"), width)
    parts = moved.withColumn("fold", F.floor(F.col("y") / far).cast("int"))
    parts = parts.select((F.col("y") - F.col("fold") * far).alias("y"), "x", "fold", (F.col("comp") - F.col("fold") * far * width).alias("comp"))
    return parts.withColumn("sparse", hashed(F.lit(seed), "fold", "comp") % 100 < keep_of_100)


def emitted(scored: DataFrame, share: float, *, crests: DataFrame | None = None, key: str = "cell_id", score: str = "v") -> DataFrame:
    """The best positive cells of each fold up to a share of its cells (halves to even), of crests alone if they are given."""
    some = scored if crests is None else scored.join(crests.select("y", "x"), ["y", "x"], "left_semi")
    budget = scored.groupBy("fold").agg(F.rint(F.count("*") * share).alias("__k"))  # a handful of folds
    w = Window.partitionBy("fold").orderBy(F.desc(score), key)
    some = some.where(F.col(score) > 0).withColumn("__i", F.row_number().over(w)).join(F.broadcast(budget), "fold")
    return some.where(F.col("__i") <= F.col("__k")).drop("__i", "__k")


def quadrant_scores(pred: DataFrame, truths: DataFrame) -> DataFrame:
    """(mode, fold, tp, fp, fn, dti): each fold against all its labels, and against the sparse ones with the known cells neither
    truth nor mistakes; fold null is the mean of the four. The sparse mode leaves predictions on known cells out."""
    known = truths.where("NOT sparse").select("y", "x")
    dense = metric.owned(pred, truths, ("fold",)).withColumn("mode", F.lit("dense"))
    sparse = metric.owned(pred.join(known, ["y", "x"], "left_anti"), truths.where("sparse"), ("fold",)).withColumn("mode", F.lit("sparse"))
    by = dense.unionByName(sparse).groupBy("mode", "fold").agg(*[F.sum(c).alias(c) for c in PARTS])
    by = by.withColumn("dti", tversky(*[F.col(c) for c in PARTS]))
    mean = by.groupBy("mode").agg(*[F.lit(None).cast("double").alias(c) for c in PARTS], F.avg("dti").alias("dti")).withColumn("fold", F.lit(None).cast("int"))
    return by.unionByName(mean)


def blocks(parts: DataFrame, footprint: DataFrame, size: int, columns: tuple[str, ...]) -> DataFrame:
    """(ty, tx, columns): sums by square block, a row for every block with a footprint cell."""
    at = [F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx")]
    sums = parts.groupBy(*at).agg(*[F.sum(c).alias(c) for c in columns])
    return footprint.select(*at).distinct().join(sums, ["ty", "tx"], "left").fillna(0.0, list(columns))


def summary(pred: DataFrame, truth: DataFrame, footprint: DataFrame, *, size: int, draws: int, seed: int) -> DataFrame:
    """fold, tp, fp, fn, dti, n_truth, lo, hi: a row a fold, and under a null fold all of them pooled, with the central 95 % of
    the score over blocks drawn with replacement. pred and truth carry their fold."""
    parts = written(metric.owned(pred, truth, ("fold",)))
    rows = parts.rollup("fold").agg(*[F.sum(c).alias(c) for c in PARTS]).withColumn("dti", tversky(*[F.col(c) for c in PARTS]))
    counts = truth.rollup("fold").agg(F.count("*").alias("n_truth"))
    drawn = metric.bootstrap(written(blocks(parts, footprint, size, PARTS)), list(PARTS), draws=draws, seed=seed)
    ci = metric.interval(drawn.withColumn("dti", tversky(*[F.col(c) for c in PARTS])), "dti")
    rows = rows.alias("r").join(counts.alias("c"), F.col("r.fold").eqNullSafe(F.col("c.fold")), "left").select("r.*", F.coalesce("n_truth", F.lit(0)).alias("n_truth"))
    pooled = F.col("fold").isNull()
    return rows.join(F.broadcast(ci)).withColumn("lo", F.when(pooled, F.col("lo"))).withColumn("hi", F.when(pooled, F.col("hi")))


def paired(candidate: DataFrame, baseline: DataFrame, truth: DataFrame, footprint: DataFrame, *, size: int, draws: int, seed: int) -> DataFrame:
    """One row: the pooled scores, their difference with the central 95 % over blocks drawn for both at once, fold wins and the
    least difference of a fold."""
    names = [f"{k}{c}" for k in "ab" for c in PARTS]
    both = None
    for k, pred in (("a", candidate), ("b", baseline)):
        part = metric.owned(pred, truth, ("fold",)).select("y", "x", "fold", *[(F.col(c) if n[0] == k else F.lit(0.0)).alias(n) for n in names for c in [n[1:]]])
        both = part if both is None else both.unionByName(part)
    both = written(both)
    dti = lambda k: tversky(*[F.sum(f"{k}{c}") for c in PARTS])
    folds = both.groupBy("fold").agg((dti("a") - dti("b")).alias("d")).agg(F.count_if(F.col("d") > 0).alias("wins"), F.count("*").alias("folds"), F.min("d").alias("min_delta"))
    pooled = both.agg(dti("a").alias("candidate"), dti("b").alias("baseline"))
    drawn = metric.bootstrap(written(blocks(both, footprint, size, tuple(names))), names, draws=draws, seed=seed)
    point = lambda k: tversky(*[F.col(f"{k}{c}") for c in PARTS])
    ci = metric.interval(drawn.withColumn("d", point("a") - point("b")), "d")
    out = pooled.join(F.broadcast(folds)).join(F.broadcast(ci))  # a row each
    return out.withColumn("delta", F.col("candidate") - F.col("baseline")).withColumn("positive", F.col("lo") > 0)


def canary(samples: DataFrame, features: list[str], positive: str, fold: str, *, bar: float = 0.90) -> DataFrame:
    """feature, auc, presence_auc, extremity, suspected: pooled AUC of each value (missing as 0) and of its presence; suspected if
    either, pooled or in any fold, is above the bar in either polarity."""
    wide = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value"), F.col(c).isNotNull().cast("double").alias("there")) for c in features]
    long = samples.select(positive, fold, F.explode(F.array(*wide)).alias("f")).select(positive, fold, "f.*")
    both = long.unpivot([positive, fold, "feature"], ["value", "there"], "what", "x")
    pooled = auc(both, "x", positive, ("feature", "what"))
    each = auc(both, "x", positive, ("feature", "what", fold)).drop(fold)
    far = F.greatest(F.col("auc"), 1 - F.col("auc"))
    worst = pooled.unionByName(each).groupBy("feature").agg(F.max(far).alias("extremity"))
    one = pooled.groupBy("feature").agg(F.max(F.when(F.col("what") == "value", F.col("auc"))).alias("auc"), F.max(F.when(F.col("what") == "there", F.col("auc"))).alias("presence_auc"))
    return one.join(worst, "feature").withColumn("suspected", F.col("extremity") > bar)


def bridged(dots: DataFrame, hidden: DataFrame, cells: DataFrame, *, size: int, draws: int, seed: int) -> DataFrame:
    """One row dti, lo, hi of dots against hidden labels, both by fold, over the blocks that hold a cell of any fold's test part."""
    parts = written(metric.owned(dots, hidden, ("fold",)))
    by = written(blocks(parts, cells, size, PARTS))
    drawn = metric.bootstrap(by, list(PARTS), draws=draws, seed=seed)
    ci = metric.interval(drawn.withColumn("dti", tversky(*[F.col(c) for c in PARTS])), "dti")
    return by.agg(tversky(*[F.sum(c) for c in PARTS]).alias("dti")).join(F.broadcast(ci))

