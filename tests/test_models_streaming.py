"""Estimators and streaming twins."""

import random
import time

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import lines, models
from gridloom.streaming import lines as live

SF = "/root/testdata/sf0.001"


def test_ridge_equals_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    m = models.ridge(df, ["a", "b", "c"], "y", 7.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 7.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-6)


def test_splines_sum_to_one(spark):
    df = spark.range(101).select((F.col("id") / 10).alias("v"))
    got = df.select(*[b.alias(f"b{i}") for i, b in enumerate(models.spline(F.col("v"), [0.0, 2.0, 5.0, 7.0, 10.0]))]).collect()
    assert all(abs(sum(r) - 1) < 1e-6 and min(r) >= 0 for r in got)


def test_residuals_lose_the_nuisance(spark):
    rng = random.Random(1)
    rows = [(i, x := rng.random() * 10, None if i % 50 == 0 else 3 * x * x + rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, n double, t double")
    got = models.residuals(df, "n", "t", "r", train=F.lit(True), alpha=1e-6)
    assert got.where("t IS NULL AND r IS NOT NULL").count() == 0
    assert abs(got.agg(F.corr("n", "r")).first()[0]) < 0.05


def test_trees_find_a_signal(spark):
    rng = random.Random(2)
    rows = [(i, x := rng.random(), None if rng.random() < 0.1 else rng.random(), float(x > 0.6), i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double, fold int")
    assert all(r["auc"] > 0.95 for r in models.fold_auc(df, ["a", "b"], "y", "fold").collect())


def test_windowed_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(src))
    q = live.windowed(live.stream(spark, str(src))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): (r["n"], round(r["total"], 6)) for r in spark.table("w").collect()}
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert got == {(r["window"]["start"], r["event_type"]): (r["n"], round(r["total"], 6)) for r in batch.collect()}


def test_line_state_does_not_depend_on_batches(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    want = {r["user_id"]: (r["n"], r["runs"], r["length"]) for r in lines.summary(lines.runs(e, "user_id", ("ts", "event_id"), "value", 40.0), "user_id", "value").collect()}
    thirds = e.withColumn("k", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    for k in (1, 2, 3):  # files in the order of time
        thirds.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    q = live.summaries(live.stream(spark, str(tmp_path / "in")), 40.0).writeStream.format("memory").queryName("s").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {}
    for r in spark.table("s").collect():
        if r["n"] >= got.get(r["user_id"], (0,))[0]:
            got[r["user_id"]] = (r["n"], r["runs"], round(r["length"], 6))
    assert got == want
