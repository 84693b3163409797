"""Ranks by parts, tree hashes, run payloads, copies and block flips against plain loops."""

import hashlib
from statistics import mean

import pytest
from pyspark.sql import functions as F

from gridloom.operators import models, ranks, rules
from gridloom.sources import scans


def _rows(n=400):
    # a third of all rows hold one value
    return [(i, 7.0 if i % 3 == 0 else float(i * 37 % 50)) for i in range(n)]


@pytest.mark.parametrize("parts", [2, 8, 64])
def test_numbered(spark, parts):
    rows = _rows() + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = {r["id"]: (r["i"], r["n"]) for r in ranks.numbered(df, "v", "id", "i", "n", parts=parts).collect()}
    order = sorted(_rows(), key=lambda r: (r[1], r[0]))
    assert got == {k: (i, len(order)) for i, (k, _) in enumerate(order, 1)}


@pytest.mark.parametrize("parts", [2, 64])
def test_placed(spark, parts):
    rows = _rows()
    got = ranks.placed(spark.createDataFrame([*rows, (1000, None)], "id long, v double"), "v", parts=parts).collect()
    values = [v for _, v in rows]
    assert len(got) == len(rows)
    for r in got:
        assert (r["__below"], r["__same"], r["__all"]) == (sum(v < r["v"] for v in values), values.count(r["v"]), len(values))


def test_frequent_value_is_split_by_key(spark):
    df = spark.createDataFrame(_rows(4000), "id long, v double").repartition(4)
    plan = ranks.numbered(df, "v", "id", "i")
    assert plan.where("i is null").count() == 0 and plan.agg(F.count_distinct("i"), F.max("i")).first() == (4000, 4000)


def test_ranks_of_few_rows(spark):
    none = spark.createDataFrame([], "id long, v double")
    assert ranks.numbered(none, "v", "id", "i", "n").collect() == []
    assert ranks.percent_rank(none, "v", "r").collect() == []
    one = spark.createDataFrame([(1, 5.0)], "id long, v double")
    assert ranks.numbered(one, "v", "id", "i", "n").collect()[0]["i"] == 1
    assert ranks.percent_rank(one, "v", "r").collect()[0]["r"] == 0.0


def _tree(keys, block, levels):
    level = {k: str(k) for k in keys}
    for _ in range(levels):
        up = {}
        for k in sorted(level):
            up.setdefault(k // block, []).append(level[k])
        level = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in up.items()}
    return level[0]


@pytest.mark.parametrize("block, levels", [(4096, 2), (10, 3)])
def test_content_id(spark, monkeypatch, block, levels):
    monkeypatch.setattr(rules, "BLOCK", block)
    keys = list(range(0, 900, 7))
    df = spark.createDataFrame([(k, "a") for k in keys] + [(3, "b"), (None, "b")], "k long, g string").repartition(5)
    got = {r["g"]: r["h"] for r in rules.content_id(df, "k", "h", ("g",)).collect()}
    assert got == {"a": _tree(keys, block, levels), "b": _tree([3], block, levels)}
    assert rules.content_id(df.where("false"), "k", "h").collect() == []


def test_packed_mask(spark):
    cells = [("a", i) for i in (0, 1, 2, 5, 9)] + [("b", 9), ("b", 9)]
    packed = scans.packed_mask(spark.createDataFrame(cells, "mask string, cell_id long"), 10)
    got = sorted((r["mask"], r["cell_id"]) for r in scans.decode_runs(packed, 10).collect())
    assert got == sorted(set(cells))


def test_cache_state(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "z")], "part long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "w"), (3, None)], "part long, v string")
    parts = spark.createDataFrame([(1,), (2,), (3,)], "part long")
    got = {r["part"]: (r["lost"], r["added"], r["reusable"]) for r in rules.cache_state(a, b, "part", parts).collect()}
    assert got == {1: (1, 0, False), 2: (0, 0, True), 3: (1, 2, False)}


def test_two_sample(spark):
    rows = [(i // 5, i % 2, float(i * 31 % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "b long, l int, v double")
    got = models.two_sample(df, "v", "l", "b", draws=9, seed=3).first()

    def gap(flipped):
        side = {0: [], 1: []}
        for b, one, v in rows:
            side[1 - one if b in flipped else one].append(v)
        return round(abs(mean(side[1]) - mean(side[0])), 6)

    def draw(d):
        h = lambda b: int(hashlib.md5(f"3:{d}:{b}".encode()).hexdigest()[:12], 16)
        return {b for b in range(12) if h(b) % 2}

    seen, null = gap(set()), [gap(draw(d)) for d in range(9)]
    assert got["observed"] == pytest.approx(seen) and got["null_mean"] == pytest.approx(mean(null))
    assert got["p"] == pytest.approx((1 + sum(x >= seen for x in null)) / 10)
