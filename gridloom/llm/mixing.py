"""Mixing sources to target weights, in DataFrame functions only.

Each source's words, its documents in pseudorandom order, form blocks of `block` words. The
mixture is a row of output slots, `per_shard` to a shard. Each shard draws its source counts from
the multinomial distribution of the targets, slot by slot. The draws miss the targets by chance, and
are corrected in the open: a source's draws, in a pseudorandom order of their own, fill its
places 0, 1, ... up to its target, and those beyond it go to the sources that were drawn too seldom. A
place goes through that source's own index permutation to a block; blocks meet places in a join
by index. Each block comes round once before any comes round twice; the last place of a source is
cut to the target.

One row per source reaches the driver: a mixture has a weight for each source, so their number is
that of a setting, not of the data, and more than `MOST_SOURCES` are refused.

Defined results for odd rows: a null text has size 0; a document of size 0 is never taken;
an absent source is one source of its own, last; repeated rows are packed as separate
documents; no documents, no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm._shared import materialise, row_of, WORD

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
BLOCK, PER_SHARD = 128, 256
#: Sources that a mixture may have.
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Source:
    """One source's part of the mixture; every figure counts words, blocks or slots."""

    sid: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    first: int
    cut: int
    a: int
    b: int


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], *, share: float = SHARE, most: float = MOST) -> list[float]:
    """`share` of all sizes by weight, none over `most` times its size, the excess shared again by weight."""
    total = share * sum(sizes)
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
            free.discard(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def _multiplier(m: int, seed: int) -> int:
    """A number prime to m, under 2**26: it makes r -> a * r + b mod m a permutation."""
    a = (0x9E3779B1 * (seed + 1) % (1 << 26)) | 1
    if m <= 2:
        return 1
    a = a % m if m < 1 << 26 else a
    a = max(a, 2)
    while math.gcd(a, m) != 1:
        a = a + 1 if a + 1 < m else 1
    return a


def plan(sizes: list[tuple[str | None, int]], *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 0) -> list[Source]:
    """The mixture's shape, sources in code-point order, null last."""
    sizes = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    aim = targets([n for _, n in sizes], [weights[i % len(weights)] for i in range(len(sizes))], share=share, most=most)
    out, first = [], 0
    for sid, ((name, size), target) in enumerate(zip(sizes, aim, strict=True)):
        m = -(-size // block)
        a, b = _multiplier(m, seed + sid), (0x85EBCA77 * (sid + seed + 1)) % max(m, 1)
        want = min(round(target), most * size)
        short = m * block - size  # words that the last block lacks
        at = ((m - 1 - b) * pow(a, -1, m)) % m if m > 1 else 0  # the rank that draws the last block
        slots = -(-want // block)
        drawn = lambda n, at=at, m=m, short=short: n * block - short * ((n > at) + (n > at + m))
        while want and drawn(slots) < want:
            slots += 1
        out.append(Source(sid, name, size, target, m, slots, first, drawn(slots) - want if want else 0, a, b))
        first += slots
    return out


def _table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The plan as a small DataFrame, made from a literal."""
    schema = T.StructType([T.StructField("sid", T.IntegerType()), T.StructField("name", T.StringType()), *[T.StructField(k, T.DoubleType() if k == "target" else T.LongType()) for k in ("size", "target", "blocks", "slots", "first", "cut", "a", "b")]])
    rows = json.dumps([s.__dict__ for s in sources])
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows), T.ArrayType(schema))).alias("p")).select("p.*")


def _unit(*cols: Column) -> Column:
    """A pseudorandom number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)


def draws(spark: SparkSession, sources: list[Source], *, per_shard: int = PER_SHARD, seed: int = 0) -> DataFrame:
    """shard, slot, sid: each slot's source, drawn by the targets; a shard's counts are multinomial."""
    n = sum(s.slots for s in sources)
    shards = -(-n // per_shard)
    df = spark.range(shards * per_shard).where(F.col("id") < n).select(F.floor(F.col("id") / per_shard).alias("shard"), (F.col("id") % per_shard).alias("slot"))
    bounds = F.expr("array(" + ",".join(f"{(s.first + s.slots) / n!r}D" for s in sources[:-1]) + ")") if n and len(sources) > 1 else F.array().cast("array<double>")
    return df.withColumn("sid", F.size(F.filter(bounds, lambda x: x <= _unit(F.lit(seed), F.lit("draw"), F.col("shard"), F.col("slot")))))


def slots(spark: SparkSession, sources: list[Source], *, block: int = BLOCK, per_shard: int = PER_SHARD, seed: int = 0) -> DataFrame:
    """The mixture: shard, slot, drawn (source by the draw), sid, idx (block of the source), cut
    (words the slot leaves out at its end)."""
    drawn = draws(spark, sources, per_shard=per_shard, seed=seed)
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))
    # running sums over shards in two levels, each of about the square root of their number
    wide = max(1, math.isqrt(-(-sum(s.slots for s in sources) // per_shard)))
    counts = counts.withColumn("part", F.floor(F.col("shard") / wide))
    sums = counts.groupBy("part", "sid").agg(F.sum("n").alias("n"))
    got = {r["sid"]: r["n"] for r in sums.groupBy("sid").agg(F.sum("n").alias("n")).collect()}  # a row per source
    before = sums.select("part", "sid", (F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).alias("base"))
    within = counts.withColumn("in", F.sum("n").over(Window.partitionBy("sid", "part").orderBy("shard")) - F.col("n")).join(before, ["part", "sid"])
    ranked = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1)
    ranked = ranked.join(within.select("shard", "sid", (F.col("base") + F.col("in")).alias("base")), ["shard", "sid"]).withColumn("rank", F.col("base") + F.col("nth"))
    # a source's draws in an order of their own; what is beyond its slots is over
    rows, over, wanting = [], 0, []
    for s in sources:
        t = got.get(s.sid, 0)
        rows.append({"sid": s.sid, "drawn": t, "slots": s.slots, "over": over, "p": _multiplier(t, seed + 7 + s.sid), "q": (0xC2B2AE35 * (s.sid + seed + 1)) % max(t, 1)})
        over += max(0, t - s.slots)
        wanting.append((s.sid, t, max(0, s.slots - t)))
    plan_ = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), T.ArrayType(T.StructType([T.StructField(k, T.IntegerType() if k == "sid" else T.LongType()) for k in ("sid", "drawn", "slots", "over", "p", "q")])))).alias("x")).select("x.*")
    df = ranked.join(F.broadcast(plan_), "sid")
    place = F.when(F.col("drawn") > 0, F.pmod(F.col("p") * F.col("rank") + F.col("q"), F.col("drawn")))
    df = df.select("shard", "slot", F.col("sid").alias("by_draw"), place.alias("place"), "slots", (F.col("over") + place - F.col("slots")).alias("spare"))
    # the sources that want slots take the spare ones in turn
    ends, at = [], 0
    for sid, t, w in wanting:
        if w:
            ends.append((sid, t, at, at + w))
            at += w
    literal = lambda k, kind: F.expr(f"array({','.join(f'{e[k]}{kind}' for e in ends)})") if ends else F.array().cast("array<bigint>")
    taker = F.size(F.filter(literal(3, "L"), lambda x: x <= F.col("spare")))
    is_spare = F.col("place") >= F.col("slots")
    df = df.select("shard", "slot", "by_draw",
        F.when(is_spare, F.get(literal(0, "L"), taker)).otherwise(F.col("by_draw")).cast("int").alias("sid"),
        F.when(is_spare, F.get(literal(1, "L"), taker) + F.col("spare") - F.get(literal(2, "L"), taker)).otherwise(F.col("place")).alias("rank"))
    df = df.join(F.broadcast(_table(spark, sources)), "sid")
    idx = F.pmod(F.col("a") * (F.col("rank") % F.col("blocks")) + F.col("b"), F.col("blocks"))
    return df.select("shard", "slot", F.col("by_draw").alias("drawn"), "sid", idx.alias("idx"), F.when(F.col("rank") == F.col("slots") - 1, F.col("cut")).otherwise(0).alias("cut"))


def pieces(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, per_shard: int = PER_SHARD, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: doc_id, source, size, sid, at (first word's place in its
    source), source_size, target. pieces: sid, at, from, until (words of the document), shard, slot."""
    spark = docs.sparkSession
    sized = materialise(docs.select("doc_id", "source", _size(F.col("text")).alias("size"), F.xxhash64("text").alias("__h")), "mix-sizes")
    n = sized.count()
    totals = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]  # a row per source
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"{len(totals)} sources; a mixture takes {MOST_SOURCES} at most")
    if not totals:
        totals = [(None, 0)]
    sources = plan(totals, weights=weights, share=share, most=most, block=block, seed=seed)
    dim = F.broadcast(_table(spark, sources).select("sid", "name", F.col("size").alias("source_size"), "target"))
    df = sized.join(dim, sized["source"].eqNullSafe(dim["name"])).drop("name")
    # places within a source: sums over parts, then within them; both are about the square root of the documents
    order = F.xxhash64(F.col("doc_id"), F.col("__h"), F.lit(seed))
    df = df.withColumn("part", F.pmod(order, F.lit(max(64, math.isqrt(n))))).withColumn("__o", order)
    sums = df.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = sums.select("sid", "part", (F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).alias("base"))
    inner = Window.partitionBy("sid", "part").orderBy("__o", "doc_id", "__h", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(before, ["sid", "part"])
    df = materialise(df.select("doc_id", "source", "size", "sid", "source_size", "target", (F.col("base") + F.col("__in")).alias("at"), "__h"), "mix-places")
    held = df.where(F.col("size") > 0).select("sid", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("idx"))
    lo = F.greatest(F.col("idx") * block, F.col("at"))
    hi = F.least((F.col("idx") + 1) * block, F.col("at") + F.col("size"))
    held = held.select("sid", "idx", "at", lo.alias("lo"), hi.alias("hi"))
    drawn = slots(spark, sources, block=block, per_shard=per_shard, seed=seed)
    ends = F.broadcast(_table(spark, sources).select("sid", "size"))
    # a cut leaves out the end of the words that the block really has
    drawn = drawn.join(ends, "sid").select("sid", "idx", "shard", "slot", (F.least((F.col("idx") + 1) * block, F.col("size")) - F.col("cut")).alias("stop"))
    got = held.join(drawn, ["sid", "idx"]).where(F.col("lo") < F.col("stop"))
    return df, got.select("sid", "at", (F.col("lo") - F.col("at")).alias("from"), (F.least("hi", "stop") - F.col("at")).alias("until"), "shard", "slot")


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's digest of `pieces`: what the mix takes of each document."""
    df, got = pieces(docs, **options)
    # (sid, at) names each document that has words
    taken = got.groupBy("sid", "at").agg(F.sum(F.col("until") - F.col("from")).alias("n"))
    full = df.where(F.col("size") > 0).join(taken, ["sid", "at"], "left")
    none = df.where(F.col("size") == 0).withColumn("n", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken")]
    return full.select(*cols).unionByName(none.select(*cols))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents of the mix with the columns of docs: a document comes once for each time round of
    which it has words, its text cut to the words taken. Those of no words, or not drawn, go."""
    df, got = pieces(docs, **options)
    turn = F.row_number().over(Window.partitionBy("sid", "at", "from").orderBy(F.desc("until"), "shard", "slot"))
    runs = got.withColumn("turn", turn).groupBy("sid", "at", "turn").agg(F.array_sort(F.collect_list(F.struct(F.col("from"), F.col("until")))).alias("runs"))
    places = df.where(F.col("size") > 0).select("sid", "at", "doc_id", "size", "__h")
    keyed = docs.select(row_of(docs.columns).alias("r"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.col("source").alias("s"))
    # repeated rows are told apart by a number; it costs a sort of the texts, so only where there are any
    repeats = places.groupBy("doc_id", "__h").count().where("count > 1").limit(1).count() > 0
    places = places.withColumn("m", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy("sid", "at")) if repeats else F.lit(1))
    nth = F.row_number().over(Window.partitionBy("d", "h").orderBy(F.col("s").asc_nulls_last()))
    keyed = keyed.withColumn("n", nth if repeats else F.lit(1))
    wanted = runs.join(places, ["sid", "at"]).select(F.col("doc_id").alias("w"), F.col("__h").alias("k"), "m", "size", "runs")
    both = keyed.join(wanted, F.col("d").eqNullSafe(F.col("w")) & (F.col("h") == F.col("k")) & (F.col("n") == F.col("m"))).select("r", "size", "runs")
    words = F.regexp_extract_all(F.col("r.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    whole = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: acc + x["until"] - x["from"]) == F.col("size")
    some = F.transform("runs", lambda x: F.array_join(F.slice(words, (x["from"] + 1).cast("int"), (x["until"] - x["from"]).cast("int")), ""))
    text = F.when(whole, F.col("r.text")).otherwise(F.array_join(some, ""))
    row = F.col("r").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return both.select(row.alias("r")).select("r.*")
