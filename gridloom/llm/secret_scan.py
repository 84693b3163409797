"""Secret scanning with character Markov models, in DataFrame functions only.

Order-1 character chains are trained from labelled samples: random strings (one chain for each
spelling, such as base 64 or hex) and ordinary identifiers. A token's log-likelihood ratio says
which kind of chain it came from; every token of `LEAST_LENGTH` characters is scored, whatever its
characters, and those that look random and that no pattern covers add spans to the patterns'
own. The ratio to reach is set on samples that the chains were not trained on.

The trained tables have len(ALPHABET)+2 squared entries a chain however large the samples are; only
they travel to the driver. Everything else stays in expressions.

Defined results for odd rows: null text is empty; repeated rows give repeated results; with
no sample of a label its chain is uniform; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm._shared import joined, materialise, spans

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: What may be a secret without any pattern: fewer characters cannot tell the chains apart well enough.
LEAST_LENGTH = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}+"
SPELLINGS = 5

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits
#: States: 1..62 the alphabet, 0 every other character, 63 the edge of a token.
EDGE = len(ALPHABET) + 1
SIZE = EDGE + 1


def _states(v: Column) -> Column:
    return F.transform(F.split(v, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def _steps(v: Column) -> Column:
    """Index of each transition of a token, edges included, in a flattened SIZE x SIZE table."""
    codes = _states(v)
    edge = F.array(F.lit(EDGE))
    return F.zip_with(F.concat(edge, codes), F.concat(codes, edge), lambda a, b: a * SIZE + b)


def train(samples: DataFrame, *, prior: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition, for each random spelling in turn against ordinary,
    from rows (text, label): 0 ordinary, 1 to SPELLINGS random."""
    steps = samples.where(F.col("text").isNotNull() & (F.col("text") != "")).select("label", F.explode(_steps(F.col("text"))).alias("k"))
    counts = {k: [0] * SIZE * SIZE for k in range(SPELLINGS + 1)}
    for r in steps.groupBy("label", "k").count().collect():  # at most (SPELLINGS + 1) * SIZE * SIZE rows
        counts[int(r["label"])][r["k"]] = r["count"]
    log_p = {}
    for label, c in counts.items():
        rows = [sum(c[i * SIZE : (i + 1) * SIZE]) for i in range(SIZE)]
        log_p[label] = [math.log((n + prior) / (rows[k // SIZE] + prior * SIZE)) for k, n in enumerate(c)]
    return [a - b for label in range(1, SPELLINGS + 1) for a, b in zip(log_p[label], log_p[0], strict=True)]


def ratio(v: Column, table: list[float]) -> Column:
    """Nats by which the likeliest random chain, all equally likely beforehand, beats the ordinary one."""
    weights = F.from_json(F.lit(json.dumps(table)), "array<double>")  # one constant, where an array of literals would be many
    start = F.struct(*[F.lit(0.0).alias(f"s{i}") for i in range(SPELLINGS)])
    step = lambda acc, k: F.struct(*[(acc[f"s{i}"] + F.get(weights, k + i * SIZE * SIZE)).alias(f"s{i}") for i in range(SPELLINGS)])
    sums = F.aggregate(_steps(v), start, step, lambda acc: F.greatest(*[acc[f"s{i}"] for i in range(SPELLINGS)]))
    return sums - F.lit(math.log(SPELLINGS))


def random_strings(spark: SparkSession, n: int = 3000, *, seed: str = "sample") -> DataFrame:
    """Labelled random strings of 16 to 40 characters, by spelling: base 64 and letters of both
    cases (1), small letters and digits (2), hex (3), capitals and digits (4), small letters (5)."""
    bits = F.sha2(F.concat_ws(":", F.lit(seed), F.col("id")), 512)
    b64 = F.base64(F.unhex(F.concat(bits, F.sha2(bits, 512))))
    of = lambda chars: F.regexp_replace(b64, f"[^{chars}]", "")
    n_chars = (16 + F.col("id") % 25).cast("int")
    made = [(b64, 1), (of("A-Za-z"), 1), (of("a-z0-9"), 2), (bits, 3), (of("A-Z0-9"), 4), (of("a-z"), 5)]
    rows = F.array(*[F.struct(F.substring(x, F.lit(1), n_chars).alias("text"), F.lit(k).alias("label")) for x, k in made])
    return spark.range(n).select(F.explode(rows).alias("x")).select("x.*")


def numbers(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled ordinary numbers of 6 to 20 digits: what counts, dates and cards look like."""
    digits = F.regexp_replace(F.sha2(F.concat_ws(":", F.lit("number"), F.col("id")), 512), "[^0-9]", "")
    return spark.range(n).select(F.substring(digits, F.lit(1), (6 + F.col("id") % 15).cast("int")).alias("text"), F.lit(0).alias("label"))


def identifiers(docs: DataFrame, n_docs: int = 2000) -> DataFrame:
    """Labelled ordinary identifiers: words of documents with the n_docs least text hashes, alone
    and joined as identifiers join them. The bound on documents is the sample's only bound."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # only hashes are ranked; the chosen ones, n_docs at most, then find their texts
    least = rows.select("h").distinct().orderBy("h").limit(n_docs)
    some = rows.join(F.broadcast(least), "h", "left_semi")
    w = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{3,}+"), F.lit(0))).alias("w")).groupBy("w").count()
    w = w.select("w", F.pmod(F.xxhash64("w"), F.lit(1 << 20)).alias("h"))
    # words meet in pairs and threes: neighbours by hash, which has nothing to do with spelling
    near = Window.partitionBy(F.col("h") % 64).orderBy("h", "w")
    w = w.withColumn("x", F.coalesce(F.lead("w").over(near), F.col("w"))).withColumn("y", F.coalesce(F.lag("w").over(near), F.col("w")))
    joins = F.array(F.col("w"), F.lower(F.concat_ws("_", "w", "x", "y")), F.concat("w", F.initcap("x"), F.initcap("y")), F.concat(F.initcap("w"), F.initcap("x"), (F.col("h") % 100).cast("string")), F.lower(F.concat_ws("-", "w", "x", "y")), F.concat_ws("/", "w", "x", "y"), F.upper(F.concat_ws("_", "w", "x")), F.lower(F.concat("w", "x")))
    return w.select(F.explode(joins).alias("text"), F.lit(0).alias("label"))


def samples(docs: DataFrame, n_random: int = 3000, n_docs: int = 2000) -> DataFrame:
    """All labelled strings: random ones, numbers, and identifiers of the words of documents."""
    spark = docs.sparkSession
    return random_strings(spark, n_random).unionByName(numbers(spark, n_random)).unionByName(identifiers(docs, n_docs))


def fit(samples: DataFrame, *, false_rate: float = 1e-3, odds: float = 1e4) -> tuple[list[float], float]:
    """(table, least): chains from four fifths of the samples, and the ratio from which a token counts
    as random: over what `false_rate` of the other fifth's ordinary tokens reach, and enough to outweigh
    `odds` of ordinary tokens to a random one."""
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    table = train(samples.where(~held))
    rest = samples.where(held & (F.length("text") >= LEAST_LENGTH) & (F.col("label") == 0)).select(ratio(F.col("text"), table).alias("r"))
    top = rest.agg(F.percentile("r", 1.0 - false_rate)).first()[0]
    return table, max(math.log(odds), top if top is not None else 0.0)


def find(docs: DataFrame, table: list[float], least: float) -> DataFrame:
    """One row per row of docs: doc_id, base and more, arrays of struct(kind, s, e, v); a token
    is added as `random` if its ratio is at least `least` and no single base span covers it."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    df = spans(df, "assign", "text", ASSIGN, t.rlike("[:=]"))
    df = spans(df, "access", "text", ACCESS, t.contains("AKIA"))
    df = spans(df, "hex", "text", HEX, F.lit(True))
    df = spans(df, "token", "text", TOKEN, F.lit(True))
    df = df.drop("text")
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["v"], ASSIGN_VALUE, 1)) >= 6))

    def of(name: str, order: int) -> Column:
        return F.transform(F.col(name), lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), x["v"].alias("v")))

    def back(arr: Column, kinds: tuple[str, ...]) -> Column:
        names = F.array(*[F.lit(k) for k in kinds])
        return F.transform(arr, lambda x: F.struct(F.get(names, x["o"]).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))

    df = df.withColumn("base", back(F.array_sort(F.concat(*[of(k, i) for i, k in enumerate(KINDS)])), KINDS))
    free = F.filter("token", lambda x: ~F.exists("base", lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"])))
    df = df.withColumn("token", free)
    more = F.filter("token", lambda x: ratio(x["v"], table) >= least)
    return df.withColumn("more", F.transform(more, lambda x: F.struct(F.lit("random").alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))).select("doc_id", "base", "more")


def report(docs: DataFrame, *, n_random: int = 3000, n_docs: int = 2000, **options) -> DataFrame:
    """Train on a bounded labelled sample, scan every whole text, return the contract's digest."""
    found = find(docs, *fit(materialise(samples(docs, n_random, n_docs), "secret-samples"), **options))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "random")]), x["kind"]).alias("o"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size("more").cast("long").alias("n_random"),
    )
