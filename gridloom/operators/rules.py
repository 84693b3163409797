"""Fail-closed validation: named checks, blockers, receipts, content identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rows(df: DataFrame, checks: dict[str, tuple[Column, bool]]) -> DataFrame:
    """(name, hard, passed): aggregate checks in one pass over df, then one row each. Null is not passing."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(k) for k, (c, _) in checks.items()])
    rows = one.unpivot([], list(checks), "name", "passed")
    hard = F.create_map(*[x for k, (_, h) in checks.items() for x in (F.lit(k), F.lit(h))])
    return rows.select("name", hard[F.col("name")].alias("hard"), "passed")


def verdict(rows: DataFrame) -> DataFrame:
    """One row: passed (all hard checks), and the failed names in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return rows.agg(F.bool_and(F.col("passed") | ~F.col("hard")).alias("passed"), F.array_join(failed, ",").alias("failed"))


def blockers(**rules: Column) -> Column:
    """Names of the rules that do not hold, in order; null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))


#: Keys, or hashes of the level below, in a block of a content hash.
BLOCK = 4096


def content_id(df: DataFrame, key: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, out): SHA-256 of a set of keys from 0 on, as a tree.

    A block of keys is hashed as comma-joined text in order, then blocks of block hashes likewise,
    until one is left; two levels at least. No row holds more than BLOCK parts, unless keys repeat.
    Null keys are left out; no keys at all give no row.
    """
    top = df.agg(F.max(key)).first()[0]
    level = df.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("__at"), F.col(key).cast("string").alias("__part"))
    size, levels = BLOCK, 2
    while size * BLOCK <= (top or 0):
        size, levels = size * BLOCK, levels + 1
    for _ in range(levels):
        parts = F.array_sort(F.collect_list(F.struct("__at", "__part")))
        text = F.array_join(F.transform(parts, lambda p: p["__part"]), ",")
        level = level.groupBy(*by, F.floor(F.col("__at") / BLOCK).alias("__b")).agg(F.sha2(text.cast("binary"), 256).alias("__part"))
        level = level.withColumnRenamed("__b", "__at")
    return level.select(*by, F.col("__part").alias(out))


def cache_state(source: DataFrame, copy: DataFrame, part: str, parts: DataFrame) -> DataFrame:
    """(part, lost, added, reusable) of a copy against its source: rows only in one, repeats counted."""
    n = F.count("*")
    lost = source.exceptAll(copy).groupBy(F.col(part).alias("part")).agg(n.alias("lost"))
    added = copy.exceptAll(source).groupBy(F.col(part).alias("part")).agg(n.alias("added"))
    both = parts.join(lost, "part", "left").join(added, "part", "left").na.fill(0, ["lost", "added"])
    return both.withColumn("reusable", F.col("lost") + F.col("added") == 0)


def blob_sha(content: Column) -> Column:
    """SHA-1 of a content-addressed blob: its header, a zero byte, its bytes."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.unhex(F.lit("00")), data))


def safe_relative(path: Column) -> Column:
    """Relative, with no parent steps, no backslash, not empty."""
    return F.coalesce(~path.rlike(r"^/|^$|\\|(^|/)\.\.(/|$)"), F.lit(False))


def is_hash(value: Column, digits: int = 40) -> Column:
    return F.coalesce(value.rlike(f"^[0-9a-f]{{{digits}}}$"), F.lit(False))


def number_in(json: Column, path: str, low: float, high: float) -> Column:
    """Whether a JSON field is a number, not a boolean or text, in [low, high]."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    value = F.try_variant_get(v, path, "double")
    return F.coalesce(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)") & value.between(low, high), F.lit(False))


def positive_interval(lo: Column, hi: Column) -> Column:
    return F.coalesce((lo > 0) & (lo <= hi) & (hi <= 1), F.lit(False))


def manifest_gaps(manifest: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) of a manifest against what was found: missing, duplicate, mismatch, extra; good rows are left out."""
    f = found.groupBy(key).agg(F.count("*").alias("__n"), F.max(value).alias("__got"))
    both = manifest.select(key, F.col(value).alias("__want"), F.lit(True).alias("__m")).join(f, key, "full")
    state = (
        F.when(F.col("__n").isNull(), "missing").when(F.col("__m").isNull(), "extra").when(F.col("__n") > 1, "duplicate")
        .when(~F.col("__got").eqNullSafe(F.col("__want")), "mismatch")
    )
    return both.select(key, state.alias("state")).where("state IS NOT NULL")


def only_listed_drops(saved: DataFrame, fresh: DataFrame, allowed: list[str]) -> DataFrame:
    """One row: whether gates (name, ok) that went from true to false are all on the list, and none vanished."""
    both = saved.select("name", F.col("ok").alias("a")).join(fresh.select("name", F.col("ok").alias("b")), "name", "full")
    fine = F.col("a").eqNullSafe(F.col("b")) | (F.col("a") & ~F.coalesce("b", F.lit(True)) & F.col("name").isin(allowed))
    return both.agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("compatible"))
