"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words, for Spark and for Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of our own, but only in a
    local session, whose executors are the driver: a cluster must name its folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def materialise(df: DataFrame, name: str, *, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **({"compression": compression} if compression else {}))
    return spark.read.schema(df.schema).parquet(path)


def row_of(columns: list[str]) -> Column:
    """A struct of the columns, whatever their names hold."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns])


def text_key(text: Column) -> Column:
    """A 64-bit hash of a text; null counts as the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def crc_part(col: Column, n: int) -> Column:
    """crc32 of an id's decimal text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def spans(df: DataFrame, out: str, text: str, pattern: str, gate: Column) -> DataFrame:
    """Add array column `out` of struct(s, e, v): the leftmost non-overlapping matches of `pattern`
    in column `text`, in code points, end exclusive; an empty array where `gate` is false.

    The gaps that `split` leaves and the matches themselves give every position, so the
    expression engine alone is enough.
    """
    m, g = f"__m_{out}", f"__g_{out}"
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(gate, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("got"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v")))
        return F.struct(e.alias("at"), F.concat(acc["got"], one).alias("got"))

    both = F.zip_with(F.col(m), F.slice(F.col(g), F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("m"), b.alias("g")))
    return df.withColumn(out, F.aggregate(both, start, step)["got"]).drop(m, g)


def joined(arr: Column) -> Column:
    """kind:start:end, comma-joined, of an array of struct(kind, s, e) in its order."""
    return F.array_join(F.transform(arr, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def tagged(arr: str, kind: str) -> Column:
    return F.transform(F.col(arr), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
