"""Scans and sinks: run-length masks, headers, HTML boards, URLs, polygons, JSON, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_lengths(payload: bytes) -> list[int]:
    """Alternating run lengths of an unsigned LEB128 byte string; an unfinished number is an error."""
    out, value, shift = [], 0, 0
    for b in payload:
        value |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            out.append(value)
            value, shift = 0, 0
    if shift:
        raise ValueError("the last run length is not finished")
    return out


def packed_runs(runs: list[int]) -> bytes:
    """The inverse of `run_lengths`."""
    out = bytearray()
    for n in runs:
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)
    return bytes(out)


def decode_runs(payloads: DataFrame, total: int) -> DataFrame:
    """(mask, cell_id) of the true cells of each (mask, payload) row; the first run is outside.

    Only run ends are made in Python; cells come from `explode(sequence)`. Lengths that do not add
    up to `total` are an error.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for mask, data in zip(b["mask"], b["payload"], strict=True):
                at = 0
                for k, n in enumerate(run_lengths(bytes(data))):
                    if k % 2 and n:
                        rows.append((mask, at, at + n - 1))
                    at += n
                if at != total:
                    raise ValueError(f"runs cover {at} of {total} cells")
            yield pd.DataFrame(rows, columns=["mask", "a", "b"])

    got = payloads.mapInPandas(ends, "mask string, a long, b long")
    return got.select("mask", F.explode(F.sequence("a", "b")).alias("cell_id"))


def mask_runs(cells: DataFrame) -> DataFrame:
    """(mask, start, n): runs of consecutive cell_id within each mask, by gaps and islands."""
    r = cells.select("mask", "cell_id").distinct()
    r = r.withColumn("g", F.col("cell_id") - F.row_number().over(Window.partitionBy("mask").orderBy("cell_id")))
    return r.groupBy("mask", "g").agg(F.min("cell_id").alias("start"), F.count("*").alias("n")).select("mask", "start", "n")


def packed_mask(cells: DataFrame, total: int) -> DataFrame:
    """(mask, payload) of true cells (mask, cell_id): the inverse of `decode_runs`. A payload is one value, so its mask's runs meet in one task."""

    def pack(runs: pd.DataFrame) -> pd.DataFrame:
        lengths, at = [], 0
        for start, n in zip(*(x.tolist() for x in (runs.sort_values("start")["start"], runs.sort_values("start")["n"])), strict=True):
            lengths += [start - at, n]
            at = start + n
        return pd.DataFrame({"mask": runs["mask"].iloc[:1], "payload": [packed_runs([*lengths, total - at])]})

    return mask_runs(cells).groupBy("mask").applyInPandas(pack, "mask string, payload binary")


def header(lines: DataFrame, required: list[str], within: int = 200) -> DataFrame:
    """(line_no, names): the first of the leading lines that has all required names, normalised.

    lines: line_no, text. Fails if there is none.
    """
    clean = F.transform(F.split(F.lower("text"), ","), lambda c: F.regexp_replace(F.trim(c), "[^a-z0-9]+", "_"))
    named = lines.where(F.col("line_no") < within).withColumn("names", clean)
    hit = named.where(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), "names")) == 0)
    first = hit.agg(F.min_by(F.struct("line_no", "names"), "line_no").alias("h"))
    return first.select(F.when(F.col("h").isNull(), F.raise_error(F.lit("no header with the required names"))).otherwise(F.col("h")).alias("h")).select("h.line_no", "h.names")


def links(html: Column) -> Column:
    """Array of (href, name) of the anchors of an HTML text."""
    href = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(1))
    name = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(2))
    return F.arrays_zip(href.alias("href"), name.alias("name"))


def leaderboard(pages: DataFrame, html: str) -> DataFrame:
    """Rows (rank, name, submissions, score) of boards; only whole rows with at least four decimals."""
    row = r'<tr>\s*<td>#(\d+)</td>\s*<td><a[^>]*>([^<]+)</a></td>\s*<td>(\d+) submissions</td>\s*<td>(\d\.\d{4,})</td>\s*</tr>'
    part = lambda k: F.regexp_extract_all(html, F.lit(row), F.lit(k))
    cols = F.arrays_zip(part(1).alias("rank"), part(2).alias("name"), part(3).alias("submissions"), part(4).alias("score"))
    got = pages.select("page_id", F.explode(cols).alias("r")).select("page_id", "r.*")
    return got.select("page_id", F.col("rank").cast("int"), "name", F.col("submissions").cast("int"), F.col("score").cast("double"))


def crossings(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells (cell_id, y, x) inside polygons (poly, edge ends ay, ax, by, bx), by the parity of ray crossings.

    The edge table is a setting, not data: it is broadcast.
    """
    e = F.broadcast(edges)
    hit = cells.join(e, (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y")))
    at = F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    got = hit.where(F.col("x") < at).groupBy("cell_id", "poly").agg(F.count("*").alias("n"))
    return got.where("n % 2 = 1").select("cell_id", "poly")


def slug(s: Column) -> Column:
    """Lower case, other than letters and digits to single hyphens, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(s), "[^0-9a-z]+", "-"), F.lit("-"))


def note(s: Column, size: int = 140) -> Column:
    """At most `size` characters; a longer text loses its middle."""
    keep = (size - 3) // 2
    return F.when(F.length(s) <= size, s).otherwise(F.concat(F.substring(s, 1, size - 3 - keep), F.lit("..."), F.right(s, F.lit(keep))))


def replace_table(df: DataFrame, path: str, checks: list[Column]) -> int:
    """Write df as parquet only if every check holds for every row; Spark's commit makes it whole or nothing."""
    bad = df.where(~F.expr("true") if not checks else ~_all(checks)).limit(1).count()
    if bad:
        raise ValueError("a row fails a check; nothing is written")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def _all(checks: list[Column]) -> Column:
    out = F.coalesce(checks[0], F.lit(False))
    for c in checks[1:]:
        out = out & F.coalesce(c, F.lit(False))
    return out
