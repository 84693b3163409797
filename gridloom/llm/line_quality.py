"""Quality rules over whole documents, and lines that too many documents of a host share.

Lines are normalised (lower case, digits to 0, white space folded), hashed, and counted by
distinct documents within a host. A line over `most_documents` is boiler-plate there: it goes
from every document but the first (least id) that has it. Documents that so lose over
`most_lost` of their words are depleted and rejected.

A document is its id and its text: the repeats of a row count once, and rows of different ids
count each, so a page that is copied often makes its own lines boiler-plate and only its first
copy keeps them. Hash and counts cover all documents; the join of lines to counts has a hot key
only where a line is hot, and then Spark splits it.

Defined results for odd rows: a null text has no words and fails the base rules; a null host
is a host; rows without an id are told apart by their texts and come last where a first document
is sought; repeated rows get the same result, each with its own loss; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gridloom.llm._shared import materialise, row_of, text_key

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Windows in which repeated words are looked for.
WINDOW = 5
MOST_DOCUMENTS, MOST_LOST, LEAST_WORDS, MOST_REPEATED = 20, 0.7, 10, 20

_STATS = "doc_id {id}, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:bigint,n:int>>"
_DIGITS = re.compile(rb"[0-9]+")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == n:
        return 0
    first: dict[tuple, int] = {}
    twice = np.zeros(n + window, dtype=np.int32)
    for i, g in enumerate(grams):
        j = first.setdefault(g, i)
        if j != i:
            for k in (i, j):
                twice[k] = 1
    at = np.flatnonzero(twice)
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_hash(parts: list[bytes]) -> int:
    """Hash of a normalised line, given its words."""
    return xxhash.xxh64_intdigest(_DIGITS.sub(b"0", b" ".join(parts).lower())) - (1 << 63)


def without_lines(text: str, gone: set[int]) -> str:
    """`text` without the lines whose hash is in `gone`; blank lines stay."""
    kept = [line for line in text.split("\n") if not ((parts := line.encode().split()) and line_hash(parts) in gone)]
    return "\n".join(kept)


def text_stats(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [(line hash, words)])."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[bytes] = set()
    dup, lines = 0, []
    for line in raw.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        lines.append((line_hash(parts), len(parts)))
    return len(words), chars, symbols, dup, repeated_words(words), lines


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hosts, texts, keys = (batch.column(i) for i in range(4))
        rows = [text_stats(t or "") for t in texts.to_pylist()]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        offsets = np.cumsum([0] + [len(r[5]) for r in rows]).astype(np.int32)
        flat = [x for r in rows for x in r[5]]
        inner = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32())], ["h", "n"])
        lines = pa.ListArray.from_arrays(pa.array(offsets), inner)
        names = ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
        yield pa.RecordBatch.from_arrays([ids, hosts, keys, *cols, lines], names)


def _judge(docs: DataFrame, *, host: str = "source", most_documents: int = MOST_DOCUMENTS, most_lost: float = MOST_LOST) -> tuple[DataFrame, DataFrame]:
    """(rows of `judge`, with row, host and text_hash; removed lines: row, host, doc_id, text_hash, h, n)."""
    stats = _STATS.format(id=docs.schema["doc_id"].dataType.simpleString())
    scanned = docs.select("doc_id", F.col(host).cast("string").alias("host"), "text", text_key(F.col("text")).alias("text_hash")).mapInArrow(_scan, stats)
    rows = materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "quality")
    at = rows.select("row", "doc_id", "host", "text_hash", F.explode("lines").alias("l")).select("row", "doc_id", "host", "text_hash", "l.h", "l.n")
    # a document is its id and text: its repeats count once, documents with the same text do not
    each = at.select("host", "h", F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").distinct()
    common = each.groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.min(F.struct("no_id", "doc_id", "text_hash")).alias("owner")).where(F.col("n_docs") > most_documents)
    common = common.select(F.col("host").alias("__host"), F.col("h").alias("__h"), "owner")
    owns = F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("text_hash") == F.col("owner.text_hash"))
    hit = at.join(common, at["host"].eqNullSafe(common["__host"]) & (at["h"] == common["__h"])).where(~owns).select("row", "host", "doc_id", "text_hash", "h", "n")
    lost = hit.groupBy("row").agg(F.sum("n").alias("lost_words"))
    out = rows.drop("lines").join(lost, "row", "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)))
    bad = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", bad)
    return out.withColumn("kept", ~bad & (F.col("lost_words") <= most_lost * F.col("n_words"))), hit


def judge(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: the counts, base_failed, lost_words (in removed lines) and kept."""
    return _judge(docs, **options)[0].drop("row")


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's digest of `judge`."""
    return judge(docs, **options).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


@F.arrow_udf(StringType())
def _cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of `gone`; null, so that the text stays, where there are none."""
    return pa.array([None if g is None else without_lines(t or "", set(g)) for t, g in zip(texts.to_pylist(), gone.to_pylist(), strict=True)], pa.string())


def keep(docs: DataFrame, **options) -> DataFrame:
    """docs without the rejected documents, and the rest without the lines that too many documents
    share (the first document keeps them); n_chars follows, other columns and rows are untouched."""
    judged, hit = _judge(docs, **options)
    who = ["doc_id", "host", "text_hash"]  # rows alike in these three are judged alike
    gone = hit.groupBy("row").agg(F.collect_set("h").alias("gone"))
    marked = judged.join(gone, "row", "left").where(~F.col("kept") | F.col("gone").isNotNull()).groupBy(*who).agg(F.first("kept").alias("kept"), F.first("gone").alias("gone"))
    marked = materialise(marked, "quality-marked").alias("m")
    # the row itself stays apart from helper columns, whatever its own are called
    keyed = docs.select(row_of(docs.columns).alias("r"), F.col("doc_id").alias("d"), F.col(options.get("host", "source")).cast("string").alias("s"), text_key(F.col("text")).alias("t"))
    same = F.col("d").eqNullSafe(F.col("m.doc_id")) & (F.col("t") == F.col("m.text_hash")) & F.col("s").eqNullSafe(F.col("m.host"))
    here = keyed.join(marked, same, "left").where(F.coalesce("m.kept", F.lit(True)))
    # only texts that lose a line go to Python
    fresh = here.select("r", _cut(F.when(F.col("m.gone").isNotNull(), F.col("r.text")), F.col("m.gone")).alias("new"))
    row = F.col("r").withField("text", F.coalesce("new", "r.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("new").isNotNull(), F.length("new")).otherwise(F.col("r.n_chars")).cast(docs.schema["n_chars"].dataType))
    return fresh.select(row.alias("r")).select("r.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
pos AS (SELECT row, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
win AS (SELECT row, i, array_to_string(ws[i:i+4], ' ') AS g FROM pos),
rep AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT k) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS k FROM rep) GROUP BY row),
lines AS (SELECT row, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
real AS (SELECT *, regexp_replace(translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM real GROUP BY row),
common AS (SELECT source, norm, min(doc_id) AS owner FROM real GROUP BY source, norm HAVING count(DISTINCT {'d': doc_id, 't': text}) > 20),
lost AS (SELECT r.row, sum(r.n) AS n FROM real r JOIN common c ON r.source IS NOT DISTINCT FROM c.source AND r.norm = c.norm WHERE r.doc_id IS DISTINCT FROM c.owner GROUP BY r.row),
s AS (SELECT w.row, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN dup USING (row) LEFT JOIN covered USING (row) LEFT JOIN lost USING (row)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_words <= 0.7 * n_words AS kept, lost_words FROM b
"""
