"""Collocations: phrases that occur together far more often than their parts do apart.

Texts are cut at punctuation into pieces, pieces into words, Arrow batch by batch. Words are counted by language. A word seen
fewer than `least` times is in no phrase that is asked for; the others get numbers, and the pieces are written as
numbers, cut again where a rare word stood. Then 2- to `max_n`-grams are exploded into rows of numbers and summed, size
by size. A gram is seen no more often than any part of it, so from triples on a round leaves out at once what begins or
ends with a gram that is too rare: rows meet the hash slots of those that are often enough, `SLOTS` at most, whatever
the corpus; a shared slot only lets more through, and sums are exact. Spark adds up each task's rows before it deals
them, so frequent grams are no hot keys.
Candidates meet the counts of their first and last words by joins, one for each cut; scores are decimals;
a phrase that a one-word extension nearly always surrounds is dropped by an anti-join. (A longer
phrase around it implies such an extension: counts only fall as phrases grow.) Ranks come from a
window that first keeps each task's best `top` of a language.

Long pieces are dealt in runs of `RUN` starts that overlap by `max_n - 1` words, so that no row
holds more and no gram is seen twice. Tasks hold `BYTES` of text and `HELD` parts of `CODED` numbered words at a time, and
read further parts of a larger vocabulary from the shared folder for each stretch of text.

Defined results for odd rows: a null or empty text has no words; a null language is `und`; repeated
rows count each; a language without candidates has no rows; an empty table gives none; other columns
are ignored. Words differ by their bytes; only A-Z are lower-cased.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm._shared import materialise, shared_dir

#: Where pieces end, and what else lies between words.
ENDS, GAPS = r"[\n.,;:!?\x0b\x0c\r]+", r"[ \t]+"
#: Starts of grams that one row carries; bytes of text taken apart at once; words in a part of the vocabulary, and parts held; hash slots of frequent grams: at most so many rows of one number are broadcast; parts in which words are numbered.
RUN, BYTES, CODED, HELD, SLOTS, PARTS = 64, 2 << 20, 1_000_000, 2, 1 << 21, 64
WIDE = "decimal(38,0)"


def stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.take(pa.array(np.arange(start, end)))  # a copy: not all text functions heed a slice's offset
            start = end


def apart(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(lang, word, piece) of every word of a batch (lang, text), in order; pieces are numbered within it."""
    text = pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
    pieces = pc.split_pattern_regex(text, ENDS)
    flat = pieces.flatten()
    split = pc.split_pattern_regex(flat, GAPS)
    word = split.flatten()
    piece = pc.list_parent_indices(split)
    real = pc.not_equal(word, "")
    word, piece = word.filter(real), piece.filter(real)
    lang = batch.column("lang").cast(pa.large_string()).take(pc.list_parent_indices(pieces)).take(piece)
    return lang, word, piece.to_numpy()


def _counted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches, most):
            lang, word, _ = apart(batch)
            got = pa.table({"lang": lang, "word": word}).group_by(["lang", "word"]).aggregate([([], "count_all")]).combine_chunks()
            cols = [got.column("lang"), got.column("word"), got.column("count_all")]
            yield from pa.table([c.cast(t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "f"]).to_batches()

    return run


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def words(docs: DataFrame) -> DataFrame:
    """(lang, word, f): every word and its occurrences."""
    return texts(docs).mapInArrow(_counted(BYTES), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(often: DataFrame) -> DataFrame:
    """(lang, word, f, id) with a number of its own for each row, nearly without gaps."""
    part = F.pmod(F.xxhash64("lang", "word"), F.lit(PARTS)).cast("int")
    w = Window.partitionBy("part").orderBy("lang", "word")
    rows = often.withColumn("part", part).withColumn("id", (F.row_number().over(w) - 1) * PARTS + F.col("part"))
    return rows.select("lang", "word", "f", F.col("id").cast("int").alias("id"))


def _joined(lang: pa.Array, word: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(lang.cast(pa.large_string()), word.cast(pa.large_string()), pa.scalar("\0", pa.large_string()))


def _part(folder: str, c: int) -> tuple[pa.Array, pa.Array]:
    """(keys, numbers) of a part of the vocabulary."""
    fs, base = pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    t = pyarrow.dataset.dataset(f"{base}/chunk={c}", filesystem=fs, format="parquet").to_table(columns=["lang", "word", "id"]).combine_chunks()
    one = lambda x: pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    return one(_joined(t.column("lang"), t.column("word"))), one(t.column("id"))


def _cut(ids: np.ndarray, known: np.ndarray, piece: np.ndarray, starts: int, more: int) -> pa.Array:
    """Runs of numbers: stretches of known words of one piece, two at least; longer ones in runs of so many starts and `more` words."""
    at = np.flatnonzero(known)
    if not len(at):
        return pa.array([], pa.list_(pa.int32()))
    begins = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(piece[at]) != 0)])
    first = np.flatnonzero(begins)
    length = np.diff(np.concatenate([first, [len(at)]]))
    n = np.maximum(1, -(-(length - 1) // starts))  # the last word alone starts no gram of two
    start = np.repeat(first, n) + starts * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    size = np.minimum(np.repeat(first + length, n) - start, starts + more)
    start, size = start[size > 1], size[size > 1]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    take = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[at][take], pa.int32()))


def _coded(folder: str, n_parts: int, held_parts: int, most: int, starts: int, more: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: _part(folder, c) for c in range(min(n_parts, held_parts))}
        for batch in stretches(batches, most):
            lang, word, piece = apart(batch)
            key, ids = _joined(lang, word), None
            for c in range(n_parts):
                keys, numbers = held[c] if c in held else _part(folder, c)
                new = numbers.take(pc.index_in(key, keys))
                ids = new if ids is None else pc.coalesce(ids, new)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([_cut(ids.fill_null(-1).to_numpy(), known, piece, starts, more)], ["ids"])

    return run


def coded(docs: DataFrame, often: DataFrame, max_n: int) -> DataFrame:
    """(ids): the words' numbers along every piece, cut where a word has none."""
    top = often.agg(F.max("id")).first()[0]
    if top is None:
        return docs.sparkSession.createDataFrame([], "ids array<int>")
    folder = f"{shared_dir(docs.sparkSession)}/gridloom-vocabulary-{uuid.uuid4().hex}"
    parts = often.select("lang", "word", "id", F.floor(F.col("id") / CODED).alias("chunk"))
    parts.write.partitionBy("chunk").parquet(folder)
    # numbers leave gaps, but no part of CODED of them can be empty below the last
    return texts(docs).mapInArrow(_coded(folder, top // CODED + 1, HELD, BYTES, RUN, max_n - 1), "ids array<int>")


def _slots(known: DataFrame, k: int, out: str) -> DataFrame:
    return F.broadcast(known.select(_slot([F.col("ids")[j] for j in range(k)]).alias(out)).distinct())


def _slot(ids):
    return F.pmod(F.xxhash64(*ids), F.lit(SLOTS))


def gram_round(codes: DataFrame, size: int, known: DataFrame | None) -> DataFrame:
    """(ids, f): every gram of `size` words and its occurrences; of those from which a part of one word less is not `known`, some."""
    at = codes.select("ids", F.posexplode("ids").alias("i", "w0")).where(F.col("i") < RUN)
    names = [f"w{j}" for j in range(size)]
    at = at.select("w0", *[F.get("ids", F.col("i") + j).alias(f"w{j}") for j in range(1, size)])
    for name in names[1:]:
        at = at.where(F.col(name).isNotNull())
    if known is not None:
        for side, part in (("a", names[:-1]), ("b", names[1:])):
            at = at.join(_slots(known, size - 1, side), _slot([F.col(c) for c in part]) == F.col(side))
    sums = at.groupBy(*names).agg(F.count("*").alias("f"))
    return sums.select(F.array(*names).alias("ids"), "f")


def collocations(docs: DataFrame, *, max_n: int = 4, least: int = 30, share: int = 80, scale: int = 1_000_000, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to max_n words that occur `least` times.

    a counts the phrase, l and r its two parts at the cut of least score 2 * scale * a / (l + r), rounded
    down; n counts the language's words. Phrases that an extension surrounds in `share` percent of their places are left out.
    """
    rare = F.when(F.col("f") >= least, F.col("word")).alias("word")  # rare words only as their sum, under null
    single = materialise(words(docs).groupBy("lang", rare).agg(F.sum("f").alias("f")), "words")
    total = single.groupBy("lang").agg(F.sum("f").alias("n"))
    single = materialise(numbered(single.where("word IS NOT NULL")), "numbered")
    codes = materialise(coded(docs, single, max_n), "codes", compression="zstd")
    often, found, known = single.select(F.array("id").alias("ids"), "f"), None, None
    for size in range(2, max_n + 1):
        known = materialise(gram_round(codes, size, known).where(F.col("f") >= least), f"grams-{size}")
        often = often.unionByName(known)
        found = known if found is None else found.unionByName(known)
    found = found.select("ids", F.col("f").alias("a"), F.size("ids").alias("size"))
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("head", F.slice("ids", F.lit(1), F.col("k"))).withColumn("tail", F.slice("ids", F.col("k") + 1, F.col("size") - F.col("k")))
    cut = cut.join(often.toDF("head", "l"), "head").join(often.toDF("tail", "r"), "tail")
    score = F.expr(f"(CAST({2 * scale} AS {WIDE}) * CAST(a AS {WIDE})) DIV (CAST(l AS {WIDE}) + CAST(r AS {WIDE}))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    scored = cut.groupBy("ids", "a").agg(best).select("ids", "a", "b.l", "b.r", "b.score")
    inner = F.array(F.slice("ids", F.lit(1), F.col("size") - 1), F.slice("ids", F.lit(2), F.col("size") - 1))
    longer = found.where("size > 2").select(F.explode(inner).alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    mostly = F.col("x.longer").cast(WIDE) * 100 >= F.col("s.a").cast(WIDE) * share
    kept = scored.alias("s").join(longer.alias("x"), (F.col("s.ids") == F.col("x.ids")) & mostly, "left_anti")
    spelt = kept.select("*", F.posexplode("ids").alias("i", "id")).join(single.select("id", "lang", "word"), "id")
    ordered = F.array_sort(F.collect_list(F.struct("i", "word")))  # max_n at most
    phrase = F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("phrase")
    spelt = spelt.groupBy("lang", "ids", "a", "l", "r", "score").agg(phrase)
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, n AS size, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM u JOIN range(1, 5) AS t(n) ON i + n - 1 <= len(w)),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY ALL),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
cut AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, ((2000000 * c.a::HUGEINT) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM c, range(1, size) AS k(k) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 :], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = b.lang AND x.phrase <> b.phrase
  AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * x.a::HUGEINT >= 80 * b.a::HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
