"""Language identification with bit-sliced Bloom filters over byte n-grams.

One table of language bitmasks serves as a Bloom filter for every language at once: bit l of
a slot says that language l has an n-gram there. The bitwise AND of an n-gram's slots gives
all languages that (seem to) hold it. A document's n-grams are counted per language; each
count is corrected for its filter's false positives, and the largest share decides.

The table's size is fixed (`SLOTS` masks per 63 languages), so it may be broadcast. An n-gram enters
a language's filter if it is not rare there against its best language. Counts cover all
training documents.

Defined results for odd rows: a null text, or one without a letter, is `und` with score 0;
with nothing learned all are `und`; if no n-gram is known, the language with the fullest
filter is taken with score 0; ties go to the language first by code point; repeated rows get
the same result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm._shared import crc_part

GRAM = 4
BITS = 20
SLOTS = 1 << BITS
#: Odd multipliers of the filter's hash functions.
HASHES = (2654435761, 2246822519, 3266489917)
PLANE = 63
#: An n-gram is a language's own with so many sightings, and so large a share of its best language's rate.
LEAST, LEAST_SHARE = 3, 0.05
CHUNK = 1 << 21

_LETTER = regex.compile(r"\p{L}")
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def grams(data: bytes) -> np.ndarray:
    """n-grams of GRAM bytes that hold a letter."""
    a = np.frombuffer(data, dtype=np.uint8)
    if len(a) < GRAM:
        return np.zeros(0, np.uint32)
    n = len(a) - GRAM + 1
    w, letter = np.zeros(n, np.uint32), np.zeros(n, bool)
    known = _IS_LETTER[a]
    for i in range(GRAM):
        w |= a[i : i + n].astype(np.uint32) << np.uint32(8 * i)
        letter |= known[i : i + n]
    return w[letter]


def prepared(text: str) -> bytes:
    return f" {text.lower()} ".encode()


def _slices(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that share GRAM - 1 bytes, so that each n-gram comes once."""
    for i in range(0, max(1, len(data) - GRAM + 1), CHUNK):
        yield data[i : i + CHUNK + GRAM - 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def fold(lang: str) -> None:
        w = np.concatenate([grams(s) for d in held.pop(lang) for s in _slices(d)] or [np.zeros(0, np.uint32)])
        g, n = np.unique(w, return_counts=True)
        if lang in sums:
            both, at = np.unique(np.concatenate([sums[lang][0], g]), return_inverse=True)
            n = np.bincount(at, np.concatenate([sums[lang][1], n])).astype(np.int64)
            g = both
        sums[lang] = (g, n)

    def flush() -> pa.RecordBatch:
        out = [pa.array([x for lang, (g, _) in sums.items() for x in [lang] * len(g)], pa.string()), *(pa.array(np.concatenate([v[i] for v in sums.values()] or [np.zeros(0)]).astype(np.int64)) for i in (0, 1))]
        sums.clear()
        return pa.RecordBatch.from_arrays(out, ["lang", "gram", "n"])

    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = prepared(text.as_py())
            held.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            if size[lang] >= CHUNK:
                fold(lang)
                size[lang] = 0
            if sum(len(g) for g, _ in sums.values()) > 2_000_000:
                yield flush()
    for lang in list(held):
        fold(lang)
    yield flush()


def train(docs: DataFrame, held_out) -> tuple[list[str], np.ndarray]:
    """(languages, masks[plane, slot]) of labelled documents that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out).select("lang", "text")
    seen = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    langs = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]  # a row per language
    planes = max(1, -(-len(langs) // PLANE))
    table = np.zeros((planes, SLOTS), dtype=np.int64)
    if not langs:
        return langs, table
    order = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
    total = seen.groupBy("lang").agg(F.sum("n").alias("all"))
    seen = seen.where(F.col("n") >= LEAST).join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("all"))
    seen = seen.withColumn("best", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= LEAST_SHARE * F.col("best"))
    bit = F.expr(f"shiftleft(1L, cast(l % {PLANE} as int))")
    slot = F.array(*[F.shiftright((F.col("gram") * F.lit(h)) % (1 << 32), 32 - BITS) for h in (x >> 1 | 1 for x in HASHES)])
    hits = seen.withColumn("l", order).select((F.col("l") / PLANE).cast("int").alias("plane"), F.explode(slot).alias("slot"), bit.alias("bit"))
    masks = hits.groupBy("plane", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()  # at most planes * SLOTS rows
    table[masks["plane"].to_numpy(), masks["slot"].to_numpy()] = masks["mask"].to_numpy()
    return langs, table


def _lookup(table: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = None
    for h in (x >> 1 | 1 for x in HASHES):
        at = (w * np.uint32(h)) >> np.uint32(32 - BITS)
        out = table[at] if out is None else out & table[at]
    return out


def tally(text: str, planes: list[np.ndarray], n_langs: int) -> tuple[int, np.ndarray]:
    """(n-grams, n-grams by language) of a whole text."""
    n, counts = 0, np.zeros(n_langs, dtype=np.int64)
    for piece in _slices(prepared(text)):
        w = grams(piece)
        n += len(w)
        for p, table in enumerate(planes):
            m = _lookup(table, w)
            if table.dtype == np.uint8:
                c = np.bincount(m, minlength=256)
                for lang in range(n_langs):
                    counts[lang] += c[(np.arange(256) >> lang) & 1 == 1].sum()
            else:
                for lang in range(p * PLANE, min(n_langs, (p + 1) * PLANE)):
                    counts[lang] += np.count_nonzero((m >> np.int64(lang % PLANE)) & 1)
    return n, counts


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of every row; docs: doc_id, text and further columns to carry along."""
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.uint8) if len(langs) <= 8 else table)
    fill = np.array([((table[i // PLANE] >> (i % PLANE)) & 1).mean() for i in range(len(langs))])
    wrong = fill ** len(HASHES)
    prior = int(np.argmax(fill)) if langs else 0
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = list(shared.value)
        for batch in batches:
            best, score = [], []
            for t in batch.column(batch.schema.get_field_index("text")):
                t = t.as_py()
                if t is None or not langs or not _LETTER.search(t):
                    best.append("und")
                    score.append(0.0)
                    continue
                n, c = tally(t, planes, len(langs))
                share = np.clip((c - n * wrong) / (1 - wrong + 1e-12), 0, None) / max(n, 1)
                i = int(np.argmax(share)) if share.max() > 0 else prior
                best.append(langs[i])
                score.append(float(round(min(1.0, share[i]), 9)))
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """Train outside the held-out fifth, predict every whole text."""
    held_out = crc_part(F.col("doc_id"), 5) == 0
    langs, table = train(docs, held_out)
    rows = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), langs, table)
    return rows.select("doc_id", "held_out", "lang_pred", "score")
