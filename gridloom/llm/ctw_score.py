"""Language-model scoring by context-tree weighting over the bytes of whole texts.

A text is its tokens, lower-cased, each word closed by one space, and the whole by an end mark.
A byte is eight binary decisions; the decisions so far name one of 255 nodes, and each
node has a context tree over the `DEPTH` bytes before, whatever words they belong to; before a
text's first byte stand end marks. With KT estimates at all tree nodes,

    Pw(s) = 1/2 Pe(s) + 1/2 prod Pw(children of s)      at inner nodes,  Pw = Pe at depth DEPTH

every depth is mixed. Scoring uses the posterior weights of the trained tree: from the
deepest context that training saw up to the root, a node gives its own KT estimate the weight
Pe / 2 Pw and passes the rest down.

Plan: one pass writes blocks of documents (some tens of MB): their texts, compressed, and a request
for each of `parts` hash parts, with the block's distinct words and its distinct grams (a byte
and the bytes before it), each with its count in training. Requests meet by part: counts of a
word come from all blocks, and go back; counts of a gram go to the trained tree, whose subtrees
below two context bytes are worked out apart and whose top has at most 256 x 256 nodes. The
gram's log probability goes back to the blocks by part, where whole texts are summed position by
position. Every distinct gram of a block is a request once; no table that grows with the corpus is
broadcast or collected.

Defined results for odd rows: a null or wordless text is its end mark; repeated rows are scored
and learnt separately; with nothing to learn from, the base score counts each token as
0 and the model gives each bit 1/2; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import crc_part, materialise

DEPTH = 5
#: Bytes of text to a block and to a piece of one, and positions that are worked on at once.
BLOCK_BYTES, PIECE_BYTES, WINDOW = 48 << 20, 1 << 20, 1 << 20
#: Bytes of text for each hash part of the requests.
PART_BYTES = 16 << 20
END_MARK = b"\x00"
WORDS, GRAMS = 0, 1


# ---- texts, grams and requests

def normalised(text: str | None) -> tuple[bytes, int]:
    """(the bytes that are scored, tokens): words closed by spaces, then the end mark."""
    words = (text or "").encode().lower().split()
    return b"".join((b" ".join(words), b" " if words else b"", END_MARK)), len(words) + 1


def grams_of(texts: list[bytes], window: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(grams of consecutive bytes, where each text begins among them, number of the first of these
    texts), some positions at a time. A gram: bytes before, nearest highest, then the byte itself."""
    window = window or WINDOW
    pad = END_MARK * DEPTH
    a = np.frombuffer(pad + b"".join(x for t in texts for x in (pad, t)), np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    real = np.ones(len(a), bool)
    real[:DEPTH] = False
    for k in range(DEPTH):
        real[DEPTH + ends - lens + DEPTH * np.arange(len(texts)) + k] = False
    done = 0  # bytes of texts so far
    for lo in range(DEPTH, len(a), window):
        hi = min(lo + window, len(a))
        g = a[lo:hi].astype(np.int64)
        for k in range(1, DEPTH + 1):
            g |= a[lo - k : hi - k].astype(np.int64) << np.int64(8 * (DEPTH - k + 1))
        g = g[real[lo:hi]]
        if len(g):
            first = int(np.searchsorted(ends, done, side="right"))
            last = int(np.searchsorted(ends, done + len(g), side="left")) + 1
            yield g, np.maximum(ends[first:last] - lens[first:last] - done, 0), first
            done += len(g)


def gram_part(g: np.ndarray, parts: int) -> np.ndarray:
    h = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, inv = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(inv, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its places in their order)."""
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.diff(part[order], prepend=-1))
    for i, j in zip(edge, [*edge[1:], len(order)], strict=True):
        yield int(part[order[i]]), order[i:j]


class _Packer:
    """Arrays and word lists as compressed bytes, and back."""

    def __init__(self):
        self.zip, self.unzip = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

    def numbers(self, x: np.ndarray) -> bytes:
        return self.zip.compress(np.ascontiguousarray(x).tobytes())

    def to_numbers(self, data: bytes, kind: str = "<i8") -> np.ndarray:
        return np.frombuffer(self.unzip.decompress(data), kind)

    def words(self, x: list[bytes]) -> bytes:
        return self.zip.compress(b" ".join(x))

    def to_words(self, data: bytes) -> list[bytes]:
        return self.unzip.decompress(data).split(b" ")

    def texts(self, x: list[bytes]) -> bytes:
        lens = np.array([len(x), *map(len, x)], "<i8").tobytes()
        return self.zip.compress(lens + b"".join(x))

    def to_texts(self, data: bytes) -> list[bytes]:
        raw = self.unzip.decompress(data)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        ends = np.cumsum(np.frombuffer(raw, "<i8", n + 1)[1:]) + 8 * (n + 1)
        return [raw[e - m : e] for e, m in zip(ends.tolist(), np.frombuffer(raw, "<i8", n + 1)[1:].tolist(), strict=True)]


class _Contents:
    """The distinct words and grams of some texts, with their counts in those that train."""

    def __init__(self):
        self.counts: Counter[bytes] = Counter()
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes], trains: list[bool]) -> None:
        counts = self.counts
        for t, train in zip(texts, trains, strict=True):
            words = t[:-1].split()
            words.append(b"")  # the end mark
            if train:
                counts.update(words)
            else:
                for w in words:
                    counts.setdefault(w, 0)
        for some, train in (([t for t, x in zip(texts, trains, strict=True) if x], 1), ([t for t, x in zip(texts, trains, strict=True) if not x], 0)):
            for g, *_ in grams_of(some) if some else ():
                u, n = np.unique(g, return_counts=True)
                self.held.append((u, n * train))
        if sum(len(k) for k, _ in self.held) > 4_000_000:
            self.held = [_merged(self.held)]

    def words(self, parts: int) -> Iterator[tuple[int, list[bytes]]]:
        """(part, its words) in the order of parts and words: that of every request and reply."""
        words = sorted(self.counts)
        part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
        for p, at in _by_part(part):
            yield p, [words[i] for i in at]

    def grams(self, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        keys, n = _merged(self.held)
        self.held = [(keys, n)]
        for p, at in _by_part(gram_part(keys, parts)):
            yield p, keys[at], n[at]


_TEXTS = "block long, kind int, part long, items long, keys binary, counts binary, ids array<{id}>, held array<boolean>"


def _blocks(id_type: pa.DataType, parts: int, block_bytes: int, piece_bytes: int):
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("items", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack, task = _Packer(), TaskContext.get().partitionId()
        serial, size, inside = 0, 0, _Contents()
        texts: list[bytes] = []
        ids: list = []
        held: list[bool] = []

        def rows(kind: int, data: list[tuple]) -> pa.RecordBatch:
            n = len(data)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, task << 24 | serial)), pa.array([kind] * n, pa.int32()), *(pa.array([d[i] for d in data], schema.types[i + 2]) for i in range(6))], schema=schema)

        def piece() -> Iterator[pa.RecordBatch]:
            if texts:
                inside.add(texts, [not h for h in held])
                yield rows(-1, [(None, len(texts), pack.texts(texts), None, list(ids), list(held))])
                texts.clear(), ids.clear(), held.clear()

        def requests() -> Iterator[pa.RecordBatch]:
            nonlocal inside
            if inside.counts:
                yield rows(WORDS, [(p, len(w), pack.words(w), pack.numbers(np.array([inside.counts[x] for x in w], "<i8")), None, None) for p, w in inside.words(parts)])
                yield rows(GRAMS, [(p, len(g), pack.numbers(np.diff(g, prepend=0)), pack.numbers(n), None, None) for p, g, n in inside.grams(parts)])
            inside = _Contents()

        waiting = 0
        for batch in batches:
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                t, _ = normalised(text.as_py())
                texts.append(t), ids.append(i), held.append(h)
                waiting += len(t)
                if waiting >= piece_bytes:
                    yield from piece()
                    size, waiting = size + waiting, 0
                    if size >= block_bytes:
                        yield from requests()
                        serial, size = serial + 1, 0
        yield from piece()
        yield from requests()

    return run


# ---- counts of words

def _word_counts(table: pa.Table) -> pa.Table:
    """Replies to one part's requests: each word's count over all blocks. stat: words that training holds."""
    pack = _Packer()
    total: dict[bytes, int] = {}
    asked = [pack.to_words(x.as_py()) for x in table.column("keys")]
    for words, n in zip(asked, table.column("counts"), strict=True):
        for w, m in zip(words, pack.to_numbers(n.as_py()).tolist(), strict=True):
            total[w] = total.get(w, 0) + m
    known = sum(n > 0 for n in total.values())
    data = [pack.numbers(np.array([total[w] for w in words], "<i8")) for words in asked]
    rows = len(data)
    return pa.table({"block": table.column("block"), "part": table.column("part"), "data": pa.array(data, pa.binary()), "known": pa.array([known] + [0] * (rows - 1), pa.int64()), "total": pa.array([sum(total.values())] + [0] * (rows - 1), pa.int64())})


# ---- the tree

def _gram_counts(table: pa.Table) -> pa.Table:
    pack = _Packer()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for k, n in zip(table.column("keys"), table.column("counts"), strict=True):
        held.append((np.cumsum(pack.to_numbers(k.as_py())), pack.to_numbers(n.as_py())))
        if sum(len(x) for x, _ in held) > 8_000_000:
            held = [_merged(held)]
    g, n = _merged(held)
    return pa.table({"g": pa.array(g), "n": pa.array(n)})


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0, by Stirling's series after eight steps up."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_LOG_PI = float(np.log(np.pi))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log Pe of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - _LOG_PI


def _mixed(log_pe: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(log_pe, below) + np.log(0.5)


def _levels(g: np.ndarray, n: np.ndarray, bit: int, top: int):
    """Nodes of one binary decision from depth DEPTH to `top`: (keys, a, b, log Pe, log Pw, index of each gram or node below)."""
    byte = g & 255
    node = (1 << bit) | (byte >> (8 - bit))
    one = (byte >> (7 - bit)) & 1
    keys, inv = np.unique(((g >> 8) << 8) | node, return_inverse=True)
    a = np.bincount(inv, n * (1 - one), len(keys))
    b = np.bincount(inv, n * one, len(keys))
    pe = log_kt(a, b)
    out = [(keys, a, b, pe, pe, inv)]
    for _ in range(DEPTH - 1, top - 1, -1):
        keys, a, b, _, pw, _ = out[-1]
        up, inv = np.unique(((keys >> 16) << 8) | (keys & 255), return_inverse=True)
        a, b, below = (np.bincount(inv, x, len(up)) for x in (a, b, pw))
        pe = log_kt(a, b)
        out.append((up, a, b, pe, _mixed(pe, below), inv))
    return one, out


def subtree_sums(g: np.ndarray, n: np.ndarray, top: int = 2) -> tuple[np.ndarray, ...]:
    """(key of depth `top`, node included; zeros; ones; log Pw) of all decisions."""
    got = [_levels(g, n, bit, top)[1][-1] for bit in range(8)]
    return tuple(np.concatenate([x[k] for x in got]) for k in (0, 1, 2, 4))


def log2_probabilities(g: np.ndarray, n: np.ndarray, upper: list[dict[str, np.ndarray]]) -> np.ndarray:
    """log2 P(byte | context) of each gram; upper[d]: tables of depth d < 2 by context and node."""
    total = np.zeros(len(g))
    for bit in range(8):
        one, levels = _levels(g, n, bit, len(upper))
        index, at = [], None
        for lv in levels:
            at = lv[5] if at is None else lv[5][at]
            index.append(at)
        p, seen = None, None
        for (keys, a, b, pe, pw, _), at in zip(levels, index, strict=True):
            a_, b_ = a[at], b[at]
            kt = (np.where(one == 1, b_, a_) + 0.5) / (a_ + b_ + 1.0)
            w = np.exp(np.minimum(pe - pw + np.log(0.5), 0.0))[at]
            p = kt if p is None else np.where(seen, w * kt + (1 - w) * p, kt)
            seen = a_ + b_ > 0
        node = (1 << bit) | ((g & 255) >> (8 - bit))
        for d in range(len(upper) - 1, -1, -1):
            t = upper[d]
            k = ((g >> np.int64(8 * (DEPTH - d + 1))) << 8 | node) if d else node
            a_, b_ = t["a"][k], t["b"][k]
            kt = (np.where(one == 1, b_, a_) + 0.5) / (a_ + b_ + 1.0)
            p = np.where(seen, t["w"][k] * kt + (1 - t["w"][k]) * p, kt)
            seen = a_ + b_ > 0
        total += np.log2(p)
    return total


def _runs(batches: Iterator[pa.RecordBatch], most: int = 1_500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by gram, in arrays that hold whole subtrees below two context bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        size += batch.num_rows
        if size < most:
            continue
        g, n = (np.concatenate(x) for x in zip(*held, strict=True))
        top = g >> (8 * (DEPTH - 1))
        last = np.searchsorted(top, top[-1])
        if last:
            yield g[:last], n[:last]
        held, size = [(g[last:], n[last:])], len(g) - last
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g, n in _runs(batches):
        k, a, b, pw = subtree_sums(g, n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(pw)], ["k", "a", "b", "pw"])


def upper_levels(rows: list[tuple[int, float, float, float]]) -> list[dict[str, np.ndarray]]:
    """Tables of depth 0 and 1 from rows (key of depth 1, zeros, ones, sum of log Pw below)."""
    a, b, below = (np.zeros(1 << 16) for _ in range(3))
    for k, x, y, s in rows:
        a[k], b[k], below[k] = x, y, s
    one = _table(a, b, below)
    parts = [x.reshape(256, 256).sum(axis=0) for x in (a, b, one["pw"])]
    return [_table(*parts), one]


def _table(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> dict[str, np.ndarray]:
    pe = log_kt(a, b)
    pw = _mixed(pe, below)
    return {"a": a, "b": b, "pw": pw, "w": np.exp(np.minimum(pe - pw + np.log(0.5), 0.0))}


def tree(grams: DataFrame, parts: int = 1) -> DataFrame:
    """(g, lp, part): log2 probability of every context-and-byte of `grams` (g, n)."""
    pair = F.shiftright("g", 8 * (DEPTH - 1))
    dealt = grams.withColumn("pair", pair).repartition("pair").sortWithinPartitions("g").select("g", "n")
    sums = dealt.mapInArrow(_sums, "k long, a long, b long, pw double")
    # depth 2 to depth 1: at most 256 x 255 rows, whatever the corpus
    first = sums.groupBy((F.shiftright("k", 16) * 256 + F.col("k").bitwiseAND(F.lit(255))).alias("k")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("pw"))
    upper = grams.sparkSession.sparkContext.broadcast(upper_levels([tuple(r) for r in first.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n in _runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(log2_probabilities(g, n, upper.value)), pa.array(gram_part(g, parts))], ["g", "lp", "part"])

    return dealt.mapInArrow(run, "g long, lp double, part long")


def _gram_replies(left: pa.Table, right: pa.Table) -> pa.Table:
    """Replies to one part's requests (left) from the tree's rows (right)."""
    pack = _Packer()
    keys, lp = right.column("g").to_numpy(), right.column("lp").to_numpy()
    order = np.argsort(keys)
    keys, lp = keys[order], lp[order]
    data = [pack.numbers(lp[np.searchsorted(keys, np.cumsum(pack.to_numbers(k.as_py())))]) for k in left.column("keys")]
    return pa.table({"block": left.column("block"), "kind": pa.array([GRAMS] * len(data), pa.int32()), "part": left.column("part"), "data": pa.array(data, pa.binary())})


# ---- scores

def _scores(id_type: pa.DataType, parts: int, total: int, distinct: int):
    low = total + 0.1 * (distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pack = _Packer()
        inside = _Contents()
        for data in left.column("keys"):
            texts = pack.to_texts(data.as_py())
            inside.add(texts, [True] * len(texts))
        replies = {(k, p): d for k, p, d in zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("data"), strict=True)}
        log: dict[bytes, float] = {}
        for p, words in inside.words(parts):
            c = pack.to_numbers(replies[WORDS, p].as_py())
            log.update(zip(words, np.log10((c + 0.1) / low).tolist(), strict=True))
        unknown = float(np.log10(0.1 / low))
        keys, lps = [], []
        for p, g, _ in inside.grams(parts):
            keys.append(g)
            lps.append(pack.to_numbers(replies[GRAMS, p].as_py(), "<f8"))
        keys, lps = pa.array(np.concatenate(keys)), np.concatenate(lps) * np.log10(2.0)
        inside, replies = None, None
        out: tuple[list, ...] = ([], [], [], [], [], [])
        waiting: list[bytes] = []

        def scored() -> None:
            score = np.zeros(len(waiting))
            for g, begin, first in grams_of(waiting, 3 * WINDOW):
                # a hash lookup in the block's distinct grams
                lp = lps[pc.index_in(pa.array(g), value_set=keys).to_numpy()]
                score[first : first + len(begin)] += np.add.reduceat(lp, begin)
            out[5].extend(np.round(score, 9).tolist())
            waiting.clear()

        size = 0
        for ids, held, data in zip(left.column("ids"), left.column("held"), left.column("keys"), strict=True):
            texts = pack.to_texts(data.as_py())
            out[0].extend(ids.as_py())
            out[1].extend(held.as_py())
            for t in texts:
                words = t[:-1].split()
                words.append(b"")
                base = np.fromiter(map(log.__getitem__, words), np.float64, len(words))
                out[2].append(len(words))
                out[3].append(len(words) - int(np.count_nonzero(base == unknown)))
                out[4].append(round(float(base.sum()), 9))
            waiting += texts
            size += sum(map(len, texts))
            if size >= 3 * WINDOW:
                scored()
                size = 0
        if waiting:
            scored()
        return pa.table({
            "doc_id": pa.array(out[0], id_type), "held_out": pa.array(out[1], pa.bool_()), "n_tokens": pa.array(out[2], pa.int64()),
            "n_known": pa.array(out[3], pa.int64()), "train_tokens": pa.array(np.full(len(out[0]), total, np.int64)),
            "base_score": pa.array(out[4], pa.float64()), "score": pa.array(out[5], pa.float64()),
        })

    return run


def score(docs: DataFrame, held_out, *, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Train on rows that are not held out, score every whole text."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(max(8, -(-size // part_bytes)), 1 << 16)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_blocks(id_type, parts, block_bytes, piece_bytes), _TEXTS.format(id=kind.simpleString()))
    rows = materialise(rows, "ctw-blocks", compression="zstd")
    asked = rows.where(F.col("kind") >= 0).select("block", "kind", "part", "keys", "counts")
    counts = asked.where(F.col("kind") == WORDS).groupBy("part").applyInArrow(_word_counts, "block long, part long, data binary, known long, total long")
    counts = materialise(counts, "ctw-words")
    distinct, total = counts.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    of_grams = asked.where(F.col("kind") == GRAMS)
    grams = materialise(of_grams.groupBy("part").applyInArrow(_gram_counts, "g long, n long"), "ctw-grams")
    replies = of_grams.select("block", "part", "keys").groupBy("part").cogroup(tree(grams, parts).groupBy("part")).applyInArrow(_gram_replies, "block long, kind int, part long, data binary")
    replies = replies.unionByName(counts.select("block", F.lit(WORDS).alias("kind"), "part", "data"))
    texts = rows.where(F.col("kind") < 0).select("block", "ids", "held", "keys")
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scores(id_type, parts, total, distinct), schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's rows: a tenth of the documents, by id, is held out of training."""
    return score(docs, crc_part(F.col("doc_id"), 10) == 0)
