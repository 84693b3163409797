"""Hard negatives by a vector-approximation file.

Vectors are quantised to integers. Each dimension is cut into at most `cells` cells, and a vector's
approximation is the cells of its components, one byte each. Marks between cells are evenly
spaced between the ends of a bounded sample; the outer cells reach to the least and the largest
value of all rows, so every cell's ends are known. For an anchor, one table each gives every cell's
least and largest product with the anchor's component; summed by lookup over a vector's cells they bound
its score from below and above.

First pass: in the approximations of the anchor's label, the k-th largest lower bound is a score that
k rows reach; only rows whose upper bound reaches it are scored exactly, and are its candidates for
positives. Second pass: rows of other labels whose bounds meet a positive's window are its
candidates; k of them that lie surely inside it set a lower bound in the same way, and only what may
pass it is scored. Each pass returns at most k rows an anchor (or a positive) and task; a window picks the first k of all.

Anchors and rows meet as a grid of groups: each task holds at most about `span` rows and `queries`
anchors, whatever the table's size. Rows are dealt by a hash of runs of ids, so no label or copied vector
makes a large group. The approximation file is a table in the shared folder, next to the
exact vectors, which are only read at the places that the bounds leave.

Defined results for odd rows: rows with a null id or label, a null vector, or a null, NaN or infinite
component take no part; shorter vectors, also empty ones, count as padded with zeros; rows of one vec_id
are never each other's candidates and make one anchor (of the least vector, then label); as candidates each row
counts; scores are exact integers, and one beyond 64 bits counts as the nearest 64-bit integer; other
columns are ignored; a positive with a negative score has an empty window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm._shared import materialise
from gridloom.llm.topk_search import _chunk, _exact, _held, _matrix, _width

#: Ids dealt out together, rows and anchors of one task, anchors bounded at once, cells of a dimension, and the rows that marks are taken from.
RANGE, SPAN, QUERIES, AT_ONCE, CELLS, SAMPLE = 512, 16384, 2048, 32, 64, 1024


def marks(sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each dimension the inner marks and every cell's least and largest integer.

    `low` and `high` are the ends over all rows. A cell j holds values above mark j - 1 and up to mark j.
    """
    inner = np.empty((len(low), cells - 1), object)
    for d in range(len(low)):
        a, b = (int(min(sample[:, d])), int(max(sample[:, d]))) if len(sample) else (int(low[d]), int(high[d]))
        inner[d] = [a + (b - a) * (j + 1) // cells for j in range(cells - 1)]
    least = np.concatenate([low[:, None], inner + 1], axis=1)
    most = np.concatenate([inner, high[:, None]], axis=1)
    return inner, np.maximum(least, low[:, None]), np.minimum(most, high[:, None])


def approximate(c: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The cell of every component, a byte each."""
    out = np.zeros(c.shape, np.uint8)
    for d in range(c.shape[1]):
        out[:, d] = np.searchsorted(np.asarray(inner[d], c.dtype), c[:, d], side="left")
    return out


def bounds(q: np.ndarray, cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, (rows, anchors), by lookup in a table for each dimension."""
    low, high = np.zeros((len(cells), len(q)), q.dtype), np.zeros((len(cells), len(q)), q.dtype)
    for d in range(q.shape[1]):
        a, b = least[d][:, None] * q[:, d][None, :], most[d][:, None] * q[:, d][None, :]
        low += np.minimum(a, b)[cells[:, d]]
        high += np.maximum(a, b)[cells[:, d]]
    return _held(low), _held(high)


def _kth(values: np.ndarray, k: int):
    """The k-th largest, or None if there are fewer."""
    if len(values) < k:
        return None
    return np.partition(values, len(values) - k)[len(values) - k] if values.dtype != object else sorted(values)[-k]


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score descending, id ascending."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores))[:k]
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


class Block:
    """The rows of one task in order of label: approximations to look up, exact vectors to score what is left."""

    def __init__(self, ids, labels, cells, vectors):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.cells, self.vectors = ids[order], labels[order], cells[order], vectors[order]
        self.scored = self.asked = 0

    def of(self, label) -> slice:
        return slice(np.searchsorted(self.labels, label, "left"), np.searchsorted(self.labels, label, "right"))

    def score(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        return _held(self.vectors[rows] @ q)

    def positives(self, q_ids, q_labels, q, least, most, k):
        """(anchor's place, id, score): the k best rows of each anchor's label that are here."""
        out = []
        for label in np.unique(q_labels):
            own = self.of(label)
            if own.start == own.stop:
                continue
            places = np.flatnonzero(q_labels == label)
            for lo in range(0, len(places), AT_ONCE):
                some = places[lo : lo + AT_ONCE]
                low, high = bounds(q[some], self.cells[own], least, most)
                for j, a in enumerate(some):
                    other = self.ids[own] != q_ids[a]
                    self.asked += int(other.sum())
                    bar = _kth(low[other, j], k)
                    rows = own.start + np.flatnonzero(other & (high[:, j] >= bar) if bar is not None else other)
                    s = self.score(rows, q[a])
                    best = _first(self.ids[rows], s, k)
                    out += zip([a] * len(best), self.ids[rows][best].tolist(), s[best].tolist(), strict=True)
        return out

    def negatives(self, q_labels, q, positive_scores, least, most, share, k):
        """(anchor's place, rank of the positive, id, score): the k best rows of other labels in each positive's window."""
        out = []
        part, whole = share
        for lo in range(0, len(q), AT_ONCE):
            low, high = bounds(q[lo : lo + AT_ONCE], self.cells, least, most)
            for j in range(low.shape[1]):
                a = lo + j
                own = self.of(q_labels[a])
                other = np.ones(len(self.ids), bool)
                other[own] = False
                for rank, p in enumerate(positive_scores[a]):
                    self.asked += len(other) - (own.stop - own.start)
                    floor = -(-part * p // whole)  # the least score in the window
                    may = other & (high[:, j] >= floor) & (low[:, j] <= p)
                    bar = _kth(low[may & (low[:, j] >= floor) & (high[:, j] <= p), j], k)
                    rows = np.flatnonzero(may & (high[:, j] >= bar) if bar is not None else may)
                    s = self.score(rows, q[a])
                    within = np.flatnonzero((s >= floor) & (s <= p))
                    best = within[_first(self.ids[rows[within]], s[within], k)]
                    out += zip([a] * len(best), [rank + 1] * len(best), self.ids[rows[best]].tolist(), s[best].tolist(), strict=True)
        return out


def _tables(q, vectors, least, most):
    """All as floats where every bound and score is exact, else as Python integers."""
    top = max([1, *(abs(int(x)) for x in (*least.ravel(), *most.ravel()))])
    q, vectors = _exact(q, vectors)
    if q.dtype != object and top * max(float(np.abs(q).max(initial=0)), 1) * max(q.shape[1], 1) < 2**52:
        return q, vectors, least.astype(float), most.astype(float)
    whole = np.vectorize(int, otypes=[object])
    return *(whole(x) if x.size else x.astype(object) for x in (q, vectors)), least, most


def _loaded(left: pa.Table, right: pa.Table, ends) -> tuple:
    least, most = ends
    left, right = left.combine_chunks(), right.sort_by("vec_id").combine_chunks()
    width = max(len(least), _width(_chunk(left, "v"), _chunk(right, "v")))
    cells = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(left.num_rows, -1)
    q, vectors, least, most = _tables(_matrix(_chunk(right, "v"), width), _matrix(_chunk(left, "v"), width), least, most)
    block = Block(left.column("vec_id").to_numpy(), left.column("label").to_numpy(), cells, vectors)
    return block, right.column("vec_id").to_numpy(), right.column("label").to_numpy(), q, least, most


def _approximated(inner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _matrix(batch.column(2), len(inner))
            a = approximate(c, inner)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in a], pa.binary())], ["vec_id", "label", "v", "cells"])

    return run


def _positives(ends, k):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if left.num_rows and right.num_rows:
            block, ids, labels, q, least, most = _loaded(left, right, ends)
            got = [(int(ids[a]), i, int(s)) for a, i, s in block.positives(ids, labels, q, least, most, k)]
        return pa.table({"anchor_id": pa.array([x[0] for x in got], pa.int64()), "positive_id": pa.array([x[1] for x in got], pa.int64()), "score": pa.array([x[2] for x in got], pa.int64())})

    return run


def _negatives(ends, share, k):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if left.num_rows and right.num_rows:
            block, ids, labels, q, least, most = _loaded(left, right, ends)
            scores = right.sort_by("vec_id").column("scores").to_pylist()
            got = [(int(ids[a]), r, i, int(s)) for a, r, i, s in block.negatives(labels, q, scores, least, most, share, k)]
        cols = list(zip(*got, strict=True)) if got else [[], [], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor_id", "prank", "negative_id", "score"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    return run


def clean(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, v): the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def _ends(v: DataFrame, cells: int, sample: int):
    """Marks from a bounded sample, and each cell's ends; the outer ones from all rows."""
    widest = v.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    each = v.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    low, high = np.zeros(widest, object), np.zeros(widest, object)
    one = lambda x: int(_matrix(pa.array([[x]], pa.list_(pa.float64())), 1)[0, 0])
    for r in each.collect():  # a row a dimension
        low[r["d"]], high[r["d"]] = min(one(r["a"]), 0), max(one(r["b"]), 0)  # 0 for shorter vectors
    some = [r["v"] for r in v.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    return marks(_matrix(pa.array(some, pa.list_(pa.float64())), widest), low, high, cells)


def approximation_file(v: DataFrame, *, cells: int = CELLS, sample: int = SAMPLE) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The written table (vec_id, label, v, cells) and every cell's ends."""
    inner, least, most = _ends(v, cells, sample)
    table = v.mapInArrow(_approximated(inner), "vec_id long, label long, v array<double>, cells binary")
    return materialise(table, "va-file"), (least, most)


def mine(vectors: DataFrame, *, label: Column | None = None, every: int = 100, k: int = 5, n: int = 5, share: tuple[int, int] = (80, 100), cells: int = CELLS, span: int = SPAN, queries: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by `every`; k positives each, n negatives a positive, whose score is
    at least share[0] / share[1] of the positive's and no more than it.
    """
    v = clean(vectors, F.col("label") if label is None else label)
    file, ends = approximation_file(v, cells=cells, sample=sample)
    rows, n_q = file.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    groups, q_groups = max(1, -(-rows // span)), max(1, -(-n_q // queries))
    deal = F.pmod(F.xxhash64(F.floor(F.col("vec_id") / RANGE)), F.lit(groups)).cast("int")
    c = file.withColumn("g", deal).withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))))
    anchors = file.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.label", "r.v")
    anchors = materialise(anchors, "anchors")
    spread = lambda q: q.withColumn("qg", F.pmod(F.xxhash64("vec_id"), F.lit(q_groups)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    got = c.groupBy("g", "qg").cogroup(spread(anchors).groupBy("g", "qg")).applyInArrow(_positives(ends, k), "anchor_id long, positive_id long, score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    positives = materialise(got.withColumn("prank", F.row_number().over(best)).where(F.col("prank") <= k).withColumnRenamed("score", "positive_score"), "positives")
    ordered = F.array_sort(F.collect_list(F.struct("prank", "positive_score")))  # k at most
    scores = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(ordered, lambda x: x["positive_score"]).alias("scores"))
    asked = spread(materialise(anchors.join(scores, "vec_id"), "asked"))
    got = c.groupBy("g", "qg").cogroup(asked.groupBy("g", "qg")).applyInArrow(_negatives(ends, share, n), "anchor_id long, prank int, negative_id long, score long")
    first = Window.partitionBy("anchor_id", "prank").orderBy(F.desc("score"), "negative_id")
    got = got.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).withColumnRenamed("score", "negative_score")
    return got.join(positives, ["anchor_id", "prank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(vectors: DataFrame) -> DataFrame:
    """`mine` with every seventh id's label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, label=moved)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
    coalesce(list_sum([a.q[i] * b.q[i] FOR i IN range(1, least(len(a.q), len(b.q)) + 1)]), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5
"""
