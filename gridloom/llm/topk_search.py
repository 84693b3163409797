"""Exact top-k by inner product, with block-at-a-time pruning.

Vectors are quantised to integers; their components are the terms. Within a group candidates are
laid out so that like vectors lie together (by the nearest of some of them, then by how near) and
cut into blocks; each block keeps every component's largest and smallest value. For a query,
the sum over components of the larger possible product bounds all scores of a block. Blocks
are taken in order of their bounds and scored through their forward index (their rows of
components) until the next bound is below the k-th score so far. That score does not begin at
nothing: a first pass scores each query against a bounded sample of the candidates, and what is
k-th there is a lower bound anywhere.

Queries and candidates meet as a grid of groups: each task holds at most about
`span` candidates and `queries` queries, whatever the table's size, and returns k rows a query.

Defined results for odd rows: rows with a null id, a null vector, or a null, NaN or infinite
component take no part; a shorter vector, also an empty one, counts as padded with zeros; rows of one vec_id
are never each other's candidates and make one query (their least vector); scores are exact
integers, and one beyond 64 bits counts as the nearest 64-bit integer; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ids dealt out together, vectors in a block, the sizes of one task's groups, and the sample that first thresholds come from.
RANGE, BLOCK, SPAN, QUERIES, SAMPLE = 512, 16, 8192, 2048, 1024
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _whole(x: float) -> int:
    """floor(256 x), exact for every finite x."""
    return int(x) * 256 if abs(x) >= 2.0**52 else int(np.floor(256.0 * x))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integers floor(256 x): float64 where they are exact, else Python integers."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    big = np.abs(flat).max(initial=0) >= 2.0**44
    out = np.zeros((len(lengths), width), object if big else float)
    keep = np.arange(width)[None, :] < lengths[:, None]
    out[keep] = [_whole(x) for x in flat.tolist()] if big else np.floor(256.0 * flat)
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where all their products and sums are exact, else as Python integers."""
    if a.dtype != object and b.dtype != object:
        top = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(a.shape[1], 1)
        if top < 2**52:
            return a, b
    whole = np.vectorize(int, otypes=[object])
    return tuple(whole(x) if x.size else x.astype(object) for x in (a, b))


def _held(s: np.ndarray) -> np.ndarray:
    """Scores, those beyond 64 bits as the nearest 64-bit integer."""
    return s if s.dtype != object else np.minimum(np.maximum(s, LOW), HIGH)


def like_order(c: np.ndarray) -> np.ndarray:
    """An order in which like vectors lie together: by the nearest of some of them, then by how near."""
    if len(c) <= 2 * BLOCK:
        return np.arange(len(c))
    x = np.array([[float(min(max(v, -(10**300)), 10**300)) for v in r] for r in c]) if c.dtype == object else c
    x = x / max(np.abs(x).max(initial=0), 1e-300)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    some = x[:: max(1, len(x) // max(2, int(np.sqrt(len(x) / 2))))]
    near = x @ some.T
    cell = np.argmax(near, axis=1)
    return np.lexsort((-near[np.arange(len(x)), cell], cell))


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """(query, id, score) rows: the k best of candidates `c` for each query, but for some that are
    below `floor`; and how many of the pairs of a query and a block were scored."""
    q, c = _exact(q, c)
    if not len(q_ids) or not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object), (0, 0)
    order = like_order(c)
    ids, c = ids[order], c[order]
    starts = np.arange(0, len(ids), block)
    top, low = np.maximum.reduceat(c, starts), np.minimum.reduceat(c, starts)
    bound = _held(np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T)
    order = np.argsort(-bound, axis=1, kind="stable")
    rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, c.dtype)
    kth = np.full(len(q), LOW, dtype=c.dtype) if floor is None else floor.astype(c.dtype)
    live, scored = np.arange(len(q)), 0
    for turn in range(len(starts)):
        at = order[live, turn]
        live = live[bound[live, at] >= kth[live]]  # an equal score may win by its id
        if not len(live):
            break
        scored += len(live)
        at = order[live, turn]
        new = [[rows[0]], [rows[1]], [rows[2]]]
        for b in np.unique(at):
            mine = live[at == b]
            lo, hi = starts[b], min(starts[b] + block, len(ids))
            s = _held(q[mine] @ c[lo:hi].T)
            hit = (s >= kth[mine][:, None]) & (q_ids[mine][:, None] != ids[None, lo:hi])
            r, j = np.nonzero(hit)
            new[0].append(mine[r])
            new[1].append(ids[lo:hi][j])
            new[2].append(s[r, j])
        rows = tuple(np.concatenate(x) for x in new)
        o = np.lexsort((rows[1], -rows[2], rows[0])) if c.dtype != object else np.array(sorted(range(len(rows[0])), key=lambda i: (rows[0][i], -rows[2][i], rows[1][i])), dtype=np.int64)
        r = rows[0][o]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        o, place, r = o[place < k], place[place < k], r[place < k]
        rows = tuple(x[o] for x in rows)
        last = place == k - 1
        kth[r[last]] = np.maximum(kth[r[last]], rows[2][last])
    return q_ids[rows[0]], rows[1], rows[2], (scored, len(q) * len(starts))


def _width(*columns: pa.Array) -> int:
    return max([0, *(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in columns)])


def _chunk(table: pa.Table, name: str) -> pa.Array:
    x = table.column(name).combine_chunks()
    return x.chunk(0) if isinstance(x, pa.ChunkedArray) else x


def _group(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("vec_id").combine_chunks()
        c_col, q_col = _chunk(left, "v"), _chunk(right, "v")
        width = _width(c_col, q_col)
        floor = np.array(right.column("floor").to_pylist(), dtype=object)
        got = search_block(right.column("vec_id").to_numpy(), _matrix(q_col, width), left.column("vec_id").to_numpy(), _matrix(c_col, width), k, floor=floor)
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array([int(x) for x in got[2]], pa.int64())})

    return run


def _floors(sample, k: int):
    """Adds each query's k-th score over the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sample.value
        some = pa.array(vectors, pa.list_(pa.float64()))
        for batch in batches:
            width = _width(some, batch.column(1))
            q, c = _exact(_matrix(batch.column(1), width), _matrix(some, width))
            s = _held(q @ c.T) if len(ids) else np.zeros((len(q), 0))
            out = []
            for mine, row in zip(batch.column(0).to_pylist(), s, strict=True):
                best = sorted((int(x) for x in row[ids != mine]), reverse=True)
                out.append(best[k - 1] if len(best) >= k else LOW)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["vec_id", "v", "floor"])

    return run


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, span: int = SPAN, queries: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for every row whose id is divisible by `every`."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    n, n_q = v.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    groups, q_groups = max(1, -(-n // span)), max(1, -(-n_q // queries))
    # a bounded sample: it sets only where the search begins
    some = [(r["vec_id"], list(r["v"])) for r in v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    shared = v.sparkSession.sparkContext.broadcast((np.array([i for i, _ in some], np.int64), [x for _, x in some]))
    deal = F.pmod(F.xxhash64(F.floor(F.col("vec_id") / RANGE)), F.lit(groups)).cast("int")
    c = v.withColumn("g", deal).withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))))
    q = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(_floors(shared, k), "vec_id long, v array<double>, floor long")
    q = q.withColumn("qg", F.pmod(F.xxhash64("vec_id"), F.lit(q_groups)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    got = c.groupBy("g", "qg").cogroup(q.groupBy("g", "qg")).applyInArrow(_group(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    coalesce(list_sum([a.q[i] * b.q[i] FOR i IN range(1, least(len(a.q), len(b.q)) + 1)]), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
