"""SimHash fingerprints and their near-duplicate components by a binary trie self-join.

Equal fingerprints are one node. Fingerprints are seen under five rotations; two that differ in
at most four bits agree on the whole leading field of one of them, so a shuffle by that field
brings them together: those are the trie's upper levels, where no error is spent. Below, each
field's trie is joined with itself: pairs of nodes go down together, one level at a time,
adding up the bits in which they differ, and a pair goes no further once it has spent over
the budget. Nodes are ranges of the sorted fingerprints, so a whole level is a few array
operations. A field with over `hot` fingerprints is split by its next six trie levels: pairs of
subtrees that are still within the budget become groups of their own, and those that are still
too large are split again, down to the leaves. So no task holds a crowded field whole.

A task returns a spanning forest of its links, not the links, so groups of copies stay
linear. Components come from alternating large-star and small-star rounds, each written to
the shared folder.

Defined results for odd rows: null and wordless texts have fingerprint zero and are linked
like any other; repeated rows share a component; a component's id is the least doc_id in
it (nulls have none); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import materialise, row_of, text_key

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Leading field of each rotation: first bit (from the top) and width.
FIELDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Node pairs of at most so many leaf pairs are compared outright.
LEAVES = 64
#: Rows that a task gathers before it runs, rows from which a group is split, and bits of one split.
GATHER, HOT, SPLIT = 100_000, 100_000, 6

Link = Callable[[np.ndarray | None, np.ndarray, np.ndarray], np.ndarray]


def fingerprint(text: str) -> int:
    """64 majority bits over the XXH64 values of the text's word shingles, repeats included."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, n)
    hash64 = xxhash.xxh64_intdigest
    return majority(np.array([hash64(joined[i:j], SEED) for i, j in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set where it is in over half the hashes (uint64)."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        h = np.ascontiguousarray(hashes[i : i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py() or "") for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "text_hash", "fp"])


def roots(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least index of each node's component under links (i, j), on top of `label`."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def trie_links(x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], budget: int = BUDGET, width: int = 64, link: Link | None = None) -> np.ndarray:
    """Component roots of sorted values `x` (uint64) whose tries, ranges [a, b) and [c, d), are joined.

    Values differ only below bit `width`. Pairs with equal ranges are self-joins. `link`, if given,
    takes the roots so far (none: None) and the pairs within the budget, and returns the roots after them.
    """
    n = len(x)
    label = link(None, np.zeros(0, np.int64), np.zeros(0, np.int64)) if link else np.arange(n)
    sums: dict[int, np.ndarray] = {}

    def ones(bit: int) -> np.ndarray:
        if bit not in sums:
            sums[bit] = np.concatenate([[0], np.cumsum((x >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        return sums[bit]

    a, b, c, d = pairs
    step = 20_000  # node pairs go down in parts, so that memory stays bounded
    stack = [(width - 1, *(y[f : f + step] for y in (a, b, c, d)), np.zeros(len(a[f : f + step]), np.int8)) for f in range(0, len(a), step)]
    while stack:
        bit, a, b, c, d, err = stack.pop()
        small = ((b - a) * (d - c) <= LEAVES) | (bit < 0)
        if small.any():
            sa, sc, nc = a[small], c[small], (d - c)[small]
            many = ((b - a)[small]) * nc
            at = np.repeat(np.arange(len(sa)), many)
            k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            i, j = sa[at] + k // nc[at], sc[at] + k % nc[at]
            near = (np.bitwise_count(x[i] ^ x[j]) <= budget) & (i != j)
            label = link(label, i[near], j[near]) if link else roots(n, i[near], j[near], label)
        keep = ~small
        if not keep.any():
            continue
        a, b, c, d, err = a[keep], b[keep], c[keep], d[keep], err[keep]
        s = ones(bit)
        m, o = b - (s[b] - s[a]), d - (s[d] - s[c])  # where the ones begin
        own = (a == c) & (b == d)
        kids = [
            (a, m, c, o, err),
            (m, b, o, d, err),
            (a, m, o, d, err + 1),
            (m[~own], b[~own], c[~own], o[~own], err[~own] + 1),
        ]
        p, q, r, t, e = (np.concatenate([k[f] for k in kids]) for f in range(5))
        go = (e <= budget) & (p < q) & (r < t) & ~((p == r) & (q == t) & (q - p < 2))
        p, q, r, t, e = p[go], q[go], r[go], t[go], e[go].astype(np.int8)
        for f in range(0, len(p), step):
            stack.append((bit - 1, p[f : f + step], q[f : f + step], r[f : f + step], t[f : f + step], e[f : f + step]))
        if bit + 2 in sums and all(y[0] < bit + 2 for y in stack):
            del sums[bit + 2]
    return label


def _forest(keys: np.ndarray, fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, sub: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many groups at once. keys: group of each row; lo, hi: its pair of subtrees (-1: the whole trie)."""
    f = fps.view(np.uint64)
    left = np.uint64(64)
    x = np.where(turn == 0, f, (f << turn) | (f >> ((left - turn) % left)))
    order = np.lexsort((x, sub, keys))
    keys, x, f, lo, hi, sub = keys[order], x[order], f[order], lo[order], hi[order], sub[order]
    edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (sub[1:] != sub[:-1]), [True]]))
    a, b = edge[:-1], edge[1:]
    whole = lo[a] == hi[a]  # a trie with itself
    two = np.flatnonzero((keys[a][1:] == keys[a][:-1]) & ~whole[1:])
    pa_ = np.concatenate([a[whole], a[two]])
    pb = np.concatenate([b[whole], b[two]])
    pc = np.concatenate([a[whole], a[two + 1]])
    pd_ = np.concatenate([b[whole], b[two + 1]])
    big = (pb - pa_ > 1) | (pa_ != pc)
    label = trie_links(x, (pa_[big], pb[big], pc[big], pd_[big]))
    at = np.flatnonzero(label != np.arange(len(x)))
    return f[at].view(np.int64), f[label[at]].view(np.int64)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (g, lo, hi): (g, lo, hi, fp, turn, sub). Whole groups are run together."""

    def starts(rows: list[np.ndarray]) -> np.ndarray:
        new = np.ones(len(rows[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:3]])
        return new

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        _, lo, hi, fp, turn, sub = rows
        u, v = _forest(np.cumsum(starts(rows)), fp, lo, hi, sub, turn.astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    waiting: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        waiting.append([np.asarray(batch.column(i)) for i in range(6)])
        size += batch.num_rows
        if size < GATHER:
            continue
        held = [np.concatenate(c) for c in zip(*waiting, strict=True)]
        last = int(np.flatnonzero(starts(held))[-1])  # the last group may go on
        if last:
            yield out([c[:last] for c in held])
        waiting = [[c[last:] for c in held]]
        size = len(held[0]) - last
    if size:
        yield out([np.concatenate(c) for c in zip(*waiting, strict=True)])


def _split(rows: DataFrame, level: int) -> DataFrame:
    """Rows of crowded groups, dealt to pairs of the subtrees SPLIT bits further down that the budget still allows."""
    turned = F.expr("shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn)")
    width = F.when(F.col("turn") == FIELDS[-1][0], FIELDS[-1][1]).otherwise(FIELDS[0][1])
    rows = rows.withColumn("__x", turned).withColumn("__at", F.lit(64 - SPLIT * (level + 1)) - width)
    rows = rows.withColumn("__s", F.expr(f"shiftrightunsigned(__x, __at) & {(1 << SPLIT) - 1}L"))
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << SPLIT)])
    left = F.lit(BUDGET) - F.bit_count(F.col("lo").bitwiseXOR(F.col("hi")))
    rows = rows.withColumn("__m", F.explode(F.filter(masks, lambda m: F.bit_count(m) <= left)))
    mine, other = F.col("__s"), F.col("__s").bitwiseXOR(F.col("__m"))
    one, low = F.col("lo") == F.col("hi"), F.col("sub") == F.col("lo")
    below = lambda prefix, bits: F.shiftleft(prefix, SPLIT).bitwiseOR(bits)
    lo = below("lo", F.when(one, F.least(mine, other)).when(low, mine).otherwise(other))
    hi = below("hi", F.when(one, F.greatest(mine, other)).when(low, other).otherwise(mine))
    return rows.select("g", lo.alias("lo"), hi.alias("hi"), "fp", "turn", below("sub", mine).alias("sub"))


def links(nodes: DataFrame, *, hot: int = HOT) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within the budget. nodes: distinct fp."""
    fields = []
    for r, (first, width) in enumerate(FIELDS):
        key = F.shiftrightunsigned("fp", 64 - first - width).bitwiseAND(F.lit((1 << width) - 1))
        fields.append(F.struct((key + F.lit(r << 13)).cast("long").alias("g"), F.lit(first).alias("turn")))
    # a group is a pair of subtrees of one field; their paths begin with a 1, so that each length has its own numbers
    top = [F.lit(1).cast("long").alias(c) for c in ("lo", "hi", "sub")]
    group = ["g", "lo", "hi"]
    rows = nodes.select("fp", F.explode(F.array(*fields)).alias("x")).select("x.g", *top[:2], "fp", "x.turn", top[2])
    done = []
    for level in range((64 - FIELDS[0][1]) // SPLIT):
        sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), (F.min("sub") != F.max("sub")).alias("both")).where(F.col("n") > hot)
        sizes = materialise(sizes.withColumn("alive", F.col("both") | (F.col("lo") == F.col("hi"))), "crowded")
        if not sizes.limit(1).count():
            break
        done.append(rows.join(sizes, group, "left_anti"))
        # subtrees without a partner within the budget have no links here
        rows = materialise(_split(rows.join(sizes.where("alive"), group, "left_semi"), level), "split")
    for part in done:
        rows = rows.unionByName(part)
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_link, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component; only nodes with a link appear."""
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # large star: a node's larger neighbours are tied to the least one it knows
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's smaller neighbours, and itself, are tied to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, "edges")
        mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark(after) == mark(e):
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = after


def classes(docs: DataFrame, *, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash, fp, component_id of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_hash"))
    marked = materialise(hashed.mapInArrow(_fingerprints, f"doc_id {kind}, text_hash long, fp long"), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    found = components(links(nodes.select("fp"), hot=hot))
    tied = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = tied.join(ids, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's digest of `classes`."""
    return classes(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: that of its least doc_id."""
    return first_of_each(docs, classes(docs, **options))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each component of `found` (doc_id, text_hash, root): the row of its least
    doc_id, nulls last, and of texts that share the id the least hash. A row is told by id and
    text, so no row of another text goes with it; of rows alike in both, the least in the others' hash stays."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash", "n"), order).alias("f")).select("f.*")
    first = materialise(first, "first-of-each")
    keyed = docs.select(row_of(docs.columns).alias("r"), F.col("doc_id").alias("d"), text_key(F.col("text")).alias("t"))

    def met(some: DataFrame) -> DataFrame:
        return keyed.join(some, keyed["d"].eqNullSafe(some["doc_id"]) & (keyed["t"] == some["text_hash"]), "left_semi")

    kept = met(first.where("n = 1")).select("r.*")
    if not first.where("n > 1").limit(1).count():
        return kept
    least = F.min_by("r", F.xxhash64(*[F.col("r")[c] for c in docs.columns]))
    return kept.unionByName(met(first.where("n > 1")).groupBy("d", "t").agg(least.alias("r")).select("r.*"))
