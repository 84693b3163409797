"""Near copies by similarity: Jaccard of at least 0.8 over sets of five-word shingles.

Texts with the same lower-case words (by a 64-bit hash) are one node. Its SimHash fingerprint is
the majority of its shingles' hashes, and `simhash_dedup` joins the fingerprints' tries: nodes
whose fingerprints link at four bits are one group. Texts of similarity 0.8 lie further apart,
about 9.7 bits on average, so nodes that share a band of their MinHash sketch are groups too: with
24 bands of 5 values a pair of similarity 0.8 shares none with probability (1 - 0.8^5)^24 = 7e-5.
Groups with the same members are one.

In each group the tries of the fingerprints are joined at 28 bits, and the pairs that come
out are compared exactly, on their shingles' 64-bit hashes, where no link has joined them yet (a
pair of similarity 0.8 lies further apart with probability 1e-8; of five shingles and four of
them, the worst case, 1e-6). A pair is dropped before that if the sizes of its sets, or the parities of their hashes, already
differ by more than similar sets can: differing parity bits never outnumber differing shingles,
so this filter is exact. A task returns a spanning forest of each group, not the links, so rows
stay linear in groups of copies.

A group of over `hot` nodes is dealt into parts. Each part is joined with itself; then the nodes
that are not in the group's largest component so far meet all its parts. So no similar pair that
shares a group and lies within 28 bits is lost.

Defined results for odd rows: a text under five words is one shingle; null and wordless texts
are copies of each other; repeated rows share a component; a component's id is the least doc_id
in it; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import simhash_dedup
from gridloom.llm._shared import materialise, text_key
from gridloom.llm.simhash_dedup import components, first_of_each, majority, roots, trie_links

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 5
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64)
_MIX[0] |= np.uint64(1)
#: Shingles that are hashed at once, so that long texts do not need much memory.
PART = 2048
#: Differing bits of two fingerprints of a group up to which their texts are compared.
BUDGET = 28
#: Rows that a task runs at once, and nodes from which a group is dealt into parts.
GATHER, HOT = 2_000, 2_000


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    k = min(size, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def node_key(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(words)), np.uint64)


def parity(h: np.ndarray) -> np.ndarray:
    """256 bits (four int64): whether an odd number of the hashes begin with each byte."""
    odd = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands(h: np.ndarray) -> np.ndarray:
    """One bucket number (int64) for each band."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(h), PART):
        x = h[i : i + PART, None] * _MIX[0] + _MIX[1]
        x ^= x >> np.uint64(32)
        low = np.minimum(low, x.min(axis=0))
    raw = low.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(raw)], np.uint64).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, fp, at = [], [], []
        for t in batch.column(1):
            words = words_of(t.as_py())
            h = hashes(words)
            node.append(node_key(words))
            fp.append(majority(h))
            at.append(bands(h))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.int64()), _signed(fp), _lists(at)], ["doc_id", "text_hash", "node", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [hashes(words_of(t.as_py())) for t in batch.column(1)]
        columns = [_signed([majority(h) for h in made]), _lists([parity(h) for h in made]), _lists([h.view(np.int64) for h in made])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["node", "fp", "parity", "hashes"])


def _comparison(sets: pa.ListArray, odd: np.ndarray, first: np.ndarray) -> simhash_dedup.Link:
    """A `link` for trie_links: joins similar sets whose roots still differ. first: the roots before."""
    at = np.asarray(sets.offsets)
    ids = np.unique(np.asarray(sets.values)[at[0] : at[-1]], return_inverse=True)[1]
    at = at - at[0]
    size, mark = np.diff(at), np.zeros(len(ids), bool)

    def link(label: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        label = first.copy() if label is None else label
        for f in range(0, len(i), 1 << 16):
            a, b = i[f : f + (1 << 16)], j[f : f + (1 << 16)]
            open_ = label[a] != label[b]
            a, b = np.divmod(np.unique(np.minimum(a, b)[open_] * len(label) + np.maximum(a, b)[open_]), len(label))
            # sets of that similarity differ in at most so many shingles
            most = (size[a] + size[b]) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
            able = (np.abs(size[a] - size[b]) <= most) & (np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1) <= most)
            a, b = a[able], b[able]
            edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else []
            for k, end in zip(edge[:-1], edge[1:], strict=True):
                one, others = a[k], b[k:end]
                others = others[label[others] != label[one]]
                if not len(others):
                    continue
                mine = ids[at[one] : at[one + 1]]
                mark[mine] = True
                many = size[others]
                begin = np.cumsum(many) - many
                both = np.add.reduceat(mark[ids[np.repeat(at[others] - begin, many) + np.arange(many.sum())]], begin, dtype=np.int64)
                mark[mine] = False
                alike = others[both >= SIMILARITY * (size[one] + many - both)]
                label = roots(len(label), np.full(len(alike), one), alike, label)
        return label

    return link


def _forest(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Spanning links of many groups at once: rows of whole groups (g, lo, hi, sub, node, root, fp, parity, hashes)."""
    g, lo, hi, sub, _, root, fp = (np.asarray(rows.column(k)) for k in range(7))
    keys = np.cumsum(_starts(rows))
    x = fp.view(np.uint64)
    order = np.lexsort((x, sub, keys))
    rows = rows.take(pa.array(order))
    keys, x, sub, whole, root, node = keys[order], x[order], sub[order], (lo == hi)[order], root[order], np.asarray(rows.column(4))
    odd = np.asarray(rows.column(7).flatten()).view(np.uint64).reshape(-1, 4)  # bits of signed numbers are not counted
    # what is known to be in one component begins as one
    by = np.lexsort((root, keys))
    new = np.concatenate([[True], (keys[by][1:] != keys[by][:-1]) | (root[by][1:] != root[by][:-1])])
    first = np.empty(len(x), np.int64)
    first[by] = np.minimum.reduceat(by, np.flatnonzero(new))[np.cumsum(new) - 1]
    edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (sub[1:] != sub[:-1]), [True]]))
    a, b = edge[:-1], edge[1:]
    own = np.flatnonzero(whole[a] & (b - a > 1))  # a trie with itself
    two = np.flatnonzero((keys[a][1:] == keys[a][:-1]) & ~whole[a][1:])
    left, right = np.concatenate([own, two]), np.concatenate([own, two + 1])
    label = trie_links(x, (a[left], b[left], a[right], b[right]), BUDGET, link=_comparison(rows.column(8), odd, first))
    at = np.flatnonzero((label != first) & (first == np.arange(len(x))))
    return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["u", "v"])


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (np.asarray(rows.column(k)) for k in range(3))])
    return new


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (g, lo, hi), as in `_forest`. Whole groups are run together."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        begin, starts = 0, np.flatnonzero(_starts(held))
        while len(starts := starts[starts > begin]):  # the last group may go on
            end = int(max(starts[0], starts[starts <= begin + GATHER].max(initial=0)))
            yield _forest(held.slice(begin, end - begin))
            begin = end
        held = held.slice(begin)
    if held is not None and held.num_rows:
        yield _forest(held)


def groups(nodes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(g, node, n): the groups of at least two nodes by bands, and by `more` (node, g); one of those with the same members."""
    at = nodes.select("node", F.explode("bands").alias("g"))
    at = at.unionByName(more) if more else at
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    of = at.groupBy("g").agg(*same).where("n > 1").groupBy("n", "x", "y").agg(F.min("g").alias("g"))
    return at.join(of, "g").select("g", "node", "n")


def sets_of(some: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, fp, parity, hashes) of the nodes in `some`."""
    wanted = nodes.join(some, "node", "left_semi").select(F.col("one.doc_id").alias("w"), F.col("one.text_hash").alias("h"), "node")
    keyed = docs.select(F.col("doc_id").alias("d"), text_key(F.col("text")).alias("t"), "text")
    texts = keyed.join(wanted, F.col("d").eqNullSafe(F.col("w")) & (F.col("t") == F.col("h"))).groupBy("node").agg(F.first("text").alias("text"))
    return materialise(texts.mapInArrow(_sets, "node long, fp long, parity array<long>, hashes array<long>"), "near-sets")


def forest(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Spanning links of the groups (g, lo, hi, sub, node, root): lo = hi, all with all, else those of sub 0 with those of sub 1."""
    group = ["g", "lo", "hi"]
    whole = rows.join(sets, "node").select(*group, "sub", "node", "root", "fp", "parity", "hashes")
    return materialise(whole.repartition(*group).sortWithinPartitions(*group).mapInArrow(_link, "u long, v long").where("u <> v"), "near-links")


def links(nodes: DataFrame, docs: DataFrame, more: DataFrame | None = None, *, hot: int = HOT) -> DataFrame:
    """Links (u, v) whose components are those of all similar pairs that share a group and lie within the budget."""
    met = materialise(groups(nodes, more), "near-groups")
    sets = sets_of(met, nodes, docs)
    part = lambda n, seed: F.pmod(F.xxhash64("node", "g", F.lit(seed)), n)
    parts = lambda n: F.ceil(F.col(n) / hot)
    own = part(parts("n"), 0)
    out = forest(met.select("g", own.alias("lo"), own.alias("hi"), F.lit(0).cast("long").alias("sub"), "node", F.col("node").alias("root")), sets)
    crowded = met.where(F.col("n") > hot)
    if not crowded.limit(1).count():
        return out
    # members outside their group's largest component meet all its members
    rooted = crowded.join(components(out), "node", "left").select("g", "node", "n", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("g", "root").agg(F.count("*").alias("k"))
    main = sizes.groupBy("g").agg(F.max_by("root", F.struct("k", "root")).alias("main"), (F.sum("k") - F.max("k")).alias("strays")).where("strays > 0")
    rooted = materialise(rooted.join(main, "g"), "near-crowded")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(n) - 1))
    members = rooted.select("g", (own * 2).alias("lo"), each("strays").alias("hi"), F.lit(0).cast("long").alias("sub"), "node", "root").withColumn("hi", F.col("hi") * 2 + 1)
    strays = rooted.where("root <> main").select("g", each("n").alias("lo"), (part(parts("strays"), 1) * 2 + 1).alias("hi"), F.lit(1).cast("long").alias("sub"), "node", "root").withColumn("lo", F.col("lo") * 2)
    return out.unionByName(forest(members.unionByName(strays), sets))


def fingerprint_groups(nodes: DataFrame) -> DataFrame:
    """(node, g): nodes whose fingerprints link at four bits share a group."""
    found = components(simhash_dedup.links(nodes.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    return nodes.join(found, "fp", "left").select("node", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("g"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, root, component_id of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_hash"))
    marked = materialise(hashed.mapInArrow(_sketch, f"doc_id {kind}, text_hash long, node long, fp long, bands array<long>"), "sketches")
    # one document's text stands for each node: the texts of a node have the same words
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("one")
    same = [F.first(c).alias(c) for c in ("fp", "bands")]
    nodes = materialise(marked.groupBy("node").agg(one, *same).withColumn("least", F.col("one.doc_id")), "sketch-nodes")
    found = components(links(nodes, docs, fingerprint_groups(nodes)))
    tied = nodes.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = tied.join(least, "root").select("node", "root", "component_id")
    return marked.select("doc_id", "text_hash", "node").join(by_node, "node").select("doc_id", "text_hash", "root", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of its least doc_id."""
    return first_of_each(docs, classes(docs))
