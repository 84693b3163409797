"""Best-fit packing of token sequences: local best fit, then a tree of merges of underfull bins.

Documents are tokenised once, in whole; a document longer than a bin becomes full pieces and
one shorter first piece, so all but the first piece fill a bin of their own. First pieces are
dealt to groups by a hash; each group packs its own by best fit, longest first. Bins with at most
`slack` tokens of room are emitted; all others go up a tree as items: `FAN` groups meet in a node,
which packs their bins by best fit, emits what is nearly full, and passes the rest on. A node
never holds more than `group` bins: where many stay underfull, the next level has more nodes. The
tree ends at one node, or when a level joins less than `least_gain` of its bins: then all are emitted.

Defined results for odd rows: a null text is empty and still packs its end mark; repeated
rows are packed as separate documents; no documents, no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import materialise

BIN, END = 1024, 2
#: First pieces in a group of the lowest level, groups that meet in a merge, and room that a nearly full bin may have.
GROUP, FAN, SLACK = 20_000, 16, 8
SPECIAL = "<|endoftext|>"
#: The byte-level pre-tokenizer's pattern, a fixed value of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary keyed by bytes: printable Latin-1 characters stand for themselves, the
    other byte values, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    value = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
    return {bytes(value[c] for c in k): v for k, v in vocabulary.items()}


class Encoder:
    """ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer file's own vocabulary, whose ids are its merge ranks, drives a faster library
    over Latin text; texts with other characters, or with the special token's string, go to the
    tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks = byte_ranks({k: v for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items() if k != SPECIAL})
        self.fast = tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # long white space makes the fast library's pattern backtrack; controls 1c-1f are space to some libraries
        self.foreign = re.compile(r"[^\x00-\x1b\x20-\u024f]|\s{500}").search

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text or self.foreign(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


def cut(n: int, size: int = BIN) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    head = (n - 1) % size + 1
    return [(0, head)] + [(s, size) for s in range(head, n, size)]


def tokenised(docs: DataFrame, path: str, size: int = BIN) -> DataFrame:
    """A row for each piece: doc_id, row (numbers the documents), piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            where, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                ids = encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, size)):
                    where.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            at = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return numbered.mapInArrow(run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int = BIN) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its offset, fill of each bin): each item, in the order given, goes to the fullest bin with room."""
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r: some bin has exactly r tokens of room
    where, offset, fill = [], [], []
    for n in lengths:
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b = size, len(fill)
            fill.append(0)
        where.append(b)
        offset.append(fill[b])
        fill[b] += n
        if room > n:
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return where, offset, fill


def _local(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        where, offset, fill = best_fit(pdf["length"].tolist(), size)
        where = np.array(where)
        return pd.DataFrame({"row": pdf["row"], "bin": (int(pdf["grp"].iloc[0]) << 32) + where, "offset": offset, "fill": np.array(fill)[where]})

    return run


def _merge(size: int):
    """Bins that meet in one node, packed as items by best fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        where, offset, fill = best_fit(pdf["fill"].tolist(), size)
        members: dict[int, list] = {}
        for w, o, m in zip(where, offset, pdf["members"], strict=True):
            members.setdefault(w, []).extend({"bin": x["bin"], "shift": x["shift"] + o} for x in m)
        rows = [(min(x["bin"] for x in m), fill[w], m) for w, m in members.items()]
        return pd.DataFrame({"bin": [r[0] for r in rows], "fill": [r[1] for r in rows], "members": [r[2] for r in rows]})

    return run


def pack(pieces: DataFrame, *, size: int = BIN, group: int = GROUP, slack: int = SLACK, least_gain: float = 1e-3) -> DataFrame:
    """pieces (doc_id, row, piece, start, length, ids_crc32) with sequence_id and offset."""
    heads = pieces.where("piece = 0")
    groups = max(1, -(-heads.count() // group))
    dealt = heads.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"))
    local = materialise(dealt.groupBy("grp").applyInPandas(_local(size), "row long, bin long, offset long, fill long"), "pack-local")
    bins = local.groupBy("bin").agg(F.first("fill").alias("fill"))
    up = bins.where(F.col("fill") < size - slack).select("bin", "fill", F.array(F.struct(F.col("bin"), F.lit(0).cast("long").alias("shift"))).alias("members"))
    n, final = up.count(), None
    while groups > 1 and n > 1:
        groups = max(-(-groups // FAN), -(-n // group))
        node = F.pmod(F.xxhash64("bin", F.lit(groups)), F.lit(groups))
        schema = "bin long, fill long, members array<struct<bin:bigint,shift:bigint>>"
        level = materialise(up.groupBy(node.alias("node")).applyInPandas(_merge(size), schema), "pack-merge")
        after, left = level.agg(F.count("*"), F.count(F.when(F.col("fill") < size - slack, 1))).first()
        end = n - after <= least_gain * n
        done = level.where((F.col("fill") >= size - slack) | F.lit(end or groups == 1)).select("bin", "members")
        final = done if final is None else final.unionByName(done)
        up, n = level.where(F.col("fill") < size - slack), 0 if end else left
    if final is not None:
        final = final.where(F.size("members") > 1).select(F.col("bin").alias("seq"), F.explode("members").alias("m")).select("seq", F.col("m.bin").alias("bin"), F.col("m.shift").alias("shift"))
        local = local.join(final, "bin", "left").select("row", F.coalesce("seq", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    local = local.select("row", F.col("bin").alias("sequence_id"), "offset")
    placed = heads.join(local, "row")
    # full pieces: numbers below zero, one of its own for each
    rest = pieces.where("piece > 0").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(rest)


def report(docs: DataFrame, *, path: str | None = None, size: int = BIN, group: int = GROUP) -> DataFrame:
    """The contract's rows: every piece of every document with its place."""
    pieces = materialise(tokenised(docs, path or vocabulary_path(), size), "pack-pieces")
    return pack(pieces, size=size, group=group).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
