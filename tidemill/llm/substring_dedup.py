"""Substring dedup by fixed-block anchors.

Every run of ``width`` words holds a whole aligned block of (width + 1) // 2 words of the document that it is in. So the
aligned, non-overlapping blocks of all documents are indexed, and every rolling window of a block's length is probed. A hit
is extended to all windows of ``width`` words around it, which are compared over all documents by two independent 64-bit
hashes; runs of repeated windows are maximal exact repeats.

Rows are dealt evenly into chunks of a few MB and written once, bucketed by chunk. A chunk sends each of its distinct
hashes once, packed by hash range (slot), whatever the number of its documents that have it; a slot answers each chunk with
the hashes that count, also those that only documents of that chunk have. So a passage that all documents share costs a few
bytes a chunk, no pairs of documents are ever made, and documents and answers meet by chunk without moving the texts again.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import delete, drop, input_bytes, parts, scratch, stored
from .textkit import U, Words, packed, rolling, unpacked

#: Bits of a hash that a probe carries beside its slot.
REST = 30


def group_edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Chunk:
    """The documents of a chunk that can be compared, and their words."""

    def __init__(self, table: pa.Table):
        self.words = w = Words(table.column("text"))
        self.row = w.rows()
        ids = table.column("doc_id")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.left = w.first[1:][self.row] - np.arange(len(w))  # words from here to the document's end
        self.h = w.hashes()

    def starts(self, size: int) -> np.ndarray:
        return np.flatnonzero((self.left >= size) & self.known[self.row]) if len(self.row) else np.zeros(0, np.int64)

    def blocks(self, width: int, block: int, bits: int):
        """Positions of rolling windows of documents that have ``width`` words, and their keys: slot and REST bits."""
        at = self.starts(block)
        length = np.diff(self.words.first)
        at = at[length[self.row[at]] >= width] if len(at) else at
        return at, rolling(self.h, block)[at] >> U(64 - bits - REST)

    def windows(self, at: np.ndarray, width: int):
        """Both hashes of windows; the last bit of the second is left free."""
        return rolling(self.h, width)[at], rolling(self.words.hashes(1), width, 1)[at] & ~U(1)


def chunk_of(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def by_slot(chunk: int, slots: np.ndarray, values: np.ndarray, names: tuple) -> pa.Table:
    """A row for each slot; slots are sorted."""
    edge = group_edges(slots)
    bounds = np.concatenate([edge, [len(slots)]])
    return pa.table([pa.array(np.full(len(edge), chunk, np.int64)), pa.array(slots[edge].astype(np.int64)), packed(values, bounds)], names=list(names))


def probes(width: int, block: int, bits: int):
    def send(table: pa.Table) -> pa.Table:
        """Each distinct block hash with two flags: 1, an aligned block has it; 2, several documents have it."""
        c = Chunk(table)
        at, key = c.blocks(width, block, bits)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        edge = group_edges(key)
        if not len(edge):
            return by_slot(0, np.zeros(0, U), np.zeros(0, np.uint32), ("chunk", "slot", "keys"))
        aligned = np.logical_or.reduceat((at - c.words.first[c.row[at]]) % block == 0, edge)
        ids = c.ids[c.row[at]]
        many = np.minimum.reduceat(ids, edge) != np.maximum.reduceat(ids, edge)
        key = key[edge]
        values = ((key & U((1 << REST) - 1)) << U(2)).astype(np.uint32) | aligned.astype(np.uint32) | (many.astype(np.uint32) << 1)
        return by_slot(chunk_of(table), key >> U(REST), values, ("chunk", "slot", "keys"))

    return send


def answer(rows: np.ndarray, good: np.ndarray, values: np.ndarray, table: pa.Table) -> pa.Table:
    """The good values of each row, for its chunk."""
    keep = np.flatnonzero(good)
    edge = group_edges(rows[keep])
    chunks = table.column("chunk").to_numpy()
    return pa.table([pa.array(chunks[rows[keep][edge]] if len(edge) else np.zeros(0, np.int64)), table.column("slot")[: len(edge)].combine_chunks() if len(edge) else pa.array([], pa.int64()), packed(values[keep], np.concatenate([edge, [len(keep)]]))], names=["chunk", "slot", "hits"])


def match_blocks(table: pa.Table) -> pa.Table:
    """The hashes that an aligned block has and at least two documents have."""
    values, rows = unpacked(table.column("keys"), np.uint32)
    key = values >> np.uint32(2)
    order = np.argsort(key, kind="stable")
    edge = group_edges(key[order])
    sizes = np.diff(np.append(edge, len(key)))
    flags = np.bitwise_or.reduceat(values[order] & np.uint32(3), edge)
    good = np.empty(len(key), bool)
    good[order] = np.repeat(((flags & 1) > 0) & ((sizes > 1) | ((flags & 2) > 0)), sizes)
    return answer(rows, good, key, table)


#: A window and the smallest id that has it. The last bit of b: several ids of the chunk have it.
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8")])


def window_edges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where runs of equal windows begin in sorted hashes."""
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)


def candidate_windows(width: int, block: int, bits: int):
    def send(table: pa.Table, hits: pa.Table) -> pa.Table:
        """Each distinct window around a hit with the smallest id that has it in this chunk."""
        empty = by_slot(0, np.zeros(0, U), np.zeros(0, WINDOW), ("chunk", "slot", "keys"))
        if not len(table) or not len(hits):
            return empty
        c = Chunk(table)
        at, key = c.blocks(width, block, bits)
        found, rows = unpacked(hits.column("hits"), np.uint32)
        wanted = np.sort((hits.column("slot").to_numpy()[rows].astype(U) << U(REST)) | found.astype(U))
        place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        hit = at[wanted[place] == key]
        cover = np.zeros(len(c.row) + 1, np.int32)
        np.add.at(cover, np.maximum(hit - (width - block), c.words.first[c.row[hit]]), 1)
        np.add.at(cover, hit + 1, -1)
        starts = c.starts(width)
        starts = starts[np.cumsum(cover)[starts] > 0]
        a, b = c.windows(starts, width)
        ids = c.ids[c.row[starts]]
        order = np.lexsort((ids, b, a))
        a, b, ids = a[order], b[order], ids[order]
        edge = window_edges(a, b)
        if not len(edge):
            return empty
        out = np.empty(len(edge), WINDOW)
        out["a"], out["b"], out["id"] = a[edge], b[edge], ids[edge]
        out["b"] |= (ids[np.append(edge[1:], len(ids)) - 1] != ids[edge]).astype(U)
        return by_slot(chunk_of(table), out["a"] >> U(64 - bits), out, ("chunk", "slot", "keys"))

    return send


def match_windows(table: pa.Table) -> pa.Table:
    """For each chunk the windows that a smaller id than one of its own has, here or elsewhere, with the smallest id."""
    values, rows = unpacked(table.column("keys"), WINDOW)
    a, b = values["a"], values["b"] & ~U(1)
    order = np.lexsort((b, a))
    edge = window_edges(a[order], b[order])
    out = np.empty(len(values), WINDOW)
    out["a"], out["b"] = a, b
    out["id"][order] = np.repeat(np.minimum.reduceat(values["id"][order], edge), np.diff(np.append(edge, len(values))))
    return answer(rows, (out["id"] < values["id"]) | (values["b"] & U(1) > 0), out, table)


def smallest_ids(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window is among the found ones, and the smallest id that has it."""
    found = found[np.lexsort((found["b"], found["a"]))]
    known, ids = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    if len(found) and len(a):
        edge = group_edges(found["a"])
        place = np.searchsorted(found["a"], a)
        for i in range(int(np.diff(np.append(edge, len(found))).max())):  # once, but for windows that differ in b alone
            at = np.minimum(place + i, len(found) - 1)
            same = (found["a"][at] == a) & (found["b"][at] == b)
            known |= same
            ids[same] = found["id"][at[same]]
    return known, ids


RESULT = "doc_id long, n_words long, n_removed long, text string, spans array<struct<start:int,end:int>>"


def removal(width: int):
    def cut(table: pa.Table, hits: pa.Table) -> pa.Table:
        c = Chunk(table)
        first = c.words.first
        starts = c.starts(width) if len(hits) else np.zeros(0, np.int64)
        repeated = np.zeros(0, bool)
        if len(starts):
            known, least = smallest_ids(unpacked(hits.column("hits"), WINDOW)[0], *c.windows(starts, width))
            repeated = known & (least < c.ids[c.row[starts]])
        cover = np.zeros(len(c.row) + 1, np.int32)
        np.add.at(cover, starts[repeated], 1)
        np.add.at(cover, starts[repeated] + width, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        data = c.words.data
        texts, places = [], []
        for i in range(len(first) - 1):
            words = data[c.words.offsets[i] : c.words.offsets[i + 1]].tobytes().split()
            lo, hi = first[i], first[i + 1]
            place = []
            if removed[hi] > removed[lo]:
                mask = gone[lo:hi]
                words = [w for w, g in zip(words, mask.tolist()) if not g]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                place = [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]
            texts.append(b" ".join(words))
            places.append(place)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table(
            [table.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array((removed[first[1:]] - removed[first[:-1]]).astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(places, span)],
            names=["doc_id", "n_words", "n_removed", "text", "spans"],
        )

    return cut


def remove_repeats(docs: DataFrame, width: int = 50, chunk_mb: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words, joined by a space) and spans (of removed words: from start to
    before end) for every row of docs.

    A word goes when a window of ``width`` words that covers it also starts in a document with a smaller doc_id. Null and
    blank texts have no words and keep an empty text. A row without doc_id has no place in the order: it loses nothing
    and nothing is lost for it. Rows that share a doc_id are not compared with each other. Other columns are ignored. An
    empty table gives no rows. The result is stored.
    """
    spark, block = docs.sparkSession, (width + 1) // 2
    n = parts(docs)
    size = input_bytes(docs)
    chunks = max(n, size // (chunk_mb << 19))
    bits = max(8, int(size // (4 << 20)).bit_length())
    name = f"chunked_{uuid.uuid4().hex}"
    # Any dealing will do, as windows are compared by id wherever they are; so no id fills a chunk, however often it comes.
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(int(chunks))).alias("chunk"))
    path = scratch(spark, "chunked")
    dealt.repartition(n, "chunk").write.option("path", f"{path}/t").option("compression", "zstd").bucketBy(n, "chunk").sortBy("chunk").saveAsTable(name)
    try:
        chunked = lambda: spark.table(name).select("chunk", "doc_id", "text")
        sent = "chunk long, slot long, keys binary"
        replied = "chunk long, slot long, hits binary"
        keys = chunked().groupBy("chunk").applyInArrow(probes(width, block, bits), sent)
        hits = stored(with_slot(keys, match_blocks, replied), "hits")
        windows = chunked().groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(candidate_windows(width, block, bits), sent)
        repeats = stored(with_slot(windows, match_windows, replied), "repeats")
        drop(hits)
        out = stored(chunked().groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(removal(width), RESULT), "kept")
        drop(repeats)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)
    return out


def with_slot(sent: DataFrame, match, schema: str) -> DataFrame:
    def one(table: pa.Table) -> pa.Table:
        out = match(table)
        return out.set_column(1, "slot", pa.array(np.full(len(out), table.column("slot")[0].as_py(), np.int64)))

    return sent.groupBy("slot").applyInArrow(one, schema)
