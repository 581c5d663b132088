"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Vectors are cut in two halves, each with a codebook of its own (k-means on a bounded sample), and every vector is entered
in the cell of its two nearest centroids. For a query, centroid pairs are traversed by the sum of the two inner products
with a heap (the multi-sequence algorithm) until the cells hold enough entries; these, and no others, are reranked by exact
inner products.

How many entries are enough is measured, not guessed: a bounded number of the queries is searched exactly against all rows,
and the entries needed to reach ``recall`` of their neighbours are taken for all queries.

Cells are packed in order into blocks of bounded size, and a cell that is larger than a block is split over several. A query
goes once to each block that has cells of its traversal, with those cells, and brings back its best ``k`` of the block. On
large tables cells are larger than blocks, so a query goes to the share of the blocks that it sees of the entries; on small
ones a block has many cells, and only their entries are left out.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import drop, parts, stored

#: The sample that codebooks are fitted on: at most about so many vectors, and so many components in all.
SAMPLE = 20_000
SAMPLE_VALUES = 4_000_000
BLOCK = 8192
#: Centroids of each half: about sqrt(2 n), for a few cells a vector on small tables, and at most so many.
MOST_CENTROIDS = 64
TRIALS = 128
#: Queries that are scored at a time.
AT_ONCE = 256


def matrix(col, width: int | None = None) -> np.ndarray:
    """A column of lists as rows of doubles. Shorter ones are filled up with zeros; width, if given, also cuts longer ones."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    values = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    n = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(n.max(initial=0)) if width is None else width
    if (n == width).all():
        return values.reshape(len(col), width)
    out, at = np.zeros((len(col), width)), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.arange(len(col)), n)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)


def entered(books):
    half, width = books[0].shape[1], books[0].shape[1] + books[1].shape[1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), width)
                cell = nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return run


def traversal(q: np.ndarray, books, counts: np.ndarray, enough: int, own: dict[int, int]) -> list[int]:
    """Cells with entries, by falling sum of inner products, until they hold enough entries besides the query's own."""
    half, k = books[0].shape[1], len(books[1])
    s, t = books[0] @ q[:half], books[1] @ q[half:]
    a, b = np.argsort(-s, kind="stable"), np.argsort(-t, kind="stable")
    s, t = (-s[a]).tolist(), (-t[b]).tolist()
    a, b = (a * k).tolist(), b.tolist()
    held, out, left = counts[np.add.outer(a, b)].tolist(), [], enough
    heap = [(s[0] + t[0], 0, 0)]
    while heap and left > 0:
        _, i, j = heapq.heappop(heap)
        if n := held[i][j]:
            cell = a[i] + b[j]
            out.append(cell)
            left -= n - own.get(cell, 0)
        if j + 1 < len(b):
            heapq.heappush(heap, (s[i] + t[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (s[i + 1] + t[0], i + 1, 0))
    return out


FOUND = "query_id long, vec_id long, score double, cell int"


def best(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, cell: np.ndarray, approx: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of x for each row of q but for its own id's, by (score, id). approx: scores that may differ in the
    last bits, and -inf where a row is no candidate."""
    approx[own[:, None] == ids[None]] = -np.inf
    bar = np.partition(approx, len(ids) - k, axis=1)[:, [len(ids) - k]] if len(ids) > k else np.full((len(q), 1), -np.inf)
    at, row = np.nonzero((approx > -np.inf) & (approx >= np.where(bar > -np.inf, bar - 1e-9 * (1 + np.abs(bar)), -np.inf)))
    score = (x[row] * q[at]).sum(axis=1)
    order = np.lexsort((ids[row], -score, at))
    at, row, score = at[order], row[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    at, row, score = at[place < k], row[place < k], score[place < k]
    return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(ids[row]), pa.array(score), pa.array(cell[row].astype(np.int32))], names=["query_id", "vec_id", "score", "cell"])


def alike_wide(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both filled up with zeros to the width of the wider."""
    width = max(x.shape[1], y.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (x, y))


def scan_all(q: np.ndarray, own: np.ndarray, k: int):
    """The exact best of each batch for a bounded number of queries."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, wide = alike_wide(matrix(batch.column("v")), q)
                yield best(wide, own, x, batch.column("id").to_numpy(), batch.column("cell").to_numpy(), wide @ x.T, k)

    return run


def search_block(k: int):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(entries) and len(queries):
            entries = entries.take(np.argsort(entries.column("cell").to_numpy(), kind="stable"))
            ids, cell = entries.column("id").to_numpy(), entries.column("cell").to_numpy()
            x, q = alike_wide(matrix(entries.column("v")), matrix(queries.column("v")))
            own, wanted = queries.column("id").to_numpy(), queries.column("cells").combine_chunks()
            names, first = np.unique(cell, return_index=True)
            last = np.append(first[1:], len(cell))
            for at in range(0, len(q), AT_ONCE):
                part = wanted.slice(at, AT_ONCE)
                who = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                what = np.searchsorted(names, part.flatten().to_numpy())
                order = np.argsort(what, kind="stable")
                who, what = who[order], what[order]
                edge = np.searchsorted(what, np.arange(len(names) + 1))
                approx = np.full((len(part), len(ids)), -np.inf)
                for c in range(len(names)):  # every cell meets the queries that want it, and no others
                    asking = who[edge[c] : edge[c + 1]]
                    if len(asking):
                        approx[asking, first[c] : last[c]] = q[at + asking] @ x[first[c] : last[c]].T
                out.append(best(q[at : at + AT_ONCE], own[at : at + AT_ONCE], x, ids, cell, approx, k))
        return pa.Table.from_batches(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("cell", pa.int32())]))

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(embeddings: DataFrame) -> DataFrame:
    """id, v of the vectors that take part: not null, not zero, all components finite."""
    kind = embeddings.schema["embedding"].dataType
    exact = isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    v = F.col("embedding") if exact else F.col("embedding").cast("array<double>")
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(real, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))


@dataclass
class Index:
    """rows: id, v, cell of all vectors; counts: entries of each cell; enough: entries that a query must see."""

    rows: DataFrame
    n: int
    books: tuple
    counts: np.ndarray
    enough: int = 0

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """The first block of each cell, and how many it has. A cell above the bound has blocks of its own."""
        first, width, block, held = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64), 0, 0
        for c, m in enumerate(self.counts.tolist()):
            if held and held + m > BLOCK:
                block, held = block + 1, 0
            first[c], width[c] = block, -(-m // BLOCK) or 1
            held += m
            if held >= BLOCK:
                block, held = block + int(width[c]), 0
        return first, width


def build(embeddings: DataFrame) -> Index | None:
    """The index over all usable vectors; None if there are fewer than two."""
    rows = stored(usable(embeddings), "vectors")
    n, usual = rows.agg(F.count("*"), F.mode(F.size("v"))).first()
    if n < 2:
        return None
    centroids = int(np.clip(np.sqrt(2 * n), 1, MOST_CENTROIDS))
    most = max(centroids, min(SAMPLE, SAMPLE_VALUES // usual))
    chance = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < most / n).limit(2 * most).select("v").toArrow()
    if not len(sample):
        sample = rows.limit(1).select("v").toArrow()
    sample = matrix(sample.column("v"), usual)
    sample = sample[np.lexsort(sample.T[::-1])]
    half = max(1, usual // 2)
    books = (kmeans(sample[:, :half], centroids), kmeans(sample[:, half:], centroids) if usual > half else np.zeros((1, 0)))
    index = stored(rows.mapInArrow(entered(books), T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])), "index")
    drop(rows)
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    return Index(index, n, books, counts)


def queries_of(index: Index, every: int) -> DataFrame:
    """id, v and own (the entries of that id by cell) of the vectors whose id is divisible by ``every``."""
    each = index.rows.where(F.col("id") % every == 0).groupBy("id", "cell").agg(F.min("v").alias("v"), F.count("*").alias("n"))
    return stored(each.groupBy("id").agg(F.min("v").alias("v"), F.collect_list(F.struct("cell", "n")).alias("own")), "queries")


def measured(index: Index, queries: DataFrame, k: int, recall: float) -> int:
    """The entries that a traversal must cover to reach the recall on some of the queries, searched exactly."""
    trial = queries.orderBy(F.xxhash64("id"), "id").limit(TRIALS).toArrow()
    if not len(trial):
        return 1
    width = index.books[0].shape[1] + index.books[1].shape[1]
    own_ids, own = trial.column("id").to_numpy(), [{x["cell"]: x["n"] for x in o} for o in trial.column("own").to_pylist()]
    exact = top(index.rows.mapInArrow(scan_all(matrix(trial.column("v")), own_ids, k), FOUND), k).collect()
    order = {}
    for ident, v, mine in zip(own_ids.tolist(), matrix(trial.column("v"), width), own):
        cells = traversal(v, index.books, index.counts, int(index.counts.sum()), mine)
        order[ident] = dict(zip(cells, np.cumsum([index.counts[c] - mine.get(c, 0) for c in cells]).tolist()))
    need = sorted(order[r.query_id][r.cell] for r in exact)
    return max(2 * k + 2, need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) if need else 2 * k + 2


def routed(index: Index, queries: DataFrame) -> DataFrame:
    """block, id, v, cells: every query once for each block that has cells of its traversal."""
    books, counts, enough = index.books, index.counts, index.enough
    (first, width), size = index.blocks(), books[0].shape[1] + books[1].shape[1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                block, row, cells = [], [], []
                for i, (q, own) in enumerate(zip(matrix(batch.column("v"), size), batch.column("own").to_pylist())):
                    to: dict[int, list[int]] = {}
                    for c in traversal(q, books, counts, enough, {x["cell"]: x["n"] for x in own}):
                        for b in range(int(first[c]), int(first[c] + width[c])):
                            to.setdefault(b, []).append(c)
                    block += to
                    row += [i] * len(to)
                    cells += to.values()
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cells, pa.list_(pa.int32()))], names=["block", "id", "v", "cells"])

    kind = T.StructType([T.StructField("block", T.LongType()), *queries.schema.fields[:2], T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return queries.repartition(parts(queries), "id").mapInArrow(run, kind)


def search(embeddings: DataFrame, every: int = 20, k: int = 20, recall: float = 0.94) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by ``every``.

    Null, zero and non-finite vectors take no part, nor do those without id. Of two vectors of different lengths the
    shorter counts as filled up with zeros. Of rows that share an id all are candidates, none for a query of that id, and
    the smallest vector is the query. Ties go to the smaller vec_id. Other columns are ignored. An empty table gives no
    rows.
    """
    index = build(embeddings)
    if index is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = queries_of(index, every)
    index.enough = measured(index, queries, k, recall)
    first, width = index.blocks()

    def placed(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            salt = np.random.default_rng(0).integers(0, 1 << 30, len(cell))
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + salt % width[cell]), *batch.columns], names=["block", *batch.schema.names])

    entries = index.rows.mapInArrow(placed, T.StructType([T.StructField("block", T.LongType()), *index.rows.schema.fields]))
    found = entries.groupBy("block").cogroup(routed(index, queries).groupBy("block")).applyInArrow(search_block(k), FOUND)
    return top(found, k).select("query_id", "rank", "vec_id", "score")
