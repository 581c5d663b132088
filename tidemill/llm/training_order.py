"""Training-order materialisation: token sequences in a keyed pseudo-random order, in binary shards of fixed stride.

Texts become token ids of a byte-level BPE vocabulary (a parameter), closed by an end token and cut into sequences of
``length`` ids. Sequences are numbered by (doc_id, hash of the text, piece), so that the numbers follow the rows and not the
files that they come in; a Feistel network under a key permutes the numbers, and cycle-walking keeps them below the number of
sequences. The result is a sequence's global slot. Shards are ranges of slots; in a shard every record has the same size, so
slot s is at (s mod per_shard) * stride of shard s div per_shard, and reading can resume at any slot.

Texts are tokenized once, and their ids stored. The numbers need only the texts' counts of sequences: these are sorted by
range, summed, and written as a file of first numbers for each part of the stored ids, which the task that reads the part
finds by name. Records are shuffled in a few rounds, each for a range of shards, so that only a part of them is on the way.

A record is doc_id (int64; the smallest one for null), piece (int32), n_tokens (int32) and ``length`` ids (uint16, or
uint32 for vocabularies above 65536), all little-endian; ids beyond n_tokens are the end token.
"""

from __future__ import annotations

import base64
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import delete, drop, make_folder, parts, scratch, small, stored, storing
from .textkit import U, mix, packed, slices
from .warc import Out

# Fixed value: the published pattern that cuts texts before byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NO_ID = -(1 << 63)


def load_ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def tokenizer_of(vocabulary: bytes) -> Tokenizer:
    """The tokenizer of a vocabulary file's content. Tasks that run in one worker share it: it is kept with the tokenizer's
    module, as functions that are shipped by value have globals of their own in each task."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_tidemill_kept", {})
    key = hash(vocabulary)
    if key not in kept:
        kept.clear()
        kept[key] = Tokenizer(load_ranks(vocabulary))
    return kept[key]


class Tokenizer:
    """Whole texts to ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.end = len(ranks)
        self.kind = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text).astype(self.kind)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts as one array, and the bounds of each row in it. Null and empty texts have none."""
        found = [self.encode(text or "") for text in texts.to_pylist()]
        return np.concatenate([np.zeros(0, self.kind), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])


def permuted(x: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next power of four, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix(U(key & ((1 << 64) - 1)) ^ np.arange(rounds, dtype=U) * U(0x9FB21C651E98DF25))
    out = x.astype(U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = (left << U(half)) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def record_kind(length: int, kind: np.dtype) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("n_tokens", "<i4"), ("ids", kind, (length,))])


TOKENS = "part int, pos long, doc_id long, digest long, pieces long, ids binary"


def tokenized(vocabulary: bytes, length: int):
    """The ids of each row that has any, where it is (part and place in it), and the number of its sequences."""

    def run(batches):
        at, part, tokenizer = 0, TaskContext.get().partitionId(), tokenizer_of(vocabulary)
        for batch in batches:
            for piece in slices(batch, "text"):
                there = pc.greater(pc.fill_null(pc.binary_length(piece.column("text")), 0), 0)
                piece = piece.filter(there)
                ids, bounds = tokenizer.ids(piece.column("text"))
                n = len(bounds) - 1
                pieces = -(-(np.diff(bounds) + 1) // length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), piece.column("doc_id").cast(pa.int64()), piece.column("digest"), pa.array(pieces), packed(ids, bounds)],
                    names=["part", "pos", "doc_id", "digest", "pieces", "ids"],
                )
                at += n

    return run


def first_numbers(tokens: DataFrame) -> DataFrame:
    """part, pos and first: the number of the first sequence of each text, by (doc_id, digest); texts that are equal in both
    are interchangeable."""
    order = ["doc_id", "digest", "part", "pos"]
    narrow = tokens.select(*order, "pieces")
    dealt = stored(narrow.repartitionByRange(parts(narrow), *order).withColumn("range", F.spark_partition_id()), "numbers")
    sums = dealt.groupBy("range").agg(F.sum("pieces").alias("n"))
    before = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    mine = F.sum("pieces").over(Window.partitionBy("range").orderBy(*order)) - F.col("pieces")
    return dealt.withColumn("mine", mine).join(small(before), "range").select("part", "pos", (F.col("before") + F.col("mine")).alias("first"))


def number_writer(folder: str):
    """Writes the first numbers of each part, in order of place, as file ``part``; a task that is repeated writes the same."""

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        now, held, written = None, [], 0

        def close():
            if now is not None:
                name = f"{path}/tmp-{uuid.uuid4().hex}"
                with fs.open_output_stream(name, compression=None) as f:
                    f.write(np.concatenate(held).astype("<i8").tobytes())
                fs.move(name, f"{path}/{now}")

        for batch in batches:
            part, first = batch.column("part").to_numpy(), batch.column("first").to_numpy()
            edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist() if len(part) else []
            for lo, hi in zip(edges, [*edges[1:], len(part)]):
                if part[lo] != now:
                    close()
                    now, held = int(part[lo]), []
                held.append(first[lo:hi])
            written += len(part)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["n"])

    return run


def records_of(doc_id, ids, bounds, length: int, kind: np.dtype, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The records of some texts in order (each one's ids and end token, cut into sequences), and the text of each."""
    size = np.diff(bounds) + 1
    pieces = -(-size // length)
    first = np.cumsum(pieces) - pieces
    row = np.repeat(np.arange(len(size)), pieces)
    out = np.empty(len(row), record_kind(length, kind))
    out["doc_id"] = doc_id[row]
    out["piece"] = np.arange(len(row)) - first[row]
    out["n_tokens"] = np.minimum(length, size[row] - out["piece"].astype(np.int64) * length)
    padded = np.full(len(row) * length, end, kind)
    padded[np.arange(len(ids)) + np.repeat(first * length - bounds[:-1], np.diff(bounds))] = ids
    out["ids"] = padded.reshape(-1, length)
    return out, row


def slotted(folder: str, length: int, kind: np.dtype, end: int, n: int, per_shard: int, key: int, shards: tuple[int, int]):
    """The records of the given range of shards, with their slots. folder has the first numbers."""

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        now, firsts = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, pos = batch.column("part").to_numpy(), batch.column("pos").to_numpy()
            first = np.empty(len(pos), np.int64)
            for p in np.unique(part).tolist():
                if p != now:
                    with fs.open_input_file(f"{path}/{p}") as f:
                        now, firsts = p, np.frombuffer(f.read(), "<i8")
                first[part == p] = firsts[pos[part == p]]
            doc_id = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
            column = batch.column("ids").cast(pa.large_binary())
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // kind.itemsize
            ids = np.frombuffer(column.buffers()[2] or b"", kind)[bounds[0] : bounds[-1]]
            records, row = records_of(doc_id, ids, bounds - bounds[0], length, kind, end)
            slot = permuted(first[row] + records["piece"], n, key)
            mine = np.flatnonzero((slot // per_shard >= shards[0]) & (slot // per_shard < shards[1]))
            records, slot = records[mine], slot[mine]
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), packed(records, np.arange(len(records) + 1))], names=["shard", "slot", "record"])

    return run


def shard_writer(folder: str, per_shard: int, stride: int):
    def run(batches):
        out, now, due, crc, rows = None, None, 0, 0, []

        def close():
            if out is not None:
                out.close()
                rows.append({"shard": now, "file": out.name, "records": out.at // stride, "crc32": crc})

        for batch in batches:
            shard, slot = (batch.column(c).to_numpy() for c in ("shard", "slot"))
            start = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() if len(shard) else []
            for lo, hi in zip(start, [*start[1:], len(shard)]):
                if shard[lo] != now:
                    close()
                    out, now, due, crc = Out(folder, ".bin"), int(shard[lo]), int(shard[lo]) * per_shard, 0
                if (slot[lo:hi] != np.arange(due, due + hi - lo)).any():
                    raise RuntimeError(f"after slot {due} of shard {now}, one is missing")
                records = b"".join(batch.column("record").slice(lo, hi - lo).to_pylist())
                out.write(records)
                crc, due = zlib.crc32(records, crc), due + hi - lo
        close()
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("crc32", pa.int64())]))

    return run


MANIFEST = "shard long, file string, records long, crc32 long"


def write_order(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, length: int = 256, per_shard: int = 16384, key: int = 2, rounds: int = 3) -> DataFrame:
    """Write the shards under folder; returns the manifest (shard, file, records, crc32), also stored as folder/manifest.

    Null and empty texts give no sequences; a null doc_id is kept as such, and comes first in the numbering; repeated rows
    are sequences of their own. The slots depend on the rows alone, not on their files or order. Other columns are ignored.
    An empty table gives no shards.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read()
    tokenizer = tokenizer_of(content)
    kind, end = tokenizer.kind, tokenizer.end
    tokens = stored(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(tokenized(content, length), TOKENS), "tokens")
    n, texts = tokens.agg(F.coalesce(F.sum("pieces"), F.lit(0)), F.count("*")).first()
    numbers = scratch(spark, "first-numbers")
    by_part = first_numbers(tokens).repartition(parts(tokens), "part").sortWithinPartitions("part", "pos")
    written = by_part.mapInArrow(number_writer(numbers), "n long").agg(F.sum("n")).first()[0]
    if (written or 0) != texts:
        raise RuntimeError(f"{texts} texts, but {written} numbers")
    make_folder(spark, f"{folder}/shards")
    shards, to = -(-n // per_shard), parts(tokens)
    for i in range(rounds):
        part = (shards * i // rounds, shards * (i + 1) // rounds)
        records = tokens.mapInArrow(slotted(numbers, length, kind, end, n, per_shard, key, part), "shard long, slot long, record binary")
        place = F.floor((F.col("shard") - part[0]) * to / max(1, part[1] - part[0]))  # each task gets a range of the shards
        dealt = records.repartitionById(to, place.cast("int")).sortWithinPartitions("shard", "slot")
        with storing(spark):
            dealt.mapInArrow(shard_writer(f"{folder}/shards", per_shard, 16 + length * kind.itemsize), MANIFEST).write.mode("append").parquet(f"{folder}/manifest")
    drop(tokens)
    delete(spark, numbers)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_order(manifest: DataFrame, folder: str, length: int = 256, per_shard: int = 16384, size: int = 2, start: int = 0) -> DataFrame:
    """All records from slot ``start`` on, each shard read sequentially: slot, shard, doc_id, piece, n_tokens,
    tokens_crc32 (of the ids without padding)."""
    stride, at_once = 16 + length * size, 4096

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(f"{folder}/shards")
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{path}/{r['file']}") as f:
                    for at in range(max(0, start - r["shard"] * per_shard), r["records"], at_once):
                        data = f.read_at(min(at_once, r["records"] - at) * stride, at * stride)
                        x = np.frombuffer(data, np.uint8).reshape(-1, stride)
                        doc = np.ascontiguousarray(x[:, :8]).view("<i8")[:, 0]
                        meta = np.ascontiguousarray(x[:, 8:16]).view("<i4")
                        crc = [zlib.crc32(data[i : i + size * m]) for i, m in zip(range(16, len(data), stride), meta[:, 1].tolist())]
                        slot = r["shard"] * per_shard + np.arange(at, at + len(x))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(slot), pa.array(np.full(len(x), r["shard"])), pa.array(doc, mask=doc == NO_ID), pa.array(meta[:, 0].astype(np.int32)), pa.array(meta[:, 1].astype(np.int32)), pa.array(crc, pa.int64())],
                            names=["slot", "shard", "doc_id", "piece", "n_tokens", "tokens_crc32"],
                        )

    spread = manifest.where((F.col("shard") + 1) * per_shard > start).repartition(parts(manifest), "shard")
    return spread.mapInArrow(run, "slot long, shard long, doc_id long, piece int, n_tokens int, tokens_crc32 long")


def ordered_round_trip(docs: DataFrame) -> DataFrame:
    folder = scratch(docs.sparkSession, "order")
    return read_order(write_order(docs, folder), folder)
