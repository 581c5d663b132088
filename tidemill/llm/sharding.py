"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Records hash into thousands of slots, once and for all. The bytes in every slot are summed, and the map from slots to shards
is stored by version. The first version deals slots in turn, as nothing is known of the data yet; rebalancing loads the
last version, edits it by moving and exchanging as few slots as even out the bytes, and stores the result as the next. A map
has a row per slot, so its size is fixed by the number of slots and not by the data.
"""

from __future__ import annotations

import bisect
import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import file_system, stored

SLOTS = 4096
#: A slot with more than one row and over this part of a shard's even share is dealt anew by salted keys.
HOT = 1 / 8
#: Shards whose bytes differ by no more than this part of an even share are left as they are.
CLOSE = 1e-4


def slot_of(key: str, slots: int = SLOTS):
    """The virtual slot of a record. Records without a key share the one that null hashes to."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("vslot")


def slot_loads(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of all slots that have records: at most as many rows as there are slots."""
    return [(x.vslot, x.bytes, x.rows) for x in records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()]


def in_turn(shards: int, slots: int = SLOTS) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalanced(current: list[int], loads: list[tuple[int, int, int]], shards: int) -> list[int]:
    """current edited for a new number of shards or new loads. Slots of shards that are gone move to the emptiest. Then, as
    long as it helps, the fullest shard gives the emptiest a slot, or exchanges one for a smaller one, so as to bring them
    as near as one step can. All other slots stay."""
    size = {slot: n for slot, n, _ in loads}
    out, total = list(current), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]  # (bytes, slot), sorted

    def put(slot: int, shard: int) -> None:
        out[slot] = shard
        total[shard] += size.get(slot, 0)
        bisect.insort(held[shard], (size.get(slot, 0), slot))

    for s, shard in enumerate(current):
        if shard < shards:
            put(s, shard)
    for s in sorted((s for s, shard in enumerate(current) if shard >= shards), key=lambda s: (-size.get(s, 0), s)):
        put(s, min(range(shards), key=lambda i: (total[i], i)))
    able, close = set(range(shards)), sum(total) / shards * CLOSE
    for _ in range(4 * len(out)):
        high, low = max(able, key=lambda i: (total[i], -i)), min(able, key=lambda i: (total[i], i))
        gap = total[high] - total[low]
        if gap <= close:
            break
        moves = [(abs(2 * n - gap), s, None) for n, s in held[high] if 0 < n < gap]
        for n, s in held[high]:
            at = bisect.bisect_left(held[low], (n - gap / 2, -1))
            moves += [(abs(2 * (n - m) - gap), s, t) for m, t in held[low][max(0, at - 1) : at + 1] if 0 < n - m < gap]
        if not moves:  # it has one slot that is too large, or none that fits; the others may still be evened out
            able.remove(high)
            continue
        _, s, t = min(moves, key=lambda x: (x[0], x[2] is not None, x[1]))
        for slot, source, to in ((s, high, low), *([] if t is None else [(t, low, high)])):
            held[source].remove((size.get(slot, 0), slot))
            total[source] -= size.get(slot, 0)
            put(slot, to)
    return out


def store_map(spark: SparkSession, path: str, version: int, assignment: list[int], loads: list[tuple[int, int, int]]) -> None:
    """Write a version of the map: vslot, shard, rows, bytes, first (rows of the shard's slots before this one)."""
    by_slot, first, lines = {s: (n, r) for s, n, r in loads}, {}, []
    for slot, shard in enumerate(assignment):
        size, rows = by_slot.get(slot, (0, 0))
        lines.append({"vslot": slot, "shard": shard, "bytes": size, "rows": rows, "first": first.get(shard, 0)})
        first[shard] = first.get(shard, 0) + rows
    kind = "array<struct<vslot:int,shard:int,bytes:bigint,rows:bigint,first:bigint>>"
    rows_of = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(lines)), kind)).alias("x")).select("x.*")
    rows_of.coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def last_version(spark: SparkSession, path: str) -> int:
    """The number of the newest map stored at path; 0 if there is none."""
    fs, at = file_system(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(m[1]) for n in names if (m := re.fullmatch(r"version=(\d+)", n))), default=0)


def next_map(spark: SparkSession, path: str, loads: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> DataFrame:
    """The last map at path, edited for these loads and this number of shards, stored as the next version."""
    if not (version := last_version(spark, path)):
        version = 1
        store_map(spark, path, version, in_turn(shards, slots), loads)
    current = [r.shard for r in load_map(spark, path, version).orderBy("vslot").collect()]  # a row per slot
    if len(current) != slots:
        raise ValueError(f"the map at {path} has {len(current)} slots, not {slots}: the number of slots is fixed for good")
    store_map(spark, path, version + 1, rebalanced(current, loads, shards), loads)
    return load_map(spark, path, version + 1)


def sharded(records: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """records (with vslot) with shard and slot: the place in the shard, gapless from 0. Every virtual slot numbers its
    own rows by the order given, and the map adds the rows of the shard's earlier slots."""
    mine = F.row_number().over(Window.partitionBy("vslot").orderBy(*order)) - 1
    numbered = records.withColumn("mine", mine.cast("long"))
    return numbered.join(F.broadcast(slot_map.select("vslot", "shard", "first")), "vslot").withColumn("slot", F.col("first") + F.col("mine")).drop("first", "mine")


def shard_documents(docs: DataFrame, path: str, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot for every row of docs. The last map stored at path (or a
    first one that deals slots in turn) is edited for these documents, and stored as the next version. The law is
    ``bytes``: the shards' sizes are as near to equal as moving and exchanging whole slots brings them.

    A null text has no bytes and the checksum of an empty text; rows without doc_id share a virtual slot, as do rows of one
    id, unless that slot is hot: its rows are salted by their place in the input. Other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of("doc_id", slots))
    loads = slot_loads(records)
    even = sum(n for _, n, _ in loads) / shards
    if hot := [slot for slot, n, rows in loads if rows > 1 and n > HOT * even]:
        salted = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(slots)).cast("int")
        records = stored(records.withColumn("vslot", F.when(F.col("vslot").isin(hot), salted).otherwise(F.col("vslot"))), "salted")
        loads = slot_loads(records)
    out = sharded(records, next_map(docs.sparkSession, path, loads, shards, slots), ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
