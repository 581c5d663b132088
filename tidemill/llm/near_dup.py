"""MinHash near-dedup with sequential Bayesian verification.

1. Every document gets its number of distinct k-word shingles, two hashes of its words and a MinHash signature.
   Equal word sequences become one class, whose smallest id stands for it, so copies never meet as pairs.
2. Signatures are cut into bands; classes that share a band's values are candidates. In each bucket every member meets
   the member that shares the most bands (a star), which links most groups with as many pairs as members.
3. A pair's signatures are compared in batches. After each batch the posterior probability that the similarity reaches the
   threshold, from a uniform prior, is bounded by the matches so far, and the pair is dropped when it is below the chosen
   miss probability. Survivors are verified on their whole shingle sets.
4. Connected components over the links. Buckets that still hold several components are then compared between components,
   in square tiles of bounded size that are spread over tasks: first each member with its likeliest partner, which joins
   most of what belongs together, and then in full, so that no link is lost. Here the sequence of batches goes on four
   times as far, over signatures of one byte a hash; chance matches of bytes can only keep a pair. A pair that meets in
   several buckets is told in one. Each tile's survivors are listed by member and verified together, in the tile: a large
   group of documents just below the threshold has many of them, and no row is made for a pair but for a link that joins
   two components. Components are found again over all links.

Sets whose sizes alone keep their similarity below the threshold are no candidates. Every step's tables go as soon as the
next step is stored, so the disk holds a step or two and not the whole run.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import drop, small, stored
from .textkit import U, Words, mix, rolling, sequences, slices

HASHES = 180
BATCH = 36
#: Hashes of the byte signatures that decide between components.
FURTHER = 4 * HASHES
MISS = 1e-6
TILE = 512
#: Members with more shingles than this are verified pair by pair, so that the sets of a tile fit in memory.
LONG_SET = 8192
#: A class that holds more than one row in so many is handed to all tasks instead of being shuffled with its copies.
COMMON = 10_000


def shingle_sets(words: Words, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each row's sorted distinct shingle hashes, and two hashes of its whole word sequence."""
    h, first = words.hashes(), words.first
    runs = rolling(h, k)
    whole, other = sequences(h, first), sequences(words.hashes(1), first, 1)
    sets = []
    for i in range(len(first) - 1):
        lo, hi = first[i], first[i + 1]
        sets.append(np.unique(runs[lo : hi - k + 1]) if hi - lo >= k else whole[i : i + 1] if hi > lo else runs[:0])
    return sets, whole, other


def band_rows(threshold: float, miss: float = MISS) -> int:
    """The most values a band may have, so that a pair at the threshold shares no band with a probability of at most
    ``miss``: 30 bands of 6 for 0.85 (7e-7), 36 of 5 for 0.8 (6e-7)."""
    return max((r for r in range(1, HASHES + 1) if HASHES % r == 0 and (1 - threshold**r) ** (HASHES // r) <= miss), default=1)


def multipliers(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    return a[:, None], mix(a ^ U(0xA5A5A5A5A5A5A5A5))[:, None]


def least_hashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, U)
    for at in range(0, len(s), 256):
        x = a * s[None, at : at + 256]
        x += b
        np.minimum(least, x.min(axis=1), out=least)
    return least


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (least_hashes(s, a, b) >> U(32)).astype("<u4")


def sketched(k: int):
    def run(batches):
        a, b = multipliers()
        for batch in batches:
            for piece in slices(batch, "text"):
                sets, whole, other = shingle_sets(Words(piece.column("text"), lower=True), k)
                sig = [signature(s, a, b).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole.view(np.int64)), pa.array(other.view(np.int64)), pa.array(sig, pa.binary())],
                    names=["doc_id", "n", "a", "b", "sig"],
                )

    return run


def byte_signatures(k: int, per_band: int):
    def run(batches):
        a, b = multipliers(FURTHER)
        for batch in batches:
            for piece in slices(batch, "text"):
                sets, _, _ = shingle_sets(Words(piece.column("text"), lower=True), k)
                least = [least_hashes(s, a, b) if len(s) else None for s in sets]
                sig = [x if x is None else x.astype("u1").tobytes() for x in least]
                keys = [x if x is None else band_keys((x[None, :HASHES] >> U(32)).astype("<u4"), per_band).tobytes() for x in least]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.binary())], names=["id", "n", "sig", "keys"])

    return run


def band_keys(sig: np.ndarray, per_band: int) -> np.ndarray:
    """The bucket of each band of each signature (a row of sig)."""
    sig = sig.reshape(-1, HASHES // per_band, per_band).astype(U)
    key = np.broadcast_to(np.arange(sig.shape[1], dtype=U) * U(0x9E3779B97F4A7C15), sig.shape[:2]).copy()
    for j in range(per_band):
        key = mix(key ^ sig[:, :, j])
    return key


def banded(per_band: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                key = band_keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, HASHES), per_band)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), key.shape[1])), pa.array(key.reshape(-1).view(np.int64))], names=["id", "key"])

    return run


def least_matches(threshold: float, miss: float = MISS, hashes: int = HASHES) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches that leave a posterior of at least ``miss`` that the
    similarity reaches the threshold: 1 - I_t(m + 1, n - m + 1), a binomial sum."""
    out = {}
    for n in range(BATCH, hashes + 1, BATCH):
        sums = itertools.accumulate(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(n + 2))
        out[n] = next(m for m, total in enumerate(sums) if total >= miss)
    return out


def survivors(x: np.ndarray, y: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Indices of the pairs (rows of x and y) that no batch prunes."""
    left, same = np.arange(len(x)), np.zeros(len(x), np.int32)
    for n in need:
        same = same + (x[left, n - BATCH : n] == y[left, n - BATCH : n]).sum(axis=1)
        keep = same >= need[n]
        left, same = left[keep], same[keep]
    return left


def prune_pairs(need):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, HASHES) for c in ("sig_x", "sig_y"))
                yield batch.select(["x", "y"]).take(pa.array(survivors(x, y, need)))

    return run


def alike(one: np.ndarray, sig: np.ndarray, others: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Those of the others (indices of sig) that no batch prunes against one."""
    same = np.zeros(len(others), np.int32)
    for n in need:
        same = same + (sig[others, n - BATCH : n] == one[n - BATCH : n]).sum(axis=1)
        keep = same >= need[n]
        others, same = others[keep], same[keep]
        if not len(others):
            break
    return others


TILE_KEY = ["key", "kind", "i", "j"]
LATE = "key long, kind int, i int, j int, id long, comp long, others binary, other long"


def prune_tile(need, likeliest: bool, bands: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """What survives in a tile of the pairs between the two sides (or within the one), of different components, but for
        those that meet in an earlier band too; if likeliest, only the one with the most matches for each member of the
        first side. A row for each member of such a pair, with the ids of those it is to be compared with; and a row for
        each pair with a long member (other)."""
        ids, comp, side, n = (table.column(c).to_numpy() for c in ("id", "comp", "side", "n"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "u1").reshape(-1, FURTHER)
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, bands)
        # The band that a member is here by; one that is here by another text of its id meets everything here.
        own = keys == table.column("key").to_numpy()[:, None]
        band = np.where(own.any(axis=1), own.argmax(axis=1), 0)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        others_of: dict[int, bytes | None] = {}
        pairs = []
        for i in left:
            others = right if len(right) else left if likeliest else left[left > i]
            others = others[(comp[others] != comp[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            good = alike(sig[i], sig, others, need)
            good = good[~((keys[good] == keys[i]) & (np.arange(bands) < np.minimum(band[good], band[i])[:, None])).any(axis=1)]
            if likeliest and len(good) > 1:
                good = good[[(sig[good] == sig[i]).sum(axis=1).argmax()]]
            long = (n[good] > LONG_SET) | (n[i] > LONG_SET)
            pairs += [(i, g) for g in good[long]]
            if not long.all():
                others_of[i] = ids[good[~long]].astype("<i8").tobytes()
                others_of.update((g, None) for g in good[~long].tolist() if g not in others_of)
        rows = np.array([*others_of, *(i for i, _ in pairs)], np.int64)
        where = [table.column(c)[:1].combine_chunks().take(pa.array(np.zeros(len(rows), np.int64))) for c in TILE_KEY]
        others = pa.array([*others_of.values(), *(None for _ in pairs)], pa.binary())
        other = pa.array([*(None for _ in others_of), *(int(ids[g]) for _, g in pairs)], pa.int64())
        return pa.table([*where, pa.array(ids[rows]), pa.array(comp[rows]), others, other], names=[*TILE_KEY, "id", "comp", "others", "other"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def verify_tile(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links among the members of a tile (id, comp, others, shingles) that join what is not joined yet."""
        sets: dict[int, set[bytes]] = {}
        others: dict[int, set[int]] = {}
        comp: dict[int, int] = {}
        for i, c, o, s in zip(*(table.column(c).to_pylist() for c in ("id", "comp", "others", "shingles"))):
            comp[i] = c
            sets.setdefault(i, set()).add(s)
            if o is not None:
                others.setdefault(i, set()).update(np.frombuffer(o, "<i8").tolist())
        arrays = {i: [np.frombuffer(s, U) for s in x] for i, x in sets.items()}
        parent = {c: c for c in comp.values()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out = []
        for x in sorted(others):
            for y in sorted(others[x]):
                a, b = root(comp[x]), root(comp[y])
                if a != b and any(similar(s, t, percent) for s in arrays[x] for t in arrays[y]):
                    parent[a] = b
                    out.append((min(x, y), max(x, y)))
        return pa.table({"x": pa.array([x for x, _ in out], pa.int64()), "y": pa.array([y for _, y in out], pa.int64())})

    return run


def set_rows(k: int):
    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                sets, _, _ = shingle_sets(Words(piece.column("text"), lower=True), k)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return run


def exact(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_x").to_pylist(), batch.column("set_y").to_pylist()):
                keep.append(similar(np.frombuffer(x, U), np.frombuffer(y, U), percent))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    sets = stored(docs.join(small(ids), "doc_id", "left_semi").mapInArrow(set_rows(k), "id long, shingles binary"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("set_x")), "x").join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("set_y")), "y")
    out = stored(both.mapInArrow(exact(percent), "x long, y long").distinct(), "links")
    drop(sets)
    return out


def verified_tiles(docs: DataFrame, late: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among what prune_tile has left (LATE), enough to join all that they join."""
    members = late.where("other is null")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    sets = stored(docs.join(small(ids), "doc_id", "left_semi").mapInArrow(set_rows(k), "id long, shingles binary"), "sets")
    out = stored(members.join(sets, "id").groupBy(*TILE_KEY).applyInArrow(verify_tile(percent), "x long, y long").distinct(), "links")
    drop(sets)
    pairs = late.where("other is not null").select(F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y")).distinct()
    return out.union(verified(docs, pairs, k, percent)) if pairs.limit(1).count() else out


def comparable(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can be alike at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (x, y). Alternates large-star and small-star
    steps, which keep components and end in stars; each round is stored. No links give no rows."""

    def step(edges: DataFrame, large: bool) -> DataFrame:
        rows = edges.union(edges.select("y", "x")) if large else edges
        least = rows.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        joined = rows.join(least, "x")
        if large:
            out = joined.where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        else:
            out = joined.select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y")))
        return out.where(F.col("x") != F.col("y")).distinct()

    edges = stored(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x != y").distinct(), "edges", links.count())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, old = now, edges
        # A large-star step makes no more edges than it gets, and a small-star step at most twice as many.
        edges = stored(step(step(edges, True), False), "edges", 2 * now[0])
        drop(old)
    pairs = edges.select(F.col("x").alias("id"), F.col("y").alias("component"))
    return pairs.union(edges.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct())


def apart(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """Tiles (key, kind, i, j) with their members (id, comp, side): of each bucket that holds several components, all of
    what is not with the hub meets everything that it is not with."""
    tagged = shared.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id"))
    mains = tagged.where("id = hub").select("key", F.col("comp").alias("main")).distinct()
    tagged = tagged.join(mains, "key").withColumn("away", F.col("comp") != F.col("main"))
    counts = tagged.groupBy("key").agg(F.sum(F.col("away").cast("long")).alias("away_n"), F.count("*").alias("n")).where("away_n > 0")
    tiles = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    placed = tagged.join(counts.select("key", tiles(F.col("away_n")).alias("ta"), F.greatest(tiles(F.col("n") - F.col("away_n")), F.lit(1)).alias("tm")), "key")
    placed = placed.withColumn("t", F.pmod(F.xxhash64("id"), F.when(F.col("away"), F.col("ta")).otherwise(F.col("tm"))).cast("int"))

    def spot(kind: int, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))

    t, zero, one = F.col("t"), F.lit(0), F.lit(1)
    among = F.transform(F.sequence(zero, F.col("ta") - 1), lambda j: spot(0, F.least(t, j), F.greatest(t, j), F.when(t <= j, 0).otherwise(1)))
    to_main = F.transform(F.sequence(zero, F.col("tm") - 1), lambda j: spot(1, t, j, zero))
    from_main = F.transform(F.sequence(zero, F.col("ta") - 1), lambda i: spot(1, i, t, one))
    return placed.select("key", "id", "comp", F.explode(F.when(F.col("away"), F.concat(among, to_main)).otherwise(from_main)).alias("x")).select("key", "id", "comp", "x.*")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Texts lower-case A-Z; words are runs of anything but white space; a text of fewer than k words has its whole sequence
    as one shingle. Documents are linked when 100 * intersection >= percent * union of their sets. Null, empty and blank
    texts have no shingles and are linked with nothing. Rows that share a doc_id are one node with the links of all; a
    row without doc_id is linked with nothing, and is kept. Other columns are ignored. An empty table gives no rows.
    """
    per_band = band_rows(percent / 100)
    docs = docs.select("doc_id", "text")
    rows = stored(docs.mapInArrow(sketched(k), "doc_id long, n long, a long, b long, sig binary"), "sketches")
    counts = stored(rows.select("doc_id", "n"), "counts")
    real = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = stored(real.groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    # Fewer than COMMON classes hold more than this share of the rows, so these may be broadcast; their copies stay spread.
    common = F.col("copies") * COMMON > total
    often = F.broadcast(classes.where(common).select("a", "b", "id"))
    named = real.select("doc_id", "a", "b")
    others = named.join(often, ["a", "b"], "left_anti").join(classes.where(~common).select("a", "b", "id"), ["a", "b"])
    members = stored(named.join(often, ["a", "b"]).union(others.select("a", "b", "doc_id", "id")).select("doc_id", "id").distinct(), "members")
    # The row of a class's smallest id stands for it; repeated rows are alike in all that is taken.
    sigs = real.join(classes.select(F.col("id").alias("doc_id"), "a", "b"), ["doc_id", "a", "b"], "left_semi").dropDuplicates(["doc_id", "a", "b"])
    sigs = stored(sigs.select(F.col("doc_id").alias("id"), "n", "sig"), "signatures")
    drop(rows, classes)
    bands = sigs.select("id", "sig").mapInArrow(banded(per_band), "id long, key long")
    bands = stored(bands.join(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "bands")
    # The member that shares the most leads its buckets: in a group of edited copies that is mostly their original.
    degree = bands.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = stored(bands.select("id", "key").join(degree, "id"), "ranked")
    drop(bands)
    hubs = ranked.groupBy("key").agg(F.min(F.struct(-F.col("degree"), F.col("id").alias("hub"))).alias("x")).select("key", "x.hub")
    shared = stored(ranked.select("key", "id").join(hubs, "key"), "shared")
    drop(ranked)
    need = least_matches(percent / 100)
    met = sigs.join(small(shared.select("id").distinct()), "id", "left_semi")
    stars = shared.where("id != hub").select(F.least("hub", "id").alias("x"), F.greatest("hub", "id").alias("y")).distinct()
    side = lambda name: met.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    pairs = stars.join(side("x"), "x").join(side("y"), "y").where(comparable(F.col("n_x"), F.col("n_y"), percent))
    pairs = stored(pairs.select("x", "y", "sig_x", "sig_y").mapInArrow(prune_pairs(need), "x long, y long"), "pairs")
    drop(sigs)
    reps = docs.where(F.col("doc_id").isNotNull())
    links = verified(reps, pairs, k, percent)
    drop(pairs)
    comp = components(links)
    # First every member's likeliest partner outside its component, and then whatever still is apart.
    further, met = least_matches(percent / 100, hashes=FURTHER), None
    for likeliest in (True, False):
        tiles = stored(apart(shared, comp), "tiles")
        if not tiles.limit(1).count():
            break
        if met is None:  # later tiles have no other members
            met = reps.join(small(tiles.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi").mapInArrow(byte_signatures(k, per_band), "id long, n long, sig binary, keys binary")
            met = stored(met.where("sig is not null").dropDuplicates(["id", "sig"]), "met")
        late = stored(tiles.join(met, "id").groupBy(*TILE_KEY).applyInArrow(prune_tile(further, likeliest, HASHES // per_band, percent), LATE), "apart")
        drop(tiles)
        if late.limit(1).count():
            links = stored(links.union(verified_tiles(reps, late, k, percent)), "links")
            comp = components(links)
        drop(late)
    drop(shared, *([met] if met is not None else []))
    mapped = stored(members.join(comp, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id")), "mapped")
    # A doc_id of several classes joins them all.
    several = mapped.groupBy("doc_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi"))
    if several.where("lo != hi").limit(1).count():
        joined = components(members.select(F.col("doc_id").alias("x"), F.col("id").alias("y")).union(links.select("x", "y")))
        several = members.select("doc_id").distinct().join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("lo"))
    out = counts.select("doc_id", F.col("n").alias("n_shingles")).join(several.select("doc_id", "lo"), "doc_id", "left")
    component = F.coalesce("lo", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
