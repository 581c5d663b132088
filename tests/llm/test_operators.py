"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute
force, round trips or held-out accuracy where SQL cannot express it."""

import hashlib
import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import base, chat, decontaminate, language, mixing, multi_index, near_dup, queries, sharding, substring_dedup, training_order, warc

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, id long, chunk int, row string"
LONG = " ".join(f"word{i}" for i in range(30_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "x", 1, 2, "y") for i, t, lang, s in rows], DOCS)


def awkward(spark):
    same = " ".join(f"w{i}" for i in range(80))
    return docs(spark, [
        (1, same, "en", "a"), (2, same, "en", "a"), (2, same, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "de", "b"),
        (6, "one two", "en", None), (7, "one two", "en", "c"), (None, same, "en", "a"), (8, LONG, "en", "c"), (9, LONG + " end", None, "c"), (10, "!!! 123", "en", "c"),
    ])


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) & set(queries.QUERIES)))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_substring_dedup(spark):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, len(r.text)) for r in substring_dedup.remove_repeats(awkward(spark)).collect())
    assert [x[:3] for x in got] == [(0, 80, 0), (1, 80, 0), (2, 80, 80), (2, 80, 80), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 2, 0), (7, 2, 0), (8, 30000, 0), (9, 30001, 30000), (10, 2, 0)]
    assert substring_dedup.remove_repeats(docs(spark, [])).collect() == []


def test_near_duplicates(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(awkward(spark)).collect()}
    assert {(1, 76, 1, True), (2, 76, 1, False), (None, 76, None, True), (3, 0, 3, True), (4, 0, 4, True), (6, 1, 6, True), (7, 1, 6, False), (8, 29996, 8, True), (9, 29997, 8, False)} <= got
    assert near_dup.near_duplicates(docs(spark, [])).collect() == []


def test_near_duplicates_with_few_common_classes(spark, monkeypatch):
    usual = sorted(map(tuple, near_dup.near_duplicates(awkward(spark)).collect()), key=str)
    monkeypatch.setattr(near_dup, "COMMON", 3)
    assert sorted(map(tuple, near_dup.near_duplicates(awkward(spark)).collect()), key=str) == usual


def test_near_duplicates_find_chains(spark):
    rng = np.random.default_rng(0)
    words = [f"v{i}" for i in rng.integers(0, 10**6, 400)]
    rows = []
    for i in range(60):  # each differs from its neighbours by a few words, and much from those far away
        rows.append((i, " ".join(words), "en", "a"))
        words = list(words)
        for p in rng.choice(len(words), 4, replace=False):
            words[p] = f"n{i}_{p}"
    got = near_dup.near_duplicates(docs(spark, rows)).collect()
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t, _, _ in rows for w in [t.split()]}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    assert {r.doc_id: r.component_id for r in got} == label


@pytest.mark.parametrize("long_set", [near_dup.LONG_SET, 100])
def test_near_duplicates_in_a_large_group_near_the_threshold(spark, monkeypatch, long_set):
    """Variants of one text of which most pairs are just below the threshold, and some chains of them above."""
    monkeypatch.setattr(near_dup, "LONG_SET", long_set)
    monkeypatch.setattr(near_dup, "TILE", 16)
    rng = np.random.default_rng(4)
    base_words, rows = [f"b{i}" for i in range(150)], []
    for i in range(90):
        words = list(base_words)
        for p in rng.choice(150, 3 + i % 2, replace=False):
            words[p] = f"n{i}_{p}"
        rows.append((i, " ".join(words), "en", "a"))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows), percent=80).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t, _, _ in rows for w in [t.split()]}
    label, links = {i: i for i in sets}, 0
    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                links += 1
                lo, hi = sorted((label[x], label[y]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    assert got == label and links < 90 * 89 / 4


def test_near_duplicates_at_a_lower_threshold(spark):
    """Bands for 0.85 miss this pair, which is alike to 0.8 exactly (16 of 20 shingles)."""
    words = [f"s12571w{i}" for i in range(22)]
    rows = [(1, " ".join(words), "en", "a"), (2, " ".join([*words[:20], "x", "y"]), "en", "a")]
    for percent, component in ((80, 1), (81, 2)):
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows), percent=percent).collect()}
        assert got == {1: 1, 2: component}


def test_bands_follow_the_threshold():
    assert near_dup.band_rows(0.85) == 6
    for t in (0.5, 0.7, 0.8, 0.85, 0.9):
        assert (1 - t ** near_dup.band_rows(t)) ** (near_dup.HASHES // near_dup.band_rows(t)) <= near_dup.MISS


def test_pruning_bound():
    need = near_dup.least_matches(0.85)
    assert list(need) == [36, 72, 108, 144, 180] and all(m < 0.85 * n for n, m in need.items())


def test_chat(spark):
    rows = [(1, 0, "user", "a: </turn> ### b \\h"), (1, 1, "assistant", None), (1, 2, None, "x"), (None, 0, "assistant", "é\\"), (2, None, "assistant", "q"), (2, 0, "assistant", "q"), (3, 0, "us: er", "only")]
    examples = chat.prefix_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", base.F.lit(1)))
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na: </turn> ### b \\h\nassistant\n\n\nx\n") and got[1].loss_chars == 0
    assert got[None].loss_sha256 == sha("é\\") and got[None].loss_chars == 2
    assert got[2].n_turns == 2 and got[2].loss_sha256 == sha("qq")
    assert got[3].turns_sha256 == sha("us: er\nonly\n") and got[3].loss_sha256 == sha("")
    assert chat.prefix_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_chat_with_long_texts_and_ties(spark):
    """Very long texts full of marks, and repeated rows, which are turns of their own."""
    long = "### a: </turn>\n\\" * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (1, 2, "user", "")]
    got = chat.digests(chat.prefix_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got] == [(4, sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows)), 2 * len(long), sha(long * 2))]


def test_decontaminate(spark):
    item = " ".join(f"Q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item, "z"), (2, None, "z"), (3, "", "z"), (4, "one two", "z"), (None, item, "z")], "item_id long, text string, h string")
    rows = [(20, f"{LONG} {item.lower()} {LONG}", "en", "a"), (21, " ".join(item.split()[:10]), "en", "a"), (22, " ".join(item.split()[:17]), "en", "a"), (22, item, "en", "a")]
    got = {(r.doc_id, r.item_id, r.shared) for r in decontaminate.contained_items(awkward(spark).union(docs(spark, rows)), bench).collect()}
    assert got == {(6, 4, 1), (7, 4, 1), (20, 1, 16), (22, 1, 16)}
    assert decontaminate.contained_items(docs(spark, []), bench).collect() == [] == decontaminate.contained_items(awkward(spark), bench.limit(0)).collect()


def targets(size, weight, cap=3.0):
    """By dealing the rest by weight until no source is above its cap."""
    target, total, open_ = {}, float(sum(size.values())), set(size)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= cap * size[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: cap * size[s] for s in full}
        open_ -= full
    return target


def by_brute_force(rows, size, target, seed=8):
    """How often the mix takes each row, as a multiset of (doc_id, text, source, copies): row by row, in the seeded order."""
    out = Counter()
    for source in size:
        docs_ = sorted(((hashlib.md5(f"{seed}:{'null' if i is None else i}:{t or ''}".encode()).hexdigest(), len((t or "").split()), i, t) for i, t, s in rows if s == source), key=lambda x: x[:2])
        whole = int(target[source] // size[source]) if size[source] else 0
        rest, start, most, taken, least = target[source] - whole * size[source], 0, float("inf"), set(), []
        while True:
            stop = None
            for n in range(start, len(docs_)):
                if docs_[n][1] <= most:
                    if docs_[n][1] > rest:
                        stop = n + 1
                        break
                    rest -= docs_[n][1]
                    taken.add(n)
            least.append(rest)
            if stop is None or min(rest, most / 2) < 1:
                break
            start, most = stop, min(rest, most / 2)
        near = [(abs(d[1] - rest), d[0], n) for n, d in enumerate(docs_) if n not in taken and d[1] > 0 and abs(d[1] - rest) < rest]
        taken |= {min(near)[2]} if near else set()
        for n, (_, words, i, t) in enumerate(docs_):
            out[i, t, source, whole + (n in taken and words > 0)] += 1
    return out


def check_mix(spark, data, weights=(1, 2, 3)):
    rows = [(r.doc_id, r.text, r.source) for r in data.select("doc_id", "text", "source").collect()]
    size, largest = Counter(), Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
        largest[s] = max(largest[s], len((t or "").split()))
    order = sorted(size, key=lambda s: (s is None, s))
    target = targets(size, {s: weights[i % len(weights)] for i, s in enumerate(order)})
    out = mixing.mix_sources(data, weights=weights).collect()
    assert len(out) == len(rows) and all(r.taken == r.copies * r.size <= 3 * r.size and r.copies <= 3 for r in out)
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] for r in out)
    kept = mixing.mixed_documents(data, weights=weights)
    assert kept.columns == data.columns
    copies, want = Counter(), Counter()
    for (i, t, s, c), n in by_brute_force(rows, size, target).items():
        copies[i, len((t or "").split()), s, c] += n
        want[i, t, s] += n * c
    assert Counter((r.doc_id, r.size, r.source, r.copies) for r in out) == copies
    assert Counter((r.doc_id, r.text, r.source) for r in kept.collect()) == +want
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
    return target, taken, largest


def test_mixing(spark):
    target, taken, largest = check_mix(spark, awkward(spark))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert mixing.mix_sources(docs(spark, [])).collect() == [] == mixing.mixed_documents(docs(spark, [])).collect()
    blank = mixing.mix_sources(docs(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0)] * 2


def test_mixing_comes_near(spark):
    """Each source by itself, within one document of its target."""
    target, taken, largest = check_mix(spark, base.table(spark, SF, "documents"))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_mixing_splits_repeated_rows(spark):
    """A third of the rows repeat one id, one text or both, and a third has no id."""
    rows = [(None, "a b c", "en", "a")] * 300 + [(7, "d e", "en", "a")] * 300 + [(i, f"x{i} y", "en", "a") for i in range(300)]
    rows += [(None, f"n{i} m m m", "en", "b") for i in range(200)] + [(5, "one two three", "en", None)] * 100
    target, taken, largest = check_mix(spark, docs(spark, rows).repartition(5), (1, 5, 2))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target), (target, taken)


def test_mixing_goes_on_past_giants(spark):
    """A giant first, and one at rank 300, of the seeded order; the seeded prefix alone would leave most of both targets."""
    size = {"a": lambda i: 1 + i % 39, "b": lambda i: 20, "c": lambda i: i % 61}
    place = lambda i, n: hashlib.md5(f"8:{i}:{' '.join(['w'] * n)}".encode()).hexdigest()
    giants = {"a": min(range(1000), key=lambda i: place(i, 20_000)), "b": sorted(range(1000), key=lambda i: place(i, 20_000))[300], "c": None}
    rows = docs(spark, [(i, " ".join(["w"] * (20_000 if i == g else size[s](i))), "en", s) for s, g in giants.items() for i in range(1000)])
    target, taken, _ = check_mix(spark, rows, (1, 1, 40))
    assert 7_000 < target["a"] < 15_000 and 7_000 < target["b"] < 15_000
    assert all(abs(taken[s] - target[s]) <= 10 for s in giants), (taken, target)


def test_sharding(spark):
    path = base.scratch(spark, "map")
    rows = base.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    out = sharding.shard_documents(rows.withColumn("vslot", base.F.lit(1)), path).collect()
    places, sizes = defaultdict(list), Counter()
    for r in out:
        places[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) == set(range(24))
    data = lambda r: (r.text or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r.doc_id, len(data(r)) + 8, zlib.crc32(data(r))) for r in rows.collect())
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    # One text is larger than an even share; the other shards are equal but for less than the smallest document's bytes.
    even = sorted(sizes.values())[:22]
    assert max(even) - min(even) <= 64 and sum(sizes.values()) == sum(r.size for r in out)
    assert sharding.shard_documents(docs(spark, []), base.scratch(spark, "map")).collect() == []


def test_sharding_law(spark):
    out = sharding.shard_documents(base.table(spark, "/root/testdata/sf0.1", "documents"), base.scratch(spark, "map"))
    sizes = [r.size for r in out.groupBy("shard").agg(F.sum("size").alias("size")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.001 * min(sizes)


def test_sharding_edits_the_stored_map(spark):
    path = base.scratch(spark, "map")
    rows = base.table(spark, "/root/testdata/sf0.01", "documents")
    maps, before = {}, sharding.in_turn(24)
    for version, given in ((2, rows.where("doc_id % 2 = 0")), (3, rows), (4, rows)):
        out = sharding.shard_documents(given, path).collect()
        maps[version] = [r.shard for r in sharding.load_map(spark, path, version).orderBy("vslot").collect()]
        assert sharding.last_version(spark, path) == version and all(maps[version][r.vslot] == r.shard for r in out)
        assert sum(a != b for a, b in zip(before, maps[version])) < 1000  # most slots stay
        before = maps[version]
    assert maps[3] == maps[4]
    with pytest.raises(ValueError):
        sharding.shard_documents(rows, path, slots=64)


def test_sharding_splits_hot_ids(spark):
    """A third of the rows has no id, and a third has one id."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, 7).alias("doc_id"), F.lit("same text").alias("text"))
    out = sharding.shard_documents(rows, base.scratch(spark, "map"))
    sizes = Counter({r.shard: r.size for r in out.groupBy("shard").agg(F.sum("size").alias("size")).collect()})
    assert len(sizes) == 24 and max(sizes.values()) < 1.05 * min(sizes.values())
    assert out.groupBy("vslot").count().agg(F.max("count")).first()[0] < 100
    assert out.count() == 30_000 == out.select("shard", "slot").distinct().count()


def test_rebalancing(spark):
    rng = np.random.default_rng(1)
    loads = [(s, int(n), 1) for s, n in enumerate(rng.integers(1, 1000, 512))]
    first = sharding.rebalanced(sharding.in_turn(8, 512), loads, 8)
    more = sharding.rebalanced(first, loads, 9)
    for shards, placed in ((8, first), (9, more)):
        total = Counter()
        for s, n, _ in loads:
            total[placed[s]] += n
        assert len(total) == shards and max(total.values()) < 1.001 * min(total.values())
    assert sum(a != b for a, b in zip(first, more)) < 512 / 9 * 1.8
    assert set(sharding.rebalanced(more, loads, 4)) == set(range(4))
    path = base.scratch(spark, "maps")
    sharding.store_map(spark, path, 1, first, loads)
    sharding.store_map(spark, path, 2, more, loads)
    assert [r.shard for r in sharding.load_map(spark, path, 2).orderBy("vslot").collect()] == more and sharding.last_version(spark, path) == 2


def test_language(spark):
    all_docs = base.table(spark, "/root/testdata/sf0.01", "documents")
    model = language.train(all_docs)
    lang = {r.doc_id: r.lang for r in all_docs.collect()}
    out = language.identify(all_docs, model).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
    got = language.identify(awkward(spark), model).collect()
    assert len(got) == 12 and {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 10} and all(0 <= r.score <= 1 for r in got)
    kept = language.known_language(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and not {3, 4, 5, 10} & {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in language.identify(awkward(spark), language.train(docs(spark, []))).collect()} == {"und"}
    assert len({tuple(r) for r in language.codewords(9)}) == 9 and language.codewords(4).shape == (4, 7) and language.codewords(1).shape[0] == 1


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_multi_index_recall(spark, sf):
    emb = base.table(spark, f"/root/testdata/sf{sf}", "embeddings")
    rows = emb.collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in multi_index.search(emb).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]].tolist()) & {v for v, _ in got[q]})
        assert len(got[q]) == 20 and all(a[1] >= b[1] for a, b in zip(got[q], got[q][1:]))
        assert all(abs(s - x[ids == v][0] @ x[ids == q][0]) < 1e-12 for v, s in got[q])
    assert hits >= 0.9 * 20 * len(got)


def routing(spark):
    index = multi_index.build(base.table(spark, "/root/testdata/sf0.1", "embeddings"))
    queries = multi_index.queries_of(index, 20)
    index.enough = multi_index.measured(index, queries, 20, 0.94)
    return index, queries.count(), multi_index.routed(index, queries).collect()


def test_multi_index_prunes(spark):
    """A query sees about half of the entries, as these vectors have next to no structure."""
    index, n, sent = routing(spark)
    assert index.enough <= 0.55 * index.n
    assert sum(int(index.counts[c]) for r in sent for c in r.cells) <= 0.56 * index.n * n


def test_multi_index_leaves_blocks_out(spark, monkeypatch):
    """Where cells are larger than blocks, as on large tables, a query goes to as many of the blocks as of the cells."""
    monkeypatch.setattr(multi_index, "MOST_CENTROIDS", 8)
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    index, n, sent = routing(spark)
    first, width = index.blocks()
    assert len(sent) <= 0.8 * int((first + width).max()) * n


def test_multi_index_with_a_hot_query_id(spark):
    """One id on half of the rows, far from all others: its own rows do not count as found."""
    rng = np.random.default_rng(5)
    rows = [(i * 20 + 1, rng.normal(size=8).tolist()) for i in range(2999)] + [(40, (rng.normal(size=8) * 0.01 + 50).tolist()) for _ in range(3000)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = multi_index.search(emb).collect()
    assert [r.rank for r in sorted(out, key=lambda r: r.rank)] == list(range(1, 21)) and all(r.query_id == 40 != r.vec_id for r in out)


def test_multi_index_edges(spark):
    kind = "vec_id long, embedding array<float>, label int, id long, v string"
    rows = [(0, [1.0, 0.0, 0.0], 1), (20, [0.0, 2.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], None), (3, [0.0, 0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0, 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [0.5], 1), (8, [3.0, 0.0, 0.0, 4.0], 1), (9, [], 1), (None, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1)]
    out = multi_index.search(spark.createDataFrame([(*r, 0, "x") for r in rows], kind)).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == 0) == [(1, 8, 3.0), (2, 1, 1.0), (3, 1, 1.0), (4, 2, 1.0), (5, 7, 0.5), (6, 20, 0.0)]
    assert multi_index.search(spark.createDataFrame([], kind)).collect() == []


def test_permutation():
    for n in (1, 2, 5, 1000, 4097):
        assert sorted(training_order.permuted(np.arange(n), n, 7).tolist()) == list(range(n))
    mask = (1 << 64) - 1

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    def walked(x, n, key):
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for r in range(4):
                left, right = right, left ^ mix(right ^ mix(key ^ (r * 0x9FB21C651E98DF25 & mask))) & ((1 << half) - 1)
            x = left << half | right
            if x < n:
                return x

    assert training_order.permuted(np.arange(1000), 1000, 5).tolist() == [walked(i, 1000, 5) for i in range(1000)]


def test_training_order(spark):
    folder = base.scratch(spark, "order")
    rows = base.table(spark, SF, "documents").select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    manifest = training_order.write_order(rows, folder, per_shard=100)
    out = training_order.read_order(manifest, folder, per_shard=100).collect()
    assert sorted(r.slot for r in out) == list(range(len(out))) and manifest.agg(F.sum("records")).first()[0] == len(out)
    with open(training_order.VOCABULARY, "rb") as f:
        t = training_order.Tokenizer(training_order.load_ranks(f.read()))
    want = []  # in the order of the numbers: by id, null first, and the text's hash
    for r in sorted(rows.withColumn("digest", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.digest)):
        if r.text:
            ids = [*t.encode(r.text), t.end]
            for p in range(0, len(ids), 256):
                part = np.array(ids[p : p + 256], "<u2")
                want.append((r.doc_id, p // 256, len(part), zlib.crc32(part.tobytes())))
    slots = training_order.permuted(np.arange(len(want)), len(want), 2).tolist()
    assert {s: w for s, w in zip(slots, want)} == {r.slot: (r.doc_id, r.piece, r.n_tokens, r.tokens_crc32) for r in out}
    later = training_order.read_order(manifest, folder, per_shard=100, start=150).collect()
    assert sorted(r.slot for r in later) == list(range(150, len(out)))
    assert training_order.ordered_round_trip(docs(spark, [])).collect() == []


def test_training_order_does_not_depend_on_files(spark):
    rows = base.table(spark, SF, "documents").select("doc_id", "text")
    relaid = base.stored(rows.orderBy(F.xxhash64("text")).repartition(5), "relaid")
    one, other = (sorted(map(tuple, training_order.ordered_round_trip(x).drop("shard").collect())) for x in (rows, relaid))
    assert one == other


def test_workers_need_no_package(tmp_path):
    """The functions that run in workers are shipped by value: here the workers' folder and path lack the package."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
for name in ("op2_training_order", "op6_language_id", "op9_warc_index"):
    assert __spark_entry__.queries()[name](spark, {SF!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]


def test_warc(spark):
    big, huge = "<p>" + "x" * 200, "é" * 3_000_000
    rows = [(1, "http://a.example.com/x?y=1#f", big), (2, "https://b.example.com:81/", big), (2, "https://b.example.com:81/", big), (3, None, None), (None, "not a url [", big), (4, "http://a.example.com/x?y=1", "short"), (5, "http://é.example/ space\r\nX: y", "short"), (1, "http://a.example.com/x?y=1", big), (9, "http://a.example.com/x", huge), (8, "http://a.example.com/x!", huge)]
    folder = base.scratch(spark, "warc")
    pages = spark.createDataFrame([(*r, "c", 7) for r in rows], "page_id long, url string, html string, digest string, row int")
    files = warc.write_archives(pages, folder, block_lines=2, date="2020-02-02T00:00:00Z")
    out = warc.read_captures(warc.resolve(pages, files, folder), folder).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out) == Counter([
        (1, "response", None, 203), (1, "revisit", 1, 203), (2, "revisit", 1, 203), (2, "revisit", 1, 203), (3, "response", None, 0), (None, "response", None, 203), (4, "response", None, 5),
        (5, "response", None, 5), (8, "response", None, 6_000_000), (9, "revisit", 8, 6_000_000),
    ])
    found = warc.Captures(files, folder)
    assert {(r["page_id"], r["payload"]) for r in found.lookup("https://a.example.com/x?y=1")} == {(1, big.encode()), (1, None), (4, b"short")}
    assert len(found.lookup("http://b.example.com:81/")) == 2 and found.lookup("http://zzz.example.com/") == []
    all_ = [r for u in {u for _, u, _ in rows} for r in found.lookup(u or "")]
    ids = {r["record_id"] for r in all_}
    assert len(ids) == len(rows) and all(r["refers_to_record"] in ids for r in all_ if r["record_type"] == "revisit")
    assert warc.url_key("http://User@WWW.Example.com/a") == "com,example,www)/a"
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_warc_lookups_in_many_files(spark):
    """A URL with most captures, over blocks and index files, between others."""
    rows = [(i, "http://hot.example/" if i % 3 else f"http://h{i % 7}.example/{i}", f"page {i}") for i in range(3000)]
    folder = base.scratch(spark, "warc")
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, block_lines=50)
    urls = spark.createDataFrame([("http://hot.example/",), ("http://h0.example/21",), ("http://h0.example/22",), (None,)], "url string")
    got = warc.read_captures(warc.resolve(urls.union(urls), files, folder), folder).collect()
    assert sorted(r.page_id for r in got) == sorted([i for i, u, _ in rows if u == "http://hot.example/"] + [21])
