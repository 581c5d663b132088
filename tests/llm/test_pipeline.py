"""The pipeline's stages against brute force on what each got."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from test_operators import awkward, by_brute_force, docs, targets
from tidemill.llm import base, language

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def survivors(rows, percent=80):
    """Of each group of similar rows the one with the smallest id, null last, and the first of equals."""
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return [r for i, r in enumerate(rows) if label[i] == i]


def clean(rows, items):
    return [r for r in rows if not any(s and len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)]


def mixed(rows):
    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    out = Counter()
    for (i, t, s, c), n in by_brute_force([(r.doc_id, r.text, r.source) for r in rows], size, targets(size, weight)).items():
        out[i, t, s] += n * c
    return +out


def decoded(model, text):
    """The language of a text by the codeword of least loss, gram by gram; None if ambiguous."""
    b = bytes(32 if c < 97 or 123 <= c < 128 else c for c in (text or "").lower().encode())
    x = np.zeros(language.DIM, np.float64)
    for size in (2, 3):
        for i in range(len(b) - size + 1):
            gram = 0
            for c in b[i : i + size]:
                gram = (gram * 257 + c) % 2**32
            x[(gram * 2654435761 + size) % 2**32 >> 20] += 1
    x = np.sqrt(x) / max(np.sqrt(x.sum()), 1e-12)
    loss = []
    for word in model["code"]:
        loss.append(sum(np.log1p(np.exp(-m)) for m in (x @ model["w"] + model["b"]) * word))
    share = np.exp(-np.array(loss) + min(loss))
    return model["langs"][int(np.argmin(loss))], 1 / share.sum()


def test_language_decoding_by_brute_force(spark):
    table = base.table(spark, SF, "documents")
    model = language.train(table)
    text = {r.doc_id: r.text for r in table.collect()}
    for r in language.identify(table, model).collect():
        if r.lang_pred != language.UNKNOWN:
            lang, score = decoded(model, text[r.doc_id])
            assert (r.lang_pred, r.ambiguous) == (lang, r.score < 0.5) and abs(score - r.score) < 1e-3
        else:
            assert not any(map(str.isalpha, text[r.doc_id] or ""))


def test_stages(spark):
    start = base.table(spark, SF, "documents")
    columns, kept, now = start.columns, [start.collect()], start
    for name, stage in corpus_pipeline.STAGES:
        now = base.stored(stage(spark, now, SF), name)
        kept.append(now.collect())
        assert name == "shard" or now.columns == columns
    given, known, dedup, uncontaminated, mix, shards = kept
    model = language.train(start)
    clear = {r.doc_id for r in language.identify(start, model).collect() if not r.ambiguous}
    assert sorted(r.doc_id for r in known) == sorted(clear) and len(known) >= 0.97 * len(given)
    assert Counter(dedup) == Counter(survivors(known))
    items = [shingles(r.text) for r in base.table(spark, SF, "benchmark").collect()]
    assert Counter(uncontaminated) == Counter(clean(dedup, items))
    assert Counter((r.doc_id, r.text, r.source) for r in mix) == mixed(uncontaminated)
    check_shards(mix, shards)


def check_shards(rows, shards):
    data = lambda r: (r.text or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in shards) == Counter((r.doc_id, len(data(r)) + 8, zlib.crc32(data(r))) for r in rows)
    places = {}
    for r in shards:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(0 <= s < 24 for s in places)


@pytest.mark.parametrize("name", list(STAGES))
def test_awkward_tables(spark, name):
    item = base.table(spark, SF, "benchmark").first().text
    own = docs(spark, [(None, item, "en", "a"), (31, f"{item} and more", "en", None), (31, f"{item} and more", "en", None), (None, None, None, None)])
    rows = awkward(spark).union(own).withColumnRenamed("id", "row_key").withColumnRenamed("row", "Row_Key_")
    out = STAGES[name](spark, rows, SF)
    got, given = out.collect(), rows.collect()
    if name == "shard":
        return check_shards(given, got)
    assert out.columns == rows.columns
    if name == "near_dedup":
        assert Counter(got) == Counter(survivors(given))
    elif name == "decontaminate":
        assert Counter(got) == Counter(clean(given, [shingles(r.text) for r in base.table(spark, SF, "benchmark").collect()]))
        assert not any(item in (r.text or "") for r in got) and any(r.doc_id is None for r in got)
    elif name == "mix":
        assert Counter((r.doc_id, r.text, r.source) for r in got) == mixed(given)
    else:
        clear = language.identify(rows, language.train(rows)).where("not ambiguous")
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in clear.collect())
        assert not any(not any(map(str.isalpha, r.text or "")) for r in got)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, name):
    assert STAGES[name](spark, docs(spark, []), SF).collect() == []
