"""Whole queries of operators that SQL cannot express, against plain Python on small tables."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sylva.llm import sharding, simhash, toxicity
from tests.llm.test_llm_small import documents, plain_fingerprint, word_text

tokenizers = pytest.importorskip("public_tokenizers")


# --- 2: SimHash ---------------------------------------------------------------------------------------------------------


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(31)
    texts, ids = [None, "", "one", " One "], [40, 30, 20, 10]
    for k in range(8):
        words = word_text(rng, 220).split()
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
            ids.append(None if rng.random() < 0.1 else rng.randrange(1000))
    fps = [plain_fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {g: min((i for i, h in zip(ids, group) if h == g and i is not None), default=None) for g in group}
    expected = Counter((i, f"{f:016x}", least[g]) for i, f, g in zip(ids, fps, group))
    assert len(set(group)) > 5
    assert Counter(tuple(r) for r in simhash.near_duplicates(documents(spark, texts, ids)).collect()) == expected


# --- 3: sharding --------------------------------------------------------------------------------------------------------


def draw(key, level, child, weight):
    h = 42
    if key is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
    h = xxhash.xxh64_intdigest(level.encode(), h)
    h = xxhash.xxh64_intdigest(struct.pack("<i", child), h)
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


def plain_shard(key, shards):
    regions = defaultdict(lambda: defaultdict(list))
    for s in range(shards):
        regions[s // 8][s // 4].append(s)
    weight = lambda racks: sum(len(x) for x in racks.values())
    region = min(regions, key=lambda r: draw(key, "region", r, weight(regions[r])))
    racks = regions[region]
    rack = next(iter(racks)) if len(racks) == 1 else min(racks, key=lambda k: draw(key, "rack", k, len(racks[k])))
    return racks[rack][0] if len(racks[rack]) == 1 else min(racks[rack], key=lambda s: draw(key, "shard", s, 1.0))


def test_shards_equal_plain_draws(spark):
    ids = [*range(-5, 300), None, 2**62, -(2**63)]
    rows = sharding.shard_documents(documents(spark, ["t"] * len(ids), ids)).collect()
    assert {(r["doc_id"], r["shard"], r["grown_shard"]) for r in rows} == {(i, plain_shard(i, 24), plain_shard(i, 25)) for i in ids}


def test_slots_of_a_row_that_is_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    texts, ids = ["same"] * 100 + [f"t{i}" for i in range(200)], [None] * 100 + [4] * 100 + list(range(100))
    rows = sharding.shard_documents(documents(spark, texts, ids)).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in rows) == Counter((i, zlib.crc32(t.encode())) for i, t in zip(ids, texts))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- 5: toxicity --------------------------------------------------------------------------------------------------------


def test_scores_equal_a_double_loop(spark):
    rng = random.Random(12)
    texts = [word_text(rng, 40) for _ in range(30)] + ["", None, "Abcd abcd ABCDEFGH"]
    known = sorted({t for x in texts for t in toxicity.terms(x)})[::2]
    state = np.random.default_rng(3)
    weights, factors = state.normal(0, 0.3, len(known)), state.normal(0, 0.3, (len(known), 5))
    machine = toxicity.Machine({t: i for i, t in enumerate(known)}, -0.4, weights, factors)
    for r in toxicity.score_documents(documents(spark, texts), machine).collect():
        at = sorted(machine.index[t] for t in toxicity.terms(texts[r["doc_id"]]) if t in machine.index)
        z = -0.4 + sum(weights[i] for i in at)
        for x, i in enumerate(at):
            for j in at[:x]:
                z += sum(float(a) * float(b) for a, b in zip(factors[i], factors[j]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_repeated_ids_do_not_multiply_the_sample(spark):
    texts = ["vile words here"] * 300 + [f"fine text number {i}" for i in range(300)]
    ids = [1] * 300 + list(range(2, 302))
    docs = documents(spark, texts, ids)
    marks = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(1, 302)], "doc_id long, quality int, toxic int")
    seen = []
    original = toxicity.train
    toxicity.train = lambda rows, *rest: seen.append(len(rows)) or original(rows, *rest)
    try:
        toxicity.fit(docs, marks, toxicity.Settings(min_docs=1, min_chi2=0.0))
    finally:
        toxicity.train = original
    assert seen and seen[0] <= 602


def test_keep_clean_reads_other_types(spark):
    rows = spark.createDataFrame([(1, b"one", {"a": 1}), (2, None, None)], "doc_id long, text binary, extra map<string,int>")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(rows, marks)
    assert kept.schema == rows.schema and kept.count() == 2
