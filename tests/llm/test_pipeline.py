"""The stages one by one, and the whole pipeline against its stages, on the smallest tables."""

import os

import pytest

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_stages_and_run(spark):
    import corpus_pipeline
    from sylva.llm import toxicity
    from sylva.llm.common import stored, table

    docs = table(spark, SMALL, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SMALL), f"test-{name}")
        assert out.columns == columns
        kept = {r["doc_id"] for r in out.collect()}
        assert kept <= ids
        if name == "toxicity":
            scores = toxicity.toxicity(docs, table(spark, SMALL, "labels")).collect()
            assert kept == {r["doc_id"] for r in scores if not r["predicted"]}
        if name == "line_dedup":
            assert kept == ids
        docs, ids = out, kept
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == ids
    for r in rows:
        assert r["length"] >= 1 and r["start"] + r["length"] <= r["doc_tokens"]


def test_registered_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def small_documents(spark):
    """Documents with toxic ones, repeated lines, near copies, null and repeated ids, over the columns of the table."""
    import random

    from tests.llm.test_llm_small import word_text

    rng = random.Random(41)
    lines = [word_text(rng, 9) for _ in range(6)]
    texts = []
    for k in range(14):
        words = word_text(rng, 90).split()
        texts.append(" ".join(words) + "\n" + rng.choice(lines))
        if k % 3 == 0:
            words[rng.randrange(90)] = "changed"
            texts.append(" ".join(words) + "\n" + rng.choice(lines))
    texts += [None, "", texts[0]]
    ids = [None if k % 7 == 3 else k % 15 for k in range(len(texts))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def plain_near(rows):
    """One row of each group of near copies, by all pairs of shingle sets."""
    import xxhash

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def hashed(i, t):
        parts = [(b"\0\0\0\0" if i is not None else b"\1\0\0\0")]
        h = xxhash.xxh64_intdigest(parts[0], 42)
        h = h if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), h)
        h = h if t is None else xxhash.xxh64_intdigest(t.encode(), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if group[i] != group[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return sorted((min((r for r, h in zip(rows, group) if h == g), key=lambda r: (r[0] is None, r[0] or 0, hashed(r[0], r[1])))
                   for g in set(group)), key=str)


def test_line_and_near_dedup_stages_equal_all_pairs(spark):
    import corpus_pipeline
    from tests.llm.test_dedup_lines import plain_dedup

    stages = dict(corpus_pipeline.STAGES)
    rows, docs = small_documents(spark)
    expected = sorted(plain_dedup([r[:2] for r in rows]), key=str)
    out = stages["line_dedup"](spark, docs, SMALL)
    assert out.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == expected
    kept = stages["near_dedup"](spark, docs, SMALL)
    assert sorted((tuple(r) for r in kept.collect()), key=str) == plain_near(rows)


def test_packing_stage_holds_all_ids(spark):
    import zlib
    from collections import Counter, defaultdict

    import corpus_pipeline
    import numpy as np
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rows, docs = small_documents(spark)
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    expected = Counter()
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        expected[i, len(ids)] += len(ids)
    found, windows = Counter(), defaultdict(int)
    for r in dict(corpus_pipeline.STAGES)["packing"](spark, docs, SMALL).collect():
        found[r["doc_id"], r["doc_tokens"]] += r["length"]
        windows[r["sequence_id"]] += r["length"]
        if r["length"] == r["doc_tokens"] and [x[0] for x in rows].count(r["doc_id"]) == 1:
            t = next(x[1] for x in rows if x[0] == r["doc_id"])
            whole = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            assert r["ids_crc32"] == zlib.crc32(whole.tobytes())
    assert found == expected and all(n == 4096 or n & (n - 1) == 0 for n in windows.values())
