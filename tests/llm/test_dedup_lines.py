"""The bit-parallel distance, families of lines that share most of their text, and what is removed from whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from sylva.llm import linededup
from tests.llm.test_llm_small import documents, edit, word_text


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_within_equals_the_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("a", ""), ("ab", "ba"), ("😀x", "x")]
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = a
        for _ in range(rng.randint(0, edits + 2)):
            k = rng.randint(0, len(b))
            b = rng.choice([b[:k] + b[k + 1 :], b[:k] + rng.choice("abé") + b[k:], b[:k] + rng.choice("abé") + b[k + 1 :]])
        pairs.append((a, b) if len(a) >= len(b) else (b, a))
    rows = spark.createDataFrame(pairs, "a string, b string")
    letters = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    found = rows.select("a", "b", linededup.within(letters("a"), letters("b"), edits).alias("near")).collect()
    for r in found:
        assert r["near"] == (edit(r["a"], r["b"]) <= edits), r


@pytest.mark.parametrize("hot", [32, 4])
def test_a_family_of_lines(spark, hot):
    """Lines alike but for three digits: most share most segments, so most keys are too common."""
    rng = random.Random(3)
    lines = [f"record {n:03d} of the register of all ships" for n in rng.sample(range(1000), 250)]
    rows = linededup.line_classes(documents(spark, lines), hot=hot).collect()
    group = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            if group[i] != group[j] and sum(x != y for x, y in zip(a, lines[j])) <= 1:
                a_, b_ = group[i], group[j]
                group = [min(a_, b_) if g in (a_, b_) else g for g in group]
    assert {r["doc_id"]: r["class_doc_id"] for r in rows} == dict(enumerate(group))


def plain_dedup(rows, edits=1, least=24):
    """Texts of (doc_id, text) without lines that are near an earlier one, by all pairs of lines."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, linededup_hash(r[1])))
    places = [((i, t), k, x.strip(" ")) for i, t in order for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    group = list(range(len(places)))
    for i, (_, _, a) in enumerate(places):
        for j in range(i):
            b = places[j][2]
            near = a == b or (min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and edit(a, b) <= edits)
            if near and group[i] != group[j]:
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    gone = {(doc, k) for n, (doc, k, _) in enumerate(places) if group[n] != n}
    return [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if ((i, t), k) not in gone)) for i, t in rows]


def linededup_hash(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_whole_texts_equal_all_pairs(spark):
    rng = random.Random(17)
    pool = [word_text(rng, 7) for _ in range(12)] + ["All rights reserved.", "Menu", ""]
    rows = []
    for k in range(40):
        own = [rng.choice(pool) for _ in range(rng.randint(1, 6))]
        own = [x[:9] + "#" + x[10:] if len(x) > 24 and rng.random() < 0.3 else x for x in own]
        rows.append((rng.choice([None, 3, 3, k, k + 100]), "\n".join(own)))
    rows += [rows[0], (None, None), (5, "")]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    found = sorted(((r["doc_id"], r["text"]) for r in linededup.dedup_lines(docs).collect()), key=str)
    assert found == sorted(plain_dedup(rows), key=str)


def test_short_lines_go_where_they_repeat(spark):
    docs = documents(spark, ["All rights reserved.\none", "two\n\n  All rights reserved.", "All rights reserved!\n\none"])
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert out == {0: "All rights reserved.\none", 1: "two\n", 2: "All rights reserved!\n"}


def test_texts_without_an_id_lose_their_own_lines_only(spark):
    common = "a common line that is long enough to take part"
    docs = documents(spark, [f"{common}\nonly in one of both texts", f"only in the other of both\n{common}", f"{common}\nL"], [None, None, 7])
    out = [r["text"] for r in linededup.dedup_lines(docs).collect()]
    assert sum(t.count(common) for t in out) == 1
    assert sum(t.count("only in one") for t in out) == sum(t.count("only in the other") for t in out) == sum(t.count("L") for t in out) == 1


def test_clashing_columns_stay(spark):
    rows = spark.createDataFrame([(1, "x\nx", {"a": 1}, 5, 6)], "doc_id long, text string, __gone map<string,int>, __doc int, head int")
    out = linededup.dedup_lines(rows)
    assert out.columns == rows.columns and out.first()["text"] == "x" and out.first()["__doc"] == 5
