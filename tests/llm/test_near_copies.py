"""The near-dedup stage against all pairs of a small table."""

import random

import numpy as np
import pytest

from sylva.llm import common, nearcopies, simhash
from tests.llm.test_llm_small import documents, word_text


@pytest.mark.parametrize("calm,hot", [(32, 2_000_000), (3, 2_000_000), (32, 700)])
def test_components_equal_all_pairs(spark, calm, hot):
    rng = random.Random(5)
    texts = [None, "", "one two", "One  two"]
    for _ in range(12):
        base = word_text(rng, 120).split()
        for _ in range(5):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    sets = [set(nearcopies.shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    docs = documents(spark, texts)
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.components(docs, calm, hot).collect()}
    assert found == {i: find(i) for i in range(len(texts))}


def test_three_changed_words_are_a_near_copy(spark):
    words = word_text(random.Random(8), 150).split()
    other = list(words)
    for k in (20, 70, 120):
        other[k] = "changed"
    texts = [" ".join(words), " ".join(other)]
    apart = bin(simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).count("1")
    assert apart > 4 and [r["doc_id"] for r in simhash.keep_one(documents(spark, texts)).collect()] == [0]


def test_pairs_at_the_least_similarity_are_found(spark):
    """Pairs between 0.8 and 0.9: the tables are laid out to miss one of fifty at 0.8 exactly, fewer above."""
    rng = random.Random(23)
    texts, near = [], 0
    for k in range(60):
        words = word_text(rng, 400).split()
        other = list(words)
        for i in range(rng.randint(5, 9)):
            other[20 + 40 * i] = "changed"
        a, b = (set(nearcopies.shingles(" ".join(w)).tolist()) for w in (words, other))
        near += len(a & b) >= 0.8 * len(a | b)
        texts += [" ".join(words), " ".join(other)]
    found = nearcopies.components(documents(spark, texts)).where("doc_id <> component_id").count()
    assert near >= 40 and 0.95 * near <= found <= near


def test_layout():
    assert nearcopies.layout(1)[0] == 24 and nearcopies.layout(10**12)[0] == 40
    for n in (1, 10**5, 10**9):
        width, tables = nearcopies.layout(n)
        assert tables < 100 and width * tables < 4096


def test_one_of_each_group_stays(spark):
    rows = [(None, "a b c"), (4, "A b  C"), (4, "A b  C"), (2, None), (9, ""), (None, None), (7, "x y"), (7, "z w"), (None, "only")]
    docs = spark.createDataFrame([(i, t, {"k": 1}, 1) for i, t in rows], "doc_id long, text string, __keep map<string,int>, r1 int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(4, "A b  C"), (2, None), (7, "x y"), (7, "z w"), (None, "only")], key=str)


def least_of_each(sets):
    """The smallest place that each set reaches by pairs of a similarity of 0.8 or more: all pairs, compared one by one."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("calm,hot", [(32, 2_000_000), (32, 60_000), (1000, 2_000_000)])
def test_large_family_loses_no_link(spark, calm, hot):
    """A family whose texts are mostly below 0.8 and partly above: every link counts, whatever else an item meets."""
    rng = random.Random(31)
    base, texts = word_text(rng, 200).split(), []
    for _ in range(400):
        own = list(base)
        for k in rng.sample(range(len(own)), rng.randint(2, 7)):
            own[k] = f"w{rng.randrange(40)}"
        texts.append(" ".join(own))
    wanted = least_of_each([set(nearcopies.shingles(t).tolist()) for t in texts])
    assert 20 < len(set(wanted)) < 380
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.components(documents(spark, texts), calm, hot).collect()}
    assert [found[i] for i in range(len(texts))] == wanted


def test_shared_counts_and_forest_connects():
    rng = np.random.default_rng(3)
    sides = [[np.unique(rng.zipf(1.3, n).astype(np.uint64) % np.uint64(5000)) for n in rng.integers(1, 400, m)] for m in (70, 50)]
    both = nearcopies.shared(*sides)
    assert both.tolist() == [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
    near = rng.random((60, 60)) < 0.02
    near |= near.T | np.eye(60, dtype=bool)
    reach = np.linalg.matrix_power(near.astype(np.int64), 1)
    for _ in range(6):
        reach = ((reach @ reach) > 0).astype(np.int64)
    own = np.eye(60, dtype=np.int64)
    for a, b in zip(*nearcopies.forest(near)):
        assert near[a, b]
        own[a, b] = own[b, a] = 1
    for _ in range(6):
        own = ((own @ own) > 0).astype(np.int64)
    assert own.tolist() == reach.tolist()


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_components_in_one_task_or_in_rounds(spark, most):
    rng = random.Random(12)
    links = [(k, k + 1) for k in range(-40, 0)] + [(2**62 + rng.randrange(90), 2**62 + rng.randrange(90)) for _ in range(60)]
    links += [(5, 5), (None, 6), (7, None)]
    rng.shuffle(links)
    least = {}
    for a, b in links:
        if None not in (a, b) and a != b:
            x, y = least.setdefault(a, a), least.setdefault(b, b)
            least = {k: min(x, y) if v in (x, y) else v for k, v in least.items()}
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"components-{most}", "")
    found = {r["node"]: r["component"] for r in common.components(frame, most).collect()}
    spark.sparkContext._jsc.clearJobGroup()
    assert found == least
    assert (len(jobs.getJobIdsForGroup(f"components-{most}")) <= 8) == (most > 3)
    assert common.components(frame.limit(0), most).collect() == []


def test_every_repeated_shingle_has_its_place_in_the_order(spark):
    """Shingles of a sample that several texts have come after all that one has, however many there are of either."""
    rng = random.Random(41)
    common, texts = word_text(rng, 300), []
    for k in range(64):
        texts.append(f"{common} {word_text(rng, 200)} {k}")
    order = nearcopies.frequent(documents(spark, texts))
    low = np.uint64(nearcopies.PLACES - 1)
    assert order.dtype == np.uint8 and len(order) == nearcopies.PLACES and (order[nearcopies.shingles(common) & low] > 1).all()
    for t in texts[:5]:
        found = nearcopies.shingles(t)
        assert not np.isin(nearcopies.prefix(found, order), nearcopies.shingles(common)).any()
    few = nearcopies.frequent(documents(spark, texts + [common.lower()] * 2), most=1)
    assert np.count_nonzero(few) <= 1
