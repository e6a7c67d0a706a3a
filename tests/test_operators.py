import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sylva import functions as fn
from sylva import sinks
from sylva.model import TREE_SCHEMA, from_bracket, from_json, nodes_to_trees, reduce_all, to_bracket, to_json, trees_to_nodes
from sylva.operators import cluster, forest, quality, schema, simplify, vocabulary
from sylva.operators.schema import BOTH, LEFT, RIGHT, Relation, Schema
from sylva.storage import TreeStore


def nodes_of(spark, *texts):
    return trees_to_nodes(spark.createDataFrame([(str(i), to_json(from_bracket(t))) for i, t in enumerate(texts)], TREE_SCHEMA))


def texts_of(nodes):
    return [to_bracket(from_json(r["tree"])) for r in nodes_to_trees(nodes).orderBy("tree_id").collect()]


DEEP = "(S (X (ENT::person Alice) (ENT::fruit apple)) (Y (u (ENT::person Bob)) (v (w leaf))) tail)"


def test_tree_measures(spark):
    nodes, tree = nodes_of(spark, DEEP), from_bracket(DEEP)
    rows = {tuple(r["pos"]): r for r in forest.subtree_measures(nodes).collect()}
    for path, n in tree.walk():
        r = rows[path]
        assert (r["height"], r["n_leaves"], set(r["entity_labels"])) == (n.height(), len(n.leaves()), n.entity_labels())
        assert r["has_duplicate_entity"] == n.has_duplicate_entity()
    kids = {tuple(r["pos"]): r for r in forest.child_measures(nodes).collect()}
    for path, n in tree.walk():
        if n.children:
            assert (kids[path]["has_entity_child"], kids[path]["has_unlabelled_child"]) == (n.has_entity_child(), n.has_unlabelled_child())
    assert [r["value"] for r in forest.leaves(nodes).orderBy("leaf").collect()] == tree.leaves()
    made = {(r["lhs"], tuple(r["rhs"])) for r in forest.productions(nodes).collect()}
    assert ("S", ("X", "Y", "'tail'")) in made and ("ENT::person", ("'Bob'",)) in made


def test_reduce_all_over_rows(spark):
    texts = [DEEP, "(S (a (b (c (ENT::x 1) (ENT::y 2)))) (d (ENT::z 3)))", "(S (a (b x)))"]
    assert texts_of(forest.reduce_all(nodes_of(spark, *texts), ("ENT",))) == [to_bracket(reduce_all(from_bracket(t), frozenset({"ENT"}))) for t in texts]


def test_group_instances(spark):
    nodes = nodes_of(spark, "(S (GROUP::p (ENT::a 1) (ENT::b 2 3)) (GROUP::p (ENT::a 1) (ENT::b 2 3)))", "(S (GROUP::p (ENT::a 4)) (GROUP::q (ENT::a 9)))", "(S x)")
    assert sorted(map(tuple, forest.group_instances(nodes, "p", ["a", "b"]).collect()), key=str) == [("1", "2 3"), ("4", None)]


def test_simple_rewrite(spark):
    nodes = nodes_of(spark, "(S (u (ENT::b 1) (ENT::a 2)) (ENT::b 3))", "(S (u (ENT::a 5) (ENT::b 6 7)))", "(S (u (ENT::c 5)))", "(S (GROUP::g (ENT::a 1)))")
    found = defaultdict(dict)
    for r in forest.simple_rewrite(nodes).collect():
        found[r["tree_id"], r["group_name"]][r["entity"]] = r["value"]
    assert found == {("0", "group_1"): {"a": "2", "b": "1"}, ("1", "group_1"): {"a": "5", "b": "6 7"}, ("2", "group_2"): {"c": "5"}}


# --- schema -------------------------------------------------------------------------------------------------------------


def test_infer(spark):
    texts = [
        "(ROOT (GROUP::a (ENT::x 1)) (REL::a<->b (GROUP::a (ENT::x 1) (ENT::y 2)) (GROUP::b (ENT::z 3))) (COLL::a (GROUP::a (ENT::x 9)) (GROUP::a (ENT::x 8))))",
        "(ROOT (u (GROUP::b (ENT::z 3)) (ENT::w 4)))"]
    own = schema.infer(nodes_of(spark, *texts))
    assert own.groups == {"a": frozenset("xy"), "b": frozenset("z")}
    assert dict(own.productions) == {
        "GROUP::a": ("ENT::x", "ENT::y"), "GROUP::b": ("ENT::z",), "REL::a<->b": ("GROUP::a", "GROUP::b"), "COLL::a": ("GROUP::a",), "u": ("ENT::w", "GROUP::b")}
    assert not own.verify()
    assert schema.infer(nodes_of(spark, *texts), keep_unlabelled=False).verify()
    assert {(r.name, r.left, r.right) for r in own.relations} == {("a<->b", "a", "b")}


@pytest.mark.parametrize("pairs,expected", [
    ([(1, "p"), (1, "q"), (2, "r")], LEFT), ([(1, "p"), (2, "p")], RIGHT), ([(1, "p"), (1, "q"), (2, "p")], BOTH), ([(1, "p")], BOTH)])
def test_orientation(spark, pairs, expected):
    rows = spark.createDataFrame([("l<->r", "l", str(a), "r", b) for a, b in pairs], "relation string, left_name string, left_oid string, right_name string, right_oid string")
    assert [tuple(r) for r in schema.orientations(rows).collect()] == [("l<->r", "l", "r", expected)]


@pytest.mark.parametrize("relations,expected", [
    ([("A", "M", LEFT), ("M", "B", RIGHT)], {"M"}), ([("M", "B", RIGHT), ("M", "C", RIGHT)], {"M"}), ([("A", "M", BOTH), ("M", "B", RIGHT)], set())])
def test_collapsible(spark, relations, expected):
    own = Schema(relations=frozenset(Relation(f"r{i}", *r) for i, r in enumerate(relations)))
    assert own.collapsible_groups() == expected
    rows = spark.createDataFrame(relations, "left string, right string, orientation string")
    assert {r["name"] for r in schema.collapsible(rows).collect()} == expected


def test_description():
    own = Schema.from_description({"p": {"a", "b"}, "q": {"c"}}, {Relation("pq", "p", "q", LEFT)})
    assert not Schema.from_description({"p q": {"a"}}).verify() and own.groups == {"p": frozenset("ab"), "q": frozenset("c")}
    assert own.entities == set("abc") and own.group_overlap() == 0 and math.isclose(own.group_balance(), 1 - 0.5 / 1.5)
    assert "GROUP::p -> ENT::a ENT::b" in own.as_cfg() and own.to_tree().label == "ROOT"
    both = own | Schema.from_description({"p": {"d"}})
    assert both.groups["p"] == frozenset("abd") and Schema().group_balance() == 1 and Schema().group_overlap() == 0


def test_valid_trees(spark):
    own = Schema.from_description({"city": {"name", "zip"}, "river": {"name", "length"}})
    nodes = nodes_of(
        spark,
        "(ROOT (REL::city<->river (GROUP::city (ENT::name Ulm) (ENT::mayor x)) (GROUP::river (ENT::name Donau))) (ENT::zip 89073))",
        "(ROOT (GROUP::lake (ENT::depth 30)))",
        "(GROUP::river (ENT::length 2850) word)",
        "(tour (COLL::river (GROUP::river (ENT::name Iller)) (GROUP::lake (ENT::name Ammer))))",
    )
    assert texts_of(schema.valid_trees(nodes, own)) == [
        "(ROOT (GROUP::city (ENT::name Ulm)) (GROUP::river (ENT::name Donau)))",
        "(GROUP::river (ENT::length 2850) word)",
        "(ROOT (GROUP::river (ENT::name Iller)))",
    ]


# --- quality ------------------------------------------------------------------------------------------------------------


def brute_confidence(rows, own, a):
    groups = defaultdict(Counter)
    for r in rows:
        groups[tuple(r[c] for c in own if c != a)][r[a]] += 1
    return sum(max(c.values()) for c in groups.values()) / len(rows)


def test_dependencies(spark):
    rng = random.Random(4)
    rows = [{"a": rng.choice([1, 2, None]), "b": rng.choice("xyz"), "c": rng.choice([1, 2])} for _ in range(60)]
    for r in rows:
        r["d"] = f"{r['a']}{r['b']}"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a int, b string, c int, d string")
    own = list("abcd")
    for a in own:
        assert math.isclose(quality.confidence(df, a).first()[0], brute_confidence(rows, own, a))
    assert math.isclose(quality.dependency_score(df, ["a", "b", "c"]).first()[0], max(brute_confidence(rows, list("abc"), a) for a in "abc"))
    for tau in (0.5, 1.0):
        flagged = set()
        for k in (2, 3, 4):
            for s in combinations(own, k):
                if max(brute_confidence(rows, s, a) for a in s) >= tau - 1e-12:
                    n = Counter(tuple(r[c] for c in s) for r in rows)
                    flagged |= {i for i, r in enumerate(rows) if None not in (v := tuple(r[c] for c in s)) and n[v] > 1}
        assert math.isclose(quality.redundancy(df, tau).first()[0], len(flagged) / len(rows))
    assert quality.confidence(df.limit(0), "a").first()[0] == 0 and quality.redundancy(df.limit(0)).first()[0] == 0
    wide = spark.createDataFrame([tuple([i % 3, i % 3] + [i * 7 % (k + 2) for k in range(14)]) for i in range(40)], [f"c{k}" for k in range(16)])
    assert quality.redundancy(wide).first()[0] == 1


def test_clustering_measures(spark):
    rng = random.Random(5)
    a = spark.createDataFrame([(i, rng.choice("pqr")) for i in range(80)], "oid int, cluster string")
    same, other = quality.contingency(a, a), quality.contingency(a, a.select("oid", (F.col("oid") % 4).cast("string").alias("cluster")))
    assert math.isclose(quality.adjusted_mutual_information(same).first()[0], 1) and abs(quality.adjusted_mutual_information(other).first()[0]) < 0.1
    assert quality.adjusted_mutual_information(same.limit(0)).first()[0] == 1
    assert math.isclose(quality.completeness(same).first()[0], 1) and quality.completeness(other).first()[0] < 0.2
    assert quality.coverage(a, a.where("oid < 40")).first()[0] == 0.5 and quality.coverage(a.limit(0), a.limit(0)).first()[0] == 1


# --- similarity, clusters, rewriting ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["jaccard", "levenshtein", "jaro"])
def test_similarity_columns(spark, name):
    rng = random.Random(6)
    sets = [sorted(rng.sample("abcdefgh", rng.randint(0, 8))) for _ in range(60)]
    pairs = spark.createDataFrame([(x, y) for x in sets[:20] for y in sets], "x array<string>, y array<string>")
    value = fn.label_sets_similarity(name)
    for r in pairs.select("x", "y", fn.METRICS[name](F.col("x"), F.col("y")).alias("s")).collect():
        assert math.isclose(r["s"], value(frozenset(r["x"]), frozenset(r["y"])))


def test_context_similarity(spark):
    nodes = nodes_of(spark, "(S (X (ENT::person Alice) (ENT::fruit apple)) (Y (ENT::person Bob) (ENT::animal rabbit)))")
    found = {tuple(r["pos"]): r["ctx"] for r in cluster.candidates(nodes).collect()}
    assert set(found) == {(0,), (1,)}
    frame = cluster.candidates(nodes)
    x, y = (frame.where(f"get(pos, 0) = {i}").select(F.col("ctx").alias(c)) for i, c in enumerate("xy"))
    both = x.crossJoin(y).select(fn.context_similarity(F.col("x"), F.col("y"), fn.jaccard)).first()[0]
    assert math.isclose(both, 0.5555555555555555)


def test_clusters_and_fixed_point(spark):
    texts = [f"(S (u (ENT::name n{i}) (ENT::age {i})) (v (ENT::city c{i}) (ENT::zip {i})))" for i in range(8)]
    nodes = nodes_of(spark, *texts)
    found = cluster.clusters(nodes, metric="jaccard")
    assert {r["members"] for r in found.groupBy("cluster").agg(F.count("*").alias("members")).collect()} == {8}
    trees = spark.createDataFrame([(str(i), to_json(from_bracket(t))) for i, t in enumerate(texts)], TREE_SCHEMA)
    out, log = simplify.simplify(trees, metric="jaccard", epochs=10)
    final = [from_json(r["tree"]) for r in out.collect()]
    assert log and len(final) == 8
    assert all(t.groups() == final[0].groups() and t.groups() for t in final)
    assert sorted(x for t in final for x in set(t.leaves())) == sorted(x for t in texts for x in set(from_bracket(t).leaves()))
    own = schema.infer(trees_to_nodes(out), keep_unlabelled=False)
    assert own.entities == {"name", "age", "city", "zip"} and own.verify()
    with pytest.raises(ValueError):
        simplify.simplify(trees, tau=2)


def test_vocabulary(spark):
    assert vocabulary.normalize("firstName of  été") == "FIRST_NAME_OF_T" or vocabulary.normalize("firstName") == "FIRST_NAME"
    merged = vocabulary.merge_vocabulary({"person": 5, "persons": 2, "Person": 1, "city": 1}, 0.8, 2)
    assert merged == {"person": "PERSON", "persons": "PERSON", "Person": "PERSON"}
    trees = spark.createDataFrame([(str(i), to_json(from_bracket("(S (ENT::a 1) (ENT::b 2))"))) for i in range(3)], TREE_SCHEMA)
    answer = '1. {"name": "ROOT", "children": [{"type": "GROUP", "name": "g", "children": [{"type": "ENT", "name": "a", "children": ["1"]}]}]}\n2. broken'
    out = [to_bracket(from_json(r["tree"])) for r in vocabulary.model_rewrite(trees.coalesce(1), lambda: lambda prompt: answer, limit=10_000).collect()]
    assert out == ["(ROOT (GROUP::g (ENT::a 1)))", "(S (ENT::a 1) (ENT::b 2))", "(S (ENT::a 1) (ENT::b 2))"]
    assert vocabulary.batches_by_size([3, 3, 9, 1], 6) == [[0, 1], [2], [3]]


# --- sinks, storage, streaming ------------------------------------------------------------------------------------------


def test_export(spark):
    g = lambda t, i, k: f"(GROUP::{t} (ENT::{k} {i}))"
    texts = [f"(ROOT (REL::o<->c {g('o', i, 'k')} {g('c', i % 2, 'n')}))" for i in range(4)]
    nodes = nodes_of(spark, *texts)
    leaf = nodes.where("kind = 'LEAF'").select("tree_id", forest.parent_pos(forest.parent_pos()).alias("pos"), F.col("value").alias("v"))
    nodes = nodes.join(leaf, ["tree_id", "pos"], "left").withColumn("oid", F.coalesce(F.concat("name", "v"), "oid")).drop("v").select(*nodes.columns)
    own = schema.infer(nodes)
    assert [r.orientation for r in own.relations] in ([RIGHT], [LEFT])
    tables = sinks.export_tables(nodes, own)
    assert sorted(map(tuple, tables["o"].select("o_oid", "c_oid", "k").collect())) == [(f"o{i}", f"c{i % 2}", str(i)) for i in range(4)]
    assert sorted(map(tuple, tables["c"].select("c_oid", "n").collect())) == [("c0", "0"), ("c1", "1")]
    vertices = {r["id"]: r for r in sinks.export_vertices(nodes).collect()}
    assert set(vertices) == {"o0", "o1", "o2", "o3", "c0", "c1"} and vertices["o1"]["props"]["k"]["kind"] == "integer"
    edges = sinks.export_edges(nodes)
    assert sorted((r["src"], r["dst"], r["type"]) for r in edges.collect()) == [(f"o{i}", f"c{i % 2}", "o_c") for i in range(4)]


def test_store(spark, tmp_path):
    store = TreeStore(spark, f"file://{tmp_path}/store")
    rows = lambda *ids: spark.createDataFrame([(i, f"tree {i}") for i in ids], TREE_SCHEMA)
    assert len(store) == 0
    store.add(rows("a", "b"))
    store.add(rows("b", "c"))
    assert len(store) == 3 and "a" in store and "z" not in store
    with pytest.raises(RuntimeError), store.transaction():
        store.clear()
        assert len(store) == 0
        raise RuntimeError
    assert len(store) == 3
    with store.transaction():
        store.discard(rows("a"))
        store.add(rows("d"))
    assert sorted(r["tree_id"] for r in TreeStore(spark, f"file://{tmp_path}/store").ids().collect()) == ["b", "c", "d"]
    assert store.get(rows("b", "q")).count() == 1


def test_streaming_equals_batch(spark, tmp_path):
    from sylva.sources.documents import read_documents
    from sylva.streaming import ingest_documents, ingested

    rows = spark.createDataFrame([(i, f'{{"a": {i}}}') for i in range(6)], "id int, body string")
    for k, part in enumerate((rows.where("id < 3"), rows.where("id >= 3"))):
        part.write.parquet(f"file://{tmp_path}/in", mode="append")
        ingest_documents(spark, f"file://{tmp_path}/in", "id int, body string", "id", "body", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    batch = trees_to_nodes(read_documents(rows, "id", "body"))
    own = ingested(spark, f"file://{tmp_path}/out")
    assert own.count() == batch.count()
    key = lambda df: sorted((r["tree_id"], tuple(r["pos"]), r["label"], r["value"]) for r in df.collect())
    assert key(own) == key(batch)
