"""Work on trees is dealt while rows are small, and not gathered or joined again by node."""

import pytest
from pyspark.sql import functions as F

from sylva.model import nodes_to_trees
from sylva.operators import forest, simplify
from sylva.plans import catalog, trees
from sylva.sources import documents as docs
from sylva.sources import relational as rel

PLACE = rel.Table("place", ("k", "name"), ("k",))
SHIP = rel.Table("ship", ("i", "name", "port"), ("i",), (rel.ForeignKey("port", "place", "k"),))
LINK = rel.Table("link", ("i", "k"), ("i", "k"), (rel.ForeignKey("i", "ship", "i"), rel.ForeignKey("k", "place", "k")))


@pytest.fixture(scope="module")
def load(spark):
    tables = {
        "place": spark.createDataFrame([(1, "Ulm"), (2, None)], "k int, name string"),
        "ship": spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", None), (4, "d", 9)], "i int, name string, port int"),
        "link": spark.createDataFrame([(1, 1), (1, 2), (2, 1), (7, 1)], "i int, k int"),
    }
    return tables.__getitem__


@pytest.fixture(scope="module")
def walk(load):
    return rel.read_walk(load, {"place": PLACE, "ship": SHIP}, "ship")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("measures", [
    lambda n: forest.child_measures(n, ("label",)), lambda n: forest.subtree_measures(n, ("label",)), forest.all_positions, forest.productions])
def test_nodes_of_a_walk_are_not_shuffled(walk, measures):
    text = plan(measures(walk.nodes()))
    assert text.count("Exchange hashpartitioning") == 1 + text.count("hashpartitioning(cast(a0.port") + text.count("hashpartitioning(a0.port") + text.count("hashpartitioning(a1.k")
    assert "Filter ((size(concat(" not in text


def test_whole_trees_of_a_walk_are_not_gathered(walk):
    found = nodes_to_trees(walk.nodes())
    assert "collect_list" not in plan(found) and found.count() == 4


def test_sizes_and_records_equal_those_of_nodes(walk):
    nodes = walk.nodes()
    shape = nodes.groupBy("tree_id").agg((F.max(F.size("pos")) + 1).alias("height"), F.count_if(F.col("kind") == "LEAF").alias("n_leaves"))
    assert sorted(map(tuple, walk.sizes().collect())) == sorted((r["height"], r["n_leaves"]) for r in shape.collect())
    ents = {r["oid"] for r in nodes.where("type = 'ENT' AND size(pos) = 2").collect()}
    records = [r for t in ("ship", "place") for r in walk.records(t).collect()]
    assert len(records) == 6 and {f"{r['oid']}/{e}" for r in records for e in r["entities"]} == ents


def test_counts_of_a_link_table_equal_those_of_nodes(load):
    plain = rel.Table("ship", ("i", "name"), ("i",))
    walk = rel.read_walk(load, {"link": LINK, "place": PLACE, "ship": plain}, "link")
    count = lambda rows: {(r["type"], r["name"]): r["count"] for r in rows.collect()}
    assert count(walk.label_counts()) == count(catalog._label_counts(walk.nodes()))


def test_shapes_are_counted_within_tasks(spark):
    rows = spark.createDataFrame([(i, f'{{"a": {{"b": {i}}}, "c{i % 2}": 1}}') for i in range(9)], "i long, json string").repartition(3)
    found = docs.read_documents(rows, "i", "json", "event", raw=True)
    key = lambda rows: sorted((r["shape"], r["tree_id"], r["n"], r["tree"]) for r in rows.collect())
    assert key(simplify.shape_counts(found)) == key(simplify.shapes_of(simplify.packed(found)))
    assert "shape_counts" in trees.weighted_clusters.__code__.co_names
