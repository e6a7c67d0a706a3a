"""Property graphs, as vertices and edges, read as a forest.

A tree starts at a vertex without incoming edges and follows edges in either direction, each edge type in one step of a
tree only. So a tree has at most as many steps as there are edge types, and the walk is that many rounds of equi-joins
over a frontier that carries the types already used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def root_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def types_with_data(edges: DataFrame) -> DataFrame:
    """Edge types of which some edge has a property."""
    return edges.groupBy("type").agg(F.max(F.size("props") > 0).alias("any")).where("any").select("type")


def _falsy(value):
    return value.isNull() | value.isin("", "0", "0.0", "false", "False")


def vertex_group(id_, label, props):
    """A group value: falsy properties are dropped."""
    kept = F.filter(F.map_entries(props), lambda e: ~_falsy(e["value"]))
    return F.struct(
        label.alias("name"), id_.cast("string").alias("oid"),
        F.transform(kept, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))).alias("ents"),
    )


def read_graph(vertices: DataFrame, edges: DataFrame, max_types: int | None = None) -> DataFrame:
    """``trees(tree_id, children)`` of ``vertices(id, label, props)`` and ``edges(id, src, dst, type, props)``.

    Children stand in the order in which the rounds reach them. An edge type with properties anywhere is read as a group
    of its own with a relation to both ends.
    """
    spark = vertices.sparkSession
    rounds = max_types or edges.select("type").distinct().count()
    with_data = [r["type"] for r in types_with_data(edges).collect()]  # as few rows as there are edge types
    ends = edges.select("id", F.col("src").alias("a"), F.col("dst").alias("b"), "type", "props").union(
        edges.select("id", F.col("dst"), F.col("src"), "type", "props").where("src <> dst")
    )
    group = vertices.select(F.col("id").alias("vid"), vertex_group(F.col("id"), F.col("label"), F.col("props")).alias("g"))
    frontier = root_vertices(vertices, edges).select(F.col("id").cast("string").alias("tree_id"), F.col("id").alias("at"), F.array().cast("array<string>").alias("used"))
    none = F.lit(None).cast("map<string,string>")
    found = [frontier.join(group, F.col("at") == F.col("vid")).select(
        "tree_id", F.lit(0).alias("round"), F.col("vid").cast("string").alias("key"), F.lit(0).alias("part"),
        F.struct(F.lit("GROUP").alias("type"), F.col("g.name").alias("name"), none.alias("metadata"), F.array("g").alias("groups")).alias("child"),
    )]
    for k in range(1, rounds + 1):
        steps = frontier.join(ends, F.col("at") == F.col("a")).where(~F.array_contains("used", F.col("type")))
        types = steps.groupBy("tree_id").agg(F.collect_set("type").alias("new"))  # bounded by the number of types
        near, far = group.select(F.col("vid").alias("a"), F.col("g").alias("ga")), group.select(F.col("vid").alias("b"), F.col("g").alias("gb"))
        met = steps.join(near, "a").join(far, "b")
        edge_group = vertex_group(F.col("id"), F.col("type"), F.col("props"))
        is_group = F.col("type").isin(*with_data) if with_data else F.lit(False)

        def rel(x, y):
            return F.struct(F.lit("REL").alias("type"), F.col("type").alias("name"), none.alias("metadata"), F.array(x, y).alias("groups"))

        target = F.struct(F.lit("GROUP").alias("type"), F.col("gb.name").alias("name"), none.alias("metadata"), F.array("gb").alias("groups"))
        kids = F.when(is_group, F.array(rel(edge_group, F.col("ga")), rel(edge_group, F.col("gb")), target)).otherwise(
            F.array(rel(F.col("ga"), F.col("gb")), target))
        found.append(met.select(
            "tree_id", F.lit(k).alias("round"), F.col("id").cast("string").alias("key"), F.posexplode(kids).alias("part", "child")
        ))
        frontier = steps.join(types, "tree_id").select(
            "tree_id", F.col("b").alias("at"), F.array_union("used", "new").alias("used")
        ).distinct()
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    ordered = F.array_sort(F.collect_list(F.struct("round", "key", "part", "child")), lambda x, y: F.when(
        F.struct(x["round"], x["key"], x["part"]) < F.struct(y["round"], y["key"], y["part"]), -1).otherwise(1))
    return rows.groupBy("tree_id").agg(F.transform(ordered, lambda r: r["child"]).alias("children"))
