"""Forests in files: a JSON tree per line, Parquet node tables, and synthetic instances of a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.model import trees_to_nodes


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``trees(tree_id, tree)``; blank lines are skipped, and ids are digests of the lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.md5("value").alias("tree_id"), F.col("value").alias("tree"))


def read_forest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Node rows of several inputs: JSON-lines files, or folders with a Parquet node table."""
    parts = [trees_to_nodes(read_json_lines(spark, p)) if p.endswith((".jsonl", ".json")) else spark.read.parquet(p) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def generate_instances(spark: SparkSession, groups: DataFrame, relations: DataFrame, size: int = 200) -> DataFrame:
    """``trees(tree_id, children)``: ``size`` instances per group and per relation, every value ``data``.

    ``groups(name, entities)`` and ``relations(name, left, right)`` are a schema, so the product with the numbers
    0..size-1 is as large as what was asked for.
    """
    numbers = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")
    none = F.lit(None).cast("map<string,string>")

    def group(name, oid, entities):
        return F.struct(name.alias("name"), oid.alias("oid"), F.transform(entities, lambda e: F.struct(e.alias("name"), F.lit("data").alias("value"))).alias("ents"))

    def child(kind: str, name, groups):
        return F.array(F.struct(F.lit(kind).alias("type"), name.alias("name"), none.alias("metadata"), groups.alias("groups")))

    alone = groups.select("name", "entities", numbers)
    oid = F.concat_ws("#", "name", F.col("i").cast("string"))
    trees = alone.select(oid.alias("tree_id"), child("GROUP", F.col("name"), F.array(group(F.col("name"), oid, F.col("entities")))).alias("children"))
    g = groups.select(F.col("name").alias("g"), F.col("entities").alias("e"))
    both = (
        relations.select("name", "left", "right", numbers)
        .join(g.select(F.col("g").alias("left"), F.col("e").alias("le")), "left")
        .join(g.select(F.col("g").alias("right"), F.col("e").alias("re")), "right")
    )
    ends = F.array(
        group(F.col("left"), F.concat_ws("#", "name", "left", F.col("i").cast("string")), F.col("le")),
        group(F.col("right"), F.concat_ws("#", "name", "right", F.col("i").cast("string")), F.col("re")),
    )
    return trees.union(both.select(oid.alias("tree_id"), child("REL", F.col("name"), ends).alias("children")))


def gathered_instances(trees: DataFrame) -> DataFrame:
    """``trees(tree_id, tree)`` of :func:`generate_instances` gathered: a collection of all instances of a name each.

    One tree per group or relation of the schema, as large as what was generated of it.
    """
    child = F.col("children")[0]
    named = F.concat_ws("::", child["type"], child["name"])

    def build(batches):
        import json

        import pyarrow as pa

        from sylva.model import Node, make_label, to_json

        def group(g) -> Node:
            return Node(make_label("GROUP", g["name"]), tuple(Node(make_label("ENT", e["name"]), (e["value"],), f"{g['oid']}/{e['name']}") for e in g["ents"]), g["oid"])

        for batch in batches:
            ids, out = batch.column("label").to_pylist(), []
            for label, rows in zip(ids, batch.column("rows").to_pylist(), strict=True):
                kind, _, name = label.partition("::")
                kids = [[group(g) for g in json.loads(r)] for r in sorted(rows)]
                kids = [k[0] if kind == "GROUP" else Node(label, tuple(k)) for k in kids]
                out.append(to_json(Node(f"COLL::{name}", tuple(kids), f"COLL::{name}")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["tree_id", "tree"])

    rows = trees.groupBy(named.alias("label")).agg(F.collect_list(F.to_json(child["groups"])).alias("rows"))
    return rows.mapInArrow(build, "tree_id string, tree string")
