"""Forests written as relational tables, property graphs and JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions import typed_value
from sylva.model import nodes_to_trees
from sylva.operators import forest
from sylva.operators import schema as schemas


def key_name(table: str) -> str:
    return f"{table}_oid"


def group_records(nodes: DataFrame, group: str, entities: list[str]) -> DataFrame:
    """One row per oid of a group: oid and its entities; of several the first in the forest counts."""
    # A group, its entities and their words meet under the group's place, as for vertices: no join.
    is_group, is_entity, is_word = (F.col("type") == "GROUP") & (F.col("name") == group), F.col("type") == "ENT", F.col("kind") == "LEAF"
    records = _records(nodes, is_group, is_entity, is_word).where("size(ents) > 0")
    value = lambda n: F.array_max(F.transform(F.filter("ents", lambda e: e["name"] == n), _words_of))
    rows = records.select("own.oid", F.struct("tree_id", "g").alias("at"), F.struct(*[value(n).alias(n) for n in entities]).alias("r"))
    return rows.groupBy("oid").agg(F.min_by("r", "at").alias("r")).select("oid", *[F.col("r")[n].alias(n) for n in entities])


def _words_of(e: Column) -> Column:
    """The words of an entity of a record of :func:`_records`; null where it has none."""
    own = F.filter("words", lambda w: F.slice(w["pos"], F.lit(1), F.size(w["pos"]) - 1) == e["pos"])
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda w: w["value"]), " "))


def _records(nodes: DataFrame, is_group: Column, is_entity: Column, is_word: Column) -> DataFrame:
    """tree_id, place g, own(oid, name), ents(pos, name) and words(pos, value) of each group."""
    up = lambda k: F.slice("pos", F.lit(1), F.greatest(F.size("pos") - k, F.lit(0)))
    place = F.when(is_group, F.col("pos")).when(is_entity, up(1)).when(is_word & (F.size("pos") >= 2), up(2))
    return nodes.where(is_group | is_entity | is_word).withColumn("g", place).where("g IS NOT NULL").groupBy("tree_id", "g").agg(
        F.max(F.when(is_group, F.struct("oid", "name"))).alias("own"),
        F.array_sort(F.collect_list(F.when(is_entity, F.struct("pos", "name")))).alias("ents"),
        F.array_sort(F.collect_list(F.when(is_word, F.struct("pos", "value")))).alias("words"),
    ).where("own IS NOT NULL")


def relation_pairs(nodes: DataFrame) -> DataFrame:
    return schemas.relation_examples(nodes).select("relation", "left_name", "left_oid", "right_name", "right_oid").distinct()


def export_tables(nodes: DataFrame, schema: schemas.Schema, name_key: Callable[[str], str] = key_name) -> dict[str, DataFrame]:
    """A table per group, with a foreign key on the many side of each 1-n relation, and a link table per n-n relation.

    The side whose records have one partner each holds the key.
    """
    out = {g: group_records(nodes, g, sorted(e)).withColumnRenamed("oid", name_key(g)) for g, e in schema.groups.items()}
    pairs = relation_pairs(nodes)
    for r in sorted(schema.relations, key=lambda r: r.name):
        own = pairs.where((F.col("relation") == r.name)).select(
            *[F.when(F.col("left_name") == s, F.col("left_oid")).otherwise(F.col("right_oid")).alias(a) for s, a in ((r.left, "l"), (r.right, "r"))]).distinct()
        if r.orientation == schemas.BOTH:
            out[r.name] = own.select(F.col("l").alias(name_key(r.left)), F.col("r").alias(f"{name_key(r.right)}{'_2' if r.left == r.right else ''}"))
            continue
        holder, target, h, t = (r.right, r.left, "r", "l") if r.orientation == schemas.LEFT else (r.left, r.right, "l", "r")
        links = own.groupBy(F.col(h).alias(name_key(holder))).agg(F.min(t).alias(name_key(target) if holder != target else f"{r.name}_oid"))
        out[holder] = out[holder].join(links, name_key(holder), "left")
    return out


def write_tables(tables: dict[str, DataFrame], write: Callable[[str, DataFrame], None]) -> None:
    """Hand each table to a writer, such as ``df.write.parquet`` or ``df.write.jdbc``."""
    for name, df in tables.items():
        write(name, df)


def export_vertices(nodes: DataFrame, collapsed: frozenset[str] = frozenset()) -> DataFrame:
    """id, label and typed properties of each group record; collapsed groups become edges instead.

    An entity's words are joined by spaces; of several entities of one label in a group the first counts, of several
    records of one oid the first in the forest, as in tables. A group, its entities and their words meet under the
    group's place, so node rows are shuffled once; what is gathered there is one record.
    """
    records = _records(nodes, F.col("type") == "GROUP", F.col("type") == "ENT", F.col("kind") == "LEAF")
    if collapsed:
        records = records.where(~F.col("own.name").isin(*collapsed))
    keys = F.array_distinct(F.transform("ents", lambda e: e["name"]))
    texts = F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(_words_of(F.filter("ents", lambda e: e["name"] == k)[0]), F.lit("")).alias("text")))
    entries = F.transform(F.filter(texts, lambda t: t["text"] != ""), lambda t: F.struct(
        t["key"].alias("key"), F.struct(t["text"].alias("text"), typed_value(t["text"]).alias("kind")).alias("value")))
    props = records.select("own.oid", "own.name", F.struct("tree_id", "g").alias("at"), F.map_from_entries(entries).alias("props"))
    return props.groupBy("oid", "name").agg(F.min_by("props", "at").alias("props")).select(
        F.col("oid").alias("id"), F.col("name").alias("label"), "props")


def export_edges(nodes: DataFrame) -> DataFrame:
    """src, dst and type of each relation: from the larger label, or from the smaller one where metadata names it as source."""
    rel = nodes.where("type = 'REL'").select("tree_id", F.col("pos").alias("r"), "name", "metadata")
    kids = forest.with_links(nodes).where("type = 'GROUP'").select("tree_id", F.col("parent_pos").alias("r"), "ord", F.col("name").alias("label"), "oid")
    both = rel.join(kids, ["tree_id", "r"]).groupBy("tree_id", "r", "name").agg(
        F.first("metadata").alias("m"), F.min(F.struct("label", "ord", "oid")).alias("a"), F.max(F.struct("label", "ord", "oid")).alias("b"), F.count("*").alias("n"))
    keep = F.coalesce(F.col("m")["source"] == F.col("a.label"), F.lit(False))
    return both.where("n = 2").select(
        F.when(keep, F.col("a.oid")).otherwise(F.col("b.oid")).alias("src"), F.when(keep, F.col("b.oid")).otherwise(F.col("a.oid")).alias("dst"),
        F.coalesce(F.col("m")["source_column"], F.replace("name", F.lit("<->"), F.lit("_"))).alias("type")).distinct()


def export_attributed_edges(edges: DataFrame, vertices: DataFrame, group: str) -> DataFrame:
    """(src, dst, type, props): each record of a collapsible group as an edge between its two neighbours."""
    hub = vertices.where(F.col("label") == group).select(F.col("id").alias("m"), "props")
    ends = edges.select(F.col("src").alias("m"), F.col("dst").alias("x")).union(edges.select("dst", "src"))
    both = ends.join(hub.select("m"), "m", "left_semi").groupBy("m").agg(F.min("x").alias("src"), F.max("x").alias("dst"), F.count("*").alias("n"))
    return both.where("n = 2").join(hub, "m").select("src", "dst", F.lit(group).alias("type"), "props")


def write_json_lines(nodes: DataFrame, path: str) -> None:
    nodes_to_trees(nodes).select(F.col("tree").alias("value")).write.mode("overwrite").text(path)
