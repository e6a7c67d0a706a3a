"""Clusters of similar subtrees.

Subtrees are compared by signature (entity labels and labels along the chain of ancestors), so all equal ones are one
item with a count. Pairs are only formed between signatures that share an entity label, by an equi-join on the label;
all others have similarity 0. A cluster is a component of the graph of pairs with similarity of ``tau`` or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions import METRICS, context_similarity
from sylva.operators import forest
from sylva.shared import connected_components, stored


def candidates(nodes: DataFrame, max_height: int = 5, depth: int = 5) -> DataFrame:
    """Subtrees that are compared, with their context: height up to ``max_height``, no entity, no repeated entity."""
    inner = forest.subtree_measures(nodes, ("kind", "oid", "type", "name", "label")).where("kind = 'NODE'")
    entry = F.struct("oid", "label", F.col("type").isNotNull().alias("typed"), F.col("entity_labels").alias("labels"))
    level = inner.select("tree_id", F.col("pos").alias("anc"), entry.alias("entry"))
    own = inner.where((F.coalesce(F.col("type"), F.lit("")) != "ENT") & (F.col("height") <= max_height)
                      & ~F.col("has_duplicate_entity") & (F.col("n_entities") > 0))
    # Merge joins: by the size of the file that trees come from, the planner takes tables of all their nodes for small ones.
    chain = forest.with_ancestors(own.select("tree_id", "pos")).where(F.size("pos") - F.size("anc") < depth).join(level.hint("merge"), ["tree_id", "anc"])
    contexts = chain.groupBy("tree_id", "pos").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.size("anc").alias("n"), "entry")), asc=False), lambda x: x["entry"]).alias("ctx"))
    return own.select("tree_id", "pos", "oid", "type", "name", "label", "height", "n_entities", "entity_labels").join(contexts.hint("merge"), ["tree_id", "pos"])


def with_signature(found: DataFrame) -> DataFrame:
    """``found`` with a 64-bit signature of what similarity looks at, oids aside."""
    seen = F.transform("ctx", lambda e: F.struct(F.when(e["typed"], e["label"]).alias("label"), e["labels"].alias("labels")))
    return found.withColumn("sig", F.xxhash64(F.to_json(seen)))


def similar_pairs(signatures: DataFrame, tau: float, metric: str = "jaro", decay: float = 2.0) -> DataFrame:
    """(a, b, similarity) of signatures ``(sig, ctx)`` that share an entity label and reach ``tau``.

    Pairs meet in the smallest label that they share only, so none is compared twice.
    """
    if not 0 <= tau <= 1:
        raise ValueError("tau must be between 0 and 1")
    plain = signatures.select("sig", F.transform("ctx", lambda e: F.struct(
        F.lit(None).cast("string").alias("oid"), e["label"].alias("label"), e["typed"].alias("typed"), e["labels"].alias("labels"))).alias("ctx"))
    keyed = plain.select("sig", "ctx", F.explode(F.col("ctx")[0]["labels"]).alias("key"))
    a = keyed.select("key", F.col("sig").alias("a"), F.col("ctx").alias("ca"))
    b = keyed.select("key", F.col("sig").alias("b"), F.col("ctx").alias("cb"))
    shared = F.array_min(F.array_intersect(F.col("ca")[0]["labels"], F.col("cb")[0]["labels"]))
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & (shared == F.col("key")))
    value = F.coalesce(context_similarity(F.col("ca"), F.col("cb"), METRICS[metric], decay), F.lit(0.0))
    return met.select("a", "b", value.alias("similarity")).where(F.col("similarity") >= tau)


def clusters(nodes: DataFrame, tau: float = 0.7, metric: str = "jaro", decay: float = 2.0, min_size: int = 2,
             max_height: int = 5, weights: DataFrame | None = None) -> DataFrame:
    """Members of clusters: cluster, size, tree_id, pos, oid, name, n_entities, entity_labels, ctx, weight, probability, rank.

    A cluster is named after the most common typed label of its members and a number; clusters below ``min_size`` members
    are noise. Subtrees without entities are similar to none. ``weights(tree_id, n)`` says of how many trees each one
    stands for; by default every tree is one. Only distinct structures are compared, and their links are joined up
    in rounds of equi-joins, so nothing is gathered on the driver.
    """
    found = candidates(nodes, max_height)
    found = found.withColumn("weight", F.lit(1).cast("long")) if weights is None else found.join(
        weights.select("tree_id", F.col("n").cast("long").alias("weight")), "tree_id")
    found = stored(with_signature(found), "subtrees")
    signatures = found.groupBy("sig").agg(F.first("ctx").alias("ctx"))
    parts = connected_components(similar_pairs(signatures, tau, metric, decay))
    members = found.join(parts, found["sig"] == parts["node"], "left").withColumn("comp", F.coalesce("component", "sig")).drop("node", "component")
    typed = members.where("type IS NOT NULL").groupBy("comp", "name").agg(F.sum("weight").alias("w"))
    bases = typed.groupBy("comp").agg(F.min(F.struct(-F.col("w"), F.col("name").alias("name"))).alias("m")).select("comp", F.col("m.name").alias("base"))
    sizes = members.groupBy("comp").agg(F.sum("weight").alias("size")).where(F.col("size") >= min_size)
    number = F.row_number().over(Window.orderBy(F.desc("size"), "comp"))  # one row per cluster of structures
    labels = sizes.join(bases, "comp", "left").withColumn("cluster", F.concat_ws("_", "base", number.cast("string"))).select("comp", "cluster", "size")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("tree_id", "pos"))
    return members.join(labels, "comp").select(
        "cluster", "size", "tree_id", "pos", "oid", "name", "n_entities", "entity_labels", "ctx", "weight",
        F.lit(1.0).alias("probability"), rank.alias("rank"))


def entity_clusters(nodes: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(oid, cluster) of each entity: its parent's cluster, or its parent's label without a clustering."""
    ents = nodes.where("type = 'ENT'").select("tree_id", "oid", forest.parent_pos().alias("pos"))
    if members is None:
        up = nodes.where("kind = 'NODE'").select("tree_id", "pos", F.col("label").alias("cluster"))
    else:
        up = members.select("tree_id", "pos", "cluster")
    return ents.join(up, ["tree_id", "pos"]).groupBy("oid").agg(F.max_by("cluster", F.struct("tree_id", "pos")).alias("cluster"))
