"""Tree primitives over node rows. The key of a node is ``(tree_id, pos)``; oids may repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent_pos(pos: Column | str = "pos") -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.when(F.size(pos) > 0, F.slice(pos, 1, F.size(pos) - 1))


def with_links(nodes: DataFrame) -> DataFrame:
    """Nodes with depth (from 1), parent_pos and ord (index in the parent; null at a root)."""
    return nodes.withColumns({
        "depth": F.size("pos") + 1, "parent_pos": parent_pos(), "ord": F.when(F.size("pos") > 0, F.element_at("pos", -1)),
    })


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """A row for each node or leaf and each of its ancestors or itself: columns of the row and ``anc``."""
    return nodes.withColumn("anc", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("pos")), lambda n: F.slice("pos", 1, n))))


def subtree_measures(nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per node: height, n_leaves, n_entities, sorted entity_labels, has_duplicate_entity, and its columns ``carry``.

    One aggregate over (node, ancestor) rows, whose number is nodes x depth; sums combine before the shuffle.
    """
    ent = F.col("type") == "ENT"
    rows, own = with_ancestors(nodes), []
    if carry:
        rows = rows.withColumn("__own", F.when(F.size("pos") == F.size("anc"), F.struct(*carry)))
        own = [F.first("__own", ignorenulls=True).alias("own")]
    return rows.groupBy("tree_id", F.col("anc").alias("pos")).agg(
        F.max(F.size("pos")).alias("deepest"),
        F.count_if(F.col("kind") == "LEAF").alias("n_leaves"), F.count_if(ent).alias("n_entities"),
        F.array_sort(F.collect_set(F.when(ent, F.col("name")))).alias("entity_labels"), *own,
    ).select(
        "tree_id", "pos", (F.col("deepest") - F.size("pos") + 1).alias("height"), "n_leaves", "n_entities", "entity_labels",
        (F.col("n_entities") > F.size("entity_labels")).alias("has_duplicate_entity"), *[F.col(f"own.{c}").alias(c) for c in carry],
    )


def child_measures(nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per node with children: n_children, has_entity_child, has_unlabelled_child, and its columns ``carry``."""
    kid = F.col("kid")
    if carry:
        # A node is a row under its parent's place, and one with its columns under its own: they meet without a join.
        kids = nodes.select("tree_id", "type", F.struct(*carry).alias("own"), F.explode(F.array(
            F.struct(parent_pos().alias("pos"), F.lit(True).alias("kid")), F.struct(F.col("pos").alias("pos"), F.lit(False).alias("kid")))).alias("at"))
        kids = kids.select("tree_id", "at.*", "type", F.when(~F.col("at.kid"), F.col("own")).alias("own")).where("pos IS NOT NULL")
    else:
        kids = nodes.select("tree_id", parent_pos().alias("pos"), F.lit(True).alias("kid"), "type").where("pos IS NOT NULL")
    own = [F.first("own", ignorenulls=True).alias("own")] if carry else []
    return kids.groupBy("tree_id", "pos").agg(
        F.count_if(kid).alias("n_children"), F.max(kid & F.coalesce(F.col("type") == "ENT", F.lit(False))).alias("has_entity_child"),
        F.max(kid & F.col("type").isNull()).alias("has_unlabelled_child"), *own,
    ).where("n_children > 0").select("tree_id", "pos", "n_children", "has_entity_child", "has_unlabelled_child", *[F.col(f"own.{c}").alias(c) for c in carry])


def leaves(nodes: DataFrame) -> DataFrame:
    """Leaves with their number within the tree, from left to right."""
    order = Window.partitionBy("tree_id").orderBy("pos")
    return nodes.where("kind = 'LEAF'").select("tree_id", "pos", "value", (F.row_number().over(order) - 1).alias("leaf"))


def leaf_position(nodes: DataFrame, leaf: int) -> DataFrame:
    """tree_id and pos of each tree's leaf with this number (from 0); trees with fewer leaves have none."""
    return leaves(nodes).where(F.col("leaf") == leaf).select("tree_id", "pos")


def positions(nodes: DataFrame, order: str = "pre") -> DataFrame:
    """tree_id, n (from 0) and pos of the nodes and leaves of each tree in an order of traversal.

    ``pre``: a node before its children; ``post``: after them; ``both``: inner nodes before and after; ``leaves``: leaves.
    """
    return all_positions(nodes, (order,)).select("tree_id", "n", "pos")


def all_positions(nodes: DataFrame, orders: tuple[str, ...] = ("pre", "post", "both", "leaves")) -> DataFrame:
    """The same with ``ord`` and ``label`` for several orders, in one pass and one sort within the trees."""
    after = F.array_append("pos", F.lit(2**31 - 1))  # sorts behind all that begins with pos
    inner, pos = F.col("kind") == "NODE", F.col("pos")
    places = {
        "pre": F.array(pos), "post": F.array(F.when(inner, after).otherwise(pos)),
        "both": F.when(inner, F.array(pos, after)).otherwise(F.array(pos)), "leaves": F.when(~inner, F.array(pos)),
    }
    if unknown := [o for o in orders if o not in places]:
        raise ValueError(f"no order of traversal: {unknown[0]}")
    def keyed(order: str) -> Column:
        return F.transform(places[order], lambda k: F.struct(F.lit(order).alias("ord"), k.alias("key")))

    rows = nodes.select("tree_id", "pos", "label", F.explode_outer(F.flatten(F.array_compact(F.array(*map(keyed, orders))))).alias("k")).where("k IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("tree_id", "ord").orderBy("key")) - 1
    return rows.select("tree_id", "pos", "label", "k.ord", "k.key").select("tree_id", "ord", number.alias("n"), "pos", "label")


def broken_trees(nodes: DataFrame) -> DataFrame:
    """tree_id and problem of each tree that is none.

    Problems: ``root`` (not exactly one), ``repeated`` (a place taken twice), ``orphan`` (no inner node above), ``gap``
    (children that are not numbered from 0 on), ``label`` (an inner node without a label, or a leaf without a value).
    """
    roots = nodes.groupBy("tree_id").agg(F.count_if(F.size("pos") == 0).alias("k")).where("k <> 1").select("tree_id", F.lit("root").alias("problem"))
    places = nodes.groupBy("tree_id", "pos").agg(F.count("*").alias("k"), F.max(F.col("kind") == "NODE").alias("inner"))
    repeated = places.where("k > 1").select("tree_id", F.lit("repeated"))
    kids = places.where(F.size("pos") > 0).groupBy("tree_id", parent_pos().alias("pos")).agg(
        F.count("*").alias("kids"), F.max(F.element_at("pos", -1)).alias("last"), F.min(F.element_at("pos", -1)).alias("first"))
    above = kids.join(places, ["tree_id", "pos"], "left")
    orphan = above.where("NOT coalesce(inner, false)").select("tree_id", F.lit("orphan"))
    gap = kids.where("first <> 0 OR last <> kids - 1").select("tree_id", F.lit("gap"))
    label = nodes.where("(kind = 'NODE' AND label IS NULL) OR (kind = 'LEAF' AND value IS NULL)").select("tree_id", F.lit("label"))
    return roots.union(repeated).union(orphan).union(gap).union(label).distinct()


def productions(nodes: DataFrame) -> DataFrame:
    """Per inner node its label and the ordered labels of its children; leaves stand as ``'text'``."""
    child = F.when(F.col("kind") == "LEAF", F.concat(F.lit("'"), "value", F.lit("'"))).otherwise(F.col("label"))
    leaf, no_text = F.col("kind") == "LEAF", F.lit(None).cast("string")
    # A node is a row under its parent's place, and one under its own: they meet without a join.
    under = F.struct(parent_pos().alias("pos"), F.struct(F.element_at("pos", F.when(F.size("pos") > 0, F.lit(-1))).alias("ord"), child.alias("c")).alias("kid"), leaf.alias("lexical"),
                     F.struct(no_text.alias("lhs"), no_text.alias("type"), no_text.alias("name")).alias("own"))
    itself = F.struct(F.col("pos").alias("pos"), F.lit(None).cast("struct<ord:int,c:string>").alias("kid"), F.lit(False).alias("lexical"),
                      F.struct(F.col("label").alias("lhs"), F.col("type").alias("type"), F.col("name").alias("name")).alias("own"))
    rows = nodes.select("tree_id", F.explode_outer(F.array_compact(F.array(F.when(F.size("pos") > 0, under), F.when(~leaf, itself)))).alias("x")).select("tree_id", "x.*")
    return rows.groupBy("tree_id", "pos").agg(
        F.first(F.when(F.col("kid").isNull(), F.col("own")), ignorenulls=True).alias("own"),
        F.transform(F.array_sort(F.collect_list("kid")), lambda x: x["c"]).alias("rhs"), F.max("lexical").alias("lexical"),
    ).where("own IS NOT NULL AND size(rhs) > 0").select("tree_id", "pos", "own.lhs", "own.type", "own.name", "rhs", "lexical")


def entity_label_count(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'ENT'").groupBy("name").agg(F.count("*").alias("count"))


def group_instances(nodes: DataFrame, group: str, entities: list[str]) -> DataFrame:
    """Distinct instances of a group: one string column per entity, leaves joined by spaces, null where absent."""
    groups = nodes.where((F.col("type") == "GROUP") & (F.col("name") == group)).select("tree_id", F.col("pos").alias("g"))
    ents = nodes.where("type = 'ENT'").select("tree_id", F.col("pos").alias("e"), "name", parent_pos().alias("g"))
    words = nodes.where("kind = 'LEAF'").select("tree_id", parent_pos().alias("e"), F.struct("pos", "value").alias("w"))
    values = (
        groups.join(ents, ["tree_id", "g"]).join(words, ["tree_id", "e"])
        .groupBy("tree_id", "g", "e", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["value"]), " ").alias("v"))
    )
    one = values.groupBy("tree_id", "g").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in entities])
    return one.select(*entities).distinct()


def compact_group_instances(trees: DataFrame, group: str, entities: list[str]) -> DataFrame:
    """The same from ``trees(tree_id, children)`` of a loader: an array lookup per instance and one distinct."""
    own = trees.select(F.explode(F.flatten(F.transform("children", lambda c: c["groups"]))).alias("g")).where(F.col("g.name") == group)
    values = F.map_from_entries(F.transform("g.ents", lambda e: F.struct(e["name"], e["value"])))
    return own.select(values.alias("m")).select(*[F.col("m")[n].alias(n) for n in entities]).distinct()


def reduce_all(nodes: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Splice out nodes (not roots) with exactly one child and no type of ``skip``; a leaf child moves up too."""
    kids = child_measures(nodes).select("tree_id", "pos", "n_children")
    single = nodes.join(kids, ["tree_id", "pos"], "left").withColumn(
        "__single", (F.coalesce("n_children", F.lit(0)) == 1) & (F.col("kind") == "NODE") & (F.size("pos") > 0)
        & (F.col("type").isNull() | (~F.col("type").isin(*skip) if skip else F.lit(True)))
    ).drop("n_children")
    gone = single.where("__single").select("tree_id", F.col("pos").alias("anc"))
    # A path loses the index of each removed node below it: that index is replaced by the removed node's own.
    hits = with_ancestors(single.where("NOT __single").select("tree_id", "pos")).where(F.size("anc") < F.size("pos")).join(
        gone, ["tree_id", "anc"]
    ).groupBy("tree_id", "pos").agg(F.collect_set(F.size("anc")).alias("levels"))
    kept = single.where("NOT __single").join(hits, ["tree_id", "pos"], "left")
    path = F.filter(F.col("pos"), lambda x, i: ~F.array_contains("levels", i))
    return kept.withColumn("pos", F.when(F.col("levels").isNull(), F.col("pos")).otherwise(path)).select(*nodes.columns)


def apply_renaming(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """Relabel by ``renames(type, old, new)``; a handful of rows that the planner broadcasts by its own size check."""
    r = renames.select(F.col("type").alias("__t"), F.col("old").alias("__o"), F.col("new").alias("__n"))
    joined = nodes.join(r, (F.col("type") == F.col("__t")) & (F.col("name") == F.col("__o")), "left")
    name = F.coalesce("__n", "name")
    return joined.withColumn("label", F.when(F.col("__n").isNotNull(), F.concat("type", F.lit("::"), "__n")).otherwise(F.col("label"))).withColumn(
        "name", name).select(*nodes.columns)


def simple_rewrite(nodes: DataFrame) -> DataFrame:
    """Each tree with an untyped node below the root becomes one group of its first entity per label.

    Columns: tree_id, group_name, entity, value. A group's number is the rank of its label set by first tree.
    """
    untyped = nodes.where("kind = 'NODE' AND type IS NULL AND size(pos) > 0").select("tree_id").distinct()
    ents = nodes.where("type = 'ENT'").join(untyped, "tree_id", "left_semi")
    first = Window.partitionBy("tree_id", "name").orderBy("pos")
    ents = ents.withColumn("k", F.row_number().over(first)).where("k = 1").select("tree_id", F.col("pos").alias("e"), "name")
    words = nodes.where("kind = 'LEAF'").select("tree_id", parent_pos().alias("e"), F.struct("pos", "value").alias("w"))
    values = ents.join(words, ["tree_id", "e"]).groupBy("tree_id", "name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["value"]), " ").alias("value"))
    sets = values.groupBy("tree_id").agg(F.array_sort(F.collect_set("name")).alias("labels"))
    numbers = sets.groupBy("labels").agg(F.min("tree_id").alias("first")).withColumn(
        "n", F.row_number().over(Window.orderBy("first")))  # one row per distinct label set
    return values.join(sets, "tree_id").join(numbers, "labels").select(
        "tree_id", F.concat(F.lit("group_"), F.col("n").cast("string")).alias("group_name"), F.col("name").alias("entity"), "value")


def inspect(nodes: DataFrame) -> DataFrame:
    """One row: trees, counts by type, and sums and maxima of height, leaves and branching."""
    per_tree = nodes.groupBy("tree_id").agg(
        (F.max(F.size("pos")) + 1).alias("height"), F.count_if(F.col("kind") == "LEAF").alias("leaves"),
        F.count_if(F.col("kind") == "NODE").alias("inner"), F.count("*").alias("all"),
        *[F.count_if(F.col("type") == t).alias(t.lower()) for t in ("ENT", "GROUP", "REL", "COLL")],
    )
    branching = child_measures(nodes).agg(F.max("n_children").alias("max_branching"), F.sum("n_children").alias("kids"), F.count("*").alias("parents"))
    return per_tree.agg(
        F.count("*").alias("n_trees"), F.sum("ent").alias("n_ent"), F.sum("group").alias("n_group"), F.sum("rel").alias("n_rel"),
        F.sum("coll").alias("n_coll"), F.max("height").alias("max_height"), F.avg("height").alias("avg_height"),
        F.max("leaves").alias("max_leaves"), F.avg("leaves").alias("avg_leaves"),
    ).join(branching).withColumn("avg_branching", F.col("kids") / F.col("parents")).drop("kids", "parents")


def tallest(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id").agg((F.max(F.size("pos")) + 1).alias("height")).agg(
        F.max_by("tree_id", F.struct("height", "tree_id")).alias("tree_id"), F.max("height").alias("height"))
