"""Schemas inferred from a forest: productions, groups and relations as small tables, and what is derived from them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.model import Node, map_trees, nodes_to_trees, trees_to_nodes
from sylva.operators import forest
from sylva.shared import stored

LEFT, RIGHT, BOTH = "LEFT", "RIGHT", "BOTH"


@dataclass(frozen=True)
class Relation:
    name: str
    left: str
    right: str
    orientation: str = BOTH


@dataclass
class Schema:
    """A schema on the driver; its size is that of a database schema, not of the data."""

    groups: dict[str, frozenset[str]] = field(default_factory=dict)
    relations: frozenset[Relation] = frozenset()
    productions: frozenset[tuple[str, tuple[str, ...]]] = frozenset()

    @classmethod
    def from_description(cls, groups: dict[str, set[str]], relations: set[Relation] = frozenset(), collections: bool = True) -> Schema:
        made: set[tuple[str, tuple[str, ...]]] = set()
        for name, entities in groups.items():
            made.add((f"GROUP::{name}", tuple(sorted(f"ENT::{e}" for e in entities))))
        for r in relations:
            made.add((f"REL::{r.name}", tuple(sorted((f"GROUP::{r.left}", f"GROUP::{r.right}")))))
        if collections:
            made |= {(f"COLL::{n}", (f"GROUP::{n}",)) for n in groups} | {(f"COLL::{r.name}", (f"REL::{r.name}",)) for r in relations}
        return cls({n: frozenset(e) for n, e in groups.items()}, frozenset(relations), frozenset(made))

    @property
    def entities(self) -> set[str]:
        return {e for es in self.groups.values() for e in es}

    def __or__(self, other: Schema) -> Schema:
        groups = {n: self.groups.get(n, frozenset()) | other.groups.get(n, frozenset()) for n in {*self.groups, *other.groups}}
        return Schema(groups, self.relations | other.relations, self.productions | other.productions)

    def ranked(self) -> list[tuple[str, tuple[str, ...]]]:
        """Productions with untyped nodes first, then collections, relations, groups and entities."""
        rank = {"COLL": 1, "REL": 2, "GROUP": 3, "ENT": 4}
        return sorted(self.productions, key=lambda p: (rank.get(p[0].partition("::")[0], 0), p[0], p[1]))

    def as_cfg(self) -> str:
        rules = self.ranked()
        heads = sorted({lhs for lhs, _ in rules})
        return ";\n".join([f"ROOT -> {' '.join(heads)}", *(f"{lhs} -> {' '.join(rhs)}" for lhs, rhs in rules)]) + ";"

    def verify(self) -> bool:
        """Whether the productions are a valid description: plain names, one definition each, relations between two
        different defined groups, and collections of one defined symbol."""
        plain = re.compile(r"[_a-zA-Z0-9]+").fullmatch
        seen = [lhs for lhs, _ in self.productions]
        if len(seen) != len(set(seen)):
            return False
        defined = set(seen)
        for lhs, rhs in self.productions:
            kind, _, name = lhs.partition("::")
            kinds = [c.partition("::")[0] for c in rhs]
            names = name.split("<->") if kind == "REL" else [name]
            if kind not in ("GROUP", "REL", "COLL") or not rhs or not all(map(plain, names)) and kind != "COLL":
                return False
            if kind == "GROUP" and (set(kinds) != {"ENT"} or not all(plain(c.partition("::")[2]) for c in rhs)):
                return False
            if kind == "REL" and (kinds != ["GROUP", "GROUP"] or rhs[0] == rhs[1] or not set(rhs) <= defined):
                return False
            if kind == "COLL" and (len(rhs) != 1 or kinds[0] not in ("GROUP", "REL") or rhs[0] not in defined):
                return False
        return True

    def group_overlap(self) -> float:
        pairs = list(combinations(self.groups.values(), 2))
        return sum(len(a & b) / len(a | b) if a | b else 1.0 for a, b in pairs) / len(pairs) if pairs else 0.0

    def group_balance(self) -> float:
        sizes = [len(e) for e in self.groups.values()]
        if not sizes:
            return 1.0
        mean = sum(sizes) / len(sizes)
        spread = (sum((s - mean) ** 2 for s in sizes) / len(sizes)) ** 0.5
        return 1 - (spread / mean if mean else 1.0)

    def collapsible_groups(self) -> set[str]:
        """Groups that stand exactly twice on the one-side of a 1-n relation, and nowhere else."""
        weight: dict[str, int] = {}
        for r in self.relations:
            weight[r.left] = weight.get(r.left, 0) + (1 if r.orientation == RIGHT else 3)
            weight[r.right] = weight.get(r.right, 0) + (1 if r.orientation == LEFT else 3)
        return {g for g, w in weight.items() if w == 2}

    def to_tree(self) -> Node:
        rules = dict(self.productions)

        def grow(label: str, above: frozenset[str]) -> Node:
            rhs = () if label in above else rules.get(label, ())
            return Node(label, tuple(grow(c, above | {label}) for c in rhs))

        return Node("ROOT", tuple(grow(lhs, frozenset()) for lhs, _ in self.ranked()))

    def labels(self) -> list[str]:
        return sorted({f"ENT::{e}" for e in self.entities} | {f"GROUP::{g}" for g in self.groups} | {f"REL::{r.name}" for r in self.relations})


def productions(nodes: DataFrame, keep_unlabelled: bool = True) -> DataFrame:
    """lhs and sorted rhs. Groups merge all their children; a collection keeps the child label that comes first.

    The forest is read once: what is asked of its distinct rules is asked of a table of them.
    """
    rows = stored(forest.productions(nodes).where("NOT lexical AND lhs <> 'ROOT'").groupBy("lhs", "type", "rhs").agg(
        F.min(F.struct("tree_id", "pos")).alias("at")), "rules")
    groups = rows.where("type = 'GROUP'").select("lhs", F.explode("rhs").alias("c")).groupBy("lhs").agg(F.array_sort(F.collect_set("c")).alias("rhs"))
    relations = rows.where("type = 'REL' AND size(rhs) = 2").select("lhs", F.array_sort("rhs").alias("rhs")).distinct()
    colls = rows.where("type = 'COLL'").groupBy("lhs").agg(F.array(F.min_by(F.col("rhs")[0], F.col("at"))).alias("rhs"))
    out = groups.union(relations).union(colls)
    if keep_unlabelled:
        other = rows.where("type IS NULL OR (type = 'REL' AND size(rhs) <> 2) OR type = 'ENT'")
        out = out.union(other.select("lhs", F.array_sort(F.array_distinct("rhs")).alias("rhs")).distinct())
    return out


def groups(nodes: DataFrame) -> DataFrame:
    """name and sorted entities, one row per group."""
    return productions(nodes, False).where(F.col("lhs").startswith("GROUP::")).select(
        F.substring_index("lhs", "GROUP::", -1).alias("name"),
        F.array_sort(F.transform(F.filter("rhs", lambda c: c.startswith("ENT::")), lambda c: F.substr(c, F.lit(6)))).alias("entities"))


def relation_examples(nodes: DataFrame) -> DataFrame:
    """Each relation between two groups: relation, left and right name and oid."""
    # A node is a row under its parent's place, and a relation one under its own: they meet without a join.
    up = F.when(F.col("type") == "REL", F.array(forest.parent_pos(), F.col("pos"))).otherwise(F.array(forest.parent_pos()))
    rows = nodes.where("size(pos) > 0 OR type = 'REL'").select(
        "tree_id", "type", "name", "oid", F.size("pos").alias("depth"), F.element_at(F.concat(F.array(F.lit(0)), "pos"), -1).alias("ord"), F.explode(up).alias("r")).where("r IS NOT NULL")
    itself = F.size("r") == F.col("depth")
    both = rows.groupBy("tree_id", "r").agg(
        F.first(F.when(itself, F.struct(F.col("name").alias("relation"))), ignorenulls=True).alias("own"),
        F.count_if(~itself).alias("n"), F.count_if(~itself & F.coalesce(F.col("type") == "GROUP", F.lit(False))).alias("g"),
        *[F.max(F.when(~itself & (F.col("ord") == i), F.col(c))).alias(f"{side}_{c}") for i, side in enumerate(("left", "right")) for c in ("name", "oid")],
    )
    return both.where("own IS NOT NULL AND n = 2 AND g = 2").select(
        "own.relation", "left_name", "left_oid", "right_name", "right_oid", F.struct("tree_id", F.col("r").alias("pos")).alias("at"))


def orientations(examples: DataFrame) -> DataFrame:
    """name, left, right, orientation. A side is multiple if one of its records takes part in two different pairs.

    ``examples`` are pairs: relation, left_name, left_oid, right_name, right_oid (others are ignored). A record is in two
    pairs if the smallest and the largest of its partners differ, told by 128 bits of their oids, so no pair is shuffled.
    """
    pairs = examples.select("relation", "left_name", "right_name", *[
        F.struct(F.xxhash64(f"{s}_oid").alias("h1"), F.xxhash64(F.lit("oid"), f"{s}_oid").alias("h2")).alias(s) for s in ("left", "right")])
    sides = pairs.select("relation", F.explode(F.array(
        F.struct(F.col("left_name").alias("side"), F.col("left").alias("own"), F.col("right").alias("other")),
        F.struct(F.col("right_name").alias("side"), F.col("right").alias("own"), F.col("left").alias("other")))).alias("x")).select("relation", "x.*")
    one = sides.groupBy("relation", "side", F.col("own.h1").alias("k1"), F.col("own.h2").alias("k2")).agg(
        *[f(f"other.{h}").alias(f"{n}_{h}") for n, f in (("min", F.min), ("max", F.max)) for h in ("h1", "h2")])
    multi = stored(one.groupBy("relation", "side").agg(
        F.max((F.col("min_h1") != F.col("max_h1")) | (F.col("min_h2") != F.col("max_h2"))).alias("multi")), "sides")
    names = pairs.select("relation", "left_name", "right_name").distinct().groupBy("relation").agg(
        F.min(F.struct("left_name", "right_name")).alias("p")).where("p.left_name <> p.right_name").select(
        "relation", F.col("p.left_name").alias("left"), F.col("p.right_name").alias("right"))
    only = multi.groupBy("relation").agg(F.count("*").alias("k")).where("k = 2")
    l, r = (multi.select("relation", F.col("side").alias(s), F.col("multi").alias(f"{s}_multi")) for s in ("left", "right"))
    return names.join(only, "relation").join(l, ["relation", "left"]).join(r, ["relation", "right"]).select(
        F.col("relation").alias("name"), "left", "right",
        F.when(F.col("left_multi") == F.col("right_multi"), BOTH).when(F.col("left_multi"), LEFT).otherwise(RIGHT).alias("orientation"))


def compact_examples(trees: DataFrame) -> DataFrame:
    """Relation examples straight from ``trees(tree_id, children)`` of a loader."""
    rel = trees.select(F.explode("children").alias("c")).where("c.type = 'REL'")
    g = F.col("c.groups")
    return rel.select(F.col("c.name").alias("relation"), g[0]["name"].alias("left_name"), g[0]["oid"].alias("left_oid"),
                      g[1]["name"].alias("right_name"), g[1]["oid"].alias("right_oid")).distinct()


def infer(nodes: DataFrame, keep_unlabelled: bool = True) -> Schema:
    """The schema of a forest, collected: one row per production, group and relation."""
    rules = frozenset((r["lhs"], tuple(r["rhs"])) for r in productions(nodes, keep_unlabelled).collect())
    found = {r["name"]: frozenset(r["entities"]) for r in groups(nodes).collect()}
    relations = frozenset(Relation(r["name"], r["left"], r["right"], r["orientation"]) for r in orientations(relation_examples(nodes)).collect())
    return Schema(found, relations, rules)


def keep_valid(tree: Node, valid: frozenset[str]) -> Node | None:
    """A tree without nodes of other labels than ``valid``: their child nodes move up in place, their leaves go.

    An unknown root becomes ROOT, without leaves and entities directly below. None where nothing is left.
    """

    def children(c: Node) -> list[Node | str]:
        out: list[Node | str] = []
        for k in c.children:
            if isinstance(k, str):
                out.append(k)
            elif k.label in valid:
                out.append(replace(k, children=tuple(children(k))))
            else:
                out += [x for x in children(k) if not isinstance(x, str)]
        return out

    kids = children(tree)
    if tree.label not in valid:
        kids = [x for x in kids if not isinstance(x, str) and x.type != "ENT"]
        tree = replace(tree, label="ROOT")
    return replace(tree, children=tuple(kids)) if kids else None


def valid_trees(nodes: DataFrame, schema: Schema) -> DataFrame:
    """The forest with what the schema does not know taken out. Trees are gathered once; the rest is narrow."""
    valid = frozenset(schema.labels())
    return trees_to_nodes(map_trees(nodes_to_trees(nodes), lambda t: (keep_valid(t, valid), True)))


def datasets(nodes: DataFrame, schema: Schema) -> dict[str, DataFrame]:
    """A de-duplicated table per group, its columns those of the schema."""
    return {g: forest.group_instances(nodes, g, sorted(e)) for g, e in schema.groups.items()}


def overlap(groups_table: DataFrame) -> DataFrame:
    """One row: mean Jaccard index over all pairs of ``groups(name, entities)``; as many rows as a schema has groups."""
    a = groups_table.select(F.col("name").alias("a"), F.col("entities").alias("ea"))
    b = groups_table.select(F.col("name").alias("b"), F.col("entities").alias("eb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    union = F.size(F.array_union("ea", "eb"))
    value = F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("ea", "eb")) / union)
    return pairs.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("overlap"))


def balance(groups_table: DataFrame) -> DataFrame:
    """One row: 1 minus the groups' sizes' standard deviation over their mean; 1 without groups."""
    size = F.size("entities")
    return groups_table.agg(F.coalesce(
        F.when(F.avg(size) == 0, F.lit(0.0)).otherwise(1 - F.stddev_pop(size) / F.avg(size)), F.lit(1.0)).alias("balance"))


def collapsible(relations: DataFrame) -> DataFrame:
    """Names of groups that stand exactly twice on the one-side of a 1-n relation of ``relations(left, right, orientation)``."""
    weights = relations.select(F.col("left").alias("name"), F.when(F.col("orientation") == RIGHT, 1).otherwise(3).alias("w")).union(
        relations.select("right", F.when(F.col("orientation") == LEFT, 1).otherwise(3)))
    return weights.groupBy("name").agg(F.sum("w").alias("w")).where("w = 2").select("name")
