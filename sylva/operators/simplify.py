"""The fixed point of rewriting: cluster, form groups, apply the first operator that changes anything, again.

Each round is one job over the forest's distinct shapes, which are written to the shared folder, which ends the lineage.
Clusters go to the tasks as supports and a few representatives per cluster.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.model import TREE_SCHEMA, Node, from_json, map_trees, reduce_all, sliced, to_json, trees_to_nodes
from sylva.operators import cluster, rewrite
from sylva.shared import stored

Operation = Callable[[Node, rewrite.Equivalence, int], rewrite.Change]

#: Collections are looked for twice: before groups merge, and after relations were found.
DEFAULT_OPERATIONS: list[tuple[str, Operation]] = [
    ("find_subgroups", rewrite.find_subgroups),
    ("merge_groups", rewrite.merge_groups),
    ("find_collections", lambda t, k, s: rewrite.find_collections(t)),
    ("find_relations", lambda t, k, s: rewrite.find_relations(t)),
    ("find_collections_again", lambda t, k, s: rewrite.find_collections(t)),
    ("reduce_bottom", lambda t, k, s: rewrite.reduce_bottom(t)),
    ("reduce_top", lambda t, k, s: rewrite.reduce_top(t)),
]


def equivalence(members: DataFrame, tau: float, metric: str, decay: float, top: int = 20) -> rewrite.Equivalence:
    """Supports and up to ``top + 1`` representatives of each cluster, by rank; one row per cluster is collected."""
    chain = F.transform("ctx", lambda e: F.struct(F.when(e["typed"], e["label"]).alias("label"), e["labels"].alias("labels")))
    rows = members.where(F.col("rank") <= top + 1).groupBy("cluster", "size").agg(F.collect_set(chain).alias("chains")).collect()
    return rewrite.Equivalence(
        {r["cluster"]: [[(e["label"], frozenset(e["labels"])) for e in c] for c in r["chains"]] for r in rows},
        {r["cluster"]: r["size"] for r in rows}, tau, metric, decay)


def shape_of(tree: Node, known: dict[str, tuple[str, str]] | None = None) -> tuple[str, str, list[str], list[tuple[str, str]]]:
    """(id, tree, leaves, (oid, metadata) of its nodes) of a tree's shape: labels and order without values and ids.

    In the shape a leaf is its number, and a node's oid is the shape's id with the node's number. ``known`` holds ids and
    trees of shapes seen before by their outline.
    """
    leaves: list[str] = []
    nodes: list[tuple[str, str]] = []
    outline: list[str] = []

    def visit(n: Node | str) -> None:
        if isinstance(n, str):
            leaves.append(n)
            outline.append(".")
            return
        nodes.append((n.oid, json.dumps(n.metadata, sort_keys=True) if n.metadata else ""))
        outline.append(f"{len(n.label)}:{n.label}(")
        for c in n.children:
            visit(c)
        outline.append(")")

    visit(tree)
    text = "".join(outline)
    known = {} if known is None else known
    if text not in known:
        key = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]
        numbers = count(), count()

        def named(n: Node | str) -> Node | str:
            if isinstance(n, str):
                return str(next(numbers[0]))
            oid = f"{key}:{next(numbers[1])}"
            return Node(n.label, tuple(named(c) for c in n.children), oid)

        known[text] = key, to_json(named(tree))
    return *known[text], leaves, nodes


def fill_in(shape: Node, key: str, tree_id: str, leaves: list[str], nodes: list[tuple[str, str]]) -> Node:
    """A rewritten shape with one tree's values and ids; nodes that rewriting made get ids from the tree's."""

    def visit(n: Node | str) -> Node | str:
        if isinstance(n, str):
            return leaves[int(n)]
        kids = tuple(visit(c) for c in n.children)
        owner, _, number = n.oid.partition(":")
        if owner == key and number:
            oid, metadata = nodes[int(number)]
            return Node(n.label, kids, oid, json.loads(metadata) if metadata else {})
        return Node(n.label, kids, str(uuid.uuid5(uuid.NAMESPACE_OID, f"{tree_id}/{n.oid}")))

    return visit(shape)


_PACKED = "tree_id string, shape string, tree string, leaves array<string>, nodes array<struct<oid:string,metadata:string>>"


def packed(trees: DataFrame) -> DataFrame:
    """tree_id, shape, the shape's tree, leaves and nodes of each of ``trees(tree_id, tree)``; narrow."""

    def run(batches):
        names = ["tree_id", "shape", "tree", "leaves", "nodes"]
        pair = pa.list_(pa.struct([("oid", pa.string()), ("metadata", pa.string())]))
        known: dict[str, tuple[str, str]] = {}
        for batch in sliced(batches, 256):
            if len(known) > 10_000:
                known.clear()
            rows = [shape_of(from_json(t), known) for t in batch.column("tree").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.list_(pa.string())),
                 pa.array([[{"oid": o, "metadata": m} for o, m in r[3]] for r in rows], pair)], names=names)

    return trees.select("tree_id", "tree").where("tree IS NOT NULL").mapInArrow(run, _PACKED)


def shapes_of(rows: DataFrame) -> DataFrame:
    """One row per shape of ``rows`` of :func:`packed`: shape, tree_id (the smallest), n trees, and the shape's tree."""
    return rows.groupBy("shape").agg(F.min("tree_id").alias("tree_id"), F.count("*").alias("n"), F.first("tree").alias("tree"))


def shape_counts(trees: DataFrame) -> DataFrame:
    """The same from ``trees(tree_id, tree)``: each task counts its shapes, so no tree is sorted or shuffled."""

    def run(batches):
        def made() -> pa.RecordBatch:
            columns = list(zip(*((k, least, n, tree) for k, (least, n, tree) in held.items()), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                names=["shape", "tree_id", "n", "tree"])

        held: dict[str, tuple[str, int, str]] = {}
        known: dict[str, tuple[str, str]] = {}
        for batch in sliced(batches):
            for tree_id, t in zip(batch.column("tree_id").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                key, tree, _, _ = shape_of(from_json(t), known)
                least, n, _ = held.get(key, (tree_id, 0, tree))
                held[key] = min(least, tree_id), n + 1, tree
            if len(held) > 10_000:
                yield made()
                held.clear()
                known.clear()
        yield made()

    parts = trees.select("tree_id", "tree").where("tree IS NOT NULL").mapInArrow(run, "shape string, tree_id string, n long, tree string")
    return parts.groupBy("shape").agg(F.min("tree_id").alias("tree_id"), F.sum("n").alias("n"), F.first("tree").alias("tree"))


def unpacked(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """``rows`` of :func:`packed` with the trees that ``shapes(shape, new)`` have become; narrow after the join."""

    def run(batches):
        known: dict[str, Node] = {}
        for batch in sliced(batches, 256):
            if len(known) > 10_000:
                known.clear()
            out = []
            columns = [batch.column(c).to_pylist() for c in ("tree_id", "shape", "new", "leaves", "nodes")]
            for tree_id, key, new, leaves, nodes in zip(*columns, strict=True):
                shape = known.get(key) or known.setdefault(key, from_json(new))
                out.append(to_json(fill_in(shape, key, tree_id, leaves, [(n["oid"], n["metadata"]) for n in nodes])))
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), pa.array(out, pa.string())], names=["tree_id", "tree"])

    return rows.drop("tree").join(shapes.select("shape", "new"), "shape").mapInArrow(run, TREE_SCHEMA)


def _form_groups(trees: DataFrame, members: DataFrame, min_support: int) -> DataFrame:
    """Trees with the members of clusters above ``min_support`` made groups: largest cluster first."""
    w = F.col("weight")
    stats = members.groupBy("cluster").agg(
        F.sum(w).alias("n"), (F.sum(w * F.col("n_entities")) / F.sum(w)).alias("e"), (F.sum(w * F.size("pos")) / F.sum(w)).alias("d")
    ).where(F.col("n") > min_support)
    order = F.row_number().over(Window.orderBy(F.desc("n"), F.desc("e"), F.desc("d"), "cluster"))  # one row per cluster
    ranked = stats.withColumn("order", order).select("cluster", "order")
    places = members.join(ranked, "cluster").groupBy("tree_id").agg(F.collect_list(F.struct("order", "cluster", "pos")).alias("places"))
    joined = trees.join(places, "tree_id", "left").select("tree_id", "tree", "places")

    def run(batches):
        for batch in batches:
            out, flags = [], []
            for t, ps in zip(batch.column("tree").to_pylist(), batch.column("places").to_pylist(), strict=True):
                by: dict[tuple[int, str], set] = {}
                for p in ps or []:
                    by.setdefault((p["order"], p["cluster"]), set()).add(tuple(p["pos"]))
                new, changed = rewrite.create_groups(from_json(t), [(c, paths) for (_, c), paths in sorted(by.items())])
                out.append(to_json(new) if by else t)
                flags.append(changed)
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), pa.array(out, pa.string()), pa.array(flags, pa.bool_())], names=["tree_id", "tree", "changed"])

    return joined.mapInArrow(run, TREE_SCHEMA + ", changed boolean")


def _first_changes(trees: DataFrame, operations: list[tuple[str, Operation]], known: rewrite.Equivalence, support: int) -> DataFrame:
    """tree_id, tree, the first operator that changes it (null where none does) and what it makes of it; narrow."""

    def run(batches):
        for batch in batches:
            first, news = [], []
            for t in batch.column("tree").to_pylist():
                tree, at, new = from_json(t), None, None
                for i, (_, operation) in enumerate(operations):
                    changed_tree, changed = operation(tree, known, support)
                    if changed:
                        at, new = i, to_json(changed_tree)
                        break
                first.append(at)
                news.append(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree_id"), batch.column("tree"), pa.array(first, pa.int32()), pa.array(news, pa.string())],
                names=["tree_id", "tree", "first", "new"])

    return trees.select("tree_id", "tree").mapInArrow(run, TREE_SCHEMA + ", first int, new string")


def simplify(trees: DataFrame, tau: float = 0.7, decay: float = 2.0, epochs: int | None = 100, min_support: int | None = None,
             metric: str = "jaro", operations: list[tuple[str, Operation]] | None = None, names: bool = True) -> tuple[DataFrame, list[str]]:
    """``trees(tree_id, tree)`` rewritten to a fixed point, and the operator that made each round's change.

    Rewriting looks at labels and order only, so it works on distinct shapes with the number of trees that each stands
    for; values and ids are put back at the end. A round applies to each shape the first operator that would change it,
    and keeps what the earliest of these operators did: that is one pass over the shapes, with the same outcome as
    operator after operator over all of them.

    At most ``epochs`` rounds, or as many as it takes where that is None; then a forest that comes back to an earlier
    state has no fixed point, which is an error. ``min_support`` defaults to a tenth of the trees, 2 at least.
    """
    if not 0 <= tau <= 1 or decay <= 0:
        raise ValueError("tau must be between 0 and 1, decay above 0")
    steps = operations or DEFAULT_OPERATIONS
    source = stored(packed(trees), "forest")
    shapes = stored(shapes_of(source), "shapes")
    weights, now = shapes.select("tree_id", "n"), shapes.select("tree_id", "tree")
    support = min_support if min_support is not None else max((shapes.agg(F.sum("n")).first()[0] or 0) // 10, 2)
    log: list[str] = []
    seen_states: set[tuple] = set()
    for _ in count() if epochs is None else range(epochs):
        if epochs is None:
            state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("tree_id", "tree").cast("decimal(38,0)"))).first())
            if state in seen_states:
                raise RuntimeError("rewriting goes in circles")
            seen_states.add(state)
        now = stored(map_trees(now, lambda t: (reduce_all(t, frozenset({"ENT"})), True)).select("tree_id", "tree"), "forest")
        members = stored(cluster.clusters(trees_to_nodes(now), tau, metric, decay, weights=weights), "members")
        grouped = stored(_form_groups(now, members, support), "forest")
        formed = bool(grouped.where("changed").take(1))
        known = equivalence(members, tau, metric, decay)
        done = stored(_first_changes(grouped, steps, known, support), "forest")
        first = done.agg(F.min("first")).first()[0]
        now = done.select("tree_id", F.when(F.col("first") == first, F.col("new")).otherwise(F.col("tree")).alias("tree"))
        if first is not None:
            log.append(steps[first][0])
        elif formed:
            log.append("create_groups")
        else:
            break
    for last in (rewrite.find_relations, rewrite.find_collections):
        now = map_trees(now, lambda t, f=last: f(t, naming_only=True)).select("tree_id", "tree")
    now = stored(now, "forest")
    if names:
        seen = trees_to_nodes(now).where("type = 'GROUP'").groupBy("name").agg(F.min(F.struct("tree_id", "pos")).alias("at"))
        new = rewrite.simplified_names([r["name"] for r in seen.orderBy("at").collect()])  # one row per group name
        now = stored(map_trees(now, lambda t: rewrite.rename(t, new)).select("tree_id", "tree"), "forest")
    by_shape = shapes.select("tree_id", "shape").join(now.select("tree_id", F.col("tree").alias("new")), "tree_id")
    return stored(unpacked(source, by_shape), "forest"), log
