"""Relational tables as a forest: one tree per row of a root table, grown along foreign keys.

A row's tree holds the rows that its foreign keys lead to, and theirs. The foreign-key graph is walked once, on the
driver, and becomes a chain of left equi-joins; a tree is then an array built from one joined row, so its nodes need no shuffle.
Small dimension tables are broadcast by the planner's own size check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions import record_oid
from sylva.shared import dealt as dealt_rows
from sylva.shared import parts

NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"  # the fixed object-identifier namespace of RFC 4122


@dataclass(frozen=True)
class ForeignKey:
    """A key to ``target``; ``more`` holds further (column, target column) pairs of a composite one."""

    column: str
    target: str
    target_column: str
    more: tuple[tuple[str, str], ...] = ()

    @property
    def pairs(self) -> tuple[tuple[str, str], ...]:
        return ((self.column, self.target_column), *self.more)


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[str, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()

    @property
    def is_association(self) -> bool:
        """A link table: two columns, both key and both foreign keys."""
        return len(self.foreign_keys) == len(self.primary_key) == len(self.columns) == 2

    @property
    def attributes(self) -> list[str]:
        keys = {a for k in self.foreign_keys for a, _ in k.pairs}
        return [c for c in self.columns if c not in keys]


Catalog = dict[str, Table]


def cycle_tables(catalog: Catalog) -> set[str]:
    """For every foreign-key cycle its table with most foreign keys (ties: the smallest name)."""
    found: set[str] = set()

    def visit(name: str, path: list[str]) -> None:
        if name in path:
            cycle = path[path.index(name):]
            found.add(min(cycle, key=lambda t: (-len(catalog[t].foreign_keys), t)))
            return
        for key in catalog[name].foreign_keys:
            if key.target in catalog:
                visit(key.target, [*path, name])

    for name in sorted(catalog):
        visit(name, [])
    return found


def root_tables(catalog: Catalog) -> list[str]:
    """Tables that no table refers to, and one per cycle; all tables where there is no foreign key at all."""
    referred = {k.target for t in catalog.values() for k in t.foreign_keys}
    if not referred:
        return sorted(catalog)
    return sorted((set(catalog) - referred) | cycle_tables(catalog))


@dataclass
class Step:
    """A place in the walk: the table as ``alias``, reached by ``key`` from ``parent`` (None at the root)."""

    alias: str
    table: str
    parent: str | None = None
    key: ForeignKey | None = None


def plan_walk(catalog: Catalog, root: str) -> list[Step]:
    """The walk from a root: depth first, foreign keys by column name, each key once per tree."""
    steps: list[Step] = []
    visited: set[tuple[str, str]] = set()

    def visit(table: str, parent: str | None, key: ForeignKey | None) -> None:
        alias = f"a{len(steps)}"
        steps.append(Step(alias, table, parent, key))
        for k in sorted(catalog[table].foreign_keys, key=lambda k: k.column):
            if (table, k.column) not in visited and k.target in catalog:
                visited.add((table, k.column))
                visit(k.target, alias, k)

    visit(root, None, None)
    return steps


GROUP_TYPE = "struct<name:string,oid:string,ents:array<struct<name:string,value:string>>>"


def entity_name(column: str) -> str:
    return column.replace(" ", "_")


@dataclass
class Walk:
    """Trees of one root table, as joined rows and the template that reads them."""

    catalog: Catalog
    steps: list[Step]
    joined: DataFrame
    root_columns: list[str]
    namespace: str = NAMESPACE
    association: bool = False
    relation_names: dict[str, str] = field(default_factory=dict)
    chained: Callable[[list[Step]], DataFrame] | None = None

    def chain(self, step: Step) -> DataFrame:
        """Joined rows without the tables that lie on no way from the root to ``step``; a left join never drops a row."""
        if self.chained is None:
            return self.joined
        wanted = {s.alias for s in self.steps if self.association and s.parent == "a0"}
        while step.parent is not None:
            wanted.add(step.alias)
            step = self.by_alias(step.parent)
        return self.chained([s for s in self.steps[1:] if s.alias in wanted])

    def col(self, alias: str, column: str) -> Column:
        return F.col(f"`{alias}.{column}`")

    def present(self, step: Step) -> Column:
        return F.lit(True) if step.parent is None else F.col(f"`{step.alias}.__there`").isNotNull()

    def oid(self, step: Step) -> Column:
        table = self.catalog[step.table]
        key = table.primary_key or table.columns
        return record_oid(self.namespace, table.name, {k: self.col(step.alias, k) for k in key})

    def entities(self, step: Step) -> list[tuple[str, Column]]:
        return [(entity_name(c), self.col(step.alias, c).cast("string")) for c in self.catalog[step.table].attributes]

    def group(self, step: Step) -> Column:
        ents = F.filter(
            F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in self.entities(step)]),
            lambda e: e["value"].isNotNull(),
        ) if self.entities(step) else F.array().cast("array<struct<name:string,value:string>>")
        return F.struct(F.lit(step.table).alias("name"), F.col(f"`{step.alias}.__oid`").alias("oid"), ents.alias("ents"))

    def relation_name(self, step: Step) -> str:
        return f"{self.by_alias(step.parent).table}<->{step.table}"

    def by_alias(self, alias: str | None) -> Step:
        return next(s for s in self.steps if s.alias == alias)

    def children(self) -> Column:
        """The root's children in order; a relation holds its two groups, a group holds itself."""
        kids = []
        for step in self.steps:
            if step.parent is not None and not (self.association and step.parent == "a0"):
                parent = self.by_alias(step.parent)
                meta = F.create_map(
                    F.lit("source"), F.lit(parent.table), F.lit("target"), F.lit(step.table),
                    F.lit("source_column"), F.lit(step.key.column),
                )
                kids.append((step, F.struct(
                    F.lit("REL").alias("type"), F.lit(self.relation_name(step)).alias("name"), meta.alias("metadata"),
                    F.array(self.group(parent), self.group(step)).alias("groups"),
                )))
            elif self.association and step.parent is None:
                left, right = [s for s in self.steps if s.parent == "a0"]
                none = F.lit(None).cast("map<string,string>")
                kids.append((step, F.struct(
                    F.lit("REL").alias("type"), F.lit(step.table).alias("name"), none.alias("metadata"),
                    F.array(self.group(left), self.group(right)).alias("groups"),
                )))
            if not (self.association and step.parent is None):
                none = F.lit(None).cast("map<string,string>")
                kids.append((step, F.struct(
                    F.lit("GROUP").alias("type"), F.lit(step.table).alias("name"), none.alias("metadata"),
                    F.array(self.group(step)).alias("groups"),
                )))
        made = F.array(*[F.when(self.present(s), k) for s, k in kids])
        return F.filter(made, lambda k: k.isNotNull())

    def trees(self, dealt: bool = False) -> DataFrame:
        """tree_id and children (array of groups and relations) per tree; ``dealt`` by id before a tree is built.

        The id is a UUID over all columns of the root row and the row's number among its equals, so rows repeated in a
        table without a key stay apart, and ids do not depend on how rows are dealt.
        """
        root = self.steps[0]
        key = self.catalog[root.table].primary_key
        columns = {c: self.col("a0", c) for c in self.root_columns}
        base = record_oid(self.namespace, f"{root.table}#tree", columns)
        rows = dealt_rows(self.joined) if dealt else self.joined  # ids are work too, and a compact file is one part
        rows = rows.withColumns({"__base": base} | {f"{s.alias}.__oid": self.oid(s) for s in self.steps})
        if dealt:
            rows = rows.repartition(parts(rows.sparkSession), "__base")
        if key and set(key) <= set(self.root_columns):
            return rows.select(F.col("__base").alias("tree_id"), self.children().alias("children"))
        number = F.row_number().over(Window.partitionBy("__base").orderBy(F.lit(1)))
        again = record_oid(self.namespace, f"{root.table}#tree", columns | {"#": F.col("__n")})
        return rows.withColumn("__n", number).withColumn(
            "__id", F.when(F.col("__n") == 1, F.col("__base")).otherwise(again)
        ).select(F.col("__id").alias("tree_id"), self.children().alias("children"))

    def nodes(self) -> DataFrame:
        """Node rows. Rows are dealt while they are small, so trees are built by all cores, and what is then grouped by
        tree needs no shuffle of nodes."""
        return trees_as_nodes(self.trees(dealt=True))

    def sizes(self) -> DataFrame:
        """height and n_leaves per tree without building a node."""
        deep, leaves = [F.lit(1)], [F.lit(0).cast("long")]
        for step in self.steps:
            own = lambda s: sum((v.isNotNull().cast("long") for _, v in self.entities(s)), F.lit(0).cast("long"))
            if self.association and step.parent is None:
                places = [(3, [s for s in self.steps if s.parent == "a0"])]
            else:
                linked = step.parent is not None and not (self.association and step.parent == "a0")
                places = [(2, [step])] + ([(3, [self.by_alias(step.parent), step])] if linked else [])
            for level, groups in places:
                n = sum(map(own, groups), F.lit(0).cast("long"))
                deep.append(F.when(self.present(step), F.when(n > 0, level + 2).otherwise(level)))
                leaves.append(F.when(self.present(step), n).otherwise(F.lit(0)))
        return self.joined.select(F.greatest(*deep).cast("int").alias("height"), sum(leaves[1:], leaves[0]).alias("n_leaves"))

    def records(self, table: str) -> DataFrame:
        """Distinct records of a table in the trees, without building one: oid and the names of the entities that they have."""
        out = None
        for step in self.steps:
            if step.table != table or (self.association and step.parent is None):
                continue
            key = self.catalog[table].primary_key or self.catalog[table].columns
            there = [v.isNotNull().alias(f"__e{i}") for i, (_, v) in enumerate(self.entities(step))]
            rows = self.chain(step).where(self.present(step)).select(*[self.col(step.alias, k) for k in key], *there).distinct()
            names = F.array_compact(F.array(*[F.when(F.col(f"__e{i}"), F.lit(n)) for i, (n, _) in enumerate(self.entities(step))]))
            rows = rows.select(self.oid(step).alias("oid"), names.alias("entities"))
            out = rows if out is None else out.union(rows)
        return out

    def relation_examples(self) -> DataFrame:
        """Distinct pairs of records per relation, by their keys: what orientation needs, without building a tree."""

        def key(step: Step) -> Column:
            table = self.catalog[step.table]
            parts = [F.coalesce(self.col(step.alias, k).cast("string"), F.lit("")) for k in table.primary_key or table.columns]
            return F.concat_ws("\x1f", F.lit(step.table), *parts)

        out = None
        for step in self.steps[1:]:
            parent = self.by_alias(step.parent)
            pairs = self.chain(step).where(self.present(step)).select(
                F.lit(self.relation_name(step)).alias("relation"), F.lit(parent.table).alias("left_name"), key(parent).alias("left_oid"),
                F.lit(step.table).alias("right_name"), key(step).alias("right_oid"),
            ).distinct()
            out = pairs if out is None else out.union(pairs)
        return out

    def label_counts(self) -> DataFrame:
        """type, name and count over all trees without building a node: one aggregate over the joined rows."""
        sums: dict[tuple[str, str], list[Column]] = {("", "ROOT"): [F.count(F.lit(1))]}

        def add(type_: str, name: str, amount: Column) -> None:
            sums.setdefault((type_, name), []).append(amount)

        def group(step: Step, present: Column) -> None:
            add("GROUP", step.table, F.count(F.when(present, 1)))
            for name, value in self.entities(step):
                add("ENT", name, F.count(F.when(present, value)))

        for step in self.steps:
            there = self.present(step)
            if self.association and step.parent is None:
                add("REL", step.table, F.count(F.lit(1)))
                for s in self.steps:
                    if s.parent == "a0":
                        group(s, there)
                continue
            if step.parent is not None and not (self.association and step.parent == "a0"):
                add("REL", self.relation_name(step), F.count(F.when(there, 1)))
                group(self.by_alias(step.parent), there)
                group(step, there)
            group(step, there)
        totals = [F.struct(
            F.lit(t or None).cast("string").alias("type"), F.lit(n).alias("name"), sum(c[1:], c[0]).cast("long").alias("count")
        ) for (t, n), c in sums.items()]
        return self.joined.agg(F.array(*totals).alias("x")).select(F.explode("x").alias("x")).select("x.*").where("count > 0")


def trees_as_nodes(trees: DataFrame) -> DataFrame:
    """Node rows of ``trees(tree_id, children)``; narrow."""
    none, no_meta = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")

    def node(pos: Column, type_: Column, name: Column, oid: Column, value: Column, kind: str, meta: Column) -> Column:
        label = F.when(F.lit(kind) == "LEAF", none).when(type_.isNull(), name).otherwise(F.concat(type_, F.lit("::"), name))
        return F.struct(
            pos.cast("array<int>").alias("pos"), F.lit(kind).alias("kind"), oid.alias("oid"), type_.alias("type"),
            name.alias("name"), label.alias("label"), value.alias("value"), meta.alias("metadata"),
        )

    def group(pos: Column, g: Column) -> Column:
        inner = F.transform(g["ents"], lambda e, j: F.array(
            node(F.array_append(pos, j), F.lit("ENT"), e["name"], F.concat_ws("/", g["oid"], e["name"]), none, "NODE", no_meta),
            node(F.concat(pos, F.array(j, F.lit(0))), none, none, none, e["value"], "LEAF", no_meta),
        ))
        return F.concat(F.array(node(pos, F.lit("GROUP"), g["name"], g["oid"], none, "NODE", no_meta)), F.flatten(inner))

    def child(c: Column, i: Column) -> Column:
        at = F.array(i)
        relation = node(at, F.lit("REL"), c["name"], none, none, "NODE", c["metadata"])
        return F.when(c["type"] == "GROUP", group(at, c["groups"][0])).otherwise(
            F.concat(F.array(relation), F.flatten(F.transform(c["groups"], lambda g, k: group(F.array(i, k), g))))
        )

    root = node(F.array().cast("array<int>"), none, F.lit("ROOT"), F.col("tree_id"), none, "NODE", no_meta)
    rows = F.concat(F.array(root), F.flatten(F.transform("children", child)))
    whole = trees.select("tree_id", rows.alias("rows"))
    # Outer, though each tree has a root: else the planner asks for the size of ``rows`` first, where the rows are read.
    out = whole.select("tree_id", F.explode_outer("rows").alias("n")).select("tree_id", "n.*")
    out._sylva_whole = whole  # for what needs whole trees: they are not gathered again
    return out


def read_walk(load: Callable[[str], DataFrame], catalog: Catalog, root: str, *, simplify_association: bool = True,
              sample: int = 0, source: DataFrame | None = None, namespace: str = NAMESPACE) -> Walk:
    """The walk from ``root``; ``source`` replaces its rows (for instance those that nothing refers to)."""
    steps = plan_walk(catalog, root)
    rows = source if source is not None else load(root)
    table = catalog[root]
    if sample:
        order = list(table.primary_key or table.columns)
        rows = rows.orderBy(*order).limit(sample)
    association = simplify_association and table.is_association
    base = rows.select(*[F.col(f"`{c}`").alias(f"a0.{c}") for c in table.columns])

    def chained(wanted: list[Step]) -> DataFrame:
        joined = base
        for step in wanted:
            joined = attached(joined, step)
        return joined

    def attached(joined: DataFrame, step: Step) -> DataFrame:
        right = load(step.table).select(
            *[F.col(f"`{c}`").alias(f"{step.alias}.{c}") for c in catalog[step.table].columns],
            F.lit(True).alias(f"{step.alias}.__there"),
        )
        match = F.lit(True)
        for own, other in step.key.pairs:
            match = match & (F.col(f"`{step.parent}.{own}`") == F.col(f"`{step.alias}.{other}`"))
        return joined.join(right, match, "inner" if association and step.parent == "a0" else "left")

    return Walk(catalog, steps, chained(steps[1:]), list(table.columns), namespace, association, chained=chained)


def unreferenced(load: Callable[[str], DataFrame], catalog: Catalog, target: str) -> DataFrame:
    """Rows of ``target`` that no row of any table refers to."""
    rows = load(target)
    for table in catalog.values():
        for key in table.foreign_keys:
            if key.target == target:
                used = load(table.name).select(*[F.col(f"`{a}`").alias(f"__used{i}") for i, (a, _) in enumerate(key.pairs)]).distinct()
                match = F.lit(True)
                for i, (_, other) in enumerate(key.pairs):
                    match = match & (F.col(f"`{other}`") == F.col(f"__used{i}"))
                rows = rows.join(used, match, "left_anti")
    return rows


def read_database(load: Callable[[str], DataFrame], catalog: Catalog, *, simplify_association: bool = True,
                  search_all: bool = False, sample: int = 0) -> DataFrame:
    """Trees of all root tables; with ``search_all`` also of rows below them that nothing refers to."""
    roots = root_tables(catalog)
    parts = [read_walk(load, catalog, r, simplify_association=simplify_association, sample=sample).trees() for r in roots]
    if search_all:
        for name in sorted({k.target for t in catalog.values() for k in t.foreign_keys} - set(roots)):
            alone = unreferenced(load, catalog, name)
            parts.append(read_walk(load, catalog, name, sample=sample, source=alone).trees())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def referenced_instances(load: Callable[[str], DataFrame], catalog: Catalog, root: str, group: str) -> DataFrame:
    """Distinct instances of a group that trees of ``root`` hold, as strings, without building a tree.

    Each way to the table in the walk is a chain of semi-joins from the root's keys; no row is multiplied.
    """
    steps = {s.alias: s for s in plan_walk(catalog, root)}
    parts = []
    for step in steps.values():
        if step.table != group:
            continue
        chain = [step]
        while chain[0].parent is not None:
            chain.insert(0, steps[chain[0].parent])
        rows = load(chain[0].table)
        for s in chain[1:]:
            keys = rows.select(*[F.col(f"`{a}`").alias(f"__k{i}") for i, (a, _) in enumerate(s.key.pairs)]).distinct()
            match = F.lit(True)
            for i, (_, other) in enumerate(s.key.pairs):
                match = match & (F.col(f"`{other}`") == F.col(f"__k{i}"))
            rows = load(s.table).join(keys, match, "left_semi")
        parts.append(rows.select(*[F.col(f"`{c}`").cast("string").alias(entity_name(c)) for c in catalog[group].attributes]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()
