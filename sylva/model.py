"""The forest: ordered labelled trees as node rows, and as values for logic that stays within one tree.

A node row is ``(tree_id, pos, kind, oid, type, name, label, value, metadata)``; ``pos`` is the path of child indices from
the root, so ordering by it is a preorder walk. A tree value is a :class:`Node`; edits return new values.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("ENT", "GROUP", "REL", "COLL")
NODE_SCHEMA = (
    "tree_id string, pos array<int>, kind string, oid string, type string, name string, label string, value string, "
    "metadata map<string,string>"
)
TREE_SCHEMA = "tree_id string, tree string"


@lru_cache(1 << 16)
def make_label(type_: str | None, name: str | None) -> str:
    if type_ is None:
        return name or ""
    return f"{type_}::{name}" if name else type_


@lru_cache(1 << 16)
def split_label(label: str) -> tuple[str | None, str]:
    """(type, name); the type is None unless what stands before the first ``::`` is one of the four types."""
    head, _, tail = label.partition("::")
    return (head, tail) if head in TYPES else (None, label)


#: Random bytes for ids to come: asking the system for 16 at a time costs more than all else about a node.
_RANDOM = bytearray()
os.register_at_fork(after_in_child=_RANDOM.clear)


def fresh_oid() -> str:
    """A random UUID (version 4)."""
    if len(_RANDOM) < 16:
        _RANDOM.extend(os.urandom(4096))
    own = _RANDOM[-16:]
    del _RANDOM[-16:]
    own[6], own[8] = own[6] & 0x0F | 0x40, own[8] & 0x3F | 0x80
    h = own.hex()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


@dataclass(frozen=True, slots=True)
class Node:
    """A tree value. Equality looks at labels and children only."""

    label: str
    children: tuple[Node | str, ...] = ()
    oid: str = field(default_factory=fresh_oid, compare=False)
    metadata: dict = field(default_factory=dict, compare=False)

    @property
    def type(self) -> str | None:
        return split_label(self.label)[0]

    @property
    def name(self) -> str:
        return split_label(self.label)[1]

    def __str__(self) -> str:
        return to_bracket(self)

    def at(self, path: tuple[int, ...]) -> Node | str:
        found: Node | str = self
        for i in path:
            found = found.children[i]
        return found

    def put(self, path: tuple[int, ...], new: list[Node | str]) -> Node:
        """The tree with the node at ``path`` replaced by the nodes ``new``."""
        if not path:
            if len(new) != 1 or isinstance(new[0], str):
                raise ValueError("a root can only be replaced by one node")
            return new[0]
        i, kids = path[0], list(self.children)
        kids[i : i + 1] = new if len(path) == 1 else [kids[i].put(path[1:], new)]
        return replace(self, children=tuple(kids))

    def walk(self, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Node]]:
        """All nodes below and including this one with their paths, in preorder."""
        yield path, self
        for i, c in enumerate(self.children):
            if isinstance(c, Node):
                yield from c.walk((*path, i))

    def leaves(self) -> list[str]:
        return [x for c in self.children for x in ([c] if isinstance(c, str) else c.leaves())]

    def height(self) -> int:
        return 1 + max((1 if isinstance(c, str) else c.height() for c in self.children), default=0)

    def entities(self) -> list[Node]:
        return [n for _, n in self.walk() if n.type == "ENT"]

    def entity_labels(self) -> frozenset[str]:
        return frozenset(n.name for n in self.entities())

    def groups(self) -> set[str]:
        return {n.name for _, n in self.walk() if n.type == "GROUP"}

    def has_duplicate_entity(self) -> bool:
        return len(self.entities()) > len(self.entity_labels())

    def has_entity_child(self) -> bool:
        return any(isinstance(c, Node) and c.type == "ENT" for c in self.children)

    def has_unlabelled_child(self) -> bool:
        return any(isinstance(c, str) or c.type is None for c in self.children)

    def productions(self) -> list[tuple[str, tuple[str, ...]]]:
        return [(n.label, tuple(c if isinstance(c, str) else c.label for c in n.children)) for _, n in self.walk()]

    def group_instances(self, name: str) -> list[dict[str, str]]:
        """Distinct instances of a group as entity -> joined leaves, inner ones first."""
        found = [r for c in self.children if isinstance(c, Node) for r in c.group_instances(name)]
        if self.type == "GROUP" and self.name == name:
            found.append({c.name: " ".join(c.leaves()) for c in self.children if isinstance(c, Node) and c.type == "ENT"})
        return [r for i, r in enumerate(found) if r not in found[:i]]

    def part(self, start: int | None = None, stop: int | None = None) -> tuple[Node | str, ...]:
        """Children by a slice."""
        return self.children[start:stop]

    def insert(self, at: int, *new: Node | str) -> Node:
        """With new children before the one at ``at``, which counts from the end where negative."""
        kids = list(self.children)
        kids[at:at] = new
        return replace(self, children=tuple(kids))

    def extend(self, *new: Node | str) -> Node:
        return replace(self, children=self.children + new)

    def pop(self, at: int = -1) -> tuple[Node, Node | str]:
        """(without the child at ``at``, that child)."""
        kids = list(self.children)
        gone = kids.pop(at)
        return replace(self, children=tuple(kids)), gone

    def clear(self) -> Node:
        return replace(self, children=())

    def leaf_position(self, leaf: int) -> tuple[int, ...]:
        """Path of the leaf with this number from 0, left to right; IndexError where there are fewer."""
        if leaf < 0:
            raise IndexError(leaf)
        for i, c in enumerate(self.children):
            n = 1 if isinstance(c, str) else len(c.leaves())
            if leaf < n:
                return (i,) if isinstance(c, str) else (i, *c.leaf_position(leaf))
            leaf -= n
        raise IndexError("fewer leaves")

    def copy(self) -> Node:
        return self

    def without(self, path: tuple[int, ...], recursive: bool = True) -> Node:
        """The tree without the node at ``path``; ancestors that this empties go too if ``recursive``."""
        parent = self.at(path[:-1])
        if recursive and len(path) > 1 and len(parent.children) == 1:
            return self.without(path[:-1])
        return self.put(path, [])


def has_type(node: Node | str, *types: str) -> bool:
    """Whether a node is of one of the types, of any at all where none is given; a leaf has no type."""
    return isinstance(node, Node) and (node.type in types if types else node.type is not None)


def is_part_of(part: Node, whole: Node) -> bool:
    """Whether ``part`` is a node of ``whole``, told by oid, the root aside."""
    return any(path and n.oid == part.oid for path, n in whole.walk())


def merge(a: Node, b: Node) -> Node:
    """One ROOT with the children of both trees; roots labelled ROOT are unwrapped."""
    kids = [c for t in (a, b) for c in (t.children if t.label == "ROOT" else (t,))]
    return Node("ROOT", tuple(kids))


def reduce_all(tree: Node, skip: frozenset[str | None] = frozenset()) -> Node:
    """Splice out every node but the root that has exactly one child and no type of ``skip``.

    Taking a node out never changes another one's number of children, so one pass is enough.
    """

    def spliced(c: Node | str) -> list[Node | str]:
        if isinstance(c, str):
            return [c]
        kids = [x for k in c.children for x in spliced(k)]
        if len(c.children) == 1 and (c.type is None or c.type not in skip):
            return kids
        return [replace(c, children=tuple(kids))]

    return replace(tree, children=tuple(x for c in tree.children for x in spliced(c)))


# --- text forms -------------------------------------------------------------------------------------------------------

_PLAIN = re.compile(r"[A-Za-z0-9_.~/-]*").fullmatch
_TOKEN = re.compile(r"\(|\)|[^\s()]+")


def to_bracket(tree: Node | str) -> str:
    """``(LABEL child child)`` with URL-quoted leaves."""
    if isinstance(tree, str):
        return tree if _PLAIN(tree) else quote(tree)
    return "(" + " ".join([tree.label, *map(to_bracket, tree.children)]) + ")"


def from_bracket(text: str) -> Node:
    """Read bracket notation; leaves are URL-unquoted. ValueError where brackets do not close or nothing is there."""
    stack: list[tuple[str, list]] = []
    done: Node | None = None
    expect_label = False
    for m in _TOKEN.finditer(text):
        token = m[0]
        if done is not None:
            raise ValueError(f"text after the end of the tree at {m.start()}")
        if expect_label:
            if token in "()":
                if token == "(":
                    raise ValueError(f"a label is missing at {m.start()}")
                token = ""
            stack.append((unquote(token), []))
            expect_label = False
            if m[0] != ")":
                continue
            token = ")"
        if token == "(":
            expect_label = True
        elif token == ")":
            if not stack:
                raise ValueError(f"nothing to close at {m.start()}")
            label, kids = stack.pop()
            node = Node(label, tuple(kids))
            if stack:
                stack[-1][1].append(node)
            else:
                done = node
        elif not stack:
            raise ValueError(f"a leaf outside a tree at {m.start()}")
        else:
            stack[-1][1].append(unquote(token))
    if done is None:
        raise ValueError("the tree does not end")
    return done


def to_dict(tree: Node | str) -> dict | str:
    if isinstance(tree, str):
        return tree
    type_, name = split_label(tree.label)
    return {"oid": tree.oid, "type": type_, "name": name, "metadata": tree.metadata, "children": [to_dict(c) for c in tree.children]}


def from_dict(data: dict | str) -> Node | str:
    """Every key may be missing; leaves are strings."""
    if isinstance(data, str):
        return data
    return Node(
        make_label(data.get("type"), data.get("name")), tuple(from_dict(c) for c in data.get("children") or ()),
        data.get("oid") or fresh_oid(), dict(data.get("metadata") or {}),
    )


def to_json(tree: Node | str) -> str:
    """The text of :func:`to_dict` with sorted keys, without building it: a wide tree would stand in memory twice."""
    text, parts = json.encoder.encode_basestring, []

    def put(n: Node | str) -> None:
        if isinstance(n, str):
            parts.append(text(n))
            return
        type_, name = split_label(n.label)
        parts.append('{"children": [')
        for i, c in enumerate(n.children):
            if i:
                parts.append(", ")
            put(c)
        metadata = json.dumps(n.metadata, ensure_ascii=False, sort_keys=True) if n.metadata else "{}"
        oid = text(n.oid) if isinstance(n.oid, str) else json.dumps(n.oid)
        parts.append(f'], "metadata": {metadata}, "name": {text(name)}, "oid": {oid}, "type": {"null" if type_ is None else text(type_)}}}')

    put(tree)
    return "".join(parts)


def from_json(text: str) -> Node:
    return from_dict(json.loads(text))


# --- rows -------------------------------------------------------------------------------------------------------------


#: Trees that are Python values at a time, and node rows.
TREES, ROWS = 64, 20_000


def sliced(batches: Iterator[pa.RecordBatch], rows: int = TREES) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task's memory does not follow from the size of Arrow's."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def node_rows(tree_id: str, tree: Node) -> Iterator[tuple]:
    """The rows of a tree's nodes in preorder, as tuples in the order of the schema."""
    waiting: list[tuple[Node | str, list[int]]] = [(tree, [])]
    while waiting:
        n, pos = waiting.pop()
        if isinstance(n, str):
            yield tree_id, pos, "LEAF", None, None, None, None, n, None
            continue
        type_, name = split_label(n.label)
        meta = [(k, None if v is None else str(v)) for k, v in n.metadata.items()]
        yield tree_id, pos, "NODE", n.oid, type_, name, n.label, None, meta
        for i in range(len(n.children) - 1, -1, -1):
            waiting.append((n.children[i], [*pos, i]))


_ARROW = pa.schema([
    ("tree_id", pa.string()), ("pos", pa.list_(pa.int32())), ("kind", pa.string()), ("oid", pa.string()),
    ("type", pa.string()), ("name", pa.string()), ("label", pa.string()), ("value", pa.string()),
    ("metadata", pa.map_(pa.string(), pa.string())),
])


def trees_to_nodes(trees: DataFrame) -> DataFrame:
    """``trees(tree_id, tree)`` in JSON form as node rows; narrow."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[tuple] = []
            for i, t in zip(batch.column("tree_id").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                for row in node_rows(i, from_json(t)) if t is not None else ():
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return trees.select("tree_id", "tree").mapInArrow(run, NODE_SCHEMA)


def _strings(array: pa.Array) -> list[str | None]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _slices(array: pa.ListArray, flat: list) -> list[list]:
    """What each list of ``array`` holds of its values ``flat``, nothing for null."""
    ends = array.offsets.to_pylist()
    first, valid = ends[0], array.is_valid().to_pylist()
    return [flat[a - first : b - first] if v else [] for a, b, v in zip(ends, ends[1:], valid)]


def _inner(array: pa.ListArray, values: pa.Array) -> pa.Array:
    first, last = array.offsets[0].as_py(), array.offsets[-1].as_py()
    return values.slice(first, last - first)


def nodes_to_trees(nodes: DataFrame) -> DataFrame:
    """Node rows as one JSON tree per tree_id; a tree is the unit that has to fit in a task.

    Node rows that a loader has just made come with its whole trees; others are gathered by one shuffle.
    """
    gathered = getattr(nodes, "_sylva_whole", None)
    if gathered is None:
        row = F.struct("pos", "kind", "oid", "type", "name", "value", "metadata")
        gathered = nodes.groupBy("tree_id").agg(F.collect_list(row).alias("rows"))

    def build(rows: list[tuple]) -> Node:
        rows.sort(key=lambda r: r[0])

        def made(k: int) -> tuple[Node | str, int]:
            pos, kind, oid, type_, name, value, metadata = rows[k]
            if kind == "LEAF":
                return value, k + 1
            kids, k2 = [], k + 1
            while k2 < len(rows) and len(rows[k2][0]) > len(pos):
                kid, k2 = made(k2)
                kids.append(kid)
            return Node(make_label(type_, name), tuple(kids), oid, dict(metadata)), k2

        return made(0)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = batch.column("rows")
            flat = rows.flatten()
            pos, metadata = (flat.field(flat.type.get_field_index(c)) for c in ("pos", "metadata"))
            texts = [_strings(flat.field(flat.type.get_field_index(c))) for c in ("kind", "oid", "type", "name", "value")]
            pairs = list(zip(_strings(_inner(metadata, metadata.keys)), _strings(_inner(metadata, metadata.items)), strict=True))
            columns = zip(_slices(pos, _inner(pos, pos.values).to_numpy().tolist()), *texts, _slices(metadata, pairs), strict=True)
            trees = [to_json(build([next(columns) for _ in range(n)])) for n in rows.value_lengths().to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), pa.array(trees, pa.string())], names=["tree_id", "tree"])

    return gathered.mapInArrow(run, TREE_SCHEMA)


def map_trees(trees: DataFrame, change: Callable[[Node], tuple[Node | None, bool]]) -> DataFrame:
    """Apply a function of one tree to each row: tree_id, tree, changed. A None drops the tree. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, out, flags = [], [], []
            for i, t in zip(batch.column("tree_id").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                new, changed = change(from_json(t))
                if new is not None:
                    ids.append(i)
                    out.append(to_json(new) if changed else t)
                    flags.append(changed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(out, pa.string()), pa.array(flags, pa.bool_())],
                names=["tree_id", "tree", "changed"],
            )

    return trees.select("tree_id", "tree").mapInArrow(run, TREE_SCHEMA + ", changed boolean")
