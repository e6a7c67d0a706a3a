"""Rewriting by a text model, as a pluggable callable: vocabulary, prompts, parsing of answers, and clean-up."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.model import Node, TREE_SCHEMA, from_dict, from_json, sliced, to_dict, to_json

Model = Callable[[str], str]


def normalize(label: str) -> str:
    """Upper-case words joined by underscores."""
    words = re.sub(r"[^0-9A-Za-z]+", " ", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", unicodedata.normalize("NFKC", label))).split()
    return "_".join(words).upper()


def merge_vocabulary(counts: dict[str, int], cutoff: float = 0.8, min_support: int = 1) -> dict[str, str]:
    """Each label with the more frequent similar one that it becomes; rare ones have none."""
    by: Counter = Counter()
    for label, n in counts.items():
        by[normalize(label)] += n
    kept: list[str] = []
    into: dict[str, str] = {}
    for label, _ in sorted(by.items(), key=lambda x: (-x[1], x[0])):
        near = difflib.get_close_matches(label, kept, 1, cutoff)
        into[label] = near[0] if near else label
        if not near:
            kept.append(label)
    total: Counter = Counter()
    for label, n in by.items():
        total[into[label]] += n
    return {x: into[normalize(x)] for x in counts if total[into[normalize(x)]] >= min_support}


def extract_vocabulary(nodes: DataFrame, cutoff: float = 0.8, min_support: int = 1) -> dict[str, str]:
    """Counted in Spark; one row per label comes to the driver."""
    rows = nodes.where("type IS NOT NULL AND name <> ''").groupBy("name").agg(F.count("*").alias("n")).collect()
    return merge_vocabulary({r["name"]: r["n"] for r in rows}, cutoff, min_support)


def plain(tree: Node) -> dict:
    """A tree without ids and metadata."""
    def strip(x):
        return x if isinstance(x, str) else {"type": x["type"], "name": x["name"], "children": [strip(c) for c in x["children"]]}

    return strip(to_dict(tree))


def numbered(trees: list[Node]) -> str:
    return "\n".join(f"{i}. {json.dumps(plain(t), sort_keys=True, separators=(',', ':'), ensure_ascii=False)}" for i, t in enumerate(trees, 1))


def sanitize(tree: Node, oid: str | None = None) -> Node:
    """A root, and no group with other than entities or relation of other than two groups: those become untyped."""
    def visit(c: Node | str) -> Node | str:
        if isinstance(c, str):
            return c
        kids = tuple(visit(k) for k in c.children)
        bad_group = c.type == "GROUP" and not all(isinstance(k, Node) and k.type == "ENT" for k in kids)
        bad_rel = c.type == "REL" and not (len(kids) == 2 and all(isinstance(k, Node) and k.type == "GROUP" for k in kids))
        return replace(c, children=kids, label=f"UNDEF_{c.oid}" if bad_group or bad_rel else c.label)

    out = visit(tree)
    return replace(out, oid=oid or out.oid) if out.label == "ROOT" else Node("ROOT", (out,), oid or tree.oid)


def parse_answer(answer: str, originals: list[Node]) -> list[Node]:
    """One tree per original from a numbered list of JSON; what is missing or broken stays as it was."""
    found: dict[int, Node] = {}
    for m in re.finditer(r"(?m)^\s*(\d+)[.)]\s*(\{.*\}|\[.*\])\s*$", answer):
        try:
            data = json.loads(m[2])
            if isinstance(data, list):
                data = {"name": "ROOT", "children": data}
            found[int(m[1])] = sanitize(from_dict(data), originals[int(m[1]) - 1].oid)
        except (ValueError, KeyError, IndexError, AttributeError, TypeError):
            continue
    return [found.get(i, t) for i, t in enumerate(originals, 1)]


def batches_by_size(sizes: list[int], limit: int) -> list[list[int]]:
    """Consecutive indices whose sizes add up to at most ``limit``; a larger one is alone."""
    out: list[list[int]] = []
    total = 0
    for i, n in enumerate(sizes):
        if not out or total + n > limit:
            out.append([])
            total = 0
        out[-1].append(i)
        total += n
    return out


def estimate_tokens(trees: DataFrame, prompt_tokens: int, limit: int, steps: int = 1, per_token: float = 4.0) -> DataFrame:
    """One row: tokens in and out for all trees and rounds, with a margin of a fifth."""
    size = F.ceil(F.length("tree") / per_token)
    return trees.agg(F.sum(size).alias("t")).select(
        ((F.col("t") + F.ceil(F.col("t") / (limit - prompt_tokens)) * prompt_tokens) * (steps + 1) * 1.2).cast("long").alias("input_tokens"),
        (F.col("t") * (steps + 1) * 1.2).cast("long").alias("output_tokens"))


def model_rewrite(trees: DataFrame, make_model: Callable[[], Model], prompt: str = "{trees}", limit: int = 2_000,
                  refining_steps: int = 0, per_token: float = 4.0) -> DataFrame:
    """Trees as a model rewrites them, ``refining_steps + 1`` times; a failing call leaves its trees as they were."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in sliced(parts, 1024):
            own = [from_json(t) for t in batch.column("tree").to_pylist()]
            for _ in range(refining_steps + 1):
                sizes = [int(len(to_json(t)) / per_token) + 1 for t in own]
                for group in batches_by_size(sizes, limit):
                    ask = [own[i] for i in group]
                    try:
                        answer = parse_answer(model(prompt.format(trees=numbered(ask))), ask)
                    except Exception:  # any failure of the plug-in: its trees stay
                        answer = ask
                    for i, t in zip(group, answer, strict=True):
                        own[i] = t
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), pa.array([to_json(t) for t in own], pa.string())], names=["tree_id", "tree"])

    return trees.select("tree_id", "tree").mapInArrow(run, TREE_SCHEMA)


def suggest_names(groups: dict[str, frozenset[str]], samples: dict[str, list[dict]], namer: Callable[[str, frozenset[str], list[dict]], str]) -> list[tuple[str, str, str]]:
    """(type, old, new) for groups, from a namer that sees entities and up to five rows; names are upper-cased."""
    return [("GROUP", g, normalize(namer(g, e, samples.get(g, [])[:5]))) for g, e in sorted(groups.items())]


def suggest_relation_names(relations: dict[str, tuple[str, str]], samples: dict[str, list[dict]],
                           namer: Callable[[str, str, str, list[dict]], str]) -> list[tuple[str, str, str]]:
    """(type, old, new) for relations, from a namer that sees both groups and up to five pairs of rows."""
    return [("REL", r, normalize(namer(r, a, b, samples.get(r, [])[:5]))) for r, (a, b) in sorted(relations.items())]


def shuffled(trees: DataFrame, seed: int = 0) -> DataFrame:
    """``trees`` in an order drawn by a seeded hash, so that prompts mix trees and a run can be repeated."""
    return trees.orderBy(F.xxhash64(F.lit(seed), "tree_id"), "tree_id")
