"""Annotated text: sentences, entity spans and relations, stand-off annotation files, and pluggable parsers."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.model import TREE_SCHEMA, Node, from_bracket, reduce_all, to_json


def plain_ascii(text: str) -> str:
    """Decompose and drop marks; what has no ASCII form stays, so that no character is invented."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def split_sentences(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, idx, sentence, and the sentence's character range [begin, end] in the text; one sentence per line.

    The ranges come from the row itself, so nothing is shuffled, and rows with repeated or null ids stay apart.
    """
    lines = F.split(F.coalesce(F.col(text_column), F.lit("")), "\n")
    none = F.array().cast("array<struct<sentence:string,begin:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    found = F.aggregate(lines, start, lambda a, line: F.struct(
        (a["at"] + F.char_length(line) + 1).alias("at"),
        F.concat(a["found"], F.array(F.struct(line.alias("sentence"), a["at"].alias("begin")))).alias("found")))["found"]
    rows = documents.select(F.col(id_column), F.posexplode(found).alias("idx", "s"))
    return rows.select(id_column, "idx", "s.sentence", "s.begin", (F.col("s.begin") + F.char_length("s.sentence")).alias("end"))


def assign_entities(entities: DataFrame, sentences: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Entities (id, entity_id, name, start, end) with the sentence in which they end, offsets relative to it.

    A start before the sentence is clipped to 0; spans that are empty or end outside the text are dropped.
    """
    joined = entities.where("start < end AND start >= 0").join(
        sentences.select(id_column, "idx", F.col("begin").alias("s_begin"), F.col("end").alias("s_end")), id_column
    ).where((F.col("end") > F.col("s_begin")) & (F.col("end") <= F.col("s_end")))
    return joined.select(
        id_column, "idx", "entity_id", "name", F.greatest(F.col("start") - F.col("s_begin"), F.lit(0)).alias("start"),
        (F.col("end") - F.col("s_begin")).alias("end"),
    ).where("start < end")


def assign_relations(relations: DataFrame, placed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Relations (id, src, dst, name) whose both ends are in one sentence, with the first such sentence."""
    a = placed.select(id_column, F.col("entity_id").alias("src"), F.col("idx"))
    b = placed.select(id_column, F.col("entity_id").alias("dst"), F.col("idx"))
    return relations.join(a, [id_column, "src"]).join(b, [id_column, "dst", "idx"]).groupBy(id_column, "src", "dst", "name").agg(
        F.min("idx").alias("idx")
    )


def read_standoff(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, entities, relations) of pairs of ``.txt`` and ``.ann`` files; discontinuous spans run from first to last."""
    stem = F.regexp_replace(F.input_file_name(), r"\.[^.]+$", "")
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(stem.alias("doc_id"), F.col("value").alias("text"))
    lines = spark.read.text(f"{folder}/*.ann").select(stem.alias("doc_id"), "value")
    return (texts, *parse_standoff(lines))


def parse_standoff(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of annotation lines (doc_id, value); notes, events and attributes are left out."""
    t = r"^(T\d+)\t(\S+) (\d+)(?: .*?|;.*?)?(\d+)\t(.*)$"
    spans = lines.where(F.col("value").startswith("T")).select(
        "doc_id", F.regexp_extract("value", r"^(T\d+)\t", 1).alias("entity_id"),
        F.upper(F.regexp_extract("value", t, 2)).alias("name"), F.regexp_extract("value", t, 3).cast("int").alias("start"),
        F.regexp_extract("value", r"[ ;](\d+)\t[^\t]*$", 1).cast("int").alias("end"),
        F.lower(F.regexp_extract("value", r"\t([^\t]*)$", 1)).alias("value"),
    )
    r = r"^R\d+\t(\S+) Arg1:(\S+) Arg2:(\S+)"
    links = lines.where(F.col("value").startswith("R")).select(
        "doc_id", F.upper(F.regexp_extract("value", r, 1)).alias("name"), F.regexp_extract("value", r, 2).alias("src"),
        F.regexp_extract("value", r, 3).alias("dst"),
    )
    return spans, links


def rename_and_exclude(rows: DataFrame, mapping: dict[str, str], exclude: set[str], uncertain: bool = False) -> DataFrame:
    """Map names, then drop excluded ones; for relations also names that say they are uncertain (``INCERTAIN``)."""
    name: Column = F.col("name")
    if mapping:
        lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        name = F.coalesce(lookup[F.col("name")], name)
    kept = rows if not exclude else rows.where(~F.col("name").isin(*exclude))
    if uncertain:
        kept = kept.where(~F.col("name").contains("INCERTAIN"))
    return kept.withColumn("name", name)


# What the loader of clinical corpora leaves out and renames unless told otherwise.
DEFAULT_EXCLUDED_ENTITIES = frozenset({"TIME", "MOMENT", "DUREE", "DURATION", "DATE", "OTHER_ENTITY", "OTHER_EVENT", "COREFERENCE"})
DEFAULT_EXCLUDED_RELATIONS = frozenset({"TEMPORALITE", "CAUSE-CONSEQUENCE"})
DEFAULT_ENTITY_NAMES = {
    "FREQ": "FREQUENCY", "FREQUENCE": "FREQUENCY", "SIGN_SYMPTOM": "SOSY", "VALEUR": "VALUE", "HEIGHT": "VALUE", "WEIGHT": "VALUE",
    "MASS": "VALUE", "QUANTITATIVE_CONCEPT": "VALUE", "QUALITATIVE_CONCEPT": "VALUE", "DISTANCE": "VALUE", "VOLUME": "VALUE",
    "AREA": "VALUE", "LAB_VALUE": "VALUE", "TRAITEMENT": "THERAPEUTIC_PROCEDURE", "MEDICATION": "THERAPEUTIC_PROCEDURE", "DOSE": "DOSAGE",
    "OUTCOME": "SOSY", "EXAMEN": "DIAGNOSTIC_PROCEDURE", "PATHOLOGIE": "DISEASE_DISORDER", "MODE": "ADMINISTRATION",
}


# --- parsing ------------------------------------------------------------------------------------------------------------

Parser = Callable[[str], Node]


def flat_parser(sentence: str) -> Node:
    """One node over all tokens, for use without a constituency parser."""
    return Node("SENT", tuple(re.findall(r"\w+|[^\w\s]", sentence)))


def bracket_parser(sentence: str) -> Node:
    """For sentences that are bracketed trees already."""
    return from_bracket(sentence)


def _token_spans(tree: Node, sentence: str) -> list[tuple[int, int]]:
    spans, at = [], 0
    for token in tree.leaves():
        found = sentence.find(token, at)
        start = found if found >= 0 else at
        spans.append((start, start + len(token)))
        at = start + len(token)
    return spans


def insert_entity(tree: Node, first: int, last: int, name: str) -> Node:
    """The tree with an entity over leaves ``first``..``last``, put at the lowest node that covers them.

    Where the span cuts through a child, the covered leaves move into the entity and emptied nodes go.
    """

    def size(c: Node | str) -> int:
        return 1 if isinstance(c, str) else len(c.leaves())

    def cut(c: Node | str, lo: int, hi: int) -> Node | str | None:
        """What remains of a child without its leaves lo..hi."""
        if isinstance(c, str):
            return None if lo <= 0 <= hi else c
        kids, at = [], 0
        for k in c.children:
            n = size(k)
            rest = k if at > hi or at + n - 1 < lo else cut(k, lo - at, hi - at)
            if rest is not None:
                kids.append(rest)
            at += n
        return Node(c.label, tuple(kids), c.oid, c.metadata) if kids else None

    def place(node: Node, lo: int, hi: int) -> Node:
        at = 0
        for i, c in enumerate(node.children):
            n = size(c)
            # Down to the lowest node that covers the span, but not into an entity over exactly this span.
            if isinstance(c, Node) and at <= lo and hi < at + n and not (c.type == "ENT" and (lo, hi) == (at, at + n - 1)):
                kids = list(node.children)
                kids[i] = place(c, lo - at, hi - at)
                return Node(node.label, tuple(kids), node.oid, node.metadata)
            at += n
        kids: list[Node | str | None] = []
        inside: list[Node | str] = []
        at, made = 0, False
        for c in node.children:
            n = size(c)
            first_in, last_in = max(lo - at, 0), min(hi - at, n - 1)
            at += n
            if first_in > last_in:
                kids.append(c)
                continue
            rest = cut(c, first_in, last_in)
            if rest is None:
                holds = isinstance(c, Node) and bool(c.entities())
                inside += [c] if isinstance(c, str) or holds else c.leaves()
            else:
                inside += c.leaves()[first_in : last_in + 1]
            before = rest is not None and first_in > 0
            if before:
                kids.append(rest)
            if not made:
                kids.append(None)
                made = True
            if rest is not None and not before:
                kids.append(rest)
        entity = Node(f"ENT::{name}", tuple(inside))
        return Node(node.label, tuple(entity if k is None else k for k in kids), node.oid, node.metadata)

    return place(tree, first, last)


def unnest_entities(tree: Node) -> Node:
    """An entity that holds entities becomes ``REL(entity over all leaves, nested(inner entities))``."""

    def visit(c: Node | str) -> Node | str:
        if isinstance(c, str):
            return c
        inner = [e for k in c.children if isinstance(k, Node) for e in k.entities()]
        if c.type == "ENT" and inner:
            flat = [Node(e.label, tuple(e.leaves()), e.oid) for e in inner]
            return Node("REL", (Node(c.label, tuple(c.leaves()), c.oid), Node("nested", tuple(flat))))
        return Node(c.label, tuple(visit(k) for k in c.children), c.oid, c.metadata)

    return visit(tree)


def enrich(tree: Node, sentence: str, entities: list[dict]) -> Node:
    """The parse with the sentence's entities in it: longest first, repeats of a span skipped, bare branches pruned."""
    spans = _token_spans(tree, sentence)
    seen: set[tuple[int, int]] = set()
    for e in sorted(entities, key=lambda e: (e["start"] - e["end"], e["start"], e["name"])):
        covered = [i for i, (a, b) in enumerate(spans) if a < e["end"] and b > e["start"]]
        if covered and (covered[0], covered[-1]) not in seen:
            seen.add((covered[0], covered[-1]))
            tree = insert_entity(tree, covered[0], covered[-1], e["name"])

    def prune(c: Node | str) -> Node | str | None:
        if isinstance(c, str) or c.type == "ENT":
            return c if not isinstance(c, str) else None
        kids = tuple(k for k in map(prune, c.children) if k is not None)
        return Node(c.label, kids, c.oid, c.metadata) if kids else None

    pruned = prune(unnest_entities(tree))
    return pruned if isinstance(pruned, Node) else Node(tree.label)


def process_tree(tree: Node, sentence: str, entities: list[dict]) -> Node | None:
    """A parsed sentence as a tree of the forest, or None where nothing structured is left."""
    tree = reduce_all(enrich(fix_coordination(tree), sentence, entities), frozenset({"ENT", "GROUP", "REL", "COLL"}))
    while len(tree.children) == 1 and isinstance(tree.children[0], Node) and tree.children[0].type != "ENT":
        tree = tree.children[0]
    if not tree.children or all(isinstance(c, str) for c in tree.children):
        return None

    def rename(c: Node | str, top: bool) -> Node | str:
        if isinstance(c, str) or c.type == "ENT":
            return c
        label = "ROOT" if top else c.label if c.type == "REL" else f"UNDEF_{uuid.uuid5(uuid.NAMESPACE_OID, c.oid).hex}"
        return Node(label, tuple(rename(k, False) for k in c.children), c.oid, c.metadata)

    return rename(tree, True)


def fix_coordination(tree: Node) -> Node:
    """A coordination (a COORD that opens with a CCONJ, beside its first conjunct) becomes a flat CONJ."""

    def visit(c: Node | str) -> Node | str:
        if isinstance(c, str):
            return c
        kids = [visit(k) for k in c.children]
        at = next((i for i, k in enumerate(kids) if isinstance(k, Node) and k.label == "COORD" and k.children
                   and isinstance(k.children[0], Node) and k.children[0].label == "CCONJ"), None)
        if at:
            first, coord = kids[at - 1], kids[at]
            parts = [x for p in (first, *coord.children[1:])
                     for x in (p.children if isinstance(p, Node) and p.label == "CONJ" else (p,))]
            kids[at - 1 : at + 1] = [Node("CONJ", tuple(parts))]
            if len(kids) == 1:
                return kids[0]
        return Node(c.label, tuple(kids), c.oid, c.metadata)

    return visit(tree)


def parse_sentences(sentences: DataFrame, make_parser: Callable[[], Parser], id_column: str = "doc_id") -> DataFrame:
    """``trees(tree_id, tree)`` of sentences (id, idx, sentence, entities array<struct<name,start,end>>).

    ``make_parser`` runs once per task, so a model is loaded once for all its sentences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = make_parser()
        for batch in batches:
            ids, trees = [], []
            for r in batch.to_pylist():
                if r["sentence"] and r["entities"] and (t := process_tree(parser(r["sentence"]), r["sentence"], r["entities"])):
                    ids.append(r["key"])
                    trees.append(to_json(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(trees, pa.string())], names=["tree_id", "tree"])

    key = F.concat_ws("/", F.col(id_column).cast("string"), F.col("idx").cast("string")).alias("key")
    return sentences.select(key, "sentence", "entities").mapInArrow(run, TREE_SCHEMA)


def extract_entities(sentences: DataFrame, make_extractor: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """Sentences with the entities that an extractor finds appended to their own."""
    kind = "array<struct<name:string,start:int,end:int>>"

    @F.pandas_udf(kind)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = make_extractor()
        for s in parts:
            yield s.map(lambda x: extract(x or ""))

    own = F.coalesce(F.col("entities"), F.array().cast(kind))
    return sentences.withColumn("entities", F.concat(own, found("sentence")))


def resolve_entities(entities: DataFrame, knowledge: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Entity values replaced by the best-scored canonical form of ``knowledge(value, canonical, score)``."""
    best = knowledge.where(F.col("score") > threshold).groupBy("value").agg(F.max_by("canonical", "score").alias("canonical"))
    return entities.join(best, "value", "left").withColumn("value", F.coalesce("canonical", "value")).drop("canonical")
