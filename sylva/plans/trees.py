"""Registered queries of the operators that work on node tables and tree values, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import sinks
from sylva.model import Node, from_bracket, from_json, map_trees, merge, nodes_to_trees, sliced, to_bracket, to_json, trees_to_nodes
from sylva.operators import cluster, forest, rewrite, schema, simplify, vocabulary
from sylva.plans.catalog import _JOINED, _PLACES, _customer_nodes, _label_counts, _label_counts_sql, _table, _walk, query
from sylva.shared import dealt, shared_dir, stored
from sylva.sources import documents as docs
from sylva.sources import lines, text
from sylva.sources import relational as rel
from sylva.sources.retail import TABLES, loader
from sylva.storage import TreeStore


def _bracketed(rows: DataFrame) -> DataFrame:
    """``trees(tree_id, tree)`` of rows with trees in bracket notation."""
    return map_values(dealt(rows.select(F.col("tree_id").cast("string").alias("tree_id"), "tree")), lambda t: to_json(from_bracket(t)))


def map_values(rows: DataFrame, change: Callable[[str], str]) -> DataFrame:
    """tree_id and the changed text of each row; narrow."""
    import pyarrow as pa

    def run(batches):
        for batch in sliced(batches):
            out = [change(t) for t in batch.column("tree").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), pa.array(out, pa.string())], names=["tree_id", "tree"])

    return rows.select("tree_id", "tree").mapInArrow(run, "tree_id string, tree string")


def _node(label: str, *children: Column) -> Column:
    parts = [x for c in children for x in (F.lit(" "), c)]
    return F.concat(F.lit(f"({label}"), *parts, F.lit(")"))


def _ent(name: str, value: Column) -> Column:
    """An entity in bracket notation; values here hold letters, digits and ``#`` only, and ``#`` is quoted."""
    return F.concat(F.lit(f"(ENT::{name} "), F.replace(value.cast("string"), F.lit("#"), F.lit("%23")), F.lit(")"))


def _values(rows: list[tuple], columns: str) -> str:
    def one(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


# --- tree primitives ----------------------------------------------------------------------------------------------------


@query("""SELECT o.ord, (o.n * c.k)::BIGINT AS positions, o.first, o.last FROM (VALUES
  ('pre', 46, 'ROOT', NULL), ('post', 46, NULL, 'ROOT'), ('both', 74, 'ROOT', 'ROOT'), ('leaves', 18, NULL, NULL)) AS o(ord, n, first, last),
  (SELECT count(*) AS k FROM customer) c""")
def traversal_orders(spark, folder):
    """Positions by order of traversal: how many, and the labels first and last in each tree."""
    seen = forest.all_positions(_customer_nodes(spark, folder))
    ends = seen.groupBy("tree_id", "ord").agg(F.count("*").alias("k"), F.min_by("label", "n").alias("first"), F.max_by("label", "n").alias("last"))
    return ends.groupBy("ord", "first", "last").agg(F.sum("k").alias("positions")).select("ord", "positions", "first", "last")


@query("SELECT leaf, path, (SELECT count(*) FROM customer)::BIGINT AS trees FROM (VALUES (0, '0/0/0'), (5, '1/0/1/0'), (17, '4/1/0')) AS t(leaf, path)")
def leaf_positions(spark, folder):
    nodes = _customer_nodes(spark, folder)
    out = None
    for leaf in (0, 5, 17):
        rows = forest.leaf_position(nodes, leaf).groupBy(F.array_join("pos", "/").alias("path")).agg(F.count("*").alias("trees"))
        rows = rows.select(F.lit(leaf).alias("leaf"), "path", "trees")
        out = rows if out is None else out.union(rows)
    return out


@query(f"""WITH j AS (SELECT * FROM {_JOINED['customer']}), v AS (
  SELECT c_custkey::VARCHAR AS value, 2 AS n FROM j UNION ALL SELECT c_name, 2 FROM j UNION ALL SELECT c_acctbal::VARCHAR, 2 FROM j UNION ALL SELECT c_mktsegment, 2 FROM j
  UNION ALL SELECT n_nationkey::VARCHAR, 3 FROM j UNION ALL SELECT n_name, 3 FROM j UNION ALL SELECT r_regionkey::VARCHAR, 2 FROM j UNION ALL SELECT r_name, 2 FROM j)
SELECT value, sum(n)::BIGINT AS count FROM v WHERE value IS NOT NULL GROUP BY value""")
def leaf_values(spark, folder):
    return forest.leaves(_customer_nodes(spark, folder)).groupBy("value").agg(F.count("*").alias("count"))


@query("SELECT 27 * count(*)::BIGINT AS links, 0::BIGINT AS lost, 27 * count(*)::BIGINT AS below_root FROM customer")
def parent_links(spark, folder):
    """Each inner node but the root has one parent, which is there, at depth one less."""
    rows = forest.with_links(_customer_nodes(spark, folder).where("kind = 'NODE'"))
    up = rows.select("tree_id", F.col("pos").alias("parent_pos"), F.col("depth").alias("above"))
    joined = rows.where("parent_pos IS NOT NULL").join(up, ["tree_id", "parent_pos"], "left")
    return joined.agg(
        F.count_if(F.col("above") == F.col("depth") - 1).alias("links"), F.count_if(F.col("above").isNull()).alias("lost"),
        F.count_if(F.col("depth") > 1).alias("below_root"))


_CHILD_CHECKS = [("GROUP::customer", True, False, 4), ("GROUP::nation", True, False, 2), ("GROUP::region", True, False, 2),
                 ("REL::customer<->nation", False, False, 2), ("REL::nation<->region", False, False, 2), ("ROOT", False, False, 5)]


@query(_values([(*r[:3], f"{r[3]}") for r in _CHILD_CHECKS], "label, has_entity, has_unlabelled, k").replace("SELECT *", "SELECT label, has_entity, has_unlabelled, k::BIGINT AS children"))
def child_checks(spark, folder):
    own = forest.child_measures(_customer_nodes(spark, folder), ("label", "type")).where("type IS NULL OR type <> 'ENT'")
    return own.select("label", F.col("has_entity_child").alias("has_entity"), F.col("has_unlabelled_child").alias("has_unlabelled"),
                      F.col("n_children").alias("children")).distinct()


@query(_values([(label, " ".join(sorted(c for t in tables for c in TABLES[t].attributes))) for label, tables in (
    ("GROUP::customer", ["customer"]), ("GROUP::nation", ["nation"]), ("GROUP::region", ["region"]), ("REL::customer<->nation", ["customer", "nation"]),
    ("REL::nation<->region", ["nation", "region"]), ("ROOT", ["customer", "nation", "region"]))], "label, entities"))
def entity_labels(spark, folder):
    own = forest.subtree_measures(_customer_nodes(spark, folder), ("label", "kind", "type")).where("kind = 'NODE' AND (type IS NULL OR type <> 'ENT')")
    return own.select("label", F.array_join("entity_labels", " ").alias("entities")).distinct()


@query("""SELECT problem, k::BIGINT AS trees FROM (VALUES ('gap', (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0)),
  ('orphan', (SELECT count(*) FROM customer WHERE c_custkey % 3 = 1))) AS t(problem, k) WHERE k > 0""")
def broken_trees(spark, folder):
    """Trees that lost a node: the last group's first entity with its leaf, or a group whose entities stayed."""
    ids = _table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    rows = _bracketed(ids.select(F.col("k").alias("tree_id"), _node("ROOT", _node("GROUP::a", _ent("x", F.col("k")), _ent("y", F.col("k")))).alias("tree")))
    nodes = trees_to_nodes(rows).withColumn("k", F.col("tree_id").cast("long"))
    at = F.array_join("pos", "/")
    first_entity, group = (at.isin("0/0", "0/0/0")) & (F.col("k") % 3 == 0), (at == "0") & (F.col("k") % 3 == 1)
    return forest.broken_trees(nodes.where(~first_entity & ~group)).groupBy("problem").agg(F.count("*").alias("trees"))


@query(_label_counts_sql("customer"))
def text_forms_round_trip(spark, folder):
    """Node rows to JSON trees, to bracket notation, and back."""
    trees = nodes_to_trees(_customer_nodes(spark, folder))
    return _label_counts(trees_to_nodes(map_values(trees, lambda t: to_json(from_bracket(to_bracket(from_json(t)))))))


@query("SELECT type, name, CASE WHEN type IS NULL THEN count ELSE 2 * count END AS count FROM (" + _label_counts_sql("customer") + ")")
def merged_trees(spark, folder):
    """Each tree merged with itself: one root, all children twice."""
    return _label_counts(trees_to_nodes(map_trees(nodes_to_trees(_customer_nodes(spark, folder)), lambda t: (merge(t, t), True))))


@query("SELECT count(*)::BIGINT AS trees, 'view' AS root, 'customer nation region' AS kept FROM customer")
def edited_trees(spark, folder):
    """Children by slices and places: relations popped, the root relabelled, what is left in order."""

    def edit(tree: Node) -> tuple[Node, bool]:
        kept, _ = tree.pop(1)
        kept, _ = kept.pop(2)
        first = kept.part(0, 1)
        out = kept.clear().extend(*kept.part(1)).insert(0, *first)
        return Node("view", out.children, tree.oid), True

    nodes = trees_to_nodes(map_trees(nodes_to_trees(_customer_nodes(spark, folder)), edit))
    shape = nodes.groupBy("tree_id").agg(
        F.max(F.when(F.size("pos") == 0, F.col("label"))).alias("root"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.size("pos") == 1, F.struct("pos", "name")))), lambda x: x["name"]), " ").alias("kept"))
    return shape.groupBy("root", "kept").agg(F.count("*").alias("trees"))


@query("""SELECT type, name, count(*)::BIGINT AS count FROM (SELECT NULL::VARCHAR AS type, 'event' AS name FROM events UNION ALL SELECT 'ENT', 'user' FROM events) GROUP BY ALL""")
def reduced_trees(spark, folder):
    """Nodes with one child are spliced out, from a chain of two down to the entity."""
    body = F.to_json(F.struct(F.struct(F.struct(F.col("user_id").alias("user")).alias("inner")).alias("outer")))
    raw = docs.read_documents(_table(spark, folder, "events").select("event_id", body.alias("json")), "event_id", "json", "event", raw=True)
    return _label_counts(forest.reduce_all(trees_to_nodes(raw), ("ENT",)))


# --- schema and datasets ------------------------------------------------------------------------------------------------


def _dataset_sql(group: str) -> str:
    columns = ", ".join(f"{c}::VARCHAR AS {c}" for c in sorted(TABLES[group].attributes))
    return f"SELECT DISTINCT {columns} FROM {_JOINED['customer']} WHERE {TABLES[group].primary_key[0]} IS NOT NULL"


for _group in ("customer", "nation", "region"):
    query(_dataset_sql(_group), f"dataset_{_group}")(
        lambda spark, folder, g=_group: schema.datasets(
            _customer_nodes(spark, folder), schema.Schema.from_description({g: set(TABLES[g].attributes)}))[g])

query(_dataset_sql("nation"), "compact_dataset_nation")(
    lambda spark, folder: forest.compact_group_instances(_walk(spark, folder, "customer").trees(), "nation", sorted(TABLES["nation"].attributes)))


@query("SELECT name, array_to_string(list_sort(e), ' ') AS entities FROM (VALUES "
       + ", ".join(f"('{t}', {TABLES[t].attributes!r})" for t in _PLACES["customer"]) + ") AS t(name, e)")
def schema_groups(spark, folder):
    return schema.groups(_customer_nodes(spark, folder)).select("name", F.array_join("entities", " ").alias("entities"))


@query("""WITH m AS (SELECT (SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)) AS cn,
    (SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY n_regionkey)) AS nr)
SELECT 'customer<->nation' AS name, 'customer nation' AS ends, CASE WHEN cn THEN 'RIGHT' ELSE 'BOTH' END AS orientation FROM m
UNION ALL SELECT 'nation<->region', 'nation region', CASE WHEN nr THEN 'RIGHT' ELSE 'BOTH' END FROM m""")
def inferred_relations(spark, folder):
    """Relations of the schema that is inferred from node rows."""
    own = schema.infer(_customer_nodes(spark, folder), keep_unlabelled=False)
    rows = [(r.name, f"{r.left} {r.right}", r.orientation) for r in own.relations]
    return spark.createDataFrame(rows, "name string, ends string, orientation string")


@query(_values([
    ("1", "COLL::city", "GROUP::city"), ("2", "COLL::river", "GROUP::river"), ("3", "COLL::city<->river", "REL::city<->river"),
    ("4", "REL::city<->river", "GROUP::city GROUP::river"), ("5", "GROUP::city", "ENT::name ENT::zip"), ("6", "GROUP::river", "ENT::length ENT::name"),
], "k, lhs, rhs").replace("SELECT *", "SELECT row_number() OVER (ORDER BY CASE split_part(lhs, '::', 1) WHEN 'COLL' THEN 1 WHEN 'REL' THEN 2 ELSE 3 END, lhs)::INTEGER AS rank, lhs, rhs"))
def described_schema(spark, folder):
    """Productions of a description in their order, the union of two descriptions."""
    city = schema.Schema.from_description({"city": {"name", "zip"}})
    both = city | schema.Schema.from_description({"city": {"name", "zip"}, "river": {"name", "length"}}, {schema.Relation("city<->river", "city", "river")})
    return spark.createDataFrame([(i, a, " ".join(b)) for i, (a, b) in enumerate(both.ranked(), 1)], "rank int, lhs string, rhs string")


@query(_values([("valid", "true"), ("plain names only", "false"), ("entities", "length name zip"), ("tree", "(ROOT (COLL::a (GROUP::a (ENT::x))) (GROUP::a (ENT::x)))"),
                ("grammar", "ROOT -> COLL::a GROUP::a;|COLL::a -> GROUP::a;|GROUP::a -> ENT::x;")], "what, value"))
def schema_forms(spark, folder):
    own = schema.Schema.from_description({"city": {"name", "zip"}, "river": {"name", "length"}}, {schema.Relation("city<->river", "city", "river")})
    small = schema.Schema.from_description({"a": {"x"}})
    rows = [("valid", str(own.verify()).lower()), ("plain names only", str(schema.Schema.from_description({"a b": {"x"}}).verify()).lower()),
            ("entities", " ".join(sorted(own.entities))), ("tree", to_bracket(small.to_tree())), ("grammar", small.as_cfg().replace("\n", "|"))]
    return spark.createDataFrame(rows, "what string, value string")


@query("""WITH o AS (SELECT max(n) > 1 AS many FROM (SELECT count(DISTINCT (l_partkey, l_suppkey, l_linenumber, l_orderkey, l_shipdate, l_quantity)) AS n FROM lineitem GROUP BY l_orderkey)),
p AS (SELECT max(n) > 1 AS many FROM (SELECT count(DISTINCT (l_orderkey, l_suppkey, l_linenumber, l_partkey, l_shipdate, l_quantity)) AS n FROM lineitem GROUP BY l_partkey))
SELECT 'lineitem' AS name FROM o, p WHERE o.many AND p.many""")
def collapsible_lineitem(spark, folder):
    """Line items stand on the one-side of two relations, to orders and to parts, and nowhere else."""
    examples = _walk(spark, folder, "lineitem").relation_examples().where("left_name = 'lineitem' AND right_name IN ('orders', 'part')")
    return schema.collapsible(schema.orientations(examples))


# --- relational source --------------------------------------------------------------------------------------------------


def _pairs_catalog() -> rel.Catalog:
    part, supplier = TABLES["part"], TABLES["supplier"]
    link = rel.Table("supply", ("l_partkey", "l_suppkey"), ("l_partkey", "l_suppkey"), (
        rel.ForeignKey("l_partkey", "part", "p_partkey"), rel.ForeignKey("l_suppkey", "supplier", "s_suppkey")))
    plain = rel.Table("supplier", tuple(c for c in supplier.columns if c != "s_nationkey"), supplier.primary_key)
    return {"supply": link, "part": part, "supplier": plain}


@query("""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT count(*)::BIGINT AS k FROM s JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT type, name, (w * k)::BIGINT AS count FROM n, (VALUES (NULL, 'ROOT', 1), ('REL', 'supply', 1), ('GROUP', 'part', 2), ('GROUP', 'supplier', 2), ('ENT', 'p_partkey', 2), ('ENT', 'p_name', 2),
  ('ENT', 'p_brand', 2), ('ENT', 'p_type', 2), ('ENT', 'p_size', 2), ('ENT', 'p_retailprice', 2), ('ENT', 's_suppkey', 2), ('ENT', 's_name', 2), ('ENT', 's_acctbal', 2)) AS t(type, name, w)""")
def association_table(spark, folder):
    """A link table becomes a relation between what it links."""
    load = loader(spark, folder)
    pairs = load("lineitem").select("l_partkey", "l_suppkey").distinct()
    return rel.read_walk(lambda t: pairs if t == "supply" else load(t), _pairs_catalog(), "supply").label_counts()


@query("SELECT c_custkey::VARCHAR AS c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25)")
def sampled_customers(spark, folder):
    """Sampling of a root table: the first rows by key."""
    walk = rel.read_walk(loader(spark, folder), TABLES, "customer", sample=25)
    return forest.group_instances(walk.nodes(), "customer", ["c_custkey"])


@query(_values([("cycle", "b"), ("cycle", "d"), ("root", "a"), ("root", "b"), ("root", "d"), ("link", "e")], "what, name"))
def catalog_analysis(spark, folder):
    """Cycles, roots and link tables of a catalog with a cycle of two tables and one that refers to itself."""
    key = rel.ForeignKey
    tables = {t.name: t for t in (
        rel.Table("a", ("i", "b"), ("i",), (key("b", "b", "i"),)), rel.Table("b", ("i", "c", "d"), ("i",), (key("c", "c", "i"), key("d", "d", "i"))),
        rel.Table("c", ("i", "b"), ("i",), (key("b", "b", "i"),)), rel.Table("d", ("i", "up"), ("i",), (key("up", "d", "i"),)))}
    link = rel.Table("e", ("x", "y"), ("x", "y"), (key("x", "a", "i"), key("y", "b", "i")))
    rows = [("cycle", t) for t in rel.cycle_tables(tables)] + [("root", t) for t in rel.root_tables(tables)] + [("link", "e")] * link.is_association
    return spark.createDataFrame(rows, "what string, name string")


# --- documents, text, lines ---------------------------------------------------------------------------------------------


@query("""SELECT kind, count(*)::BIGINT AS trees, (2 * count(*))::BIGINT AS entities FROM region, (VALUES ('csv'), ('json'), ('toml'), ('xml'), ('yaml')) AS t(kind) GROUP BY kind""")
def document_formats(spark, folder):
    """The same record in five formats is the same tree."""
    r = _table(spark, folder, "region").select(F.col("r_regionkey").cast("string").alias("k"), F.col("r_name").alias("n"))
    forms = {
        "json": F.to_json(F.struct(F.struct("k", "n").alias("region"))), "csv": F.concat(F.lit("k,n\n"), "k", F.lit(","), "n", F.lit("\n")),
        "xml": F.concat(F.lit("<region><k>"), "k", F.lit("</k><n>"), "n", F.lit("</n></region>")),
        "toml": F.concat(F.lit("[region]\nk = '"), "k", F.lit("'\nn = '"), "n", F.lit("'\n")),
        "yaml": F.concat(F.lit("region:\n  k: "), "k", F.lit("\n  n: "), "n", F.lit("\n")),
    }
    rows = r.select("k", F.explode(F.array(*[F.struct(F.lit(f).alias("kind"), c.alias("text")) for f, c in forms.items()])).alias("x"))
    nodes = trees_to_nodes(docs.read_documents(rows.select(F.concat_ws("/", "x.kind", "k").alias("i"), "x.text"), "i", "text"))
    ents = nodes.where("type = 'ENT' AND name IN ('k', 'n')")
    return ents.groupBy(F.substring_index("tree_id", "/", 1).alias("kind")).agg(F.countDistinct("tree_id").alias("trees"), F.count("*").alias("entities"))


@query("""SELECT doc_id, 'T' || k AS entity_id, CASE WHEN k = 1 THEN 'PLACE' ELSE 'TIME' END AS name, (k * 3)::INTEGER AS start, (k * 3 + 5)::INTEGER AS "end"
FROM documents, (VALUES (1), (2)) AS t(k)""")
def standoff_entities(spark, folder):
    """Stand-off annotation lines: names mapped, one excluded, notes and relations left out."""
    d = _table(spark, folder, "documents").select("doc_id")
    ann = F.array(*[F.lit(x) for x in ("T1\tLoc 3 8\tUlm a", "T2\ttime 6 7;9 11\tnow", "T3\tjunk 1 2\tx", "#1\tnote T1\tn", "R1\tat Arg1:T1 Arg2:T2")])
    spans, _ = text.parse_standoff(d.select("doc_id", F.explode(ann).alias("value")))
    return text.rename_and_exclude(spans, {"LOC": "PLACE"}, {"JUNK"}).select("doc_id", "entity_id", "name", "start", "end")


@query("SELECT doc_id, 'AT' AS name, 'T1' AS src, 'T2' AS dst, 0::INTEGER AS idx FROM documents WHERE text IS NOT NULL")
def relations_in_sentences(spark, folder):
    """Relations whose two ends lie in one sentence, and uncertain ones left out."""
    d = _table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.lit("Ulm lies there.\nNot here.").alias("text"))
    ann = F.array(*[F.lit(x) for x in ("T1\tLOC 0 3\tUlm", "T2\tVERB 4 8\tlies", "T3\tADV 20 24\there", "R1\tat Arg1:T1 Arg2:T2", "R2\tat Arg1:T1 Arg2:T3", "R3\tINCERTAIN_at Arg1:T1 Arg2:T2")])
    spans, links = text.parse_standoff(d.select("doc_id", F.explode(ann).alias("value")))
    placed = text.assign_entities(spans, text.split_sentences(d))
    return text.assign_relations(text.rename_and_exclude(links, {}, set(), uncertain=True), placed).select("doc_id", "name", "src", "dst", "idx")


@query("""SELECT type, name, (k * n)::BIGINT AS count FROM (SELECT count(*) AS n FROM documents), (VALUES (NULL, 'ROOT', 1), ('ENT', 'PERSON', 2), ('ENT', 'CITY', 1), ('ENT', 'AREA', 1), ('REL', '', 1),
  (NULL, 'nested', 1)) AS t(type, name, k) WHERE name <> 'nested'""")
def parsed_sentences(spark, folder):
    """Sentences parsed flat and enriched with their entities; an entity within another becomes a relation."""
    rows = _table(spark, folder, "documents").select(F.col("doc_id"), F.monotonically_increasing_id().alias("idx"), F.lit("Ann met Bob in North Ulm").alias("sentence"))
    kinds = [("PERSON", 0, 3), ("PERSON", 8, 11), ("AREA", 15, 24), ("CITY", 21, 24)]
    ents = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in kinds])
    nodes = trees_to_nodes(text.parse_sentences(rows.withColumn("entities", ents), lambda: text.flat_parser))
    return _label_counts(nodes.where("type IS NOT NULL OR size(pos) = 0"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'x2' END AS value FROM documents")
def resolved_entities(spark, folder):
    """Values by their best canonical form above a threshold."""
    ents = _table(spark, folder, "documents").select("doc_id", F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string")).alias("value"))
    known = spark.createDataFrame([("x0", "one", 0.9), ("x0", "uno", 0.5), ("x1", "two", 0.4), ("x2", "three", 0.1)], "value string, canonical string, score double")
    return text.resolve_entities(ents, known, 0.2).select("doc_id", "value")


@query("SELECT 3 * count(*)::BIGINT AS entities FROM documents")
def extracted_entities(spark, folder):
    rows = _table(spark, folder, "documents").select("doc_id", F.lit("a bb ccc").alias("sentence"), F.lit(None).cast("array<struct<name:string,start:int,end:int>>").alias("entities"))
    import re

    found = text.extract_entities(rows, lambda: lambda s: [{"name": "W", "start": m.start(), "end": m.end()} for m in re.finditer(r"\w+", s)])
    return found.agg(F.sum(F.size("entities")).alias("entities"))


@query(_label_counts_sql("customer"))
def json_lines_round_trip(spark, folder):
    """The forest written as JSON lines and read again."""
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}.jsonl"
    sinks.write_json_lines(_customer_nodes(spark, folder), path)
    return _label_counts(lines.read_forest(spark, [path]))


@query("""SELECT * FROM (VALUES ('COLL', 'a', 1::BIGINT), ('COLL', 'ab', 1), ('COLL', 'b', 1), ('GROUP', 'a', 80), ('GROUP', 'b', 80), ('REL', 'ab', 40), ('ENT', 'x', 80), ('ENT', 'y', 160)) AS t(type, name, count)""")
def generated_collections(spark, folder):
    groups = spark.createDataFrame([("a", ["x"]), ("b", ["y", "z"])], "name string, entities array<string>").select(
        "name", F.transform("entities", lambda e: F.when(e == "z", "y").otherwise(e)).alias("entities"))
    relations = spark.createDataFrame([("ab", "a", "b")], "name string, left string, right string")
    return _label_counts(trees_to_nodes(lines.gathered_instances(lines.generate_instances(spark, groups, relations, 40))))


@query("SELECT count(*)::BIGINT AS kept, count_if(c_custkey % 5 = 1)::BIGINT AS replaced FROM customer WHERE c_custkey % 4 <> 0")
def stored_trees(spark, folder):
    """A store after adding all customers, adding some again with another tree, and discarding some, in one transaction."""
    import uuid

    store = TreeStore(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    c = _table(spark, folder, "customer").select(F.col("c_custkey"), F.col("c_custkey").cast("string").alias("tree_id"))
    store.add(_bracketed(c.select("tree_id", _node("ROOT", _ent("k", F.col("c_custkey"))).alias("tree"))))
    with store.transaction():
        store.add(_bracketed(c.where("c_custkey % 5 = 1").select("tree_id", _node("NEW", _ent("k", F.col("c_custkey"))).alias("tree"))))
        store.discard(c.where("c_custkey % 4 = 0"))
    return store.read().agg(F.count("*").alias("kept"), F.count_if(F.col("tree").contains('"NEW"')).alias("replaced"))


# --- rewriting ----------------------------------------------------------------------------------------------------------


def _changed(trees: DataFrame, change: Callable[[Node], rewrite.Change]) -> DataFrame:
    return _label_counts(trees_to_nodes(map_trees(trees, change))).where("type IS NOT NULL")


def _customers_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    c = _table(spark, folder, "customer")
    group = _node("GROUP::customer", _ent("c_name", F.col("c_name")))
    return _bracketed(c.groupBy(F.col("c_nationkey").alias("tree_id")).agg(
        F.concat(F.lit("(ROOT (GROUP::nation (ENT::key 1)) "), F.array_join(F.collect_list(group), " "), F.lit(")")).alias("tree")))


@query("""SELECT type, name, count::BIGINT AS count FROM (SELECT 'COLL' AS type, 'customer' AS name, count(*) AS count FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'GROUP', 'customer', count(*) FROM customer UNION ALL SELECT 'ENT', 'c_name', count(*) FROM customer
  UNION ALL SELECT 'GROUP', 'nation', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'ENT', 'key', count(DISTINCT c_nationkey) FROM customer) WHERE count > 0""")
def found_collections(spark, folder):
    return _changed(_customers_by_nation(spark, folder), rewrite.find_collections)


@query("""SELECT type, name, count::BIGINT AS count FROM (SELECT 'REL' AS type, 'customer<->nation' AS name, count(*) FILTER (k > 1 OR k = 1) AS count FROM (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1)
  WHERE k = 1 UNION ALL SELECT 'REL', 'customer<->nation', count(*) FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)) WHERE count > 0""")
def found_relations(spark, folder):
    """A nation beside its customers, gathered in a collection, becomes a relation for each of them."""

    def both(t: Node) -> rewrite.Change:
        return rewrite.find_relations(rewrite.find_collections(t)[0])

    return _changed(_customers_by_nation(spark, folder), both).where("type = 'REL'")


def _event_trees(spark: SparkSession, folder: str) -> DataFrame:
    e = _table(spark, folder, "events")
    tree = _node("event", _node("who", _ent("user", F.col("user_id")), _ent("kind", F.col("event_type"))), _node("what", _ent("value", F.col("event_id"))))
    return _bracketed(e.select(F.col("event_id").alias("tree_id"), tree.alias("tree")))


def _inner_labels(trees: DataFrame, change: Callable[[Node], rewrite.Change]) -> DataFrame:
    nodes = trees_to_nodes(map_trees(trees, change)).where("kind = 'NODE'")
    return nodes.groupBy("label").agg(F.count("*").alias("count"))


_EVENTS = "SELECT label, (k * n)::BIGINT AS count FROM (SELECT count(*) AS n FROM events), (VALUES {}) AS t(label, k)"
_EVENT_ENTS = "('ENT::user', 1), ('ENT::kind', 1), ('ENT::value', 1)"


@query(_EVENTS.format(f"('event', 1), {_EVENT_ENTS}"))
def reduced_from_below(spark, folder):
    return _inner_labels(_event_trees(spark, folder), rewrite.reduce_bottom)


@query(_EVENTS.format(f"('event', 1), {_EVENT_ENTS}"))
def reduced_from_above(spark, folder):
    return _inner_labels(_event_trees(spark, folder), rewrite.reduce_top)


_KNOWN = {"person": ["(GROUP::person (ENT::user 1) (ENT::kind 2))"] * 3}


@query(_EVENTS.format(f"('event', 1), ('GROUP::person', 1), {_EVENT_ENTS}"))
def found_subgroups(spark, folder):
    """The part of a flat event that a known cluster supports becomes a group."""
    known = rewrite.Equivalence.from_trees({k: [from_bracket(t) for t in ts] for k, ts in _KNOWN.items()}, tau=0.8, metric="jaccard")
    return _inner_labels(_event_trees(spark, folder), lambda t: rewrite.find_subgroups(rewrite.reduce_bottom(t)[0], known, 2))


@query(_EVENTS.format(f"('event', 1), ('GROUP::record', 1), {_EVENT_ENTS}"))
def merged_groups(spark, folder):
    """A group and the entity beside it merge where a cluster knows them as one."""
    known = rewrite.Equivalence.from_trees(
        {"record": [from_bracket("(GROUP::record (ENT::user 1) (ENT::kind 2) (ENT::value 3))")] * 4, "person": [from_bracket(_KNOWN["person"][0])] * 2},
        tau=0.8, metric="jaccard")

    def change(t: Node) -> rewrite.Change:
        grouped = rewrite.create_groups(t, [("person", {(0,)})])[0]
        return rewrite.merge_groups(rewrite.reduce_bottom(grouped)[0], known, 2)

    return _inner_labels(_event_trees(spark, folder), change)


@query(_EVENTS.format(f"('event', 1), ('GROUP::thing', 1), ('what', 1), {_EVENT_ENTS}"))
def renamed_clusters(spark, folder):
    """Groups made of cluster members, with the cluster's number taken off their name."""
    names = rewrite.simplified_names(["thing_12"])
    return _inner_labels(_event_trees(spark, folder), lambda t: rewrite.rename(rewrite.create_groups(t, [("thing_12", {(0,)})])[0], names))


@query("SELECT label, (k * n)::BIGINT AS count FROM (SELECT count(*) AS n FROM events), (VALUES ('ROOT', 1), ('event', 1), ('who', 1), ('what', 1), " + _EVENT_ENTS + ") AS t(label, k)")
def model_rewritten(spark, folder):
    """A text model that answers with the trees as they came."""
    nodes = trees_to_nodes(vocabulary.model_rewrite(_event_trees(spark, folder), lambda: lambda prompt: prompt)).where("kind = 'NODE'")
    return nodes.groupBy("label").agg(F.count("*").alias("count"))


@query("SELECT 'c_name' AS label, 'C_NAME' AS word FROM (SELECT count(*) AS n FROM customer) WHERE n > 0 UNION ALL SELECT 'customer', 'CUSTOMER' UNION ALL SELECT 'key', 'KEY' UNION ALL SELECT 'nation', 'NATION'")
def vocabulary_words(spark, folder):
    found = vocabulary.extract_vocabulary(trees_to_nodes(_customers_by_nation(spark, folder)))
    return spark.createDataFrame(sorted(found.items()), "label string, word string")


@query("""WITH l AS (SELECT CASE WHEN event_id % 2 = 0 THEN 2 ELSE 3 END AS k FROM events)
SELECT count(DISTINCT k)::BIGINT AS clusters, count(*)::BIGINT AS members FROM l""")
def weighted_clusters(spark, folder):
    """Flat events with two and with three entities of different labels: two clusters, all events in them."""
    e = _table(spark, folder, "events")
    two = _node("event", _node("who", _ent("user", F.col("user_id")), _ent("kind", F.col("event_type"))))
    three = _node("event", _node("what", _ent("a", F.col("event_id")), _ent("b", F.col("event_id")), _ent("c", F.col("event_id"))))
    trees = _bracketed(e.select(F.col("event_id").alias("tree_id"), F.when(F.col("event_id") % 2 == 0, two).otherwise(three).alias("tree")))
    shapes = stored(simplify.shape_counts(trees), "shapes")
    found = cluster.clusters(trees_to_nodes(shapes), weights=shapes).where("size(pos) = 1")
    return found.agg(F.countDistinct("cluster").alias("clusters"), F.coalesce(F.sum("weight"), F.lit(0)).alias("members"))


# --- sinks --------------------------------------------------------------------------------------------------------------


@query("SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def link_table(spark, folder):
    """A relation that is many-to-many on both sides becomes a table of keys, joined back for the names."""
    own = schema.Schema({t: frozenset(TABLES[t].attributes) for t in ("customer", "nation")}, frozenset({schema.Relation("customer<->nation", "customer", "nation")}))
    tables = sinks.export_tables(_customer_nodes(spark, folder), own)
    return tables["customer<->nation"].join(tables["customer"], "customer_oid").join(tables["nation"], "nation_oid").select("c_name", "n_name")


@query("SELECT 'person' AS label, 'Ann Lee' AS full_name, 'string' AS kind, count(*)::BIGINT AS n FROM customer")
def vertices_with_words(spark, folder):
    """Entities of several words, and several entities of one label in a group."""
    c = _table(spark, folder, "customer").select(F.col("c_custkey").alias("tree_id"))
    tree = F.lit("(ROOT (GROUP::person (ENT::name Ann Lee) (ENT::name Annie) (ENT::age 30)))")
    v = sinks.export_vertices(trees_to_nodes(_bracketed(c.select("tree_id", tree.alias("tree")))))
    return v.groupBy("label", F.col("props")["name"]["text"].alias("full_name"), F.col("props")["name"]["kind"].alias("kind")).agg(F.count("*").alias("n"))
