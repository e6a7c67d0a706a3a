"""All registered queries of the forest engine with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import functions as fn
from sylva import sinks
from sylva.model import trees_to_nodes
from sylva.operators import cluster, forest, quality, schema, simplify
from sylva.shared import stored
from sylva.sources import documents as docs
from sylva.sources import graph, lines, text
from sylva.sources import relational as rel
from sylva.sources.retail import TABLES, loader

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _ORACLES[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from sylva.plans import trees  # noqa: F401  (registers its queries here)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from sylva.plans import trees  # noqa: F401

    return dict(_ORACLES)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _walk(spark: SparkSession, folder: str, root: str) -> rel.Walk:
    return rel.read_walk(loader(spark, folder), TABLES, root)


def _customer_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _walk(spark, folder, "customer").nodes()


# How often a table stands in one tree of the walk: once alone, and once per relation that it takes part in.
_PLACES = {
    "lineitem": {"lineitem": 4, "orders": 3, "customer": 3, "nation": 5, "region": 2, "part": 2, "supplier": 3},
    "customer": {"customer": 2, "nation": 3, "region": 2},
    "orders": {"orders": 2, "customer": 3, "nation": 3, "region": 2},
}
_JOINED = {
    "lineitem": "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey",
    "customer": "customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "orders": "orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
}
_RELATIONS = {
    "lineitem": ["lineitem<->orders", "orders<->customer", "customer<->nation", "nation<->region", "lineitem<->part", "lineitem<->supplier", "supplier<->nation"],
    "customer": ["customer<->nation", "nation<->region"],
    "orders": ["orders<->customer", "customer<->nation", "nation<->region"],
}


def _label_counts_sql(root: str, groups: dict[str, str] | None = None, leave_out: tuple[str, ...] = ()) -> str:
    parts = ["SELECT NULL::VARCHAR AS type, 'ROOT' AS name, count(*)::BIGINT AS count FROM j"]
    for table, places in _PLACES[root].items():
        if table in leave_out:
            continue
        parts.append(f"SELECT 'GROUP', '{(groups or {}).get(table, table)}', ({places} * count(*))::BIGINT FROM j")
        parts += [f"SELECT 'ENT', '{c}', ({places} * count({c}))::BIGINT FROM j" for c in TABLES[table].attributes]
    parts += [f"SELECT 'REL', '{r}', count(*)::BIGINT FROM j" for r in _RELATIONS[root] if not set(r.split("<->")) & set(leave_out)]
    return f"WITH j AS (SELECT * FROM {_JOINED[root]}) " + " UNION ALL ".join(parts)


def _label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'NODE'").groupBy("type", "name").agg(F.count("*").alias("count"))


# --- sources ------------------------------------------------------------------------------------------------------------


@query(_label_counts_sql("lineitem"))
def forest_label_counts(spark, folder):
    """Relational walk from all root tables: nodes per label over the whole forest."""
    return _walk(spark, folder, "lineitem").label_counts()


@query(_label_counts_sql("orders"))
def forest_node_rows(spark, folder):
    """The same for orders, counted from the node rows themselves."""
    return _label_counts(_walk(spark, folder, "orders").nodes())


@query("SELECT 'lineitem' AS table_name")
def root_tables(spark, folder):
    return spark.createDataFrame([(t,) for t in rel.root_tables(TABLES)], "table_name string")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unreferenced_orders(spark, folder):
    return rel.unreferenced(loader(spark, folder), TABLES, "orders").select("o_orderkey", "o_custkey")


_REFERENCED = {
    "orders": "o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "part": "p_partkey IN (SELECT l_partkey FROM lineitem)",
    "supplier": "s_suppkey IN (SELECT l_suppkey FROM lineitem)",
    "customer": "c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))",
    "nation": "n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem))",
    "region": "r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))))",
}
for _group, _where in _REFERENCED.items():
    query(
        "SELECT DISTINCT " + ", ".join(f"{c}::VARCHAR AS {c}" for c in TABLES[_group].attributes) + f" FROM {_group} WHERE {_where}",
        f"group_instances_{_group}",
    )(lambda spark, folder, g=_group: rel.referenced_instances(loader(spark, folder), TABLES, "lineitem", g))


def _oid_sql() -> str:
    import uuid

    inner = uuid.uuid5(uuid.UUID(rel.NAMESPACE), "customer").hex
    return (
        "SELECT c_custkey, r[1:8] || '-' || r[9:12] || '-5' || r[14:16] || '-' || substr('89ab', (('0x' || r[17:17])::INTEGER % 4) + 1, 1)"
        " || r[18:20] || '-' || r[21:32] AS oid FROM (SELECT c_custkey, sha1(unhex('" + inner + "') || ('c_custkey=' || c_custkey)::BLOB) AS r FROM customer)"
    )


@query(_oid_sql())
def oid_customer(spark, folder):
    return _table(spark, folder, "customer").select("c_custkey", fn.record_oid(rel.NAMESPACE, "customer", {"c_custkey": F.col("c_custkey")}).alias("oid"))


@query("""SELECT type, name, count(*)::BIGINT AS count FROM (
  SELECT 'GROUP' AS type, 'root' AS name FROM events WHERE json_extract_string(props, '$.k') <> ''
  UNION ALL SELECT 'ENT', 'k' FROM events WHERE json_extract_string(props, '$.k') <> '') GROUP BY ALL""")
def event_property_trees(spark, folder):
    """JSON documents as trees."""
    return _label_counts(trees_to_nodes(docs.read_documents(_table(spark, folder, "events"), "event_id", "props")))


def _conversation_documents(spark, folder) -> DataFrame:
    turns = _table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.to_json(F.struct("conv_id", "turns")).alias("json"))


@query("""SELECT conv_id::VARCHAR AS tree_id, count(*)::BIGINT AS relations, count_if(text IS NOT NULL AND text <> '')::BIGINT AS texts
FROM conversations GROUP BY conv_id""")
def conversation_relations(spark, folder):
    """Nested documents: a relation between a conversation and each of its turns."""
    nodes = trees_to_nodes(docs.read_documents(_conversation_documents(spark, folder), "conv_id", "json", "conversation"))
    return nodes.groupBy("tree_id").agg(
        F.count_if((F.col("type") == "REL") & (F.col("name") == "conversation<->turns")).alias("relations"),
        F.count_if((F.col("type") == "ENT") & (F.col("name") == "text")).alias("texts"),
    )


@query("""WITH s AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS idx, parts[i] AS sentence,
  (coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0))::INTEGER AS "begin",
  (coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) + length(parts[i]))::INTEGER AS "end"
FROM (SELECT doc_id, parts, unnest(range(1, n + 1)) AS i FROM s)""")
def sentences(spark, folder):
    return text.split_sentences(_table(spark, folder, "documents"))


@query("""WITH e AS (SELECT doc_id, k AS entity_id, 'SPAN' AS name, ((doc_id * 31 + k * 97) % n_chars)::INTEGER AS start,
    ((doc_id * 31 + k * 97) % n_chars + 5 + k)::INTEGER AS "end" FROM documents, unnest(range(0, 5)) AS t(k) WHERE n_chars > 0),
p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
s AS (SELECT doc_id, (i - 1)::INTEGER AS idx, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) AS b, length(parts[i]) AS n
      FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p))
SELECT e.doc_id, s.idx, e.entity_id, e.name, greatest(e.start - s.b, 0)::INTEGER AS start, (e."end" - s.b)::INTEGER AS "end"
FROM e JOIN s ON e.doc_id = s.doc_id AND e."end" > s.b AND e."end" <= s.b + s.n""")
def spans_in_sentences(spark, folder):
    """Character spans to the sentences in which they end."""
    d = _table(spark, folder, "documents")
    spans = d.where("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("entity_id"))
    start = ((F.col("doc_id") * 31 + F.col("entity_id") * 97) % F.col("n_chars")).cast("int")
    spans = spans.select("doc_id", "entity_id", F.lit("SPAN").alias("name"), start.alias("start"), (start + 5 + F.col("entity_id")).cast("int").alias("end"))
    return text.assign_entities(spans, text.split_sentences(d))


@query("""SELECT kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN lower(trim(v)) IN ('true', 'false') THEN 'boolean'
  WHEN regexp_full_match(trim(v), '[+-]?\\d+') THEN 'integer' WHEN try_cast(trim(v) AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS kind
  FROM (SELECT c_custkey::VARCHAR AS v FROM customer UNION ALL SELECT c_name FROM customer UNION ALL SELECT c_acctbal::VARCHAR FROM customer
        UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE ' false ' END FROM customer)) GROUP BY kind""")
def typed_values(spark, folder):
    """Kinds of textual values on export."""
    c = _table(spark, folder, "customer")
    flag = F.when(F.col("c_custkey") % 2 == 0, "True").otherwise(" false ")
    values = c.select(F.explode(F.array(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"), flag)).alias("v"))
    return values.groupBy(fn.typed_value(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT type, name, sum(n)::BIGINT AS count FROM (
  SELECT 'GROUP' AS type, g AS name, n FROM (VALUES ('customer', 60), ('orders', 90), ('part', 60)) AS t(g, n)
  UNION ALL SELECT 'REL', r, 30 FROM (VALUES ('customer_orders'), ('orders_part')) AS t(r)
  UNION ALL SELECT 'ENT', e, n FROM (VALUES ('c_name', 60), ('c_custkey', 60), ('o_orderkey', 90), ('p_name', 60)) AS t(e, n)) GROUP BY ALL""")
def generated_instances(spark, folder):
    """Synthetic instances of a schema."""
    groups = spark.createDataFrame([("customer", ["c_custkey", "c_name"]), ("orders", ["o_orderkey"]), ("part", ["p_name"])], "name string, entities array<string>")
    relations = spark.createDataFrame([("customer_orders", "customer", "orders"), ("orders_part", "orders", "part")], "name string, left string, right string")
    nodes = rel.trees_as_nodes(lines.generate_instances(spark, groups, relations, 30))
    return _label_counts(nodes).where("type IS NOT NULL")


@query("""SELECT r_name AS tree, type, name, count(*)::BIGINT AS count FROM (
  SELECT r_name, 'GROUP' AS type, 'region' AS name FROM region
  UNION ALL SELECT r_name, 'REL', 'in_region' FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, 'GROUP', g FROM region JOIN nation ON n_regionkey = r_regionkey, unnest(['region', 'nation', 'nation']) AS t(g)) GROUP BY ALL""")
def graph_forest(spark, folder):
    """A property graph of regions and nations."""
    r, n = _table(spark, folder, "region"), _table(spark, folder, "nation")
    vertices = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("region").alias("label"), F.create_map(F.lit("name"), F.col("r_name")).alias("props")).union(
        n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("nation"), F.create_map(F.lit("name"), F.col("n_name"))))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    edges = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("in_region").alias("type"), none.alias("props"))
    nodes = rel.trees_as_nodes(graph.read_graph(vertices, edges))
    names = r.select(F.concat(F.lit("r"), "r_regionkey").alias("tree_id"), F.col("r_name").alias("tree"))
    return nodes.where("type IN ('GROUP', 'REL')").join(names, "tree_id").groupBy("tree", "type", "name").agg(F.count("*").alias("count"))


# --- tree operators -----------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT (2 * ((o_orderkey IS NOT NULL)::INT + (o_orderstatus IS NOT NULL)::INT + (o_totalprice IS NOT NULL)::INT + (o_orderdate IS NOT NULL)::INT + (o_orderpriority IS NOT NULL)::INT)
  + CASE WHEN c_custkey IS NULL THEN 0 ELSE 3 * (1 + (c_name IS NOT NULL)::INT + (c_acctbal IS NOT NULL)::INT + (c_mktsegment IS NOT NULL)::INT) END
  + CASE WHEN n_nationkey IS NULL THEN 0 ELSE 3 * (1 + (n_name IS NOT NULL)::INT) END + CASE WHEN r_regionkey IS NULL THEN 0 ELSE 2 * (1 + (r_name IS NOT NULL)::INT) END)::BIGINT AS n_leaves
  FROM """ + _JOINED["orders"] + """) SELECT 5::INTEGER AS height, n_leaves, count(*)::BIGINT AS trees FROM t GROUP BY n_leaves""")
def forest_tree_shape(spark, folder):
    # Height counts a leaf as one level and the root as another.
    return _walk(spark, folder, "orders").sizes().groupBy("height", "n_leaves").agg(F.count("*").alias("trees"))


@query("SELECT name, count FROM (" + _label_counts_sql("customer") + ") WHERE type = 'ENT'")
def entity_histogram(spark, folder):
    return forest.entity_label_count(_customer_nodes(spark, folder))


@query("SELECT count(*)::BIGINT AS n_trees, (24 * count(*))::BIGINT - 6 * count(*)::BIGINT AS n_ent, (7 * count(*))::BIGINT AS n_group, (2 * count(*))::BIGINT AS n_rel, 0::BIGINT AS n_coll, 5::INTEGER AS max_height, 5.0::DOUBLE AS avg_height, 18::BIGINT AS max_leaves, 18.0::DOUBLE AS avg_leaves, 5::BIGINT AS max_branching, round(45 / 28.0, 9)::DOUBLE AS avg_branching FROM customer")
def inspector_summary(spark, folder):
    return forest.inspect(_customer_nodes(spark, folder)).withColumn("avg_branching", F.round("avg_branching", 9))


@query("""SELECT tree, height, n_entities, dup FROM (VALUES ('GROUP::customer', 3, 4, false), ('GROUP::nation', 3, 2, false), ('GROUP::region', 3, 2, false),
  ('REL::customer<->nation', 4, 6, false), ('REL::nation<->region', 4, 4, false), ('ROOT', 5, 18, true)) AS t(tree, height, n_entities, dup)""")
def subtree_measures(spark, folder):
    m = forest.subtree_measures(_customer_nodes(spark, folder), ("label", "kind", "type")).where("kind = 'NODE' AND (type IS NULL OR type <> 'ENT')")
    return m.select(F.col("label").alias("tree"), "height", F.col("n_entities").cast("int").alias("n_entities"), F.col("has_duplicate_entity").alias("dup")).distinct()


@query(_label_counts_sql("customer", {"customer": "client"}))
def renamed_groups(spark, folder):
    renames = spark.createDataFrame([("GROUP", "customer", "client")], "type string, old string, new string")
    return _label_counts(forest.apply_renaming(_customer_nodes(spark, folder), renames))


@query("""WITH f AS (SELECT conv_id::VARCHAR AS tree_id, conv_id, arg_min(turn, turn) FILTER (turn IS NOT NULL) AS turn, arg_min(role, turn) FILTER (role <> '') AS role,
  arg_min(text, turn) FILTER (text <> '') AS text FROM conversations GROUP BY conv_id)
SELECT tree_id, 'group_1' AS group_name, entity, value FROM (SELECT tree_id, 'conv_id' AS entity, conv_id::VARCHAR AS value FROM f
  UNION ALL SELECT tree_id, 'turn', turn::VARCHAR FROM f UNION ALL SELECT tree_id, 'role', role FROM f UNION ALL SELECT tree_id, 'text', text FROM f)""")
def simple_rewrite_groups(spark, folder):
    nodes = trees_to_nodes(docs.read_documents(_conversation_documents(spark, folder), "conv_id", "json", "conversation", raw=True))
    return forest.simple_rewrite(nodes)


# --- schema -------------------------------------------------------------------------------------------------------------


@query("SELECT lhs, rhs FROM (VALUES " + ", ".join(
    [f"('GROUP::{t}', '{' '.join(sorted('ENT::' + c for c in TABLES[t].attributes))}')" for t in _PLACES["customer"]]
    + ["('REL::customer<->nation', 'GROUP::customer GROUP::nation')", "('REL::nation<->region', 'GROUP::nation GROUP::region')"]) + ") AS t(lhs, rhs)")
def schema_productions(spark, folder):
    return schema.productions(_customer_nodes(spark, folder)).select("lhs", F.array_join("rhs", " ").alias("rhs"))


_ORIENTED = """WITH m AS (
  SELECT 'orders<->customer' AS name, 'orders' AS "left", 'customer' AS "right", false AS l, (SELECT max(n) > 1 FROM (SELECT count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey)) AS r
  UNION ALL SELECT 'customer<->nation', 'customer', 'nation', false, (SELECT max(n) > 1 FROM (SELECT count(DISTINCT c_custkey) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_nationkey))
  UNION ALL SELECT 'nation<->region', 'nation', 'region', false, (SELECT max(n) > 1 FROM (SELECT count(DISTINCT n_nationkey) AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) GROUP BY n_regionkey)))
SELECT name, "left", "right", CASE WHEN l = r THEN 'BOTH' WHEN l THEN 'LEFT' ELSE 'RIGHT' END AS orientation FROM m"""


@query(_ORIENTED)
def schema_relation_orientation(spark, folder):
    return schema.orientations(_walk(spark, folder, "orders").relation_examples())


@query(f"""WITH o AS ({_ORIENTED}), w AS (SELECT "left" AS name, CASE WHEN orientation = 'RIGHT' THEN 1 ELSE 3 END AS w FROM o UNION ALL SELECT "right", CASE WHEN orientation = 'LEFT' THEN 1 ELSE 3 END FROM o)
SELECT name FROM w GROUP BY name HAVING sum(w) = 2""")
def collapsible_groups(spark, folder):
    return schema.collapsible(schema_relation_orientation(spark, folder))


def _nation_segments(spark, folder) -> DataFrame:
    """Groups of unequal sizes: the nations' pairs of segment and hundreds of the balance, over all customers."""
    c = _table(spark, folder, "customer")
    return c.groupBy(F.col("c_nationkey").cast("string").alias("name")).agg(F.array_sort(F.collect_set(F.concat("c_mktsegment", F.floor(F.col("c_acctbal") / 100).cast("string")))).alias("entities"))


_SEGMENTS = "WITH g AS (SELECT c_nationkey::VARCHAR AS name, list_sort(list(DISTINCT c_mktsegment || floor(c_acctbal / 100)::BIGINT::VARCHAR)) AS e FROM customer GROUP BY 1) "


@query(_SEGMENTS + """SELECT round(coalesce(avg(len(list_intersect(a.e, b.e)) / len(list_distinct(list_concat(a.e, b.e)))::DOUBLE), 0), 9)::DOUBLE AS overlap FROM g a JOIN g b ON a.name < b.name""")
def group_overlap(spark, folder):
    return schema.overlap(_nation_segments(spark, folder)).select(F.round("overlap", 9).alias("overlap"))


@query(_SEGMENTS + "SELECT round(1 - stddev_pop(len(e)) / avg(len(e)), 9)::DOUBLE AS balance FROM g")
def group_balance(spark, folder):
    return schema.balance(_nation_segments(spark, folder)).select(F.round("balance", 9).alias("balance"))


@query(_label_counts_sql("customer", leave_out=("region",)))
def valid_trees(spark, folder):
    """The forest under a schema without regions: their nodes go, entities of dropped groups at the root too."""
    known = {t: frozenset(TABLES[t].attributes) for t in ("customer", "nation")}
    own = schema.Schema(known, frozenset({schema.Relation("customer<->nation", "customer", "nation")}))
    kept = schema.valid_trees(_customer_nodes(spark, folder), own)
    return _label_counts(kept)


# --- quality ------------------------------------------------------------------------------------------------------------


def _part(spark, folder) -> DataFrame:
    return _table(spark, folder, "part").select("p_brand", "p_type", "p_size")


@query("""WITH c AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT p_type, p_size, max(n) AS m, sum(n) AS t FROM c GROUP BY ALL)
SELECT round(sum(m) / sum(t)::DOUBLE, 9)::DOUBLE AS confidence FROM b""")
def fd_confidence_part(spark, folder):
    return quality.confidence(_part(spark, folder), "p_brand").select(F.round("confidence", 9).alias("confidence"))


def _confidence_sql(own: list[str], a: str) -> str:
    rest = ", ".join(x for x in own if x != a)
    return f"(SELECT sum(m) / sum(t)::DOUBLE FROM (SELECT {rest}, max(n) AS m, sum(n) AS t FROM (SELECT {', '.join(own)}, count(*) AS n FROM part GROUP BY ALL) GROUP BY {rest}))"


_ATTRS = ["p_brand", "p_type", "p_size"]


@query("SELECT round(greatest(" + ", ".join(_confidence_sql(_ATTRS, a) for a in _ATTRS) + "), 9)::DOUBLE AS score")
def dependency_score_part(spark, folder):
    return quality.dependency_score(_part(spark, folder), _ATTRS).select(F.round("score", 9).alias("score"))


_SETS = [["p_brand", "p_type"], ["p_brand", "p_size"], ["p_type", "p_size"], _ATTRS]


@query("SELECT round(avg((" + " OR ".join(
    f"(greatest({', '.join(_confidence_sql(s, a) for a in s)}) >= 0.2 AND (SELECT count(*) FROM part q WHERE " + " AND ".join(f"q.{c} = p.{c}" for c in s) + ") > 1)" for s in _SETS)
    + ")::INT), 9)::DOUBLE AS redundancy FROM part p")
def redundancy_part(spark, folder):
    return quality.redundancy(_part(spark, folder), tau=0.2).select(F.round("redundancy", 9).alias("redundancy"))


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT round((SELECT count(*) FROM a WHERE o_custkey IN (SELECT o_custkey FROM b)) / (SELECT count(*) FROM a)::DOUBLE, 9)::DOUBLE AS coverage""")
def entity_coverage(spark, folder):
    """How many entities of all orders' customers remain among urgent orders."""
    load = loader(spark, folder)
    whole = rel.read_walk(load, TABLES, "orders").records("customer")
    urgent = rel.read_walk(load, TABLES, "orders", source=load("orders").where("o_orderpriority = '1-URGENT'")).records("customer")

    def ents(records: DataFrame) -> DataFrame:
        return records.select(F.explode(F.transform("entities", lambda e: F.concat_ws("/", F.col("oid"), e))).alias("oid"))

    return quality.coverage(ents(whole), ents(urgent)).select(F.round("coverage", 9).alias("coverage"))


@query("""WITH t AS (SELECT c_nationkey AS x, c_mktsegment AS y, count(*)::DOUBLE AS n FROM customer GROUP BY ALL), s AS (SELECT sum(n) AS t FROM t),
h AS (SELECT -sum(ny / t * ln(ny / t)) AS h FROM (SELECT y, sum(n) AS ny FROM t GROUP BY y), s),
c AS (SELECT -sum(n / t * ln(n / nx)) AS c FROM t JOIN (SELECT x, sum(n) AS nx FROM t GROUP BY x) USING (x), s)
SELECT round(1 - c / h, 9)::DOUBLE AS completeness FROM h, c""")
def cluster_completeness(spark, folder):
    c = _table(spark, folder, "customer")
    table = quality.contingency(c.select(F.col("c_custkey").alias("oid"), F.col("c_nationkey").alias("cluster")), c.select(F.col("c_custkey").alias("oid"), F.col("c_mktsegment").alias("cluster")))
    return quality.completeness(table).select(F.round("completeness", 9).alias("completeness"))


@query("""WITH t AS (SELECT c_nationkey AS x, c_mktsegment AS y, count(*)::DOUBLE AS n FROM customer GROUP BY ALL), s AS (SELECT sum(n) AS t FROM t),
x AS (SELECT x, sum(n) AS nx FROM t GROUP BY x), y AS (SELECT y, sum(n) AS ny FROM t GROUP BY y),
mi AS (SELECT sum(n / t * ln(t * n / (nx * ny))) AS mi FROM t JOIN x USING (x) JOIN y USING (y), s),
h AS (SELECT (SELECT -sum(nx / t * ln(nx / t)) FROM x, s) AS hx, (SELECT -sum(ny / t * ln(ny / t)) FROM y, s) AS hy),
k AS (SELECT nx AS a, ny AS b, t, unnest(range(greatest(1, nx + ny - t)::BIGINT, least(nx, ny)::BIGINT + 1)) AS k FROM x, y, s),
e AS (SELECT sum(k / t * ln(t * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1)
  - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS e FROM k)
SELECT round((mi - e) / ((hx + hy) / 2 - e), 6)::DOUBLE AS ami FROM mi, h, e""")
def cluster_mutual_information(spark, folder):
    c = _table(spark, folder, "customer")
    table = quality.contingency(c.select(F.col("c_custkey").alias("oid"), F.col("c_nationkey").alias("cluster")), c.select(F.col("c_custkey").alias("oid"), F.col("c_mktsegment").alias("cluster")))
    return quality.adjusted_mutual_information(table).select(F.round("ami", 6).alias("ami"))


@query("SELECT type, sum(count)::BIGINT AS n_nodes, count(*)::BIGINT AS n_labels, round(sum(count) / count(*)::DOUBLE, 6)::DOUBLE AS ratio FROM (" + _label_counts_sql("customer") + ") GROUP BY type")
def type_statistics(spark, folder):
    return quality.type_statistics(_customer_nodes(spark, folder)).withColumn("ratio", F.round("ratio", 6))


# --- similarity and clustering --------------------------------------------------------------------------------------------


def _brand_types(spark, folder) -> DataFrame:
    return _table(spark, folder, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("labels"))


_BRANDS = "WITH g AS (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS e FROM part GROUP BY 1), p AS (SELECT a.p_brand AS a, b.p_brand AS b, a.e AS x, b.e AS y FROM g a JOIN g b ON a.p_brand < b.p_brand), m AS (SELECT *, len(list_intersect(x, y)) AS i FROM p) "


def _similarities(spark, folder, metric) -> DataFrame:
    g = _brand_types(spark, folder)
    a, b = (g.select(F.col("p_brand").alias(s), F.col("labels").alias(f"l{s}")) for s in "ab")
    keyed_a, keyed_b = a.withColumn("key", F.explode("la")), b.withColumn("key", F.explode("lb"))
    met = keyed_a.join(keyed_b, "key").where("a < b").select("a", "b", "la", "lb").distinct()
    return met.select("a", "b", F.round(metric(F.col("la"), F.col("lb")), 9).alias("similarity"))


@query(_BRANDS + "SELECT a, b, round(i / len(list_distinct(list_concat(x, y)))::DOUBLE, 9)::DOUBLE AS similarity FROM m WHERE i > 0")
def label_similarity_jaccard(spark, folder):
    return _similarities(spark, folder, fn.jaccard)


@query(_BRANDS + "SELECT a, b, round(2 * i / (len(x) + len(y))::DOUBLE, 9)::DOUBLE AS similarity FROM m WHERE i > 0")
def label_similarity_dice(spark, folder):
    return _similarities(spark, folder, fn.dice)


@query(_BRANDS + """, j AS (SELECT *, len(list_filter(list_intersect(x, y), lambda t: abs(list_position(x, t) - list_position(y, t)) <= greatest(greatest(len(x), len(y)) // 2 - 1, 0))) AS k,
  len(list_filter([1, 2, 3, 4], lambda n: n <= len(x) AND n <= len(y) AND x[1:n] = y[1:n])) AS f FROM m WHERE i > 0),
v AS (SELECT a, b, f, CASE WHEN k = 0 THEN 0.0 ELSE (k / len(x)::DOUBLE + k / len(y)::DOUBLE + 1) / 3 END AS s FROM j)
SELECT a, b, round(CASE WHEN s > 0.7 THEN s + f * 0.1 * (1 - s) ELSE s END, 9)::DOUBLE AS similarity FROM v""")
def label_similarity_jaro_winkler(spark, folder):
    return _similarities(spark, folder, fn.jaro_winkler)


def _event_trees(spark, folder) -> DataFrame:
    e = _table(spark, folder, "events")
    body = F.to_json(F.struct(F.struct("user_id", "event_type").alias("who"), F.struct("value", "ts").alias("what")))
    return docs.read_documents(e.select("event_id", body.alias("json")), "event_id", "json", "event", raw=True)


@query()
def subtree_clusters(spark, folder):
    """Clusters of all events' subtrees: distinct shapes are compared, each with the number of its trees."""
    shapes = stored(simplify.shape_counts(_event_trees(spark, folder)), "shapes")
    found = cluster.clusters(trees_to_nodes(shapes), weights=shapes)
    return found.groupBy("cluster").agg(F.sum("weight").alias("members"), F.max("n_entities").alias("entities"))


@query()
def rewrite_fixed_point(spark, folder):
    trees, _ = simplify.simplify(_event_trees(spark, folder), epochs=None)
    return _label_counts(trees_to_nodes(trees))


# --- sinks --------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS nation FROM customer")
def export_table_customer(spark, folder):
    """The customer table with its foreign key to nation, joined back for its name."""
    nodes = _customer_nodes(spark, folder)
    own = schema.Schema({t: frozenset(TABLES[t].attributes) for t in ("customer", "nation")}, frozenset({schema.Relation("customer<->nation", "customer", "nation", schema.RIGHT)}))
    tables = sinks.export_tables(nodes, own)
    nations = tables["nation"].select("nation_oid", F.col("n_name").alias("nation"))
    return tables["customer"].join(nations, "nation_oid").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "nation")


@query("""SELECT label, count(*)::BIGINT AS n, sum(k)::BIGINT AS properties FROM (
  SELECT 'customer' AS label, 4 AS k FROM customer UNION ALL SELECT 'nation', 2 FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
  UNION ALL SELECT 'region', 2 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer))) GROUP BY label""")
def export_vertices(spark, folder):
    v = sinks.export_vertices(_customer_nodes(spark, folder))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("props")).alias("properties"))


@query("""SELECT type, count(*)::BIGINT AS n FROM (SELECT 'c_nationkey' AS type FROM customer
  UNION ALL SELECT 'n_regionkey' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)) GROUP BY type""")
def export_edges(spark, folder):
    return sinks.export_edges(_customer_nodes(spark, folder)).groupBy("type").agg(F.count("*").alias("n"))
