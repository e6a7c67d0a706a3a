"""Reading from and writing to a relational database, with an embedded one in memory."""

import uuid

import pytest
from pyspark.sql import functions as F

from sylva.operators import schema
from sylva.pipelines import load_database
from sylva.sinks.database import export_database
from sylva.sources import database
from sylva.sources import relational as rel


@pytest.fixture
def url():
    return f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"


def run(spark, url, *statements):
    with database.connection(spark, url) as c:
        for s in statements:
            c.createStatement().executeUpdate(s)


def test_reflection_and_walk_with_a_composite_key(spark, url):
    run(spark, url,
        'CREATE TABLE "ship" ("yard" INT, "num" INT, "name" VARCHAR(20), PRIMARY KEY ("yard", "num"))',
        'CREATE TABLE "port" ("id" INT PRIMARY KEY, "town" VARCHAR(20))',
        'CREATE TABLE "visit" ("id" INT PRIMARY KEY, "yard" INT, "num" INT, "port" INT REFERENCES "port" ("id"), FOREIGN KEY ("yard", "num") REFERENCES "ship" ("yard", "num"))',
        """INSERT INTO "ship" VALUES (1, 1, 'Ann'), (1, 2, 'Bea'), (2, 1, 'Cis')""", """INSERT INTO "port" VALUES (7, 'Kiel'), (8, 'Hull')""",
        'INSERT INTO "visit" VALUES (1, 1, 2, 7), (2, 2, 1, 7), (3, 2, 1, NULL)')
    catalog = database.reflect(spark, url)
    assert set(catalog) == {"ship", "port", "visit"} and catalog["ship"].primary_key == ("yard", "num")
    keys = {k.target: k.pairs for k in catalog["visit"].foreign_keys}
    assert keys == {"ship": (("yard", "yard"), ("num", "num")), "port": (("port", "id"),)}
    assert catalog["visit"].attributes == ["id"] and rel.root_tables(catalog) == ["visit"]
    nodes = load_database(spark, url, search_all=True)
    names = nodes.where("kind = 'LEAF'").select("tree_id", F.col("value")).where("value IN ('Ann', 'Bea', 'Cis', 'Kiel', 'Hull')").distinct()
    found = sorted(tuple(sorted(r["v"])) for r in names.groupBy("tree_id").agg(F.collect_set("value").alias("v")).collect())
    assert found == [("Ann",), ("Bea", "Kiel"), ("Cis",), ("Cis", "Kiel"), ("Hull",)]


def test_ranges_read_each_row_once(spark, url):
    run(spark, url, 'CREATE TABLE "t" ("k" INT PRIMARY KEY, "v" INT)', 'INSERT INTO "t" VALUES (1, 1), (5, 2), (9, 3), (100, 4)')
    rows = database.loader(spark, url, database.reflect(spark, url), partitions=3)("t")
    assert rows.rdd.getNumPartitions() == 3 and sorted(r["k"] for r in rows.collect()) == [1, 5, 9, 100]


def test_write_twice_adds_once(spark, url):
    from tests.test_operators import nodes_of

    texts = [f"(ROOT (REL::city<->land (GROUP::city (ENT::name {c}) (ENT::people {n})) (GROUP::land (ENT::land {x}))))"
             for c, n, x in (("Ulm", 120000, "BW"), ("Bonn", 330000, "NW"), ("Köln", 1080000, "NW"))]
    nodes = nodes_of(spark, *texts).withColumn("oid", F.when(F.col("type") == "GROUP", F.concat_ws("/", "tree_id", "name")).otherwise(F.col("oid")))
    own = schema.Schema({"city": frozenset({"name", "people"}), "land": frozenset({"land"})}, frozenset({schema.Relation("city<->land", "city", "land", schema.RIGHT)}))
    assert export_database(nodes, own, url) == {"city": 3, "land": 3}
    assert export_database(nodes, own, url) == {"city": 0, "land": 0}
    catalog = database.reflect(spark, url)
    assert catalog["city"].primary_key == ("city_oid",) and [k.target for k in catalog["city"].foreign_keys] == ["land"]
    rows = database.loader(spark, url, catalog)("city")
    assert dict(rows.dtypes)["people"] == "bigint" and {r["name"]: r["people"] for r in rows.collect()}["Köln"] == 1080000


def test_link_tables(spark, url):
    from tests.test_operators import nodes_of

    nodes = nodes_of(spark, "(ROOT (REL::a<->b (GROUP::a (ENT::x 1)) (GROUP::b (ENT::y no))))")
    own = schema.Schema({"a": frozenset({"x"}), "b": frozenset({"y"})}, frozenset({schema.Relation("a<->b", "a", "b")}))
    assert export_database(nodes, own, url) == {"a": 1, "b": 1, "a_b": 1}
    assert {k.target for k in database.reflect(spark, url)["a_b"].foreign_keys} == {"a", "b"}
