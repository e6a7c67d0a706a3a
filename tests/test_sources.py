import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylva import functions as fn
from sylva.model import from_bracket, from_json, nodes_to_trees, to_bracket, trees_to_nodes
from sylva.sources import documents as docs
from sylva.sources import graph, lines, text
from sylva.sources import relational as rel
from sylva.sources.relational import ForeignKey, Table

SHOP = {t.name: t for t in (
    Table("Item", ("id", "title", "cost"), ("id",)),
    Table("Buyer", ("id", "full name", "age"), ("id",)),
    Table("Sale", ("item_id", "buyer_id", "amount"), ("item_id", "buyer_id"), (ForeignKey("item_id", "Item", "id"), ForeignKey("buyer_id", "Buyer", "id"))),
)}


@pytest.fixture(scope="module")
def shop(spark):
    tables = {
        "Item": spark.createDataFrame([(1, "pen", 3), (2, "cup", None)], "id int, title string, cost int"),
        "Buyer": spark.createDataFrame([(1, "Ann Lee", 30), (2, "Bo", 41), (3, "Cy", 22)], "id int, `full name` string, age int"),
        "Sale": spark.createDataFrame([(1, 1, 5), (2, 1, 6), (2, 2, 7)], "item_id int, buyer_id int, amount int"),
    }
    return tables.__getitem__


def brackets(trees):
    nodes = rel.trees_as_nodes(trees)
    return sorted(to_bracket(from_json(r["tree"])) for r in nodes_to_trees(nodes).collect())


def test_database(shop):
    found = brackets(rel.read_database(shop, SHOP))
    assert len(found) == 3
    assert found[0] == (
        "(ROOT (GROUP::Sale (ENT::amount 5)) (REL::Sale<->Buyer (GROUP::Sale (ENT::amount 5)) (GROUP::Buyer (ENT::id 1) (ENT::full_name Ann%20Lee) (ENT::age 30)))"
        " (GROUP::Buyer (ENT::id 1) (ENT::full_name Ann%20Lee) (ENT::age 30)) (REL::Sale<->Item (GROUP::Sale (ENT::amount 5)) (GROUP::Item (ENT::id 1) (ENT::title pen) (ENT::cost 3)))"
        " (GROUP::Item (ENT::id 1) (ENT::title pen) (ENT::cost 3)))")
    assert "(GROUP::Item (ENT::id 2) (ENT::title cup))" in found[1]
    alone = brackets(rel.read_database(shop, SHOP, search_all=True))
    assert [t for t in alone if t not in found] == ["(ROOT (GROUP::Buyer (ENT::id 3) (ENT::full_name Cy) (ENT::age 22)))"]
    assert rel.read_database(shop, SHOP, sample=2).count() == 2


def test_association_table(spark, shop):
    link = Table("Likes", ("item_id", "buyer_id"), ("item_id", "buyer_id"), SHOP["Sale"].foreign_keys)
    catalog = {"Item": SHOP["Item"], "Buyer": SHOP["Buyer"], "Likes": link}
    rows = spark.createDataFrame([(1, 3), (9, 1)], "item_id int, buyer_id int")  # the second refers to nothing
    found = brackets(rel.read_database(lambda t: rows if t == "Likes" else shop(t), catalog))
    assert len(found) == 1 and found[0].startswith("(ROOT (REL::Likes (GROUP::Buyer (ENT::id 3)") and "<->" not in found[0]


def test_roots_and_cycles():
    a = Table("a", ("id", "b_id", "c_id"), ("id",), (ForeignKey("b_id", "b", "id"), ForeignKey("c_id", "c", "id")))
    b = Table("b", ("id", "a_id"), ("id",), (ForeignKey("a_id", "a", "id"),))
    c = Table("c", ("id",), ("id",))
    assert rel.root_tables({"a": a, "b": b, "c": c}) == ["a"]
    assert rel.root_tables({"c": c}) == ["c"]
    assert [s.table for s in rel.plan_walk({"a": a, "b": b, "c": c}, "a")] == ["a", "b", "a", "c"]


def test_repeated_rows_are_different_trees(spark):
    catalog = {"t": Table("t", ("x", "y"))}
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    ids = [r["tree_id"] for r in rel.read_database(lambda _: rows.repartition(3), catalog).collect()]
    assert len(set(ids)) == 3
    assert set(ids) == {r["tree_id"] for r in rel.read_database(lambda _: rows.coalesce(1), catalog).collect()}


def test_record_oid(spark):
    row = spark.createDataFrame([(7, "é", None)], "a int, b string, c string")
    own = row.select(fn.record_oid(rel.NAMESPACE, "T", {"b": F.col("b"), "a": F.col("a"), "c": F.col("c")})).first()[0]
    inner = uuid.uuid5(uuid.UUID(rel.NAMESPACE), "T")
    assert own == str(uuid.uuid5(inner, "a=7;b=é;c=None"))


@pytest.mark.parametrize("data,expected", [
    ({}, []), ({"a": None, "b": ""}, []),
    ({"A b": 1, "c": "x y"}, ["(GROUP::doc (ENT::a_b 1) (ENT::c x%20y))"]),
    ({"k": 1, "sub": {"v": 2}}, ["(ROOT (REL::doc<->sub (GROUP::doc (ENT::k 1)) (GROUP::sub (ENT::v 2))))"]),
    ({"k": 1, "subs": [{"v": 2}, {"v": 3}]},
     ["(ROOT (REL::doc<->subs (GROUP::doc (ENT::k 1)) (GROUP::subs (ENT::v 2))) (REL::doc<->subs (GROUP::doc (ENT::k 1)) (GROUP::subs (ENT::v 3))))"]),
    ([{"v": 2}, {"v": 3}], ["(GROUP::doc (ENT::v 2))", "(GROUP::doc (ENT::v 3))"]),
])
def test_documents(data, expected):
    assert [to_bracket(t) for t in docs.document_trees(data, "doc")] == expected


@pytest.mark.parametrize("content,kind", [
    ('{"a": [1, 2]}', dict), ("<r><a x='1'>t</a><a>u</a></r>", dict), ("a,b\n1,2\n3,4\n", list), ("a: 1\nb: [2, 3]\n", dict), ('[t]\na = "x"\n', dict)])
def test_document_formats(content, kind):
    assert isinstance(docs.parse_document(content), kind)


def test_document_errors():
    for bad in ("", "  ", "just words"):
        with pytest.raises(ValueError):
            docs.parse_document(bad)


def test_read_documents(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, None), (3, "{broken"), (4, '[{"a": 1}, {"a": 2}]')], "id int, body string")
    found = {r["tree_id"] for r in docs.read_documents(rows, "id", "body").collect()}
    assert found == {"1", "4/0", "4/1"}


def test_graph(spark):
    v = spark.createDataFrame([("p", "Person", {"name": "Ann", "none": ""}), ("q", "Person", {"name": "Bo"}), ("c", "City", {"name": "X"})], "id string, label string, props map<string,string>")
    e = spark.createDataFrame([("1", "p", "q", "KNOWS", {}), ("2", "q", "c", "LIVES", {"since": "1999"})], "id string, src string, dst string, type string, props map<string,string>")
    assert [r["id"] for r in graph.root_vertices(v, e).collect()] == ["p"]
    assert brackets(graph.read_graph(v, e)) == [
        "(ROOT (GROUP::Person (ENT::name Ann)) (REL::KNOWS (GROUP::Person (ENT::name Ann)) (GROUP::Person (ENT::name Bo))) (GROUP::Person (ENT::name Bo))"
        " (REL::LIVES (GROUP::LIVES (ENT::since 1999)) (GROUP::Person (ENT::name Bo))) (REL::LIVES (GROUP::LIVES (ENT::since 1999)) (GROUP::City (ENT::name X))) (GROUP::City (ENT::name X)))"]


def test_sentences_and_spans(spark):
    d = spark.createDataFrame([(1, "ab cd\n\nef gh"), (2, None)], "doc_id int, text string")
    s = text.split_sentences(d)
    assert [(r["idx"], r["begin"], r["end"]) for r in s.where("doc_id = 1").orderBy("idx").collect()] == [(0, 0, 5), (1, 6, 6), (2, 7, 12)]
    e = spark.createDataFrame([(1, "a", "X", 3, 5), (1, "b", "X", 3, 9), (1, "c", "X", 5, 5), (1, "d", "X", 8, 40), (1, "e", "X", 10, 12)], "doc_id int, entity_id string, name string, start int, end int")
    placed = text.assign_entities(e, s)
    assert sorted((r["entity_id"], r["idx"], r["start"], r["end"]) for r in placed.collect()) == [("a", 0, 3, 5), ("b", 2, 0, 2), ("e", 2, 3, 5)]
    links = spark.createDataFrame([(1, "b", "e", "R"), (1, "a", "e", "R")], "doc_id int, src string, dst string, name string")
    assert [(r["src"], r["idx"]) for r in text.assign_relations(links, placed).collect()] == [("b", 2)]


def test_standoff(spark, tmp_path):
    (tmp_path / "x.txt").write_text("Ann took the drug")
    (tmp_path / "x.ann").write_text("T1\tPer 0 3\tAnn\nT2\tDrug 9 12;13 17\tThe Drug\nR1\tTakes Arg1:T1 Arg2:T2\n#1\tnote\n")
    _, spans, found = text.read_standoff(spark, str(tmp_path))
    assert sorted((r["entity_id"], r["name"], r["start"], r["end"], r["value"]) for r in spans.collect()) == [("T1", "PER", 0, 3, "ann"), ("T2", "DRUG", 9, 17, "the drug")]
    assert [(r["name"], r["src"], r["dst"]) for r in found.collect()] == [("TAKES", "T1", "T2")]
    renamed = text.rename_and_exclude(spans, {"DRUG": "MEDICINE"}, {"PER"})
    assert [r["name"] for r in renamed.collect()] == ["MEDICINE"]


@pytest.mark.parametrize("tree,first,last,expected", [
    ("(S (NP the man) (VP eats))", 1, 1, "(S (NP the (ENT::e man)) (VP eats))"),
    ("(S (NP the man) (VP eats))", 0, 1, "(S (NP (ENT::e the man)) (VP eats))"),
    ("(S (NP the man) (VP eats))", 1, 2, "(S (NP the) (ENT::e man eats))"),
    ("(S (NP the (ENT::x man)) (VP eats))", 0, 1, "(S (NP (ENT::e the (ENT::x man))) (VP eats))"),
])
def test_insert_entity(tree, first, last, expected):
    assert to_bracket(text.insert_entity(from_bracket(tree), first, last, "e")) == expected


@given(st.integers(1, 8), st.data())
@settings(max_examples=40, deadline=None)
def test_insert_entity_keeps_words(n, data):
    words = [f"w{i}" for i in range(n)]
    cut = data.draw(st.integers(0, n))
    parts = [f"(A {' '.join(words[:cut])})" if cut else "", f"(B {' '.join(words[cut:])})" if cut < n else ""]
    tree = from_bracket(f"(S {' '.join(p for p in parts if p)})")
    first = data.draw(st.integers(0, n - 1))
    last = data.draw(st.integers(first, n - 1))
    found = text.insert_entity(tree, first, last, "e")
    assert sorted(found.leaves()) == sorted(words)
    assert [e.leaves() for e in found.entities()] == [words[first : last + 1]]


def test_parse_sentences(spark):
    rows = spark.createDataFrame(
        [(1, 0, "Ann takes aspirin", [("P", 0, 3), ("D", 10, 17), ("D", 10, 17)]), (1, 1, "nothing", []), (2, 0, None, None)],
        "doc_id int, idx int, sentence string, entities array<struct<name:string,start:int,end:int>>")
    found = text.parse_sentences(rows, lambda: text.flat_parser).collect()
    assert [(r["tree_id"], to_bracket(from_json(r["tree"]))) for r in found] == [("1/0", "(ROOT (ENT::P Ann) (ENT::D aspirin))")]
    more = text.extract_entities(rows, lambda: lambda s: [{"name": "N", "start": 0, "end": 1}] if s else [])
    assert [len(r["entities"]) for r in more.orderBy("doc_id", "idx").collect()] == [4, 1, 0]


def test_json_lines_and_instances(spark, tmp_path):
    from sylva.sinks import write_json_lines

    groups = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "name string, entities array<string>")
    relations = spark.createDataFrame([("ab", "a", "b")], "name string, left string, right string")
    nodes = rel.trees_as_nodes(lines.generate_instances(spark, groups, relations, 3))
    assert nodes.where("type = 'GROUP'").count() == 12 and nodes.where("type = 'REL'").count() == 3
    write_json_lines(nodes, str(tmp_path / "f"))
    back = trees_to_nodes(lines.read_json_lines(spark, str(tmp_path / "f")))
    assert back.count() == nodes.count()
    assert docs.sampled(groups.withColumn("g", F.lit(1)), "g", "name", 1).count() == 1
