import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva import model
from sylva.model import Node, from_bracket, from_json, reduce_all, split_label, to_bracket, to_json

NAMES = st.text("ABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=1, max_size=4)
WORDS = st.text(st.characters(min_codepoint=33, max_codepoint=126), min_size=1, max_size=6)


def entities(name=NAMES):
    return st.builds(lambda n, ws: Node(f"ENT::{n}", tuple(ws)), name, st.lists(WORDS, min_size=1, max_size=3))


def groups():
    return st.builds(
        lambda n, es: Node(f"GROUP::{n}", tuple({e.name: e for e in es}.values())), NAMES, st.lists(entities(), min_size=1, max_size=4))


def trees():
    relation = st.builds(lambda a, b: Node(f"REL::{a.name}<->{b.name}", (a, b)), groups(), groups())
    coll = st.builds(lambda g, k: Node(f"COLL::{g.name}", (g,) * k), groups(), st.integers(2, 3))
    base = st.one_of(entities(), groups(), relation, coll)
    inner = st.recursive(base, lambda s: st.builds(lambda n, c: Node(n, tuple(c)), NAMES, st.lists(s, min_size=1, max_size=4)), max_leaves=5)
    return st.builds(lambda c: Node("ROOT", tuple(c)), st.lists(inner, min_size=1, max_size=4))


@pytest.mark.parametrize("label,expected", [
    ("ENT::name", ("ENT", "name")), ("ENT", ("ENT", "")), ("GROUP::a::b", ("GROUP", "a::b")), ("OTHER::x", (None, "OTHER::x")), ("S", (None, "S"))])
def test_labels(label, expected):
    assert split_label(label) == expected
    assert model.make_label(*split_label(label)) == label


@given(trees())
@settings(max_examples=60, deadline=None)
def test_text_forms_round_trip(tree):
    assert from_bracket(to_bracket(tree)) == tree
    back = from_json(to_json(tree))
    assert back == tree and back.oid == tree.oid


@given(trees())
@settings(max_examples=60, deadline=None)
def test_reduce_leaves_no_single_child(tree):
    def one_by_one(t):
        for path, n in t.walk():
            if path and len(n.children) == 1 and n.type != "ENT":
                return one_by_one(t.put(path, list(n.children)))
        return t

    assert reduce_all(tree, frozenset({"ENT"})) == one_by_one(tree)


@pytest.mark.parametrize("text", ["", "(S", "S)", "(S x) y", "x", "((A b))"])
def test_broken_brackets(text):
    with pytest.raises(ValueError):
        from_bracket(text)


def test_measures():
    t = from_bracket("(S (X (ENT::person Alice) (ENT::fruit red%20apple)) (ENT::person Bob))")
    assert t.leaves() == ["Alice", "red apple", "Bob"]
    assert t.height() == 4 and t.at((0, 1)).label == "ENT::fruit"
    assert t.entity_labels() == {"person", "fruit"} and t.has_duplicate_entity()
    assert t.without((0, 0)).leaves() == ["red apple", "Bob"]
    assert t.without((0, 1)).without((0, 0)) == from_bracket("(S (ENT::person Bob))")
    assert model.merge(t, Node("ROOT", ("x",))).children[1] == "x"


def test_group_instances():
    t = from_bracket("(S (GROUP::A (ENT::x 1) (ENT::y 2 3)) (GROUP::A (ENT::x 1) (ENT::y 2 3)) (GROUP::A (ENT::x 4)))")
    assert t.group_instances("A") == [{"x": "1", "y": "2 3"}, {"x": "4"}]


def test_rows_round_trip(spark):
    texts = ["(S (GROUP::A (ENT::x 1) (ENT::y 2 3)) z)", "(ROOT (REL::a<->b (GROUP::a (ENT::k v)) (GROUP::b (ENT::k w))))"]
    data = [(str(i), to_json(from_bracket(t))) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(data, model.TREE_SCHEMA)
    nodes = model.trees_to_nodes(frame)
    back = {r["tree_id"]: from_json(r["tree"]) for r in model.nodes_to_trees(nodes.repartition(3)).collect()}
    assert {i: to_bracket(t) for i, t in back.items()} == {str(i): t for i, t in enumerate(texts)}


def test_edits_by_place_and_relations_between_nodes():
    from sylva.model import has_type, is_part_of

    t = from_bracket("(log (ENT::day 3) (GROUP::ship (ENT::name Ann) (ENT::flag de nl)) word)")
    assert [t.leaf_position(k) for k in range(5)] == [(0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1), (2,)]
    with pytest.raises(IndexError):
        t.leaf_position(5)
    rest, gone = t.pop(1)
    assert gone.label == "GROUP::ship" and to_bracket(rest) == "(log (ENT::day 3) word)"
    assert to_bracket(rest.insert(1, "new").extend("last")) == "(log (ENT::day 3) new word last)"
    assert t.part(1) == t.children[1:] and t.clear().children == ()
    assert has_type(gone, "GROUP") and not has_type(gone, "ENT") and has_type(gone) and not has_type("word") and not has_type(t)
    assert is_part_of(gone, t) and not is_part_of(t, t) and not is_part_of(gone, rest)
