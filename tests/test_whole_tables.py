"""Queries over small tables of which every row counts, held against counting by hand."""

from datetime import datetime

import pytest

from sylva.operators import simplify
from sylva.plans import catalog
from sylva.sources import documents as docs


@pytest.fixture(scope="module")
def late_events(spark, tmp_path_factory):
    """Five events, the ids of all but one far beyond the first few hundred."""
    folder = str(tmp_path_factory.mktemp("late"))
    rows = [(i, datetime(2024, 1, 1), k, "view", float(k)) for k, i in enumerate((1, 400, 401, 5_000, 10**9))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def test_every_event_is_clustered(spark, late_events):
    found = catalog.queries()["subtree_clusters"](spark, late_events).collect()
    assert sum(r["members"] for r in found) == 3 * 5  # the root, who and what of each event


def test_every_event_is_rewritten(spark, late_events):
    counts = {r["name"]: r["count"] for r in catalog.queries()["rewrite_fixed_point"](spark, late_events).collect() if r["type"] == "ENT"}
    assert counts == dict.fromkeys(("user_id", "event_type", "value", "ts"), 5)


def test_rewriting_that_never_settles_is_an_error(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": 1, "c": 2}}')], "i long, json string")
    trees = docs.read_documents(rows, "i", "json", "event", raw=True)
    with pytest.raises(RuntimeError, match="circles"):
        simplify.simplify(trees, epochs=None, operations=[("same", lambda t, k, s: (t, True))])


def test_every_part_has_its_label(spark, tmp_path):
    rows = [("a", "x", 1), ("a", "y", 40), ("b", "x", 2), ("b", "z", 50)]
    spark.createDataFrame(rows, "p_brand string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = {m: catalog.queries()[f"label_similarity_{m}"](spark, str(tmp_path)).first()["similarity"] for m in ("jaccard", "dice")}
    assert found == {"jaccard": round(1 / 3, 9), "dice": 0.5}  # both are 1 among the small parts


def test_every_customer_has_its_segment(spark, tmp_path):
    rows = [(1, "x", 9500.0), (1, "y", 5.0), (2, "x", 9510.0)]
    spark.createDataFrame(rows, "c_nationkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert catalog.queries()["group_overlap"](spark, str(tmp_path)).first()[0] == 0.5
    assert catalog.queries()["group_balance"](spark, str(tmp_path)).first()[0] == round(1 - 0.5 / 1.5, 9)
