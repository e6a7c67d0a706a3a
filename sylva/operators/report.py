"""A forest before and after rewriting, as a table of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators import cluster, forest, quality, schema

REDUNDANCY_TAUS = (1.0, 0.7, 0.5)


def schema_metrics(own: schema.Schema) -> dict[str, float]:
    return {
        "productions": len(own.productions), "groups": len(own.groups), "relations": len({r.name for r in own.relations}),
        "entities": len(own.entities), "group_overlap": own.group_overlap(), "group_balance": own.group_balance(),
    }


def redundancy(nodes: DataFrame, own: schema.Schema, tau: float) -> float | None:
    """Mean redundancy of the groups' tables; None where no group has two attributes or more."""
    scores = [quality.redundancy(table, tau).first()[0] for name, table in schema.datasets(nodes, own).items() if len(own.groups[name]) >= 2]
    return sum(scores) / len(scores) if scores else None


def compare(source: DataFrame, current: DataFrame, taus: tuple[float, ...] = REDUNDANCY_TAUS, clustering: bool = True) -> dict[str, float | None]:
    """Metrics of ``current`` against ``source``: coverage, agreement of clusterings, grammar, labels and redundancy."""
    before, after = schema.infer(source), schema.infer(current)
    out: dict[str, float | None] = {f"{k}_before": v for k, v in schema_metrics(before).items()} | schema_metrics(after)
    out["ratio_productions"] = len(after.productions) / len(before.productions) if before.productions else 0.0
    out["coverage"] = quality.coverage(source.where("type = 'ENT'"), current.where("type = 'ENT'")).first()[0]
    for suffix, nodes in (("_before", source), ("", current)):
        for r in quality.type_statistics(nodes).collect():
            kind = (r["type"] or "untyped").lower()
            out |= {f"{kind}_nodes{suffix}": r["n_nodes"], f"{kind}_labels{suffix}": r["n_labels"], f"{kind}_ratio{suffix}": r["ratio"]}
    if clustering:
        a = cluster.entity_clusters(source, cluster.clusters(source))
        b = cluster.entity_clusters(current, cluster.clusters(current))
        table = quality.contingency(a, b)
        out["cluster_ami"] = quality.adjusted_mutual_information(table).first()[0]
        out["cluster_completeness"] = (quality.completeness(table).first() or [None])[0]
    for tau in taus:
        out[f"redundancy_{tau:g}"] = redundancy(current, after, tau)
    return out


def compare_valid(source: DataFrame, current: DataFrame, own: schema.Schema, **settings) -> dict[str, float | None]:
    return compare(source, schema.valid_trees(current, own), **settings)


def as_table(spark, metrics: dict[str, float | None]) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in metrics.items()], "metric string, value double")


def inspection(nodes: DataFrame) -> DataFrame:
    """What an inspection shows: one row of totals, and the tallest tree's id."""
    return forest.inspect(nodes).join(forest.tallest(nodes).select(F.col("tree_id").alias("tallest_tree")))


def log(metrics: dict[str, float | None], record, step: int | None = None) -> int:
    """Hand the metrics that have a value to ``record(name, value, step)`` of a tracking tool; their number."""
    known = {k: float(v) for k, v in metrics.items() if v is not None}
    for name, value in sorted(known.items()):
        record(name, value, step)
    return len(known)
