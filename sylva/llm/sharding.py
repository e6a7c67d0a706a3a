"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn one level after the other.

Every child of a node draws ``-ln(u) / weight`` from a hash of the row's key and the child's name; the smallest draw
wins. A draw depends on nothing but key, child and weight, so when weights change rows leave or enter only the subtrees
whose weights changed. Growing by one shard opens a new region, or a new rack or slot in the last one; a shard that opens
a region (as the 25th does in the standard layout) takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RACK_SHARDS, REGION_RACKS = 4, 2
#: Rows of a shard are numbered in this many independent runs, so no task ever sorts a whole shard.
SLOT_RUNS = 1024
#: Copies of one row that are put out at a time.
COPIES = 65_536


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def standard_tree(shards: int) -> list[Leaf]:
    """Shards of equal weight, four to a rack and two racks to a region."""
    return [Leaf(s // (RACK_SHARDS * REGION_RACKS), s // RACK_SHARDS, s) for s in range(shards)]


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 11)
    return -F.ln((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))) / F.lit(float(weight))


def _lightest(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct(_draw(key, level, c, w).alias("d"), F.lit(c).alias("c")) for c, w in sorted(weights.items())]
    return F.array_min(F.array(*draws))["c"]


def _chosen(at: Column, level: str, key: Column, children: dict[int, dict[int, float]]) -> Column:
    cases = None
    for parent, weights in sorted(children.items()):
        pick = _lightest(key, level, weights)
        cases = F.when(at == parent, pick) if cases is None else cases.when(at == parent, pick)
    return cases


def assign(df: DataFrame, key: str, tree: list[Leaf], out: str) -> DataFrame:
    """``df`` with the drawn shard in column ``out``.

    A null key is a key of its own (all null keys meet in one shard); equal keys always meet. The tree is a parameter
    and part of the plan, meant for up to a few hundred shards. Existing columns, ``out`` apart, stay as they are.
    """
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    for leaf in tree:
        regions[leaf.region] = regions.get(leaf.region, 0.0) + leaf.weight
        inner = racks.setdefault(leaf.region, {})
        inner[leaf.rack] = inner.get(leaf.rack, 0.0) + leaf.weight
        shards.setdefault(leaf.rack, {})[leaf.shard] = leaf.weight
    region, rack, k = f"__{out}_region", f"__{out}_rack", F.col(f"`{key}`")
    return (
        df.withColumn(region, _lightest(k, "region", regions))
        .withColumn(rack, _chosen(F.col(region), "rack", k, racks))
        .withColumn(out, _chosen(F.col(rack), "shard", k, shards).cast("int"))
        .drop(region, rack)
    )


def number_rows(rows: DataFrame, group: str, out: str, groups: int) -> DataFrame:
    """``rows`` with a gapless number from 0 within each ``group``, in column ``out``; other columns are kept.

    Equal rows are counted before anything is shuffled, and only the counts are numbered. Distinct rows of a group are
    dealt by a hash of all their columns into ``SLOT_RUNS`` runs; a run is numbered in one window, and its start is the
    sum of the counts before it. The table of starts has at most groups x SLOT_RUNS rows and is broadcast under that
    bound. So neither a large group nor a row that is repeated without end meets in one task; the copies of a row are
    put out again ``COPIES`` at a time.
    """
    from pyspark.sql import Window

    if groups * SLOT_RUNS > 4_000_000:
        raise ValueError("too many groups to number with broadcast starts")
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    runs = counted.withColumn("__run", F.pmod(F.xxhash64(F.lit("run"), *columns), F.lit(SLOT_RUNS)).cast("int"))
    before = Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy(group, "__run").agg(F.sum("__n").alias("__of")).select(
        group, "__run", F.coalesce(F.sum("__of").over(before), F.lit(0)).alias("__start")
    )
    within = Window.partitionBy(group, "__run").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(F.broadcast(starts), [group, "__run"])
    first = F.col("__start") + F.col("__before")
    last = first + F.col("__n") - 1
    step = F.lit(COPIES).cast("long")
    return (
        placed.select(*columns, last.alias("__last"), F.explode(F.sequence(first, last, step)).alias("__from"))
        .select(*columns, F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + COPIES - 1, F.col("__last")))).alias(out))
    )


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Every document with its shard, its slot there, and its shard were there one more.

    Null or empty texts have size 8 and checksum 0; repeated rows are all kept, in the same shard with slots of their
    own; an empty table gives an empty result; other columns of the input are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = assign(assign(rows, "doc_id", standard_tree(shards), "shard"), "doc_id", standard_tree(shards + 1), "grown_shard")
    return number_rows(rows, "shard", "slot", shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
