"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within ``2 * half`` bits share a variant within ``half`` bits of each. Every distinct fingerprint
therefore stands for all its variants, and whatever meets in a variant is linked: both ends are within ``half`` bits of
it, so within ``2 * half`` of each other. A variant with m fingerprints needs m - 1 links (all to its smallest), never
all pairs.

The variants are shuffled by their leading bits: a fingerprint is sent once for each leading pattern that its variants
have (some tens of rows instead of 2,081), and the trailing bits are varied where the pattern's rows meet. A pattern
whose rows have too many variants is dealt again by more leading bits, down to whole variants, so no task holds a hot ball.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm import nearcopies
from sylva.llm.common import connected_components, sliced, stored

SEED, WORDS, BITS, HALF = 42, 4, 64, 2
#: Fingerprints whose own leading bits fall in one pattern, on average; and variants that a pattern's rows may stand for
#: before it is dealt again (some 50 bytes each in the task that sorts them).
PER_PATTERN, HOT_VARIANTS = 256, 2_000_000
STEP = 8


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text as an unsigned integer; texts without words (also null) have 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = memoryview(b" ".join(words)), np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(BITS, dtype=np.int64), len(words) - WORDS + 1
    for k in range(0, total, 65_536):
        cuts = zip(starts[k : min(k + 65_536, total)].tolist(), ends[k + WORDS - 1 : k + WORDS - 1 + 65_536].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cuts], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and the signed 64-bit pattern of its fingerprint, for every row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for part in sliced([batch]) for t in part.column("text").to_pylist()]
            own = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), own], names=["doc_id", "fp"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, flips: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _leading(fp: Column, bits: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - bits) if bits < BITS else fp


def _deal(rows: DataFrame, had: int, bits: int) -> DataFrame:
    """(fp, pattern of ``had`` bits) -> a row for each pattern of ``bits`` leading bits that a variant of it has."""
    added = bits - had
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in _masks(added, HALF)])
    used = F.bit_count(_leading(F.col("fp"), had).bitwiseXOR(F.col("pattern"))) if had else F.lit(0)
    own = F.shiftleft(F.col("pattern"), added) if had else F.lit(0).cast("long")
    low = _leading(F.col("fp"), bits).bitwiseAND(F.lit(_signed((1 << added) - 1)))
    return rows.select(
        "fp", own.alias("own"), low.alias("low"),
        F.explode(F.filter(masks, lambda m: F.bit_count(m) <= F.lit(HALF) - used)).alias("flip"),
    ).select("fp", F.col("own").bitwiseOR(F.col("low").bitwiseXOR(F.col("flip"))).alias("pattern"))


def _meet(bits: int):
    """Vary the trailing bits of one pattern's fingerprints and link all that meet to the smallest that they meet."""
    low = BITS - bits
    masks = {k: np.array(_masks(low, k), dtype=np.uint64) for k in range(HALF + 1)}

    def run(rows: pa.Table) -> pa.Table:
        fps = np.unique(rows.column("fp").to_numpy().view(np.uint64))
        pattern = np.uint64(rows.column("pattern")[0].as_py() & (2**64 - 1))
        trailing = fps & np.uint64((1 << low) - 1)
        used = np.bitwise_count((fps >> np.uint64(low)) ^ pattern)
        variants, owners = [], []
        for k in range(HALF + 1):
            at = np.flatnonzero(used == k)
            if len(at):
                m = masks[HALF - k]
                variants.append((trailing[at][:, None] ^ m[None, :]).ravel())
                owners.append(np.repeat(at, len(m)))
        a = b = np.zeros(0, dtype=np.uint64)
        if len(fps) > 1:
            values, who = np.concatenate(variants), np.concatenate(owners)
            order = np.argsort(values)
            values, who = values[order], who[order]
            new = np.concatenate(([True], values[1:] != values[:-1]))
            starts = np.flatnonzero(new)
            least = np.minimum.reduceat(who, starts)
            first = np.repeat(least, np.diff(np.append(starts, len(values))))
            pairs = np.unique(np.stack([first, who], axis=1)[first != who], axis=0)
            a, b = fps[pairs[:, 0]], fps[pairs[:, 1]]
            near = np.bitwise_count(a ^ b) <= 2 * HALF
            a, b = a[near], b[near]
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def _variants(bits: int) -> Column:
    """Variants of the trailing bits that a row of a pattern of ``bits`` leading bits stands for."""
    used = F.bit_count(_leading(F.col("fp"), bits).bitwiseXOR(F.col("pattern")))
    counts = [sum(math.comb(BITS - bits, k) for k in range(left + 1)) for left in range(HALF, -1, -1)]
    return F.element_at(F.array(*[F.lit(c) for c in counts]), used + 1).cast("long")


def ball_links(distinct: DataFrame, bits: int | None = None, hot: int = HOT_VARIANTS) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct(fp long)`` that connect all pairs within ``2 * HALF`` bits.

    Each link is verified; pairs meeting in one variant are linked through the variant's smallest fingerprint. A task
    holds the variants of one pattern at a time, ``hot`` at most: patterns beyond it are dealt again by more bits.
    """
    if bits is None:
        bits = min(40, max(4, math.ceil(math.log2(max(1, distinct.count()) / PER_PATTERN + 1))))
    links, rows, had = None, _deal(distinct.select("fp", F.lit(0).cast("long").alias("pattern")), 0, bits), bits
    while True:
        sizes = rows.groupBy("pattern").agg(F.sum(_variants(had)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        calm = rows if most <= hot else rows.join(sizes.where(F.col("n") <= hot), "pattern").select("fp", "pattern")
        found = calm.groupBy("pattern").applyInArrow(_meet(had), "a long, b long")
        links = found if links is None else links.union(found)
        if most <= hot:
            break
        busy = stored(rows.join(sizes.where(F.col("n") > hot), "pattern").select("fp", "pattern"), "busy")
        if had + STEP >= BITS:
            whole = _deal(busy, had, BITS)
            least = whole.groupBy("pattern").agg(F.min("fp").alias("a"))
            links = links.union(
                whole.join(least, "pattern").where("a <> fp").select("a", F.col("fp").alias("b"))
                .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * HALF)
            )
            break
        rows, had = _deal(busy, had, had + STEP), had + STEP
    return links.distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``documents``.

    Documents whose fingerprints differ in 4 bits or fewer are linked; a component's id is its smallest doc_id. Null
    and blank texts have fingerprint zero and are linked like any other; a null doc_id keeps its row and takes the id of
    its component (null if the component has no other id); repeated rows each keep their row; an empty table gives an
    empty result.
    """
    prints = stored(fingerprints(documents), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = connected_components(ball_links(distinct.select("fp")))
    linked = distinct.join(parts, distinct["fp"] == parts["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = linked.join(ids, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of ``documents`` of each group of near copies: that with the smallest doc_id, all columns as they are.

    Near copies share four fifths of their 5-word shingles (see ``nearcopies``). A null doc_id comes after all others;
    of different texts under one doc_id in a group the one with the smallest hash stays. Null and blank texts are copies
    of each other. An empty table stays empty.
    """
    rows = stored(nearcopies.groups(documents), "near-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2"))
    r1, r2 = (f"{c}-{uuid.uuid4().hex}" for c in ("r1", "r2"))
    keep = rows.groupBy("group").agg(first.alias("m")).select(F.col("m.r1").alias(r1), F.col("m.r2").alias(r2))
    one, two = nearcopies.row_hashes(documents)
    named = documents.withColumn(r1, one).withColumn(r2, two).join(keep, [r1, r2], "left_semi")
    if rows.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").take(1):
        named = named.dropDuplicates([r1, r2])  # rows are dealt by these already
    return named.drop(r1, r2)
