"""Column functions: labels, identifiers, typed values, and similarity of label sets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPED = "^(ENT|GROUP|REL|COLL)(::|$)"


def label_type(label: Column) -> Column:
    return F.when(label.rlike(_TYPED), F.substring_index(label, "::", 1))


def label_name(label: Column) -> Column:
    return F.when(label.rlike(_TYPED), F.regexp_replace(label, "^[A-Z]+(::)?", "")).otherwise(label)


def label_of(type_: Column, name: Column) -> Column:
    return F.when(type_.isNull(), name).when(F.coalesce(name, F.lit("")) == "", type_).otherwise(F.concat(type_, F.lit("::"), name))


def uuid5(namespace: Column, text: Column) -> Column:
    """Name-based UUID of ``text`` under a UUID given as a string."""
    digest = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(text, "UTF-8")))

    def form(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
        return F.concat(
            F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
            variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
        )

    return F.transform(F.array(digest), form)[0]  # the digest is used six times and made once


def record_oid(namespace: str, table: str, key: dict[str, Column]) -> Column:
    """Deterministic id of a record: the order of the key's columns does not matter, null parts read ``None``."""
    inner = F.lit(str(uuid.uuid5(uuid.UUID(namespace), table)))
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(key[k].cast("string"), F.lit("None"))) for k in sorted(key)]
    return uuid5(inner, F.concat_ws(";", *parts))


def typed_value(value: Column) -> Column:
    """Kind of a textual value by trial: boolean, integer, float, string."""
    v = F.trim(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.lower(v).isin("true", "false"), F.lit("boolean"))
        .when(v.rlike(r"^[+-]?\d+(_\d+)*$"), F.lit("integer"))
        .when(v.rlike(r"(?i)^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+)?$|(?i)^[+-]?(nan|inf|infinity)$"), F.lit("float"))
        .otherwise(F.lit("string"))
    )


# --- similarity of label sets: both sides are sorted arrays without repeats ---------------------------------------------


def jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def dice(x: Column, y: Column) -> Column:
    """Normalised indel ratio: on sorted sets the longest common subsequence is the intersection."""
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(x, y)) / total)


def jaro_winkler(x: Column, y: Column, weight: float = 0.1, boost_from: float = 0.7) -> Column:
    """Jaro-Winkler over tokens. Sorted sets have no transpositions, so matches are common tokens within the window."""
    nx, ny = F.size(x), F.size(y)
    window = F.greatest(F.floor(F.greatest(nx, ny) / 2).cast("int") - 1, F.lit(0))
    common = F.filter(x, lambda t: F.array_contains(y, t) & (
        F.abs(F.array_position(x, t) - F.array_position(y, t)) <= window))
    m = F.size(common)
    jaro = F.when((nx == 0) & (ny == 0), F.lit(1.0)).when(m == 0, F.lit(0.0)).otherwise((m / nx + m / ny + 1) / 3)
    prefix = F.size(F.filter(
        F.sequence(F.lit(1), F.lit(4)),
        lambda i: (i <= nx) & (i <= ny) & (F.slice(x, 1, i) == F.slice(y, 1, i)),
    ))
    return F.when(jaro > boost_from, jaro + prefix * weight * (1 - jaro)).otherwise(jaro)


METRICS = {"jaccard": jaccard, "levenshtein": dice, "jaro": jaro_winkler}


def context_similarity(x: Column, y: Column, metric=jaro_winkler, decay: float = 2.0, depth: int = 5) -> Column:
    """Similarity of two subtrees from their context arrays, innermost first.

    A context entry is ``struct(oid, label, typed, labels)``. 0 if the subtrees' own entity labels are disjoint, 1 if the
    subtrees are one node or have one typed label; else the decaying mean over both chains of ancestors.
    """
    if decay <= 0:
        raise ValueError("decay must be above 0")
    n = F.least(F.size(x), F.size(y), F.lit(depth))

    def same(a: Column, b: Column) -> Column:
        return (a["oid"] == b["oid"]) | (a["typed"] & b["typed"] & (a["label"] == b["label"]))

    levels = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.pow(F.lit(float(decay)), -i).alias("w"),
            F.when(same(F.get(x, i), F.get(y, i)), F.lit(1.0)).otherwise(metric(F.get(x, i)["labels"], F.get(y, i)["labels"])).alias("s"),
        ),
    )
    total = F.aggregate(levels, F.lit(0.0), lambda a, v: a + v["w"] * v["s"])
    weight = F.aggregate(levels, F.lit(0.0), lambda a, v: a + v["w"])
    own_x, own_y = F.get(x, F.lit(0)), F.get(y, F.lit(0))
    return (
        F.when(~F.arrays_overlap(own_x["labels"], own_y["labels"]), F.lit(0.0))
        .when(same(own_x, own_y), F.lit(1.0))
        .otherwise(F.least(F.greatest(total / weight, F.lit(0.0)), F.lit(1.0)))
    )


def label_sets_similarity(metric: str):
    """The plain Python form of a metric over two sets, for logic within one tree."""

    def value(a: frozenset[str], b: frozenset[str]) -> float:
        x, y = sorted(a), sorted(b)
        shared = a & b
        if metric == "jaccard":
            return len(shared) / len(a | b) if a | b else 1.0
        if metric == "levenshtein":
            return 2 * len(shared) / (len(x) + len(y)) if x or y else 1.0
        if not x and not y:
            return 1.0
        window = max(max(len(x), len(y)) // 2 - 1, 0)
        m = sum(abs(x.index(t) - y.index(t)) <= window for t in shared)
        jaro = (m / len(x) + m / len(y) + 1) / 3 if m else 0.0
        prefix = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        return jaro + min(prefix, 4) * 0.1 * (1 - jaro) if jaro > 0.7 else jaro

    return value
