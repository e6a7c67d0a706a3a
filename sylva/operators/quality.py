"""Quality measures: functional dependencies, redundancy, coverage and agreement of clusterings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence(df: DataFrame, column: str) -> DataFrame:
    """One row: how well all other columns determine ``column``; nulls are values; 0 without other columns or rows.

    Rows are counted per combination, the largest count per determinant is kept: two aggregates, no self-join.
    """
    others = [c for c in df.columns if c != column]
    if not others or column not in df.columns:
        return df.sparkSession.createDataFrame([(0.0,)], "confidence double")
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    best = counts.groupBy(*others).agg(F.max("__n").alias("__m"), F.sum("__n").alias("__t"))
    return best.agg(F.coalesce(F.sum("__m") / F.sum("__t"), F.lit(0.0)).alias("confidence"))


def dependency_score(df: DataFrame, attributes: list[str]) -> DataFrame:
    """One row: the largest confidence of an attribute given the other ones, over one shared count."""
    attributes = [a for a in attributes if a in df.columns]
    if len(attributes) < 2:
        return df.sparkSession.createDataFrame([(0.0,)], "score double")
    counts = df.groupBy(*attributes).agg(F.count("*").alias("__n"))
    parts = []
    for a in attributes:
        best = counts.groupBy(*[x for x in attributes if x != a]).agg(F.max("__n").alias("m"), F.sum("__n").alias("t"))
        parts.append(best.agg(F.coalesce(F.sum("m") / F.sum("t"), F.lit(0.0)).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.agg(F.max("score").alias("score"))


#: Attribute sets that one pass over the counts scores.
SETS_PER_PASS = 64


def _scored(counts: DataFrame, columns: list[str], sets: list[frozenset[str]]) -> dict[frozenset[str], tuple[float, bool]]:
    """Per attribute set its dependency score, and whether some combination without a null stands in several rows."""
    out = {}
    present = [(F.shiftright(F.col("__g").cast("long"), len(columns) - 1 - i).bitwiseAND(1) == 0) for i in range(len(columns))]
    for k in range(0, len(sets), SETS_PER_PASS):
        chunk = sets[k : k + SETS_PER_PASS]
        grouped = counts.groupingSets([[F.col(c) for c in columns if c in own] for own in chunk], *columns).agg(
            F.sum("__n").alias("__s"), F.grouping_id().alias("__g"))
        null_in = F.lit(False)
        for c, there in zip(columns, present, strict=True):
            null_in = null_in | (there & F.col(c).isNull())
        # One row per attribute of the set: the combination of the others determines it.
        parts = [
            F.when(there, F.struct(F.lit(i).alias("a"), F.struct(*[
                (F.lit(None).cast(counts.schema[c].dataType) if c == own else F.col(c)).alias(f"v{j}") for j, c in enumerate(columns)
            ]).alias("rest")))
            for i, (own, there) in enumerate(zip(columns, present, strict=True))
        ]
        rows = grouped.select("__g", "__s", F.when(~null_in, F.col("__s")).alias("__r"), F.explode(F.array_compact(F.array(*parts))).alias("p"))
        best = rows.groupBy("__g", "p.a", "p.rest").agg(F.max("__s").alias("m"), F.sum("__s").alias("t"), F.max("__r").alias("r"))
        found = best.groupBy("__g", "a").agg((F.sum("m") / F.sum("t")).alias("c"), F.max("r").alias("r")).groupBy("__g").agg(
            F.max("c").alias("c"), F.max("r").alias("r"))
        for r in found.collect():  # one row per set
            own = frozenset(c for i, c in enumerate(columns) if not r["__g"] >> (len(columns) - 1 - i) & 1)
            out[own] = (r["c"], (r["r"] or 0) > 1)
    return out


def redundancy(df: DataFrame, tau: float = 1.0, null_threshold: float = 0.8) -> DataFrame:
    """One row: the share of rows that repeat another row on a set of attributes which depend on each other.

    All sets of two attributes or more count whose dependency score is at least ``tau``; a row is flagged if it has no
    null on the set and another row agrees with it there. Sets are tried level by level. Scores only rise with more
    attributes and repeats only vanish, so a set that counts makes its supersets needless, and one without repeats can
    flag nothing, nor can its supersets: both are left out of the next level, at any number of attributes and without
    another result. Rows are counted per combination once; a level scores its sets by grouping sets over these counts.
    """
    nulls = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    if not nulls["__n"]:
        return df.sparkSession.createDataFrame([(0.0,)], "redundancy double")
    columns = [c for c in df.columns if nulls[c] / nulls["__n"] <= null_threshold]
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([(0.0,)], "redundancy double")
    counts = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    level = [frozenset(p) for p in combinations(columns, 2)]
    kept: list[frozenset[str]] = []
    while level:
        scores = _scored(counts, columns, level)
        kept += [s for s in level if scores[s][1] and scores[s][0] >= tau - 1e-12]
        open_sets = {s for s in level if scores[s][1] and scores[s][0] < tau - 1e-12}
        wider = {s | {c} for s in open_sets for c in columns if c not in s}
        level = sorted((s for s in wider if all(s - {c} in open_sets for c in s)), key=sorted)
    flag = F.lit(False)
    for own in kept:
        whole = F.lit(True)
        for c in own:
            whole = whole & F.col(c).isNotNull()
        flag = flag | (whole & (F.sum("__n").over(Window.partitionBy(*sorted(own))) > 1))
    flagged = counts.withColumn("__f", flag)
    return flagged.agg((F.sum(F.when(F.col("__f"), F.col("__n")).otherwise(0)) / F.sum("__n")).alias("redundancy"))


def coverage(source: DataFrame, current: DataFrame, oid: str = "oid") -> DataFrame:
    """One row: Jaccard index of two sets of entity ids; 1 for two empty sets."""
    a = source.select(F.col(oid).alias("oid")).distinct().withColumn("a", F.lit(1))
    b = current.select(F.col(oid).alias("oid")).distinct().withColumn("b", F.lit(1))
    both = a.join(b, "oid", "full")
    return both.agg(F.coalesce(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("coverage"))


def contingency(source: DataFrame, current: DataFrame) -> DataFrame:
    """Counts of (source cluster, current cluster) over ``(oid, cluster)`` tables; a missing entity is a cluster of its own."""
    a = source.select("oid", F.col("cluster").alias("x"))
    b = current.select("oid", F.col("cluster").alias("y"))
    joined = a.join(b, "oid", "full").select(
        F.when(F.col("x").isNull(), F.struct(F.lit(True).alias("alone"), F.col("oid").cast("string").alias("id"))).otherwise(F.struct(F.lit(False).alias("alone"), F.col("x").cast("string").alias("id"))).alias("x"),
        F.when(F.col("y").isNull(), F.struct(F.lit(True).alias("alone"), F.col("oid").cast("string").alias("id"))).otherwise(F.struct(F.lit(False).alias("alone"), F.col("y").cast("string").alias("id"))).alias("y"),
    )
    return joined.groupBy("x", "y").agg(F.count("*").alias("n"))


def completeness(table: DataFrame) -> DataFrame:
    """One row: 1 - H(current | source) / H(current) from a contingency table; 1 where there is one current cluster."""
    rows = table.select("x", "y", F.col("n").cast("double").alias("n"))
    total = rows.agg(F.sum("n").alias("t"))
    by_y, by_x = rows.groupBy("y").agg(F.sum("n").alias("ny")), rows.groupBy("x").agg(F.sum("n").alias("nx"))
    h = by_y.join(total).select((-F.col("ny") / F.col("t") * F.ln(F.col("ny") / F.col("t"))).alias("v")).agg(F.sum("v").alias("h"))
    c = rows.join(by_x, "x").join(total).select((-F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("nx"))).alias("v")).agg(F.sum("v").alias("c"))
    return h.join(c).select(F.when(F.col("h") < 1e-12, F.lit(1.0)).otherwise(1 - F.col("c") / F.col("h")).alias("completeness"))


def _log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series from x + 8 on, which is exact to some 1e-15."""
    z = x.cast("double") + 9
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = F.lit(1.0)
    for k in range(1, 9):
        product = product * (x.cast("double") + k)
    return series - F.ln(product)


def adjusted_mutual_information(table: DataFrame) -> DataFrame:
    """One row: AMI (arithmetic mean) from a contingency table; 1 for equal trivial clusterings and for no entities.

    The expected value depends only on how many clusters have which size, so its sums run over distinct pairs of sizes
    and the sizes of their overlap, as rows. An overlap's distribution is hypergeometric; beyond ``sqrt(30 min(a, b))``
    from its mean are at most 2 exp(-60) of it (Hoeffding), so only overlaps that near are summed.
    """
    rows = table.select("x", "y", F.col("n").cast("double").alias("n"))
    by_x, by_y = rows.groupBy("x").agg(F.sum("n").alias("nx")), rows.groupBy("y").agg(F.sum("n").alias("ny"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("t"))

    def entropy(sizes: DataFrame, n: str, name: str) -> DataFrame:
        return sizes.join(total).agg(
            F.coalesce(-F.sum(F.col(n) / F.col("t") * F.ln(F.col(n) / F.col("t"))), F.lit(0.0)).alias(f"h{name}"),
            F.count("*").alias(f"k{name}"))

    mi = rows.join(by_x, "x").join(by_y, "y").join(total).agg(F.coalesce(
        F.sum(F.col("n") / F.col("t") * F.ln(F.col("t") * F.col("n") / (F.col("nx") * F.col("ny")))), F.lit(0.0)).alias("mi"))
    sizes_x = by_x.groupBy(F.col("nx").alias("a")).agg(F.count("*").alias("ka"))
    sizes_y = by_y.groupBy(F.col("ny").alias("b")).agg(F.count("*").alias("kb"))
    a, b, t, k = F.col("a"), F.col("b"), F.col("t"), F.col("k")
    mean, reach = a * b / t, F.sqrt(30 * F.least(a, b)) + 1
    low = F.greatest(F.lit(1.0), a + b - t, F.floor(mean - reach)).cast("long")
    high = F.least(a, b, F.ceil(mean + reach)).cast("long")
    f = _log_factorial
    log_p = f(a) + f(b) + f(t - a) + f(t - b) - f(t) - f(k) - f(a - k) - f(b - k) - f(t - a - b + k)
    pairs = sizes_x.join(sizes_y).join(total).select("*", low.alias("low"), high.alias("high")).where("low <= high")  # pairs of sizes
    expected = pairs.withColumn("k", F.explode(F.sequence("low", "high"))).agg(F.coalesce(
        F.sum(F.col("ka") * F.col("kb") * k / t * F.ln(t * k / (a * b)) * F.exp(log_p)), F.lit(0.0)).alias("e"))
    parts = mi.join(expected).join(entropy(by_x, "nx", "x")).join(entropy(by_y, "ny", "y")).join(total)
    spread = (F.col("hx") + F.col("hy")) / 2 - F.col("e")
    trivial = ((F.col("kx") == 1) & (F.col("ky") == 1)) | ((F.col("kx") == F.col("t")) & (F.col("ky") == F.col("t")))
    return parts.select(
        F.when((F.col("t") == 0) | trivial | (F.abs(spread) < 1e-15), F.lit(1.0)).otherwise((F.col("mi") - F.col("e")) / spread).alias("ami"))


def type_statistics(nodes: DataFrame) -> DataFrame:
    """Per type (null: untyped) the nodes, distinct labels and nodes per label."""
    return nodes.where("kind = 'NODE'").groupBy("type").agg(
        F.count("*").alias("n_nodes"), F.countDistinct("label").alias("n_labels")
    ).withColumn("ratio", F.col("n_nodes") / F.col("n_labels"))


def report(source: DataFrame, current: DataFrame) -> DataFrame:
    """Counts before and after in one row: nodes, untyped nodes, labels, and coverage of entities."""
    def side(nodes: DataFrame, suffix: str) -> DataFrame:
        return nodes.where("kind = 'NODE'").agg(
            F.count("*").alias(f"nodes{suffix}"), F.count_if(F.col("type").isNull()).alias(f"unlabelled{suffix}"),
            F.countDistinct("label").alias(f"labels{suffix}"))

    ents = coverage(source.where("type = 'ENT'"), current.where("type = 'ENT'"))
    return side(source, "_before").join(side(current, "")).join(ents)


def by_nulls(df: DataFrame) -> DataFrame:
    """Rows with fewest nulls first, columns with fewest nulls first."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    columns = sorted(df.columns, key=lambda c: (counts[c], c))
    amount = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.orderBy(amount, *[F.col(c).asc_nulls_last() for c in columns]).select(*columns)
