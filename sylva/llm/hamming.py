"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, and each segment is an index key. Two codes at distance d agree in some segment up
to d // segments bits; so once all segments were probed up to radius s, every code within segments x (s + 1) - 1 bits was
seen and verified. The radius grows round by round, and a query leaves as soon as its kth verified distance is covered:
the answer is exact. Equal codes are one index row, with the k + 1 smallest ids that any query can return of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import stored

BITS, TOP, QUERY_STEP = 64, 10, 100
#: Shares of a query's candidates that are ranked apart before they meet, so that no query is one task's alone.
SALTS = 16


def sign_code(vector: Column) -> Column:
    """Bit i (from 0) is whether component i is above zero; null where one of the first 64 is missing."""
    code = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.when(F.get(vector, F.lit(i)) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        code = code.bitwiseOR(F.shiftleft(bit, i))
    whole = (F.size(vector) >= BITS) & ~F.exists(F.slice(vector, 1, BITS), lambda v: v.isNull())
    return F.when(whole, code)


def segment_widths(codes: int) -> list[int]:
    """Widths of segments of about log2(codes) - 2.5 bits, so that a bucket holds about six codes.

    Wider segments would have emptier buckets, but the probes of one more bit of radius grow faster than that saves.
    """
    parts = min(10, max(2, round(BITS / max(6.0, math.log2(max(codes, 2)) - 2.5))))
    return [BITS // parts + (i < BITS % parts) for i in range(parts)]


def _values(code: Column, widths: list[int]) -> list[Column]:
    out, low = [], 0
    for w in widths:
        out.append(F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << w) - 1)))
        low += w
    return out


def _probes(active: DataFrame, widths: list[int], radius: int) -> DataFrame:
    """(query_id, query, bound, segment, value) for every value that differs from a query's segment in ``radius`` bits.

    The bits to flip are drawn one after the other in rising order, so no table of masks is sent around.
    """
    segments = F.array(*[
        F.struct(F.lit(s).alias("segment"), F.lit(w).alias("width"), v.alias("value"))
        for s, (w, v) in enumerate(zip(widths, _values(F.col("query"), widths), strict=True)) if radius <= w
    ])
    rows = active.select("query_id", "query", "bound", F.explode(segments).alias("s"), F.lit(-1).alias("bit")).select(
        "query_id", "query", "bound", "s.*", "bit"
    )
    for left in range(radius - 1, -1, -1):
        rows = rows.withColumn("bit", F.explode(F.sequence(F.col("bit") + 1, F.col("width") - (left + 1)))).withColumn(
            "value", F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))
        )
    return rows.select("query_id", "query", "bound", "segment", "value")


def _nearest(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` nearest rows of each query with their rank: first of each of its ``SALTS`` shares, then of all."""
    order = ("distance", "vec_id")
    share = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy(*order)
    whole = Window.partitionBy("query_id").orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)


def search(codes: DataFrame, top: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """The ``top`` nearest of each query among ``codes(vec_id, code)``: query_id, rank from 1, vec_id, distance.

    Queries are the rows whose vec_id is divisible by ``step``; their own vec_id is no candidate; ties go to the smaller
    vec_id. Rows with a null take no part; repeated rows count once; with fewer candidates than ``top`` all are given.
    """
    spark = codes.sparkSession
    rows = stored(codes.select("vec_id", "code").dropna().distinct(), "codes")
    queries = rows.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
    # Spark limits each code's rows to the smallest ids before it shuffles them.
    by_code = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    members = stored(rows.withColumn("n", by_code).where(F.col("n") <= top + 1).drop("n"), "code-members")
    distinct = members.select("code").distinct()
    widths = segment_widths(distinct.count())
    index = stored(
        distinct.select("code", F.posexplode(F.array(*_values(F.col("code"), widths))).alias("segment", "value")), "code-index"
    )
    active = stored(queries.withColumn("bound", F.lit(BITS)), "code-queries")
    best = spark.createDataFrame([], "query_id long, vec_id long, distance int")
    finished = best
    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    for radius in range(max(widths) + 1):
        probes = _probes(active, widths, radius)
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        # The planner takes the probes for as small as the queries that they come from, and would broadcast them.
        met = probes.join(index.hint("merge"), ["segment", "value"]).where(distance <= F.col("bound"))
        found = met.select("query_id", "code", distance.alias("distance")).distinct()
        seen = found.join(members.hint("merge"), "code").where("vec_id <> query_id").select("query_id", "vec_id", "distance")
        best = stored(
            _nearest(best.union(seen).distinct(), top).drop("rank"), "code-best"
        )
        covered = len(widths) * (radius + 1) - 1
        state = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        judged = active.drop("bound").join(state, "query_id", "left").withColumn(
            "done", F.coalesce((F.col("n") >= top) & (F.col("kth") <= covered), F.lit(False))
        )
        last = radius == max(widths)
        judged = stored(judged.withColumn("done", F.lit(True)) if last else judged, "code-judged")
        finished = finished.union(best.join(judged.where("done").select("query_id"), "query_id", "left_semi"))
        best = best.join(judged.where("NOT done").select("query_id"), "query_id", "left_semi")
        active = judged.where("NOT done").select(
            "query_id", "query", F.when(F.col("n") >= top, F.col("kth")).otherwise(BITS).alias("bound")
        )
        if not active.take(1):
            break
    return finished.withColumn("rank", nearest).select("query_id", "rank", "vec_id", "distance")


def search_embeddings(embeddings: DataFrame, top: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """``search`` over the sign codes of ``embeddings``; vectors with fewer than 64 components take no part."""
    return search(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), sign_code(F.col("embedding")).alias("code")), top, step)


ORACLE_SQL = f"""
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding[1:{BITS}], lambda x: x > 0) AS code FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) >= {BITS}),
d AS (SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(range(1, {BITS} + 1), lambda i: (q.code[i] <> c.code[i])::INTEGER)) AS INTEGER) AS distance
      FROM c q JOIN c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= {TOP}
"""
