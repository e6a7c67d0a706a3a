"""Approximate nearest neighbours by inner product on robust-pruned directed graphs, one graph per shard.

Vectors are dealt to bands of similar length, and within a band to shards by a hash. A shard's graph is built by insertion
in batches: a greedy beam search from the shard's centre proposes neighbours, and relaxed pruning keeps a candidate only
if no kept neighbour is ``relax`` times closer to it than the node is, so edges stay diverse. Inner product becomes
distance by one more coordinate that gives all vectors of a shard the same norm; in a band that coordinate is small, so
both orders nearly agree. A query runs a beam search in every shard; the scores of what it finds are computed in double
precision from the original vectors. Equal vectors are one node that carries its smallest ids, as many as a query can ask
for, so copies cost no edges and no answers.

Shards grow with the square root of the number of vectors up to what a task can hold, and a shard meets the queries in
chunks of ``CHUNK_QUERIES``: what is shuffled is one copy of a shard per chunk and one copy of a chunk per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import forget, stored

TOP, QUERY_STEP = 20, 20
#: Rows of a shard: this many for up to as many vectors times 8, then growing with their square root, up to the most.
SHARD_ROWS, MOST_SHARD_ROWS = 8_192, 131_072
DEGREE, BEAM, QUERY_BEAM, RELAX = 32, 64, 192, 1.2
BATCH, QUERY_BLOCK, CHUNK_QUERIES = 128, 1_024, 65_536
#: Lengths in a band differ by this factor at most, unless the band would have fewer rows than the least.
BAND_RATIO, BAND_ROWS, MOST_BANDS = 1.08, 256, 256


def scaled(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` divided by their largest component, in single precision: no square of them can overflow."""
    most = np.abs(vectors).max()
    return (vectors / (most if most > 0 else 1.0)).astype(np.float32)


def prune(node: np.ndarray, candidates: np.ndarray, x: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Relaxed distance pruning of candidates (rows of indices, -1 for none), for many nodes at once; sorted by distance."""
    n, width = candidates.shape
    points = x[np.maximum(candidates, 0)]
    own = ((points - x[node][:, None, :]) ** 2).sum(axis=2)
    own[(candidates < 0) | (candidates == node[:, None])] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    rows = np.arange(n)[:, None]
    candidates, own, points = candidates[rows, order], own[rows, order], points[rows, order]
    repeat = np.zeros_like(own, dtype=bool)
    repeat[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    own[repeat] = np.inf
    norms = (points**2).sum(axis=2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    alive = np.isfinite(own)
    kept = np.full((n, degree), -1, dtype=np.int32)
    at = np.arange(n)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        kept[some, k] = candidates[at, first][some]
        closer = relax * relax * between[at, first] <= own
        alive &= ~closer
        alive[at, first] = False
    return kept


def beam_search(
    queries: np.ndarray, x: np.ndarray, graph: np.ndarray, start: int, beam: int, by_distance: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Greedy best-first search of all queries at once: the ``beam`` best nodes found, and all nodes expanded.

    Costs are squared distances, or negative inner products; -1 stands for no node.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    squares = (x**2).sum(axis=1) if by_distance else None

    def cost(ids: np.ndarray) -> np.ndarray:
        products = np.einsum("nkd,nd->nk", x[np.maximum(ids, 0)], queries)
        return squares[np.maximum(ids, 0)] - 2 * products if by_distance else -products

    seen = np.zeros((n, len(x)), dtype=bool)
    seen[:, start] = True
    ids = np.full((n, beam), -1, dtype=np.int32)
    costs = np.full((n, beam), np.inf, dtype=np.float32)
    ids[:, 0] = start
    costs[:, 0] = cost(ids[:, :1])[:, 0]
    fresh = np.zeros((n, beam), dtype=bool)
    fresh[:, 0] = True
    expanded = []
    while True:
        busy = np.flatnonzero(fresh.any(axis=1))
        if not len(busy):
            break
        best = np.where(fresh[busy], costs[busy], np.inf).argmin(axis=1)
        node = ids[busy, best]
        fresh[busy, best] = False
        step = np.full(n, -1, dtype=np.int32)
        step[busy] = node
        expanded.append(step)
        near = graph[node]
        known = (near < 0) | seen[busy[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(near >= 0)
        seen[busy[r], near[r, c]] = True
        products = np.einsum("nkd,nd->nk", x[np.maximum(near, 0)], queries[busy])
        price = (squares[np.maximum(near, 0)] - 2 * products if by_distance else -products).astype(np.float32)
        price[known] = np.inf
        all_costs = np.concatenate([costs[busy], price], axis=1)
        all_ids = np.concatenate([ids[busy], near], axis=1)
        all_fresh = np.concatenate([fresh[busy], ~known], axis=1)
        keep = np.argpartition(all_costs, beam - 1, axis=1)[:, :beam]
        b = np.arange(len(busy))[:, None]
        costs[busy] = all_costs[b, keep]
        ids[busy] = np.where(np.isfinite(all_costs[b, keep]), all_ids[b, keep], -1)
        fresh[busy] = all_fresh[b, keep] & np.isfinite(all_costs[b, keep])
    order = np.argsort(costs, axis=1, kind="stable")
    return ids[rows, order], np.stack(expanded, axis=1) if expanded else np.full((n, 0), -1, dtype=np.int32)


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 1):
    """(graph, start) over the rows of ``vectors``; graph is (n, degree) of int32, -1 for no edge."""
    n = len(vectors)
    x = scaled(vectors)
    squares = (x**2).sum(axis=1)
    x = np.concatenate([x, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1, dtype=np.int32)
    graph[:, : min(degree // 2, n)] = rng.integers(0, n, (n, min(degree // 2, n)))
    order = rng.permutation(n)
    for k in range(0, n, BATCH):
        nodes = order[k : k + BATCH]
        found, path = beam_search(x[nodes], x, graph, start, min(beam, n), True)
        candidates = np.concatenate([found, path, graph[nodes]], axis=1)
        graph[nodes] = prune(nodes, candidates, x, degree, relax)
        # Edges back: nodes that would have too many are pruned anew.
        to, back = graph[nodes], np.repeat(nodes[:, None], degree, axis=1)
        mask = to >= 0
        targets, sources = to[mask], back[mask].astype(np.int32)
        by = np.argsort(targets, kind="stable")
        targets, sources = targets[by], sources[by]
        heads, first = np.unique(targets, return_index=True)
        counts = np.diff(np.append(first, len(targets)))
        width = int(counts.max()) if len(counts) else 0
        if not width:
            continue
        added = np.full((len(heads), width), -1, dtype=np.int32)
        rank = np.arange(len(targets)) - np.repeat(first, counts)
        added[np.repeat(np.arange(len(heads)), counts), rank] = sources
        merged = np.concatenate([graph[heads], added], axis=1)
        full = (merged >= 0).sum(axis=1) > degree
        packed = -np.sort(-merged[~full], axis=1)[:, :degree]
        packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
        graph[heads[~full]] = packed
        if full.any():
            graph[heads[full]] = prune(heads[full], merged[full], x, degree, relax)
    return with_entries(graph), start


def with_entries(graph: np.ndarray) -> np.ndarray:
    """The graph with an edge to every node that has none: from its nearest kept neighbour, in one more column if need be."""
    n = len(graph)
    lost = np.flatnonzero(np.bincount(graph[graph >= 0], minlength=n) == 0)
    lost = lost[graph[lost, 0] >= 0]
    while len(lost):
        hosts, first = np.unique(graph[lost, 0], return_index=True)
        column = np.full((n, 1), -1, dtype=np.int32)
        column[hosts, 0] = lost[first]
        graph = np.concatenate([graph, column], axis=1)
        lost = np.delete(lost, first)
    return graph


def _usable(vector: Column) -> Column:
    """Whether a vector takes part: there, not zero, and free of null, infinite or undefined components."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _rows(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))


def merged_vectors(rows: DataFrame, keep_ids: int) -> DataFrame:
    """v (bytes), ids and the logarithm of the length: each task merges its own equal vectors.

    Of each it keeps the ``keep_ids`` smallest ids, which is all that any query can return of them; so a vector that is a
    third of all rows sends a few ids per task.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[bytes, list[int]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            keys = list(groups)
            for k in range(0, len(keys), 4_096):
                part, lengths = keys[k : k + 4_096], []
                for key in part:
                    v = np.frombuffer(key)
                    most = np.abs(v).max()
                    lengths.append(float(np.log(most) + 0.5 * np.log(((v / most) ** 2).sum())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([sorted(set(groups[x]))[:keep_ids] for x in part], pa.list_(pa.int64())),
                     pa.array(lengths, pa.float64())],
                    names=["v", "ids", "length"],
                )
            groups.clear()

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                key = (np.array(v, dtype=np.float64) + 0.0).tobytes()  # -0.0 and 0.0 are equal
                own = groups.setdefault(key, [])
                own.append(i)
                if len(own) > 4 * keep_ids:
                    groups[key] = sorted(set(own))[:keep_ids]
            if len(groups) > 50_000:  # what is merged here is merged again in the shard
                yield from emit()
        yield from emit()

    return rows.mapInArrow(merge, "v binary, ids array<long>, length double")


def bands(counts: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """(lowest step, rows) of each band, longest vectors first, from (step of the logarithm of the length, rows)."""
    out: list[list[int]] = []
    top = 0
    for step, rows in sorted(counts, reverse=True):
        if not out or (out[-1][1] >= least and top - step > np.log(BAND_RATIO) / STEP):
            out.append([step, 0])
            top = step
        out[-1] = [step, out[-1][1] + rows]
    if len(out) > 1 and out[-1][1] < least:
        last = out.pop()
        out[-1] = [last[0], out[-1][1] + last[1]]
    return [(a, b) for a, b in out]


#: Lengths are counted by steps of their logarithm; doubles have some 300,000 steps at most.
STEP = 0.005


def rows_of_shard(n: int, least: int) -> int:
    return int(min(MOST_SHARD_ROWS, max(least, least * (n / (8 * least)) ** 0.5)))


def dealt(merged: DataFrame, shard_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """``merged`` with its shard, and the number of shards per size of a vector in bytes; each size has its own shards."""
    step = F.floor(F.col("length") / STEP).cast("int")
    counted = merged.groupBy(F.length("v").alias("bytes"), step.alias("step")).agg(F.count("*").alias("n")).collect()
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in counted:
        sizes.setdefault(r["bytes"], []).append((r["step"], r["n"]))
    edges, shards = [], {}
    for size, counts in sorted(sizes.items()):
        n = sum(c for _, c in counts)
        each, first = rows_of_shard(n, shard_rows), 0
        found = bands(counts, max(BAND_ROWS, n // MOST_BANDS))
        for k, (low, rows) in enumerate(found):
            many = -(-rows // each)
            edges.append((size, low if k < len(found) - 1 else -(2**31), first, many))
            first += many
        shards[size] = first
    spark = merged.sparkSession
    table = spark.createDataFrame(edges or [(0, 0, 0, 1)], "bytes int, low int, first int, many int").groupBy("bytes").agg(
        F.sort_array(F.collect_list(F.struct("low", "first", "many")), asc=False).alias("bands"))  # at most 256 bands a size
    own = F.get(F.filter("bands", lambda b: b["low"] <= step), F.lit(0))
    rows = merged.withColumn("bytes", F.length("v")).join(F.broadcast(table), "bytes").withColumn("band", own)
    shard = F.col("band.first") + F.pmod(F.xxhash64("v"), F.col("band.many")).cast("int")
    return rows.select("bytes", shard.alias("shard"), "v", "ids"), shards


def index_shards(rows: DataFrame, keep_ids: int, shards: int) -> DataFrame:
    """One row for each (bytes, shard) of ``rows(bytes, shard, v, ids)``: its nodes' vectors, ids and graph as bytes."""

    def graph(table: pa.Table) -> pa.Table:
        groups: dict[bytes, list[int]] = {}
        for v, ids in zip(table.column("v").to_pylist(), table.column("ids").to_pylist(), strict=True):
            groups.setdefault(v, []).extend(ids)
        keys = sorted(groups)
        ids = [sorted(set(groups[k]))[:keep_ids] for k in keys]
        vectors = np.stack([np.frombuffer(k) for k in keys])
        edges, start = build(vectors)
        return pa.table({
            "bytes": table.column("bytes").slice(0, 1).cast(pa.int32()), "shard": table.column("shard").slice(0, 1).cast(pa.int32()),
            "start": pa.array([start], pa.int32()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()), "graph": pa.array([edges.tobytes()], pa.binary()),
            "counts": pa.array([np.array([len(i) for i in ids], dtype=np.int32).tobytes()], pa.binary()),
            "ids": pa.array([np.concatenate([np.array(i, dtype=np.int64) for i in ids]).tobytes()], pa.binary()),
        })

    # Two tasks for each shard on average, as building is what costs; Spark would put small shards together.
    return rows.repartition(2 * max(1, shards), "bytes", "shard").groupBy("bytes", "shard").applyInArrow(
        graph, "bytes int, shard int, start int, vectors binary, graph binary, counts binary, ids binary"
    )


def query_blocks(rows: DataFrame) -> DataFrame:
    """bytes, query_ids and queries of up to ``QUERY_BLOCK`` rows of one length each."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}

        def emit(size: int) -> pa.RecordBatch:
            ids, vectors = held.pop(size)
            return pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int32()), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
                 pa.array([b"".join(vectors)], pa.binary())],
                names=["bytes", "query_ids", "queries"],
            )

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                raw = np.array(v, dtype=np.float64).tobytes()
                ids, vectors = held.setdefault(len(raw), ([], []))
                ids.append(i)
                vectors.append(raw)
                if len(ids) == QUERY_BLOCK:
                    yield emit(len(raw))
        for size in list(held):
            yield emit(size)

    return rows.mapInArrow(blocks, "bytes int, query_ids binary, queries binary")


def _find(top: int):
    """Search one shard with the query blocks of one chunk: the ``top`` best of each query."""

    def search_block(shard: dict, x: np.ndarray, x32: np.ndarray, edges: np.ndarray, first: np.ndarray, row: dict, out: tuple) -> None:
        counts, ids = np.frombuffer(shard["counts"], dtype=np.int32), np.frombuffer(shard["ids"], dtype=np.int64)
        queries = np.frombuffer(row["queries"]).reshape(-1, x.shape[1])
        query_ids = np.frombuffer(row["query_ids"], dtype=np.int64)
        for k in range(0, len(queries), BATCH):
            q = queries[k : k + BATCH]
            unit = (q / np.abs(q).max(axis=1, keepdims=True)).astype(np.float32)
            found, _ = beam_search(unit, x32, edges, shard["start"], min(max(QUERY_BEAM, 2 * top), len(x)), False)
            scores = np.einsum("nkd,nd->nk", x[np.maximum(found, 0)], q)
            for i in range(len(q)):
                node, own = np.unique(found[i], return_index=True)
                node, score = node[node >= 0], scores[i][own[node >= 0]]
                near = np.argsort(-score, kind="stable")[: top + 1]
                node, score = node[near], score[near]
                who = np.concatenate([ids[first[j] : first[j + 1]] for j in node])
                far = np.repeat(score, counts[node])
                other = who != query_ids[k + i]
                who, far = who[other], far[other]
                best = np.lexsort((who, -far))[:top]
                out[0].append(np.full(len(best), query_ids[k + i]))
                out[1].append(who[best])
                out[2].append(far[best])

    def run(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if shards.num_rows and blocks.num_rows:
            shard = shards.to_pylist()[0]
            x = np.frombuffer(shard["vectors"]).reshape(-1, shard["bytes"] // 8)
            edges = np.frombuffer(shard["graph"], dtype=np.int32).reshape(len(x), -1)
            first = np.concatenate(([0], np.cumsum(np.frombuffer(shard["counts"], dtype=np.int32))))
            x32 = scaled(x)
            for batch in blocks.to_batches(max_chunksize=1):
                for row in batch.to_pylist():
                    search_block(shard, x, x32, edges, first, row, out)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, k) for n, c, k in zip(("query_id", "vec_id", "score"), out, kinds)})

    return run


def search(embeddings: DataFrame, top: int = TOP, step: int = QUERY_STEP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``top`` nearest found of each query: query_id, rank from 1, vec_id, score; ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``step``; candidates are all rows with another vec_id. Rows with a
    null vec_id or an unusable vector take no part; rows repeated with one vec_id and vector count once; vectors of
    another length than the query's are no candidates; an empty table gives an empty result. A query's best from a shard
    are ``top`` rows, and only those are merged.
    """
    from pyspark.sql import Window

    rows = _rows(embeddings)
    merged = stored(merged_vectors(rows, top + 1), "ann-vectors")
    placed, numbers = dealt(merged, shard_rows)
    shards = stored(index_shards(placed, top + 1, sum(numbers.values())), "ann-shards")
    forget(merged)
    asked = stored(query_blocks(rows.where(F.col("vec_id") % step == 0).distinct()), "ann-queries")
    chunks = max(1, -(-asked.count() * QUERY_BLOCK // CHUNK_QUERIES))
    # Each shard meets each chunk of its vectors' size once.
    held = shards.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    many = F.create_map(*[F.lit(x) for pair in (numbers or {0: 1}).items() for x in pair])
    sent = asked.withColumn("chunk", F.pmod(F.xxhash64("query_ids"), F.lit(chunks)).cast("int")).where(many[F.col("bytes")].isNotNull())
    sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0), many[F.col("bytes")] - 1)))
    key, tasks = ("bytes", "shard", "chunk"), 2 * max(1, sum(numbers.values()) * chunks)
    found = held.repartition(tasks, *key).groupBy(*key).cogroup(sent.repartition(tasks, *key).groupBy(*key)).applyInArrow(
        _find(top), "query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
