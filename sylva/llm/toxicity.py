"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its terms: lower-case words and their first letters, hashed to 32 bits. The machine scores
``bias + sum w_i + sum_{i<j} <v_i, v_j>`` over the screened terms present, so two terms that are harmless apart (an
insult, the name of a group) can count together. Terms are screened by chi-square against the labels; weights and
factors are learned by Adam on the logistic loss. Only the fit uses a sample of labelled rows, bounded by ``max_rows``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sylva.llm.common import forget, sliced, stored

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 6)
THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000  # labelled rows of the fit, chosen by a hash of doc_id
    max_terms: int = 4_096  # screened terms, the largest chi-squares
    min_docs: int = 8  # labelled rows that a screened term occurs in
    min_chi2: float = 40.0
    factors: int = 8
    linear_epochs: int = 60  # weights alone, so that a telling term counts by itself
    epochs: int = 20  # then weights and factors, on whole rows
    keep: float = 0.4  # of a row's terms per step while weights are learned alone: few of many telling terms must do
    batch: int = 256
    rate: float = 0.1
    factor_rate: float = 0.01
    decay: float = 1e-5
    factor_decay: float = 1e-3
    seed: int = 7


def word_terms(word: str) -> list[int]:
    """Hashed terms of one lower-case word: itself, and its first letters where it is longer."""
    raw = word.encode("utf-8", "surrogatepass")
    return [xxhash.xxh32_intdigest(raw, 0)] + [
        xxhash.xxh32_intdigest(word[:k].encode("utf-8", "surrogatepass"), k) for k in PREFIXES if len(word) > k
    ]


def terms(text: str | None) -> set[int]:
    return {t for w in set(WORD.findall((text or "").lower())) for t in word_terms(w)}


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that no fit sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Machine:
    """Weights and factors of the screened terms; index by hashed term."""

    def __init__(self, index: dict[int, int], bias: float, weights: np.ndarray, factors: np.ndarray):
        self.index, self.bias, self.weights, self.factors = index, bias, weights, factors
        self.words: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        if len(self.words) > 100_000:
            self.words = {}
        known, present = self.words, set()
        for w in set(WORD.findall((text or "").lower())):
            found = known.get(w)
            if found is None:
                found = known[w] = tuple(self.index[t] for t in word_terms(w) if t in self.index)
            if found:
                present.update(found)
        total = self.bias
        if present:
            at = np.fromiter(present, dtype=np.int64)
            v = self.factors[at]
            total += self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -60, 60))))


def train(rows: list[tuple[int, list[int]]], size: int, s: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors from (label, indices of the terms present)."""
    rng = np.random.default_rng(s.seed)
    y = np.array([r[0] for r in rows], dtype=np.float64)
    base = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    p = [np.array([np.log(base / (1 - base))]), np.zeros(size), rng.normal(0, 0.01, (size, s.factors))]
    if not size or not len(y):
        return float(p[0][0]), p[1], p[2]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    flat = [np.array(r[1], dtype=np.int64) for r in rows]
    for epoch in range(s.linear_epochs + s.epochs):
        moved = 3 if epoch >= s.linear_epochs else 2
        order = rng.permutation(len(rows))
        for k in range(0, len(order), s.batch):
            own = order[k : k + s.batch]
            at = np.concatenate([flat[i] for i in own])
            doc = np.repeat(np.arange(len(own)), [len(flat[i]) for i in own])
            if epoch < s.linear_epochs:
                stays = rng.random(len(at)) < s.keep
                at, doc = at[stays], doc[stays]
            v = p[2][at]
            sums = np.stack([np.bincount(doc, v[:, f], len(own)) for f in range(s.factors)], axis=1)
            pairs = 0.5 * ((sums**2).sum(axis=1) - np.bincount(doc, (v**2).sum(axis=1), len(own)))
            z = p[0][0] + np.bincount(doc, p[1][at], len(own)) + pairs
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[own]) / len(own)
            gv = g[doc][:, None] * (sums[doc] - v)
            grads = [
                np.array([g.sum()]),
                np.bincount(at, g[doc], size) + s.decay * p[1],
                np.stack([np.bincount(at, gv[:, f], size) for f in range(s.factors)], axis=1) + s.factor_decay * p[2],
            ]
            step += 1
            pace = s.rate if epoch < s.linear_epochs else s.factor_rate
            rates = (pace, pace, s.factor_rate)
            for x, d, m, u, rate in list(zip(p, grads, first, second, rates, strict=True))[:moved]:
                m += 0.1 * (d - m)
                u += 0.001 * (d * d - u)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
    return float(p[0][0]), p[1], p[2]


def fit(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Machine:
    """A machine fitted to labelled rows outside the held-out fold.

    Labels that are null or not 0 or 1 are left out; of several labels of a document the largest counts; labels without
    a document, and documents without a label, take no part. Of several texts under one doc_id the one with the smallest
    hash counts, so at most ``max_rows`` texts are learned from. Without usable labels every score is the bias.
    """
    spark = documents.sparkSession
    own = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(s.max_rows)
    ).collect()
    sample = spark.createDataFrame([(r["id"], r["y"]) for r in own], "id long, y int")
    rows = (
        documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(sample), "id")  # at most max_rows rows of 12 bytes
        .groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("y", "text")
    )
    rows = stored(rows, "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2_048):
            n: Counter = Counter()
            pos: Counter = Counter()
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms(text)
                n.update(found)
                if y:
                    pos.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64()),
                 pa.array([pos[t] for t in n], pa.int64())],
                names=["term", "n", "pos"],
            )

    positives = sum(r["y"] for r in own)
    total, expected = len(own), max(positives, 1) / max(len(own), 1)
    n, pos = F.col("n"), F.col("pos")
    gap = pos - n * F.lit(expected)
    chi2 = gap * gap * F.lit(float(total)) / (
        n * F.lit(expected * max(1 - expected, 1e-9)) * F.greatest(F.lit(float(total)) - n, F.lit(1.0))
    )
    picked = (
        rows.mapInArrow(counted, "term long, n long, pos long")
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        .where(n >= s.min_docs).select("term", chi2.alias("chi2")).where(F.col("chi2") >= s.min_chi2)
        .orderBy(F.desc("chi2"), "term").limit(s.max_terms).collect()
    )
    index = {r["term"]: i for i, r in enumerate(picked)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x for part in sliced([batch]) for x in part.column("text").to_pylist())
            at = [sorted(index[t] for t in terms(x) if t in index) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(at, pa.list_(pa.int32()))], names=["y", "at"])

    found = rows.mapInArrow(present, "y int, at array<int>").collect()
    forget(rows)
    # Copies of one document count once, and the order of the rows does not matter.
    distinct = sorted({(r["y"], tuple(r["at"])) for r in found if r["at"]})
    clean = sum(1 for r in found if not r["at"] and not r["y"])
    toxic = sum(1 for r in found if not r["at"] and r["y"])
    plain = [(0, ())] * min(clean, max(len(distinct), 1)) + [(1, ())] * (toxic * min(clean, max(len(distinct), 1)) // max(clean, 1))
    return Machine(index, *train([*distinct, *plain], len(index), s))


def score_documents(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``, from its whole text.

    Null and empty texts score like any text without known terms; a null doc_id stays null and counts as not held out;
    repeated rows stay; an empty table gives an empty result; other columns are never looked at.
    """
    parts = (machine.index, machine.bias, machine.weights, machine.factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*parts)
        for batch in batches:
            scores = pa.array([own.score(t) for part in sliced([batch]) for t in part.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], names=["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxicity(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    return score_documents(documents, fit(documents, labels, s))


def keep_clean(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` that score below the threshold, with their columns, scored in place.

    Texts of any type are read as strings; null and empty ones score like any text without known terms.
    """
    machine = fit(documents, labels, s)
    parts = (machine.index, machine.bias, machine.weights, machine.factors)

    # A text column of another type is read through a string column of its own, which goes again after scoring.
    plain = isinstance(documents.schema["text"].dataType, StringType)
    rows = documents if plain else documents.select("*", F.col("text").cast("string").alias(f"text-{uuid.uuid4().hex}"))
    at, width = documents.columns.index("text") if plain else len(documents.columns), len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*parts)
        for batch in batches:
            keep = [own.score(t) < THRESHOLD for part in sliced([batch]) for t in part.column(at).to_pylist()]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:width], schema=pa.schema(list(kept.schema)[:width]))

    return rows.mapInArrow(run, documents.schema)
