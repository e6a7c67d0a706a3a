"""What the operators share: table access, small slices of Arrow batches, components, the library's intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.shared import connected_components, forget, shared_dir, stored

__all__ = ["components", "connected_components", "forget", "shared_dir", "sliced", "stored", "table"]

#: Links that one task connects, 16 bytes each; of more, rounds of joins do.
LINKS_AT_ONCE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python strings at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), sorted, and the smallest that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        apart = least[x] != least[y]
        if not apart.any():
            return nodes, nodes[least]
        u, v = least[x[apart]], least[y[apart]]
        np.minimum.at(least, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(further := least[least], least):
            least = further


def components(links: DataFrame, most: int = LINKS_AT_ONCE) -> DataFrame:
    """As :func:`connected_components`, without its rounds where there are few links: one task connects up to ``most``.

    Each round is some ten stages, whose tasks and threads the driver keeps in memory for a while, however small they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        nodes, least = least_reachable(*(found.column(c).to_numpy() for c in "ab"))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    known = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"), "few-links")
    if known.count() > most:
        found = connected_components(known)
    else:
        found = stored(known.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(
            run, "node long, component long"), "components")
    forget(known)
    return found
