"""A set of trees in a folder, with snapshots: each change writes a new Parquet folder and then moves one pointer row.

Readers see the last complete snapshot; a failed change leaves it as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class TreeStore:
    """Trees keyed by ``tree_id``: adding one that is there replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._pending: DataFrame | None = None
        self._open = 0

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("n long, folder string").parquet(f"{self.path}/versions")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def read(self) -> DataFrame:
        if self._pending is not None:
            return self._pending
        versions = self._versions()
        last = versions.orderBy(F.desc("n")).limit(2).collect() if versions is not None else []
        if not last:
            return self.spark.createDataFrame([], "tree_id string, tree string")
        if len(last) == 2 and last[0]["n"] == last[1]["n"]:
            raise RuntimeError(f"two writers made version {last[0]['n']}: {last[0]['folder']} and {last[1]['folder']}")
        return self.spark.read.parquet(f"{self.path}/{last[0]['folder']}")

    def _write(self, trees: DataFrame) -> None:
        if self._open:
            self._pending = trees
            return
        versions = self._versions()
        n = ((versions.agg(F.max("n")).first()[0] if versions is not None else None) or 0) + 1
        folder = f"trees-{uuid.uuid4().hex}"
        trees.write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(n, folder)], "n long, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def add(self, trees: DataFrame) -> None:
        new = trees.select("tree_id", "tree")
        last = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("tree")))
        new = new.withColumn("__k", last).where("__k = 1").drop("__k")
        self._write(self.read().join(new, "tree_id", "left_anti").unionByName(new))

    def add_in_batches(self, batches: Iterator[DataFrame]) -> int:
        """Add batch after batch, each a snapshot of its own, so that what is in stays in; the number of batches."""
        n = 0
        for n, batch in enumerate(batches, 1):
            self.add(batch)
        return n

    def reference(self, tree_id: str) -> tuple[str, str]:
        """What :meth:`resolve` finds the tree by, from any session: the store's folder and the tree's id."""
        if tree_id not in self:
            raise KeyError(tree_id)
        return self.path, tree_id

    @classmethod
    def resolve(cls, spark: SparkSession, reference: tuple[str, str]) -> DataFrame:
        """The tree of a reference as one row; none where it was discarded since."""
        return cls(spark, reference[0]).read().where(F.col("tree_id") == reference[1])

    def discard(self, ids: DataFrame) -> None:
        self._write(self.read().join(ids.select("tree_id"), "tree_id", "left_anti"))

    def clear(self) -> None:
        self._write(self.read().limit(0))

    def get(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids.select("tree_id").distinct(), "tree_id", "left_semi")

    def ids(self) -> DataFrame:
        return self.read().select("tree_id")

    def __len__(self) -> int:
        return self.read().count()

    def __contains__(self, tree_id: str) -> bool:
        return bool(self.read().where(F.col("tree_id") == tree_id).take(1))

    @contextmanager
    def transaction(self) -> Iterator[TreeStore]:
        """Changes inside become one snapshot; an exception drops them. Transactions may be nested."""
        self._open += 1
        try:
            yield self
        except BaseException:
            self._open -= 1
            if not self._open:
                self._pending = None
            raise
        self._open -= 1
        if not self._open and self._pending is not None:
            trees, self._pending = self._pending, None
            self._write(trees)
