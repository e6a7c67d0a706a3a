"""Incremental ingest: new files of documents become node rows as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sylva.model import trees_to_nodes
from sylva.sources.documents import read_documents


def ingest_documents(spark: SparkSession, source: str, schema: StructType | str, id_column: str, text_column: str,
                     target: str, checkpoint: str, name: str = "ROOT", once: bool = True) -> StreamingQuery:
    """Follow a folder of Parquet files and append their trees' nodes to ``target``.

    Each micro-batch has a folder of its own in ``target`` and overwrites it, so a batch that is run again after a
    failure adds nothing twice. The only state is Spark's list of files seen.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        nodes = trees_to_nodes(read_documents(batch, id_column, text_column, name))
        nodes.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All nodes so far; of a tree that came in several batches the last one's."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("tree_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["tree_id", "batch"]).drop("batch")
