"""Intermediate tables in the folder that driver and executors share, and connected components on top of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset: a temporary one on a local master, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sylva-')}"
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext.getCheckpointDir() or found
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def path_of(df: DataFrame) -> str | None:
    """The folder of a table that :func:`stored` wrote."""
    return getattr(df, "_sylva_path", None)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends here and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sylva_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`stored` wrote and that nothing reads any more; others are left alone."""
    for df in tables:
        path = None if df is None else path_of(df)
        if path is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where they come in fewer parts, as those of a small file do; else as they are.

    For work in Python, which costs far more per row than moving it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def parts(spark: SparkSession) -> int:
    """Into how many parts rows are dealt from which much more is made: as many as a shuffle has, one per core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over :func:`parts` in any case: a compact file is one part, however many rows it has."""
    return rows.repartition(parts(rows.sparkSession))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of ``edges(a long, b long)``: columns node, component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Minima are partial aggregates, joins are
    equi-joins that AQE can split, and each round is written to the shared folder, where it replaces the one before.
    Self-loops and repeats are harmless; an edge with a null end is ignored; without edges the result is empty.
    """

    def linked(both: DataFrame) -> DataFrame:
        return both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u")

    links = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    if not links.take(1):
        return edges.sparkSession.createDataFrame([], "node long, component long")
    previous = None
    for _ in range(max_rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            linked(both).where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        )
        small = linked(large)
        before, links = links, stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "links",
        )
        forget(before)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
