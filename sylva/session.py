"""Session factory with the settings that every part of the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch on its way to Python. Spark's own default is 64 MB, held by the JVM and by each Python worker.
BATCH_BYTES, _BATCH_KEY, _BATCH_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def tune(spark: SparkSession) -> SparkSession:
    """A session that others made, with the batch size of :func:`get_session` unless it has one of its own.

    For applications (the registered queries, the corpus pipeline); operators never change a session.
    """
    if spark.conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")
    return spark


def get_session(app: str = "sylva", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE on; ``master`` only where the launcher has not set one (tests, benchmarks)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(_BATCH_KEY, f"{BATCH_BYTES}b")
    )
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
