"""Corpora in archives: zip files and gzip-compressed tar files, told apart by their first bytes."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def members(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the files in an archive; ValueError for other data."""
    if content[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, z.read(i)
    elif content[:2] == b"\x1f\x8b":
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
            for i in t:
                if i.isfile():
                    yield i.name, t.extractfile(i).read()
    else:
        raise ValueError("neither a zip nor a gzip archive")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, name and text of every file in the archives under ``path``; each archive is unpacked by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [{"archive": archive, "name": n, "text": c.decode("utf-8", "replace")} for n, c in members(content)]
                schema = pa.schema([("archive", pa.string()), ("name", pa.string()), ("text", pa.string())])
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, name string, text string")


def standoff_from_archives(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, annotation lines) of the ``.txt`` and ``.ann`` files among ``files``, keyed by archive and stem."""
    stem = F.concat_ws("!", "archive", F.regexp_replace("name", r"\.[^.]+$", "")).alias("doc_id")
    texts = files.where(F.col("name").endswith(".txt")).select(stem, "text")
    lines = files.where(F.col("name").endswith(".ann")).select(stem, F.explode(F.split("text", "\n")).alias("value"))
    return texts, lines


def cache_key(content_digest: str, language: str, **settings) -> str:
    """Key of a parsed corpus: its content, language and settings, whatever order these are given in."""
    plain = {k: sorted(v) if isinstance(v, (set, frozenset)) else v for k, v in settings.items()}
    return hashlib.md5(json.dumps([content_digest, language, plain], sort_keys=True, default=str).encode()).hexdigest()
