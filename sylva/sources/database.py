"""Relational databases over JDBC: the catalog from the database's own metadata, and tables as DataFrames.

Metadata is read on the driver, through the JVM's driver manager; rows are read by executors. A table with one whole-number
key is read in ranges of it, so that its reading is spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sylva.sources.relational import Catalog, ForeignKey, Table

#: JDBC type codes of whole numbers.
WHOLE = (-5, 4, 5, -6)


@contextmanager
def connection(spark: SparkSession, url: str) -> Iterator:
    """A JDBC connection of the driver process, closed at the end."""
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        yield c
    finally:
        c.close()


def _rows(result, *columns: str) -> list[tuple]:
    out = []
    while result.next():
        out.append(tuple(result.getObject(c) for c in columns))
    result.close()
    return out


def reflect(spark: SparkSession, url: str, schema: str | None = None, with_views: bool = False) -> Catalog:
    """The catalog of a database: tables (and views), columns in order, primary and foreign keys of any width.

    Tables of system schemas are left out. A foreign key to a table outside the catalog is left out as well.
    """
    kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 2 if with_views else 1)
    kinds[0] = "TABLE"
    if with_views:
        kinds[1] = "VIEW"
    with connection(spark, url) as c:
        meta = c.getMetaData()
        names = [n for s, n in _rows(meta.getTables(None, schema, "%", kinds), "TABLE_SCHEM", "TABLE_NAME")
                 if (s or "").upper() not in ("SYS", "SYSTEM", "INFORMATION_SCHEMA", "PG_CATALOG")]
        found: Catalog = {}
        for name in sorted(names):
            columns = sorted(_rows(meta.getColumns(None, schema, name, "%"), "ORDINAL_POSITION", "COLUMN_NAME"))
            keys = sorted(_rows(meta.getPrimaryKeys(None, schema, name), "KEY_SEQ", "COLUMN_NAME"))
            links: dict[tuple, list[tuple]] = {}
            for key, number, column, target, target_column in _rows(
                    meta.getImportedKeys(None, schema, name), "FK_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME"):
                links.setdefault((key, target), []).append((number, column, target_column))
            made = []
            for (_, target), parts in sorted(links.items(), key=lambda x: str(x)):
                parts = sorted(parts)
                if target in names:
                    made.append(ForeignKey(parts[0][1], target, parts[0][2], tuple((a, b) for _, a, b in parts[1:])))
            found[name] = Table(name, tuple(c for _, c in columns), tuple(c for _, c in keys), tuple(made))
    return found


def loader(spark: SparkSession, url: str, catalog: Catalog, partitions: int = 0, **options: str) -> Callable[[str], DataFrame]:
    """A function from a table's name to its rows; with ``partitions`` tables with one whole-number key are read in ranges."""

    def quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def load(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", quoted(name)).options(**options)
        key = catalog[name].primary_key if name in catalog else ()
        if partitions > 1 and len(key) == 1:
            with connection(spark, url) as c:
                result = c.createStatement().executeQuery(f"SELECT min({quoted(key[0])}) AS a, max({quoted(key[0])}) AS b FROM {quoted(name)}")
                whole = result.getMetaData().getColumnType(1) in WHOLE
                low, high = _rows(result, "a", "b")[0]
            if whole and low is not None:
                reader = reader.options(partitionColumn=quoted(key[0]), lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions))
        return reader.load()

    return load
