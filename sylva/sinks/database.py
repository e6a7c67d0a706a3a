"""Forests written to a relational database: tables with keys and types, and rows that are not there yet.

Rows go to a staging table by executors; one statement then inserts those whose key is missing. So writing a forest again,
or one that shares records with what is there, adds nothing twice, and a write that dies leaves only a staging table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import typed_value
from sylva.operators import schema as schemas
from sylva.sinks import export_tables, key_name
from sylva.sources.database import connection

#: SQL types of a column's values: of the kinds that occur the first in this order that all fit.
SQL_TYPES = {"boolean": "BOOLEAN", "integer": "BIGINT", "float": "DOUBLE PRECISION", "string": "VARCHAR(32672)"}
KEY_TYPE = "VARCHAR(64)"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def table_name(name: str) -> str:
    """A relation's name as a table's."""
    return name.replace("<->", "_")


def typed(table: DataFrame, keys: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``table`` with its textual columns cast to what all their values are, and the columns' SQL types."""
    columns = [c for c in table.columns if c not in keys]
    kinds = table.agg(*[F.collect_set(typed_value(F.col(f"`{c}`"))).alias(c) for c in columns]).first() if columns else None
    types = dict.fromkeys(keys, KEY_TYPE)
    out = table
    for c in columns:
        found = set(kinds[c])
        kind = "string" if not found else next(k for k, fits in (
            ("boolean", {"boolean"}), ("integer", {"integer"}), ("float", {"integer", "float"}), ("string", set(SQL_TYPES))) if found <= fits)
        types[c] = SQL_TYPES[kind]
        value = F.trim(F.col(f"`{c}`"))
        cast = {"boolean": F.lower(value).cast("boolean"), "integer": F.replace(value, F.lit("_"), F.lit("")).cast("long"),
                "float": F.replace(value, F.lit("_"), F.lit("")).cast("double")}
        if kind != "string":
            out = out.withColumn(c, cast[kind])
    return out, types


def export_database(nodes: DataFrame, own: schemas.Schema, url: str) -> dict[str, int]:
    """Write a forest under a schema to a database; the number of rows added per table.

    A group is a table with its oid as primary key, a 1-n relation a foreign key on the side of many, an n-n relation a
    table of two keys. Tables that are there are kept and must have the columns written; rows are added where their key is
    missing.
    """
    spark = nodes.sparkSession
    tables = export_tables(nodes, own)
    links = {r.name: r for r in own.relations if r.orientation == schemas.BOTH}
    added = {}
    for name, df in sorted(tables.items(), key=lambda x: (x[0] in links, x[0])):
        keys = [c for c in df.columns if c in {key_name(g) for g in own.groups} or c.endswith("_oid") or c.endswith("_oid_2")]
        primary = keys if name in links else [key_name(name)]
        rows, types = typed(df, set(keys))
        added[table_name(name)] = insert_absent(spark, rows, table_name(name), url, primary, types)
    with connection(spark, url) as c:
        for r in sorted(own.relations, key=lambda r: r.name):
            for table, column, target in _references(r):
                _try(c, f"ALTER TABLE {_quoted(table_name(table))} ADD CONSTRAINT {_quoted(f'fk_{uuid.uuid5(uuid.NAMESPACE_OID, table + column).hex[:16]}')} "
                        f"FOREIGN KEY ({_quoted(column)}) REFERENCES {_quoted(target)} ({_quoted(key_name(target))})")
    return added


def _references(r: schemas.Relation) -> list[tuple[str, str, str]]:
    """(table, column, table referred to) of a relation's foreign keys."""
    if r.orientation == schemas.BOTH:
        second = f"{key_name(r.right)}{'_2' if r.left == r.right else ''}"
        return [(r.name, key_name(r.left), r.left), (r.name, second, r.right)]
    holder, target = (r.right, r.left) if r.orientation == schemas.LEFT else (r.left, r.right)
    return [(holder, key_name(target) if holder != target else f"{r.name}_oid", target)]


def _try(c, statement: str) -> bool:
    """Run a statement that may have been run before; whether the database took it."""
    from py4j.protocol import Py4JJavaError

    try:
        c.createStatement().executeUpdate(statement)
    except Py4JJavaError as e:
        if "SQLException" not in str(e.java_exception.getClass().getName()) and not e.java_exception.getClass().getName().endswith("TransactionRollbackException"):
            raise
        return False
    return True


def _exists(c, table: str) -> bool:
    return c.getMetaData().getTables(None, None, table, None).next()


def insert_absent(spark: SparkSession, rows: DataFrame, table: str, url: str, primary: list[str], types: dict[str, str]) -> int:
    """Create ``table`` where it is missing and add the rows whose key it does not hold; the number of these."""
    columns = ", ".join(f"{_quoted(c)} {types[c]}{' NOT NULL' if c in primary else ''}" for c in rows.columns)
    stage = f"stage_{uuid.uuid4().hex[:20]}"
    names = ", ".join(map(_quoted, rows.columns))
    same = " AND ".join(f"t.{_quoted(k)} = s.{_quoted(k)}" for k in primary)
    with connection(spark, url) as c:
        if not _exists(c, table):
            c.createStatement().executeUpdate(f"CREATE TABLE {_quoted(table)} ({columns}, PRIMARY KEY ({', '.join(map(_quoted, primary))}))")
        c.createStatement().executeUpdate(f"CREATE TABLE {_quoted(stage)} ({columns})")
    kept = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in primary)).dropDuplicates(primary)
    kept.write.format("jdbc").option("url", url).option("dbtable", _quoted(stage)).mode("append").save()
    with connection(spark, url) as c:
        n = c.createStatement().executeUpdate(
            f"INSERT INTO {_quoted(table)} ({names}) SELECT {names} FROM {_quoted(stage)} s WHERE NOT EXISTS (SELECT 1 FROM {_quoted(table)} t WHERE {same})")
        c.createStatement().executeUpdate(f"DROP TABLE {_quoted(stage)}")
    return n
