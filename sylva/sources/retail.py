"""Foreign-key catalog of the star-schema tables, which Parquet does not record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.sources.relational import Catalog, ForeignKey, Table

TABLES: Catalog = {t.name: t for t in (
    Table("region", ("r_regionkey", "r_name"), ("r_regionkey",)),
    Table("nation", ("n_nationkey", "n_name", "n_regionkey"), ("n_nationkey",), (ForeignKey("n_regionkey", "region", "r_regionkey"),)),
    Table("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), ("c_custkey",),
          (ForeignKey("c_nationkey", "nation", "n_nationkey"),)),
    Table("supplier", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ("s_suppkey",), (ForeignKey("s_nationkey", "nation", "n_nationkey"),)),
    Table("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), ("p_partkey",)),
    Table("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), ("o_orderkey",),
          (ForeignKey("o_custkey", "customer", "c_custkey"),)),
    Table("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                       "l_returnflag", "l_linestatus", "l_shipdate"), (),
          (ForeignKey("l_orderkey", "orders", "o_orderkey"), ForeignKey("l_partkey", "part", "p_partkey"),
           ForeignKey("l_suppkey", "supplier", "s_suppkey"))),
)}


def loader(spark: SparkSession, folder: str):
    def load(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    return load
