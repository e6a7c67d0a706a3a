"""The registered queries of the subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import ann, hamming, linededup, packing, pieces, sharding, simhash, toxicity, urlfilter, warc
from sylva.llm.common import table
from sylva.session import tune


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op1_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(urlfilter.derived_captures(pages), urlfilter.derived_entries(pages))


def op5_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_piece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search_embeddings(table(spark, sf_dir, "embeddings"))


def op8_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(table(spark, sf_dir, "documents"))


def op9_pack_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_pruned_graph, op2_simhash, op3_shard_tree, op4_temporal_list, op5_factorization_machine, op6_piece_prefix_table,
        op7_multi_index_hashing, op8_line_edit_join, op9_pack_sum_of_squares, op10_warc_round_trip,
    )
    return {f.__name__: lambda spark, sf_dir, f=f: f(tune(spark), sf_dir) for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_temporal_list": urlfilter.ORACLE_SQL,
        "op7_multi_index_hashing": hamming.ORACLE_SQL,
        "op8_line_edit_join": linededup.ORACLE_SQL,
        "op10_warc_round_trip": warc.ORACLE_SQL,
    }
