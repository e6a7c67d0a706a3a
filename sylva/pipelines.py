"""Whole tasks as functions, and a small command line: ``python -m sylva.pipelines TASK ...``."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import sinks
from sylva.model import nodes_to_trees, trees_to_nodes
from sylva.operators import forest, report, schema, simplify, vocabulary
from sylva.sinks import database as database_sink
from sylva.sources import archives, database, documents, graph, lines, text
from sylva.sources import relational as rel


def load_documents(spark: SparkSession, path: str, name: str = "ROOT", raw: bool = False) -> DataFrame:
    return trees_to_nodes(documents.read_document_files(spark, path, name, raw))


def load_tables(load: Callable[[str], DataFrame], catalog: rel.Catalog, search_all: bool = False, sample: int = 0) -> DataFrame:
    return rel.trees_as_nodes(rel.read_database(load, catalog, search_all=search_all, sample=sample))


def load_graph(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return rel.trees_as_nodes(graph.read_graph(vertices, edges))


def load_database(spark: SparkSession, url: str, search_all: bool = False, sample: int = 0, partitions: int = 8) -> DataFrame:
    """The forest of a database, its catalog read from the database itself."""
    catalog = database.reflect(spark, url)
    return load_tables(database.loader(spark, url, catalog, partitions), catalog, search_all, sample)


def _cached(spark: SparkSession, folder: str) -> DataFrame | None:
    """A finished corpus in the cache: one whose writing ended, so that its folder has Spark's mark of success."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        return spark.read.parquet(folder)
    store.delete(path, True)  # what a writer left behind that died half-way
    return None


def load_corpus(spark: SparkSession, path: str, make_parser: Callable[[], text.Parser], language: str = "", cache: str | None = None,
                mapping: dict[str, str] | None = None, exclude: frozenset[str] = frozenset(), sample: int = 0,
                make_extractor: Callable[[], Callable[[str], list[dict]]] | None = None, knowledge: DataFrame | None = None) -> DataFrame:
    """Annotated text in archives as a forest; with ``cache``, a folder of parsed corpora by key, parsed only once.

    ``sample`` sentences are chosen by a hash where it is not 0; an extractor adds entities that it finds; ``knowledge``
    puts canonical values in their place, as names of entities have none. Relations have no form in these trees: they
    are read (``text.assign_relations``) but not part of the forest.
    """
    files = archives.read_archives(spark, path)
    folder = None
    if cache is not None:
        digest = files.select(F.sha2(F.concat_ws("\0", "archive", "name", "text"), 256).alias("d")).agg(
            F.md5(F.concat_ws("", F.array_sort(F.collect_list("d"))))).first()[0]  # one digest per file of the corpus
        settings = {"mapping": mapping or {}, "exclude": exclude, "sample": sample, "extracted": make_extractor is not None, "resolved": knowledge is not None}
        folder = f"{cache.rstrip('/')}/{archives.cache_key(digest, language, **settings)}"
        if (found := _cached(spark, folder)) is not None:
            return found
    texts, annotations = archives.standoff_from_archives(files)
    spans, _ = text.parse_standoff(annotations)
    spans = text.rename_and_exclude(spans, mapping or {}, set(exclude))
    if knowledge is not None:
        spans = text.resolve_entities(spans, knowledge)
    sentences = text.split_sentences(texts)
    placed = text.assign_entities(spans, sentences).groupBy("doc_id", "idx").agg(F.collect_list(F.struct("name", "start", "end")).alias("entities"))
    ready = sentences.join(placed, ["doc_id", "idx"], "inner" if make_extractor is None else "left")
    if make_extractor is not None:
        ready = text.extract_entities(ready, make_extractor)
    if sample:
        ready = ready.orderBy(F.xxhash64("doc_id", "idx"), "doc_id", "idx").limit(sample)
    nodes = trees_to_nodes(text.parse_sentences(ready, make_parser))
    if folder is not None:
        nodes.write.mode("overwrite").parquet(folder)
        return spark.read.parquet(folder)
    return nodes


def load_corpora(spark: SparkSession, corpora: list[tuple[str, str]], make_parser: Callable[[str], Callable[[], text.Parser]], **settings) -> DataFrame:
    """Several corpora, (path, language) each, as one forest; ``make_parser`` gives the factory of a language's parser."""
    if not corpora:
        raise ValueError("no corpus")
    parts = [load_corpus(spark, path, make_parser(language), language, **settings) for path, language in corpora]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clear_cache(spark: SparkSession, cache: str) -> None:
    """Delete a folder of parsed corpora."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(nodes: DataFrame) -> DataFrame:
    """The trees that are whole, each once: broken ones and repeats of a tree_id are left out."""
    good = nodes.join(forest.broken_trees(nodes).select("tree_id").distinct(), "tree_id", "left_anti")
    return good.select(nodes.columns)


def simplify_by_model(nodes: DataFrame, make_model: Callable[[], vocabulary.Model], **settings) -> DataFrame:
    return trees_to_nodes(vocabulary.model_rewrite(nodes_to_trees(nodes), make_model, **settings))


def imported(name: str):
    """An object by ``module:name``, for plug-ins named on the command line."""
    from importlib import import_module

    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def run_simplify(nodes: DataFrame, **settings) -> tuple[DataFrame, list[str]]:
    trees, log = simplify.simplify(nodes_to_trees(nodes), **settings)
    return trees_to_nodes(trees), log


def export_tables(nodes: DataFrame, folder: str) -> None:
    own = schema.infer(nodes, keep_unlabelled=False)
    sinks.write_tables(sinks.export_tables(nodes, own), lambda name, df: df.write.mode("overwrite").parquet(f"{folder}/{name.replace('<->', '__')}"))


def export_graph(nodes: DataFrame, folder: str) -> None:
    own = schema.infer(nodes, keep_unlabelled=False)
    collapsed = frozenset(own.collapsible_groups())
    vertices, edges = sinks.export_vertices(nodes), sinks.export_edges(nodes)
    vertices.where(~F.col("label").isin(*collapsed) if collapsed else F.lit(True)).write.mode("overwrite").parquet(f"{folder}/vertices")
    hubs = vertices.where(F.col("label").isin(*collapsed)).select("id") if collapsed else vertices.limit(0).select("id")
    plain = edges.join(hubs.withColumnRenamed("id", "src"), "src", "left_anti").join(hubs.withColumnRenamed("id", "dst"), "dst", "left_anti")
    plain.select("src", "dst", "type").write.mode("overwrite").parquet(f"{folder}/edges")
    for group in sorted(collapsed):
        sinks.export_attributed_edges(edges, vertices, group).write.mode("overwrite").parquet(f"{folder}/edges_{group}")


#: A small clinical schema for synthetic instances.
EXAMPLE_GROUPS = [("Patient", ["name", "age", "sex"]), ("Treatment", ["drug", "dose"]), ("Exam", ["test", "result"])]
EXAMPLE_RELATIONS = [("Patient_Treatment", "Patient", "Treatment"), ("Patient_Exam", "Patient", "Exam")]


def generate(spark: SparkSession, size: int = 200) -> DataFrame:
    groups = spark.createDataFrame(EXAMPLE_GROUPS, "name string, entities array<string>")
    relations = spark.createDataFrame(EXAMPLE_RELATIONS, "name string, left string, right string")
    return rel.trees_as_nodes(lines.generate_instances(spark, groups, relations, size))


#: Tasks of the command line and their arguments; plug-ins are given as ``module:name``.
TASKS = {
    "load-document": ["path", "out"], "load-sql": ["url", "out"], "load-graph": ["vertices", "edges", "out"], "load-corpus": ["path", "out"],
    "simplify": ["path", "out"], "simplify-llm": ["path", "model", "out"], "cleanup": ["path", "out"], "inspect": ["path"], "compare": ["path", "other"],
    "generate": ["out"], "export-tables": ["path", "out"], "export-sql": ["path", "url"], "export-graph": ["path", "out"], "schema": ["path"],
    "cache-clear": ["cache"],
}
OPTIONS = {"load-corpus": [("--language", ""), ("--cache", None), ("--parser", "sylva.sources.text:flat_parser")], "load-sql": [("--sample", "0")]}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sylva")
    tasks = parser.add_subparsers(dest="task", required=True)
    for name, extra in TASKS.items():
        task = tasks.add_parser(name)
        for e in extra:
            task.add_argument(e)
        for option, default in OPTIONS.get(name, []):
            task.add_argument(option, default=default)
    a = parser.parse_args(arguments)
    from sylva.session import get_session

    spark = get_session()
    if a.task == "cache-clear":
        clear_cache(spark, a.cache)
        return
    if a.task.startswith("load-") or a.task == "generate":
        if a.task == "load-document":
            nodes = load_documents(spark, a.path)
        elif a.task == "load-sql":
            nodes = load_database(spark, a.url, sample=int(a.sample))
        elif a.task == "load-graph":
            nodes = load_graph(spark.read.parquet(a.vertices), spark.read.parquet(a.edges))
        elif a.task == "load-corpus":
            parse = imported(a.parser)
            nodes = load_corpus(spark, a.path, lambda: parse, a.language, a.cache, text.DEFAULT_ENTITY_NAMES, text.DEFAULT_EXCLUDED_ENTITIES)
        else:
            nodes = generate(spark)
        nodes.write.mode("overwrite").parquet(a.out)
        return
    nodes = lines.read_forest(spark, [a.path])
    if a.task == "simplify":
        run_simplify(nodes)[0].write.mode("overwrite").parquet(a.out)
    elif a.task == "simplify-llm":
        simplify_by_model(nodes, imported(a.model)).write.mode("overwrite").parquet(a.out)
    elif a.task == "cleanup":
        clean_up(nodes).write.mode("overwrite").parquet(a.out)
    elif a.task == "inspect":
        report.inspection(nodes).show(truncate=False)
    elif a.task == "compare":
        report.as_table(spark, report.compare(nodes, lines.read_forest(spark, [a.other]))).show(100, truncate=False)
    elif a.task == "schema":
        print(schema.infer(nodes).as_cfg())
    elif a.task == "export-tables":
        export_tables(nodes, a.out)
    elif a.task == "export-sql":
        database_sink.export_database(nodes, schema.infer(nodes, keep_unlabelled=False), a.url)
    elif a.task == "export-graph":
        export_graph(nodes, a.out)


if __name__ == "__main__":
    main()
