import io
import tarfile
import zipfile

import pytest

from sylva import pipelines
from sylva.operators import report, schema
from sylva.sources import archives, text

FILES = {"d/x.txt": b"Ann takes aspirin\nBo sleeps", "d/x.ann": b"T1\tPer 0 3\tAnn\nT2\tDrug 10 17\taspirin\nT3\tPer 18 20\tBo\n"}


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in FILES.items():
            z.writestr(n, c)
    return out.getvalue()


def tarred():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for n, c in FILES.items():
            info = tarfile.TarInfo(n)
            info.size = len(c)
            t.addfile(info, io.BytesIO(c))
    return out.getvalue()


def test_archives():
    assert dict(archives.members(zipped())) == dict(archives.members(tarred())) == FILES
    with pytest.raises(ValueError):
        list(archives.members(b"plain"))
    key = archives.cache_key("d", "en", exclude={"a", "b"}, mapping={"x": "y"})
    assert key == archives.cache_key("d", "en", mapping={"x": "y"}, exclude={"b", "a"}) != archives.cache_key("d", "fr", exclude={"a", "b"}, mapping={"x": "y"})


def test_corpus_with_cache(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/c.zip").write_bytes(zipped())
    calls = tmp_path / "calls"

    def make_parser():
        with calls.open("a") as f:
            f.write("x")
        return text.flat_parser

    run = lambda: pipelines.load_corpus(spark, f"file://{tmp_path}/in", make_parser, "en", f"file://{tmp_path}/cache", {"DRUG": "MEDICINE"})
    first = run()
    assert sorted(r["name"] for r in first.where("type = 'ENT'").collect()) == ["MEDICINE", "PER", "PER"]
    parsed = calls.read_text()
    assert run().count() == first.count() and calls.read_text() == parsed


def test_generate_export_and_compare(spark, tmp_path):
    nodes = pipelines.generate(spark, 4).cache()
    own = schema.infer(nodes)
    assert own.verify() and set(own.groups) == {"Patient", "Treatment", "Exam"}
    pipelines.export_tables(nodes, f"file://{tmp_path}/t")
    pipelines.export_graph(nodes, f"file://{tmp_path}/g")
    assert spark.read.parquet(f"file://{tmp_path}/t/Patient").count() == 12
    assert spark.read.parquet(f"file://{tmp_path}/g/edges").count() == 8
    metrics = report.compare(nodes, nodes)
    assert metrics["coverage"] == 1 and metrics["ratio_productions"] == 1 and metrics["cluster_completeness"] == 1
    assert report.as_table(spark, metrics).count() == len(metrics)
    assert report.inspection(nodes).first()["n_trees"] == 20
