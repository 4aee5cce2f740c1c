"""Files are listed and read by tasks, with the rows of Spark's own reader, which keeps every name on the driver."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpuspark.operators import parse
from corpuspark.plans import ingest
from corpuspark.plans.base import Views

FILES = {
    "a.md": "é",
    "b.bin": "x",
    "empty.md": "",
    ".hidden.md": "x",
    "_hidden.md": "x",
    "_k=1.md": "x",
    "c.md._COPYING_": "x",
    "one two/ü %20.html": "<p>",
    "one two/[1].md": "x\n" * 5,
    "one two/three/4/5/6/deep.md": "y" * 1000,
    "_folder/x.md": "x",
    "_k=2/x.md": "x",
    "_metadata_/x.md": "x",
    "folder.md/x.html": "x",
}


def spark_reads(spark, path, pattern):
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return sorted((r.path, r.length, bytes(r.content)) for r in files.select("path", "length", "content").collect())


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "top of all"
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    (top / "no files").mkdir()
    return top


@pytest.mark.parametrize("batch", [1 << 22, 1])
@pytest.mark.parametrize("levels", [3, 1])
@pytest.mark.parametrize(("below", "pattern"), [("", "*"), ("", "*.{md,html}"), ("", "[a-c]?*"), ("/*", "*.md"), ("/one two", "*"), ("/a.md", "*"), ("/_hidden.md", "*"), ("/no files", "*"), ("/{one two,one two/three}", "*")])
def test_rows_are_those_of_sparks_reader(spark, folder, monkeypatch, below, pattern, levels, batch):
    monkeypatch.setattr(parse, "LEVELS", levels)
    monkeypatch.setattr(parse, "BATCH_BYTES", batch)
    got = [(r.path, r.size_bytes, bytes(r.content)) for r in parse.read_corpus(spark, f"{folder}{below}", pattern).collect()]
    assert sorted(got) == spark_reads(spark, f"{folder}{below}", pattern)


def test_the_driver_lists_no_files(spark, folder):
    assert parse.read_corpus(spark, str(folder)).inputFiles() == []


def test_what_arrow_does_not_open_is_read_by_spark(spark, folder, monkeypatch):
    monkeypatch.setattr(parse, "_opened", lambda uri: None)
    got = parse.read_corpus(spark, str(folder), "*.md")
    assert got.inputFiles() and sorted((r.path, r.size_bytes, bytes(r.content)) for r in got.collect()) == spark_reads(spark, str(folder), "*.md")


def test_a_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        parse.read_corpus(spark, f"{tmp_path}/none")


def test_only_texts_of_repeated_ids_are_shuffled(spark, monkeypatch, tmp_path):
    """All rows are files of their own, also of repeated ids and of none; each other text goes from its scan to its file."""
    given = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 50")
    odd = given.where("doc_id = 3").unionByName(given.where("doc_id = 7").withColumn("text", F.lit("other")))
    nameless = given.where("doc_id IN (1, 2)").withColumn("doc_id", F.lit(None).cast("long"))
    docs = given.unionByName(odd).unionByName(nameless).unionByName(given.where("doc_id = 9").withColumn("text", F.lit(None).cast("string")))
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(ingest.parse, "write_corpus", lambda files, path, real=parse.write_corpus: seen.append(files) or real(files, path))
    got = ingest.s1_files(Views(spark, str(tmp_path))).collect()
    want = docs.where("text IS NOT NULL").selectExpr("doc_id", "octet_length(text) + 1 AS size_bytes", "sha2(concat(text, chr(10)), 256) AS digest").collect()
    assert sorted(((r.file_id, r.size_bytes, r.digest) for r in got), key=repr) == sorted(map(tuple, want), key=repr)
    names = [r["name"] for r in seen[0].select("name").collect()]
    assert len(set(names)) == len(names) == len(got)
    plan = seen[0]._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Union":
        plan = plan.children().head()
    once, repeated = plan.children().apply(0).toString(), plan.children().apply(1).toString()
    assert "Window" not in once and "Window" in repeated
