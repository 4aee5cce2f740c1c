"""Files written one for each row and read back."""

from pyspark.sql import functions as F

from corpuspark.operators import parse


def test_one_file_a_row_in_few_folders(spark, tmp_path):
    texts = ["\n", "one\r\ntwo", "Grüße\n"] * 200
    rows = spark.createDataFrame([(f"{k}.md", t) for k, t in enumerate(texts)], "name string, content string").repartition(3)
    path = f"file://{tmp_path}/files"
    for _ in range(2):  # a repetition writes the same files
        parse.write_corpus(rows, path)
    got = {r["name"]: r.text for r in parse.read_corpus(spark, path, "*.md").collect()}
    assert got == {f"{k}.md": t for k, t in enumerate(texts)}
    folders = parse.read_corpus(spark, path).select(F.regexp_extract("path", "(.*)/", 1)).distinct().count()
    assert folders <= parse.FOLDERS < len(texts)
