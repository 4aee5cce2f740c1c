"""A corpus pipeline of four stages: toxicity, language ID, near-duplicates, packing.

Defined results, of every stage: an empty table gives no rows; all columns come through as they are, whatever their names; the last stage
returns its own. Null and empty texts: kept by toxicity (they are scored as texts without words), dropped by language (no letter), kept
by near-duplicates, packed as the end id alone. Repeated rows of an id: kept by the first two stages, one row after near-duplicates.
Rows without an id: kept by the first two, one for each different text after near-duplicates. Ties: of near-duplicates the least id
stays; of languages the alphabetically first counts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspark.llm import jaccard, langid, packing, toxicity
from corpuspark.llm.common import IdFilter, in_fold, quoted, stored, table

#: SQL can't express a trained classifier or a tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None
CACHED_PIECES = 1 << 20  # workers also hold what the stages before left


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns labels of the training rows among ``docs`` only."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~in_fold("doc_id", 5, 0))
    scored = toxicity.score(docs, model, docs.columns)
    return scored.where(F.col(quoted(scored.columns)[-1]) == 0).select(quoted(docs.columns))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that no language codes in fewer bits than the bare frequencies of bytes do: text in no
    known language. Short documents of several possible languages stay."""
    trees = langid.train(docs.where(~in_fold("doc_id", 4, 2)))
    found = langid.predict(docs, trees, docs.columns)
    lang, _, saved = map(F.col, quoted(found.columns)[-3:])
    return found.where((lang != langid.UNKNOWN) & (saved > 0)).select(quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; repeated rows of an id are one document. Rows without id are told apart by text."""
    gone = jaccard.near_duplicates(docs).where("NOT kept").select("doc_id")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    gone, again = stored(gone, "gone"), stored(again, "again")
    touched = IdFilter(gone.unionByName(again), "doc_id")  # all other rows stay where they are
    key = "only where the id is null"
    few = touched.maybe(docs).join(gone, "doc_id", "left_anti").withColumn(key, F.when(F.col("doc_id").isNull(), F.col("text")))
    few = few.dropDuplicates(["doc_id", key]).select(quoted(docs.columns))
    return touched.surely_not(docs).unionByName(few)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; see the packing operator for the columns."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cached=CACHED_PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
