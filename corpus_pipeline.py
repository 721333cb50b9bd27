"""Corpus pipeline: documents to token ids, each stage on all that its predecessor kept.

Stages write Parquet tables into the shared folder of ``spark.checkpoint.dir`` and read them again;
a lost executor costs the running stage's tasks only.  A stage's table is deleted once the next
stage has written its own; the last stage's table stays for the returned DataFrame.

Defined cases.  Null, empty and letterless texts have no language and go.  Rows without a doc_id are judged like others; equal
ones are near copies of each other.  Rows that repeat a doc_id with one text: one stays; with different texts: see
``neardup.keep_one``.  No document with a label: no language is known and all go.  Empty ``documents``: no rows.  Empty ``benchmark``:
all clean.  Very long texts are read whole.  Further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridelens.llm import decontaminate, language, neardup, pii, tokens
from ridelens.llm.common import delete_path, table
from ridelens.session import shared_path

#: A document is in no language that the labels name if its best cosine is lower than ``SCORE_PER_NGRAM``
#: times the number of its different n-grams, but ``LEAST_SCORE`` at least and ``MOST_SCORE`` at most.  Cosines of
#: unrelated vectors spread by 1/32; clean texts of a few words come down to 0.07, long ones hardly to 0.4.
LEAST_SCORE = 0.03
SCORE_PER_NGRAM = 0.002
MOST_SCORE = 0.25


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels name; others, and texts without a letter, go."""
    prototypes = language.train(docs.filter(~language.held_out()))
    return language.keep_known(docs, prototypes, LEAST_SCORE, SCORE_PER_NGRAM, MOST_SCORE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return neardup.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no segment of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs, pii.train(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding gives its text again."""
    return tokens.encode(docs)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("benchmarks", without_benchmarks),
    ("personal_data", without_personal_data),
    ("tokens", token_ids),
]

# Cosines of random vectors and alignments have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs


QUERIES = {"pipeline": run}
ORACLE_SQL_BY_QUERY = {"pipeline": ORACLE_SQL}
