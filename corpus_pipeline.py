"""From documents to a training mix, in stages that each read what the last one wrote.

Each stage bears nulls in any column, empty and very long texts, rows of equal
ids, repeated rows, empty tables and further columns of any name that does not
begin with ``__pw_``, as its docstring says; further columns come out as they
went in, but for ``mix_copies`` and ``mix_words``, which the last stage writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewise.llm import decontamination, mixing, secrets, simhash, toxicity
from pagewise.llm.common import delete, new_dir, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects (score 0.5 or more) go.

    Null and empty texts have the score of no evidence; repeated rows are scored
    alike, so all stay or all go. Without labels of both classes every document
    has the class share as its score. No documents: no rows.
    """
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: op9's links, and texts alike by 0.8 in shingles of five words.

    That is the one of the least id, null ids last, ties by hash of the row.
    Null and empty texts are one group; rows equal in every column count as one.
    No documents: no rows.
    """
    return simhash.keep_one(docs, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go.

    Null and empty texts hold none, so they stay; repeated rows all stay or all
    go; null items match nothing, and an empty benchmark takes no document.
    """
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced by a mark and ``n_chars`` is counted anew.

    Null texts stay null and empty ones empty; repeated rows are redacted alike.
    No documents: no rows.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often and how many words that makes.

    Null and empty texts have no words and go; a null source is a source of its
    own; rows equal in id and text are taken alike. No documents: no rows.
    """
    return mixing.taken(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
]

#: Hashes, a trained classifier and a forest are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    What a stage wrote is deleted once the next one has read it; the last
    stage's files stay, as the result reads them. No documents: no rows.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            delete(spark, before)
        before = at
    return docs
