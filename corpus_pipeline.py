"""A training-data pipeline over the documents table; counted as part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact, minhash, pii, queries, toxicity
from lectern.llm.common import columns, saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.

    Null and empty texts score as texts without votes do, and stay unless most labels are toxic; rows that share a doc_id
    are scored each; an empty table, or one without labels, loses nothing; columns beside those of documents are left out.
    """
    docs = columns(docs, *COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id stays.

    Null counts as empty, so of all null and empty texts one doc_id stays; rows that share doc_id and text stay together;
    an empty table gives an empty result; columns beside those of documents are left out.
    """
    return exact.drop_copies(columns(docs, *COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the smallest doc_id stays.

    Null and empty texts link with nothing and stay; a text of fewer than five words is one shingle; rows that share a
    doc_id are one document and stay or go together; rows without a doc_id stay; an empty table gives an empty result;
    columns beside those of documents are left out.
    """
    return minhash.drop_near(columns(docs, *COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows.

    No row goes; a null text stays null, as does its n_chars; rows that share a doc_id are read each; an empty table gives an
    empty result; columns beside those of documents are left out.
    """
    return pii.redact(columns(docs, *COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 1,024 tokens.

    A null or empty text is its end token alone; long texts are cut into pieces; rows that share a doc_id, or have none,
    are packed each; an empty table gives an empty result.
    """
    return queries.packed(columns(docs, "doc_id", "text"))


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("minhash near-dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name.replace(" ", "-"))
    return docs


#: SQL can't express a trained score, BPE or the packing program; tests/llm holds the rows against brute force.
ORACLE_SQL = None
