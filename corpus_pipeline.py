"""A training corpus out of raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents, whatever other columns there are and however
they are named; the last returns the encoded corpus. Every stage takes an empty table and
gives one, and reads very long texts whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftcast.llm import bpe, decontam, exact, ngram_join, quality
from weftcast.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality classifier rejects go.

    Null and empty texts score as the labels' share of good ones (0.5 without labels) and stay or go by that
    like others. Rows with a null doc_id are scored like others; rows that repeat share their fate; a score at
    the threshold stays. Without usable labels every score is 0.5, or 1 if all labels are good.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the row with the largest doc_id stays.

    Null and empty texts are equal to each other. A null doc_id owns a text only if no other does. Rows that repeat
    both doc_id and text stay or go together.
    """
    return exact.deduplicated(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies stays, that with the least doc_id.

    Null and empty texts are near nothing and stay. A null doc_id names a group only if no other can; rows of the
    group's doc_id with other texts than its own are told apart by their text. A similarity of just 0.8 is near.
    Rows that repeat both doc_id and text stay together.
    """
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that leak a benchmark item go.

    Null and empty texts leak nothing and stay, as do documents that share too little with any item; items with a null
    id count, items with a null text or fewer than five words don't. Rows that repeat share their fate, whatever their doc_id.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the token ids of every document.

    Null and empty texts have none. Every row gives a row, repeated ones and those with a null doc_id too; special
    tokens in a text are ordinary text.
    """
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("decoded")


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("byte-level BPE", encode)]

#: SQL can't express the classifier or the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
