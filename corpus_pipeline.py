"""A training corpus from raw documents, in stages that each work on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from lamina.llm.common import Scratch, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts and repeated rows are scored like others.

    Without labels of both kinds all rows stay; an empty table stays empty; other columns, whatever their names, are kept.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (without ASCII white space; null counts as empty) the one with the most code points stays, then the
    smallest doc_id (null first), then one of rows that repeat. An empty table stays empty; other columns are kept."""
    return exact_dedup.drop_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row of the smallest doc_id stays (a null id only where there is no other),
    of rows that repeat one. Texts without words, null too, are one group. An empty table stays empty; other columns are kept."""
    return simhash.drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages over the allowed share go. Null and empty texts hold none; rows that repeat
    are judged alike; without items all rows stay; an empty table stays empty; other columns are kept."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding them: the rows' digests as in op1. A null or empty text has no ids;
    each row, repeated ones too, gives one; an empty table gives none."""
    return bpe.digests(bpe.encode(docs, *bpe.vocabulary(), decoded=True))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("simhash_dedup", remove_near_copies),
    ("decontaminate", remove_contaminated),
    ("byte_bpe", tokenize),
]

#: Toxicity scores can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
