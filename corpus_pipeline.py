"""The corpus pipeline: stages over ``documents``, each a call of one operator.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, other
columns with them, whatever their names.  Every stage reads whole texts, however long, takes a null
text as empty, and gives no rows for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vgraph.llm import toxicity as tox
from vgraph.llm.common import materialize
from vgraph.llm.exact_dedup import drop_exact_duplicates
from vgraph.llm.mixing import mixed
from vgraph.llm.near_text import drop_near_texts
from vgraph.llm.packing import pack


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the training fold of the labels, predicts as toxic go.

    Repeated rows and ties are judged by their texts alone; rows with a null id stay or go likewise;
    without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(tox.fold() != 0)
    scored = tox.score(docs, tox.fit(docs, labels))
    return scored.where("predicted = 0").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, of these the smallest id, null last; of fully equal rows one."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by five-word shingles at 0.8 stays, that with the smallest id; rows with a null id stay."""
    return drop_near_texts(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2 in turn and share 150% of all words, at most two epochs each.

    A null source is one of its own; rows equal in id and size are taken alike.
    """
    return mixed(docs, (3, 1, 2), 1.5, 2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 1024; every row, repeated ones and null ids too, is a document."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Fingerprints, tokens and the model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
