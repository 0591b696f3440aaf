"""From raw documents to token ids: language ID, exact and near dedup, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the docs of the next.  All but the last return the columns of documents.  A
stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe import digests, encode
from plumbline.llm.common import Scratch, col
from plumbline.llm.exact_dedup import drop_copies
from plumbline.llm.language import identify, learn_from
from plumbline.llm.mixing import take
from plumbline.llm.near_dedup import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or with a narrow margin go."""
    found = identify(docs, learn_from(docs))
    return found.filter(f"{found.columns[-1]}.accepted").select(*[col(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, packed as little-endian unsigned 32-bit integers, and their digests."""
    return digests(encode(docs.select("doc_id", "source", "text")), "source", "ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("tokens", tokens)]
#: SQL can't express the compression, the signatures or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over documents; each result goes through the shared folder, until the next is written."""
    room = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = room.put(name, stage(spark, docs, sf_dir))
        if before:
            room.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
