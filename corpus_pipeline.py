"""From raw documents to packed training sequences: each stage takes the table that the one before it wrote.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns of
any name; what it does with them is said where the stage's operator is defined, and in short at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.exact_dedup import exact_dedup
from loomtext.llm.minhash import without_near_duplicates
from loomtext.llm.mixing import mixed
from loomtext.llm.packing import packed
from loomtext.llm.quality import good_documents
from loomtext.llm.queries import TARGETS, labelled_domains
from loomtext.llm.storage import discard, fresh, written
from loomtext.llm.token_counts import token_counts


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, and so do null and blank texts. Equal rows fare alike; null ids are no obstacle."""
    (score,) = fresh(docs.columns, "score")
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score_col=score).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays; null texts equal each other, and a null id loses to any other. Of repeated rows one stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays. Rows without id, text or words are nobody's duplicates; rows of one id go or stay together."""
    return without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the target shares of the languages ask, some not at all and some twice. Null and blank texts are taken once."""
    return mixed(docs, labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences, in tokens of the vocabulary. A row without tokens has no pack."""
    return packed(token_counts(docs), length=F.col("n_tokens"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix),
    ("packing", pack),
]

#: The classifiers are fitted and the candidates hashed, which SQL cannot state; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left of ``documents``; each stage's table is deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
