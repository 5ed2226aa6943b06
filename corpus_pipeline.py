"""A training corpus from ``documents``: filter, deduplicate, clean, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microstar.llm import mixing, near_dup, pieces, secrets, toxicity
from microstar.llm.common import table, tokenizer
from microstar.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, learned from the labelled rows that are not held out."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    Near duplicates share 80 % of their five-word shingles or more.
    """
    return near_dup.keep_one(docs, like=near_dup.Likeness(percent=80))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked and ``n_chars`` follows."""
    return secrets.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each of its copies in the mix of sources."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: ``doc_id, source, lang, n_tokens, ids_sha256, decoded_sha256, library_agrees, ids``."""
    return pieces.encode_decode(docs, tokenizer("piece_bpe_32k.model"), keep=("source", "lang"), with_ids=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]

#: The rows cannot be expressed in SQL (trained scores, tokenizer); tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
