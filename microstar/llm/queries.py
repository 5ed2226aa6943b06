"""The registered queries of this subpackage: each operator over its whole given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microstar.llm import (decontamination, mixing, near_dup, neighbours, pieces, repetition, secrets, spellings, substrings,
                           token_files, toxicity, vector_codes, warc)
from microstar.llm.common import table, tokenizer


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by merges and decoded again, checked against the library."""
    return pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors, by inner product, of every vector whose id 20 divides."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without those under 20-word windows that start earlier elsewhere."""
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back from the archives."""
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids written to seekable files in id order, then read back."""
    return token_files.write_and_read(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 by systematic sampling."""
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets and linked weak credential parts of every whole text."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-array repetition rules over every whole text."""
    return repetition.quality(table(spark, sf_dir, "documents"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: Jaccard 0.85 or more on five-word shingles."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents under 10-word windows of benchmark items."""
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as 16 codebook indexes each."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent word one edit away that they vary."""
    return spellings.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_neighbours": op2_neighbours,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_token_files": op6_token_files,
    "op7_mixing": op7_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_repetition": op9_repetition,
    "op10_near_dup": op10_near_dup,
    "op11_decontaminate": op11_decontaminate,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE = {
    "op5_warc": warc.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op11_decontaminate": decontamination.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
