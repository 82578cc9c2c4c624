"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, token ids.

Each stage takes what its predecessor kept and returns the columns of `documents`; the last one adds
the token ids. `run` applies them one after another, each written as Parquet to the folder that all
executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.lineage import new_path
from rankloom.llm import bpe, decontaminate, minhash, passages, quality_rules
from rankloom.llm.common import plain_names, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept. Texts without words fail; copies in one language share a verdict; a null language is one of its own."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more): the one with the smallest id.

    Documents without words stay. A null id comes last; of rows that agree on everything one stays."""
    return minhash.one_of_each(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages of more than 50 words, or of 400 bytes, that stand anywhere else.

    No occurrence stays, so of copies nothing is left; a text can become empty. n_chars follows the text."""
    return passages.deduplicated(docs, words=51).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: ten words in a row, or all of an item of fewer. Repeated rows go or stay together."""
    plain, new = plain_names(docs)
    found = decontaminate.contamination(plain, read(spark, sf_dir, "benchmark"), keep=plain.columns, text=new["text"])
    return found.where(F.size("_runs") == 0).select(*plain.columns).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, the digest of their ids and that of the bytes these decode to. Empty texts have no ids."""
    import public_tokenizers

    how = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "keep": docs.columns}
    return bpe.digests(bpe.encode(docs, **how), **how)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", benchmark_passages),
    ("byte_level_bpe", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = new_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
