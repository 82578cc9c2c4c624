"""Queries of the training-data operators: each applies one of them to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import alignment, bpe, decontaminate, language, licenses, manifest, minhash, oracles, passages, quality_model, quality_rules, toxicity, urlfilter, warc
from rankloom.llm.common import held_out, read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "keep": ["doc_id"]}
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents"), **how), **how)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digests(read(spark, sf_dir, "documents"), keep=["doc_id"], length=400, words=51)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.digests(found, ["doc_id"])


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.learn(docs, ~held_out(F.col("_id"), 3, 1))
    found = language.labelled(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


#: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*rows)))
    return urlfilter.judged(read(spark, sf_dir, "pages"), rules, keep=["page_id"])


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    weights = quality_model.fit(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("_id"), 5, 0))
    found = quality_model.scores(docs, weights, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read(spark, sf_dir, "pages"), key="page_id", url="url", payload="html")
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate("text", capitals, capitals.lower())
    return manifest.proofs(read(spark, sf_dir, "documents"), keep=["doc_id"], claims={"text": text}, changed=held_out(F.col("doc_id"), 5, 0))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    read_as = toxicity.readings(docs)
    weights = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("_id"), 5, 0), read_as)
    found = toxicity.scores(docs, weights, read_as, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = {"byte_path": public_tokenizers.path("byte_bpe_50k.json"), "piece_path": public_tokenizers.path("piece_bpe_32k.model")}
    return alignment.alignment(read(spark, sf_dir, "documents"), keep=["doc_id"], **how)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_minhash": op2_minhash,
    "op3_licenses": op3_licenses,
    "op4_language": op4_language,
    "op5_url_filter": op5_url_filter,
    "op6_quality_model": op6_quality_model,
    "op7_warc": op7_warc,
    "op8_suffix_array": op8_suffix_array,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontaminate": op10_decontaminate,
    "op11_manifest": op11_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_alignment": op13_alignment,
}
ORACLES = {
    "op2_minhash": oracles.OP2,
    "op5_url_filter": oracles.OP5,
    "op7_warc": oracles.OP7,
    "op10_decontaminate": oracles.OP10,
    "op11_manifest": oracles.OP11,
}
