"""Learned-sparse vectors as rows (item_id, term, weight)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.lineage import exists
from rankloom.functions.ranking import best_first, ranked, rounded
from rankloom.operators import blockindex, encoding


def pooled(logits: DataFrame) -> DataFrame:
    """Weights > 0 of (item_id, position, term_id, logit, mask): the greatest log1p(relu(logit)) * mask over positions."""
    w = F.max(F.log1p(F.greatest(F.col("logit"), F.lit(0.0))) * F.col("mask"))
    return logits.groupBy("item_id", "term_id").agg(rounded(w).alias("weight")).where("weight > 0")


def normalised(vectors: DataFrame, vocabulary: int) -> DataFrame:
    """(item_id, term_id, weight) of rows that hold a map, index and value arrays, or a dense array.

    Of repeated indices the later one counts; zeros and terms beyond the vocabulary are dropped.
    """
    pairs = F.coalesce(
        F.map_entries("as_map"),
        F.transform(F.arrays_zip("indices", "values"), lambda p: F.struct(p["indices"].alias("key"), p["values"].alias("value"))),
        F.transform("dense", lambda w, i: F.struct(i.alias("key"), w.alias("value"))),
    )
    rows = vectors.select("item_id", F.posexplode(pairs).alias("at", "pair")).select("item_id", "at", F.col("pair.key").alias("term_id"), F.col("pair.value").alias("weight"))
    last = rows.groupBy("item_id", "term_id").agg(F.max_by("weight", "at").alias("weight"))
    return last.where((F.col("weight") != 0) & (F.col("term_id") >= 0) & (F.col("term_id") < vocabulary))


def scores(items: DataFrame, queries: DataFrame, term: str = "term") -> DataFrame:
    """Dot products of (query_id, term, weight) with (item_id, term, weight) where they are not empty."""
    q = queries.select("query_id", term, F.col("weight").alias("qw"))
    return items.join(q, term).groupBy("query_id", "item_id").agg(rounded(F.sum(F.col("weight") * F.col("qw"))).alias("score"))


def log_counts(tf: np.ndarray, size: np.ndarray, df: float) -> np.ndarray:
    """Weights of a stand-in model, for `termblocks.search`."""
    return np.round(np.log(1.0 + tf), 6)


def raw_counts(tf: np.ndarray, size: np.ndarray, df: float) -> np.ndarray:
    return tf


def search(index: blockindex.Index, queries: DataFrame, top: int = 100) -> DataFrame:
    """The best items of each query (query_id, term, weight); the index's impacts are the items' weights. Most postings stay unread."""
    return blockindex.search(index, queries.select("query_id", "term", "weight"), top)


def candidate_scores(items: DataFrame, queries: DataFrame, pairs: DataFrame, term: str = "term") -> DataFrame:
    near = items.join(pairs.select("item_id").distinct(), "item_id", "left_semi")
    return pairs.select("query_id", "item_id").join(scores(near, queries, term), ["query_id", "item_id"], "left").select("query_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def expansion(queries: DataFrame, own_tokens: DataFrame, top: int = 20) -> DataFrame:
    """The strongest terms of each query, whether they stand in it (a leading ## aside), and its number of terms."""
    count = queries.where("weight > 0").groupBy("query_id").agg(F.count("*").alias("n_terms"))
    first = ranked(queries.where("weight > 0"), ["query_id"], F.col("weight").desc(), F.col("term"), top=top)
    bare = first.withColumn("token", F.regexp_replace("term", "^##", ""))
    there = own_tokens.select("query_id", F.col("term").alias("token")).distinct().withColumn("own", F.lit(True))
    kind = F.when(F.col("own"), "ORIGINAL").otherwise("EXPANDED")
    return bare.join(there, ["query_id", "token"], "left").join(count, "query_id").select("query_id", "term", "weight", "rank", kind.alias("kind"), "n_terms")


def stats(vectors: DataFrame, items: DataFrame, vocabulary: int) -> DataFrame:
    n = items.agg(F.count("*").alias("n_rows")).crossJoin(vectors.agg(F.count("*").alias("nnz")))
    return n.select("n_rows", "nnz", F.round(F.col("nnz") / (F.col("n_rows") * F.lit(float(vocabulary))), 12).alias("density"))


def by_variant(items: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """Search within each variant (`model` on both sides)."""
    q = queries.select("model", "query_id", "term", F.col("weight").alias("qw"))
    s = items.join(q, ["model", "term"]).groupBy("model", "query_id", "item_id").agg(rounded(F.sum(F.col("weight") * F.col("qw"))).alias("score"))
    return ranked(s, ["model", "query_id"], *best_first(), top=top)


def first_available(run: DataFrame, priority: DataFrame) -> DataFrame:
    """The rows of the variant of least priority that has any; `priority`: model, priority."""
    best = run.select("model").distinct().join(priority, "model").agg(F.min_by("model", "priority").alias("model"))
    return run.join(F.broadcast(best), "model", "left_semi")


def missing(texts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be encoded."""
    return texts.join(done.select(key).distinct(), key, "left_anti")


def resumed(texts: DataFrame, key: str, text: str, make_encoder: Callable[[], Callable[[list[str]], encoding.Sparse]], path: str, batches: int = 4) -> DataFrame:
    """(key, term_id, weight) of all texts, encoding only those that `path` lacks, one of `batches` parts after another.

    Each part is appended as (key, term_ids, weights), a row for every text, also one without terms, so that a run which was broken
    off goes on after its last whole part. What a part left unfinished Spark's writer never shows.
    """
    spark = texts.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(batches))
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, term_ids array<int>, weights array<double>"
    for i in range(batches):
        todo = texts.where(part == i)
        if exists(spark, path):
            todo = missing(todo, spark.read.schema(schema).parquet(path), key)
        encoding.sparse(todo, key, text, make_encoder).write.mode("append").parquet(path)
    return encoding.opened(spark.read.schema(schema).parquet(path), key)
