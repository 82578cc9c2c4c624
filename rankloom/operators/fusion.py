"""Run tables (query_id, method, item_id, score, rank): fusion, restriction, reranking, assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.ranking import mapped, ranked, rounded

RRF_K = 60
#: Method order and fusion weights.
METHODS = {"bm25": 0, "sparse": 1, "dense": 2}
WEIGHTS = {"bm25": 0.3, "sparse": 0.4, "dense": 0.3}


def method_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """One table of several methods' (query_id, item_id, score, rank), with method and method_ord in the given order."""
    parts = [r.select("query_id", F.lit(m).alias("method"), F.lit(i).alias("method_ord"), "item_id", "score", "rank") for i, (m, r) in enumerate(runs.items())]
    return reduce(DataFrame.unionByName, parts)


def rrf(run: DataFrame, k: int = RRF_K, top: int | None = 100) -> DataFrame:
    """Reciprocal rank fusion; ties go to the earliest list and its rank. A repeat within a list adds again."""
    fused = run.groupBy("query_id", "item_id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 12).alias("score"), F.min(F.struct("method_ord", "rank")).alias("_first"))
    return ranked(fused, ["query_id"], F.col("score").desc(), F.col("_first"), F.col("item_id"), top=top).drop("_first")


def needs_methods(run: DataFrame, least: int) -> DataFrame:
    """`run`, or nothing if it has fewer than `least` methods."""
    n = run.agg(F.countDistinct("method").alias("_n"))
    return run.crossJoin(F.broadcast(n)).where(F.col("_n") >= least).drop("_n")


def minmax(run: DataFrame) -> DataFrame:
    """Scores scaled to [0, 1] within query and method; a range under 1e-10 gives 0.5."""
    w = Window.partitionBy("query_id", "method")
    low, spread = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return run.withColumn("norm", rounded(F.when(spread < 1e-10, 0.5).otherwise((F.col("score") - low) / spread)))


def weighted(run: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Sum of weight * scaled score; a method that lacks the item adds nothing, an unknown one weighs 0."""
    w = mapped(F.col("method"), weights, F.lit(0.0))
    return minmax(run).groupBy("query_id", "item_id").agg(rounded(F.sum(w * F.col("norm")), 9).alias("score"))


def pool_restricted(run: DataFrame, pool: DataFrame, depth: int = 250, top: int = 50) -> DataFrame:
    """The first `depth` rows of each list that are in the pool, ranked anew and cut to `top`."""
    kept = run.where(F.col("rank") <= depth).join(pool, "item_id", "left_semi")
    return ranked(kept.withColumnRenamed("rank", "_was"), ["query_id", "method"], F.col("_was"), top=top).drop("_was")


def reranked(run: DataFrame, lexical: DataFrame, depth: int = 1000) -> DataFrame:
    """The same rows in the order of their lexical score (missing: 0); ties keep the run's order."""
    scores = lexical.where(F.col("rank") <= depth).select("query_id", "item_id", F.col("score").alias("lexical"))
    joined = run.withColumnRenamed("rank", "_was").join(scores, ["query_id", "item_id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    return ranked(joined, ["query_id", "method"], F.col("lexical").desc(), F.col("_was"))


def candidate_run(scored: dict[str, DataFrame]) -> DataFrame:
    """All candidates ranked by each method's (query_id, item_id, score)."""
    return method_runs({m: ranked(s, ["query_id"], F.col("score").desc(), F.col("item_id")) for m, s in scored.items()})


def side_by_side(run: DataFrame, texts: DataFrame, top: int = 10) -> DataFrame:
    """Each method's first rows and their fusion, with 100 characters of text, ??? where there is none."""
    shown = run.where(F.col("rank") <= top)
    fused = rrf(shown, top=top).select("query_id", F.lit("rrf").alias("method"), "item_id", "rank")
    rows = shown.select("query_id", "method", "item_id", "rank").unionByName(fused)
    short = texts.select("item_id", F.substring("text", 1, 100).alias("text"))
    return rows.join(short, "item_id", "left").select("query_id", "method", "rank", "item_id", F.coalesce("text", F.lit("???")).alias("text"))


def merged_results(scoring: DataFrame, retrieval: DataFrame) -> DataFrame:
    """One row a method: (method, ndcg_10, auc) beside (method, recall_10); a method without scoring has AUC 0."""
    both = scoring.join(retrieval, "method", "full_outer")
    return both.select("method", "ndcg_10", F.coalesce("auc", F.lit(0.0)).alias("auc"), "recall_10")
