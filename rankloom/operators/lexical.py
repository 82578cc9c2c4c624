"""BM25: postings with precomputed impacts, search and candidate scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.lineage import checked_broadcast, written
from rankloom.functions.ranking import best_first, ranked, rounded
from rankloom.functions.text import counted_tokens
from rankloom.operators import blockindex, termblocks

#: Terms whose document frequencies are sent to every executor at the most.
BROADCAST_TERMS = 1_000_000


@dataclass(frozen=True)
class Bm25:
    method: str = "lucene"
    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5


def impact(how: Bm25, tf: Column, dl: Column, avgdl: Column, n: Column, df: Column, ln: Callable = F.ln, greatest: Callable = lambda a, b: F.greatest(F.lit(a), b)) -> Column:
    """The score of one posting. Variants whose value at tf = 0 isn't 0 keep what exceeds it. With numpy's `ln` and `greatest`, of arrays and numbers."""
    length = 1 - how.b + how.b * dl / avgdl
    k = how.k1 * length
    if how.method == "lucene":
        return ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k)
    if how.method == "robertson":
        return ln(greatest(1.0, (n - df + 0.5) / (df + 0.5))) * tf / (tf + k)
    if how.method == "atire":
        return ln(n / df) * tf * (how.k1 + 1) / (tf + k)
    if how.method == "bm25l":
        c = tf / length
        at_zero = (how.k1 + 1) * how.delta / (how.k1 + how.delta)
        return ln((n + 1) / (df + 0.5)) * ((how.k1 + 1) * (c + how.delta) / (how.k1 + c + how.delta) - at_zero)
    if how.method == "bm25+":
        return ln((n + 1) / df) * ((how.k1 + 1) * tf / (k + tf))
    raise ValueError(f"unknown method {how.method}")


def counts(items: DataFrame) -> DataFrame:
    """(item_id, size, term, tf) of (item_id, text), written: texts are cut into tokens once, and what comes after reads only the columns it needs."""
    return written(counted_tokens(items, "item_id", "text"), "counts")


def postings(tf: DataFrame, n: int, how: Bm25 = Bm25()) -> DataFrame:
    """(item_id, term, tf, impact) from `counts` of n items. Items without tokens count in the mean length.

    Only terms are summed up over items; their document frequencies are broadcast where there are at most BROADCAST_TERMS, else joined by term.
    """
    df = written(tf.groupBy("term").agg(F.count("*").alias("df")))
    total = tf.agg(F.sum("tf")).first()[0] or 0
    x = lambda c: F.col(c).cast("double")
    whole = tf.join(checked_broadcast(df, BROADCAST_TERMS), "term")
    return whole.select("item_id", "term", "tf", impact(how, x("tf"), x("size"), F.lit(total / max(1, n)), F.lit(float(n)), x("df")).alias("impact"))


def scores(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of every item of the postings that shares a term; repeated query words count again.

    The query side is small as a rule, and the planner broadcasts it when it is; the postings stay where they are up to the partial sum.
    """
    wanted = counted_tokens(queries, "query_id", "query").select("query_id", "term", F.col("tf").alias("qtf"))
    return found.join(wanted, "term").groupBy("query_id", "item_id").agg(rounded(F.sum(F.col("impact") * F.col("qtf"))).alias("score"))


def search(index: blockindex.Index, queries: DataFrame, top: int = 100) -> DataFrame:
    """The best items of each (query_id, query); most postings stay unread, see `blockindex`."""
    return blockindex.search(index, counted_tokens(queries, "query_id", "query").select("query_id", "term", F.col("tf").alias("weight")), top)


def scan(made: DataFrame, n: int, queries: DataFrame, top: int = 100, how: Bm25 = Bm25()) -> DataFrame:
    """As `search`, for many (query_id, query) in one pass over the written `termblocks` of a catalog of n items; no index is needed."""
    avgdl = (made.agg(F.sum("total")).first()[0] or 0) / max(1, n)
    wanted = counted_tokens(queries, "query_id", "query").select("query_id", "term", F.col("tf").alias("weight"))
    return termblocks.search(made, wanted, lambda tf, size, df: impact(how, tf, size, avgdl, float(n), df, np.log, np.maximum), top, with_df=True)


def padded(run: DataFrame, items: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """`run` filled up to `top` rows a query with the least items that it lacks, at score 0. Only `top` + `top` items can matter."""
    least = items.select("item_id").orderBy("item_id").limit(2 * top)
    rest = queries.select("query_id").crossJoin(F.broadcast(least)).join(run.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(run.select("query_id", "item_id", "score").unionByName(rest), ["query_id"], *best_first(), top=top)


def candidate_scores(index: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of the given (query_id, item_id) only, 0 where nothing matches, from postings; other items' are dropped first."""
    near = index.join(pairs.select("item_id").distinct(), "item_id", "left_semi")
    found = scores(near, queries)
    return pairs.select("query_id", "item_id").join(found, ["query_id", "item_id"], "left").select("query_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def vocabulary_size(index: DataFrame) -> DataFrame:
    return index.agg(F.countDistinct("term").alias("n_terms"))
