"""Relevance evaluation of runs against graded labels.

Every metric starts from the list of queries, so that a query without results counts as it should.
qrels: (query_id, item_id, label). run: (query_id, method, item_id, rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.ranking import GRADED, LABELS, POOL_GAINS, mapped, quantiles, ranked, running, sampled_within

KS = [10, 20, 50]


def m(c: Column) -> Column:
    return F.round(c, 6)


def mean(c: Column | str) -> Column:
    """The mean of values of 6 decimals, rounded to 6 again: summed as whole millionths, so that a half is a half in whatever order."""
    return F.round(F.avg(F.round((F.col(c) if isinstance(c, str) else c) * 1e6).cast("long"))) / 1e6


def with_k(df: DataFrame, ks: list[int]) -> DataFrame:
    return df.withColumn("k", F.explode(F.array(*map(F.lit, ks))))


def each_query(methods: list[str], qrels: DataFrame, ks: list[int]) -> DataFrame:
    """(method, query_id, k) for every method and every query of the qrels."""
    named = qrels.select("query_id").distinct().withColumn("method", F.explode(F.array(*map(F.lit, methods)) if methods else F.array().cast("array<string>")))
    return with_k(named, ks)


def methods_of(run: DataFrame) -> list[str]:
    """The names of the few methods of a run; where they are known beforehand, pass them on instead."""
    return sorted(r["method"] for r in run.select("method").distinct().collect())


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    one = qrels.groupBy("query_id", "item_id").agg(F.max("label").alias("label"))
    return run.select("method", "query_id", "item_id", "rank").join(one, ["query_id", "item_id"], "left")


def recall(run: DataFrame, qrels: DataFrame, ks: list[int] = KS, methods: list[str] | None = None) -> DataFrame:
    """Per query: share of exact, and of exact or substitute items among the first k; no relevant item gives 0."""
    hits = with_k(judged(run, qrels), ks).where(F.col("rank") <= F.col("k"))
    found = lambda labels: F.countDistinct(F.when(F.col("label").isin(labels), F.col("item_id")))
    got = hits.groupBy("method", "query_id", "k").agg(found(["E"]).alias("e"), found(["E", "S"]).alias("es"))
    have = qrels.groupBy("query_id").agg(found(["E"]).alias("all_e"), found(["E", "S"]).alias("all_es"))
    rows = each_query(methods or methods_of(run), qrels, ks).join(got, ["method", "query_id", "k"], "left").join(have, "query_id")
    share = lambda a, b: m(F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0))
    return rows.select("method", "query_id", "k", share("e", "all_e").alias("recall_exact"), share("es", "all_es").alias("recall_exact_sub"))


def label_shares(run: DataFrame, qrels: DataFrame, ks: list[int] = KS, methods: list[str] | None = None) -> DataFrame:
    """Per query: shares of E, S, C, I and unlabelled among the rows retrieved up to k; nothing retrieved gives zeros."""
    rows = with_k(judged(run, qrels), ks).where(F.col("rank") <= F.col("k")).withColumn("label", F.coalesce("label", F.lit("unlabeled")))
    names = [*LABELS, "unlabeled"]
    got = rows.groupBy("method", "query_id", "k").agg(*[F.avg((F.col("label") == x).cast("double")).alias(x) for x in names])
    out = each_query(methods or methods_of(run), qrels, ks).join(got, ["method", "query_id", "k"], "left")
    return out.select("method", "query_id", "k", *[m(F.coalesce(x, F.lit(0.0))).alias(f"share_{x.lower()}") for x in names])


def retrieval(run: DataFrame, qrels: DataFrame, ks: list[int] = KS, methods: list[str] | None = None) -> DataFrame:
    """Means over all queries of the qrels, zeros included. `run` is used more than once: give it a written table."""
    methods = methods or methods_of(run)
    one = recall(run, qrels, ks, methods).join(label_shares(run, qrels, ks, methods), ["method", "query_id", "k"])
    columns = ["recall_exact", "recall_exact_sub", *[f"share_{x.lower()}" for x in [*LABELS, "unlabeled"]]]
    return one.groupBy("method", "k").agg(F.count("*").alias("num_queries"), *[mean(c).alias(c) for c in columns])


def curated(run: DataFrame, qrels: DataFrame, ks: list[int] = KS, gains: dict = POOL_GAINS, methods: list[str] | None = None) -> DataFrame:
    """Pool evaluation: the ideal comes from all labelled items, short lists have short denominators, and a
    query without results is counted but left out of the means; a method without any results has means of 0.

    `run` is used more than once: give it a written table."""
    methods = methods or methods_of(run)
    gain = lambda c: mapped(c, gains, F.lit(0.0))
    one = qrels.groupBy("query_id", "item_id").agg(F.max("label").alias("label"))
    ideal_rows = ranked(one.withColumn("g", gain(F.col("label"))), ["query_id"], F.col("g").desc(), F.col("item_id"), name="pos")
    ideal = with_k(ideal_rows, ks).where(F.col("pos") <= F.col("k")).groupBy("query_id", "k").agg(F.sum(F.col("g") / F.log2(F.col("pos") + 1)).alias("idcg"))
    rows = with_k(judged(run, qrels).withColumn("g", gain(F.coalesce("label", F.lit("I")))), ks).where(F.col("rank") <= F.col("k"))
    got = rows.groupBy("method", "query_id", "k").agg(
        F.sum(F.col("g") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.coalesce(1 / F.min(F.when(F.col("g") > 0, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.avg((F.col("g") > 0).cast("double")).alias("precision"),
    )
    out = each_query(methods, qrels, ks).join(got, ["method", "query_id", "k"], "left").join(ideal, ["query_id", "k"], "left").join(recall(run, qrels, ks, methods), ["method", "query_id", "k"])
    there = F.col("dcg").isNotNull()
    ndcg = F.when(there, F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0))
    over = lambda c, name: m(F.coalesce(F.avg(F.when(there, c)), F.lit(0.0))).alias(name)
    recalls = [F.coalesce(mean(F.when(there, F.col(c))), F.lit(0.0)).alias(c) for c in ("recall_exact", "recall_exact_sub")]
    return out.groupBy("method", "k").agg(F.count("*").alias("num_queries"), over(ndcg, "ndcg"), over(F.col("mrr"), "mrr"), over(F.col("precision"), "precision"), *recalls)


def positions(scored: DataFrame) -> DataFrame:
    """Candidates (query_id, method, item_id, label, score) with gain, position by score and position by gain."""
    rows = scored.withColumn("gain", mapped(F.col("label"), GRADED, F.lit(0)))
    by_score = ranked(rows, ["method", "query_id"], F.col("score").desc(), F.col("item_id"), name="pos")
    return ranked(by_score, ["method", "query_id"], F.col("gain").desc(), F.col("item_id"), name="ideal")


def candidate_metrics(scored: DataFrame, ks: list[int] = KS) -> DataFrame:
    """Per query and k: graded NDCG with the ideal of the same list, MRR, precision and label shares; a gain of 1 or more is relevant."""
    rows = with_k(positions(scored), ks)
    inside = F.col("pos") <= F.col("k")
    at = lambda p: F.sum(F.when(F.col(p) <= F.col("k"), F.col("gain") / F.log2(F.col(p) + 1)).otherwise(0.0))
    hit = inside & (F.col("gain") >= 1)
    share = lambda c: m(F.avg(F.when(inside, c.cast("double"))))
    return rows.groupBy("method", "query_id", "k").agg(
        m(F.when(at("ideal") > 0, at("pos") / at("ideal")).otherwise(0.0)).alias("ndcg"),
        m(F.coalesce(1 / F.min(F.when(hit, F.col("pos"))), F.lit(0.0))).alias("mrr"),
        share(F.col("gain") >= 1).alias("precision"),
        *[share(F.col("label") == x).alias(f"share_{x.lower()}") for x in LABELS],
    )


def separability(scored: DataFrame) -> DataFrame:
    """ROC AUC of the pooled scores of each method, E, S, C against I, ties half; one class only gives 0.

    Counts per distinct score come first; no task orders all scores of a method (see `running`).
    """
    pos = F.col("label").isin("E", "S", "C")
    by = scored.where(F.col("label").isin(LABELS)).groupBy("method", "score").agg(F.count("*").alias("n"), F.sum(pos.cast("long")).alias("p"))
    rows = running(by, ["method"], ["score"], "n").withColumn("rank_sum", F.col("p") * (F.col("before") + (F.col("n") + 1) / 2.0))
    total = rows.groupBy("method").agg(F.sum("rank_sum").alias("r"), F.sum("p").cast("double").alias("p"), F.sum(F.col("n") - F.col("p")).cast("double").alias("q"))
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return total.select("method", m(F.when((F.col("p") > 0) & (F.col("q") > 0), auc).otherwise(0.0)).alias("auc"))


def candidate_scoring(scored: DataFrame, ks: list[int] = KS) -> DataFrame:
    """Macro means of `candidate_metrics` and the pooled AUC."""
    columns = ["ndcg", "mrr", "precision", *[f"share_{x.lower()}" for x in LABELS]]
    means = candidate_metrics(scored, ks).groupBy("method", "k").agg(F.count("*").alias("num_queries"), *[mean(c).alias(c) for c in columns])
    return means.join(separability(scored), "method")


def score_stats(scored: DataFrame) -> DataFrame:
    rows = scored.where(F.col("label").isin(LABELS))
    middle = quantiles(rows, ["method", "label"], "score", {"median": 0.5})
    one = rows.groupBy("method", "label").agg(F.count("*").alias("n"), m(F.avg("score")).alias("mean"), m(F.stddev_pop("score")).alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))
    return one.join(middle, ["method", "label"]).select("method", "label", "n", "mean", m(F.col("median")).alias("median"), "std", "min", "max")


def method_comparison(scored: DataFrame) -> DataFrame:
    rows = candidate_scoring(scored, [10])
    return rows.select("method", F.col("ndcg").alias("ndcg_10"), F.col("mrr").alias("mrr_10"), F.col("precision").alias("precision_10"), F.round(100 * F.col("share_e"), 4).alias("e_pct_10"), F.round(100 * F.col("share_i"), 4).alias("i_pct_10"), "auc")


def curated_table(run: DataFrame, qrels: DataFrame, ks: list[int] = KS, methods: list[str] | None = None) -> DataFrame:
    rows = curated(run, qrels, ks, methods=methods)
    wide = rows.groupBy("method").pivot("k", ks).agg(F.first("ndcg"))
    first = rows.where(F.col("k") == ks[0]).select("method", F.col("mrr").alias(f"mrr_{ks[0]}"), "num_queries")
    return wide.select("method", *[F.col(f"`{k}`").alias(f"ndcg_{k}") for k in ks]).join(first, "method")


def score_quantiles(scored: DataFrame, at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    names = {f"q{int(p * 100)}": p for p in at}
    found = quantiles(scored.where(F.col("label").isin(LABELS)), ["method", "label"], "score", names)
    return found.select("method", "label", *[F.round(c, 9).alias(c) for c in names])


def score_points(scored: DataFrame, most: int = 50_000) -> DataFrame:
    """(method, label, query_id, item_id, score): the points behind a box plot, at most `most` of each method and label."""
    rows = scored.where(F.col("label").isin(LABELS)).select("method", "label", "query_id", "item_id", "score")
    return sampled_within(rows, ["method", "label"], F.concat_ws(":", "query_id", "item_id"), most)


def label_bars(scored: DataFrame, ks: list[int] = KS) -> DataFrame:
    rows = candidate_scoring(scored, ks)
    pairs = F.map_from_arrays(F.array(*map(F.lit, LABELS)), F.array(*[f"share_{x.lower()}" for x in LABELS]))
    return rows.select("method", "k", F.explode(pairs).alias("label", "share")).select("method", "k", "label", F.round(100 * F.col("share"), 4).alias("pct"))


def method_report(scored: DataFrame, ks: list[int] = KS) -> DataFrame:
    """Long form (method, metric, value), sorted."""
    rows = candidate_scoring(scored, ks)
    names = ["ndcg", "mrr", "precision"]
    pairs = F.map_from_arrays(F.array(*[F.concat(F.lit(f"{n}@"), F.col("k").cast("string")) for n in names]), F.array(*names))
    long = rows.select("method", F.explode(pairs).alias("metric", "value")).unionByName(rows.select("method", F.lit("auc").alias("metric"), F.col("auc").alias("value")).distinct())
    return long.orderBy("method", "metric")


def comparison_frame(scored: DataFrame, ks: list[int] = KS) -> DataFrame:
    """One wide row a method for a CSV sink."""
    rows = candidate_scoring(scored, ks)
    wide = rows.groupBy("method").pivot("k", ks).agg(F.first("ndcg").alias("ndcg"), F.first("share_e").alias("e"))
    return wide.join(rows.select("method", "auc").distinct(), "method").select("method", "auc", *[F.col(f"{k}_{c}").alias(f"{c}_{k}") for k in ks for c in ("ndcg", "e")])
