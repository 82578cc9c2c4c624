"""Label expansion: choosing queries, pairs to label, the store, and agreement with given labels."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.lineage import checked_broadcast, delete, exists, written
from rankloom.functions.ranking import LABELS, quantiles, ranked, sample_order
from rankloom.functions.text import filled

PROMPT = "Query: {query}\nProduct: {text}\nAnswer with one letter: E (exact), S (substitute), C (complement) or I (irrelevant)."
#: Dollars for a million input and output tokens, tokens of a call, calls a second.
PRICE_IN, PRICE_OUT, TOKENS_IN, TOKENS_OUT, RATE = 0.10, 0.40, 400, 2, 1.8

#: Ids that are sent to every executor at the most.
SENT = 1_000_000

STORE = "query_id string, item_id string, label string, labeled_at timestamp"


def upserted(store: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (query_id, item_id): the latest, and of the same time the greatest label."""
    both = store.unionByName(new)
    return ranked(both, ["query_id", "item_id"], F.col("labeled_at").desc(), F.col("label").desc(), top=1, name="_r").drop("_r")


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("query_id", "item_id"), F.lit(buckets)).cast("int").alias("bucket")


def append(new: DataFrame, store: str, buckets: int = 64) -> None:
    """Add rows to a store in buckets; nothing that is there is read or written. Its number of buckets must stay the same."""
    new.select(*[f.split()[0] for f in STORE.split(", ")], bucket(buckets)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(store)


def latest(spark: SparkSession, store: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a store in buckets as `upserted` would leave them; of some buckets only, if named. An empty store has none."""
    if not exists(spark, store):
        return spark.createDataFrame([], STORE)
    rows = spark.read.schema(f"{STORE}, bucket int").parquet(store)
    rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
    return upserted(rows.drop("bucket"), rows.drop("bucket").limit(0))


def compact(spark: SparkSession, store: str, most_files: int = 1) -> list[int]:
    """Rewrite the buckets of more than `most_files` files as their latest rows; returns these buckets.

    The new file stands beside the old ones before they are deleted, and reading takes the latest row of each key, so that a
    run which is broken off changes no result. Nothing else may append to the store meanwhile.
    """
    old: dict[int, list[str]] = {}
    for name in spark.read.parquet(store).inputFiles():
        old.setdefault(int(name.rpartition("bucket=")[2].partition("/")[0]), []).append(name)
    touched = sorted(b for b, names in old.items() if len(names) > most_files)
    for b in touched:
        rows = spark.read.schema(STORE).parquet(*old[b])
        upserted(rows, rows.limit(0)).withColumn("bucket", F.lit(b)).coalesce(1).write.mode("append").partitionBy("bucket").parquet(store)
        delete(spark, old[b])
    return touched


def looked_up(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """The pairs with their stored label, null if there is none."""
    keys = pairs.select(F.col("query_id").cast("string").alias("query_id"), F.col("item_id").cast("string").alias("item_id"))
    return keys.join(store.select("query_id", "item_id", "label"), ["query_id", "item_id"], "left")


def store_stats(store: DataFrame) -> DataFrame:
    return store.groupBy("label").agg(F.count("*").alias("n"))


def from_nested(text: DataFrame) -> DataFrame:
    """Rows of a store kept as JSON {labels: {query: {item: {label, timestamp}}}}; column `value`."""
    parsed = text.select(F.from_json("value", "labels map<string,map<string,struct<label:string,timestamp:string>>>").alias("s"))
    queries = parsed.select(F.explode("s.labels").alias("query_id", "items"))
    return queries.select("query_id", F.explode("items").alias("item_id", "x")).select("query_id", "item_id", "x.label", F.to_timestamp("x.timestamp").alias("labeled_at"))


def disagreement(run: DataFrame, queries: DataFrame, depth: int = 50, methods: list[str] | None = None) -> DataFrame:
    """Mean over pairs of methods of 1 - Jaccard of their first items; 0 with fewer than two methods.

    A method of the run that found nothing for a query has an empty set there, at distance 1 from any that is not;
    two empty sets are at distance 0. A query with null or empty text, where there is a column `query`, has 0.
    A query's intersections come from how many lists hold each item, by pairs of the few methods.
    """
    methods = methods or sorted(r["method"] for r in run.select("method").distinct().collect())
    sets = run.where(F.col("rank") <= depth).select("query_id", "method", "item_id").distinct()
    sizes = sets.groupBy("query_id").agg(*[F.sum((F.col("method") == x).cast("long")).alias(f"n{i}") for i, x in enumerate(methods)])
    held = sets.groupBy("query_id", "item_id").agg(*[F.max((F.col("method") == x).cast("long")).alias(f"h{i}") for i, x in enumerate(methods)])
    pairs = [(i, j) for j in range(len(methods)) for i in range(j)]
    if not pairs:
        return queries.select("query_id", F.lit(0.0).alias("disagreement"))
    common = held.groupBy("query_id").agg(*[F.sum(F.col(f"h{i}") * F.col(f"h{j}")).alias(f"c{i}_{j}") for i, j in pairs])
    both = sizes.join(common, "query_id")
    union = lambda i, j: F.col(f"n{i}") + F.col(f"n{j}") - F.col(f"c{i}_{j}")
    each = [F.when(union(i, j) > 0, 1 - F.col(f"c{i}_{j}") / union(i, j)).otherwise(0.0) for i, j in pairs]
    found = both.select("query_id", (sum(each[1:], each[0]) / len(pairs)).alias("d"))
    wanted = queries.where(F.length("query") > 0) if "query" in queries.columns else queries
    found = found.join(wanted.select("query_id"), "query_id", "left_semi")
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.round(F.coalesce("d", F.lit(0.0)), 6).alias("disagreement"))


def with_cache(cache: DataFrame, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached values, and computed ones for the wanted queries that the cache lacks."""
    rest = wanted.join(cache.select("query_id"), "query_id", "left_anti")
    return cache.join(wanted.select("query_id"), "query_id", "left_semi").unionByName(compute(rest))


def chosen(scores: DataFrame, most: int, share: float = 0.6, seed: int = 42) -> DataFrame:
    """(query_id, disagreement): the int(most * share) highest, the rest drawn from the others by hash order."""
    high = int(most * share)
    top = scores.orderBy(F.col("disagreement").desc(), "query_id").limit(high)
    others = scores.join(top.select("query_id"), "query_id", "left_anti")
    drawn = others.withColumn("_o", sample_order(F.col("query_id"), seed)).orderBy("_o", "query_id").limit(most - high).drop("_o")
    return top.unionByName(drawn)


def labelled_items(selected: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, item_id, label) of the selected queries that have labelled items."""
    rows = qrels.select("query_id", "item_id", "label").join(selected.select("query_id"), "query_id", "left_semi")
    return rows.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "item_id", "label")


def disagreement_stats(scores: DataFrame, selected: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6)
    spread = quantiles(selected, [], "disagreement", {"p50_chosen": 0.5, "p90_chosen": 0.9}).select(r("p50_chosen").alias("p50_chosen"), r("p90_chosen").alias("p90_chosen"))
    return scores.agg(r(F.avg("disagreement")).alias("mean_all")).crossJoin(selected.agg(r(F.avg("disagreement")).alias("mean_chosen"))).crossJoin(spread)


def pairs_to_label(run: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct (query_id, item_id) of all methods that the store lacks, as strings."""
    pairs = run.select(F.col("query_id").cast("string").alias("query_id"), F.col("item_id").cast("string").alias("item_id")).distinct()
    return pairs.join(store.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")


def pair_counts(run: DataFrame, store: DataFrame) -> DataFrame:
    total = run.select("query_id", "item_id").distinct().agg(F.count("*").alias("total"))
    new = pairs_to_label(run, store).agg(F.count("*").alias("new"))
    return total.crossJoin(new).select("total", (F.col("total") - F.col("new")).alias("already"), "new")


def prompts(pairs: DataFrame, queries: DataFrame, texts: DataFrame, template: str = PROMPT) -> DataFrame:
    """(query_id, item_id, prompt) of the pairs that have both texts; all ids as strings. Texts of other items are left where they are read."""
    pairs = written(pairs)
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "query")
    items = written(pairs.select("item_id").distinct())
    t = texts.select(F.col("item_id").cast("string").alias("item_id"), "text").join(checked_broadcast(items, SENT), "item_id", "left_semi")
    both = pairs.join(q, "query_id", "left").join(t, "item_id", "left").where((F.length("query") > 0) & (F.length("text") > 0))
    return both.select("query_id", "item_id", filled(template, {"query": F.col("query"), "text": F.col("text")}).alias("prompt"))


def labelled(rows: DataFrame, make_labeler: Callable[[], Callable[[list[str]], list[str]]], workers: int = 8, batch: int = 64) -> DataFrame:
    """(query_id, item_id, raw) by a user's labeler over `prompt`; `workers` bounds how many calls run at once, and nothing before them."""

    def run(frames):
        labeler = make_labeler()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({"query_id": part["query_id"], "item_id": part["item_id"], "raw": labeler(part["prompt"].tolist())})

    return rows.select("query_id", "item_id", "prompt").repartition(workers).mapInPandas(run, "query_id string, item_id string, raw string")


def run_labeling(rows: DataFrame, make_labeler: Callable, store: str, now: Column, batches: int = 4, workers: int = 8) -> None:
    """Label the rows (query_id, item_id, prompt) that the store, a folder of Parquet, lacks, and append each of `batches` parts as it ends.

    An answer that is no label is never stored, so that the next run asks again. A run that was broken off goes on after the parts it had stored.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("query_id", "item_id"), F.lit(batches))
    for i in range(batches):
        todo = rows.where(part == i)
        if (there := stored(spark, store)) is not None:
            todo = todo.join(there.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
        answers = labelled(todo, make_labeler, workers).select("query_id", "item_id", parsed(F.col("raw")).alias("label"), now.alias("labeled_at"))
        answers.where("label <> '?'").write.mode("append").parquet(store)


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows of a store; None if nothing has been stored. A first run that was broken off may have left an empty folder."""
    return spark.read.schema(STORE).parquet(store) if exists(spark, store) else None


def parsed(raw: Column) -> Column:
    """The first letter if it is a label, else ?."""
    first = F.substring(F.upper(F.trim(F.coalesce(raw, F.lit("")))), 1, 1)
    return F.when(first.isin(LABELS), first).otherwise("?")


def cost(responses: DataFrame, seconds: Column) -> DataFrame:
    """Calls, errors and dollars of (raw, tokens_in, tokens_out)."""
    dollars = (F.sum("tokens_in") * PRICE_IN + F.sum("tokens_out") * PRICE_OUT) / 1e6
    return responses.agg(F.count("*").alias("calls"), F.sum((parsed(F.col("raw")) == "?").cast("long")).alias("errors"), F.round(dollars, 9).alias("usd"), F.round(F.count("*") / seconds, 6).alias("pairs_per_sec"))


def dry_run(counts: DataFrame, concurrency: int = 100) -> DataFrame:
    each = (TOKENS_IN * PRICE_IN + TOKENS_OUT * PRICE_OUT) / 1e6
    return counts.select("new", F.round(F.col("new") * F.lit(each), 9).alias("usd"), F.round(F.col("new") / F.lit(RATE) / F.lit(float(concurrency)) / 3600, 9).alias("hours"))


def estimated_pairs(n_queries: Column, top: int, stored: Column) -> Column:
    """Without retrieval results: int(top * 3 * 0.4) pairs a query, less what is stored, not under 0."""
    return F.greatest(F.lit(0), F.lit(int(top * 3 * 0.4)) * n_queries - stored)


def dry_run_estimate(queries: DataFrame, store: DataFrame, top: int, concurrency: int = 100) -> DataFrame:
    """The dry run where there are no retrieval results to count."""
    counts = queries.agg(F.countDistinct("query_id").alias("n")).crossJoin(store.agg(F.count("*").alias("stored")))
    return dry_run(counts.select(estimated_pairs(F.col("n"), top, F.col("stored")).alias("new")), concurrency)


def agreement(responses: DataFrame) -> DataFrame:
    """Per gold label, and `all`: valid answers, correct ones and their share. Errors aren't valid."""
    valid = responses.withColumn("pred", parsed(F.col("raw"))).where("pred <> '?'")
    right = F.sum((F.col("pred") == F.col("gold")).cast("long"))
    counts = [F.count("*").alias("n"), right.alias("correct"), F.round(right / F.count("*"), 6).alias("agreement")]
    return valid.groupBy("gold").agg(*counts).unionByName(valid.agg(*counts).select(F.lit("all").alias("gold"), "n", "correct", "agreement"))


def confusions(responses: DataFrame, top: int = 10) -> DataFrame:
    wrong = responses.withColumn("pred", parsed(F.col("raw"))).where("pred <> '?' AND pred <> gold")
    return wrong.groupBy("gold", "pred").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "gold", "pred").limit(top)


def latency(responses: DataFrame) -> DataFrame:
    seconds = F.sum("latency_ms") / 1000
    spread = quantiles(responses, [], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    one = responses.agg(F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.round(seconds, 6).alias("total_s"), F.round(F.count("*") / seconds, 6).alias("pairs_per_sec"))
    return one.crossJoin(spread).select("mean_ms", F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"), "total_s", "pairs_per_sec")


def augmented(human: DataFrame, expanded: DataFrame) -> DataFrame:
    """Both label sources as qrels; where both have a pair the human label counts."""
    e = expanded.select("query_id", "item_id", F.col("label").alias("more"))
    return human.select("query_id", "item_id", "label").join(e, ["query_id", "item_id"], "full_outer").select("query_id", "item_id", F.coalesce("label", "more").alias("label"))
