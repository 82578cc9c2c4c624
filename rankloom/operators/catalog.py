"""Catalogs, judgments and query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.ranking import GRADED, LABELS, mapped, numbered, quantiles, ranked, sample_order
from rankloom.functions.text import TEMPLATE, filled, squeezed
from rankloom.sources.tables import TEXT_COLUMNS


def capped(products: DataFrame, required: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """All required products, filled up to `most` with a fixed sample of the others; `required`: product_id."""
    kept = products.join(required, "product_id", "left_semi")
    n = kept.select(F.count("*").alias("n"))
    others = products.join(required, "product_id", "left_anti").select("product_id").distinct().withColumn("_o", sample_order(F.col("product_id"), seed))
    placed = numbered(others, ["_o", "product_id"], "_place")
    chosen = placed.crossJoin(F.broadcast(n)).where(F.col("_place") < F.lit(most) - F.col("n")).select("product_id")
    return kept.unionByName(products.join(chosen, "product_id", "left_semi"))


def head(products: DataFrame, n: int) -> DataFrame:
    return products.orderBy("product_id").limit(n)


def item_text(products: DataFrame, template: str = TEMPLATE, last: str | None = None) -> DataFrame:
    """(product_id, text). Of repeated ids the row with the greatest `last` counts, where that is given."""
    if last:
        products = ranked(products, ["product_id"], F.col(last).desc(), top=1, name="_r")
    names = {c.removeprefix("product_"): F.col(c) for c in TEXT_COLUMNS}
    return products.select("product_id", squeezed(filled(template, names)).alias("text"))


def ordinals(df: DataFrame, key: str) -> DataFrame:
    """(key, ordinal): the place of each distinct key in sorted order, from 0."""
    return numbered(df.select(key).distinct(), [key], "ordinal")


def sampled_queries(queries: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most `most` queries, drawn by hash order; 0 takes all."""
    if most <= 0:
        return queries
    return queries.withColumn("_o", sample_order(F.col("query_id"), seed)).orderBy("_o", "query_id").limit(most).drop("_o")


def candidates(qrels: DataFrame, queries: DataFrame, gains: dict = GRADED) -> DataFrame:
    """(query_id, query, item_id, label, gain); an unknown label gains 0."""
    zero = F.lit(type(next(iter(gains.values())))(0))
    return qrels.select("query_id", "item_id", "label").join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "item_id", "label", mapped(F.col("label"), gains, zero).alias("gain"))


def evaluation_sets(qrels: DataFrame) -> DataFrame:
    """Per query the sorted exact items, exact or substitute items, and the number of labelled ones."""
    own = qrels.select("query_id", "item_id", "label").distinct()
    ids = lambda labels: F.array_join(F.array_sort(F.collect_set(F.when(F.col("label").isin(labels), F.col("item_id")))), ",")
    return own.groupBy("query_id").agg(ids(["E"]).alias("exact_ids"), ids(["E", "S"]).alias("exact_sub_ids"), F.countDistinct("item_id").alias("n_labeled"))


def labels_by_item(qrels: DataFrame, order: list[str]) -> DataFrame:
    """(query_id, item_id, label): of repeated items of a query the last label in `order` counts; of the same place the greatest."""
    last = F.max(F.struct(*order, F.col("label").alias("_label")))["_label"]
    return qrels.groupBy("query_id", "item_id").agg(last.alias("label"))


def per_query_means(qrels: DataFrame) -> DataFrame:
    """One row: how many queries there are, and per query the mean of its rows, of its distinct items, and of its distinct exact items."""
    each = qrels.groupBy("query_id").agg(F.count("*").alias("rows"), F.countDistinct("item_id").alias("items"), F.countDistinct(F.when(F.col("label") == "E", F.col("item_id"))).alias("exact"))
    mean = lambda c: F.round(F.coalesce(F.sum(c) / F.count("*"), F.lit(0.0)), 6).alias(f"mean_{c}")
    return each.agg(F.count("*").alias("n_queries"), mean("rows"), mean("items"), mean("exact"))


def pool_rows(qrels: DataFrame, queries: DataFrame, split: str, most: int) -> DataFrame:
    """The labelled rows of a sample of one split's queries."""
    chosen = sampled_queries(queries.where(F.col("split") == split), most)
    return qrels.join(chosen.select("query_id"), "query_id", "left_semi")


def curated_pool(qrels: DataFrame, queries: DataFrame, split: str, most: int) -> DataFrame:
    """The distinct items labelled for a sample of one split's queries."""
    return pool_rows(qrels, queries, split, most).select("item_id").distinct()


def label_distribution(qrels: DataFrame) -> DataFrame:
    counts = qrels.groupBy("label").agg(F.count("*").alias("n"))
    labels = qrels.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    total = qrels.agg(F.count("*").alias("total"))
    out = labels.join(counts, "label", "left").crossJoin(F.broadcast(total))
    return out.select("label", F.coalesce("n", F.lit(0)).alias("n"), F.round(100 * F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("pct"))


def _spread(df: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """One row: the mean of `value` and its quantiles."""
    found = quantiles(df, [], value, at)
    return df.agg(F.round(F.avg(value), 6).alias("mean")).crossJoin(found.select(*[F.round(c, 6).alias(c) for c in at]))


def query_length_stats(queries: DataFrame) -> DataFrame:
    words = F.size(F.split(F.trim("query"), r"\s+"))
    return _spread(queries.select(words.alias("w")), "w", {"median": 0.5, "p5": 0.05, "p95": 0.95})


def items_per_query_stats(qrels: DataFrame) -> DataFrame:
    return _spread(qrels.groupBy("query_id").agg(F.count("*").alias("n")), "n", {"median": 0.5, "p95": 0.95})


def metadata_coverage(products: DataFrame) -> DataFrame:
    shares = products.agg(*[F.round(100 * F.avg(F.when(F.length(c) > 0, 1.0).otherwise(0.0)), 6).alias(c) for c in TEXT_COLUMNS])
    return shares.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, TEXT_COLUMNS)), F.array(*TEXT_COLUMNS))).alias("field", "pct"))


def dataset_counts(qrels: DataFrame) -> DataFrame:
    return qrels.agg(F.count("*").alias("n_rows"), F.countDistinct("query_id").alias("n_queries"), F.countDistinct("item_id").alias("n_items"))
