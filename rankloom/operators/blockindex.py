"""Inverted index in blocks, laid out for the join, and top-k search that leaves most postings unread.

Layout. A row holds about `BLOCK` postings of one term at the most, with the greatest and the least impact. A
term's postings are dealt to its blocks by a hash of the item, so a block is found from a term and an item. Every
`STRIDE` blocks of a term lie in another bucket, so the longest list is spread over many files; a bucket is one
directory, sorted by term. `terms` has a row for each term: document frequency, impact bounds, number of blocks. The
manifest is written last; a folder without it can't be opened.

Search (exact, MaxScore): the terms of a query are read in order of the most they can add. The first few lists give a
threshold, the score that `top` items reach already. The terms that together can't reach it are never read on their own: only
for items which the other terms found, which can still pass, and only in the blocks that hold such items. The files to be scanned
follow from the query's terms. Postings stay where they are read; sums by query and item are shuffled.

Nulls: rows without a term, an item or a query don't take part. Repeated postings add up. An empty index or query set gives no rows.
Impacts and query weights may be negative. Ties in the score go to the least item; scores are rounded to 6 decimals first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.lineage import checked_broadcast, exists, written
from rankloom.functions.ranking import best_first, ranked, rounded

#: Postings of a block, blocks of a term that share a bucket, and postings of a bucket, about.
BLOCK, STRIDE, BUCKET = 128, 64, 4_000_000
#: Rows of a table that is sent to every executor at the most.
SENT = 1_000_000
#: Lists that give the threshold have so many times `top` postings together.
LEAD = 4
#: Lists up to so many postings are read rather than looked into: that costs less than a join with the items found so far.
WORTH = 20_000
#: More than rounding changes a score.
SLACK = 2e-6


def bucket_of(term: Column, block: Column, buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64(term, F.floor(block / STRIDE)), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def block_of(item: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(item), blocks)


def build(postings: DataFrame, path: str, block: int = BLOCK) -> Index:
    """Write (item_id, term, tf, impact) as an index. Without `tf` it is 1."""
    spark = postings.sparkSession
    rows = postings.where("term IS NOT NULL AND item_id IS NOT NULL")
    rows = rows if "tf" in rows.columns else rows.withColumn("tf", F.lit(1).cast("long"))
    bounds = rows.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("high"), F.min("impact").alias("low"))
    bounds.withColumn("blocks", F.ceil(F.col("df") / block)).sort("term").write.parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    total, n_terms = terms.agg(F.coalesce(F.sum("df"), F.lit(0)), F.count("*")).first()
    buckets = max(spark.sparkContext.defaultParallelism, 1 + total // BUCKET) if total else 1
    dealt = rows.join(checked_broadcast(terms.select("term", "blocks"), SENT), "term").withColumn("block", block_of(F.col("item_id"), F.col("blocks")))
    dealt = dealt.withColumn("bucket", bucket_of(F.col("term"), F.col("block"), buckets)).select("bucket", "term", "block", "item_id", "tf", "impact").repartition(buckets, "bucket")
    packed = dealt.groupBy("bucket", "term", "block").agg(F.collect_list(F.struct("item_id", "tf", "impact")).alias("p"), F.max("impact").alias("high"), F.min("impact").alias("low"))
    columns = [F.col(f"p.{c}").alias(f"{c}s") for c in ("item_id", "tf", "impact")]
    packed.select("bucket", "term", "block", "high", "low", *columns).sortWithinPartitions("bucket", "term", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    kind = postings.schema["item_id"].dataType.simpleString()
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(block).alias("block"), F.lit(int(total)).cast("long").alias("postings"), F.lit(int(n_terms)).cast("long").alias("terms"), F.lit(kind).alias("item")).coalesce(1).write.json(f"{path}/manifest")
    return Index(spark, path)


@dataclass
class Index:
    spark: SparkSession
    path: str

    def __post_init__(self):
        if not exists(self.spark, f"{self.path}/manifest/_SUCCESS"):
            raise ValueError(f"{self.path} has no manifest; the index was not finished")
        self.manifest = self.spark.read.schema("buckets int, block int, postings long, terms long, item string").json(f"{self.path}/manifest").first()
        item, term = self.manifest["item"], "string"
        self.schema = f"term {term}, block long, high double, low double, item_ids array<{item}>, tfs array<long>, impacts array<double>, bucket int"

    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df long, high double, low double, blocks long").parquet(f"{self.path}/terms")

    def blocks(self) -> DataFrame:
        # An index without postings has no directory of a bucket.
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/blocks")

    def postings(self) -> DataFrame:
        """(item_id, term, tf, impact)."""
        return opened(self.blocks(), "term").select("item_id", "term", "tf", "impact")

    def blocks_of(self, terms: DataFrame) -> DataFrame:
        """The blocks of the wanted terms (term, blocks, ...), from the files of their buckets only."""
        strides = F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / STRIDE))
        where = terms.select("term", F.explode(strides).alias("s")).select(bucket_of(F.col("term"), F.col("s") * STRIDE, self.manifest["buckets"]).alias("bucket"))
        needed = [r[0] for r in where.distinct().collect()]  # one number a file
        return self.blocks().where(F.col("bucket").isin(needed) if len(needed) < self.manifest["buckets"] else F.lit(True))


def opened(blocks: DataFrame, *keep: str) -> DataFrame:
    """A row for each posting of the blocks, with the columns `keep`."""
    zipped = F.arrays_zip(F.col("item_ids").alias("item_id"), F.col("tfs").alias("tf"), F.col("impacts").alias("impact"))
    return blocks.select(*keep, F.inline(zipped)).toDF(*keep, "item_id", "tf", "impact")


def planned(index: Index, wanted: DataFrame, top: int) -> DataFrame:
    """(query_id, term, weight, df, blocks, most, least, place, lead): the query's terms in the order they are read.

    `wanted` is (query_id, term, weight); weights of repeated terms are added. `most` and `least` bound what the term adds to any score."""
    total = wanted.where("term IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id", "term").agg(F.sum("weight").cast("double").alias("weight"))
    rows = total.join(index.terms(), "term")
    ends = [F.lit(0.0), F.col("weight") * F.col("high"), F.col("weight") * F.col("low")]
    order = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "df", "term")
    rows = rows.withColumn("most", F.greatest(*ends)).withColumn("least", F.least(*ends))
    read = F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("query_id", "term", "weight", "df", "blocks", "most", "least", F.row_number().over(order).alias("place"), (F.coalesce(read, F.lit(0)) < LEAD * top).alias("lead"))


def summed(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, item_id, partial): what the given terms of each query add to the scores of the items in their lists."""
    found = opened(index.blocks_of(terms).join(terms.select("query_id", "term", "weight"), "term"), "query_id", "weight")
    return found.groupBy("query_id", "item_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("partial"))


def with_thresholds(index: Index, terms: DataFrame, top: int) -> DataFrame:
    """`terms` (a written table) with `bound`, below which no item of a query is among its `top`, and `read`: whether the whole list must be read.

    Terms are left unread from the last one on while all of them together add less than the threshold, if their lists are long."""
    lead = terms.where("lead")
    later = terms.groupBy("query_id").agg(F.sum(F.when(~F.col("lead"), F.col("least")).otherwise(0.0)).alias("_least"))
    best = ranked(summed(index, lead), ["query_id"], F.col("partial").desc(), F.col("item_id"), top=top)
    bound = best.where(F.col("rank") == top).join(later, "query_id").select("query_id", (F.col("partial") + F.col("_least") - SLACK).alias("bound"))
    rest = F.sum("most").over(Window.partitionBy("query_id").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return terms.join(bound, "query_id", "left").withColumn("read", F.col("bound").isNull() | (rest >= F.col("bound")) | (F.col("df") <= WORTH))


def search(index: Index, wanted: DataFrame, top: int = 100, counts: list | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the best `top` items of each query; `wanted` is (query_id, term, weight).

    To `counts` goes how many postings were read for pairs with a query, and how many reading every list would take."""
    terms = written(planned(index, wanted, top))
    size = lambda df: df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    # Without a long list no threshold is needed.
    terms = written(with_thresholds(index, terms, top)) if not terms.where(F.col("df") > WORTH).isEmpty() else terms.withColumns({"bound": F.lit(None).cast("double"), "read": F.lit(True)})
    if terms.where("NOT read").isEmpty():
        if counts is not None:
            counts.append({"lead": 0, "read": size(terms), "looked_up": 0, "all": size(terms)})
        scores = summed(index, terms).select("query_id", "item_id", rounded(F.col("partial")).alias("score"))
        return ranked(scores, ["query_id"], *best_first(), top=top)
    unread = terms.where("NOT read").groupBy("query_id").agg(F.sum("most").alias("_most"), F.first("bound").alias("_bound"))
    found = summed(index, terms.where("read")).join(unread, "query_id", "left")
    can_pass = found.where(F.col("_bound").isNull() | (F.col("partial") + F.col("_most") >= F.col("_bound")))
    open_ = written(can_pass)
    # For these items the terms left unread are looked up, in the blocks that hold them.
    pairs = open_.where("_bound IS NOT NULL").join(terms.where("NOT read").select("query_id", "term", "weight", "blocks"), "query_id")
    pairs = pairs.withColumn("block", block_of(F.col("item_id"), F.col("blocks"))).select("query_id", "item_id", "term", "block", "weight", "partial", "_bound")
    bounds = index.blocks_of(terms.where("NOT read")).select("term", "block", F.col("high").alias("_high"), F.col("low").alias("_low"))
    most = F.greatest(F.lit(0.0), F.col("weight") * F.col("_high"), F.col("weight") * F.col("_low"))
    held = pairs.join(bounds, ["term", "block"]).groupBy("query_id", "item_id").agg(F.first("partial").alias("partial"), F.first("_bound").alias("_bound"), F.sum(most).alias("_most"), F.collect_list(F.struct("term", "block", "weight")).alias("_at"))
    asked = written(held.where(F.col("partial") + F.col("_most") >= F.col("_bound")).select("query_id", "item_id", F.inline("_at")))
    needed = asked.select("term", "block").distinct()
    scanned = index.blocks_of(terms.where("NOT read")).join(needed, ["term", "block"], "left_semi")
    more = opened(scanned, "term").join(asked.select("query_id", "item_id", "term", "weight"), ["term", "item_id"]).select("query_id", "item_id", (F.col("weight") * F.col("impact")).alias("partial"))
    if counts is not None:
        looked = scanned.agg(F.coalesce(F.sum(F.size("item_ids")), F.lit(0))).first()[0]
        counts.append({"lead": size(terms.where("lead")), "read": size(terms.where("read")), "looked_up": looked, "all": size(terms)})
    scores = open_.select("query_id", "item_id", "partial").unionByName(more).groupBy("query_id", "item_id").agg(rounded(F.sum("partial")).alias("score"))
    return ranked(scores, ["query_id"], *best_first(), top=top)
