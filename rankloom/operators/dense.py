"""Dense vectors: exact inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.lineage import checked_broadcast, written
from rankloom.functions.ranking import best_first, ranked, rounded

#: Vector components in one block of items, of queries, and in the sample that cells are made from; cells at the most.
ITEM_VALUES, QUERY_VALUES, SAMPLE_VALUES, CELLS = 1 << 18, 1 << 17, 1 << 22, 1024
#: So many pairs of blocks are scored without asking which can be skipped.
FEW = 64
#: More than rounding can change a score.
SLACK = 1e-5
#: Vector components of the items that one task holds while it goes through its queries.
PART_VALUES = 1 << 24
#: Rows of places that are sent to every executor at the most.
SENT = 1_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def cells(df: DataFrame, key: str, n: int, size: int) -> np.ndarray | None:
    """Centres of at most CELLS cells, from a bounded sample of the vectors by a hash of their keys and a few rounds of k-means; None if one will do."""
    k = min(CELLS, max(1, SAMPLE_VALUES // (4 * size)), n * size // ITEM_VALUES)
    if k < 2:
        return None
    rows = df.orderBy(F.xxhash64(key), key).limit(min(n, 16 * k, SAMPLE_VALUES // size)).select("vector").collect()  # SAMPLE_VALUES values at the most
    sample = np.array([r["vector"] for r in rows], np.float64)
    centres = sample[:k]
    for _ in range(4):
        own = nearest(sample, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - (centres * centres).sum(1) / 2).argmax(1)


def packed(df: DataFrame, key: str, values: int, centres: np.ndarray | None, n: int, size: int) -> DataFrame:
    """Written rows of up to about `values` vector components of one cell: `block`, the keys in order, the vectors, their centre and radius."""
    rows = df.select(key, F.transform("vector", lambda v: v.cast("double")).alias("vector"))
    kind = rows.schema[key].dataType.simpleString()
    if centres is None:
        dealt = rows.withColumn("cell", F.lit(0))
        splits = {0: 1 + n * size // values}
    else:

        def assign(batches):
            for batch in batches:
                own = nearest(np.stack(batch.column(1).to_numpy(zero_copy_only=False)), centres) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[key, "vector", "cell"])

        dealt = written(rows.mapInArrow(assign, f"{key} {kind}, vector array<double>, cell int"))
        splits = {r["cell"]: 1 + r["count"] * size // values for r in dealt.groupBy("cell").count().collect()}  # a row a cell
    split = F.create_map(*[F.lit(x) for c, m in splits.items() for x in (c, m)]) if splits else F.lit(None).cast("map<int,int>")
    block = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64(key), split[F.col("cell")].cast("long"))
    groups = dealt.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(key, "vector"))).alias("r"))

    def measure(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors = batch.column(1)[i].values, batch.column(2)[i].values
                x = np.stack(vectors.to_numpy(zero_copy_only=False))
                centre = x.mean(0)
                lists = [pa.array([a], pa.list_(a.type)) for a in (ids, pa.array(x.ravel()), pa.array(centre))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(ids)], pa.int32()), *lists, pa.array([float(np.sqrt(((x - centre) ** 2).sum(1).max()))])], names=["block", "n", "ids", "vectors", "centre", "radius"])

    found = groups.select("block", F.col(f"r.{key}").alias("ids"), F.col("r.vector").alias("v")).mapInArrow(measure, f"block long, n int, ids array<{kind}>, vectors array<double>, centre array<double>, radius double")
    return written(found, wide=True)


def matrix(batch: pa.RecordBatch, name: str, i: int, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name))[i].values.to_numpy(zero_copy_only=False).reshape(-1, width)


def bounds(asked: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(asking, block, n, most): how much any query of a block of queries can score in a block of items; with thresholds, only where one can pass its own.

    A query q scores at most q.c + |q| r among vectors within r of c. Only centres meet the queries here, not items."""
    per = max(1, ITEM_VALUES // size)
    group = F.floor(F.pmod(F.xxhash64("block"), F.lit(1_000_003)) / max(1, 1_000_003 * per // max(1, blocks.count())))
    metas = blocks.groupBy(group.alias("g")).agg(F.collect_list("block").alias("blocks"), F.collect_list("n").alias("ns"), F.collect_list("radius").alias("radii"), F.flatten(F.collect_list("centre")).alias("centres"))
    queries = asked.select(F.col("block").alias("asking"), "vectors", "least")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = {name: c[i].values for name, c in zip(batch.schema.names, batch.columns, strict=True) if name not in ("asking", "vectors", "centres", "g")}
                q, c = matrix(batch, "vectors", i, size), matrix(batch, "centres", i, size)
                most = q @ c.T + np.sqrt((q * q).sum(1))[:, None] * at["radii"].to_numpy(zero_copy_only=False) + SLACK
                can = (most >= at["least"].to_numpy(zero_copy_only=False)[:, None]).any(0)
                asking = batch.column(batch.schema.get_field_index("asking"))[i].as_py()
                keep = pa.array(np.flatnonzero(can))
                yield pa.RecordBatch.from_arrays([pa.array([asking] * len(keep), pa.int64()), at["blocks"].take(keep), at["ns"].take(keep), pa.array(most.max(0)[can])], names=["asking", "block", "n", "most"])

    return queries.crossJoin(metas).mapInArrow(run, "asking long, block long, n int, most double")


def low(scores: np.ndarray, top: int) -> np.ndarray:
    """For each row a score that at least `top` of its scores reach: the `top`-th of the greatest ones of many parts."""
    width = scores.shape[1] // (4 * top)
    parts = scores[:, : 4 * top * width].reshape(len(scores), 4 * top, width).max(2) if width > 1 else scores
    return np.partition(parts, -top, axis=1)[:, -top]


def exact(q: np.ndarray, v: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rounded inner products of the given pairs of rows."""
    cuts = range(0, max(1, len(which)), 1 << 16)
    return np.round(np.concatenate([np.einsum("ij,ij->i", q[which[c : c + (1 << 16)]], v[at[c : c + (1 << 16)]]) for c in cuts]), 6)


class Best:
    """The best `top` items of each of a block of queries `q`, among the blocks of items that it has met.

    `least` are the scores that an item must reach to count; they rise as items are found. Single precision tells which pairs can reach
    them, with a margin for its errors; the scores of these are taken in double precision."""

    def __init__(self, q: np.ndarray, least: np.ndarray, top: int):
        self.q, self.least, self.top, self.parts, self.new = np.array(q), np.array(least), top, [], 0
        self.error = (q.shape[1] + 4) * 2.0**-23 * np.sqrt((self.q * self.q).sum(1))

    def first(self, which: np.ndarray, scores: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the first `top` of each query in their order, and which of them are last of a full list."""
        rows = pa.table({"which": which, "score": scores, "id": ids})
        order = pc.sort_indices(rows, sort_keys=[("which", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        own = which[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        return order[place < self.top], order[place == self.top - 1]

    def meet(self, ids: pa.Array, v: np.ndarray, queries: np.ndarray, items: np.ndarray) -> None:
        """Score a block of items. `queries` and `items` are places in both blocks that don't count."""
        kind = np.float32 if max(np.abs(self.q).max(), np.abs(v).max()) < 1e15 else np.float64
        q, narrow = self.q.astype(kind), v.T.astype(kind)
        error = self.error * np.sqrt((v * v).sum(1).max())
        for j in range(0, len(q), 256):
            scores, least = q[j : j + 256] @ narrow, self.least[j : j + 256]
            own = (queries >= j) & (queries < j + 256)
            scores[queries[own] - j, items[own]] = -np.inf
            bar = least - error[j : j + 256]
            open_ended = np.flatnonzero(least == -np.inf)
            if len(open_ended) and len(ids) > self.top:
                bar[open_ended] = low(scores[open_ended], self.top) - 2 * error[j + open_ended]
            # Rounding lifts a score by half of 1e-6; the bar is no higher in single precision. What doesn't count stays under it.
            bar = np.maximum(np.nextafter((bar - 1e-6 - 1e-12 * np.abs(bar)).astype(kind), kind(-np.inf)), np.finfo(kind).min)
            which, at = np.divmod(np.flatnonzero(scores >= bar[:, None]), len(ids))
            found = exact(self.q, v, which + j, at)
            reached = found >= least[which]
            which, at, found = which[reached], at[reached], found[reached]
            if len(which) > self.top * len(scores):
                kept, _ = self.first(which, found, pa.array(at))
                which, at, found = which[kept], at[kept], found[kept]
            self.parts.append((which + j, found, ids.take(pa.array(at))))
            self.new += len(which)
        if self.new >= self.top * len(self.q):
            self.settle()

    def settle(self) -> None:
        if self.parts:
            which, scores = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
            ids = pa.concat_arrays([p[2] for p in self.parts])
            kept, last = self.first(which, scores, ids)
            self.least[which[last]] = np.maximum(self.least[which[last]], scores[last])
            self.parts, self.new = [(which[kept], scores[kept], ids.take(pa.array(kept)))], 0

    def found(self, queries: pa.Array) -> pa.RecordBatch:
        self.settle()
        which, scores, ids = self.parts[0]
        return pa.RecordBatch.from_arrays([queries.take(pa.array(which)), ids, pa.array(scores)], names=["query_id", "item_id", "score"])


def scored(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, had: DataFrame | None, top: int, size: int, kinds: dict[str, str]) -> DataFrame:
    """(query_id, item_id, score): the best `top` of each query in its pairs of blocks, one matrix product a pair.

    `had` is (asking, block, at): places of a query and an item in their blocks that don't count. A block of queries knows its blocks of items and the places;
    the pairs are made where they are scored, by tasks that hold a part of the items and read the queries, so that no matrix is shuffled with its pair.
    A task hands on `top` rows a query for all of its items."""
    wanted = pairs.groupBy("asking").agg(F.collect_set("block").alias("wanted"))
    queries = asked.select(F.col("block").alias("asking"), F.col("ids").alias("queries"), F.col("vectors").alias("q"), "least").join(wanted, "asking")
    if had is not None:
        masks = had.join(pairs, ["asking", "block"], "left_semi").groupBy("asking").agg(F.map_from_entries(F.collect_list(F.struct("block", "at"))).alias("masks"))
        queries = queries.join(masks, "asking", "left")
    else:
        queries = queries.withColumn("masks", F.lit(None).cast("map<long,array<struct<query:int,item:int>>>"))
    queries = written(queries, wide=True)
    items = blocks.select("block", F.col("ids").alias("items"), F.col("vectors").alias("v"), "n")
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = max(1 + (items.agg(F.sum("n")).first()[0] or 0) * size // PART_VALUES, 3 * cores // max(1, queries.rdd.getNumPartitions()))
    both = queries.crossJoin(items.drop("n").coalesce(parts).hint("shuffle_replicate_nl")).where(F.array_contains("wanted", F.col("block")))

    def run(batches):
        now, best, asking = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                column = {name: c[i] for name, c in zip(batch.schema.names, batch.columns, strict=True)}
                if best is None or column["asking"].as_py() != now:
                    if best is not None:
                        yield best.found(asking)
                    now, asking = column["asking"].as_py(), column["queries"].values
                    best = Best(matrix(batch, "q", i, size), column["least"].values.to_numpy(zero_copy_only=False), top)
                at = column["at"].values
                out = (at.field(0).to_numpy(), at.field(1).to_numpy()) if at is not None else (np.empty(0, int), np.empty(0, int))
                best.meet(column["items"].values, matrix(batch, "v", i, size), *out)
        if best is not None:
            yield best.found(asking)

    return both.select("asking", "queries", "least", "q", "items", "v", F.try_element_at("masks", F.col("block")).alias("at")).mapInArrow(run, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")


def places(blocks: DataFrame, name: str, key: str) -> DataFrame:
    """(key, block as `name`, place) of every key of the blocks."""
    return blocks.select(F.col("block").alias(name), F.posexplode("ids").alias(f"{name}_at", key))


def masked(had: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(asking, block, at): places of the pairs (query_id, item_id) of `had` in the blocks of queries and of items."""
    own = had.select("query_id", "item_id").distinct()
    items = written(places(blocks, "block", "item_id").join(own.select("item_id").distinct(), "item_id", "left_semi"))
    both = own.join(checked_broadcast(items, SENT), "item_id").join(checked_broadcast(written(places(asked, "asking", "query_id")), SENT), "query_id")
    return both.groupBy("asking", "block").agg(F.collect_list(F.struct(F.col("asking_at").alias("query"), F.col("block_at").alias("item"))).alias("at"))


def search(items: DataFrame, queries: DataFrame, top: int = 100, had: DataFrame | None = None, counts: list | None = None) -> DataFrame:
    """The best `top` items of (item_id, vector) by inner product for each of (query_id, vector), without the pairs (query_id, item_id) of `had`. Exact.

    Items and queries are clustered into cells and packed into blocks, each with its centre and radius. A first round scores each block of queries
    against the blocks that promise most; the last place of a query is its threshold. The second scores the pairs of
    blocks of which a query can still pass its threshold; the others are skipped. Few pairs are all scored at once.
    To `counts` goes how many pairs of blocks there are and how many were scored. Rows without a vector don't take part. Nothing but
    a bounded sample and the numbers of cells passes through the driver; a pair of blocks emits `top` rows a query at the most.
    What is shuffled and written grows with the items, the queries and `had`, not with the pairs of blocks, see `scored`.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", queries), ("item_id", items))}
    items, queries = items.where("vector IS NOT NULL"), queries.where("vector IS NOT NULL")
    (n, size), m = items.agg(F.count("*"), F.max(F.size("vector"))).first(), queries.count()
    if not n or not m:
        return queries.limit(0).select("query_id", F.lit(None).cast(kinds["item_id"]).alias("item_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    centres = cells(items, "item_id", n, size)
    # Places of had items travel with their block of queries.
    wide = size if had is None else size + had.count() // m
    blocks, asked = packed(items, "item_id", ITEM_VALUES, centres, n, size), packed(queries, "query_id", QUERY_VALUES, centres if m * wide > QUERY_VALUES else None, m, wide)
    asked = asked.withColumn("least", F.transform("ids", lambda _: F.lit(float("-inf"))))
    masks = None if had is None else written(masked(had, asked, blocks))
    every = blocks.count() * asked.count()
    if every <= FEW:
        pairs = asked.select(F.col("block").alias("asking")).crossJoin(blocks.select("block"))
        if counts is not None:
            counts.append({"pairs": every, "scored": every})
        return ranked(scored(pairs, asked, blocks, masks, top, size, kinds), ["query_id"], *best_first(), top=top)
    first = Window.partitionBy("asking").orderBy(F.col("most").desc(), "block")
    before = F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, -1))
    seeds = written(bounds(asked, blocks, size).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * top).select("asking", "block"))
    found = written(ranked(scored(seeds, asked, blocks, masks, top, size, kinds), ["query_id"], *best_first(), top=top))
    last = found.where(F.col("rank") == top).select("query_id", F.col("score").alias("last"))
    limits = places(asked, "block", "query_id").join(last, "query_id", "left").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("block_at", F.coalesce("last", F.lit(float("-inf"))).alias("last")))).alias("l"))
    asked = asked.drop("least").join(written(limits.select("block", F.col("l.last").alias("least"))), "block")
    rest = written(bounds(asked, blocks, size).select("asking", "block").join(seeds, ["asking", "block"], "left_anti"))
    if counts is not None:
        counts.append({"pairs": every, "scored": seeds.count() + rest.count()})
    more = scored(rest, asked, blocks, masks, top, size, kinds)
    return ranked(found.drop("rank").unionByName(more), ["query_id"], *best_first(), top=top)


def candidate_scores(items: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Inner products of the given (query_id, item_id), 0 where either has no vector."""
    q = queries.select("query_id", F.col("vector").alias("qv"))
    i = items.select("item_id", F.col("vector").alias("iv"))
    both = pairs.select("query_id", "item_id").join(i, "item_id", "left").join(q, "query_id", "left")
    return both.select("query_id", "item_id", F.coalesce(rounded(dot(F.col("qv"), F.col("iv"))), F.lit(0.0)).alias("score"))
