"""The recommendation funnel: split, retrieve, slate, rerank, evaluate.

Interactions: (user_id, item_id, ts) with further columns that settle ties where given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.lineage import checked_broadcast, cut, written
from rankloom.functions.ranking import best_first, numbered, ranked, running, sample_order
from rankloom.operators import dense

#: Items, and users with one value each, that are sent to every executor at the most.
BROADCAST_ITEMS = BROADCAST_USERS = 1_000_000
#: Vector components that are sent to every executor at the most.
SENT_VALUES = 1 << 22


def kcore(interactions: DataFrame, k: int = 5) -> DataFrame:
    """Only users and items with k interactions or more, repeated until nothing changes."""
    now, n = interactions, None
    while True:
        users = now.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("user_id")
        items = now.groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("item_id")
        now = cut(now.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi"))
        left = now.count()
        if left == n:
            return now.select(*interactions.columns)
        n = left


def stats(interactions: DataFrame) -> DataFrame:
    n = interactions.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_interactions"))
    return n.withColumn("avg_length", F.round(F.col("n_interactions") / F.col("n_users"), 6))


def capped_users(interactions: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """The interactions of at most `most` users, drawn by hash order; 0 takes all."""
    if most <= 0:
        return interactions
    drawn = interactions.select("user_id").distinct().withColumn("_o", sample_order(F.col("user_id"), seed)).orderBy("_o", "user_id").limit(most)
    return interactions.join(drawn.select("user_id"), "user_id", "left_semi")


def histories(interactions: DataFrame, ties: list[str] = [], dedup: bool = True, most_users: int = 0) -> DataFrame:  # noqa: B006
    """(user_id, item_id, ts, pos): each user's items in order of time; of a repeated item the latest event. See `capped_users`."""
    interactions = capped_users(interactions, most_users)
    rows = ranked(interactions, ["user_id", "item_id"], F.col("ts").desc(), *[F.col(t).desc() for t in ties], top=1, name="_r") if dedup else interactions
    out = ranked(rows, ["user_id"], F.col("ts"), *[F.col(t) for t in ties], F.col("item_id"), name="pos")
    return out.select("user_id", "item_id", "ts", "pos")


def split(history: DataFrame, most_evaluated: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, target): all but the last item of each user, and the last one, of at most `most_evaluated` users (0: all)."""
    return parted(with_length(history), most_evaluated)


def with_length(history: DataFrame) -> DataFrame:
    """The histories with the last place of each user's, `_n`."""
    return history.withColumn("_n", F.max("pos").over(Window.partitionBy("user_id")))


def parted(marked: DataFrame, most_evaluated: int = 0) -> tuple[DataFrame, DataFrame]:
    """`split` of histories that have their lengths; of a written table both parts are scans."""
    return marked.where("pos < _n").drop("_n"), capped_users(marked.where("pos = _n").drop("_n"), most_evaluated)


def popularity(train: DataFrame, users: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent items of the train prefixes that the user has not had.

    A user with a history of n items needs the first `top` + n items only, so as many rows are made as there are
    histories and `top` for each user. The items are broadcast where they are at most BROADCAST_ITEMS, else joined by place.
    """
    count = train.groupBy("item_id").agg(F.count("*").alias("score"))
    own = train.groupBy("user_id").agg(F.countDistinct("item_id").alias("n"))
    placed = numbered(count.withColumn("_less", -F.col("score")), ["_less", "item_id"], "place").drop("_less")
    longest = own.agg(F.max("n").alias("longest"))
    best = cut(placed.crossJoin(F.broadcast(longest)).where(F.col("place") < top + F.col("longest")).drop("longest"))
    need = users.select("user_id").distinct().join(own, "user_id", "left").select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), top - 1 + F.coalesce("n", F.lit(0)))).alias("place"))
    rows = need.join(checked_broadcast(best, BROADCAST_ITEMS), "place").join(train.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    return ranked(rows.select("user_id", "item_id", "score"), ["user_id"], *best_first(), top=top)


def history_vectors(train: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vector): the unit mean of the vectors of a user's items.

    A user's items meet before their vectors come to them, so that no vector is shuffled where the vectors of all items in
    histories are of at most SENT_VALUES components; more are joined by item, and one row for each pair goes back to its user."""
    own = train.select("user_id", "item_id").repartition("user_id").distinct()
    known = written(vectors.where(F.size("vector") > 0).join(train.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "vector"))
    size = known.agg(F.max(F.size("vector"))).first()[0] or 1
    n = known.count()
    each = own.join(F.broadcast(known), "item_id") if n * size <= SENT_VALUES else own.join(known, "item_id").repartition("user_id")
    mean = each.groupBy("user_id").agg(*[F.round(F.avg(F.get("vector", F.lit(i)).cast("double")), 9).alias(f"x{i}") for i in range(size)])
    whole = mean.select("user_id", F.array(*[f"x{i}" for i in range(size)]).alias("v"))
    return whole.select(F.col("user_id").alias("query_id"), dense.unit(F.col("v")).alias("vector"))


def vector_topk(users: DataFrame, items: DataFrame, seen: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Nearest items of (query_id, vector), without those in `seen` (user_id, item_id), which are left out before the cut."""
    had = None if seen is None else seen.select(F.col("user_id").alias("query_id"), "item_id")
    return dense.search(items, users, top, had).withColumnRenamed("query_id", "user_id")


def oracle_slate(slate: DataFrame, targets: DataFrame, keys: list[str] = ["user_id"]) -> DataFrame:  # noqa: B006
    """The slate of each of `keys` with the target in the last place where it was missing; an empty slate gets it at 1."""
    t = targets.select(*keys, F.col("item_id").alias("target"))
    w = Window.partitionBy(*keys)
    rows = t.join(slate.select(*keys, "item_id", "rank"), keys, "left")
    there = F.max((F.col("item_id") == F.col("target")).cast("int")).over(w)
    last = F.max("rank").over(w)
    item = F.when(F.col("rank").isNull() | ((F.col("rank") == last) & (there == 0)), F.col("target")).otherwise(F.col("item_id"))
    return rows.select(*keys, item.alias("item_id"), F.coalesce("rank", F.lit(1)).alias("rank"))


def stacked(slates: dict[str, DataFrame], targets: DataFrame) -> DataFrame:
    """(retriever, mode, user_id, item_id, rank): the slates of all retrievers as they are (natural) and with the target in them (oracle).

    A user without a target is left out; one that a retriever has nothing for has an oracle slate only. Give it written slates and targets, which it reads twice."""
    parts = [s.select(F.lit(name).alias("retriever"), "user_id", "item_id", "rank") for name, s in slates.items()]
    natural = reduce(DataFrame.unionByName, parts).join(checked_broadcast(targets.select("user_id"), BROADCAST_USERS), "user_id", "left_semi").select("retriever", "user_id", "item_id", "rank")
    wanted = targets.select(F.explode(F.array(*map(F.lit, slates))).alias("retriever"), "user_id", "item_id")
    oracle = oracle_slate(natural, wanted, ["retriever", "user_id"])
    named = lambda df, mode: df.select("retriever", F.lit(mode).alias("mode"), "user_id", "item_id", "rank")
    return named(natural, "natural").unionByName(named(oracle, "oracle"))


def with_orders(slates: DataFrame, outputs: DataFrame) -> DataFrame:
    """Stacked slates in the order they came in and in that of the model's outputs (retriever, mode, user_id, raw)."""
    keys = ["retriever", "mode", "user_id"]
    named = lambda df, order: df.select("retriever", "mode", F.lit(order).alias("ordering"), "user_id", "item_id", "rank")
    return named(slates, "incoming").unionByName(named(permuted(slates, outputs, keys), "permuted"))


def stacked_metrics(slates: DataFrame, targets: DataFrame) -> DataFrame:
    """Recall, NDCG and MRR over all users with a target of every retriever, mode and order, in one pass over the slates. Give it written targets."""
    hit = slates.join(checked_broadcast(targets.select("user_id", F.col("item_id").alias("target")), BROADCAST_USERS), "user_id")
    place = F.when(F.col("item_id") == F.col("target"), F.col("rank"))
    best = hit.groupBy("retriever", "mode", "ordering", "user_id").agg(F.min(place).alias("rank"))
    users = targets.agg(F.count("*").alias("n_users"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    sums = best.groupBy("retriever", "mode", "ordering").agg(total(F.when(F.col("rank").isNotNull(), 1.0)).alias("recall"), total(1 / F.log2(F.col("rank") + 1)).alias("ndcg"), total(1 / F.col("rank")).alias("mrr"))
    mean = lambda c: F.round(F.col(c) / F.col("n_users"), 6).alias(c)
    return sums.crossJoin(F.broadcast(users)).select("retriever", "mode", "ordering", "n_users", mean("recall"), mean("ndcg"), mean("mrr"))


def slate_metrics(slate: DataFrame, targets: DataFrame) -> DataFrame:
    """Share of users whose target is in the slate, NDCG and MRR, over all users with a target."""
    hit = slate.select("user_id", "item_id", "rank").join(targets.select("user_id", "item_id"), ["user_id", "item_id"]).groupBy("user_id").agg(F.min("rank").alias("rank"))
    rows = targets.select("user_id").join(hit, "user_id", "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return rows.agg(F.count("*").alias("n_users"), mean(F.when(F.col("rank").isNotNull(), 1.0)).alias("recall"), mean(1 / F.log2(F.col("rank") + 1)).alias("ndcg"), mean(1 / F.col("rank")).alias("mrr"))


def prompts(train: DataFrame, slate: DataFrame, metadata: DataFrame, scores: bool = False) -> DataFrame:
    """(user_id, prompt): JSON of the history and the candidates with their text and, if wanted, the retriever's scores; never the target."""
    own = ["score"] if scores else []
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda p: p["v"])
    past = train.groupBy("user_id").agg(ordered(F.struct(F.col("pos"), F.col("item_id").alias("v"))).alias("history"))
    seen = slate.join(metadata.select("item_id", "text"), "item_id", "left")
    options = seen.groupBy("user_id").agg(ordered(F.struct("rank", F.struct("item_id", "text", *own).alias("v"))).alias("candidates"))
    return options.join(past, "user_id", "left").select("user_id", F.to_json(F.struct("history", "candidates")).alias("prompt"))


def outputs_with_slates(outputs: DataFrame, slate: DataFrame) -> DataFrame:
    """(user_id, ids, incoming): parsed model output (null: not a JSON array) beside the slate, in order."""
    incoming = slate.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").cast("long").alias("item_id")))), lambda p: p["item_id"]).alias("incoming"))
    return outputs.withColumn("ids", F.from_json("raw", "array<bigint>")).drop("raw").join(incoming, "user_id")


def validity(both: DataFrame) -> DataFrame:
    """Shares of the outputs of (ids, incoming), and the mean of latency_ms and tokens where there are such columns."""
    ids, incoming = F.col("ids"), F.col("incoming")
    ok = ids.isNotNull()
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    twice = F.size(F.array_distinct(ids)) < F.size(ids)
    lacks, extra = F.size(F.array_except(incoming, ids)) > 0, F.size(F.array_except(ids, incoming)) > 0
    whole = ok & ~twice & ~lacks & ~extra
    return both.agg(F.count("*").alias("n"), rate(ok).alias("valid_json"), rate(~ok).alias("parse_failure"), rate(whole).alias("valid_permutation"), rate(ok & twice).alias("duplicate"), rate(ok & lacks).alias("missing"), rate(ok & extra).alias("out_of_candidate"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("latency_ms", "tokens") if c in both.columns])


def permuted(slate: DataFrame, outputs: DataFrame, keys: list[str] = ["user_id"]) -> DataFrame:  # noqa: B006
    """The slate in the order of the output: named items first, each at its first mention, then the rest as they were.

    A slate travels as one row."""
    said = outputs.select(*keys, F.from_json("raw", "array<bigint>").alias("ids")).where("ids IS NOT NULL").groupBy(*keys).agg(F.collect_list("ids").alias("said"))
    rows = slate.groupBy(*keys).agg(F.collect_list(F.struct("rank", "item_id")).alias("own")).join(said, keys, "left")
    at = lambda item: F.array_min(F.transform("said", lambda ids: F.nullif(F.array_position(ids, item.cast("bigint")), F.lit(0))))
    order = F.array_sort(F.transform("own", lambda x: F.struct(at(x["item_id"]).isNull().alias("unnamed"), at(x["item_id"]).alias("at"), x["rank"].alias("was"), x["item_id"].alias("item_id"))))
    return rows.select(*keys, F.posexplode(order).alias("_at", "_x")).select(*keys, F.col("_x.item_id").alias("item_id"), (F.col("_at") + 1).alias("rank"))


def identity_rate(both: DataFrame) -> DataFrame:
    return both.agg(F.round(F.avg(F.coalesce(F.col("ids") == F.col("incoming"), F.lit(False)).cast("double")), 6).alias("identity_rate"))


def leakage(train: DataFrame, targets: DataFrame) -> DataFrame:
    """Histories that hold their own target, train rows counted twice as targets, and the mean over users of the share of
    train rows later than the user's target, by running counts over distinct times, which are dealt out by range."""
    held = train.join(targets.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").agg(F.count("*").alias("target_in_history"))
    outside = train.join(targets.select("user_id", "pos"), ["user_id", "pos"], "left_semi").agg(F.count("*").alias("outside_prefix"))
    times = train.groupBy("ts").agg(F.count("*").alias("n")).unionByName(targets.groupBy("ts").agg(F.lit(0).cast("long").alias("n"))).groupBy("ts").agg(F.sum("n").alias("n"))
    rows = running(times, [], ["ts"], "n", "earlier")
    everything = times.agg(F.sum("n").alias("everything"))
    later = rows.crossJoin(F.broadcast(everything)).select("ts", (F.col("everything") - F.col("earlier") - F.col("n")).alias("later"))
    total = train.agg(F.count("*").cast("double").alias("total"))
    share = targets.join(later, "ts").crossJoin(F.broadcast(total)).agg(F.round(F.avg(F.col("later") / F.col("total")), 6).alias("later_share"))
    return held.crossJoin(outside).crossJoin(share)


def flattened(metrics: DataFrame) -> DataFrame:
    """(retriever, slate, metric, value) of nested result JSON; column `value` holds the text."""
    kind = "retriever_results array<struct<retriever:string,metrics:map<string,map<string,map<string,double>>>>>"
    rows = metrics.select(F.from_json("value", kind).alias("m")).select(F.explode("m.retriever_results").alias("r"))
    slates = rows.select("r.retriever", F.explode("r.metrics").alias("slate", "orders"))
    return slates.select("retriever", "slate", F.explode("orders").alias("ordering", "values")).select("retriever", "slate", "ordering", F.explode("values").alias("metric", "value"))
