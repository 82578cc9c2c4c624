"""One pass over blocks of items for many queries: exact results, and no pairs of a query and an item in a shuffle."""

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankloom.functions.lineage import new_path, written
from rankloom.functions.text import STOP_WORDS, counted_tokens
from rankloom.operators import blockindex, dense, labels, lexical, sparse, termblocks
from rankloom.plans.queries import QUERIES, Inputs
from tests.test_operators import clustered


def catalog(n, seed=1):
    """Texts with one word in each, some in many; every fifth is a copy of another, some are empty, null or of stop words."""
    rng = random.Random(seed)
    texts = [" ".join(["All", *rng.choices([f"w{k}" for k in range(12)], k=rng.randint(0, 9)), rng.choice(["ÉTÉ x_1", "the", ""])]) for _ in range(n)]
    return [(i, None if i % 31 == 30 else "" if i % 31 == 29 else "the of" if i % 31 == 28 else texts[i // 5 * 5] if i % 5 == 4 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("top", [1, 7, 300])
def test_same_rows_as_scoring_everything(spark, monkeypatch, top):
    for name, value in (("TOKENS", 60), ("QUERIES", 3), ("SCORES", 36), ("REMEMBERED", 3 * top)):
        monkeypatch.setattr(termblocks, name, value)
    rows = catalog(200)
    items = spark.createDataFrame([*rows, (None, "all w1 w1")], "item_id long, text string").repartition(3)
    made = written(termblocks.blocks(items, "item_id", "text"))
    assert made.count() > 15 and sorted(map(tuple, termblocks.opened(made.where("ids IS NOT NULL"), "item_id").where("item_id IS NOT NULL").collect())) == sorted(map(tuple, counted_tokens(items, "item_id", "text").where("item_id IS NOT NULL").collect()))
    wanted = [(q, t, float(w)) for q in range(10) for t, w in (("all", -1), ("w1", q), ("w1", 1), (f"w{q}", 2), ("été", 0), ("absent", 5))] + [(None, "all", 1.0), (77, None, 1.0), (78, "absent", 1.0)]
    weights = Counter()
    for q, t, w in wanted:
        if q is not None and t is not None:
            weights[q, t] += w
    found = {i: Counter(w for w in (t or "").lower().split() if len(w) > 1 and w not in STOP_WORDS) for i, t in rows}
    want = set()
    for q in range(10):
        scores = {i: sum(weights[q, t] * c for t, c in terms.items()) for i, terms in found.items() if any((q, t) in weights for t in terms)}
        want |= {(q, i, s, r) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top], 1)}
    got = termblocks.search(made, spark.createDataFrame(wanted, "query_id long, term string, weight double"), sparse.raw_counts, top)
    assert {tuple(r) for r in got.collect()} == want


def test_same_rows_as_the_index(spark, monkeypatch):
    monkeypatch.setattr(termblocks, "TOKENS", 100)
    items = spark.createDataFrame(catalog(300, 2), "item_id long, text string").repartition(2)
    queries = spark.createDataFrame([(q, f"all w{q} w{q + 1} w3 été") for q in range(8)] + [(8, None), (9, "nowhere")], "query_id long, query string")
    index = blockindex.build(lexical.postings(lexical.counts(items), 300), new_path(spark, "index"))
    made = written(termblocks.blocks(items, "item_id", "text"))
    assert sorted(map(tuple, lexical.scan(made, 300, queries, 9).collect())) == sorted(map(tuple, lexical.search(index, queries, 9).collect()))
    empty = written(termblocks.blocks(items.limit(0), "item_id", "text"))
    assert lexical.scan(empty, 0, queries).count() == 0 and lexical.scan(made, 300, queries.limit(0)).count() == 0
    text = written(termblocks.blocks(items.withColumn("item_id", F.concat(F.lit("i"), "item_id")), "item_id", "text"))
    assert [r.item_id for r in lexical.scan(text, 300, queries.where("query_id = 0"), 300).orderBy("score", F.desc("item_id")).select("item_id").limit(1).collect()][0].startswith("i")


@pytest.mark.parametrize("name", ["bm25_topk", "sparse_topk", "sparse_variants"])
def test_no_pairs_are_shuffled(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("item_id" in line.split("hashpartitioning")[1] for line in exchanges)


def test_a_task_hands_on_few_rows(spark, monkeypatch):
    """Every item matches every query; after the first blocks hardly any row can still be among the best."""
    monkeypatch.setattr(termblocks, "TOKENS", 2000)
    items = spark.range(400).select(F.col("id").alias("item_id"), F.expr("concat('all', repeat(' more', int(id * 79 % 400)))").alias("text")).coalesce(1)
    made = written(termblocks.blocks(items, "item_id", "text")).coalesce(1)
    wanted = spark.range(20).select(F.col("id").alias("query_id"), F.lit("all").alias("term"), F.lit(1.0).alias("weight"))
    per_size = lambda tf, size, df: tf / size
    assert made.count() > 30 and termblocks.scored(made, wanted, per_size, 5, False).count() < 1000  # of 8000
    assert [r.score for r in termblocks.search(made, wanted, per_size, 5).where("query_id = 3").orderBy("rank").collect()] == [1.0, 0.5, 0.333333, 0.25, 0.2]


def test_few_queries_meet_each_block_of_items_once(spark, monkeypatch):
    for name, value in (("ITEM_VALUES", 256), ("QUERY_VALUES", 128), ("FEW", 4)):
        monkeypatch.setattr(dense, name, value)
    x, counts = clustered(1200, 8, 12, 1), []
    frame = lambda rows, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{key} int, vector array<double>")
    got = dense.search(frame(x, "item_id"), frame(x[::80], "query_id"), 10, None, counts)
    want = {(q, i) for q, line in enumerate(np.round(x[::80] @ x.T, 6)) for i in np.lexsort((np.arange(len(line)), -line))[:10].tolist()}
    assert {(r.query_id, r.item_id) for r in got.collect()} == want
    assert counts[0]["pairs"] < 150  # with the queries split over the items' cells, several times as many


def test_prompts_shuffle_the_texts_of_their_items_only(spark):
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("2", "999")], "query_id string, item_id string")
    queries = spark.createDataFrame([(1, "q")], "query_id long, query string")
    texts = spark.range(50).select(F.col("id").alias("item_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    made = labels.prompts(pairs, queries, texts, "{query} {text}")
    assert sorted(r.prompt for r in made.collect()) == ["q t2", "q t3"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan


def test_few_blocks_are_read_at_once(spark, sf, monkeypatch):
    """A reader takes what a row group has at once, so one of many blocks of megabytes would not fit in memory."""
    monkeypatch.setattr(termblocks, "TOKENS", 500)
    x = Inputs(spark, sf)
    monkeypatch.setattr(Inputs, "state", lambda self: ("few blocks",))
    vectors = dense.packed(x.items, "item_id", 1 << 10, None, x.items.count(), 64)
    for made in (x.blocks(), vectors):
        files = [pq.ParquetFile(name.removeprefix("file://")).metadata for name in made.inputFiles()]
        assert sum(f.num_rows for f in files) > 16
        assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 4
