"""Hand-computed cases for the semantics that are easy to get wrong."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.functions.lineage import new_path
from rankloom.functions.ranking import numbered, quantiles, running
from rankloom.functions.text import counted_tokens, filled, squeezed, tokenize
from rankloom.operators import blockindex, catalog, dense, funnel, fusion, labels, lexical, relevance, sparse


def run_of(spark, rows):
    return spark.createDataFrame(rows, "query_id int, method string, method_ord int, item_id int, score double, rank int")


def test_tokens_keep_counts_and_drop_stop_words(spark):
    df = spark.createDataFrame([(1, "The cat, the CAT a b2 été_x"), (2, None)], "item_id int, text string")
    assert sorted(r.term for r in tokenize(df, "item_id", "text").collect()) == ["b2", "cat", "cat", "été_x"]


def test_tokens_are_counted_within_their_row(spark):
    df = spark.createDataFrame([(1, "the cat b2 a CAT cat x1"), (2, None), (3, "the"), (4, "é1 É1")], "item_id int, text string")
    assert sorted(map(tuple, counted_tokens(df, "item_id", "text").collect())) == [(1, 5, "b2", 1), (1, 5, "cat", 3), (1, 5, "x1", 1), (4, 2, "é1", 2)]


def test_running_sums_and_quantiles_over_many_tasks(spark):
    rng = np.random.default_rng(5)
    rows = [(None if g == 2 else "ab"[g], int(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300)))]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = {r.i: r.before for r in running(df, ["g"], ["v", "i"], "v").collect()}
    assert all(got[i] == sum(w for h, w, j in rows if h == g and (w, j) < (v, i)) for g, v, i in rows)
    assert sorted((r.i, r.n) for r in numbered(df, ["i"], "n").collect()) == [(i, i) for i in range(300)]
    for g, low, mid in quantiles(df.where("g IS NOT NULL"), ["g"], "v", {"low": 0.05, "mid": 0.5}).collect():
        own = [v for h, v, _ in rows if h == g]
        assert (low, mid) == pytest.approx((np.percentile(own, 5), np.percentile(own, 50)))
    assert quantiles(df, [], "v", {"top": 1.0}).first().top == max(v for _, v, _ in rows)
    assert quantiles(df.where("i < 0"), [], "v", {"top": 1.0}).first().top is None


def test_template_collapses_white_space(spark):
    df = spark.createDataFrame([("a  b", None)], "t string, b string")
    assert df.select(squeezed(filled("{t}. {b}. Brand: {b}", {"t": F.col("t"), "b": F.col("b")}))).first()[0] == "a b. . Brand:"


def test_last_row_wins_for_repeated_ids(spark):
    cols = "product_id string, product_title string, product_bullet_point string, product_description string, product_brand string, product_color string, at int"
    df = spark.createDataFrame([("p", "old", "", "", "", "", 1), ("p", "new", "", "", "", "", 2)], cols)
    assert [r.text for r in catalog.item_text(df, "{title}", "at").collect()] == ["new"]


def test_cap_keeps_only_required_when_they_are_too_many(spark):
    df = spark.createDataFrame([(str(i),) for i in range(10)], "product_id string")
    assert catalog.capped(df, df.where("product_id < '5'"), 3).count() == 5
    assert catalog.capped(df, df.where("product_id < '5'"), 7).count() == 7


def test_ordinals_over_many_partitions(spark):
    df = spark.range(1000).select(F.format_string("%05d", "id").alias("k")).repartition(7)
    assert [(r.k, r.ordinal) for r in catalog.ordinals(df, "k").orderBy("k").collect()] == [(f"{i:05d}", i) for i in range(1000)]


def test_repeated_query_words_count_again_and_padding(spark):
    items = spark.createDataFrame([(1, "red shoe"), (2, "blue shoe"), (3, "green hat")], "item_id int, text string")
    index = blockindex.build(lexical.postings(lexical.counts(items), 3), new_path(spark, "index"))
    q = spark.createDataFrame([(1, "red"), (2, "red red")], "query_id int, query string")
    got = {(r.query_id, r.item_id): r.score for r in lexical.search(index, q).collect()}
    assert got[2, 1] == pytest.approx(2 * got[1, 1], abs=2e-6) and len(got) == 2
    full = lexical.padded(lexical.search(index, q), items, q, 2)
    assert [(r.item_id, r.score > 0) for r in full.where("query_id = 1").orderBy("rank").collect()] == [(1, True), (2, False)]


def test_sparse_forms(spark):
    rows = [(1, {0: 1.0, 9: 2.0}, None, None, None), (2, None, [1, 1, 50], [1.0, 3.0, 4.0], None), (3, None, None, None, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "item_id int, as_map map<int,double>, indices array<int>, values array<double>, dense array<double>")
    got = {(r.item_id, r.term_id): r.weight for r in sparse.normalised(df, 10).collect()}
    assert got == {(1, 0): 1.0, (1, 9): 2.0, (2, 1): 3.0, (3, 1): 5.0}


def test_dense_search_in_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(dense, "ITEM_VALUES", 6)
    monkeypatch.setattr(dense, "QUERY_VALUES", 4)
    items = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "item_id int, vector array<float>")
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "query_id int, vector array<float>")
    got = dense.search(items, q, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id) for r in got] == [(k, i) for k in range(5) for i in (2, 5)]


def clustered(n, size, centres, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, size))[rng.integers(0, centres, n)] * 4 + rng.normal(size=(n, size)) * 0.05
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).round(4)


@pytest.mark.parametrize("with_had", [False, True])
def test_pairs_of_blocks_are_skipped_exactly(spark, monkeypatch, with_had):
    for name, value in (("ITEM_VALUES", 256), ("QUERY_VALUES", 128), ("FEW", 4)):
        monkeypatch.setattr(dense, name, value)
    items, asked = clustered(1200, 8, 12, 1), clustered(1200, 8, 12, 1)[::15]
    df = lambda x, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} int, vector array<double>")
    had = {(q, i) for q in range(len(asked)) for i in np.argsort(-(asked[q] @ items.T))[:7].tolist()} | {(0, i) for i in range(1195)} if with_had else set()
    counts = []
    got = dense.search(df(items, "item_id"), df(asked, "query_id"), 10, spark.createDataFrame(list(had), "query_id int, item_id int") if with_had else None, counts)
    want = set()
    for q, row in enumerate(np.round(asked @ items.T, 6)):
        order = [i for i in np.lexsort((np.arange(len(row)), -row)).tolist() if (q, i) not in had][:10]
        want |= {(q, i, k) for k, i in enumerate(order, 1)}
    assert {(r.query_id, r.item_id, r["rank"]) for r in got.collect()} == want
    assert counts[0]["pairs"] > 200 and counts[0]["scored"] < counts[0]["pairs"] / 2


def test_a_pair_of_blocks_emits_no_more_than_top_rows_a_query(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "item_id int, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id int, vector array<double>")
    blocks, asked = dense.packed(items, "item_id", 60, None, 50, 2), dense.packed(q.where("query_id < 3"), "query_id", 8, None, 2, 2).withColumn("least", F.transform("ids", lambda _: F.lit(float("-inf"))))
    pairs = asked.select(F.col("block").alias("asking")).crossJoin(blocks.select("block"))
    had = spark.createDataFrame([(asked.first().block, b.block, [(0, 0)]) for b in blocks.collect()], "asking long, block long, at array<struct<query:int,item:int>>")
    assert dense.scored(pairs, asked, blocks, had, 3, 2, {"query_id": "int", "item_id": "int"}).count() <= 3 * 2 * blocks.count()
    assert [r.item_id for r in dense.search(items, q, 3).where("query_id = 1").orderBy("rank").collect()] == [0, 1, 2]


def test_users_get_what_they_have_not_had(spark):
    rng = np.random.default_rng(7)
    train = list({(int(u), int(i)) for u, i in zip(rng.integers(0, 6, 60), rng.zipf(1.5, 60) % 12)} | {(9, i) for i in range(12)})
    df = spark.createDataFrame(train, "user_id int, item_id int")
    users = spark.createDataFrame([(u,) for u in (*range(6), 9, 77)], "user_id int")
    count = {i: sum(j == i for _, j in train) for _, i in train}
    want = {(u, i, r) for u in (*range(6), 9, 77) for r, i in enumerate([i for i in sorted(count, key=lambda i: (-count[i], i)) if (u, i) not in train][:4], 1)}
    assert {(r.user_id, r.item_id, r.rank) for r in funnel.popularity(df, users, 4).collect()} == want
    items = spark.createDataFrame([(i, [float(-i), 1.0]) for i in range(12)], "item_id int, vector array<float>")
    vectors = users.select(F.col("user_id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    nearest = {(u, i, r) for u in (*range(6), 9, 77) for r, i in enumerate([i for i in range(12) if (u, i) not in train][:3], 1)}
    assert {(r.user_id, r.item_id, r.rank) for r in funnel.vector_topk(vectors, items, df, 3).collect()} == nearest
    assert funnel.popularity(df.limit(0), users, 4).count() == 0 and dense.search(items.limit(0), vectors, 3).count() == 0


def shuffled(plan):
    """Bytes of all shuffles of an executed plan, those under its stages included."""
    made, more = 0, [plan]
    while more:
        node = more.pop()
        if node.nodeName() == "Exchange" and node.metrics().contains("dataSize"):
            made += node.metrics().apply("dataSize").value()
        children = node.children()
        more += [children.apply(i) for i in range(children.size())]
        more += [getattr(node, name)() for name, kind in (("executedPlan", "AdaptiveSparkPlan"), ("plan", "QueryStage")) if node.nodeName().endswith(kind)]
    return made


def test_no_matrix_is_shuffled_for_each_of_its_pairs(spark, monkeypatch):
    for name, value in (("ITEM_VALUES", 256), ("QUERY_VALUES", 128), ("FEW", 4)):
        monkeypatch.setattr(dense, name, value)
    x = np.random.default_rng(3).normal(size=(800, 16))
    df = lambda rows, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{key} int, vector array<double>")
    counts, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the blocks are large
    try:
        got = dense.search(df(x, "item_id"), df(x[:400], "query_id"), 5, None, counts)
        rows = {(r.query_id, r.item_id) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert counts[0]["scored"] > 1000  # of blocks of about 16 items and 8 queries, 3 KB a pair
    want = {(q, i) for q, row in enumerate(np.round(x[:400] @ x.T, 6)) for i in np.lexsort((np.arange(800), -row))[:5].tolist()}
    assert rows == want
    assert shuffled(got._jdf.queryExecution().executedPlan()) < 1_000_000


@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_history_vectors_with_and_without_a_broadcast(spark, monkeypatch, sent):
    monkeypatch.setattr(funnel, "SENT_VALUES", sent)
    rng = np.random.default_rng(5)
    items = rng.normal(size=(30, 4))
    train = {u: set(rng.integers(0, 40, 12).tolist()) for u in range(50)} | {99: {35, 36}}
    rows = spark.createDataFrame([(u, i) for u, own in train.items() for i in [*own, *own]], "user_id int, item_id int")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)] + [(31, None), (32, [])], "item_id int, vector array<double>")
    got = {r.query_id: np.array(r.vector) for r in funnel.history_vectors(rows, vectors).collect()}
    want = {u: items[sorted(i for i in own if i < 30)].mean(0) for u, own in train.items() if u != 99}
    assert set(got) == set(want) and all(np.allclose(got[u], v / np.linalg.norm(v), atol=1e-7) for u, v in want.items())


def test_best_of_many_blocks_keeps_ties_in_order():
    rng = np.random.default_rng(11)
    q, v = rng.normal(size=(300, 6)).round(1), rng.normal(size=(900, 6)).round(1)
    v[100:] = v[rng.integers(0, 100, 800)]  # copies, so that most cuts fall into a tie
    v[::7] *= 1e4
    had = rng.random((300, 900)) < 0.3
    for top in (1, 7, 400):
        best, order = dense.Best(q, np.full(300, -np.inf), top), rng.permutation(900)
        for at in np.array_split(order, [5, 200, 210, 700]):
            at = np.sort(at)
            best.meet(pa.array(at), v[at], *np.nonzero(had[:, at]))
        found = best.found(pa.array(np.arange(300))).to_pydict()
        scores = np.where(had, -np.inf, np.round(q @ v.T, 6))
        want = [(k, i) for k, row in enumerate(scores) for i in np.lexsort((np.arange(900), -row))[: min(top, int((row > -np.inf).sum()))].tolist()]
        assert list(zip(found["query_id"], found["item_id"], strict=True)) == want


def test_user_caps(spark):
    df = spark.createDataFrame([(u, i, u * 10 + i) for u in range(9) for i in range(3)], "user_id int, item_id int, ts int")
    assert funnel.histories(df, most_users=4).select("user_id").distinct().count() == 4 and funnel.histories(df).count() == 27
    train, target = funnel.split(funnel.histories(df), 2)
    assert (train.count(), target.count()) == (18, 2)


def test_zero_vector_stays(spark):
    assert spark.range(1).select(dense.unit(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_rrf_ties_go_to_the_earliest_list(spark):
    run = run_of(spark, [(1, "b", 1, 10, 1.0, 1), (1, "a", 0, 20, 1.0, 1), (1, "a", 0, 30, 0.5, 2), (1, "b", 1, 40, 0.5, 2)])
    assert [r.item_id for r in fusion.rrf(run).orderBy("rank").collect()] == [20, 10, 30, 40]


def test_minmax_of_one_score_is_half(spark):
    run = run_of(spark, [(1, "bm25", 0, 1, 7.0, 1), (1, "dense", 1, 1, 1.0, 1), (1, "dense", 1, 2, 0.0, 2)])
    assert {(r.method, r.item_id): r.norm for r in fusion.minmax(run).collect()} == {("bm25", 1): 0.5, ("dense", 1): 1.0, ("dense", 2): 0.0}
    assert {r.item_id: r.score for r in fusion.weighted(run).collect()} == {1: pytest.approx(0.45), 2: 0.0}


def test_rerank_is_stable_and_keeps_the_set(spark):
    run = run_of(spark, [(1, "dense", 0, i, 1.0 - i / 10, i) for i in range(1, 5)])
    lexical_run = spark.createDataFrame([(1, 3, 2.0, 1)], "query_id int, item_id int, score double, rank int")
    assert [r.item_id for r in fusion.reranked(run, lexical_run).orderBy("rank").collect()] == [3, 1, 2, 4]


@pytest.fixture
def small(spark):
    qrels = spark.createDataFrame([(1, 1, "E"), (1, 2, "S"), (1, 3, "I"), (2, 4, "I"), (3, 5, "E")], "query_id int, item_id int, label string")
    run = run_of(spark, [(1, "m", 0, 3, 3.0, 1), (1, "m", 0, 1, 2.0, 2), (1, "m", 0, 99, 1.0, 3), (2, "m", 0, 4, 1.0, 1)])
    return run, qrels


def test_empty_results_count_as_zero_in_retrieval(small):
    run, qrels = small
    got = relevance.retrieval(run, qrels, [10]).first()
    assert got.num_queries == 3 and got.recall_exact == pytest.approx(1 / 3, abs=1e-6)
    assert got.share_unlabeled == pytest.approx(1 / 9, abs=1e-6)


def test_empty_results_are_left_out_of_pool_means(small):
    run, qrels = small
    got = relevance.curated(run, qrels, [10]).first()
    dcg, ideal = 1.0 / math.log2(3), 1.0 + 0.7 / math.log2(3)
    assert got.num_queries == 3 and got.ndcg == pytest.approx(dcg / ideal / 2, abs=1e-6)
    assert got.precision == pytest.approx((1 / 3 + 0) / 2, abs=1e-6) and got.mrr == pytest.approx(0.25)


def test_a_method_without_results_has_means_of_zero(small):
    run, qrels = small
    got = {r.method: r for r in relevance.curated(run, qrels, [10], methods=["m", "none"]).collect()}
    assert (got["none"].num_queries, got["none"].ndcg, got["none"].recall_exact) == (3, 0.0, 0.0) and got["m"].ndcg > 0


def test_candidate_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(q, "m", i, float(rng.integers(0, 5)), "ESCI"[rng.integers(0, 4)]) for q in range(4) for i in range(12)] + [(9, "m", 0, 1.0, "X")]
    df = spark.createDataFrame(rows, "query_id int, method string, item_id int, score double, label string")
    gain = {"E": 3, "S": 2, "C": 1}
    got = {r.query_id: r for r in relevance.candidate_metrics(df, [5]).collect()}
    for q in range(4):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[2]))
        g = [gain.get(r[4], 0) for r in own]
        dcg = lambda x: sum(v / math.log2(i + 2) for i, v in enumerate(x[:5]))
        assert got[q].ndcg == pytest.approx(dcg(g) / dcg(sorted(g, reverse=True)), abs=1e-6)
        assert got[q].mrr == pytest.approx(next((1 / (i + 1) for i, v in enumerate(g[:5]) if v >= 1), 0.0), abs=1e-6)
    pos = [r[3] for r in rows if r[4] in "ESC"]
    neg = [r[3] for r in rows if r[4] == "I"]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert relevance.separability(df).first().auc == pytest.approx(auc, abs=1e-6)
    assert relevance.separability(df.where("label = 'E'")).first().auc == 0.0


def test_disagreement(spark):
    run = run_of(spark, [(1, "a", 0, 1, 1.0, 1), (1, "a", 0, 2, 1.0, 2), (1, "b", 1, 2, 1.0, 1), (2, "a", 0, 1, 1.0, 1)])
    q = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, ""), (5, None)], "query_id int, query string")
    run = run.unionByName(run_of(spark, [(i, "a", 0, 1, 1.0, 1) for i in (4, 5)]))
    # An empty set is at distance 1 from one that isn't, two empty ones at 0; without text there is no disagreement.
    assert {r.query_id: r.disagreement for r in labels.disagreement(run, q).collect()} == {1: 0.5, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}
    assert {r.disagreement for r in labels.disagreement(run, q, methods=["a"]).collect()} == {0.0}


def test_store_upsert_and_nested_load(spark):
    nested = spark.createDataFrame([('{"metadata": {}, "labels": {"7": {"p": {"label": "E", "timestamp": "2024-01-01 00:00:00"}}}}',)], "value string")
    store = labels.from_nested(nested)
    new = store.select("query_id", "item_id", F.lit("I").alias("label"), F.expr("TIMESTAMP '2024-03-01 00:00:00'").alias("labeled_at"))
    assert [(r.query_id, r.item_id, r.label) for r in labels.upserted(store, new).collect()] == [("7", "p", "I")]
    assert labels.upserted(labels.upserted(store, new), new).count() == 1


def test_labeling_goes_on_where_it_was_broken_off(spark):
    from rankloom.functions.lineage import new_path

    store = new_path(spark, "labels")
    rows = spark.createDataFrame([(str(i), str(j), f"{i * j}") for i in range(6) for j in range(6)], "query_id string, item_id string, prompt string")

    def failing():
        def answer(prompts):
            if any(p == "25" for p in prompts):
                raise RuntimeError("the service is down")
            return ["?" if p == "0" else "E" for p in prompts]

        return answer

    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    with pytest.raises(Exception, match="the service is down"):
        labels.run_labeling(rows, failing, store, now, batches=6, workers=2)
    before = labels.stored(spark, store).count() if labels.stored(spark, store) else 0
    asked = spark.sparkContext.accumulator(0)

    def counting():
        def answer(prompts):
            asked.add(len(prompts))
            return ["S"] * len(prompts)

        return answer

    labels.run_labeling(rows, counting, store, now, batches=6, workers=2)
    found = labels.stored(spark, store)
    assert found.count() == found.select("query_id", "item_id").distinct().count() == 36
    assert asked.value == 36 - before and found.where("label NOT IN ('E', 'S')").count() == 0


def test_encoding_takes_up_what_is_missing(spark):
    from rankloom.functions.lineage import new_path

    path = new_path(spark, "encoded")
    df = spark.createDataFrame([(i, "w " * i) for i in range(20)], "item_id int, text string")
    made = spark.sparkContext.accumulator(0)

    def encoder():
        def encode(texts):
            made.add(len(texts))
            return [{1: float(len(t))} if t else {} for t in texts]

        return encode

    sparse.resumed(df.where("item_id < 7"), "item_id", "text", encoder, path).collect()
    got = {r.item_id: r.weight for r in sparse.resumed(df, "item_id", "text", encoder, path).collect()}
    assert got == {i: 2.0 * i for i in range(1, 20)} and made.value == 20


def test_agreement_golden_arithmetic(spark):
    cells = [("E", "E", 1422), ("S", "S", 213), ("C", "C", 30), ("I", "I", 111), ("E", "S", 206), ("E", "I", 66), ("E", "C", 47), ("S", "?", 1), ("S", "E", 278), ("C", "S", 22), ("I", "S", 102)]
    df = spark.createDataFrame([(g, p, n) for g, p, n in cells], "gold string, raw string, n int").select("gold", "raw", F.explode(F.sequence(F.lit(1), F.col("n"))))
    got = {r.gold: r for r in labels.agreement(df).collect()}
    assert got["all"].n == 2497 and got["all"].agreement == pytest.approx(1776 / 2497, abs=1e-6) and round(got["all"].agreement, 4) == 0.7113
    assert [(r.gold, r.pred, r.n) for r in labels.confusions(df, 2).collect()] == [("S", "E", 278), ("E", "S", 206)]


def test_parse_label(spark):
    df = spark.createDataFrame([(" e ",), ("Substitute",), ("unknown",), ("",), (None,)], "raw string")
    assert [r[0] for r in df.select(labels.parsed(F.col("raw"))).collect()] == ["E", "S", "?", "?", "?"]


def test_kcore_needs_several_rounds(spark):
    rows = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 9)]
    df = spark.createDataFrame(rows, "user_id int, item_id int")
    assert sorted(map(tuple, funnel.kcore(df, 2).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_oracle_slate_cases(spark):
    slate = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 20, 2)], "user_id int, item_id int, rank int")
    targets = spark.createDataFrame([(1, 99), (2, 10), (3, 5)], "user_id int, item_id int")
    got = sorted(map(tuple, funnel.oracle_slate(slate, targets).collect()))
    assert got == [(1, 10, 1), (1, 99, 2), (2, 10, 1), (2, 20, 2), (3, 5, 1)]
    assert funnel.slate_metrics(funnel.oracle_slate(slate, targets), targets).first().recall == 1.0


def test_permutations(spark):
    slate = spark.createDataFrame([(u, 10 + r, r) for u in (1, 2, 3) for r in (1, 2, 3)], "user_id int, item_id int, rank int")
    outputs = spark.createDataFrame([(1, "[13,11]"), (2, "oops"), (3, "[12,12,77]")], "user_id int, raw string")
    got = funnel.permuted(slate, outputs).orderBy("user_id", "rank").collect()
    assert [r.item_id for r in got] == [13, 11, 12, 11, 12, 13, 12, 11, 13]
    v = funnel.validity(funnel.outputs_with_slates(outputs, slate)).first()
    assert (v.valid_json, v.valid_permutation, v.duplicate, v.out_of_candidate) == (round(2 / 3, 6), 0.0, round(1 / 3, 6), round(1 / 3, 6))


def test_slates_are_put_in_order_as_one_row_each(spark):
    """Several outputs of a user, items named twice, foreign items, nulls and text that is no JSON, against the same in Python; no row of a slate is shuffled on its own."""
    rng = np.random.default_rng(13)
    slates = {u: rng.permutation(30)[:10].tolist() for u in range(2000)}
    raw = {u: [("oops", "[]", "[3,null,3]", str(rng.permutation(40)[:12].tolist()))[k % 4] for k in range(u, u + u % 3)] for u in slates}
    slate = spark.createDataFrame([(u, i, r) for u, own in slates.items() for r, i in enumerate(own, 1)], "user_id int, item_id int, rank int").coalesce(1)
    outputs = spark.createDataFrame([(u, x) for u, own in raw.items() for x in own], "user_id int, raw string").coalesce(1)

    def place(u, i):
        said = [json.loads(x) for x in raw[u] if x != "oops"]
        return min((x.index(i) for x in said if i in x), default=99)

    got = funnel.permuted(slate, outputs)
    want = {(u, i, r) for u, own in slates.items() for r, i in enumerate(sorted(own, key=lambda i: (place(u, i), own.index(i))), 1)}
    assert {(r.user_id, r.item_id, r["rank"]) for r in got.collect()} == want
    assert shuffled(got._jdf.queryExecution().executedPlan()) < 1_200_000


def test_plans(spark, sf):
    from rankloom.plans.queries import QUERIES, Inputs

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(QUERIES["bm25_topk"](spark, sf)) and "CartesianProduct" not in plan(QUERIES["sparse_topk"](spark, sf))
    evaluated = plan(QUERIES["evaluate_curated_pool"](spark, sf))
    assert "CartesianProduct" not in evaluated and "mapInArrow" not in evaluated and evaluated.count("text#") == 0  # the run is read, not searched again
    x = Inputs(spark, sf)
    index = plan(x.postings())
    assert index.count("FileScan parquet") == 2 and "SortMergeJoin" not in index and "text" not in index  # counts are written once, frequencies broadcast
