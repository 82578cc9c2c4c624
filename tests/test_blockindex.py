"""The index in blocks: exact results, postings left unread, files left out."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.functions.lineage import new_path
from rankloom.operators import blockindex

POSTINGS = "item_id long, term string, tf long, impact double"


def frame(spark, rows):
    return spark.createDataFrame(rows, POSTINGS)


def brute(postings, wanted, top):
    lists = defaultdict(list)
    for item, term, _, impact in postings:
        if item is not None and term is not None:
            lists[term].append((item, impact))
    scores = defaultdict(lambda: defaultdict(float))
    for q, term, weight in wanted:
        for item, impact in lists.get(term, []):
            scores[q][item] += weight * impact
    return {(q, i, r + 1): round(s, 6) for q, found in scores.items() for r, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-round(x[1], 6), x[0]))[:top])}


def skewed(n, negative=False, seed=1):
    """One term in every item, some in many, most in few; many equal impacts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for term, share, most in [("all", 1.0, 0.2), *((f"m{k}", 0.3, 0.5) for k in range(4)), *((f"r{k}", 0.02, 5.0) for k in range(40))]:
            if rng.random() < share:
                low = -most if negative else 0.0
                rows.append((i, term, rng.randint(1, 3), round(rng.uniform(low, most), 1 if rng.random() < 0.5 else 6)))
    queries = [(q, t, float(rng.choice([-1, 1, 2]) if negative else rng.choice([1, 1, 2]))) for q in range(12) for t in ["all", "m0", *rng.sample([f"m{k}" for k in range(1, 4)] + [f"r{k}" for k in range(40)] + ["absent"], 6)]]
    return rows, queries


@pytest.mark.parametrize("negative", [False, True])
@pytest.mark.parametrize("top", [1, 5, 50])
def test_same_rows_as_scoring_everything(spark, monkeypatch, negative, top):
    monkeypatch.setattr(blockindex, "WORTH", 0)
    rows, queries = skewed(600, negative)
    index = blockindex.build(frame(spark, rows), new_path(spark, "index"), block=16)
    wanted = spark.createDataFrame(queries, "query_id long, term string, weight double")
    got = {(r.query_id, r.item_id, r.rank): r.score for r in blockindex.search(index, wanted, top).collect()}
    assert got == pytest.approx(brute(rows, queries, top), abs=2e-6)


def test_frequent_terms_stay_unread(spark, monkeypatch):
    monkeypatch.setattr(blockindex, "WORTH", 100)
    rows, queries = skewed(3000)
    index = blockindex.build(frame(spark, rows), new_path(spark, "index"), block=32)
    wanted = spark.createDataFrame(queries, "query_id long, term string, weight double")
    counts = []
    got = {(r.query_id, r.item_id, r.rank): r.score for r in blockindex.search(index, wanted, 5, counts).collect()}
    assert got == pytest.approx(brute(rows, queries, 5), abs=2e-6)
    assert counts[0]["all"] > 12 * 3000 and counts[0]["read"] < counts[0]["all"] / 4
    assert counts[0]["looked_up"] < counts[0]["all"] / 4
    monkeypatch.setattr(blockindex, "WORTH", 1_000_000)  # every list is short, and read
    assert {(r.query_id, r.item_id, r.rank): r.score for r in blockindex.search(index, wanted, 5, counts).collect()} == pytest.approx(got, abs=2e-6)
    assert counts[1]["read"] == counts[1]["all"] == counts[0]["all"]


def test_only_the_files_of_the_query_are_scanned(spark, monkeypatch):
    rows = [(i, f"t{i % 50}", 1, 1.0) for i in range(2000)]
    index = blockindex.build(frame(spark, rows), new_path(spark, "index"), block=8)
    terms = blockindex.planned(index, spark.createDataFrame([(1, "t3", 1.0)], "query_id long, term string, weight double"), 5)
    plan = index.blocks_of(terms)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert {r.term for r in index.blocks_of(terms).select("term").collect()} < {f"t{k}" for k in range(50)}
    joined = blockindex.summed(index, terms)._jdf.queryExecution().executedPlan().toString()
    assert joined.count("hashpartitioning(term") == 0  # postings stay where they are read


def test_a_long_list_lies_in_several_buckets(spark):
    index = blockindex.build(frame(spark, [(i, "all", 1, 1.0) for i in range(4000)]), new_path(spark, "index"), block=4)
    found = index.blocks()
    assert found.select("bucket").distinct().count() > 1
    assert found.agg(F.max(F.size("item_ids"))).first()[0] < 40 and index.postings().count() == 4000


def test_odd_rows(spark):
    rows = [(1, "a", 1, 1.0), (1, "a", 1, 1.0), (None, "a", 1, 9.0), (2, None, 1, 9.0), (2, "a", 1, 0.0)]
    index = blockindex.build(frame(spark, rows), new_path(spark, "index"))
    wanted = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, None, 1.0), (3, "z", 1.0), (None, "a", 1.0)], "query_id long, term string, weight double")
    got = {(r.query_id, r.item_id): r.score for r in blockindex.search(index, wanted, 10).where("query_id IS NOT NULL").collect()}
    assert got == {(1, 1): 4.0, (1, 2): 0.0}
    empty = blockindex.build(frame(spark, []), new_path(spark, "index"))
    assert blockindex.search(empty, wanted, 10).count() == 0 and empty.postings().count() == 0
    assert blockindex.search(index, wanted.limit(0), 10).count() == 0


def test_an_unfinished_index_cannot_be_opened(spark):
    with pytest.raises(ValueError):
        blockindex.Index(spark, new_path(spark, "index"))


def test_text_items(spark):
    index = blockindex.build(spark.createDataFrame([("x", "a", 2.0), ("y", "a", 3.0)], "item_id string, term string, impact double"), new_path(spark, "index"))
    wanted = spark.createDataFrame([(1, "a", 1.0)], "query_id long, term string, weight double")
    assert [r.item_id for r in blockindex.search(index, wanted, 2).orderBy("rank").collect()] == ["y", "x"]
