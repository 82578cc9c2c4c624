"""Label stores in buckets, scans of partitioned tables, bounded samples, stacked slates."""

from hashlib import md5

from pyspark.sql import functions as F

from rankloom.functions.lineage import files, new_path
from rankloom.functions.ranking import sampled_within
from rankloom.operators import catalog, funnel, labels
from rankloom.sources import tables


def rows_of(spark, n, label, day, step=1):
    return spark.range(0, n, step).selectExpr("CAST(id % 7 AS STRING) AS query_id", "CAST(id AS STRING) AS item_id", f"'{label}' AS label", f"TIMESTAMP '2024-01-0{day} 00:00:00' AS labeled_at")


def test_an_upsert_leaves_what_is_there_alone(spark):
    store = new_path(spark, "labels")
    labels.append(rows_of(spark, 200, "E", 1), store, 8)
    before = set(files(spark, store))
    one = rows_of(spark, 1, "I", 2)
    labels.append(one, store, 8)
    assert before < set(files(spark, store))
    touched = labels.compact(spark, store)
    assert touched == [one.select(labels.bucket(8)).first()[0]]
    after = set(files(spark, store))
    assert len(before - after) == 1 and len(after) == 8  # only the one bucket was written anew
    found = labels.latest(spark, store)
    assert found.count() == 200 and [r.item_id for r in found.where("label = 'I'").collect()] == ["0"]


def test_latest_wins_and_equals_an_upsert(spark):
    store = new_path(spark, "labels")
    parts = [rows_of(spark, 60, "E", 1), rows_of(spark, 60, "S", 3, 2), rows_of(spark, 60, "C", 2, 3)]
    for part in parts:
        labels.append(part, store, 4)
    want = {tuple(r) for r in labels.upserted(labels.upserted(parts[0], parts[1]), parts[2]).collect()}
    assert {tuple(r) for r in labels.latest(spark, store).collect()} == want
    labels.compact(spark, store)
    assert {tuple(r) for r in labels.latest(spark, store).collect()} == want and labels.compact(spark, store) == []
    assert labels.latest(spark, new_path(spark, "labels")).count() == 0


def test_only_the_wanted_files_are_opened(spark):
    path = new_path(spark, "examples")
    rows = spark.range(100).selectExpr("id AS query_id", "'q' AS query", "id AS item_id", "'E' AS label", "IF(id % 2 = 0, 'us', 'es') AS locale", "IF(id % 3 = 0, 'train', 'test') AS split")
    tables.write_partitioned(rows, path, ["locale", "split"])
    found = tables.judgments_at(spark, path, "us", "test")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(locale" in plan and "ReadSchema: struct<query_id:bigint,query:string,item_id:bigint,label:string>" in plan
    assert found.count() == sum(i % 2 == 0 and i % 3 != 0 for i in range(100)) and all("locale=us/split=test" in r[0] for r in found.select(F.input_file_name()).collect())
    plain = new_path(spark, "examples")
    rows.write.parquet(plain)
    pushed = tables.judgments(tables.parquet(spark, plain), "us", "test")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(locale), IsNotNull(split), EqualTo(locale,us), EqualTo(split,test)]" in pushed


def test_lines_that_are_no_interactions_are_left_out(spark):
    path = new_path(spark, "interactions")
    spark.createDataFrame([('{"user_id": 1, "item_id": 2, "ts": "2024-01-01T00:00:00Z", "event_id": 3, "more": 4}',), ("oops",), ('{"user_id": 5}',)], "value string").write.text(path)
    assert sorted((r.user_id, r.item_id) for r in tables.interactions_jsonl(spark, path).collect()) == [(1, 2), (5, None)]


def test_bounded_samples_of_groups_of_any_size(spark):
    rows = [("a", i) for i in range(3000)] + [("b", i) for i in range(5)] + [(None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, id int")
    got = {(r.g, r.id) for r in sampled_within(df, ["g"], F.col("id"), 20).collect()}
    for g in ("a", "b", None):
        own = sorted((i for x, i in rows if x == g), key=lambda i: md5(f"42:{i}".encode()).hexdigest())
        assert {i for x, i in got if x == g} == set(own[:20])
    assert sampled_within(df.limit(0), ["g"], F.col("id"), 20).count() == 0


def test_the_last_label_of_an_item_counts(spark):
    df = spark.createDataFrame([(1, 1, "E", 1), (1, 1, "I", 2), (1, 2, "S", 1), (2, 1, None, 1)], "query_id int, item_id int, label string, at int")
    assert {(r.query_id, r.item_id): r.label for r in catalog.labels_by_item(df, ["at"]).collect()} == {(1, 1): "I", (1, 2): "S", (2, 1): None}
    means = catalog.per_query_means(df).first()
    assert (means.n_queries, means.mean_rows, means.mean_items, means.mean_exact) == (2, 2.0, 1.5, 0.5)
    assert catalog.per_query_means(df.limit(0)).first().n_queries == 0


def test_stacked_slates(spark):
    targets = spark.createDataFrame([(1, 11), (2, 99), (3, 5)], "user_id int, item_id int")
    slate = lambda rows: spark.createDataFrame(rows, "user_id int, item_id int, rank int")
    slates = {"p": slate([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2), (8, 1, 1)]), "v": slate([(1, 12, 1)])}
    stack = funnel.stacked(slates, targets)
    outputs = spark.createDataFrame([("p", "natural", 1, "[11,10]"), ("p", "oracle", 2, "[99]")], "retriever string, mode string, user_id int, raw string")
    got = {(r.retriever, r.mode, r.ordering): (r.n_users, r.recall, r.mrr) for r in funnel.stacked_metrics(funnel.with_orders(stack, outputs), targets).collect()}
    third, two = round(1 / 3, 6), round(2 / 3, 6)
    assert got == {
        ("p", "natural", "incoming"): (3, third, round(0.5 / 3, 6)),
        ("p", "natural", "permuted"): (3, third, third),
        ("p", "oracle", "incoming"): (3, 1.0, two),
        ("p", "oracle", "permuted"): (3, 1.0, round(2.5 / 3, 6)),
        ("v", "natural", "incoming"): (3, 0.0, 0.0),
        ("v", "natural", "permuted"): (3, 0.0, 0.0),
        ("v", "oracle", "incoming"): (3, 1.0, 1.0),
        ("v", "oracle", "permuted"): (3, 1.0, 1.0),
    }


def test_times_later_than_a_target(spark):
    train = spark.createDataFrame([(1, 1, 1, f"2024-01-0{d} 00:00:0{s}") for d in (1, 2) for s in range(4)], "user_id int, item_id int, pos int, t string").select("user_id", "item_id", "pos", F.to_timestamp("t").alias("ts"))
    targets = spark.createDataFrame([(1, 9, 9, "2024-01-01 00:00:02"), (2, 9, 9, "2024-01-03 00:00:00")], "user_id int, item_id int, pos int, t string").select("user_id", "item_id", "pos", F.to_timestamp("t").alias("ts"))
    assert funnel.leakage(train, targets).first().later_share == round((5 / 8 + 0) / 2, 6)
