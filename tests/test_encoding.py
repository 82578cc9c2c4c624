"""Encoding in columns, pooling of matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import encoding

TEXTS = [(1, "b bb"), (2, None), (3, ""), (None, "a"), (3, "a a a"), (4, "x" * 5000)]


def vowels():
    """A dense model: lengths and numbers of a and b; it notes how long the texts of a call are."""
    return lambda texts: np.array([[len(t), t.count("a"), t.count("b")] for t in texts], float)


def letters():
    return encoding.of_dicts(lambda texts: [{ord(c): float(t.count(c)) for c in sorted(set(t) - {" "})} for t in texts])


def test_dense_vectors(spark):
    df = spark.createDataFrame(TEXTS, "item_id long, text string")
    got = sorted(encoding.dense(df, "item_id", "text", vowels, batch=2).collect(), key=str)
    want = sorted(((k, [float(len(t or "")), float((t or "").count("a")), float((t or "").count("b"))]) for k, t in TEXTS), key=str)
    assert sorted((r.item_id, r.vector) for r in got if r.item_id is not None) == sorted(x for x in want if x[0] is not None) and len(got) == len(TEXTS)
    assert encoding.dense(df.limit(0), "item_id", "text", vowels).count() == 0


def test_sparse_vectors_without_a_row_a_term(spark):
    df = spark.createDataFrame(TEXTS, "item_id long, text string")
    rows = encoding.sparse(df, "item_id", "text", letters, batch=4)
    assert sorted((r.item_id or 0, len(r.term_ids)) for r in rows.collect()) == [(0, 1), (1, 1), (2, 0), (3, 0), (3, 1), (4, 1)]
    assert {(r.item_id, r.term_id, r.weight) for r in encoding.opened(rows, "item_id").collect()} == {(1, 98, 3.0), (None, 97, 1.0), (3, 97, 3.0), (4, 120, 5000.0)}


def test_texts_of_like_length_go_together(spark):
    def spread():
        return lambda texts: np.full((len(texts), 1), max(map(len, texts)) - min(map(len, texts)))

    df = spark.createDataFrame([(i, "x" * (i * 37 % 100)) for i in range(100)], "item_id int, text string").coalesce(1)
    assert encoding.dense(df, "item_id", "text", spread, batch=10).agg(F.max(F.col("vector")[0])).first()[0] == 9.0


def test_a_model_that_gives_too_few_rows_fails(spark):
    def short():
        return lambda texts: np.zeros((1, 2))

    df = spark.createDataFrame([(1, "a"), (2, "b")], "item_id int, text string").coalesce(1)
    with pytest.raises(Exception, match="1 rows for 2 texts"):
        encoding.dense(df, "item_id", "text", short).collect()


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_pooled_matrices(spark, monkeypatch, at_once):
    monkeypatch.setattr(encoding, "POOL_VALUES", at_once * 4)
    rng = np.random.default_rng(3)
    items = [(i % 9, rng.normal(size=(int(n), 4)), rng.integers(0, 2, int(n))) for i, n in enumerate(rng.integers(0, 6, 14))]
    df = spark.createDataFrame([(k, x.ravel().tolist(), m.tolist()) for k, x, m in items] + [(99, None, None)], "item_id int, logits array<double>, mask array<int>")
    want = {}
    for k, x, m in items:
        for row, on in zip(x, m, strict=True):
            for t, v in enumerate(row):
                w = round(float(np.log1p(max(v, 0)) * on), 6)
                want[k, t] = max(want.get((k, t), 0.0), w)
    assert {(r.item_id, r.term_id): r.weight for r in encoding.pooled(df, "item_id", 4).collect()} == {k: w for k, w in want.items() if w > 0}
