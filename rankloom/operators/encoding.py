"""Encoding texts by a user's model, and pooling of token logits, in columns.

A model is made once in each task. It takes a list of texts and gives a matrix (a row for each text), the three arrays
of a sparse matrix in compressed rows (where each row begins, term numbers, weights), or a dictionary for each text. Within what a task has at hand, texts of
like length go to the model together, so that padding is short. No row of Python objects is made for a term unless the model gives dictionaries.

A null text is encoded as an empty one. A null key stays null. Repeated rows are encoded as often as they occur. An empty
table gives an empty one, without calling the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.ranking import rounded

Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Values of a matrix of logits that are pooled at once.
POOL_VALUES = 1 << 22


def by_length(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of up to `size` rows of (key, text), the shortest texts first."""
    texts = pc.fill_null(batch.column(1), "")
    batch = pa.RecordBatch.from_arrays([batch.column(0), texts], names=batch.schema.names)
    batch = batch.take(pc.array_sort_indices(pc.utf8_length(texts)))
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def lists(edges: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def dense(df: DataFrame, key: str, text: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> DataFrame:
    """(key, vector) by an encoder that gives a matrix with a row for each text."""

    def run(batches):
        encoder = make_encoder()
        for whole in batches:
            for part in by_length(whole, batch):
                made = np.ascontiguousarray(encoder(part.column(1).to_pylist()), dtype=np.float32)
                if len(made) != part.num_rows:
                    raise ValueError(f"the encoder gave {len(made)} rows for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), lists(np.arange(len(made) + 1) * made.shape[1], pa.array(made.ravel()))], names=[key, "vector"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind(df, key)}, vector array<float>")


def sparse(df: DataFrame, key: str, text: str, make_encoder: Callable[[], Callable[[list[str]], Sparse]], batch: int = 256) -> DataFrame:
    """(key, term_ids, weights) by an encoder that gives a sparse matrix; a text without terms has empty arrays."""

    def run(batches):
        encoder = make_encoder()
        for whole in batches:
            for part in by_length(whole, batch):
                edges, terms, weights = compressed(encoder(part.column(1).to_pylist()))
                if len(edges) != part.num_rows + 1:
                    raise ValueError(f"the encoder gave {len(edges) - 1} rows for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), lists(edges, pa.array(terms, pa.int32())), lists(edges, pa.array(weights, pa.float64()))], names=[key, "term_ids", "weights"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind(df, key)}, term_ids array<int>, weights array<double>")


def opened(vectors: DataFrame, key: str) -> DataFrame:
    """(key, term_id, weight) of (key, term_ids, weights)."""
    pairs = F.arrays_zip(F.col("term_ids").alias("term_id"), F.col("weights").alias("weight"))
    return vectors.select(key, F.inline(pairs)).toDF(key, "term_id", "weight")


def compressed(made: Sparse | list[dict[int, float]]) -> Sparse:
    """A model's sparse matrix; one that it gives as a dictionary for each row is brought into that form."""
    if not isinstance(made, list):
        return made
    edges = np.concatenate(([0], np.cumsum([len(r) for r in made], dtype=np.int64)))
    return edges, np.array([t for r in made for t in r], np.int32), np.array([w for r in made for w in r.values()], np.float64)


def of_dicts(encoder: Callable[[list[str]], list[dict[int, float]]]) -> Callable[[list[str]], Sparse]:
    """An encoder whose rows are dictionaries as one that gives a sparse matrix."""
    return lambda texts: compressed(encoder(texts))


def pooled(logits: DataFrame, key: str, size: int) -> DataFrame:
    """(key, term_id, weight) with weight > 0 of rows (key, logits, mask): the logits of some positions of a text, `size` terms each, one after another.

    The weight of a term is the greatest log1p(relu(logit)) * mask over a text's positions. Maxima are taken in the task, position by
    position of all texts at hand, and only positive ones leave it; rows of the same text then meet by term."""

    def run(batches):
        for batch in batches:
            keys, values, masks = batch.columns
            n = np.asarray(pc.list_value_length(masks).fill_null(0))
            positions = np.concatenate(([0], np.cumsum(n)))
            x, mask = (np.asarray(c.flatten(), np.float64) for c in (values, masks))
            if len(x) != len(mask) * size:
                raise ValueError(f"{len(x)} logits for {len(mask)} positions of {size} terms")
            step = max(1, POOL_VALUES // size)
            i = 0
            while i < len(n):
                # As many texts as fit; one that is longer goes alone.
                j = max(i + 1, int(np.searchsorted(positions, positions[i] + step, side="right")) - 1)
                start, end = positions[i], positions[j]
                rows = np.log1p(np.maximum(np.nan_to_num(x[start * size : end * size], nan=0.0), 0.0)).reshape(-1, size) * np.nan_to_num(mask[start:end])[:, None]
                has = np.flatnonzero(n[i:j])
                best = np.maximum.reduceat(rows, positions[i:j][has] - start, axis=0) if len(has) else rows[:0]
                which, term = np.nonzero(best > 0)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(i + has[which])), pa.array(term, pa.int32()), pa.array(best[which, term])], names=[key, "term_id", "weight"])
                i = j

    found = logits.select(key, "logits", "mask").mapInArrow(run, f"{key} {kind(logits, key)}, term_id int, weight double")
    return found.groupBy(key, "term_id").agg(rounded(F.max("weight")).alias("weight")).where("weight > 0")
