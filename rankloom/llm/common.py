"""Helpers shared by the training-data operators.

Texts are handled as UTF-8 bytes inside Arrow batches. A null text counts as an empty one
unless an operator's docstring says otherwise. Batches are cut into slices of a few megabytes
before Python objects are made, so a worker's memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
CACHE_WORDS = 100_000
#: Rows that Spark hands to Python at once; its own default of 10,000 makes batches of whole texts large.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch, unless the session asks for fewer still.

    This is a setting of the session, which the operators here leave behind: plans are lazy, and Spark looks it up when it runs them.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: int = -1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of `batch` of about SLICE_BYTES of text, each with its texts as bytes."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
    ends = np.searchsorted(np.cumsum(sizes), np.arange(1, sizes.sum() // SLICE_BYTES + 1) * SLICE_BYTES, side="right")
    edges = np.unique(np.concatenate(([0], ends, [batch.num_rows])))
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        part = batch.slice(int(start), int(end - start))
        yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, keep: list[str], text: str, fields: list[T.StructField], work: Callable[..., list], rows: bool = False) -> DataFrame:
    """The columns `keep` of `df` and, beside them, `fields` that `work` makes from the whole texts; no shuffle.

    `work` gets a list of texts (and, with `rows`, the batch of kept columns) and returns one Arrow array for each
    field. A kept column with the name of a field gives way to it.
    """
    modest_batches(df.sparkSession)
    names = [f.name for f in fields]
    keep = [c for c in keep if c not in names]
    own = [f"c{i}" for i in range(len(keep))]
    kept = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, own, strict=True)])
    source = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, own, strict=True)], F.col(f"`{text}`").cast("string").alias("_text"))
    made = [T.StructField(f"f{i}", f.dataType, f.nullable) for i, f in enumerate(fields)]

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(work(texts, part) if rows else work(texts))], names=[*own, *(f.name for f in made)])

    return source.mapInArrow(run, T.StructType([*kept.schema.fields, *made])).toDF(*keep, *names)


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns named c0, c1, ..., so that none clashes with a name an operator uses, and the new name of each."""
    new = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new


def squeezed(df: DataFrame, keep: list[str], text: str, name: str = "_z") -> DataFrame:
    """The columns `keep` and the text compressed as `name` (null stays null), for texts that have to be shuffled."""

    def work(texts, part):
        squeeze = zstandard.ZstdCompressor(level=1)
        there = part.column(part.num_columns - 1).is_valid().to_pylist()
        return [pa.array([squeeze.compress(t) if x else None for t, x in zip(texts, there, strict=True)], pa.binary())]

    return map_texts(df, keep, text, [field(name, "binary")], work, rows=True)


def unsqueezed(df: DataFrame, keep: list[str], text: str, name: str = "_z") -> DataFrame:
    """The columns `keep` and `text`, from the compressed column `name`."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts = [None if z is None else unpack.decompress(z) for z in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.binary()).cast(pa.string())], names=[*keep, text])

    return df.select(*[F.col(f"`{c}`") for c in keep], name).mapInArrow(run, kept.schema.add(text, "string"))


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if kind not in ATOMIC else ATOMIC[kind])


ATOMIC = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "boolean": T.BooleanType(),
    "longs": T.ArrayType(T.LongType()),
    "ints": T.ArrayType(T.IntegerType()),
    "strings": T.ArrayType(T.StringType()),
}


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads close values (the public murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of `size` consecutive entries."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mixed(out)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype(), copy=False), type=kind))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part` when divided by `parts`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def hash_bound(most: int, size: int) -> int:
    """The greatest signed 64-bit hash of a share of `most` in `size` rows; at least one row in 2**64 is within it."""
    return min(2**63 - 1, -(2**63) + max(1, (most << 64) // max(1, size)))


def hashed_share(key: Column, most: int, size: int) -> Column:
    """Whether a row is in the sample of about `most` of `size` rows, by a hash of its key."""
    return F.xxhash64(key) <= F.lit(hash_bound(most, size))
