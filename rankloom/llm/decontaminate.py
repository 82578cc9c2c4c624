"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and benchmark items are A-Z lower-cased and cut into words; the symbols of the search are
whole words. Patterns are the windows of consecutive item words; an item of fewer words is one
pattern. For each pattern length a block shift table says how far a search may skip from a pair
of words, a suffix-hash bucket names the patterns that can end at a position that allows no skip,
and a direct comparison of all words confirms each occurrence. Documents never leave their task.

Items are dealt into blocks of about `block_words` words by running counts in Spark. A benchmark of one block is
searched for in one pass. Of a larger one, the driver and each task hold one block at a time: documents are gone
through once for each block, what it finds is written to the shared folder by the text's digest, and joined in the end.

Null text has no words. Items without words are no pattern. A null item id never counts as an
item, though its windows still hit words. Repeated items count once; repeated documents give
repeated rows. Kept columns named like a new one give way to it.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.lineage import cut, new_path
from rankloom.functions.ranking import running
from rankloom.llm.common import field, list_array, map_texts, modest_batches, slices

WINDOW = 10
BLOCK_WORDS = 200_000
HITS = "digest binary, runs array<bigint>, items array<string>"
#: Positions each cursor of the search walks over.
STRIDE = 256
#: Runs are packed as start * SPAN + length.
SPAN = 1 << 32

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


class Vocabulary(dict):
    """Numbers of the patterns' words; any other word is 0, which no pattern holds."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Patterns:
    """Search tables of the patterns of one length."""

    def __init__(self, rows: np.ndarray, owners: list[list[int]]):
        self.rows, self.length = rows, rows.shape[1]
        self.block = min(2, self.length)
        self.bits = max(12, int(rows.size * 4).bit_length())
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.int32)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self.hashed(rows[:, end - self.block + 1], rows[:, end]), self.length - 1 - end)
        suffix = self.hashed(rows[:, -self.block], rows[:, -1])
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1))
        self.owner_at = np.concatenate(([0], np.cumsum([len(x) for x in owners])))
        self.owner = np.array([y for x in owners for y in x], np.int64)

    def hashed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence in `ids`."""
        ends = np.arange(self.length - 1, len(ids), STRIDE)
        limit = np.minimum(ends + STRIDE, len(ids))
        at, key = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while ends.size:
            h = self.hashed(ids[ends - self.block + 1], ids[ends])
            skip = self.shift[h]
            if not skip.all():
                at.append(ends[skip == 0])
                key.append(h[skip == 0])
            ends = ends + np.maximum(skip, 1)
            inside = ends < limit
            ends, limit = ends[inside], limit[inside]
        first, h = np.concatenate(at) - self.length + 1, np.concatenate(key)
        n = self.bucket[h + 1] - self.bucket[h]
        first, low = np.repeat(first, n), np.repeat(self.bucket[h] - (np.cumsum(n) - n), n)
        pattern = self.order[low + np.arange(len(first))] if len(first) else np.empty(0, np.int64)
        for i in range(self.length):
            same = ids[first + i] == self.rows[pattern, i]
            first, pattern = first[same], pattern[same]
        return first, pattern


class Block:
    """The patterns of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.words, self.items = Vocabulary(), [i for i, _ in items]
        found: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, text) in enumerate(items):
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found[size][tuple(ids[i : i + size])].append(k)
        self.tables = [Patterns(np.array(list(rows), np.int64), [sorted(set(x)) for x in rows.values()]) for rows in found.values()]

    def search(self, texts: list[bytes]) -> tuple[list[int], list[np.ndarray], list[list[str]]]:
        """Of each text: its number of words, the runs of hit words as start * SPAN + length, the items found."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        ids = np.zeros(int(sizes.sum()) + len(texts), np.int64)
        for w, b in zip(words, begin.tolist(), strict=True):
            ids[b : b + len(w)] = np.fromiter(map(self.words.__getitem__, w), np.int64, len(w))
        cover = np.zeros(len(ids) + 1, np.int64)
        pairs = [np.empty((0, 2), np.int64)]
        for table in self.tables:
            first, pattern = table.search(ids)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + table.length, -1)
            doc = np.searchsorted(begin, first, side="right") - 1
            n = table.owner_at[pattern + 1] - table.owner_at[pattern]
            low = np.repeat(table.owner_at[pattern] - (np.cumsum(n) - n), n)
            pairs.append(np.unique(np.column_stack((np.repeat(doc, n), table.owner[low + np.arange(int(n.sum()))])), axis=0))
        hit = np.diff(np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0])))
        starts, stops = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        edges = np.searchsorted(starts, np.append(begin, len(ids)))
        runs = [(starts[a:b] - at) * SPAN + (stops[a:b] - starts[a:b]) for a, b, at in zip(edges[:-1], edges[1:], begin, strict=True)]
        items: list[set[str]] = [set() for _ in texts]
        for doc, item in np.concatenate(pairs).tolist():
            if self.items[item] is not None:
                items[doc].add(self.items[item])
        return sizes.tolist(), runs, [sorted(x) for x in items]


def dealt(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> DataFrame:
    """(id, text, block) of the distinct items that have words."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    counted = items.withColumn("n", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).where("n > 0")
    return cut(running(counted, [], ["id", "text"], "n").select("id", "text", F.floor(F.col("before") / block_words).alias("block")))


def block_of(items: DataFrame, number: int, window: int) -> Block:
    """The search tables of one block, whose size is bounded by `block_words` and one item more."""
    rows = items.where(F.col("block") == number).orderBy("id", "text").collect()
    return Block([(r["id"], r["text"].encode()) for r in rows], window)


def merged(runs: Column) -> Column:
    """Runs of several blocks as runs that don't touch, in order."""
    start, stop = lambda x: F.shiftright(x, 32), lambda x: F.shiftright(x, 32) + x % SPAN
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def add(done, x):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (start(x) <= last["b"])
        here = lambda a, b: F.array(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), here(last["a"], F.greatest(last["b"], stop(x).cast("long"))))).otherwise(F.concat(done, here(start(x), stop(x))))

    return F.aggregate(F.array_sort(runs), empty, add)


def contamination(df: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns `keep` and `_n_words` (long), `_runs` (maximal runs [a, b) of hit words) and `_items` (ids found, as sorted strings)."""
    items = dealt(benchmark, item_id, item_text, block_words)
    last = items.agg(F.max("block")).first()[0] or 0
    keep = [c for c in keep if c not in ("_n_words", "_runs", "_items")]
    if last == 0:
        block = block_of(items, 0, window)

        def whole(texts):
            sizes, runs, found = block.search(texts)
            return [pa.array(sizes, pa.int64()), list_array(runs, pa.int64()), pa.array(found, pa.list_(pa.string()))]

        out = map_texts(df, keep, text, [field("_n_words", "long"), field("_runs", "longs"), field("_items", "strings")], whole)
        return out.withColumn("_runs", merged(F.col("_runs")))

    digest = F.unhex(F.substring(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256), 1, 32))
    folder = new_path(df.sparkSession, "contamination")
    for number in range(last + 1):
        hits(df.select(digest.alias("digest"), F.col(f"`{text}`").cast("string").alias("text")), block_of(items, number, window)).write.mode("append").parquet(folder)
    found = df.sparkSession.read.schema(HITS).parquet(folder).groupBy("digest").agg(F.flatten(F.collect_set("runs")).alias("runs"), F.flatten(F.collect_set("items")).alias("items"))

    def count(texts):
        return [pa.array([len(words_of(t)) for t in texts], pa.int64())]

    own = [f"c{i}" for i in range(len(keep))]
    rows = map_texts(df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, own, strict=True)], digest.alias("digest"), F.col(f"`{text}`").alias("text")), [*own, "digest"], "text", [field("_n_words", "long")], count)
    out = rows.join(found, "digest", "left").withColumns({"runs": F.coalesce("runs", F.array().cast("array<long>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(*[F.col(x).alias(c) for c, x in zip(keep, own, strict=True)], "_n_words", merged(F.col("runs")).alias("_runs"), F.array_sort(F.array_distinct("items")).alias("_items"))


def hits(texts: DataFrame, block: Block) -> DataFrame:
    """(digest, runs, items) of the texts (digest, text) that hold a pattern of the block."""

    def run(batches):
        for batch in batches:
            for part, data in slices(batch):
                _, runs, items = block.search(data)
                at = [i for i, r in enumerate(runs) if len(r)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), list_array([runs[i] for i in at], pa.int64()), pa.array([items[i] for i in at], pa.list_(pa.string()))], names=["digest", "runs", "items"])

    modest_batches(texts.sparkSession)
    return texts.mapInArrow(run, HITS)


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of `contamination`'s rows and the counts and digest of what was found."""
    keep = [c for c in keep if c not in ("_n_words", "_runs", "_items", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    n_hit = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return found.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_runs") > 0).alias("contaminated"),
    )
