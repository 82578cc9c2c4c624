"""Byte-level BPE encoding and decoding.

Overlapping chunk encoding: a long text is cut into chunks that overlap, the chunks are
pre-tokenised in parallel, neighbours are stitched at the first boundary both have in their
overlap, and the pieces between those points are encoded in parallel. From a shared boundary on
both chunks cut alike, since a match depends only on what follows it. Where neighbours share no
boundary (one pre-token as long as the overlap), they are encoded as one piece. Short texts are
one chunk and never leave their task. Decoding concatenates the bytes of the ids.

Null text: empty, no ids. Empty text: no ids. Repeated rows give repeated results. Bytes that are
not UTF-8 are replaced as Python's decoder does. An id unknown to the vocabulary decodes to
nothing. A kept column named like one that is made here gives way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from base64 import b64decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import field, map_texts, slices

LONG_CHARS = 32_768
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: A boundary this near the end of a chunk may come from the cut.
MARGIN_CHARS = 8
#: Pre-tokens in each half of a task's cache, and characters of the longest one that is kept.
CACHED, SHORT = 100_000, 48


NO_RANK = (1 << 31) - 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank, the leftmost first, is joined until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # part that starts at i is piece[i:end[i]]; 0 once it is joined to its left
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(queue, (r, left, stop))
    return [ranks[piece[i:e]] for i, e in enumerate(end) if e]


class Pairs:
    """The rank of every joinable pair of ids, in an open-addressed table; `merged` joins many pre-tokens step by step at once."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        self.byte_ids = np.array([ranks.get(bytes([c]), NO_RANK) for c in range(256)], np.int32)
        self.bits = max(10, (4 * len(rank)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        key = (left << 32) | right
        slot = self.slot(left, right)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            key, rank, slot = (np.delete(x, put) for x in (key, rank, slot))
            slot = (slot + 1) & ((1 << self.bits) - 1)

    def slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key, slot = (left.astype(np.int64) << 32) | right, self.slot(left, right)
        out, open_ = self.ranks[slot], np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        out[self.keys[slot] != key] = NO_RANK
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word, none empty: in each step every word joins its leftmost pair of least rank."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        pair = np.append(np.where(owner[1:] == owner[:-1], self.rank(ids[:-1], ids[1:]), NO_RANK), NO_RANK)
        done_ids, done_owner = [], []
        while len(ids):
            begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            count = np.diff(np.append(begin, len(owner)))
            least = np.minimum.reduceat(pair, begin)
            if (least == NO_RANK).any():
                rest = np.repeat(least < NO_RANK, count)
                done_ids.append(ids[~rest])
                done_owner.append(owner[~rest])
                ids, owner, pair, count, least = ids[rest], owner[rest], pair[rest], count[least < NO_RANK], least[least < NO_RANK]
                if not len(ids):
                    break
            at = np.flatnonzero(pair == np.repeat(least, count))
            at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, pair = ids[keep], owner[keep], pair[keep]
            at = at - np.arange(len(at))
            for i in (at, at[at > 0] - 1):
                after = np.minimum(i + 1, len(ids) - 1)
                pair[i] = np.where((after > i) & (owner[i] == owner[after]), self.rank(ids[i], ids[after]), NO_RANK)
        owner = np.concatenate([np.empty(0, np.int64), *done_owner])
        order = np.argsort(owner, kind="stable")
        data = np.concatenate([np.empty(0, np.int32), *done_ids])[order].astype("<u4").tobytes()
        stop = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [data[a:b] for a, b in zip([0, *stop], stop)]


class Packed(dict):
    """Packed ids of short pre-tokens. When full, what is here becomes the older half, which the next full one replaces."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pairs, self.older = ranks, Pairs(ranks), {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            ids = merge(word.encode(), self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= SHORT:
            self[word] = packed
        return packed

    def learn(self, words: set[str]) -> None:
        """Make the short ones of the words that are not known yet, all together."""
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        new = []
        for w in words - self.keys():
            if (packed := self.older.get(w)) is not None:
                self[w] = packed
            elif len(w) <= SHORT:
                if (whole := self.ranks.get(w.encode())) is not None:
                    self[w] = struct.pack("<I", whole)
                else:
                    new.append(w)
        self.update(zip(new, self.pairs.merged([w.encode() for w in new])))


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.pieces[rank] = token
        self.pattern = regex.compile(pattern)
        self.packed = Packed(self.ranks)

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.pattern.findall(t) for t in texts]
        self.packed.learn(set().union(*found))
        return [b"".join(map(self.packed.__getitem__, x)) for x in found]

    def decode(self, ids: bytes) -> bytes:
        known = np.frombuffer(ids, "<u4")
        return b"".join(map(self.pieces.__getitem__, known[known < len(self.pieces)].tolist()))

    def ends(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text)]


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(df: DataFrame, *, ranks_path: str, pattern: str, keep: list[str], text: str = "text", long_chars: int = LONG_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """The columns `keep` and `_ids`, binary: the ids of the whole text as little-endian unsigned 32-bit integers.

    ranks_path: a tiktoken rank file that every executor can open. Each match of `pattern` is encoded by itself.
    """
    if not chunk > overlap > 2 * MARGIN_CHARS:
        raise ValueError("chunk > overlap > 16 is needed")
    keep = [c for c in keep if c != "_ids"]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = [f"c{i}" for i in range(len(keep))]  # no name that is used here
    kept = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, own, strict=True)], whole.alias("_text"))
    is_long = F.length("_text") > long_chars

    def short(texts):
        v = vocabulary(ranks_path, pattern)
        return [pa.array(v.encode([t.decode(errors="replace") for t in texts]), pa.binary())]

    done = map_texts(kept.where(~is_long), own, "_text", [field("_ids", "binary")], short)
    key = F.sha2(F.col("_text").cast("binary"), 256)
    pieces = long_ids(kept.where(is_long).select(key.alias("_key"), "_text"), ranks_path, pattern, chunk, overlap)
    rest = kept.where(is_long).select(*own, key.alias("_key"))
    return done.unionByName(rest.join(pieces, "_key").drop("_key")).toDF(*keep, "_ids")


def long_ids(texts: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """_key, _ids for the distinct texts of (_key, _text)."""

    def cut_up(batches):
        seen: set[str] = set()  # a task hands on each text once, however many copies it meets
        for batch in batches:
            for part, whole in slices(batch):
                for key, data in zip(part.column(0).to_pylist(), whole, strict=True):
                    if key in seen:
                        continue
                    seen.add(key)
                    t = data.decode(errors="replace")
                    starts = list(range(0, max(1, len(t) - overlap), chunk))
                    for i, s in enumerate(starts):
                        last = i == len(starts) - 1
                        piece = t[s:] if last else t[s : s + chunk + overlap]
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i], pa.int32()), pa.array([s], pa.int64()), pa.array([last]), pa.array([piece])], names=["_key", "_chunk", "_start", "_last", "_text"])

    def boundaries(batches):
        """Adds where the chunk's own cuts fall: in the overlap with the chunk before, and in that with the next."""
        v = vocabulary(ranks_path, pattern)
        for batch in batches:
            for part, chunks in slices(batch):
                heads, tails = [], []
                for i, s, last, data in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), chunks, strict=True):
                    t = data.decode()
                    trusted = len(t) if last else len(t) - MARGIN_CHARS
                    ends = [e for e in v.ends(t) if e <= trusted]
                    heads.append([s + e for e in [0, *ends] if e <= overlap] if i else [])
                    tails.append([] if last else [s + e for e in ends if e >= chunk])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64())), part.columns[-1]], names=["_key", "_chunk", "_start", "_last", "_head", "_tail", "_text"])

    def encoded(batches):
        v = vocabulary(ranks_path, pattern)
        for batch in batches:
            for part, chunks in slices(batch):
                ids = v.encode([t.decode() for t in chunks])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=["_key", "_run", "_ids"])

    schema = "_key string, _chunk int, _start long, _last boolean, _text string"
    chunks = texts.mapInArrow(cut_up, schema).repartition("_key", "_chunk").mapInArrow(boundaries, "_key string, _chunk int, _start long, _last boolean, _head array<long>, _tail array<long>, _text string")
    # A text's own chunks only: the window is as large as one row of the input was.
    by_text = Window.partitionBy("_key").orderBy("_chunk")
    first_copy = F.row_number().over(Window.partitionBy("_key", "_chunk").orderBy("_start")) == 1
    stitched = (
        chunks.withColumn("_one", first_copy)
        .where("_one")
        .withColumn("_from", F.when(F.col("_chunk") == 0, 0).otherwise(F.array_min(F.array_intersect("_head", F.lag("_tail").over(by_text)))))
        .withColumn("_run", F.count("_from").over(by_text))
        .select("_key", "_run", "_chunk", "_start", "_from", F.when(F.col("_last"), F.col("_text")).otherwise(F.substring("_text", 1, chunk + overlap)).alias("_text"), "_last")
    )
    next_from = F.lead("_from").over(by_text)
    # Each chunk hands on its characters from its own point to the next one's; an unstitched one its whole step.
    until = F.when(F.col("_last"), F.col("_start") + F.length("_text")).otherwise(F.coalesce(next_from, F.col("_start") + chunk))
    since = F.coalesce("_from", "_start")
    parts = stitched.withColumn("_until", until).withColumn("_since", since).select(
        "_key", "_run", "_chunk", F.expr("substring(_text, cast(_since - _start + 1 as int), cast(_until - _since as int))").alias("_text")
    )
    joined = parts.groupBy("_key", "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_text"))), lambda p: p["_text"]), "").alias("_text"))
    ids = joined.repartition("_key", "_run").mapInArrow(encoded, "_key string, _run long, _ids binary")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_run", "_ids"))), lambda p: p["_ids"])
    return ids.groupBy("_key").agg(F.aggregate(ordered, F.expr("X''"), lambda a, b: F.concat(a, b)).alias("_ids"))


def digests(encoded: DataFrame, *, ranks_path: str, pattern: str, keep: list[str]) -> DataFrame:
    """Of `encode`'s rows: the columns `keep`, n_tokens, and the SHA-256 of the ids and of the bytes they decode to."""
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    keep = [c for c in keep if c not in ("_ids", *new)]
    own = [f"c{i}" for i in range(len(keep))]
    rows = encoded.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, own, strict=True)], "_ids")

    def run(batches):
        v = vocabulary(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = part.column(part.num_columns - 1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(v.decode(x)).hexdigest() for x in ids])],
                    names=[*own, *new],
                )

    schema = rows.drop("_ids").schema
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema).toDF(*keep, *new)
