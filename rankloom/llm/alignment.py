"""Alignment of two tokenizers over the same bytes: a byte-level BPE (A) and a piece model with byte fallback (B).

A text's tokens are rows of two token-byte incidence matrices in compressed sparse rows. The product A·Bᵀ, made row
by row (Gustavson), has an entry for each pair of tokens that overlap: the links. Offsets where tokens of both end
cut the text into groups; the product of the token-group incidences has an entry for each pair in a common group.

Both tokenizers work on the parts of a text between single spaces as they do on the whole: no pre-token of A and no
piece of B reaches over such a space (the latter is tested on the vocabulary; else a text is one part). So the
distinct parts of a slice are encoded and multiplied together, once, and a text's figures are sums over its parts.

Links are counted over all texts by id pair. The counted pairs go to the tasks in blocks of at most `PAIRS`, one
block at a time, so that memory doesn't follow the vocabulary; the texts' own links never pass through the driver.

Null and empty texts, and texts whose joined A or B bytes differ from space + text, have no tokens: zeros, and an
empty digest. Repeated rows count as often as they occur. An empty table gives an empty table. A long text is held
whole, a few times over, by its task. Kept columns named like a new one give way to it.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.lineage import written
from rankloom.llm.common import field, map_texts

#: Counted id pairs that a task holds at once (17 bytes each).
PAIRS = 2_000_000
#: Parts whose tokens a worker remembers, and id pairs that it counts before it hands them on.
CACHE_PARTS, CACHE_PAIRS = 200_000, 1_000_000
#: A single space between characters of which neither is white space.
_SPACE = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")
#: Characters whose classes all versions of Unicode agree on, so that two readings of the pre-token pattern can't differ.
_PLAIN = re.compile("[\\t\\n -~\u00a1-\u024f]*")
#: The pre-token pattern of byte-level BPE, and the piece model's mark for a space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_MARK = "▁"


class Csr:
    """Rows of sorted column numbers: those of row i are `indices[indptr[i]:indptr[i + 1]]`."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, columns: int):
        self.indptr, self.indices, self.columns = indptr, indices, columns

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.concatenate(([0], np.cumsum(counts))), self.rows()[order], len(self.indptr) - 1)

    def times(self, other: Csr) -> Csr:
        """The pattern of the product: each row is the union of the rows of `other` that its entries name."""
        sizes = np.diff(other.indptr)[self.indices]
        cols = other.indices[np.repeat(other.indptr[self.indices] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        keys = np.unique(np.repeat(self.rows(), sizes) * other.columns + cols)
        rows = keys // max(1, other.columns)
        return Csr(np.searchsorted(rows, np.arange(len(self.indptr))), keys - rows * other.columns, other.columns)


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: each token covers the bytes after those of the token before it."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate(([0], ends)), np.arange(total), total)


def grouped(a: Csr, b: Csr) -> tuple[Csr, Csr]:
    """Tokens by groups, for both sides; groups end where a token of each side ends."""
    ends = np.intersect1d(a.indptr[1:], b.indptr[1:], assume_unique=True)
    of = lambda m: Csr(np.arange(len(m.indptr)), np.searchsorted(ends, m.indptr[1:]), len(ends))
    return of(a), of(b)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin[i], ..., begin[i] + size[i] - 1 of every i, one after another."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


class Tokenizers:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        own = byte_characters()
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(own[c] for c in token if c in own)
        # The same merges with less work for each part: a token's number is its rank, and no token can be merged in a way that the list of merges lacks.
        self.fast = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in vocabulary.values()}, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes))
        self.whole = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)

    def parts(self, text: str) -> list[str]:
        return [text] if self.whole else _SPACE.split(text)

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [self.fast.encode_ordinary(" " + p) if _PLAIN.fullmatch(p) else None for p in parts]
        rest = [i for i, x in enumerate(a) if x is None]
        for i, e in zip(rest, self.a.encode_batch_fast([" " + parts[i] for i in rest], add_special_tokens=False), strict=True):
            a[i] = e.ids
        return a, self.b.encode(parts, num_threads=1)


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Digests:
    """The text `a1,a2|b1;a3|b2,b3` of parts: the ids of each group in order."""

    def __init__(self, n_a: int, n_b: int):
        ended = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        self.a, self.a_last, self.b, self.b_last, self.b_end = ended(n_a, ","), ended(n_a, "|"), ended(n_b, ","), ended(n_b, ";"), ended(n_b, "")

    def texts(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
        """Of parts with n_a and n_b tokens; the groups are numbered through all parts."""
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        end = np.zeros(len(b), bool)
        end[np.cumsum(n_b)[n_b > 0] - 1] = True
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = np.where(last_a, self.a_last[a], self.a[a])
        out[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = np.where(end, self.b_end[b], np.where(last_b, self.b_last[b], self.b[b]))
        words, edges = out.tolist(), np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        return ["".join(words[i:j]).encode() for i, j in zip(edges[:-1], edges[1:], strict=True)]


class Parts:
    """What is known of the parts met so far: figures, the groups as text, and the id pairs of their links."""

    FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_shared")

    def __init__(self, both: Tokenizers):
        self.both = both
        self.digests = Digests(len(both.a_bytes), len(both.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.figures = np.empty((0, len(self.FIGURES)), np.int64)
        self.good = np.empty(0, bool)
        self.texts: list[bytes] = []
        self.pairs, self.begin = np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, parts: list[str]) -> np.ndarray:
        """The number of each part; new ones are encoded."""
        if len(self.place) > CACHE_PARTS or len(self.pairs) > 16 * CACHE_PARTS:
            self.clear()
        new = [p for p in dict.fromkeys(parts) if p not in self.place]
        if new:
            self.learn(new)
        return np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))

    def learn(self, new: list[str]) -> None:
        both = self.both
        a, b = both.encode(new)
        wanted = [(" " + p).encode("utf-8", "replace") for p in new]
        good = np.array([b"".join(map(both.a_bytes.__getitem__, x)) == w == b"".join(map(both.b_bytes.__getitem__, y)) for x, y, w in zip(a, b, wanted, strict=True)])
        a, b = ([x if g else [] for x, g in zip(side, good.tolist(), strict=True)] for side in (a, b))
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(new)) for side in (a, b))
        ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
        # One matrix for all new parts: their bytes follow each other, and both sides end where a part ends.
        at_a, at_b = incidence(both.a_size[ids_a]), incidence(both.b_size[ids_b])
        links = at_a.times(at_b.transposed())
        group_a, group_b = grouped(at_a, at_b)
        part_a = np.repeat(np.arange(len(new)), n_a)
        rows = links.rows()
        n_links = np.bincount(part_a[rows], minlength=len(new))
        in_group = np.bincount(group_b.indices, minlength=group_b.columns)
        n_shared = np.bincount(part_a, weights=in_group[group_a.indices], minlength=len(new)).astype(np.int64)
        last = np.diff(group_a.indices, append=-1) != 0
        n_groups = np.bincount(part_a[last], minlength=len(new))
        self.texts += self.digests.texts(ids_a, ids_b, group_a.indices, group_b.indices, n_a, n_b)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.figures = np.concatenate((self.figures, np.stack((n_a, n_b, n_groups, n_links, n_shared), axis=1)))
        self.good = np.concatenate((self.good, good))
        self.begin = np.concatenate((self.begin, len(self.pairs) + np.cumsum(n_links) - n_links))
        self.pairs = np.concatenate((self.pairs, ids_a[rows] * len(both.b_bytes) + ids_b[links.indices]))


@lru_cache(maxsize=1)
def parts_known(byte_path: str, piece_path: str) -> Parts:
    """Those of this worker."""
    return Parts(Tokenizers(byte_path, piece_path))


def packed(pairs: np.ndarray, counts: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Sorted id pairs, as gaps, and how often each occurs, compressed."""
    return squeeze.compress(np.concatenate((np.diff(pairs, prepend=0), counts)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes, unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    x = np.ascontiguousarray(np.frombuffer(unpack.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    n = len(x) // 2
    return np.cumsum(x[:n]), x[n:]


def aligned(df: DataFrame, *, byte_path: str, piece_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, the figures of each text, `groups_sha256` and its packed links `_links`; nothing is shuffled."""

    def work(texts):
        known = parts_known(byte_path, piece_path)
        squeeze = zstandard.ZstdCompressor(level=1)
        cut_up = []
        for t in texts:
            try:
                cut_up.append(known.both.parts(t.decode()) if t else [])
            except UnicodeDecodeError:
                cut_up.append([])
        n = np.fromiter(map(len, cut_up), np.int64, len(texts))
        flat = known.of([p for parts in cut_up for p in parts])
        doc = np.repeat(np.arange(len(texts)), n)
        bad = np.unique(doc[~known.good[flat]])
        has = ~np.isin(doc, bad)
        flat, doc = flat[has], doc[has]
        figures = np.zeros((len(texts), len(Parts.FIGURES)), np.int64)
        np.add.at(figures, doc, known.figures[flat])
        edges = np.searchsorted(doc, np.arange(len(texts) + 1))
        digests = [hashlib.sha256(b";".join([known.texts[i] for i in flat[s:e].tolist()])).hexdigest() if e > s else "" for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        size = known.figures[flat, 3]
        keys = np.sort(np.repeat(doc, size) << 32 | known.pairs[ragged(known.begin[flat], size)])
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.diff(first, append=len(keys))
        keys = keys[first]
        ends = np.searchsorted(keys, np.arange(len(texts) + 1) << 32)
        links = [packed(keys[s:e] & 0xFFFFFFFF, counts[s:e], squeeze) if e > s else b"" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return [*(pa.array(figures[:, i], pa.int64()) for i in range(figures.shape[1])), pa.array(digests, pa.string()), pa.array(links, pa.binary())]

    return map_texts(df, keep, text, [*(field(x, "long") for x in Parts.FIGURES), field("groups_sha256", "string"), field("_links", "binary")], work)


def pair_counts(links: DataFrame, pieces: int) -> DataFrame:
    """(pair, n, best) of the packed column `_links`: how many links hold the id pair, and whether none of its B id has more."""

    def run(batches):
        unpack, held, size = zstandard.ZstdDecompressor(), [], 0

        def out():
            pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(where, weights=np.concatenate([c for _, c in held])).astype(np.int64)

        for batch in batches:
            for data in batch.column(0).to_pylist():
                if data:
                    held.append(unpacked(data, unpack))
                    size += len(held[-1][0])
                if size > CACHE_PAIRS:
                    held, size = [out()], 0
                    if len(held[0][0]) > CACHE_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["pair", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out()], names=["pair", "n"])

    counts = links.select("_links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % pieces))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def looked_up(rows: DataFrame, counts: DataFrame, most: int = PAIRS) -> DataFrame:
    """`rows` without `_links` but with `n_best` and `count_sum`; `counts` (a written table) goes out in blocks of about `most` pairs.

    One block is looked up in the stage that reads the rows; several make a pass each over the rows' links, and their sums meet by row number."""
    spark = rows.sparkSession
    blocks = 1 + counts.count() // most

    def block(i: int, source: DataFrame) -> DataFrame:
        table = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i).toArrow()
        order = np.argsort(table.column("pair").to_numpy())
        sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

        def run(batches):
            unpack = zstandard.ZstdDecompressor()
            known, n, best = sent.value
            for batch in batches:
                found = []
                for data in batch.column(batch.num_columns - 1).to_pylist():
                    if not data or not len(known):
                        found.append((0, 0))
                        continue
                    pairs, times = unpacked(data, unpack)
                    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    times = np.where(known[at] == pairs, times, 0)
                    found.append((int(times @ best[at]), int(times @ n[at])))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], names=[*batch.schema.names[:-1], "n_best", "count_sum"])

        schema = source.drop("_links").schema.add("n_best", "long").add("count_sum", "long")
        return source.mapInArrow(run, schema)

    kept = [c for c in rows.columns if c != "_links"]
    if blocks == 1:
        return block(0, rows.select(*[F.col(f"`{c}`") for c in kept], "_links"))
    lines = written(rows.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_kept"), "_links"))
    sums = None
    for i in range(blocks):
        one = block(i, lines.select("_row", "_links"))
        sums = one if sums is None else sums.unionByName(one)
    sums = sums.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return lines.select("_row", "_kept").join(sums, "_row").select(*[F.col(f"_kept.`{c}`").alias(c) for c in kept], "n_best", "count_sum")


def alignment(df: DataFrame, *, byte_path: str, piece_path: str, keep: list[str], text: str = "text", most: int = PAIRS) -> DataFrame:
    """The columns `keep`, the figures of each text and its links by their counts over all texts."""
    import sentencepiece

    new = (*Parts.FIGURES, "groups_sha256", "n_best", "count_sum", "_links")
    rows = written(aligned(df, byte_path=byte_path, piece_path=piece_path, keep=[c for c in keep if c not in new], text=text))
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    return looked_up(rows, written(pair_counts(rows, pieces)), most)
